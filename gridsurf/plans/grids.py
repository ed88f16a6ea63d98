"""Queries of statistics and neighbourhood operators over planes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridsurf.functions import packing as P
from gridsurf.operators import stats
from gridsurf.operators import windows as N
from gridsurf.plans.fixtures import disc, pixels, planes, points, r6, sql, table

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return add


def _box(col: str, r: int, rel: str, keys: str = "vec_id, x, y") -> str:
    """Self-join form of a clipped square, independent of window frames."""
    return f"FROM {rel} a JOIN {rel} b ON a.vec_id = b.vec_id AND b.x BETWEEN a.x - {r} AND a.x + {r} AND b.y BETWEEN a.y - {r} AND a.y + {r}"


def subject():
    return F.col("alpha") >= 128


@query("win_box_mean", sql("px", f"SELECT a.vec_id, a.x, a.y, round(avg(b.v), 6) AS mean {_box('v', 1, 'px')} GROUP BY a.vec_id, a.x, a.y"))
def _(s, d):
    return N.box_mean(pixels(s, d), "v", 1, "mean").select("vec_id", "x", "y", r6(F.col("mean"), "mean"))


@query("win_masked_box_mean", sql("planes", f"SELECT a.vec_id, a.x, a.y, round(coalesce(avg(CASE WHEN b.alpha >= 128 THEN b.depth END), max(a.depth)), 6) AS mean {_box('', 2, 'planes')} GROUP BY a.vec_id, a.x, a.y"))
def _(s, d):
    return N.masked_box_mean(planes(s, d), F.col("depth"), subject(), 2, "mean").select("vec_id", "x", "y", r6(F.col("mean"), "mean"))


@query("win_box_blur_sep", sql("px", "m AS (SELECT a.vec_id, a.x, a.y, avg(b.v) AS m FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.y = b.y AND abs(a.x - b.x) <= 2 GROUP BY ALL) SELECT a.vec_id, a.x, a.y, round(avg(b.m), 6) AS blur FROM m a JOIN m b ON a.vec_id = b.vec_id AND a.x = b.x AND abs(a.y - b.y) <= 2 GROUP BY ALL"))
def _(s, d):
    return N.separable_mean(pixels(s, d), "v", 2, "blur").select("vec_id", "x", "y", r6(F.col("blur"), "blur"))


def _pass(rel: str, col: str) -> str:
    return f"SELECT a.vec_id, a.x, a.y, CAST(round_even(avg(b.{col}), 0) AS INT) AS v FROM {rel} a JOIN {rel} b ON a.vec_id = b.vec_id AND a.x = b.x AND abs(a.y - b.y) <= 6 GROUP BY ALL"


@query("win_vertical_blur3", sql("planes", f"p1 AS ({_pass('planes', 'r')}), p2 AS ({_pass('p1', 'v')}), p3 AS ({_pass('p2', 'v')}) SELECT vec_id, x, y, v FROM p3"))
def _(s, d):
    df = N.by_plane(planes(s, d)).withColumn("v", F.col("r"))
    for _ in range(3):
        df = df.withColumn("v", P.u8(F.avg("v").over(N.along_y(6))))
    return df.select("vec_id", "x", "y", "v")


@query("win_smooth_touched", sql("planes", "SELECT a.vec_id, a.x, a.y, round(CASE WHEN a.g >= 128 THEN (SELECT avg(b.depth) FROM planes b WHERE b.vec_id = a.vec_id AND b.x = a.x AND abs(a.y - b.y) <= 2 AND b.g >= 128) ELSE a.depth END, 6) AS v FROM planes a"))
def _(s, d):
    touched = F.col("g") >= 128
    mean = F.avg(F.when(touched, F.col("depth"))).over(N.along_y(2))
    return N.by_plane(planes(s, d)).select("vec_id", "x", "y", r6(F.when(touched, mean).otherwise(F.col("depth")), "v"))


@query("win_unsharp", sql("planes", f"SELECT a.vec_id, a.x, a.y, max(a.alpha) AS alpha, CAST(CASE WHEN max(a.alpha) >= 128 THEN least(255, greatest(0, round_even(max(a.r) + 0.6::DOUBLE * (max(a.r) - avg(CASE WHEN b.alpha >= 128 THEN b.r END)), 0))) ELSE max(a.r) END AS INT) AS r {_box('', 1, 'planes')} GROUP BY a.vec_id, a.x, a.y"))
def _(s, d):
    df = N.masked_box_mean(planes(s, d), F.col("r").cast("double"), subject(), 1, "mean")
    return df.select("vec_id", "x", "y", "alpha", F.when(subject(), P.u8(F.col("r") + 0.6 * (F.col("r") - F.col("mean")))).otherwise(F.col("r")).alias("r"))


@query("win_row_runs", sql("planes", "SELECT vec_id, y, min(x) AS x0, max(x) AS x1, count(*) AS n FROM (SELECT vec_id, y, x, x - row_number() OVER (PARTITION BY vec_id, y ORDER BY x) AS g FROM planes WHERE alpha >= 128) GROUP BY vec_id, y, g HAVING count(*) >= 2"))
def _(s, d):
    return N.runs(planes(s, d), subject()).filter("n >= 2")


@query("win_fill", sql("planes", """l AS (SELECT a.*, (SELECT arg_max(b.r, b.x) FROM planes b WHERE b.vec_id = a.vec_id AND b.y = a.y AND b.x < a.x AND b.g < 128) AS lf, (SELECT arg_min(b.r, b.x) FROM planes b WHERE b.vec_id = a.vec_id AND b.y = a.y AND b.x > a.x AND b.g < 128) AS rf FROM planes a)
SELECT vec_id, x, y, CAST(CASE WHEN g < 128 THEN r WHEN coalesce(lf, r) = r THEN coalesce(rf, lf, r) ELSE lf END AS INT) AS r FROM l"""))
def _(s, d):
    good = F.when(F.col("g") < 128, F.col("r"))
    left = F.last(good, ignorenulls=True).over(N.along_x().rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(good, ignorenulls=True).over(N.along_x().rowsBetween(1, Window.unboundedFollowing))
    df = N.by_plane(planes(s, d)).select("*", left.alias("lf"), right.alias("rf"))
    # a left fill that happens to equal the old value counts as none
    masked = F.when(F.coalesce("lf", "r") == F.col("r"), F.coalesce("rf", "lf", "r")).otherwise(F.col("lf"))
    return df.select("vec_id", "x", "y", F.when(F.col("g") < 128, F.col("r")).otherwise(masked).alias("r"))


@query("win_edge_replicate", sql("planes", "SELECT p.vec_id, o.x, o.y, p.r, CAST(CASE WHEN o.x = p.x AND o.y = p.y THEN p.alpha ELSE 0 END AS INT) AS alpha FROM (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM range(-2, 10) a(x), range(-2, 10) b(y)) o JOIN planes p ON p.x = least(7, greatest(0, o.x)) AND p.y = least(7, greatest(0, o.y))"))
def _(s, d):
    # each border pixel repeats outwards; no grid is joined
    return edge_replicate(planes(s, d), 2)


def edge_replicate(df, r: int):
    """Planes with r more pixels on every side, which repeat the border's colour with alpha 0."""
    whole = Window.partitionBy("vec_id")
    df = N.by_plane(df).select("*", *(f(c).over(whole).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    low = lambda c: F.when(F.col(c) == F.col(f"_lo{c}"), F.col(c) - r).otherwise(F.col(c))
    high = lambda c: F.when(F.col(c) == F.col(f"_hi{c}"), F.col(c) + r).otherwise(F.col(c))
    spread = lambda c: F.explode(F.sequence(low(c), high(c)))
    df = df.select("*", spread("x").alias("ox")).select("*", spread("y").alias("oy"))
    own = (F.col("ox") == F.col("x")) & (F.col("oy") == F.col("y"))
    return df.select("vec_id", F.col("ox").alias("x"), F.col("oy").alias("y"), "r", F.when(own, F.col("alpha")).otherwise(0).alias("alpha"))


@query("win_guided_filter", sql("planes", f"""m AS (SELECT a.vec_id, a.x, a.y, max(a.r) / 255.0::DOUBLE AS i0, avg(b.r / 255.0::DOUBLE) AS mi, avg(b.alpha / 255.0::DOUBLE) AS mp, avg(b.depth) AS md, avg(b.r / 255.0::DOUBLE * b.depth) AS mid, avg(b.r / 255.0::DOUBLE * (b.r / 255.0::DOUBLE)) AS mii {_box('', 2, 'planes')} GROUP BY a.vec_id, a.x, a.y),
k AS (SELECT vec_id, x, y, i0, (mid - mi * md) / (mii - mi * mi + 1e-4::DOUBLE) AS ka, md - (mid - mi * md) / (mii - mi * mi + 1e-4::DOUBLE) * mi AS kb FROM m)
SELECT a.vec_id, a.x, a.y, round(avg(b.ka) * max(a.i0) + avg(b.kb), 6) AS q {_box('', 2, 'k')} GROUP BY a.vec_id, a.x, a.y"""))
def _(s, d):
    return guided(planes(s, d).withColumn("i", F.col("r") / 255.0), ["i"], "depth", 2, 1e-4).select("vec_id", "x", "y", r6(F.col("q"), "q"))


def guided(df, guides: list[str], target: str, r: int, eps: float):
    """Edge-preserving smoothing of target by 1 or 3 guide columns: a local linear model in every square, then its mean. Adds q."""
    n = len(guides)
    sums = {"_c": F.lit(1.0), "_t": F.col(target)}
    sums |= {f"_g{i}": F.col(g) for i, g in enumerate(guides)} | {f"_gt{i}": F.col(g) * F.col(target) for i, g in enumerate(guides)}
    sums |= {f"_g{i}{j}": F.col(guides[i]) * F.col(guides[j]) for i in range(n) for j in range(i, n)}
    df = N.box(df, r, **sums)
    m = lambda c: F.col(c) / F.col("_c")
    cov = [m(f"_gt{i}") - m(f"_g{i}") * m("_t") for i in range(n)]
    var = [[m(f"_g{min(i, j)}{max(i, j)}") - m(f"_g{i}") * m(f"_g{j}") + (eps if i == j else 0.0) for j in range(n)] for i in range(n)]
    if n == 1:
        a = [cov[0] / var[0][0]]
    else:
        minor = lambda i, j: var[(i + 1) % 3][(j + 1) % 3] * var[(i + 2) % 3][(j + 2) % 3] - var[(i + 1) % 3][(j + 2) % 3] * var[(i + 2) % 3][(j + 1) % 3]
        det = sum((var[0][j] * minor(0, j) for j in range(3)), F.lit(0.0))
        a = [F.when(F.abs(det) < 1e-12, 0.0).otherwise(sum((minor(j, i) * cov[j] for j in range(3)), F.lit(0.0)) / det) for i in range(3)]
    df = df.select("*", *(x.alias(f"_a{i}") for i, x in enumerate(a)))
    df = df.withColumn("_b", m("_t") - sum((F.col(f"_a{i}") * m(f"_g{i}") for i in range(n)), F.lit(0.0)))
    df = N.box(df.drop(*sums), r, _n=F.lit(1.0), _mb=F.col("_b"), **{f"_ma{i}": F.col(f"_a{i}") for i in range(n)})
    q = sum((F.col(f"_ma{i}") * F.col(g) for i, g in enumerate(guides)), F.col("_mb")) / F.col("_n")
    return df.withColumn("q", q)


@query("mask_gate_dilate", sql("planes", f"SELECT a.vec_id, a.x, a.y, CAST(CASE WHEN max(b.g) >= 200 THEN max(a.alpha) ELSE 0 END AS INT) AS alpha {_box('', 1, 'planes')} GROUP BY a.vec_id, a.x, a.y"))
def _(s, d):
    df = N.extremes(planes(s, d), 1, open=(F.max, F.col("g")))
    return df.select("vec_id", "x", "y", F.when(F.col("open") >= 200, F.col("alpha")).otherwise(0).alias("alpha"))


@query("mask_soften_edge", sql("planes", f"SELECT a.vec_id, a.x, a.y, CAST(CASE WHEN max(b.alpha) >= 128 AND min(b.alpha) < 128 THEN round_even(avg(b.alpha), 0) ELSE max(a.alpha) END AS INT) AS alpha {_box('', 1, 'planes')} GROUP BY a.vec_id, a.x, a.y"))
def _(s, d):
    df = N.extremes(N.box_mean(planes(s, d), "alpha", 1, "mean"), 1, hi=(F.max, F.col("alpha")), lo=(F.min, F.col("alpha")))
    edge = (F.col("hi") >= 128) & (F.col("lo") < 128)
    return df.select("vec_id", "x", "y", F.when(edge, P.u8(F.col("mean"))).otherwise(F.col("alpha")).alias("alpha"))


@query("mask_torso_head", sql("planes", """b AS (SELECT vec_id, min(y) AS y0, max(y) AS y1 FROM planes WHERE alpha >= 128 GROUP BY vec_id), r AS (SELECT vec_id, y, min(x) AS x0, max(x) AS x1 FROM planes WHERE alpha >= 128 GROUP BY vec_id, y)
SELECT p.vec_id, p.x, p.y FROM planes p JOIN b USING (vec_id) JOIN r ON r.vec_id = p.vec_id AND r.y = p.y WHERE p.alpha >= 128 AND p.y <= y0 + (y1 - y0) * 0.55::DOUBLE AND abs(p.x - (x0 + x1) / 2.0) <= (x1 - x0) * 0.3::DOUBLE"""))
def _(s, d):
    df = N.by_plane(planes(s, d)).filter(subject())
    whole, row = Window.partitionBy("vec_id"), Window.partitionBy("vec_id", "y")
    df = df.select("vec_id", "x", "y", F.min("y").over(whole).alias("y0"), F.max("y").over(whole).alias("y1"), F.min("x").over(row).alias("x0"), F.max("x").over(row).alias("x1"))
    return df.filter("y <= y0 + (y1 - y0) * 0.55D AND abs(x - (x0 + x1) / 2.0D) <= (x1 - x0) * 0.3D").select("vec_id", "x", "y")


_L1 = """o AS (SELECT vec_id, x, y FROM planes WHERE alpha < 128 UNION ALL SELECT v.vec_id, CAST(a.x AS INT), CAST(b.y AS INT) FROM (SELECT DISTINCT vec_id FROM planes) v, range(-1, 9) a(x), range(-1, 9) b(y) WHERE a.x IN (-1, 8) OR b.y IN (-1, 8)),
l AS (SELECT p.vec_id, p.x, p.y, CASE WHEN max(p.alpha) < 128 THEN 0 ELSE min(abs(p.x - o.x) + abs(p.y - o.y)) END AS l1 FROM planes p JOIN o ON o.vec_id = p.vec_id GROUP BY ALL)"""


@query("mask_erosion_distance", sql("planes", _L1 + " SELECT vec_id, x, y, CAST(CASE WHEN l1 = 0 THEN 0 WHEN l1 < 3 THEN l1 - 1 ELSE 3 END AS INT) AS dist FROM l"))
def _(s, d):
    return N.border_distance(planes(s, d), subject(), 3, "dist").select("vec_id", "x", "y", F.col("dist").cast("int").alias("dist"))


@query("calib_rim_calm", sql("planes", _L1 + f""", m AS (SELECT a.vec_id, a.x, a.y, max(a.depth) AS z, max(a.alpha) AS alpha, coalesce(avg(CASE WHEN b.alpha >= 128 THEN b.depth END), max(a.depth)) AS mean {_box('', 2, 'planes')} GROUP BY a.vec_id, a.x, a.y)
SELECT m.vec_id, m.x, m.y, round(CASE WHEN alpha >= 128 AND dd < 3 THEN z * dd / 3.0::DOUBLE + mean * (1 - dd / 3.0::DOUBLE) ELSE z END, 6) AS z FROM m JOIN (SELECT vec_id, x, y, CASE WHEN l1 = 0 THEN 0 WHEN l1 < 3 THEN l1 - 1 ELSE 3 END AS dd FROM l) USING (vec_id, x, y)"""))
def _(s, d):
    return rim_calm(planes(s, d), "depth", 2, 3).select("vec_id", "x", "y", r6(F.col("depth"), "z"))


def rim_calm(df, z: str, r: int, band: int):
    """Blends z into its masked mean towards the silhouette."""
    df = N.border_distance(N.masked_box_mean(df, F.col(z), subject(), r, "_mean"), subject(), band, "_rim")
    w = 1 - F.col("_rim") / float(band)
    return df.withColumn(z, F.when(subject() & (F.col("_rim") < band), F.col(z) * (1 - w) + F.col("_mean") * w).otherwise(F.col(z))).drop("_mean", "_rim")


@query("calib_enhance_relief", sql("planes", _L1 + f""", f AS (SELECT a.vec_id, a.x, a.y, max(a.depth) AS z, max(a.alpha) AS alpha, coalesce(avg(CASE WHEN b.alpha >= 128 AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 THEN b.depth END), max(a.depth)) AS fine, coalesce(avg(CASE WHEN b.alpha >= 128 THEN b.depth END), max(a.depth)) AS base {_box('', 3, 'planes')} GROUP BY a.vec_id, a.x, a.y)
SELECT vec_id, x, y, round(CASE WHEN alpha >= 128 THEN base + (fine - base) * (1 + 2 * t * t * (3 - 2 * t)) + (z - fine) ELSE z END, 6) AS z FROM (SELECT f.*, least(1.0, (CASE WHEN l1 = 0 THEN 0 WHEN l1 < 3 THEN l1 - 1 ELSE 3 END) / 3.0)::DOUBLE AS t FROM f JOIN l USING (vec_id, x, y))"""))
def _(s, d):
    df = N.masked_box_mean(planes(s, d), F.col("depth"), subject(), 1, "fine")
    df = N.border_distance(N.masked_box_mean(df, F.col("depth"), subject(), 3, "base"), subject(), 3, "rim")
    t = F.col("rim") / 3.0
    boosted = F.col("base") + (F.col("fine") - F.col("base")) * (1 + 2 * t * t * (3 - 2 * t)) + (F.col("depth") - F.col("fine"))
    return df.select("vec_id", "x", "y", r6(F.when(subject(), boosted).otherwise(F.col("depth")), "z"))


@query("geom_relief_clamp", sql("planes", f"""f AS (SELECT a.vec_id, a.x, a.y, max(a.depth) AS z, max(a.alpha) AS alpha, coalesce(avg(CASE WHEN b.alpha >= 128 AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 THEN b.depth END), max(a.depth)) AS den, coalesce(avg(CASE WHEN b.alpha >= 128 THEN b.depth END), max(a.depth)) AS trend {_box('', 3, 'planes')} GROUP BY a.vec_id, a.x, a.y)
SELECT vec_id, x, y, round(CASE WHEN alpha >= 128 THEN CASE WHEN abs(den - trend) <= 0.04 THEN den ELSE trend + sign(den - trend) * (0.04::DOUBLE + 0.04::DOUBLE * tanh((abs(den - trend) - 0.04::DOUBLE) / 0.04::DOUBLE)) END ELSE z END, 6) AS z FROM f"""))
def _(s, d):
    df = N.masked_box_mean(N.masked_box_mean(planes(s, d), F.col("depth"), subject(), 1, "den"), F.col("depth"), subject(), 3, "trend")
    over = F.col("den") - F.col("trend")
    soft = F.col("trend") + F.signum(over) * (0.04 + 0.04 * F.tanh((F.abs(over) - 0.04) / 0.04))
    return df.select("vec_id", "x", "y", r6(F.when(subject(), F.when(F.abs(over) <= 0.04, F.col("den")).otherwise(soft)).otherwise(F.col("depth")), "z"))


_NB = "(SELECT b.depth - a.depth FROM planes b WHERE b.vec_id = a.vec_id AND b.x = a.x + {dx} AND b.y = a.y + {dy} AND b.alpha >= 128)"
_GAPS = f"""g AS (SELECT a.vec_id, a.x, a.y, a.depth, {_NB.format(dx=-1, dy=0)} AS l, {_NB.format(dx=1, dy=0)} AS r, {_NB.format(dx=0, dy=-1)} AS u, {_NB.format(dx=0, dy=1)} AS dn FROM planes a WHERE a.alpha >= 128),
e AS (SELECT *, greatest(coalesce(l, 0), coalesce(r, 0), coalesce(u, 0), coalesce(dn, 0), 0) AS gap FROM g),
ed AS (SELECT *, CASE WHEN gap <= 0 THEN 'none' WHEN l = gap THEN 'left' WHEN r = gap THEN 'right' WHEN u = gap THEN 'up' ELSE 'down' END AS dir FROM e)"""


def gaps(df):
    """Largest step to the back over the four subject neighbours and its direction, the first of equals."""
    df = N.neighbours(df, F.when(subject(), F.col("depth"))).filter(subject())
    each = [F.coalesce(F.col(n) - F.col("depth"), F.lit(0.0)) for n in ("left", "right", "up", "down")]
    gap = F.greatest(*each, F.lit(0.0))
    df = df.withColumn("gap", gap)
    side = F.when(F.col("gap") <= 0, "none")
    for n, e in zip(("left", "right", "up", "down"), each, strict=True):
        side = side.when(e == F.col("gap"), n)
    return df.withColumn("dir", side)


@query("edge_gap_max", sql("planes", _GAPS + " SELECT vec_id, x, y, round(gap, 6) AS gap, dir FROM ed"))
def _(s, d):
    return gaps(planes(s, d)).select("vec_id", "x", "y", r6(F.col("gap"), "gap"), "dir")


_BAND = "500 * (1 + depth) * tan(radians(45.0::DOUBLE)) * gap / ((1 + depth) * (1 + depth + gap))"
_MASK = _GAPS + f""", st AS (SELECT vec_id, x, y, dir, CAST(floor(least(4, greatest(1, {_BAND} / 50)) + 0.5) AS INT) AS w FROM ed WHERE gap >= 0.02 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6),
mk AS (SELECT DISTINCT vec_id, x, y FROM (SELECT vec_id, x + CASE dir WHEN 'left' THEN -k WHEN 'right' THEN k ELSE 0 END AS x, y + CASE dir WHEN 'up' THEN -k WHEN 'down' THEN k ELSE 0 END AS y FROM (SELECT *, unnest(range(1, w + 1)) AS k FROM st)) WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7)"""


def inpaint_mask(df):
    """Pixels behind depth steps that a turned camera would expose."""
    g = gaps(df).filter("gap >= 0.02 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6")
    near, far = 1 + F.col("depth"), 1 + F.col("depth") + F.col("gap")
    band = 500 * near * F.tan(F.radians(F.lit(45.0))) * F.col("gap") / (near * far) / 50
    g = g.select("vec_id", "x", "y", "dir", F.explode(F.sequence(F.lit(1), P.half_up(P.clamp(band, 1.0, 4.0)).cast("int"))).alias("k"))
    step = lambda a, b: F.when(F.col("dir") == a, -F.col("k")).when(F.col("dir") == b, F.col("k")).otherwise(0)
    return g.select("vec_id", (F.col("x") + step("left", "right")).alias("x"), (F.col("y") + step("up", "down")).alias("y")).filter("x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7").distinct()


@query("inpaint_mask", sql("planes", _MASK + " SELECT vec_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM mk"))
def _(s, d):
    return inpaint_mask(planes(s, d))


@query("inpaint_composite", sql("planes", _MASK + f""", f AS (SELECT p.*, CASE WHEN mk.x IS NULL THEN 0 ELSE 255 END AS m FROM planes p LEFT JOIN mk USING (vec_id, x, y)),
h AS (SELECT a.vec_id, a.x, a.y, avg(b.m) AS m FROM f a JOIN f b ON a.vec_id = b.vec_id AND a.y = b.y AND abs(a.x - b.x) <= 1 GROUP BY ALL), v AS (SELECT a.vec_id, a.x, a.y, avg(b.m) / 255 AS w FROM h a JOIN h b ON a.vec_id = b.vec_id AND a.x = b.x AND abs(a.y - b.y) <= 1 GROUP BY ALL)
SELECT f.vec_id, f.x, f.y, CAST(round_even(f.r * (1 - w) + f.b * w, 0) AS INT) AS r FROM f JOIN v USING (vec_id, x, y)"""))
def _(s, d):
    df = planes(s, d)
    mask = inpaint_mask(df).withColumn("m", F.lit(255.0))
    df = N.separable_mean(df.join(mask, ["vec_id", "x", "y"], "left").fillna({"m": 0.0}), "m", 1, "w").withColumn("w", F.col("w") / 255)
    return df.select("vec_id", "x", "y", P.u8(F.col("r") * (1 - F.col("w")) + F.col("b") * F.col("w")).alias("r"))


@query("agg_bbox", sql("planes", "SELECT vec_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM planes WHERE alpha >= 128 GROUP BY vec_id"))
def _(s, d):
    return planes(s, d).filter(subject()).groupBy("vec_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))


@query("agg_fit_affine", sql("planes", """t AS (SELECT vec_id, depth AS x, g / 255.0::DOUBLE AS y FROM planes WHERE alpha >= 128), f AS (SELECT vec_id, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS shift FROM t GROUP BY vec_id)
SELECT vec_id, n, round(max(slope), 5) AS slope, round(max(shift), 5) AS shift, round(sqrt(avg((slope * x + shift - y) * (slope * x + shift - y))), 5) AS rmse FROM t JOIN f USING (vec_id) GROUP BY vec_id, n"""))
def _(s, d):
    f = stats.fit_line(planes(s, d).filter(subject()), ["vec_id"], F.col("depth"), F.col("g") / 255.0)
    return f.select("vec_id", "n", *(F.round(c, 5).alias(c) for c in ("slope", "shift", "rmse")))


@query("agg_fit_plane", sql("planes", """c AS (SELECT vec_id, sum(alpha) AS w, sum(alpha * x) / sum(alpha)::DOUBLE AS cx, sum(alpha * y) / sum(alpha)::DOUBLE AS cy, sum(alpha * depth) / sum(alpha)::DOUBLE AS cz FROM planes GROUP BY vec_id HAVING sum(alpha) >= 64),
m AS (SELECT vec_id, sum(alpha * (x - cx) * (x - cx)) AS xx, sum(alpha * (x - cx) * (y - cy)) AS xy, sum(alpha * (y - cy) * (y - cy)) AS yy, sum(alpha * (x - cx) * (depth - cz)) AS xz, sum(alpha * (y - cy) * (depth - cz)) AS yz FROM planes JOIN c USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round((xz * yy - yz * xy) / (xx * yy - xy * xy), 6) AS bx, round((yz * xx - xz * xy) / (xx * yy - xy * xy), 6) AS by FROM m WHERE abs(xx * yy - xy * xy) > 1e-12"""))
def _(s, d):
    return fit_plane(planes(s, d), ["vec_id"], F.col("alpha").cast("double")).select("vec_id", r6(F.col("bx"), "bx"), r6(F.col("by"), "by"))


def fit_plane(df, keys, w, z="depth"):
    """Weighted slopes bx, by of z over x and y, from moments about the origin; groups of less weight than 64 or no extent give none."""
    x, y, z = F.col("x").cast("double"), F.col("y").cast("double"), F.col(z)
    m = df.groupBy(*keys).agg(*(F.sum(e).alias(n) for n, e in {"w": w, "wx": w * x, "wy": w * y, "wz": w * z, "wxx": w * x * x, "wxy": w * x * y, "wyy": w * y * y, "wxz": w * x * z, "wyz": w * y * z}.items()))
    c = lambda ab, a, b: F.col(ab) - F.col(a) * F.col(b) / F.col("w")
    m = m.filter("w >= 64").select(*keys, c("wxx", "wx", "wx").alias("xx"), c("wxy", "wx", "wy").alias("xy"), c("wyy", "wy", "wy").alias("yy"), c("wxz", "wx", "wz").alias("xz"), c("wyz", "wy", "wz").alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    return m.filter(F.abs(det) > 1e-12).select(*keys, ((F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det).alias("bx"), ((F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det).alias("by"))


@query("normals_5x5", sql("planes", f"""m AS (SELECT a.vec_id, a.x, a.y, count(*) AS n, regr_count(b.depth, b.x) AS k, sum(b.x) AS sx, sum(b.y) AS sy, sum(b.depth) AS sz, sum(b.x * b.x) AS sxx, sum(b.x * b.y) AS sxy, sum(b.y * b.y) AS syy, sum(b.x * b.depth) AS sxz, sum(b.y * b.depth) AS syz {_box('', 2, 'planes')} WHERE a.alpha >= 128 AND b.alpha >= 128 AND abs(b.depth - a.depth) <= 0.2 GROUP BY ALL),
c AS (SELECT vec_id, x, y, n, sxx - sx * sx / n::DOUBLE AS xx, sxy - sx * sy / n::DOUBLE AS xy, syy - sy * sy / n::DOUBLE AS yy, sxz - sx * sz / n AS xz, syz - sy * sz / n AS yz FROM m),
g AS (SELECT vec_id, x, y, CASE WHEN n >= 4 AND abs(xx * yy - xy * xy) > 1e-12 THEN (xz * yy - yz * xy) / (xx * yy - xy * xy) ELSE 0 END AS gx, CASE WHEN n >= 4 AND abs(xx * yy - xy * xy) > 1e-12 THEN (yz * xx - xz * xy) / (xx * yy - xy * xy) ELSE 0 END AS gy FROM c)
SELECT vec_id, x, y, round(gx * 9 / sqrt(gx * gx * 81 + gy * gy * 81 + 1), 5) AS nx, round(gy * 9 / sqrt(gx * gx * 81 + gy * gy * 81 + 1), 5) AS ny, round(-1 / sqrt(gx * gx * 81 + gy * gy * 81 + 1), 5) AS nz FROM g"""))
def _(s, d):
    return normals(planes(s, d)).select("vec_id", "x", "y", *(F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")))


def normals(df, reach: float = 0.2, focal: float = 9.0):
    """Normals of subject pixels by plane fits over the 5 x 5 neighbours of about their depth.

    The square is gathered by two windows, columns of five and rows of those, under one deal by plane; no neighbour is shuffled.
    """
    put = F.when(subject(), F.struct("x", "y", F.col("depth").alias("z")))
    near = N.by_plane(df).select("vec_id", "x", "y", "alpha", "depth", F.collect_list(put).over(N.along_y(2)).alias("_c"))
    near = near.select("vec_id", "x", "y", "alpha", "depth", F.collect_list("_c").over(N.along_x(2)).alias("_s")).filter(subject())
    own = F.filter(F.flatten("_s"), lambda e: F.abs(e["z"] - F.col("depth")) <= reach)
    names = ("n", "sx", "sy", "sz", "sxx", "sxy", "syy", "sxz", "syz")
    zero = F.struct(*(F.lit(0.0).alias(k) for k in names))

    def add(a, e):
        ox, oy, z = (e["x"] - F.col("x")).cast("double"), (e["y"] - F.col("y")).cast("double"), e["z"]
        terms = (F.lit(1.0), ox, oy, z, ox * ox, ox * oy, oy * oy, ox * z, oy * z)
        return F.struct(*((a[k] + t).alias(k) for k, t in zip(names, terms, strict=True)))

    m = near.select("vec_id", "x", "y", F.aggregate(own, zero, add).alias("t")).select("vec_id", "x", "y", "t.*")
    c = lambda ab, a, b: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    xx, xy, yy, xz, yz = c("sxx", "sx", "sx"), c("sxy", "sx", "sy"), c("syy", "sy", "sy"), c("sxz", "sx", "sz"), c("syz", "sy", "sz")
    det = xx * yy - xy * xy
    ok = (F.col("n") >= 4) & (F.abs(det) > 1e-12)
    m = m.select("vec_id", "x", "y", (F.when(ok, (xz * yy - yz * xy) / det).otherwise(0.0) * focal).alias("gx"), (F.when(ok, (yz * xx - xz * xy) / det).otherwise(0.0) * focal).alias("gy"))
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1)
    return m.select("vec_id", "x", "y", (F.col("gx") / size).alias("nx"), (F.col("gy") / size).alias("ny"), (-1 / size).alias("nz"))


@query("agg_nearest_rank", sql("planes", "q AS (SELECT vec_id, list_sort(list(depth)) AS v FROM planes WHERE alpha >= 128 GROUP BY vec_id) SELECT vec_id, " + ", ".join(f"round(v[CAST(floor({q}::DOUBLE * (len(v) - 1) + 0.5) AS INT) + 1], 6) AS {n}" for n, q in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99))) + " FROM q"))
def _(s, d):
    q = stats.quantiles(planes(s, d).filter(subject()), ["vec_id"], F.col("depth"), {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    return q.select("vec_id", *(r6(F.col(c), c) for c in ("p01", "p50", "p99")))


@query("agg_mad_range", sql("planes", """q AS (SELECT vec_id, list_sort(list(depth)) AS v FROM planes WHERE alpha >= 128 GROUP BY vec_id), m AS (SELECT vec_id, v, v[len(v) // 2 + 1] AS med FROM q), k AS (SELECT vec_id, v, med, 1.4826::DOUBLE * list_sort(list_transform(v, lambda z: abs(z - med)))[len(v) // 2 + 1] AS sg FROM m)
SELECT vec_id, round(greatest(v[1], med - 3 * sg), 6) AS lo, round(least(v[len(v)], med + 3 * sg), 6) AS hi FROM k"""))
def _(s, d):
    e = planes(s, d).filter(subject()).groupBy("vec_id").agg(F.array_sort(F.collect_list("depth")).alias("v"))
    mid = (F.floor(F.size("v") / 2) + 1).cast("int")
    e = e.withColumn("med", F.element_at("v", mid)).withColumn("sg", 1.4826 * F.element_at(F.array_sort(F.transform("v", lambda z: F.abs(z - F.col("med")))), mid))
    return e.select("vec_id", r6(F.greatest(F.element_at("v", 1), F.col("med") - 3 * F.col("sg")), "lo"), r6(F.least(F.element_at("v", -1), F.col("med") + 3 * F.col("sg")), "hi"))


@query("agg_scale_range", sql("planes", "q AS (SELECT vec_id, list_sort(list(depth) FILTER (depth > 0)) AS v FROM planes GROUP BY vec_id), k AS (SELECT vec_id, v[CAST(floor(0.001::DOUBLE * (len(v) - 1)) AS INT) + 1] / 1.15::DOUBLE AS lo, v[CAST(floor(0.999::DOUBLE * (len(v) - 1)) AS INT) + 1] * 1.15::DOUBLE AS hi FROM q) SELECT vec_id, round(CASE WHEN hi / lo < 1.01 THEN lo / 1.05 ELSE lo END, 6) AS lo, round(CASE WHEN hi / lo < 1.01 THEN hi * 1.05 ELSE hi END, 6) AS hi FROM k"))
def _(s, d):
    q = stats.quantiles(planes(s, d).filter("depth > 0"), ["vec_id"], F.col("depth"), {"a": 0.001, "b": 0.999}, "floor")
    lo, hi = F.col("a") / 1.15, F.col("b") * 1.15
    thin = hi / lo < 1.01
    return q.select("vec_id", r6(F.when(thin, lo / 1.05).otherwise(lo), "lo"), r6(F.when(thin, hi * 1.05).otherwise(hi), "hi"))


@query("agg_iou", sql("planes disc", "SELECT vec_id, round(CASE WHEN sum(CASE WHEN p.alpha >= 128 OR q.alpha >= 128 THEN 1 ELSE 0 END) = 0 THEN 1 ELSE sum(CASE WHEN p.alpha >= 128 AND q.alpha >= 128 THEN 1 ELSE 0 END) / sum(CASE WHEN p.alpha >= 128 OR q.alpha >= 128 THEN 1 ELSE 0 END)::DOUBLE END, 6) AS iou FROM planes p JOIN disc q USING (vec_id, x, y) GROUP BY vec_id"))
def _(s, d):
    a, b = subject(), F.col("other") >= 128
    df = planes(s, d).join(disc(s, d).withColumnRenamed("alpha", "other"), ["vec_id", "x", "y"])
    both, any_ = F.count_if(a & b), F.count_if(a | b)
    return df.groupBy("vec_id").agg(r6(F.when(any_ == 0, 1.0).otherwise(both / any_), "iou"))


@query("agg_zbuffer_min", sql("pts", "SELECT CAST(floor(x * 32) AS INT) AS ix, CAST(floor(y * 32) AS INT) AS iy, round(min(z), 6) AS z, count(*) AS n FROM pts GROUP BY ALL"))
def _(s, d):
    return points(s, d).groupBy(F.floor(F.col("x") * 32).cast("int").alias("ix"), F.floor(F.col("y") * 32).cast("int").alias("iy")).agg(r6(F.min("z"), "z"), F.count("*").alias("n"))


@query("agg_silhouette_grid", sql("planes", "SELECT vec_id, CAST(x // 2 AS INT) AS cx, CAST(y // 2 AS INT) AS cy, sum(CASE WHEN alpha >= 128 THEN 1 ELSE 0 END) * 2 >= count(*) AS on_, round(min(CASE WHEN alpha >= 128 AND depth > 0 THEN depth END), 6) AS z FROM planes GROUP BY ALL"))
def _(s, d):
    cell = lambda c: F.floor(F.col(c) / 2).cast("int")
    return planes(s, d).groupBy("vec_id", cell("x").alias("cx"), cell("y").alias("cy")).agg((F.count_if(subject()) * 2 >= F.count("*")).alias("on_"), r6(F.min(F.when(subject() & (F.col("depth") > 0), F.col("depth"))), "z"))


@query("agg_normalize_frame", sql("pts", "SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (source = 0) AS front, count(*) FILTER (source = 1) AS back, round((min(x) + max(x)) / 2, 6) AS cx, round((min(y) + max(y)) / 2, 6) AS cy, round((min(z) + max(z)) / 2, 6) AS cz, round(1 / greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 6) AS scale FROM pts"))
def _(s, d):
    ext = F.greatest(*(F.max(c) - F.min(c) for c in "xyz"))
    return points(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("source") == 0).alias("front"), F.count_if(F.col("source") == 1).alias("back"), *(r6((F.min(c) + F.max(c)) / 2, f"c{c}") for c in "xyz"), r6(1 / ext, "scale"))


@query("metric_normalize01", sql("planes", "q AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM planes GROUP BY vec_id) SELECT vec_id, x, y, round(least(1, greatest(0, (v - lo) / greatest(hi - lo, 1e-8::DOUBLE))), 6) AS v FROM planes JOIN q USING (vec_id)"))
def _(s, d):
    df = N.by_plane(planes(s, d))
    w = Window.partitionBy("vec_id")
    df = df.select("vec_id", "x", "y", "v", F.percentile("v", F.lit(0.01)).over(w).alias("lo"), F.percentile("v", F.lit(0.99)).over(w).alias("hi"))
    return df.select("vec_id", "x", "y", r6(P.clamp((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8)), 0.0, 1.0), "v"))


@query("metric_depth", sql("planes", "SELECT vec_id, round(avg(abs(depth - g / 255.0::DOUBLE) / greatest(depth, 1e-3::DOUBLE)), 6) AS absrel, round(avg(CASE WHEN greatest(depth, 1e-3::DOUBLE) / greatest(g / 255.0::DOUBLE, 1e-3::DOUBLE) < 1.05 AND greatest(g / 255.0::DOUBLE, 1e-3::DOUBLE) / greatest(depth, 1e-3::DOUBLE) < 1.05 THEN 1.0 ELSE 0.0 END), 6) AS delta FROM planes GROUP BY vec_id"))
def _(s, d):
    a, b = F.greatest(F.col("depth"), F.lit(1e-3)), F.greatest(F.col("g") / 255.0, F.lit(1e-3))
    return planes(s, d).groupBy("vec_id").agg(r6(F.avg(F.abs(F.col("depth") - F.col("g") / 255.0) / a), "absrel"), r6(F.avg(F.when(F.greatest(a / b, b / a) < 1.05, 1.0).otherwise(0.0)), "delta"))


@query("metric_psnr", sql("planes", "SELECT vec_id, round(10 * log10(255.0::DOUBLE * 255 / greatest(avg(CAST((r - g) * (r - g) AS DOUBLE)), 1e-12::DOUBLE)), 6) AS psnr FROM planes GROUP BY vec_id"))
def _(s, d):
    e = F.avg(((F.col("r") - F.col("g")) * (F.col("r") - F.col("g"))).cast("double"))
    return planes(s, d).groupBy("vec_id").agg(r6(10 * F.log10(255.0 * 255 / F.greatest(e, F.lit(1e-12))), "psnr"))


@query("metric_landmark", sql("planes", "SELECT vec_id, round(avg(abs(depth - g / 255.0::DOUBLE)), 6) AS mae, round(max(abs(depth - g / 255.0::DOUBLE)), 6) AS worst FROM planes WHERE (y * 8 + x) % 7 = 0 GROUP BY vec_id"))
def _(s, d):
    e = F.abs(F.col("depth") - F.col("g") / 255.0)
    return planes(s, d).filter("(y * 8 + x) % 7 = 0").groupBy("vec_id").agg(r6(F.avg(e), "mae"), r6(F.max(e), "worst"))


@query("metric_depth_to_width", sql("pts", """q AS (SELECT CAST(floor(y * 8) AS INT) AS band, list_sort(list(x)) AS xs, list_sort(list(z)) AS zs, count(*) AS n FROM pts GROUP BY 1)
SELECT band, n, round(CASE WHEN n >= 64 THEN (zs[CAST(floor(0.99::DOUBLE * (n - 1)) AS INT) + 1] - zs[CAST(floor(0.01::DOUBLE * (n - 1)) AS INT) + 1]) / (xs[CAST(floor(0.99::DOUBLE * (n - 1)) AS INT) + 1] - xs[CAST(floor(0.01::DOUBLE * (n - 1)) AS INT) + 1]) END, 6) AS ratio FROM q"""))
def _(s, d):
    return depth_to_width(points(s, d))


def depth_to_width(df):
    """Extent in depth over that in width, between ranked percentiles, in eight bands of height.

    Ranks come from the counts of distinct values, so no band's points meet in one place.
    """
    out = None
    for c in "xz":
        v = df.groupBy(F.floor(F.col("y") * 8).cast("int").alias("band"), F.col(c).alias("v")).agg(F.count("*").alias("k"))
        w = Window.partitionBy("band").orderBy("v")
        v = v.select("band", "v", "k", F.sum("k").over(w).alias("upto"), F.sum("k").over(Window.partitionBy("band")).alias("n"))
        at = lambda q: F.min(F.when(F.col("upto") > F.floor(q * (F.col("n") - 1)), F.col("v")))
        e = v.groupBy("band", "n").agg((at(0.99) - at(0.01)).alias(f"e{c}"))
        out = e if out is None else out.join(e.drop("n"), "band")
    return out.select("band", "n", r6(F.when(F.col("n") >= 64, F.col("ez") / F.col("ex")), "ratio"))


RULES = [("absrel", "max", 0.02, 0.4), ("delta", "min", 0.97, 0.05), ("missing", "max", 1.0, 2.0)]


@query("metric_threshold_rules", sql("planes", """m AS (SELECT vec_id, avg(abs(depth - g / 255.0::DOUBLE)) AS absrel, avg(CASE WHEN abs(depth - g / 255.0::DOUBLE) < 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS delta FROM planes GROUP BY vec_id)
SELECT vec_id, 'absrel' AS metric, CASE WHEN absrel <= 0.02 THEN 'ok' WHEN absrel <= 0.4 THEN 'warn' ELSE 'fail' END AS verdict FROM m UNION ALL SELECT vec_id, 'delta', CASE WHEN delta >= 0.97 THEN 'ok' WHEN delta >= 0.05 THEN 'warn' ELSE 'fail' END FROM m"""))
def _(s, d):
    e = F.abs(F.col("depth") - F.col("g") / 255.0)
    m = planes(s, d).groupBy("vec_id").agg(F.avg(e).alias("absrel"), F.avg(F.when(e < 0.05, 1.0).otherwise(0.0)).alias("delta"))
    rows = m.select("vec_id", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("absrel", "delta")])).alias("t")).select("vec_id", "t.*")
    rules = s.createDataFrame(RULES, "metric string, kind string, good double, poor double")
    j = rows.join(F.broadcast(rules), "metric", "left").filter("v IS NOT NULL")  # three rules; measures that are missing are passed over
    within = lambda lim: F.when(F.col("kind") == "max", F.col("v") <= F.col(lim)).otherwise(F.col("v") >= F.col(lim))
    return j.select("vec_id", "metric", F.when(within("good"), "ok").when(within("poor"), "warn").otherwise("fail").alias("verdict"))


@query("topk_min_by", sql("planes", "SELECT label, arg_min(vec_id, (m, vec_id)) AS worst, round(min(m), 6) AS value FROM (SELECT label, vec_id, avg(depth) AS m FROM planes GROUP BY ALL) GROUP BY label"))
def _(s, d):
    m = planes(s, d).groupBy("label", "vec_id").agg(F.round(F.avg("depth"), 12).alias("m"))
    return m.groupBy("label").agg(F.min(F.struct("m", "vec_id")).alias("t")).select("label", F.col("t.vec_id").alias("worst"), r6(F.col("t.m"), "value"))


@query("sample_stride", sql("planes", "SELECT vec_id, x, y FROM (SELECT vec_id, x, y, row_number() OVER (PARTITION BY vec_id ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY vec_id) AS n FROM planes WHERE alpha >= 128) WHERE i % greatest(1, n // 10) = 0"))
def _(s, d):
    w = Window.partitionBy("vec_id")
    df = N.by_plane(planes(s, d)).filter(subject()).select("vec_id", "x", "y", (F.row_number().over(w.orderBy("y", "x")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return df.filter(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / 10)) == 0).select("vec_id", "x", "y")


@query("join_planes", sql("planes disc", "SELECT vec_id, x, y, round(p.depth * q.alpha / 255, 6) AS v FROM planes p JOIN disc q USING (vec_id, x, y)"))
def _(s, d):
    j = planes(s, d).select("vec_id", "x", "y", "depth").join(disc(s, d), ["vec_id", "x", "y"])
    return j.select("vec_id", "x", "y", r6(F.col("depth") * F.col("alpha") / 255, "v"))


@query("resize_bilinear", sql("px", """t AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, greatest(0, least(7, (x + 0.5::DOUBLE) * 8 / 12 - 0.5)) AS sx, greatest(0, least(7, (y + 0.5::DOUBLE) * 8 / 12 - 0.5)) AS sy FROM range(12) a(x), range(12) b(y))
SELECT vec_id, t.x, t.y, round(sum(p.v * greatest(0, 1 - abs(p.x - sx)) * greatest(0, 1 - abs(p.y - sy))), 6) AS v FROM t JOIN px p ON abs(p.x - sx) < 1 AND abs(p.y - sy) < 1 GROUP BY vec_id, t.x, t.y"""))
def _(s, d):
    return resize(pixels(s, d), "v", 8, 12).select("vec_id", "x", "y", r6(F.col("v"), "v"))


def resize(df, value: str, old: int, new: int):
    """Bilinear, pixel centres aligned, edges clamped: each source pixel adds its share to the targets that it touches."""
    reach = -(-new // old) + 1

    def targets(c):
        at = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(float(old - 1)), (t + 0.5) * old / new - 0.5))
        mid = F.floor((F.col(c) + 0.5) * new / old)
        near = F.filter(F.transform(F.sequence(mid - 2 * reach, mid + 2 * reach), lambda t: F.struct(t.cast("int").alias("t"), F.greatest(F.lit(0.0), 1 - F.abs(at(t) - F.col(c))).alias("w"))), lambda e: (e["t"] >= 0) & (e["t"] < new) & (e["w"] > 0))
        return F.explode(near)

    df = df.select("vec_id", "y", F.col(value).alias("_v"), targets("x").alias("tx")).select("vec_id", "_v", "tx", targets("y").alias("ty"))
    return df.groupBy("vec_id", F.col("tx.t").alias("x"), F.col("ty.t").alias("y")).agg(F.sum(F.col("_v") * F.col("tx.w") * F.col("ty.w")).alias(value))


@query("grid_crop", sql("px", "SELECT vec_id, x - 2 AS x, y - 3 AS y, v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 6"))
def _(s, d):
    return pixels(s, d).filter("x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 6").select("vec_id", (F.col("x") - 2).alias("x"), (F.col("y") - 3).alias("y"), "v")


@query("shell_back_color", sql("planes", """r AS (SELECT vec_id, y, min(x) AS x0, max(x) AS x1, arg_min(r, x) AS c0, arg_max(r, x) AS c1 FROM planes WHERE alpha >= 128 GROUP BY vec_id, y)
SELECT p.vec_id, p.x, p.y, CAST(round_even((c0 + (c1 - c0) * CASE WHEN x1 > x0 THEN (p.x - x0) / (x1 - x0)::DOUBLE ELSE 0 END) * 0.55::DOUBLE, 0) AS INT) AS c FROM planes p JOIN r USING (vec_id, y) WHERE p.alpha >= 128"""))
def _(s, d):
    w = Window.partitionBy("vec_id", "y")
    df = N.by_plane(planes(s, d)).filter(subject()).select("vec_id", "x", "y", F.min("x").over(w).alias("x0"), F.max("x").over(w).alias("x1"), F.min_by("r", "x").over(w).alias("c0"), F.max_by("r", "x").over(w).alias("c1"))
    t = F.when(F.col("x1") > F.col("x0"), (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(0.0)
    return df.select("vec_id", "x", "y", P.u8((F.col("c0") + (F.col("c1") - F.col("c0")) * t) * 0.55).alias("c"))


@query("geom_head_box", sql("planes", """w AS (SELECT v.vec_id, CAST(y.y AS INT) AS y, count(p.x) AS n FROM (SELECT DISTINCT vec_id FROM planes) v CROSS JOIN range(8) y(y) LEFT JOIN planes p ON p.vec_id = v.vec_id AND p.y = y.y AND p.alpha >= 128 GROUP BY ALL),
m AS (SELECT a.vec_id, a.y, avg(b.n) AS n FROM w a JOIN w b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 GROUP BY ALL), k AS (SELECT *, lag(n) OVER o AS before, lead(n) OVER o AS after, max(n) OVER (PARTITION BY vec_id ORDER BY y ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS wider FROM m WINDOW o AS (PARTITION BY vec_id ORDER BY y))
SELECT vec_id, CAST(coalesce(min(y) FILTER (n <= before AND n < after AND wider >= 1.25 * n AND y <= 3), 1) AS INT) AS neck FROM k GROUP BY vec_id"""))
def _(s, d):
    rows = planes(s, d).groupBy("vec_id", "y").agg(F.count_if(subject()).alias("n"))
    o = Window.partitionBy("vec_id").orderBy("y")
    m = rows.select("vec_id", "y", F.avg("n").over(o.rangeBetween(-1, 1)).alias("n"))
    k = m.select("*", F.lag("n").over(o).alias("before"), F.lead("n").over(o).alias("after"), F.max("n").over(o.rowsBetween(1, Window.unboundedFollowing)).alias("wider"))
    neck = F.min(F.when((F.col("n") <= F.col("before")) & (F.col("n") < F.col("after")) & (F.col("wider") >= 1.25 * F.col("n")) & (F.col("y") <= 3), F.col("y")))
    return k.groupBy("vec_id").agg(F.coalesce(neck, F.lit(1)).alias("neck"))


@query("metric_pixel_probe", sql("planes", "SELECT vec_id, count(*) FILTER (r >= 128) AS lit, round(avg(CASE WHEN r >= 128 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(x) FILTER (r >= 128), 6) AS cx, round(avg(y) FILTER (r >= 128), 6) AS cy, min(x) FILTER (r >= 128) AS x0, max(x) FILTER (r >= 128) AS x1, round(avg(g) FILTER (r >= 128), 6) AS mean_g FROM planes GROUP BY vec_id"))
def _(s, d):
    on = F.col("r") >= 128
    lit = lambda c: F.when(on, F.col(c))
    return planes(s, d).groupBy("vec_id").agg(F.count_if(on).alias("lit"), r6(F.avg(F.when(on, 1.0).otherwise(0.0)), "coverage"), r6(F.avg(lit("x")), "cx"), r6(F.avg(lit("y")), "cy"), F.min(lit("x")).alias("x0"), F.max(lit("x")).alias("x1"), r6(F.avg(lit("g")), "mean_g"))


_RUNS = "on_ AS (SELECT vec_id, y, x, depth, x - row_number() OVER (PARTITION BY vec_id, y ORDER BY x) AS g FROM planes WHERE alpha >= 128), ru AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, count(*) OVER w AS n FROM on_ WINDOW w AS (PARTITION BY vec_id, y, g))"


def in_runs(df, least: int):
    """Subject pixels with their run: x0, x1, n; runs shorter than `least` are dropped."""
    on = N.by_plane(df).filter(subject()).withColumn("g_", F.col("x") - F.row_number().over(N.along_x()))
    w = Window.partitionBy("vec_id", "y", "g_")
    return on.select("*", F.min("x").over(w).alias("x0"), F.max("x").over(w).alias("x1"), F.count("*").over(w).alias("n")).filter(F.col("n") >= least)


@query("geom_limb_cylinder", sql("planes", _RUNS + """, t AS (SELECT vec_id, y, x, g, depth, -0.32::DOUBLE * n / 8 * sqrt(greatest(0, 1 - power((x - (x0 + x1) / 2.0::DOUBLE) / (n / 2.0::DOUBLE), 2))) AS goal FROM ru WHERE n >= 3)
SELECT vec_id, x, y, round(goal - avg(goal) OVER w - (depth - avg(depth) OVER w), 6) AS fix FROM t WINDOW w AS (PARTITION BY vec_id, y, g)"""))
def _(s, d):
    df = in_runs(planes(s, d), 3)
    off = (F.col("x") - (F.col("x0") + F.col("x1")) / 2.0) / (F.col("n") / 2.0)
    w = Window.partitionBy("vec_id", "y", "g_")
    df = df.withColumn("goal", -0.32 * F.col("n") / 8 * F.sqrt(F.greatest(F.lit(0.0), 1 - off * off)))
    return df.select("vec_id", "x", "y", r6(F.col("goal") - F.avg("goal").over(w) - (F.col("depth") - F.avg("depth").over(w)), "fix"))


@query("geom_hull_dent", sql("planes", _RUNS + """, r3 AS (SELECT * FROM ru WHERE n >= 3)
SELECT p.vec_id, p.x, p.y, round(max(p.depth) - min(CASE WHEN a.x = b.x THEN a.depth ELSE a.depth + (b.depth - a.depth) * (p.x - a.x) / (b.x - a.x)::DOUBLE END), 6) AS dent FROM r3 p JOIN r3 a ON a.vec_id = p.vec_id AND a.y = p.y AND a.g = p.g AND a.x <= p.x JOIN r3 b ON b.vec_id = p.vec_id AND b.y = p.y AND b.g = p.g AND b.x >= p.x AND (a.x < b.x OR a.x = p.x) GROUP BY p.vec_id, p.x, p.y"""))
def _(s, d):
    return hull_dents(in_runs(planes(s, d), 3)).select("vec_id", "x", "y", r6(F.col("dent"), "dent"))


def hull_dents(df):
    """How far each pixel of a run lies behind the lower hull of the run's depths: one Arrow batch a group of runs, a monotone chain each."""
    import numpy as np
    import pandas as pd

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, run in pdf.sort_values(["y", "g_", "x"]).groupby(["y", "g_"], sort=False):
            x, z = run.x.to_numpy(np.float64), run.depth.to_numpy()
            keep: list[int] = []
            for i in range(len(x)):
                while len(keep) > 1 and (z[keep[-1]] - z[keep[-2]]) * (x[i] - x[keep[-2]]) >= (z[i] - z[keep[-2]]) * (x[keep[-1]] - x[keep[-2]]):
                    keep.pop()
                keep.append(i)
            out.append(pd.DataFrame({"vec_id": run.vec_id, "x": run.x, "y": run.y, "dent": z - np.interp(x, x[keep], z[keep])}))
        return pd.concat(out)

    return df.select("vec_id", "x", "y", "g_", "depth").groupBy("vec_id").applyInPandas(hull, "vec_id long, x int, y int, dent double")


@query("metric_bulge", sql("planes", _RUNS + """, m AS (SELECT a.vec_id, a.y, a.x, max(a.n) AS n, avg(b.depth) - max(a.depth) AS up FROM ru a JOIN ru b ON a.vec_id = b.vec_id AND a.y = b.y AND a.g = b.g AND abs(a.x - b.x) <= 1 WHERE a.n >= 3 GROUP BY ALL)
SELECT vec_id, count(*) FILTER (up > 0) AS n, round(max(up) / 8, 6) AS worst FROM m GROUP BY vec_id"""))
def _(s, d):
    df = in_runs(planes(s, d), 3)
    up = F.avg("depth").over(Window.partitionBy("vec_id", "y", "g_").orderBy("x").rangeBetween(-1, 1)) - F.col("depth")
    return df.select("vec_id", up.alias("up")).groupBy("vec_id").agg(F.count_if(F.col("up") > 0).alias("n"), r6(F.max("up") / 8, "worst"))
