"""Queries of graph, hierarchy, point-cloud, rendering and alignment operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridsurf.functions import packing as P
from gridsurf.operators import cloud, graph, pyramid
from gridsurf.operators import windows as N
from gridsurf.plans.fixtures import disc, pixels, planes, points, r6, sql, table
from gridsurf.plans.grids import gaps, subject
from gridsurf.plans.scalars import _POSES, _ROT, depth_bucket, poses

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return add


def _cc(cond: str, near: str) -> str:
    """Reachability by recursion over the cells of a plane; the smallest y * 8 + x reached names the component."""
    return f"""s AS (SELECT vec_id, x, y, y * 8 + x AS id FROM planes WHERE {cond}), ed AS (SELECT a.vec_id, a.id AS a, b.id AS b FROM s a JOIN s b ON a.vec_id = b.vec_id AND {near}),
re(vec_id, id, root) AS (SELECT vec_id, id, id FROM s UNION SELECT re.vec_id, ed.b, re.root FROM re JOIN ed ON ed.vec_id = re.vec_id AND ed.a = re.id WHERE ed.b > re.root),
lab AS (SELECT vec_id, id, min(root) AS root FROM re GROUP BY vec_id, id)"""


_EIGHT = "greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1"
_FOUR = "abs(a.x - b.x) + abs(a.y - b.y) = 1"


def named(df):
    """Component names as the least y * 8 + x in them."""
    own = df.withColumn("at", F.col("y") * 8 + F.col("x"))
    low = own.groupBy("vec_id", "root").agg(F.min("at").alias("low"), F.count("*").alias("size"))
    return own.join(low, ["vec_id", "root"]).select("vec_id", "x", "y", F.col("low").alias("label"), "size")


@query("cc_8", sql("planes", _cc("alpha >= 160", _EIGHT) + " SELECT vec_id, CAST(id % 8 AS INT) AS x, CAST(id // 8 AS INT) AS y, root AS label, count(*) OVER (PARTITION BY vec_id, root) AS size FROM lab"))
def _(s, d):
    return named(graph.label(planes(s, d), F.col("alpha") >= 160, True))


@query("mask_small_components", sql("planes", _cc("alpha >= 160", _EIGHT) + ", z AS (SELECT *, count(*) OVER (PARTITION BY vec_id, root) AS size FROM lab), k AS (SELECT *, max(size) OVER (PARTITION BY vec_id) AS most FROM z) SELECT vec_id, CAST(id % 8 AS INT) AS x, CAST(id // 8 AS INT) AS y FROM k WHERE size >= 0.25 * most"))
def _(s, d):
    df = named(graph.label(planes(s, d), F.col("alpha") >= 160, True))
    return df.withColumn("most", F.max("size").over(Window.partitionBy("vec_id"))).filter("size >= 0.25 * most").select("vec_id", "x", "y")


@query("cc_hole_fill", sql("planes", _cc("alpha < 128", _FOUR) + """, z AS (SELECT *, count(*) OVER w AS size, max(CASE WHEN id % 8 IN (0, 7) OR id // 8 IN (0, 7) THEN 1 ELSE 0 END) OVER w AS open FROM lab WINDOW w AS (PARTITION BY vec_id, root))
SELECT p.vec_id, p.x, p.y, CAST(CASE WHEN z.open = 0 AND z.size <= 16 THEN 255 ELSE p.alpha END AS INT) AS alpha FROM planes p LEFT JOIN z ON z.vec_id = p.vec_id AND z.id = p.y * 8 + p.x"""))
def _(s, d):
    df = planes(s, d)
    back = graph.label(df, F.col("alpha") < 128, False)
    edge = (F.col("x") % 7 == 0) | (F.col("y") % 7 == 0)
    holes = back.groupBy("vec_id", "root").agg(F.count("*").alias("size"), F.max(edge).alias("open")).filter("NOT open AND size <= 16")
    hit = back.join(holes, ["vec_id", "root"], "left_semi").select("vec_id", "x", "y", F.lit(255).alias("fill"))
    return df.join(hit, ["vec_id", "x", "y"], "left").select("vec_id", "x", "y", F.coalesce("fill", "alpha").alias("alpha"))


@query("metric_view_sanity", sql("planes", _cc("alpha >= 128", _FOUR) + ", z AS (SELECT vec_id, root, count(*) AS n FROM lab GROUP BY ALL) SELECT vec_id, count(*) AS parts, round(max(n) / sum(n)::DOUBLE, 6) AS main FROM z GROUP BY vec_id"))
def _(s, d):
    parts = graph.label(planes(s, d), subject(), False).groupBy("vec_id", "root").agg(F.count("*").alias("n"))
    return parts.groupBy("vec_id").agg(F.count("*").alias("parts"), r6(F.max("n") / F.sum("n"), "main"))


_EDT = "SELECT p.vec_id, p.x, p.y, p.alpha, p.depth, coalesce(sqrt(min((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y))::DOUBLE), 1e10) AS dist FROM planes p LEFT JOIN planes o ON o.vec_id = p.vec_id AND o.alpha < 128 GROUP BY ALL"


@query("edt_exact", sql("planes", f"e AS ({_EDT}) SELECT vec_id, x, y, round(dist, 6) AS dist FROM e"))
def _(s, d):
    return graph.distance(planes(s, d), F.col("alpha") < 128, "dist").select("vec_id", "x", "y", r6(F.col("dist"), "dist"))


@query("mask_silhouette_band", sql("planes", f"e AS ({_EDT}) SELECT vec_id, x, y FROM e WHERE dist BETWEEN 1.4 AND 3"))
def _(s, d):
    return graph.distance(planes(s, d), F.col("alpha") < 128, "dist").filter("dist BETWEEN 1.4 AND 3").select("vec_id", "x", "y")


@query("shell_thickness", sql("planes", f"e AS ({_EDT}), m AS (SELECT *, max(CASE WHEN alpha >= 128 THEN dist END) OVER (PARTITION BY vec_id) AS top FROM e) SELECT vec_id, x, y, round(CASE WHEN alpha >= 128 THEN sqrt(1 - power(1 - least(1, greatest(0, (dist - 0.5) / greatest(top - 0.5, 1e-6::DOUBLE))), 2)) ELSE 0 END, 6) AS t FROM m"))
def _(s, d):
    df = graph.distance(planes(s, d), F.col("alpha") < 128, "dist")
    df = df.withColumn("top", F.max(F.when(subject(), F.col("dist"))).over(Window.partitionBy("vec_id")))
    r = P.clamp((F.col("dist") - 0.5) / F.greatest(F.col("top") - 0.5, F.lit(1e-6)), 0.0, 1.0)
    return df.select("vec_id", "x", "y", r6(F.when(subject(), F.sqrt(1 - (1 - r) * (1 - r))).otherwise(0.0), "t"))


_NEAR = "arg_min(o.{v}, (CAST((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) AS INT), o.y, o.x))"


@query("join_nearest_fg", sql("planes", f"SELECT p.vec_id, p.x, p.y, round({_NEAR.format(v='depth')}, 6) AS v FROM planes p JOIN planes o ON o.vec_id = p.vec_id AND o.alpha >= 128 GROUP BY p.vec_id, p.x, p.y"))
def _(s, d):
    df = graph.nearest(planes(s, d), subject(), F.col("depth"), "v")
    return df.filter("v IS NOT NULL").select("vec_id", "x", "y", r6(F.col("v"), "v"))


@query("calib_boundary_pull", sql("planes", f"""n AS (SELECT p.vec_id, p.x, p.y, {_NEAR.format(v='depth')} AS v FROM planes p JOIN planes o ON o.vec_id = p.vec_id AND o.alpha >= 128 GROUP BY p.vec_id, p.x, p.y)
SELECT p.vec_id, p.x, p.y, round(CASE WHEN p.alpha > 0 AND p.alpha < 128 THEN coalesce(n.v, p.depth) ELSE p.depth END, 6) AS depth FROM planes p LEFT JOIN n USING (vec_id, x, y)"""))
def _(s, d):
    df = graph.nearest(planes(s, d), subject(), F.col("depth"), "v")
    return df.select("vec_id", "x", "y", r6(F.when((F.col("alpha") > 0) & (F.col("alpha") < 128), F.coalesce("v", "depth")).otherwise(F.col("depth")), "depth"))


@query("join_idw", sql("planes", """m AS (SELECT vec_id, x, y, depth FROM planes WHERE (y * 8 + x) % 5 = 0), c AS (SELECT p.vec_id, p.x, p.y, (p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y) AS d2, m.depth FROM planes p JOIN m USING (vec_id)),
k AS (SELECT vec_id, x, y, min(r) AS r FROM (SELECT vec_id, x, y, r, count(*) FILTER (d2 <= r * r) AS n FROM c, (SELECT unnest([2, 4, 8, 16]) AS r) GROUP BY ALL) WHERE n >= 6 GROUP BY ALL)
SELECT c.vec_id, c.x, c.y, k.r, round(sum(depth / (d2 + 0.01::DOUBLE)) / sum(1 / (d2 + 0.01::DOUBLE)), 6) AS v FROM c JOIN k USING (vec_id, x, y) WHERE d2 <= k.r * k.r GROUP BY ALL"""))
def _(s, d):
    df = N.by_plane(planes(s, d)).select("vec_id", "x", "y", "depth")
    marks = df.filter("(y * 8 + x) % 5 = 0")
    out = None
    left = df.select("vec_id", "x", "y")
    for r in (2, 4, 8, 16):
        # marks are dealt to the cells of side r that they touch, pixels look into their own
        cell = lambda c: F.floor(F.col(c) / r)  # noqa: B023, E731
        near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        m = marks.select("vec_id", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("depth").alias("z"), cell("x").alias("gx"), cell("y").alias("gy"))
        m = m.select("vec_id", "mx", "my", "z", F.explode(F.transform(near, lambda k: F.col("gx") + k)).alias("cx"), "gy").select("vec_id", "mx", "my", "z", "cx", F.explode(F.transform(near, lambda k: F.col("gy") + k)).alias("cy"))
        d2 = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
        met = left.withColumn("cx", cell("x")).withColumn("cy", cell("y")).join(m, ["vec_id", "cx", "cy"]).withColumn("d2", d2).filter(F.col("d2") <= r * r)
        got = met.groupBy("vec_id", "x", "y").agg(F.count("*").alias("n"), (F.sum(F.col("z") / (F.col("d2") + 0.01)) / F.sum(1 / (F.col("d2") + 0.01))).alias("v")).filter("n >= 6")
        got = graph.saved(got.select("vec_id", "x", "y", F.lit(r).alias("r"), r6(F.col("v"), "v")))
        out = got if out is None else out.unionByName(got)
        left = left.join(got, ["vec_id", "x", "y"], "left_anti")
    return out


# --- hierarchy ---------------------------------------------------------------

_TAPS = "(VALUES (-2, 1.0), (-1, 4.0), (0, 6.0), (1, 4.0), (2, 1.0))"


def _refl(c: str, n: int) -> str:
    return f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= {n} THEN {2 * n - 1} - ({c}) ELSE {c} END"


def _smooth(rel: str, n: int, scale: int = 1) -> str:
    """2-D form of the separable kernel."""
    return f"""SELECT t.vec_id, t.x, t.y, sum(s.v * kx.w * ky.w / 256.0::DOUBLE * {scale}) AS v FROM {rel} t, {_TAPS} kx(k, w), {_TAPS} ky(k, w), {rel} s
    WHERE s.vec_id = t.vec_id AND s.x = {_refl('t.x + kx.k', n)} AND s.y = {_refl('t.y + ky.k', n)} GROUP BY ALL"""


_DOWN = f"g0 AS ({_smooth('px', 8)}), d1 AS (SELECT vec_id, x // 2 AS x, y // 2 AS y, v FROM g0 WHERE x % 2 = 0 AND y % 2 = 0)"
_UP = f"{_DOWN}, z1 AS (SELECT p.vec_id, p.x, p.y, coalesce(d1.v, 0) AS v FROM px p LEFT JOIN d1 ON d1.vec_id = p.vec_id AND d1.x * 2 = p.x AND d1.y * 2 = p.y), u1 AS ({_smooth('z1', 8, 4)})"


@query("pyr_smooth", sql("px", f"g0 AS ({_smooth('px', 8)}) SELECT vec_id, x, y, round(v, 6) AS v FROM g0"))
def _(s, d):
    return pyramid.smooth(pixels(s, d), 8).select("vec_id", "x", "y", r6(F.col("v"), "v"))


@query("pyr_down", sql("px", _DOWN + " SELECT vec_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(v, 6) AS v FROM d1"))
def _(s, d):
    return pyramid.down(pixels(s, d), 8).select("vec_id", "x", "y", r6(F.col("v"), "v"))


@query("pyr_up", sql("px", _UP + " SELECT vec_id, x, y, round(v, 6) AS v FROM u1"))
def _(s, d):
    return pyramid.up(pyramid.down(pixels(s, d), 8), 8).select("vec_id", "x", "y", r6(F.col("v"), "v"))


@query("pyr_laplacian_roundtrip", sql("px", "SELECT vec_id, x, y, round(v, 6) AS v FROM px"))
def _(s, d):
    return pyramid.collapse(pyramid.laplacian(pixels(s, d), 8)).select("vec_id", "x", "y", r6(F.col("v"), "v"))


_BLEND = f"""src AS (SELECT vec_id, x, y, depth AS v FROM planes), tile AS (SELECT vec_id, x, y, g / 255.0::DOUBLE AS v FROM planes), wt AS (SELECT vec_id, x, y, alpha / 255.0::DOUBLE AS v FROM planes),
dif AS (SELECT src.vec_id, src.x, src.y, tile.v - src.v AS v FROM src JOIN tile USING (vec_id, x, y)), dg AS ({_smooth('dif', 8)}), dd AS (SELECT vec_id, x // 2 AS x, y // 2 AS y, v FROM dg WHERE x % 2 = 0 AND y % 2 = 0),
dz AS (SELECT p.vec_id, p.x, p.y, coalesce(dd.v, 0) AS v FROM dif p LEFT JOIN dd ON dd.vec_id = p.vec_id AND dd.x * 2 = p.x AND dd.y * 2 = p.y), du AS ({_smooth('dz', 8, 4)})
SELECT src.vec_id, src.x, src.y, round(src.v + wt.v * (dif.v - du.v), 6) AS v FROM src JOIN wt USING (vec_id, x, y) JOIN dif USING (vec_id, x, y) JOIN du USING (vec_id, x, y)"""


def blend_detail(base, tile, weight, n: int):
    """base with the finest band of tile mixed in by weight; coarser bands stay those of base. Each: vec_id, x, y, v."""
    dif = tile.withColumnRenamed("v", "t").join(base, ["vec_id", "x", "y"]).select("vec_id", "x", "y", (F.col("t") - F.col("v")).alias("v"))
    fine = pyramid.up(pyramid.down(dif, n), n).withColumnRenamed("v", "u")
    out = base.join(dif.withColumnRenamed("v", "d"), ["vec_id", "x", "y"]).join(fine, ["vec_id", "x", "y"], "left").join(weight.withColumnRenamed("v", "w"), ["vec_id", "x", "y"])
    return out.select("vec_id", "x", "y", (F.col("v") + F.greatest(F.col("w"), F.lit(0.0)) * (F.col("d") - F.coalesce("u", F.lit(0.0)))).alias("v"))


@query("pyr_blend", sql("planes", _BLEND))
def _(s, d):
    df = planes(s, d)
    plane = lambda c: df.select("vec_id", "x", "y", c.alias("v"))
    return blend_detail(plane(F.col("depth")), plane(F.col("g") / 255.0), plane(F.col("alpha") / 255.0), 8).select("vec_id", "x", "y", r6(F.col("v"), "v"))


@query("depth_fuse", sql("planes", """f AS (SELECT vec_id, regr_slope(depth, g / 255.0::DOUBLE) AS fa, regr_intercept(depth, g / 255.0::DOUBLE) AS fb, count(*) AS n FROM planes WHERE alpha >= 128 GROUP BY vec_id),
k AS (SELECT p.*, coalesce(n, 0) >= 16 AS ok, fa * (g / 255.0::DOUBLE) + fb AS t, least(1.0, (least(x, y, 7 - x, 7 - y) + 0.5) / 3.0)::DOUBLE AS e FROM planes p LEFT JOIN f USING (vec_id))
SELECT vec_id, x, y, round(CASE WHEN ok THEN (0.15::DOUBLE * depth + e * e * (3 - 2 * e) * t) / (0.15::DOUBLE + e * e * (3 - 2 * e)) ELSE depth END, 5) AS v FROM k"""))
def _(s, d):
    from gridsurf.operators.stats import fit_line

    df = planes(s, d).withColumn("tile", F.col("g") / 255.0)
    fit = fit_line(df.filter(subject()), ["vec_id"], F.col("tile"), F.col("depth")).filter("n >= 16")
    e = F.least(F.lit(1.0), (F.least("x", "y", 7 - F.col("x"), 7 - F.col("y")) + 0.5) / 3.0)
    w = e * e * (3 - 2 * e)
    fused = (0.15 * F.col("depth") + w * (F.col("slope") * F.col("tile") + F.col("shift"))) / (0.15 + w)
    return df.join(fit, "vec_id", "left").select("vec_id", "x", "y", F.round(F.when(F.col("slope").isNotNull(), fused).otherwise(F.col("depth")), 5).alias("v"))


_QT = """lv AS (SELECT unnest([0, 1, 2, 3]) AS level), nd AS (SELECT vec_id, level, x // CAST(pow(2, level) AS INT) AS cx, y // CAST(pow(2, level) AS INT) AS cy, count(*) AS n, sum(CASE WHEN alpha >= 128 THEN 1 ELSE 0 END) AS inside,
coalesce(avg(depth) FILTER (alpha >= 128), 0) AS m, coalesce(var_pop(depth) FILTER (alpha >= 128), 0) AS s FROM planes, lv GROUP BY ALL),
own AS (SELECT *, level > 0 AND ((inside > 0 AND inside < n) OR s > 0.01) AS own FROM nd),
sp AS (SELECT a.*, EXISTS (SELECT 1 FROM own b WHERE b.vec_id = a.vec_id AND b.level <= a.level AND b.cx // CAST(pow(2, a.level - b.level) AS INT) = a.cx AND b.cy // CAST(pow(2, a.level - b.level) AS INT) = a.cy AND b.own) AS parts FROM own a),
ce AS (SELECT c.vec_id, c.level, c.cx, c.cy, c.inside, c.m FROM sp c LEFT JOIN sp p ON p.vec_id = c.vec_id AND p.level = c.level + 1 AND p.cx = c.cx // 2 AND p.cy = c.cy // 2 WHERE NOT c.parts AND c.inside > 0 AND (c.level = 3 OR p.parts))"""


def quad(df):
    tree = pyramid.nodes(df.withColumn("inside", subject()), 3, ["depth"])
    return pyramid.cells(tree, 3, ((F.col("inside") > 0) & (F.col("inside") < F.col("n"))) | (F.col("s_depth") > 0.01))


@query("quadtree_leaf_stats", sql("planes", "SELECT vec_id, CAST(x // 2 AS INT) AS cx, CAST(y // 2 AS INT) AS cy, count(*) AS n, count(*) FILTER (alpha < 128) AS outside, round(avg(depth) FILTER (alpha >= 128), 6) AS depth, round(avg(r) FILTER (alpha >= 128), 6) AS r, round(avg(alpha) FILTER (alpha >= 128), 6) AS alpha FROM planes GROUP BY ALL"))
def _(s, d):
    cell = lambda c: F.floor(F.col(c) / 2).cast("int").alias(f"c{c}")
    mean = lambda c: r6(F.avg(F.when(subject(), F.col(c))), c)
    return planes(s, d).groupBy("vec_id", cell("x"), cell("y")).agg(F.count("*").alias("n"), F.count_if(~subject()).alias("outside"), mean("depth"), mean("r"), mean("alpha"))


@query("quadtree_cells", sql("planes", _QT + " SELECT vec_id, level, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, inside AS n, round(m, 6) AS depth FROM ce"))
def _(s, d):
    return quad(planes(s, d)).select("vec_id", "level", "cx", "cy", F.col("inside").alias("n"), r6(F.col("m_depth"), "depth"))


_MOSAIC = "vec_id // 64 AS mosaic, CAST(vec_id % 8 AS INT) AS tx, CAST(vec_id // 8 % 8 AS INT) AS ty"


@query("quadtree_estimate", sql("planes", _QT + f""", sub AS (SELECT vec_id, count(*) AS px FROM planes WHERE alpha >= 128 GROUP BY vec_id), c AS (SELECT vec_id, count(*) AS cells FROM ce GROUP BY vec_id), m AS (SELECT DISTINCT vec_id, {_MOSAIC} FROM planes)
SELECT mosaic, coalesce(sum(cells), 0) AS cells, coalesce(sum(px), 0) AS pixels, round(CASE WHEN coalesce(sum(px), 0) = 0 THEN 0 ELSE 1 - sum(cells) / sum(px)::DOUBLE END, 6) AS reduction FROM m LEFT JOIN sub USING (vec_id) LEFT JOIN c USING (vec_id) WHERE tx % 4 = 0 AND ty % 4 = 0 GROUP BY mosaic"""))
def _(s, d):
    # a mosaic is 8 x 8 root tiles; every fourth along each side stands for it
    return reduction(planes(s, d).select("*", F.floor(F.col("vec_id") / 64).cast("long").alias("mosaic"), (F.col("vec_id") % 8).alias("tx"), (F.floor(F.col("vec_id") / 8) % 8).alias("ty")), "mosaic", 4)


def reduction(df, key: str, stride: int):
    """key, cells, pixels and the share of subject pixels that cells save; root tiles at every stride-th place tx, ty are built."""
    some = df.filter(f"tx % {stride} = 0 AND ty % {stride} = 0")
    tile = some.groupBy(key, "vec_id").agg(F.count_if(subject()).alias("pixels"))
    cells = quad(some).groupBy("vec_id").agg(F.count("*").alias("cells"))
    out = tile.join(cells, "vec_id", "left").groupBy(key).agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.sum("pixels").alias("pixels"))
    return out.select(key, "cells", "pixels", r6(F.when(F.col("pixels") == 0, 0.0).otherwise(1 - F.col("cells") / F.col("pixels")), "reduction"))


@query("metric_reduction", sql("planes", _QT + """, sub AS (SELECT vec_id, count(*) FILTER (alpha >= 128) AS pixels FROM planes GROUP BY vec_id), c AS (SELECT vec_id, count(*) AS cells FROM ce GROUP BY vec_id)
SELECT vec_id, coalesce(cells, 0) AS cells, pixels, round(CASE WHEN pixels = 0 THEN 0 ELSE 1 - coalesce(cells, 0) / pixels::DOUBLE END, 6) AS reduction FROM sub LEFT JOIN c USING (vec_id)"""))
def _(s, d):
    return reduction(planes(s, d).select("*", F.col("vec_id").alias("plane"), F.lit(0).alias("tx"), F.lit(0).alias("ty")), "plane", 1).withColumnRenamed("plane", "vec_id")


@query("quadtree_flatten", sql("planes", _QT + " SELECT p.vec_id, p.x, p.y, round(ce.m, 6) AS depth FROM planes p JOIN ce ON ce.vec_id = p.vec_id AND p.x // CAST(pow(2, ce.level) AS INT) = ce.cx AND p.y // CAST(pow(2, ce.level) AS INT) = ce.cy WHERE p.alpha >= 128"))
def _(s, d):
    df = planes(s, d)
    side = F.pow(F.lit(2), "level").cast("int")
    span = lambda c: F.explode(F.sequence(F.col(c) * F.col("side"), F.col(c) * F.col("side") + F.col("side") - 1))
    # a cell writes itself back over the pixels that it covers
    back = quad(df).withColumn("side", side).select("vec_id", "m_depth", "cy", "side", span("cx").alias("x")).select("vec_id", "m_depth", "x", span("cy").alias("y"))
    return df.filter(subject()).select("vec_id", "x", "y").join(back, ["vec_id", "x", "y"]).select("vec_id", "x", "y", r6(F.col("m_depth"), "depth"))


@query("quadtree_solve_k", sql("planes", """lv AS (SELECT unnest([0, 1, 2, 3]) AS level), nd AS (SELECT vec_id, level, x // CAST(pow(2, level) AS INT) AS cx, y // CAST(pow(2, level) AS INT) AS cy, count(*) AS n, sum(CASE WHEN alpha >= 128 THEN 1 ELSE 0 END) AS inside, coalesce(var_pop(depth) FILTER (alpha >= 128), 0) / 0.01::DOUBLE AS s FROM planes, lv GROUP BY ALL),
o AS (SELECT *, CASE WHEN level = 0 THEN 0 WHEN inside > 0 AND inside < n THEN 1e300 ELSE s END AS k0 FROM nd), k AS (SELECT a.vec_id, a.level, a.cx, a.cy, a.inside, max(b.k0) AS k FROM o a JOIN o b ON b.vec_id = a.vec_id AND b.level <= a.level AND b.cx // CAST(pow(2, a.level - b.level) AS INT) = a.cx AND b.cy // CAST(pow(2, a.level - b.level) AS INT) = a.cy GROUP BY ALL),
t AS (SELECT c.inside, c.k, coalesce(p.k, 1e301) AS pk FROM k c LEFT JOIN k p ON p.vec_id = c.vec_id AND p.level = c.level + 1 AND p.cx = c.cx // 2 AND p.cy = c.cy // 2)
SELECT CAST(q AS INT) AS q, count(*) FILTER (inside > 0 AND k <= pow(2.0, q - 4) AND pk > pow(2.0, q - 4)) AS cells FROM t, range(9) r(q) GROUP BY q"""))
def _(s, d):
    # a node is whole at k if its own critical value is at most k and its parent's is above
    t = pyramid.nodes(planes(s, d).withColumn("inside", subject()), 3, ["depth"])
    own = F.when(F.col("level") == 0, 0.0).when((F.col("inside") > 0) & (F.col("inside") < F.col("n")), 1e300).otherwise(F.col("s_depth") / 0.01)
    t = t.select("vec_id", "level", "cx", "cy", "inside", own.alias("k0"))
    ups = t.select("vec_id", "k0", F.explode(F.sequence("level", F.lit(3))).alias("up"), "level", "cx", "cy")
    shift = F.pow(F.lit(2), F.col("up") - F.col("level"))
    k = ups.groupBy("vec_id", F.col("up").alias("level"), F.floor(F.col("cx") / shift).cast("int").alias("cx"), F.floor(F.col("cy") / shift).cast("int").alias("cy")).agg(F.max("k0").alias("k"))
    c = t.join(k, ["vec_id", "level", "cx", "cy"]).withColumn("px", F.floor(F.col("cx") / 2).cast("int")).withColumn("py", F.floor(F.col("cy") / 2).cast("int"))
    up = k.select("vec_id", (F.col("level") - 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("k").alias("pk"))
    c = c.join(up, ["vec_id", "level", "px", "py"], "left").withColumn("pk", F.coalesce("pk", F.lit(1e301)))
    at = [2.0 ** (q - 4) for q in range(9)]
    one = c.agg(*(F.count_if((F.col("inside") > 0) & (F.col("k") <= v) & (F.col("pk") > v)).alias(f"c{q}") for q, v in enumerate(at)))
    return one.select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"c{q}").alias("cells")) for q in range(9)])).alias("t")).select("t.*")


# --- clouds ------------------------------------------------------------------


def _vox(rel: str, out: str, shift: str) -> str:
    return f"""{out}k AS (SELECT *, CAST(floor((x + {shift}) / 0.05::DOUBLE) AS BIGINT) AS ix, CAST(floor((y + {shift}) / 0.05::DOUBLE) AS BIGINT) AS iy, CAST(floor((z + {shift}) / 0.05::DOUBLE) AS BIGINT) AS iz FROM {rel}),
{out}s AS (SELECT ix, iy, iz, arg_min(nx, (-face_on, pid)) AS sx, arg_min(ny, (-face_on, pid)) AS sy, arg_min(nz, (-face_on, pid)) AS sz FROM {out}k GROUP BY ALL),
{out}d AS (SELECT k.*, CASE WHEN nx * sx + ny * sy + nz * sz >= 0 THEN 0 ELSE 1 END AS side FROM {out}k k JOIN {out}s USING (ix, iy, iz)),
{out}f AS (SELECT ix, iy, iz, side, source, round(sum(face_on), 9) AS f FROM {out}d GROUP BY ALL), {out}w AS (SELECT ix, iy, iz, side, arg_min(source, (-f, source)) AS source FROM {out}f GROUP BY ALL),
{out} AS (SELECT pid, source, x, y, z, nx, ny, nz, face_on FROM {out}d JOIN {out}w USING (ix, iy, iz, side, source))"""


@query("dedup_voxel_pass1", sql("pts", _vox("pts", "v1", "0.0") + " SELECT pid, source FROM v1"))
def _(s, d):
    return cloud.voxel_pass(points(s, d), 0.05, 0.0).select("pid", "source")


@query("dedup_voxel_two_pass", sql("pts", _vox("pts", "v1", "0.0") + ", " + _vox("v1", "v2", "0.025::DOUBLE") + " SELECT pid, source FROM v2"))
def _(s, d):
    return cloud.voxel_pass(cloud.voxel_pass(points(s, d), 0.05, 0.0), 0.05, 0.5).select("pid", "source")


_SRC = "CASE source WHEN 0 THEN 'front' WHEN 1 THEN 'right' ELSE 'left' END"


def moved(df, p):
    """Points in the frame of a pose about (0.5, 0.5, 0.5)."""
    j = df.join(F.broadcast(p), "slot")  # three poses
    c = [F.col(k) - 0.5 for k in "xyz"]
    w = [(F.col("scale") * sum((F.col(f"m{i}{k}") * c[k] for k in range(3)), F.lit(0.0)) + 0.5).alias(f"w{'xyz'[i]}") for i in range(3)]
    return j.select("*", *w)


_MOVE = "mv AS (SELECT pts.*, slot, scale * (m00 * (x - 0.5) + m01 * (y - 0.5) + m02 * (z - 0.5)) + 0.5 AS wx, scale * (m10 * (x - 0.5) + m11 * (y - 0.5) + m12 * (z - 0.5)) + 0.5 AS wy, scale * (m20 * (x - 0.5) + m21 * (y - 0.5) + m22 * (z - 0.5)) + 0.5 AS wz FROM pts JOIN rot ON {on})"


def with_slot(df):
    return df.withColumn("slot", F.when(F.col("source") == 0, "front").when(F.col("source") == 1, "right").otherwise("left"))


@query("merge_union", sql("pts", _MOVE.format(on=f"slot = {_SRC}") + " SELECT pid, slot, round(wx, 6) AS x, round(wy, 6) AS y, round(wz, 6) AS z FROM mv", _POSES + ", " + _ROT))
def _(s, d):
    return moved(with_slot(points(s, d)), poses(s)).select("pid", "slot", *(r6(F.col(f"w{c}"), c) for c in "xyz"))


_GRID = "gr AS (SELECT slot AS view, CAST(floor(wx * 16) AS INT) AS gx, CAST(floor(wy * 16) AS INT) AS gy, min(wz) AS seen FROM mv WHERE slot = {src} GROUP BY ALL)"
_PROBE = _MOVE.format(on="true") + ", " + _GRID.format(src=_SRC)


def probe(pts, p):
    """Every point in the view of every other source, with what that view saw there: a small grid of nearest depths."""
    own = with_slot(pts).withColumnRenamed("slot", "own")
    allv = moved(own.select("*", F.explode(F.array(F.lit("front"), F.lit("right"), F.lit("left"))).alias("slot")), p)
    allv = allv.select("*", F.floor(F.col("wx") * 16).cast("int").alias("gx"), F.floor(F.col("wy") * 16).cast("int").alias("gy"))
    grid = allv.filter("slot = own").groupBy("slot", "gx", "gy").agg(F.min("wz").alias("seen"))
    return allv.filter("slot <> own").join(grid, ["slot", "gx", "gy"])


@query("join_projection_probe", sql("pts", _PROBE + f" SELECT pid, slot AS view, round(wz - seen, 6) AS behind FROM mv JOIN gr ON view = slot AND gx = CAST(floor(wx * 16) AS INT) AND gy = CAST(floor(wy * 16) AS INT) WHERE slot <> {_SRC}", _POSES + ", " + _ROT))
def _(s, d):
    return probe(points(s, d), poses(s)).select("pid", F.col("slot").alias("view"), r6(F.col("wz") - F.col("seen"), "behind"))


@query("join_free_space_anti", sql("pts", _PROBE + f" SELECT pid FROM pts WHERE pid NOT IN (SELECT pid FROM mv JOIN gr ON view = slot AND gx = CAST(floor(wx * 16) AS INT) AND gy = CAST(floor(wy * 16) AS INT) WHERE slot <> {_SRC} AND seen - wz > 0.02)", _POSES + ", " + _ROT))
def _(s, d):
    p = points(s, d)
    bad = probe(p, poses(s)).filter("seen - wz > 0.02").select("pid")
    return p.join(bad, "pid", "left_anti").select("pid")


@query("agg_inside_ratio", sql("pts", _PROBE + f", pr AS (SELECT mv.pid, slot, seen FROM mv LEFT JOIN gr ON view = slot AND gx = CAST(floor(wx * 16) AS INT) AND gy = CAST(floor(wy * 16) AS INT) WHERE slot <> {_SRC}) SELECT slot, count(*) AS n, round(avg(CASE WHEN seen IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS inside FROM pr GROUP BY slot", _POSES + ", " + _ROT))
def _(s, d):
    return inside_ratio(points(s, d), poses(s)).select("slot", "n", r6(F.col("inside"), "inside"))


def inside_ratio(pts, p):
    """Per view the share of other sources' points that fall where it saw the subject."""
    n = with_slot(pts).groupBy("slot").agg(F.count("*").alias("own"))
    hit = probe(pts, p).groupBy("slot").agg(F.count("*").alias("hit"))
    total = F.sum("own").over(Window.partitionBy())  # three rows
    return n.select("slot", (total - F.col("own")).alias("n")).join(hit, "slot", "left").select("slot", "n", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("inside"))


_ALIGN = _PROBE + f", pr AS (SELECT mv.pid, slot, seen FROM mv LEFT JOIN gr ON view = slot AND gx = CAST(floor(wx * 16) AS INT) AND gy = CAST(floor(wy * 16) AS INT) WHERE slot <> {_SRC}), ra AS (SELECT slot, avg(CASE WHEN seen IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS inside FROM pr GROUP BY slot)"


@query("align_gate", sql("pts", _ALIGN + " SELECT arg_min(slot, (round(inside, 9), slot)) AS worst, round(min(inside), 6) AS inside, min(inside) >= 0.9 AS passed FROM ra", _POSES + ", " + _ROT))
def _(s, d):
    low = inside_ratio(points(s, d), poses(s)).agg(F.min(F.struct(F.round("inside", 9).alias("i"), "slot")).alias("t"), F.min("inside").alias("inside"))
    return low.select(F.col("t.slot").alias("worst"), r6(F.col("inside"), "inside"), (F.col("inside") >= 0.9).alias("passed"))


@query("align_cost", sql("pts", _ALIGN + ", ex AS (SELECT slot, max(wy) - min(wy) AS h, max(wx) - min(wx) AS w FROM mv GROUP BY slot) SELECT slot, round(1 - inside + 0.15::DOUBLE * abs(h / w - 1), 6) AS cost FROM ra JOIN ex USING (slot)", _POSES + ", " + _ROT))
def _(s, d):
    p, ps = points(s, d), poses(s)
    ex = moved(p.select("*", F.explode(F.array(F.lit("front"), F.lit("right"), F.lit("left"))).alias("slot")), ps).groupBy("slot").agg((F.max("wy") - F.min("wy")).alias("h"), (F.max("wx") - F.min("wx")).alias("w"))
    return inside_ratio(p, ps).join(ex, "slot").select("slot", r6(1 - F.col("inside") + 0.15 * F.abs(F.col("h") / F.col("w") - 1), "cost"))


@query("align_yaw_scan", sql("pts", """c AS (SELECT CAST(k AS INT) AS k, (k - 20) * pi() / 90 AS yaw FROM range(41) t(k)), f AS (SELECT DISTINCT CAST(floor(x * 16) AS INT) AS gx, CAST(floor(y * 16) AS INT) AS gy FROM pts WHERE source = 0),
h AS (SELECT k, count(*) AS n, count(f.gx) AS hit FROM pts CROSS JOIN c LEFT JOIN f ON f.gx = CAST(floor(((x - 0.5) * cos(yaw) + (z - 0.5) * sin(yaw) + 0.5) * 16) AS INT) AND f.gy = CAST(floor(y * 16) AS INT) WHERE source <> 0 GROUP BY k) SELECT k, n, hit FROM h"""))
def _(s, d):
    p = points(s, d)
    front = p.filter("source = 0").select(F.floor(F.col("x") * 16).cast("int").alias("gx"), F.floor(F.col("y") * 16).cast("int").alias("gy")).distinct().withColumn("hit", F.lit(1))
    yaw = (F.col("k") - 20) * F.pi() / 90
    e = p.filter("source <> 0").select("x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k"))
    # counted by grid cell first, so that 41 turns of a point are not 41 joined rows
    cells = e.groupBy("k", F.floor(((F.col("x") - 0.5) * F.cos(yaw) + (F.col("z") - 0.5) * F.sin(yaw) + 0.5) * 16).cast("int").alias("gx"), F.floor(F.col("y") * 16).cast("int").alias("gy")).agg(F.count("*").alias("m"))
    return cells.join(front, ["gx", "gy"], "left").groupBy("k").agg(F.sum("m").alias("n"), F.coalesce(F.sum(F.col("m") * F.col("hit")), F.lit(0)).alias("hit"))


@query("join_double_rate_semi", sql("pts", """g AS (SELECT *, CAST(floor(x * 50) AS INT) AS ix, CAST(floor(y * 50) AS INT) AS iy, CAST(floor(z * 50) AS INT) AS iz FROM pts),
o AS (SELECT b.*, ix + i AS jx, iy + j AS jy, iz + k AS jz FROM g b, range(-1, 2) a(i), range(-1, 2) c(j), range(-1, 2) e(k)),
hit AS (SELECT DISTINCT s.pid FROM g s JOIN o b ON b.jx = s.ix AND b.jy = s.iy AND b.jz = s.iz WHERE b.source <> s.source AND (b.x - s.x) * (b.x - s.x) + (b.y - s.y) * (b.y - s.y) + (b.z - s.z) * (b.z - s.z) <= 0.0004 AND b.nx * s.nx + b.ny * s.ny + b.nz * s.nz >= 0.7)
SELECT count(*) AS n, count(hit.pid) AS doubled FROM pts LEFT JOIN hit USING (pid)"""))
def _(s, d):
    n, doubled = cloud.partnered(points(s, d), 0.02, 0.7)
    return s.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(doubled).cast("long").alias("doubled"))


# --- rendering ---------------------------------------------------------------

_BUCKET = "CAST(least(8191, greatest(0, floor((1 - (z + 2 - 1.1::DOUBLE) / 1.8::DOUBLE) * 8192))) AS INT)"


@query("render_depth_histogram", sql("pts", f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM pts GROUP BY ALL"))
def _(s, d):
    return points(s, d).groupBy(depth_bucket().alias("bucket")).agg(F.count("*").alias("n"))


@query("render_bucket_offsets", sql("pts", f"h AS (SELECT {_BUCKET} AS bucket, count(*) AS n FROM pts GROUP BY ALL) SELECT a.bucket, a.n, CAST(coalesce((SELECT sum(n) FROM h b WHERE b.bucket < a.bucket), 0) AS BIGINT) AS before FROM h a"))
def _(s, d):
    return cloud.bucket_offsets(points(s, d), depth_bucket())


@query("render_depth_sort", sql("pts", f"SELECT pid, bucket, row_number() OVER (ORDER BY bucket, pid) - 1 AS place FROM (SELECT pid, {_BUCKET} AS bucket FROM pts)"))
def _(s, d):
    p = points(s, d).select("pid", depth_bucket().alias("bucket"))
    # a counting sort: the buckets' offsets, then ranks inside each
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("pid"))
    off = cloud.bucket_offsets(p, F.col("bucket")).select("bucket", "before")  # 8192 rows at most
    return p.withColumn("k", rank).join(F.broadcast(off), "bucket").select("pid", "bucket", (F.col("before") + F.col("k") - 1).alias("place"))


@query("render_composite", sql("pts", """t AS (SELECT CAST(floor(x * 16) AS INT) AS ix, CAST(floor(y * 16) AS INT) AS iy, z, pid, r / 255.0::DOUBLE AS c, a / 255.0::DOUBLE * 0.5 AS al FROM pts),
o AS (SELECT ix, iy, list({'c': c, 'a': al} ORDER BY z DESC, pid) AS l FROM t GROUP BY ALL) SELECT ix, iy, round(list_reduce(list_transform(l, lambda e: {'c': e.c * e.a, 'a': e.a, 't': 1 - e.a}), lambda p, q: {'c': p.c * q.t + q.c, 'a': p.a * q.t + q.a, 't': q.t}).c, 6) AS c, round(list_reduce(list_transform(l, lambda e: {'c': e.c * e.a, 'a': e.a, 't': 1 - e.a}), lambda p, q: {'c': p.c * q.t + q.c, 'a': p.a * q.t + q.a, 't': q.t}).a, 6) AS cover FROM o"""))
def _(s, d):
    cell = lambda c: F.floor(F.col(c) * 16).cast("int").alias(f"i{c}")
    rows = points(s, d).select(cell("x"), cell("y"), (-F.col("z")).alias("far"), "pid", (F.col("r") / 255.0).alias("c"), (F.col("a") / 255.0 * 0.5).alias("al"))
    out = cloud.composite(rows, ["ix", "iy"], ["far", "pid"], "c", "al", (-1.0, 0.0))
    return out.select("ix", "iy", r6(F.col("c"), "c"), r6(F.col("cover"), "cover"))


@query("render_frame_stats", sql("pts", f"c AS (SELECT *, (nx * (0.5 - x) + ny * (0.5 - y) + nz * (-2 - z)) / sqrt((0.5 - x) * (0.5 - x) + (0.5 - y) * (0.5 - y) + (-2 - z) * (-2 - z)) AS dot FROM pts) SELECT count(*) AS total, count(*) FILTER (dot >= -0.15) AS drawn, count(DISTINCT {_BUCKET}) FILTER (dot >= -0.15) AS buckets FROM c"))
def _(s, d):
    ex, ey, ez = 0.5 - F.col("x"), 0.5 - F.col("y"), -2 - F.col("z")
    dot = (F.col("nx") * ex + F.col("ny") * ey + F.col("nz") * ez) / P.hypot3(ex, ey, ez)
    drawn = dot >= -0.15
    by = points(s, d).groupBy(depth_bucket().alias("bucket")).agg(F.count("*").alias("n"), F.count_if(drawn).alias("k"))
    return by.agg(F.sum("n").alias("total"), F.sum("k").alias("drawn"), F.count_if(F.col("k") > 0).alias("buckets"))


# --- splats ------------------------------------------------------------------


@query("splat_front", sql("planes", _QT + """ SELECT vec_id, level, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, round((cx * s + s / 2.0 - 4) * (1 + m) / 9, 6) AS wx, round((cy * s + s / 2.0 - 4) * (1 + m) / 9, 6) AS wy, round(1 + m, 6) AS wz, round(0.5 * s * (1 + m) / 9 * 1.3::DOUBLE, 6) AS radius FROM (SELECT *, pow(2.0, level)::DOUBLE AS s FROM ce)"""))
def _(s, d):
    side, z = F.pow(F.lit(2.0), "level"), 1 + F.col("m_depth")
    at = lambda c: (F.col(c) * side + side / 2 - 4) * z / 9
    return quad(planes(s, d)).select("vec_id", "level", "cx", "cy", r6(at("cx"), "wx"), r6(at("cy"), "wy"), r6(z, "wz"), r6(0.5 * side * z / 9 * 1.3, "radius"))


@query("splat_back", sql("planes", "SELECT vec_id, x, y, round(1 + depth + 0.3::DOUBLE * (g / 255.0::DOUBLE), 6) AS wz, CAST(round_even(r * 0.55::DOUBLE, 0) AS INT) AS r FROM planes WHERE alpha >= 128 AND x % 2 = 0 AND y % 2 = 0"))
def _(s, d):
    return planes(s, d).filter(subject() & (F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)).select("vec_id", "x", "y", r6(1 + F.col("depth") + 0.3 * (F.col("g") / 255.0), "wz"), P.u8(F.col("r") * 0.55).alias("r"))


@query("splat_skirt", sql("planes", """nb AS (SELECT a.vec_id, a.x, a.y, a.depth, greatest(0, coalesce(max(b.depth - a.depth), 0)) AS gap FROM planes a LEFT JOIN planes b ON b.vec_id = a.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND b.alpha >= 128 WHERE a.alpha >= 128 GROUP BY ALL),
k AS (SELECT *, CAST(least(12, greatest(1, ceil(gap / 0.05))) AS INT) AS steps FROM nb WHERE gap >= 0.1), e AS (SELECT *, unnest(range(1, steps + 1)) AS i FROM k)
SELECT vec_id, x, y, CAST(i AS INT) AS step, round(1 + depth + gap * i / (steps + 1), 6) AS wz, round(1 - i / (steps + 1)::DOUBLE, 6) AS fade FROM e"""))
def _(s, d):
    k = gaps(planes(s, d)).filter("gap >= 0.1").withColumn("steps", P.clamp(F.ceil(F.col("gap") / 0.05), 1, 12).cast("int"))
    e = k.select("*", F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("step"))
    t = F.col("step") / (F.col("steps") + 1)
    return e.select("vec_id", "x", "y", "step", r6(1 + F.col("depth") + F.col("gap") * t, "wz"), r6(1 - t, "fade"))


@query("splat_pack", sql("pts", """b AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, 1 / greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS k FROM pts)
SELECT pid, round((x - cx) * k, 6) AS x, round((y - cy) * k, 6) AS y, round((z - cz) * k, 6) AS z, round(0.5 * 0.01::DOUBLE * (z + 1) * k * 1.3::DOUBLE / greatest(abs(nz), 0.3::DOUBLE), 6) AS radius FROM pts, b"""))
def _(s, d):
    p = points(s, d)
    ext = F.greatest(*(F.max(c) - F.min(c) for c in "xyz"))
    frame = p.agg(*(((F.min(c) + F.max(c)) / 2).alias(f"c{c}") for c in "xyz"), (1 / ext).alias("k"))
    e = p.crossJoin(F.broadcast(frame))  # one row
    return e.select("pid", *(r6((F.col(c) - F.col(f"c{c}")) * F.col("k"), c) for c in "xyz"), r6(0.5 * 0.01 * (F.col("z") + 1) * F.col("k") * 1.3 / F.greatest(F.abs("nz"), F.lit(0.3)), "radius"))
