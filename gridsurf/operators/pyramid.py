"""Image pyramids as row and column windows, quadtrees as one grouping of all ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsurf.operators import windows as N
from gridsurf.operators.graph import saved

KERNEL = (1, 4, 6, 4, 1)


def _along(axis: str):
    return N.along_x() if axis == "x" else N.along_y()


def _at(k: int, axis: str) -> Column:
    """The value k places on, null beyond the border; planes are dense."""
    return F.lag("v", -k).over(_along(axis)) if k < 0 else F.lead("v", k).over(_along(axis)) if k else F.col("v")


def _smooth(df: DataFrame, axis: str) -> DataFrame:
    """The 5 taps along one axis; places beyond an end are mirrored about it, between two pixels."""
    a2, a1, v, b1, b2 = (_at(k, axis) for k in range(-2, 3))
    before, after = F.coalesce(a1, v), F.coalesce(b1, v)
    far_before, far_after = F.coalesce(a2, F.when(a1.isNull(), F.coalesce(b1, v)).otherwise(a1)), F.coalesce(b2, F.when(b1.isNull(), F.coalesce(a1, v)).otherwise(b1))
    return df.select("vec_id", "x", "y", ((far_before + far_after) * KERNEL[0] / 16.0 + (before + after) * KERNEL[1] / 16.0 + v * KERNEL[2] / 16.0).alias("v"))


def smooth(df: DataFrame, n: int) -> DataFrame:
    """[1 4 6 4 1] / 16 along both axes of n x n planes (vec_id, x, y, v), reflected edges. One deal by plane serves both."""
    return _smooth(_smooth(N.by_plane(df), "x"), "y")


def _halve(df: DataFrame) -> DataFrame:
    half = lambda c: (F.col(c) / 2).cast("int").alias(c)
    return df.filter("x % 2 = 0 AND y % 2 = 0").select("vec_id", half("x"), half("y"), "v")


def down(df: DataFrame, n: int) -> DataFrame:
    return _halve(smooth(df, n))


def _double(df: DataFrame, axis: str, n: int) -> DataFrame:
    """One axis to n places: values at even places, zeros between, the taps at twice their weight. A value makes its own place and the one after."""
    at, last = F.col(axis), (n + 1) // 2 - 1
    a, v, b = (_at(k, axis) for k in (-1, 0, 1))
    k0, k1, k2 = KERNEL[:3]
    # mirrored places hold a value where they are even: -2 is 1 and -1 is 0 at the front, n is n - 1 and n + 1 is n - 2 at the back
    first, odd_first = F.when(at == 0, k1 * v).otherwise(k0 * a), F.when(at == 0, k0 * v).otherwise(0.0)
    if n % 2:  # the last place is even: n is itself, n + 1 is odd
        then, odd_then = F.when(at == last, k1 * v).otherwise(k0 * b), F.when(at == last - 1, (k0 + k1) * b).otherwise(k1 * b)
    else:  # the last place is odd: n is odd, n + 1 is the value before it
        then, odd_then = F.when(at == last, F.lit(0.0)).otherwise(k0 * b), F.when(at == last, k0 * v).otherwise(k1 * b)
    even, odd = (first + k2 * v + then) / 8.0, (odd_first + k1 * v + odd_then) / 8.0
    other = "y" if axis == "x" else "x"
    df = df.select("vec_id", axis, other, even.alias("_e"), odd.alias("_o"))
    both = F.array(F.struct((at * 2).alias("p"), F.col("_e").alias("v")), F.struct((at * 2 + 1).alias("p"), F.col("_o").alias("v")))
    return df.select("vec_id", other, F.explode(both).alias("e")).filter(F.col("e.p") < n).select("vec_id", F.col("e.p").cast("int").alias(axis), other, "e.v")


def up(df: DataFrame, n: int) -> DataFrame:
    """To n x n: values at even places, zeros between, smoothed at four times the weight."""
    return _double(_double(N.by_plane(df), "x", n), "y", n).select("vec_id", "x", "y", "v")


def gaussian(df: DataFrame, n: int, least: int = 2) -> list[tuple[int, DataFrame]]:
    out = [(n, df)]
    while n > least:
        df = down(df, n)
        n = (n + 1) // 2
        out.append((n, df))
    return out


def laplacian(df: DataFrame, n: int) -> list[tuple[int, DataFrame]]:
    """Differences of each level and the next one enlarged; the last level as it is."""
    g = gaussian(df, n)
    out = []
    for (size, a), (_, b) in zip(g, g[1:]):
        u = up(b, size).withColumnRenamed("v", "u")
        out.append((size, a.join(u, ["vec_id", "x", "y"], "left").select("vec_id", "x", "y", (F.col("v") - F.coalesce("u", F.lit(0.0))).alias("v"))))
    return [*out, g[-1]]


def collapse(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    _, df = levels[-1]
    for size, lap in reversed(levels[:-1]):
        u = up(df, size).withColumnRenamed("v", "u")
        df = lap.join(u, ["vec_id", "x", "y"], "left").select("vec_id", "x", "y", (F.col("v") + F.coalesce("u", F.lit(0.0))).alias("v"))
    return df


def nodes(df: DataFrame, levels: int, values: list[str]) -> DataFrame:
    """Every quadtree node of planes: vec_id, level, cx, cy, n, inside, m_<value>, s_<value> (mean and variance of its pixels).

    df: vec_id, x, y, inside (boolean) and value columns.
    """
    own = lambda v: F.when(F.col("inside"), F.col(v)).otherwise(0.0)
    side = F.pow(F.lit(2), F.col("level"))
    up = lambda c: F.floor(F.col(c) / side).cast("int").alias(f"c{c}")
    # every pixel counts in all the nodes that hold it; sums are made before the shuffle
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    each = each.select("vec_id", "level", up("x"), up("y"), F.col("inside").cast("long").alias("inside"), *(e for v in values for e in (own(v).alias(f"t_{v}"), (own(v) * own(v)).alias(f"q_{v}"))))
    out = each.groupBy("vec_id", "level", "cx", "cy").agg(F.count("*").alias("n"), F.sum("inside").alias("inside"), *(F.sum(f"{k}_{v}").alias(f"{k}_{v}") for v in values for k in ("t", "q")))
    m = lambda v: F.col(f"t_{v}") / F.greatest(F.col("inside"), F.lit(1))
    return out.select("vec_id", "level", "cx", "cy", "n", "inside", *(e for v in values for e in (m(v).alias(f"m_{v}"), F.greatest(F.col(f"q_{v}") / F.greatest(F.col("inside"), F.lit(1)) - m(v) * m(v), F.lit(0.0)).alias(f"s_{v}"))))


def cells(tree: DataFrame, levels: int, split: Column) -> DataFrame:
    """The nodes that stay whole: those that do not split although what holds them does. A node splits if it or any below it must.

    split: whether a node must split for itself; single pixels never do.
    """
    tree = saved(tree.withColumn("own", split & (F.col("level") > 0)))  # read three times
    # the needs of all below come up in one grouping of every node's ancestors
    ups = tree.filter("own").select("vec_id", F.explode(F.sequence("level", F.lit(levels))).alias("up"), "level", "cx", "cy")
    shift = F.pow(F.lit(2), F.col("up") - F.col("level"))
    marked = ups.select("vec_id", F.col("up").alias("level"), F.floor(F.col("cx") / shift).cast("int").alias("cx"), F.floor(F.col("cy") / shift).cast("int").alias("cy")).distinct().withColumn("parts", F.lit(True))
    t = tree.join(marked, ["vec_id", "level", "cx", "cy"], "left").withColumn("parts", F.coalesce("parts", F.lit(False)))
    above = t.filter("parts").select("vec_id", (F.col("level") - 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    whole = t.filter("NOT parts AND inside > 0").withColumn("px", F.floor(F.col("cx") / 2).cast("int")).withColumn("py", F.floor(F.col("cy") / 2).cast("int"))
    roots = whole.filter(F.col("level") == levels)
    return whole.filter(F.col("level") < levels).join(above, ["vec_id", "level", "px", "py"], "left_semi").unionByName(roots.select(*["vec_id", "level", "px", "py"], *[c for c in whole.columns if c not in ("vec_id", "level", "px", "py")])).drop("px", "py", "own", "parts")
