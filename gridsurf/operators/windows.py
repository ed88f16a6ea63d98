"""Neighbourhood operators over planes of pixels(vec_id, x, y, ...).

Rows are dealt by plane once; row windows and column windows then need no further
shuffle, as a deal by plane also keeps each row and each column together. Frames
are clipped at the border, as SQL frames are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "vec_id"


def by_plane(df: DataFrame) -> DataFrame:
    return df.repartition(KEY)


def along_x(r: int | None = None, back: bool = False):
    w = Window.partitionBy(KEY, "y").orderBy(F.desc("x") if back else "x")
    return w if r is None else w.rangeBetween(-r, r)


def along_y(r: int | None = None, back: bool = False):
    w = Window.partitionBy(KEY, "x").orderBy(F.desc("y") if back else "y")
    return w if r is None else w.rangeBetween(-r, r)


def box(df: DataFrame, r: int, **sums: Column) -> DataFrame:
    """df with the sum of each named expression over the (2r + 1)-sided square around each pixel."""
    names = list(sums)
    df = by_plane(df).select("*", *(F.sum(c).over(along_x(r)).alias(f"_{n}") for n, c in sums.items()))
    return df.select("*", *(F.sum(f"_{n}").over(along_y(r)).alias(n) for n in names)).drop(*(f"_{n}" for n in names))


def extremes(df: DataFrame, r: int, **wanted) -> DataFrame:
    """As box(), with (F.min or F.max, expression) for each name."""
    df = by_plane(df).select("*", *(f(c).over(along_x(r)).alias(f"_{n}") for n, (f, c) in wanted.items()))
    return df.select("*", *(f(f"_{n}").over(along_y(r)).alias(n) for n, (f, _) in wanted.items())).drop(*(f"_{n}" for n in wanted))


def box_mean(df: DataFrame, value: str, r: int, out: str) -> DataFrame:
    """Mean over the clipped square."""
    return box(df, r, _s=F.col(value), _n=F.lit(1.0)).withColumn(out, F.col("_s") / F.col("_n")).drop("_s", "_n")


def masked_box_mean(df: DataFrame, value: Column, mask: Column, r: int, out: str) -> DataFrame:
    """Mean over the masked pixels of the square; the pixel's own value where there are none."""
    df = box(df, r, _s=F.when(mask, value).otherwise(0.0), _n=F.when(mask, 1.0).otherwise(0.0))
    return df.withColumn(out, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(value)).drop("_s", "_n")


def separable_mean(df: DataFrame, value: str, r: int, out: str) -> DataFrame:
    """Mean of the row means of a column: differs from the mean of the square at clipped edges."""
    df = by_plane(df).withColumn("_m", F.avg(value).over(along_x(r)))
    return df.withColumn(out, F.avg("_m").over(along_y(r))).drop("_m")


def neighbours(df: DataFrame, value: Column) -> DataFrame:
    """df with the value to the left, right, above and below (null beyond the border)."""
    df = by_plane(df).withColumn("_v", value)
    return df.select("*", F.lag("_v").over(along_x()).alias("left"), F.lead("_v").over(along_x()).alias("right"), F.lag("_v").over(along_y()).alias("up"), F.lead("_v").over(along_y()).alias("down")).drop("_v")


def runs(df: DataFrame, mask: Column) -> DataFrame:
    """Maximal horizontal runs of masked pixels: vec_id, y, x0, x1, n."""
    on = by_plane(df).filter(mask).withColumn("_g", F.col("x") - F.row_number().over(along_x()))
    return on.groupBy(KEY, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n")).drop("_g")


def border_distance(df: DataFrame, mask: Column, limit: int, out: str) -> DataFrame:
    """Layers to peel (4 neighbours, the border counts as outside) before a pixel goes, `limit` at most; 0 outside.

    The city-block distance to the outside is the least, over a pixel's row, of the
    horizontal steps plus the vertical distance found first within each column.
    """
    big = 1 << 20
    df = by_plane(df).withColumn("_in", mask)
    last = lambda w: F.last(F.when(~F.col("_in"), F.col("y")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    edge_y = F.max("y").over(Window.partitionBy(KEY))
    edge_x = F.max("x").over(Window.partitionBy(KEY))
    df = df.select("*", F.coalesce(last(along_y()), F.lit(-1)).alias("_a"), last(along_y(back=True)).alias("_b"), edge_y.alias("_ey"), edge_x.alias("_ex"))
    df = df.withColumn("_d", F.least(F.col("y") - F.col("_a"), F.coalesce("_b", F.col("_ey") + 1) - F.col("y")))
    ahead = Window.partitionBy(KEY, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(KEY, "y").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    from_left = F.min(F.col("_d") - F.col("x")).over(ahead) + F.col("x")
    from_right = F.min(F.col("_d") + F.col("x")).over(behind) - F.col("x")
    df = df.select("*", F.least(from_left, from_right, F.col("x") + 1, F.col("_ex") + 1 - F.col("x"), F.lit(big)).alias("_l1"))
    value = F.when(~F.col("_in"), 0).when(F.col("_l1") < limit, F.col("_l1") - 1).otherwise(limit)
    return df.withColumn(out, value).drop("_in", "_a", "_b", "_ey", "_ex", "_d", "_l1")
