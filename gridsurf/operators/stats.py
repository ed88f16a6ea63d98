"""Robust and least-squares statistics over grouped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(ordered: Column, q: float, rule: str = "round") -> Column:
    """The element of an ordered array at round(q(n-1)), floor(q(n-1)) or floor(qn); groups are planes, of bounded size."""
    n = F.size(ordered)
    at = {"round": F.floor(q * (n - 1) + 0.5), "floor": F.floor(q * (n - 1)), "count": F.least(n - 1, F.floor(q * n))}[rule]
    return F.when(n > 0, F.element_at(ordered, (at + 1).cast("int")))


def quantiles(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, float], rule: str = "round") -> DataFrame:
    """Exact ranked quantiles of each group, by one shuffle on the keys."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v")).select(*keys, *(nearest_rank(F.col("_v"), q, rule).alias(n) for n, q in wanted.items()))


def fit_line(df: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """keys, n, slope, shift, rmse of a least-squares line over finite pairs; the identity and an infinite rmse where it is not determined.

    The residual comes from the same five sums, so one aggregation does.
    """
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    s = df.select(*keys, x.cast("double").alias("_x"), y.cast("double").alias("_y")).filter(finite(F.col("_x")) & finite(F.col("_y"))).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.sum(F.col("_x") * F.col("_y")).alias("sxy"), F.sum(F.col("_y") * F.col("_y")).alias("syy")
    )
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy"))
    den = n * sxx - sx * sx
    ok = (n >= 2) & (F.abs(den) >= 1e-12)
    slope = F.when(ok, (n * sxy - sx * sy) / den).otherwise(1.0)
    s = s.withColumn("slope", slope).withColumn("shift", F.when(ok, (sy - F.col("slope") * sx) / n).otherwise(0.0))
    a, b = F.col("slope"), F.col("shift")
    sse = syy + a * a * sxx + n * b * b - 2 * a * sxy - 2 * b * sy + 2 * a * b * sx
    return s.select(*keys, "n", "slope", "shift", F.when(ok, F.sqrt(F.greatest(sse, F.lit(0.0)) / n)).otherwise(float("inf")).alias("rmse"))
