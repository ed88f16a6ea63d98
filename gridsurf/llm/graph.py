"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsurf.llm import common


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: large stars hang higher neighbours on the least one, small stars the lower ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    out = both.join(least, "a")
    if large:
        out = out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of each node that an edge(a, b) touches; root: the least node of its component.

    Each round is written to the shared folder, so that plans stay short and a
    lost executor costs one round at most. Ends when a round changes nothing.
    """
    spark = edges.sparkSession
    now, path = common.write_table(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    was = state(now)
    for _ in range(rounds):
        if not was[0]:
            break
        new, new_path = common.write_table(_stars(_stars(now, True), False), "edges")
        common.drop_table(spark, path)
        now, path, seen = new, new_path, was
        was = state(now)
        if was == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
