"""Components of masks and point graphs, exact distances and nearest-foreground look-up."""

from __future__ import annotations

import re
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsurf.operators import windows as N


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder of spark.checkpoint.dir; where that is unset, a local session gets one of its own and a cluster is refused."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty() and sc.getConf().get("spark.checkpoint.dir"):
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir"))
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gridsurf-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) of every node on an edge a, b of longs.

    Each round hangs every node's larger neighbours on its least neighbour, then the
    smaller ones likewise, which ends in stars after a logarithmic number of rounds.
    """

    def hang(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = e.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        j = e.join(low, "a")
        if larger:
            out = j.filter("b > a").select(F.col("b").alias("x"), "low")
        else:
            out = j.select(F.col("b").alias("x"), "low").unionByName(low.select(F.col("a").alias("x"), "low"))
        return out.filter("x <> low").select(F.greatest("x", "low").alias("a"), F.least("x", "low").alias("b")).distinct()

    e = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(64):  # rounds are logarithmic in the nodes
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        e = saved(hang(hang(e, True), False))
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select("b", F.col("b").alias("root")).distinct().withColumnRenamed("b", "node"))


def label(df: DataFrame, mask: Column, diagonal: bool) -> DataFrame:
    """vec_id, x, y, root of masked pixels. Horizontal runs are the nodes, runs that touch in successive rows the edges."""
    runs = N.runs(df, mask)
    runs = saved(runs.select("vec_id", "y", "x0", "x1", F.monotonically_increasing_id().alias("node")))  # numbers of runs, fixed by the checkpoint
    r = 1 if diagonal else 0
    up = runs.select("vec_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("node").alias("b"))
    edges = runs.join(up, ["vec_id", "y"]).filter(f"x0 <= u1 + {r} AND u0 <= x1 + {r}").select(F.col("node").alias("a"), "b")
    named = runs.join(components(edges), "node", "left").select("vec_id", "y", "x0", "x1", F.coalesce("root", "node").alias("root"))
    return named.select("vec_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "root")


def lower(sites: list[tuple[int, int, int]], places: list[int]) -> list[int]:
    """For each place of a row the number of its nearest site; ties go to the least y, then the least x.

    sites: x, y and squared distance across the row of each site, x ascending. A site's squared distance at x is a parabola of one shape,
    so that differences of two are straight: the lines f + s * s - 2 * s * x. Those on the lower hull
    are found in one sweep, and places and hull then advance together, which makes a row's cost linear.
    """
    hull: list[int] = []
    lift = [f + x * x for x, _, f in sites]
    for k, (x, _, _) in enumerate(sites):
        while len(hull) > 1:
            i, j = hull[-2], hull[-1]
            # j is above the crossing of i and k
            if (lift[j] - lift[i]) * (x - sites[i][0]) > (lift[k] - lift[i]) * (sites[j][0] - sites[i][0]):
                hull.pop()
            else:
                break
        hull.append(k)
    out, at = [], 0
    for p in places:
        value = lambda k: lift[k] - 2 * sites[k][0] * p  # noqa: B023, E731
        while at + 1 < len(hull) and value(hull[at + 1]) < value(hull[at]):
            at += 1
        best, k = hull[at], at + 1
        while k < len(hull) and value(hull[k]) == value(hull[at]):  # lines through one point stay on the hull
            if sites[hull[k]][1::-1] < sites[best][1::-1]:
                best = hull[k]
            k += 1
        out.append(best)
    return out


def _nearest_in_row(df: DataFrame, site: Column) -> DataFrame:
    """df with `_m`, the site (x, y, v) nearest to the pixel, and `_d2`; site: the nearest one in the pixel's own column, as a struct of y and v.

    Rows of a plane are the unit: their sites are gathered in order of x under the deal by plane.
    """
    plain = [c for c in df.columns]
    rows = df.withColumn("_c", site).groupBy("vec_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "_c", *(c for c in plain if c not in ("vec_id", "x", "y"))))).alias("_p"))
    held = F.filter("_p", lambda e: e["_c"].isNotNull())
    rows = rows.withColumn("_s", F.transform(held, lambda e: F.struct(e["x"].alias("x"), e["_c"]["y"].alias("y"), e["_c"]["v"].alias("v"))))
    rows = rows.withColumn("_q", F.struct("y", F.transform("_p", lambda e: e["x"]).alias("at"), F.transform("_s", lambda e: e["x"]).alias("x"), F.transform("_s", lambda e: e["y"]).alias("sy")))

    @F.pandas_udf("array<int>")
    def pick(q: pd.DataFrame) -> pd.Series:
        out = []
        for y, at, x, sy in zip(q["y"], q["at"], q["x"], q["sy"], strict=True):
            sites = [(int(a), int(b), int(b - y) ** 2) for a, b in zip(x, sy, strict=True)]
            out.append(lower(sites, [int(p) for p in at]) if sites else None)
        return pd.Series(out)

    rows = rows.withColumn("_k", pick("_q"))
    each = rows.select("vec_id", "y", "_s", "_k", F.posexplode("_p").alias("_i", "_e")).withColumn("_m", F.get("_s", F.get("_k", F.col("_i"))))
    dx, dy = F.col("_e.x") - F.col("_m.x"), F.col("y") - F.col("_m.y")
    return each.select(*(F.col(c) if c in ("vec_id", "y") else F.col(f"_e.{c}").alias(c) for c in plain), "_m", (dx * dx + dy * dy).alias("_d2"))


def distance(df: DataFrame, outside: Column, out: str) -> DataFrame:
    """Exact distance to the nearest outside pixel of the plane, 1e10 where it has none; the border is not outside."""
    return nearest(df, outside, F.lit(None).cast("int"), "_v", out).drop("_v")


def nearest(df: DataFrame, inside: Column, value: Column, out: str, far: str | None = None) -> DataFrame:
    """The value of the nearest inside pixel of the plane, ties to the first in scan order; null where there is none. far: a column for its distance, 1e10 where there is none.

    Column by column the nearest inside row is a window; then each row's columns meet on the hull of lower().
    """
    plain = df.columns
    df = N.by_plane(df).withColumn("_i", inside).withColumn("_w", value)
    put = F.when(F.col("_i"), F.struct("y", F.col("_w").alias("v")))
    above = F.last(put, ignorenulls=True).over(N.along_y().rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(put, ignorenulls=True).over(N.along_y().rowsBetween(0, Window.unboundedFollowing))
    df = df.select(*plain, above.alias("_a"), below.alias("_b"))
    site = F.when(F.col("_a").isNull() | (F.col("_b.y") - F.col("y") < F.col("y") - F.col("_a.y")), F.col("_b")).otherwise(F.col("_a"))
    got = _nearest_in_row(df, site)
    more = [F.coalesce(F.sqrt(F.col("_d2").cast("double")), F.lit(1e10)).alias(far)] if far else []
    return got.select(*(c for c in plain if c != out), F.col("_m.v").alias(out), *more)
