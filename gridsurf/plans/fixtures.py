"""Relations built from the supplied tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsurf.functions.packing import clamp, half_up

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x, y, v: each vector as a plane of 8 x 8."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "e"))
    return e.select("vec_id", "label", (F.col("pos") % SIDE).alias("x"), F.floor(F.col("pos") / SIDE).cast("int").alias("y"), F.col("e").cast("double").alias("v"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels with alpha, depth and colour."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.posexplode("embedding").alias("pos", "e"))
    v = F.col("e").cast("double")
    code = lambda c: clamp(half_up(128 + 512 * c), 0, 255).cast("int")
    at = lambda k: F.element_at("embedding", (F.col("pos") + k) % (SIDE * SIDE) + 1).cast("double")
    return e.select(
        "vec_id", "label", (F.col("pos") % SIDE).alias("x"), F.floor(F.col("pos") / SIDE).cast("int").alias("y"), v.alias("v"),
        code(v).alias("alpha"), clamp(0.5 + v, 0.0, 1.0).alias("depth"), code(v).alias("r"), code(at(21)).alias("g"), code(at(42)).alias("b"),
    )


def disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    radius = 2 + 0.15 * F.col("label")
    inside = (F.col("x") - 3.5) * (F.col("x") - 3.5) + (F.col("y") - 3.5) * (F.col("y") - 3.5) <= radius * radius
    return pixels(spark, sf_dir).select("vec_id", "x", "y", F.when(inside, 255).otherwise(0).alias("alpha"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, source, position, unit normal, face_on and colour of each line item. pid is made of the columns that tell lines apart."""
    li = table(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("double")
    pid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", half_up(d("l_extendedprice") * 100).cast("bigint"))
    x, y, z = d("l_quantity") / 50, (d("l_extendedprice") / 1000) % 1, d("l_discount") * 10
    ax, ay, az = x - 0.5, y - 0.5, d("l_tax") * 10 - 0.4
    raw = li.select(pid.alias("pid"), (F.col("l_linenumber") % 3).cast("int").alias("source"), x.alias("x"), y.alias("y"), z.alias("z"), ax.alias("ax"), ay.alias("ay"), az.alias("az"), *(F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
    size = F.greatest(F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az")), F.lit(1e-12))
    return raw.select(
        "pid", "source", "x", "y", "z", (F.col("ax") / size).alias("nx"), (F.col("ay") / size).alias("ny"), (F.col("az") / size).alias("nz"), F.abs(F.col("az") / size).alias("face_on"),
        (F.col("l_orderkey") % 256).cast("int").alias("r"), (F.col("l_partkey") % 256).cast("int").alias("g"), (F.col("l_suppkey") % 256).cast("int").alias("b"), (F.col("l_linenumber") * 36 % 256).cast("int").alias("a"),
    )


SQL = {
    "px": "SELECT vec_id, label, CAST(pos % 8 AS INT) AS x, CAST(pos // 8 AS INT) AS y, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding) AS e FROM embeddings)",
    "planes": """SELECT vec_id, label, CAST(pos % 8 AS INT) AS x, CAST(pos // 8 AS INT) AS y, v,
        CAST(least(255, greatest(0, floor(128 + 512 * v + 0.5))) AS INT) AS alpha, least(1.0, greatest(0.0, 0.5 + v)) AS depth,
        CAST(least(255, greatest(0, floor(128 + 512 * v + 0.5))) AS INT) AS r,
        CAST(least(255, greatest(0, floor(128 + 512 * CAST(embedding[(pos + 21) % 64 + 1] AS DOUBLE) + 0.5))) AS INT) AS g,
        CAST(least(255, greatest(0, floor(128 + 512 * CAST(embedding[(pos + 42) % 64 + 1] AS DOUBLE) + 0.5))) AS INT) AS b
        FROM (SELECT vec_id, label, embedding, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)""",
    "disc": "SELECT vec_id, x, y, CASE WHEN (x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5) <= (CAST(2 AS DOUBLE) + CAST(0.15 AS DOUBLE) * label) * (CAST(2 AS DOUBLE) + CAST(0.15 AS DOUBLE) * label) THEN 255 ELSE 0 END AS alpha FROM px",
    "pts0": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(CAST(l_extendedprice AS DOUBLE) * 100 + 0.5) AS BIGINT)) AS pid, CAST(l_linenumber % 3 AS INT) AS source,
        CAST(l_quantity AS DOUBLE) / 50 AS x, (CAST(l_extendedprice AS DOUBLE) / 1000) % 1 AS y, CAST(l_discount AS DOUBLE) * 10 AS z,
        CAST(l_quantity AS DOUBLE) / 50 - 0.5 AS ax, (CAST(l_extendedprice AS DOUBLE) / 1000) % 1 - 0.5 AS ay, CAST(l_tax AS DOUBLE) * 10 - CAST(0.4 AS DOUBLE) AS az,
        CAST(l_orderkey % 256 AS INT) AS r, CAST(l_partkey % 256 AS INT) AS g, CAST(l_suppkey % 256 AS INT) AS b, CAST(l_linenumber * 36 % 256 AS INT) AS a FROM lineitem""",
    "pts": """SELECT pid, source, x, y, z, ax / greatest(sqrt(ax * ax + ay * ay + az * az), CAST(1e-12 AS DOUBLE)) AS nx, ay / greatest(sqrt(ax * ax + ay * ay + az * az), CAST(1e-12 AS DOUBLE)) AS ny,
        az / greatest(sqrt(ax * ax + ay * ay + az * az), CAST(1e-12 AS DOUBLE)) AS nz, abs(az / greatest(sqrt(ax * ax + ay * ay + az * az), CAST(1e-12 AS DOUBLE))) AS face_on, r, g, b, a FROM pts0""",
}
_NEEDS = {"disc": ["px"], "pts": ["pts0"]}


def sql(uses: str, body: str, more: str = "") -> str:
    """body over the relations named in `uses`; `more`: further common table expressions."""
    names: list[str] = []
    for n in uses.split():
        names += [m for m in [*_NEEDS.get(n, []), n] if m not in names]
    parts = [f"{n} AS ({SQL[n]})" for n in names] + ([more] if more else [])
    joint = ",\n" if re.match(r"\w+ AS \(", body) else "\n"  # body may start with common table expressions of its own
    return "WITH RECURSIVE " + ",\n".join(parts) + joint + body if parts else body


def r6(col, name: str | None = None):
    """Rounded for comparison between engines, which sum in different orders."""
    c = F.round(col, 6)
    return c.alias(name) if name else c
