"""Benchmark decontamination by size-partitioned MinHash containment search (operator 5).

DataFrame functions only. A test item is the set of its word 5-grams. Items are
partitioned by the size of that set, in powers of two, and each partition has its
own number of minimum hashes: an item's sketch holds its lowest-hashed shingles, so
many that a document which holds THRESHOLD of the set cannot miss all of them (of m
shingles any m - ceil(0.8 m) + 1 will do). Documents too small for the least item of
a partition are not compared with it. Banded Jaccard signatures of whole documents
cannot do this: a 40-shingle item in a 20,000-word document has a Jaccard similarity
of 0.002. Documents that meet a sketch are verified by exact shingle containment.

Words are runs of letters and digits, lower case. Items of fewer than five words are
one shingle of all their words.

Cases: null, empty and wordless texts and items meet nothing; rows with the same
doc_id (null included) count as one document, items with the same item_id as one item;
empty tables give no rows; columns other than doc_id, text and item_id are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsurf.llm import common

SHINGLE = 5
#: Containment of at least NEED / OF.
NEED, OF = 4, 5
#: Rows of a table of item shingles that may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def words(text):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def spread(w, size: int):
    """Array of structs s0, s1, ... of each run of `size` elements of an array column."""
    n = F.size(w)
    return F.when(n >= size, F.arrays_zip(*[F.slice(w, F.lit(k + 1), n - (size - 1)).alias(f"s{k}") for k in range(size)]))


def shingle_rows(docs: DataFrame, size: int, hashed: bool) -> DataFrame:
    """doc_id, n (words), s: a row for each shingle, as s0, s1, ... words or their hashes. Words are made once a row."""
    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    if hashed:
        w = w.select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), "w").select("doc_id", "n", F.explode(spread(F.col("w"), size)).alias("s"))


def item_shingles(bench: DataFrame) -> DataFrame:
    """item_id, size (words of a shingle), shingle, m (shingles of the item), need, h: a row for each distinct shingle."""
    w = bench.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    rows = None
    for size in range(1, SHINGLE + 1):
        own = w.filter(F.size("w") == size if size < SHINGLE else F.size("w") >= size).select("item_id", F.lit(size).alias("size"), F.explode(spread(F.col("w"), size)).alias("s"))
        own = own.select("item_id", "size", F.concat_ws(" ", *[F.col(f"s.s{k}") for k in range(size)]).alias("shingle"))
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.distinct()
    m = rows.groupBy("item_id", "size").agg(F.count("*").alias("m"))
    parts = F.split("shingle", " ")
    h = F.coalesce(*[F.when(F.col("size") == s, F.xxhash64(*[F.xxhash64(parts[k]) for k in range(s)])) for s in range(1, SHINGLE + 1)])
    return rows.join(m.withColumnRenamed("item_id", "_item").withColumnRenamed("size", "_size"), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("size") == F.col("_size"))).select("item_id", "size", "shingle", "m", F.ceil(F.col("m") * NEED / OF).alias("need"), h.alias("h"))


def sketches(items: DataFrame) -> DataFrame:
    """size, h, least: the minimum hashes of all items, and the shingles that a document needs to hold at least."""
    from pyspark.sql import Window

    # a partition's items have 2^b to 2^(b+1) - 1 shingles; its depth serves the largest of them
    band = F.floor(F.log2("m"))
    most = F.pow(F.lit(2), band + 1) - 1
    depth = F.least(F.col("m"), (most - F.ceil(most * NEED / OF) + 1).cast("long"))
    by_hash = Window.partitionBy("item_id", "size").orderBy("h", "shingle")
    low = items.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= depth)
    return low.groupBy("size", "h").agg(F.min("need").alias("least"))


def contained(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, shared, shingles, containment of each pair with a containment of at least 0.8."""
    items, _ = common.write_table(item_shingles(bench), "items")
    sketch = sketches(items)
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # 1 to 5
    small = F.broadcast if items.count() <= BROADCAST_ROWS else (lambda df: df)
    own = docs.select("doc_id", "text")

    met = None
    for size in sizes:
        rows = shingle_rows(own, size, hashed=True)
        rows = rows.select("doc_id", (F.col("n") - (size - 1)).alias("n"), F.xxhash64(*[F.col(f"s.s{k}") for k in range(size)]).alias("h"))
        hit = rows.join(small(sketch.filter(F.col("size") == size)), "h").filter("n >= least").select("doc_id")
        met = hit if met is None else met.unionByName(hit)
    if met is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(bench.dtypes)['item_id']}, shared long, shingles long, containment double")
    met, _ = common.write_table(met.distinct(), "suspects")
    suspects = own.join(met.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")

    pairs = None
    for size in sizes:
        rows = shingle_rows(suspects, size, hashed=False).select("doc_id", F.concat_ws(" ", *[F.col(f"s.s{k}") for k in range(size)]).alias("shingle"))
        hit = rows.join(small(items.filter(F.col("size") == size)), "shingle").select("doc_id", "item_id", "shingle", "m", "need")
        pairs = hit if pairs is None else pairs.unionByName(hit)
    # one row for each shingle of a pair, then their number: no item's shingles meet in one place uncounted
    counted = pairs.distinct().groupBy("doc_id", "item_id", "m", "need").agg(F.count("*").alias("shared"))
    return counted.filter("shared >= need").select("doc_id", "item_id", "shared", F.col("m").alias("shingles"), (F.col("shared") / F.col("m")).alias("containment"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT item_id, least(5, len(w)) AS size, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) AS shingle FROM bw WHERE len(w) > 0),
bm AS (SELECT item_id, count(*) AS m FROM (SELECT DISTINCT item_id, size, shingle FROM bs) GROUP BY item_id),
sizes AS (SELECT DISTINCT size FROM bs),
ds AS (SELECT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS shingle FROM dw, sizes WHERE len(w) >= size),
hits AS (SELECT DISTINCT d.doc_id, b.item_id, b.size, b.shingle FROM ds d JOIN bs b ON d.size = b.size AND d.shingle = b.shingle)
SELECT doc_id, item_id, count(*) AS shared, m AS shingles, CAST(count(*) AS DOUBLE) / m AS containment
FROM hits JOIN bm USING (item_id) GROUP BY doc_id, item_id, m HAVING count(*) * 5 >= m * 4
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(common.read_docs(spark, sf_dir), common.read_docs(spark, sf_dir, "benchmark"))
