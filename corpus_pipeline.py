"""A training corpus from `documents`: quality, near-duplicates, repeated passages, benchmark leaks, piece ids.

Counted as part of gridsurf.llm. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame; run() writes each stage's result as Parquet in the shared folder and reads it
back as the next one's docs. All stages but the last return the columns of documents.

Rows that are equal in all columns are equal in their fate: both go or both stay, but
where one of a group of copies stays, one of them does. A null doc_id is a document of its
own to the quality, passage and piece stages; the near-duplicate stage keeps of a
component one row, that of the smallest doc_id (null after all others; of rows that share it the one whose
columns hash lowest); benchmark leaks are removed by doc_id, null included. Extra columns of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsurf.llm import common, decontaminate, near, pieces, quality, substring

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score below its threshold go. Learns from the labelled rows of its training part."""
    labels = common.read_docs(spark, sf_dir, "labels")
    train = common.crc_fold(F.col("doc_id"), 5) != 0
    model = quality.learn(docs.filter(train), labels.filter(train))
    scored = quality.predict(docs.select(*COLUMNS), model, keep=COLUMNS)
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4's links and, for near copies that it does not reach, shared minimum hashes, all verified (five-word shingles, similarity 0.8): of each component one document stays, that of the smallest doc_id."""
    row = F.xxhash64(*COLUMNS)
    stay = near.near_copies(docs, row, hashed=True).filter("leads").select("own").distinct()
    kept = docs.select(*COLUMNS, row.alias("_own")).join(stay.withColumnRenamed("own", "_own"), "_own", "left_semi")
    # rows equal in all columns: one of them stays
    return kept.groupBy("_own").agg(*(F.first(c).alias(c) for c in COLUMNS)).select(*COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: repeated words go; a document of which none are left goes, one that lost none stays as it is."""
    own = docs.select(F.expr("xxhash64(CAST(doc_id AS LONG), coalesce(text, ''))").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("text").alias("was"), "lang", "source", "n_chars")
    cut = substring.remove(own, ["doc_id", "was", "lang", "source", "n_chars"], texts=True)
    cut = cut.filter("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("was"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    found = decontaminate.contained(docs, common.read_docs(spark, sf_dir, "benchmark"))
    leaks = found.select(F.col("doc_id").alias("_leak")).distinct()
    return docs.select(*COLUMNS).join(leaks, F.col("doc_id").eqNullSafe(F.col("_leak")), "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the sampled segmentations of every document, with their piece ids."""
    import public_tokenizers

    return pieces.encode_samples(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_passages),
    ("decontamination", drop_leaks),
    ("pieces", encode_pieces),
]

#: The first stage's model and the last one's draws have no SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_docs(spark, sf_dir)
    before = set(common.written())
    for name, stage in STAGES:
        docs, path = common.write_table(stage(spark, docs, sf_dir), f"stage-{name}")
        for done in set(common.written()) - before - {path}:  # what the stage has written, and its input
            common.drop_table(spark, done)
        common.free(spark)
    return docs
