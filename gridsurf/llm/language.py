"""Language identification by multilingual mixture inference (operator 9).

A model holds the likelihood of byte 4-grams (hashed into 65,536 buckets) for
each language value met in the training rows, of which about SAMPLE texts for
each language and at most common.SAMPLE_BYTES of text are read. A text is cut into segments of SEGMENT words; an
expectation-maximisation over its segments estimates the share of each language
in it. Language sets of growing size, in order of share, compete by penalised
likelihood; the largest share in the set chosen gives lang_pred, its value the
score.

Cases: null texts and texts without a letter give `und` with score 0, as do all
texts where nothing could be learned; ties go to the first language in
alphabetical order; rows with the same doc_id each keep a row; an empty table
gives no rows; columns other than doc_id, text and lang (training rows only)
are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsurf.llm import common

SAMPLE = 1500
BUCKETS = 1 << 16
SEGMENT = 4
ROUNDS = 12
#: Price, in nats, of each language of a set after the first, times the logarithm of the segments.
PRICE = 3.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each letter byte: the 4-gram bucket that it ends, its word number (over all texts); and of each word the text."""
    raw, starts, _ = common.joined(texts, b"    ")
    b = _FOLD[raw]
    inside = b != 32
    wide = b.astype(np.uint32)
    code = wide.copy()
    for k in (1, 2, 3):
        code[k:] |= wide[:-k] << np.uint32(8 * k)
    at = np.flatnonzero(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    word_at = np.flatnonzero(first)
    word = np.cumsum(first)[at] - 1
    bucket = (code[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return bucket.astype(np.int64), word, np.searchsorted(starts, word_at, "right") - 1


def fit(texts: list[str], langs: list[str], smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Language values in order and the log-likelihood of each bucket in each: BUCKETS x languages."""
    names = sorted(set(langs))
    table = np.zeros((BUCKETS, len(names)))
    for k, name in enumerate(names):
        own = [t for t, x in zip(texts, langs, strict=True) if x == name]
        for s in range(0, len(own), 200):
            table[:, k] += np.bincount(grams(own[s : s + 200])[0], minlength=BUCKETS)
    return names, np.log((table + smooth) / (table.sum(0) + smooth * BUCKETS)).astype(np.float32)


def _em(like: np.ndarray, doc: np.ndarray, n: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (texts x languages) and log-likelihood of each text's mixture over the allowed languages."""
    like = np.where(allowed[doc], like, -np.inf)
    top = like.max(1)
    p = np.exp(like - top[:, None])
    share = allowed / allowed.sum(1)[:, None]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    own = doc[first]
    count = np.bincount(doc, minlength=n)
    for _ in range(ROUNDS):
        r = p * share[doc]
        r /= np.maximum(r.sum(1), 1e-300)[:, None]
        share[own] = np.add.reduceat(r, first, axis=0) / count[own][:, None]
    total = np.zeros(n)
    total[own] = np.add.reduceat(top + np.log(np.maximum((p * share[doc]).sum(1), 1e-300)), first)
    return share, total


def infer(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the language's number (-1: none) and its share."""
    n, k = len(texts), table.shape[1]
    pred, score = np.full(n, -1), np.zeros(n)
    bucket, word, word_doc = grams(texts)
    if not k or not len(bucket):
        return pred, score
    # segments: runs of SEGMENT words of one text
    doc_first = np.searchsorted(word_doc, np.arange(n))
    part = (np.arange(len(word_doc)) - doc_first[word_doc]) // SEGMENT
    new = np.append(True, (np.diff(part) != 0) | (np.diff(word_doc) != 0))
    seg_of_word = np.cumsum(new) - 1
    doc = word_doc[new]
    seg = seg_of_word[word]
    like = np.add.reduceat(table[bucket], np.flatnonzero(np.diff(seg, prepend=-1)), axis=0).astype(np.float64)
    everything = np.ones((n, k), bool)
    share, full = _em(like, doc, n, everything)
    rank = np.argsort(-share, axis=1, kind="stable")
    place = np.argsort(rank, axis=1, kind="stable")
    segments = np.bincount(doc, minlength=n)
    price = PRICE * np.log(segments + 2.0)
    best, value = share, np.full(n, -np.inf)
    for m in range(1, k + 1):
        if m == 1:
            got, ll = np.where(place < 1, share, 0.0), np.zeros(n)
            np.add.at(ll, doc, like[np.arange(len(doc)), rank[doc, 0]])
        elif m < k:
            got, ll = _em(like, doc, n, place < m)
        else:
            got, ll = share, full
        gain = ll - (m - 1) * price > value
        best = np.where(gain[:, None], got, best)
        value = np.where(gain, ll - (m - 1) * price, value)
    for i, t in enumerate(texts):
        if segments[i] and common.has_letter(t):
            pred[i] = int(best[i].argmax())
            score[i] = min(1.0, max(0.0, float(best[i, pred[i]])))
    return pred, score


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The model from docs(doc_id, text, lang): about `sample` hashed texts of each language value."""
    have = docs.filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r.lang: r["count"] for r in have.groupBy("lang").count().collect()}  # a row for each language value
    if not counts:
        return [], np.zeros((BUCKETS, 0), np.float32)
    chance = F.lit(1.0)
    for name, n in counts.items():
        chance = F.when(F.col("lang") == name, F.lit(sample / n)).otherwise(chance)
    got = have.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < chance * 1_000_000).select("doc_id", "text", "lang")
    got = common.within_bytes(got, "doc_id").toPandas()
    return fit(got.text.tolist(), got.lang.tolist())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""
    common.tune(docs.sparkSession)
    names, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS floats for each language

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            for a, z in common.slices(b.column(1)):
                pred, score = infer(b.column(1).slice(a, z - a).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array([names[p] if p >= 0 else "und" for p in pred], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_docs(spark, sf_dir)
    held = common.crc_fold(F.col("doc_id"), 3) == 1
    return predict(docs, learn(docs.filter(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")
