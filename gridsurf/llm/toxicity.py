"""Toxicity by non-negative positive-unlabelled learning (operator 7).

A linear classifier over hashed words is trained in numpy from confirmed toxic
texts and unlabelled text with the class-prior-corrected risk
    prior * R(positive, +) + max(0, R(unlabelled, -) - prior * R(positive, -)),
logistic loss; where the second part falls below zero its gradient is reversed.
Negative labels are never used: rows marked 0 count as unlabelled text; the
labels give the class prior alone. Training reads at most SAMPLE toxic and
SAMPLE unlabelled texts, those whose doc_id hashes lowest, and common.SAMPLE_BYTES of text.

Cases: null, empty and wordless texts score by the intercept; without toxic
training rows every score is the prior (0); rows with the same doc_id each keep
a row; an empty table gives no rows; columns other than doc_id and text (and
labels(doc_id, toxic) in training) are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsurf.llm import common

SAMPLE = 3000
BITS = 20
EPOCHS = 400
THRESHOLD = 0.7
#: Toxic training texts a word must stand in to be a feature: a count, as a share would shut out small languages.
LEAST = 3
#: and how many times its share in unlabelled text; language alone gives less.
LIFT = 2.5

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word: letters and digits, A-Z folded."""
    raw, starts, _ = common.joined(texts, b" ")
    b = _FOLD[raw]
    ws, we, _ = common.word_bounds(b, np.array([0, len(b)]))
    if not len(ws):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return (common.word_hashes(b, ws, we) >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(starts, ws, "right") - 1


def features(texts: list[str | None], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct known words of each text: text and slot."""
    bucket, doc = words(texts)
    s = slot[bucket]
    key = np.unique(doc[s >= 0] << BITS | s[s >= 0])
    return key >> BITS, key & ((1 << BITS) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit(positive: list[str | None], unlabelled: list[str | None], prior: float, epochs: int = EPOCHS, l2: float = 3e-3):
    """slot of each bucket, weights and intercept."""
    if not positive or not unlabelled or prior <= 0:
        return None
    prior = min(prior, 0.95)
    n_p, n_u = len(positive), len(unlabelled)
    texts = [*positive, *unlabelled]
    parts = [words(texts[s : s + 200]) for s in range(0, len(texts), 200)]
    bucket = np.concatenate([p[0] for p in parts])
    doc = np.concatenate([p[1] + 200 * k for k, p in enumerate(parts)])
    key = np.unique(doc << BITS | bucket)
    held = np.bincount(key[key >> BITS < n_p] & ((1 << BITS) - 1), minlength=1 << BITS)
    others = np.bincount(key[key >> BITS >= n_p] & ((1 << BITS) - 1), minlength=1 << BITS)
    # words of several toxic texts whose share there exceeds that in unlabelled text; l2 holds chance ones down
    rate = n_p / n_u
    chosen = np.flatnonzero((held >= LEAST) & (held > LIFT * rate * others))
    slot = np.full(1 << BITS, -1, np.int64)
    slot[chosen] = np.arange(len(chosen))
    f = [features(texts[s : s + 200], slot) for s in range(0, len(texts), 200)]
    row = np.concatenate([x[0] + 200 * k for k, x in enumerate(f)])
    col = np.concatenate([x[1] for x in f])
    # rare words weigh more: what stands in most texts says little of a few
    rare = np.log((n_u + 1.0) / (others[chosen] + 1.0)) + 1e-3
    val = rare[col]
    w, b = np.zeros(len(chosen)), 0.0
    m1, m2, mean = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, epochs + 1):
        z = np.bincount(row, w[col] * val, n_p + n_u) + b
        p = sigmoid(z)
        zp, zu = z[:n_p], z[n_p:]
        gap = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = np.zeros(n_p + n_u)  # of the risk with respect to z
        rest = np.concatenate([-prior * p[:n_p] / n_p, p[n_p:] / n_u])
        if gap >= 0:
            g = rest
            g[:n_p] += prior * (p[:n_p] - 1) / n_p
        else:
            g = -rest
        grad = np.append(np.bincount(col, g[row] * val, len(chosen)) + l2 * w, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        move = 0.1 / (1 + step / 30) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if step > epochs // 2:  # the reversed gradient swings about the bound; the mean settles
            mean += np.append(w, b) / (epochs - epochs // 2)
    return slot, mean[:-1] * rare, float(mean[-1])


def score(texts: list[str | None], model) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    slot, w, b = model
    row, col = features(texts, slot)
    return sigmoid(np.bincount(row, w[col], len(texts)) + b)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A model from docs(doc_id, text) and the labels that they may use."""
    marks = labels.filter("toxic IS NOT NULL").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    prior = marks.agg(F.avg("toxic")).first()[0]
    if not prior:
        return None
    toxic = common.hash_sample(marks.filter("toxic = 1"), "doc_id", sample)
    # unlabelled text is drawn from all rows, toxic ones among them, as the prior says
    plain = common.hash_sample(docs.select("doc_id").distinct(), "doc_id", sample)
    wanted = toxic.select("doc_id", F.lit(1).alias("kind")).unionByName(plain.select("doc_id", F.lit(0).alias("kind")))
    got = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id", "kind"])
    got = common.within_bytes(got, "doc_id").orderBy("doc_id").toPandas()  # 2 x `sample` rows and SAMPLE_BYTES at most
    return fit(got.text[got.kind == 1].tolist(), got.text[got.kind == 0].tolist(), float(prior))


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, score for each row of docs."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS slots and the weights

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            for a, z in common.slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(score(b.column(1).slice(a, z - a).to_pylist(), shared.value))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read_docs(spark, sf_dir), common.read_docs(spark, sf_dir, "labels")
    held = common.crc_fold(F.col("doc_id"), 3) == 1
    out = predict(docs, learn(docs.filter(~held), labels.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
