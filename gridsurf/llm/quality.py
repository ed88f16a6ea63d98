"""Quality of documents by a linear-chain conditional random field over lines (operator 3).

Every line (text between line feeds) is labelled good or bad from its own and
its neighbours' features; forward-backward gives each line's probability of
being good, and their mean, weighted by line length, is the document's evidence.
A two-number calibration learned with the model turns it into a score.

Lines have no labels of their own: in training they take their document's. The
model is fitted by gradient ascent on at most SAMPLE labelled documents and
common.SAMPLE_BYTES of text, those whose doc_id hashes lowest.

Cases: null and empty texts are one empty line and are scored like any other;
without labelled rows every score is 0.5, with labels of one kind alone it is that
label (0 or 1); rows with the same doc_id each keep a row; an empty table gives no
rows; columns other than doc_id and text (and labels(doc_id, quality) in training)
are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsurf.llm import common

SAMPLE = 4000
EPOCHS = 120
THRESHOLD = 0.3

_KIND = np.full(256, 4, np.uint8)  # 0 upper, 1 lower or non-ASCII, 2 digit, 3 plain punctuation, 4 symbol, 5 white space
_KIND[0x41:0x5B] = 0
_KIND[0x61:0x7B] = 1
_KIND[0x80:] = 1
_KIND[0x30:0x3A] = 2
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 3
_KIND[common.SPACE] = 5

OWN = 18
#: Own features, those of both neighbours, whether there is a neighbour before and after.
FEATURES = OWN * 3 + 2


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, lengths in bytes, and the text of each line."""
    raw, starts, ends = common.joined(texts, b"\n")
    stop = np.flatnonzero(raw == 10)
    begin = np.append(0, stop[:-1] + 1)
    doc = np.searchsorted(starts, begin, "right") - 1
    n, size = len(stop), stop - begin
    kind = _KIND[raw]
    counts = np.stack([np.add.reduceat((kind == k).astype(np.int32), begin) for k in range(6)], 1).astype(np.float64)
    counts[:, 5] -= 1  # the line feed itself
    length = np.maximum(size, 1.0)
    letters = counts[:, 0] + counts[:, 1]
    ws, we, _ = common.word_bounds(raw, np.array([0, len(raw)]))
    words = np.zeros(n)
    repeat, distinct, bare = np.zeros(n), np.zeros(n), np.zeros(n)
    line_hash = np.zeros(n, np.uint64)
    if len(ws):
        line = np.searchsorted(stop, ws)
        h = common.word_hashes(raw, ws, we)
        words = np.bincount(line, minlength=n).astype(np.float64)
        same = np.append(False, (h[1:] == h[:-1]) & (line[1:] == line[:-1]))
        repeat = np.bincount(line[same], minlength=n).astype(np.float64)
        _, first = np.unique(common.mix64(h ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
        distinct = np.bincount(line[first], minlength=n).astype(np.float64)
        letterless = np.add.reduceat((kind < 2).astype(np.int32), ws) == 0
        bare = np.bincount(line[letterless], minlength=n).astype(np.float64)
        np.add.at(line_hash, line, h)
    key = common.mix64(line_hash ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    copied = (times[inverse] > 1) & (words > 0)
    w = np.maximum(words, 1.0)
    upper, symbols, spread = counts[:, 0] / np.maximum(letters, 1.0), counts[:, 4] / length, distinct / w
    own = np.stack(
        [
            np.ones(n), np.log1p(size) / 5, upper, counts[:, 2] / length, symbols, counts[:, 3] / length,
            np.minimum(length / w / 10, 3.0), repeat / w, spread, copied, bare / w,
            upper > 0.6, symbols > 0.04, symbols > 0.12, (spread < 0.5) & (words > 3), bare / w > 0.2, words == 0, np.minimum(words, 40) / 40,
        ],
        1,
    ).astype(np.float64)
    x = np.zeros((n, FEATURES))
    x[:, :OWN] = own
    linked = np.append(False, doc[1:] == doc[:-1])
    x[1:, OWN : 2 * OWN] = own[:-1] * linked[1:, None]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:] * linked[1:, None]
    x[:, -2] = linked
    x[:-1, -1] = linked[1:]
    return x, size.astype(np.float64), doc


class Chain:
    """Lines of many texts side by side, longest text first, for steps along all chains at once."""

    def __init__(self, doc: np.ndarray, n: int):
        self.first = np.searchsorted(doc, np.arange(n))
        self.size = np.searchsorted(doc, np.arange(n), "right") - self.first
        self.order = np.argsort(-self.size, kind="stable")
        self.size, self.first = self.size[self.order], self.first[self.order]
        steps = int(self.size.max(initial=0))
        #: how many chains have a line t
        self.width = np.searchsorted(-self.size, -np.arange(steps), "left")
        self.steps = steps


def _pass(edge: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """log-odds of good at a line from those of the line before; edge[from, to], 1 is good."""
    return np.logaddexp(edge[1, 1] + odds, edge[0, 1]) - np.logaddexp(edge[1, 0] + odds, edge[0, 0])


def marginals(unary: np.ndarray, edge: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: log-odds of good, and the forward and backward parts that give pair probabilities."""
    ahead, back = unary.copy(), np.zeros_like(unary)
    for t in range(1, chain.steps):
        at = chain.first[: chain.width[t]] + t
        ahead[at] += _pass(edge, ahead[at - 1])
    for t in range(chain.steps - 1, 0, -1):
        at = chain.first[: chain.width[t]] + t
        back[at - 1] = _pass(edge.T, unary[at] + back[at])
    return ahead + back, ahead, back


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _pair(ahead: np.ndarray, ub: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Probabilities of label pairs of neighbouring lines: pairs x 2 x 2."""
    s = np.stack([np.stack([np.full_like(ahead, edge[0, 0]), edge[0, 1] + ub], 1), np.stack([ahead + edge[1, 0], ahead + edge[1, 1] + ub], 1)], 1)
    s -= s.max((1, 2))[:, None, None]
    p = np.exp(s)
    return p / p.sum((1, 2))[:, None, None]


def evidence(x, size, doc, n, weight, edge) -> np.ndarray:
    """Per text: the mean probability of good, weighted by line length."""
    good = sigmoid(marginals(x @ weight, edge, Chain(doc, n))[0])
    w = size + 1.0
    return np.bincount(doc, good * w, n) / np.bincount(doc, w, n)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, l2: float = 1e-4):
    """weight (features), edge (2 x 2), scale and shift of the calibration; None without both labels."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return None if not len(labels) else float(labels[0])
    n = len(texts)
    parts = [line_features(texts[s : s + 100]) for s in range(0, n, 100)]  # the features of bytes and words are larger than the lines'
    x, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    doc = np.concatenate([p[2] + 100 * k for k, p in enumerate(parts)])
    chain, y = Chain(doc, n), labels[doc]
    linked = np.flatnonzero(np.append(False, doc[1:] == doc[:-1]))
    # each text counts alike, however many its lines, and both labels alike
    per_doc = 1.0 / np.bincount(doc, minlength=n)
    per_doc *= np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / n
    w_line = per_doc[doc]
    weight, edge = np.zeros(FEATURES), np.zeros((2, 2))
    m1, m2 = [np.zeros(FEATURES), np.zeros((2, 2))], [np.zeros(FEATURES), np.zeros((2, 2))]
    seen = np.zeros((len(linked), 2, 2))
    same = y[linked].astype(int)
    seen[np.arange(len(linked)), same, same] = 1.0
    for step in range(1, epochs + 1):
        unary = x @ weight
        odds, ahead, back = marginals(unary, edge, chain)
        g_w = x.T @ (w_line * (y - sigmoid(odds))) - l2 * weight
        pair = _pair(ahead[linked - 1], unary[linked] + back[linked], edge)
        g_e = ((seen - pair) * w_line[linked][:, None, None]).sum(0) - l2 * edge
        for k, (param, g) in enumerate(((weight, g_w), (edge, g_e))):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            param += 0.1 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    e = _logit(evidence(x, size, doc, n, weight, edge))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps of a one-feature logistic fit
        p = sigmoid(a * e + b)
        r, v = labels - p, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * e * e).sum() + 1e-3, (v * e).sum()], [(v * e).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(h, [(r * e).sum() - 1e-3 * a, r.sum() - 1e-3 * b])
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -1, 1))
    return weight, edge, a, b


def score(texts: list[str | None], model) -> np.ndarray:
    if not isinstance(model, tuple):
        return np.full(len(texts), 0.5 if model is None else model)
    weight, edge, a, b = model
    x, size, doc = line_features(texts)
    return sigmoid(a * _logit(evidence(x, size, doc, len(texts), weight, edge)) + b)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A model from the labelled rows of docs(doc_id, text)."""
    marks = labels.filter("quality IS NOT NULL").select("doc_id", "quality").dropDuplicates(["doc_id"])
    marks = common.hash_sample(marks, "doc_id", sample)
    got = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").dropDuplicates(["doc_id"])
    got = common.within_bytes(got, "doc_id").orderBy("doc_id").toPandas()  # `sample` rows and SAMPLE_BYTES at most
    return fit(got.text.tolist(), got.quality.to_numpy())


def predict(docs: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score for each row of docs; with `keep` those columns in place of doc_id."""
    common.tune(docs.sparkSession)
    keep = keep or ["doc_id"]
    own = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in own.dtypes if n != "_text") + ", score double"
    names = [*keep, "score"]

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            text = b.column(len(keep))
            for a, z in common.slices(text):
                got = score(text.slice(a, z - a).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(a, z - a) for k in range(len(keep))), pa.array(got)], names)

    return own.mapInArrow(scan, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read_docs(spark, sf_dir), common.read_docs(spark, sf_dir, "labels")
    train = common.crc_fold(F.col("doc_id"), 5) != 0
    model = learn(docs.filter(train), labels.filter(train))
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", (~train).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
