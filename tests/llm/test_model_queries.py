"""Queries 2, 3, 7 and 9 against plain versions, on long texts, clashing columns and repeated rows."""

from __future__ import annotations

import itertools

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridsurf.llm import common, language, pieces, quality, substring, suffix_dedup, toxicity
from tests.llm.conftest import SCHEMA, prose

SF = "/root/testdata/sf0.1"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def long_rows(spark):
    """A text longer than a slice and a batch, twice; clashing columns; odd rows."""
    rng = np.random.default_rng(8)
    long = "\n".join(prose(rng, 60, lines=False) for _ in range(6500))
    assert len(long) > common.ARROW_BYTES >= 2 << 20
    rows = [(1, long, "en", "s", 0), (2, "a short text", "en", "s", 0), (2, "a short text", "en", "s", 0), (3, long, "de", "s", 0), (4, None, None, None, None), (None, "", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["score", "predicted", "held_out", "lang_pred", "kind", "_text", "_total", "toxic", "quality", "uid", "copies", "k", "rank", "near", "far", "shard"]
    return rows, df.select("*", *(F.lit("z").alias(c) for c in names))


def test_models_score_whole_texts(spark, long_rows):
    rows, df = long_rows
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for module, scored, model in (
        (quality, lambda m, t: quality.score([t], m)[0], quality.learn(df, labels)),
        (toxicity, lambda m, t: toxicity.score([t], m)[0], toxicity.learn(df, labels)),
    ):
        got = sorted((r.doc_id or 0, r.score) for r in module.predict(df, model).collect())
        want = sorted((k or 0, scored(model, t)) for k, t, *_ in rows)
        assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    model = language.learn(df)
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in language.predict(df, model).collect())
    want = []
    for k, t, *_ in rows:
        p, s = language.infer([t], model[1])
        want.append((k or 0, model[0][p[0]] if p[0] >= 0 else "und", s[0]))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)])


def test_repeats_of_long_texts(long_rows):
    rows, df = long_rows
    one = {k or 0: t for k, t, *_ in rows}
    got = {r.doc_id or 0: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_passages(df).collect()}
    assert got == substring.brute(list(one.items()))
    size = {k: len((t or "").encode()) for k, t in one.items()}
    gone = {r.doc_id or 0: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()}
    assert gone == {0: 0, 1: size[1], 2: 0, 3: size[3], 4: 0}
    kept = {r.doc_id: (r.spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, texts=True).collect()}
    assert [tuple(s) for s in kept[1][0]] == [(0, size[1])] and kept[1][1] == b"" and kept[2] == ([], b"a short text")


def plain_mixture(like: np.ndarray, allowed: list[int], rounds: int) -> tuple[np.ndarray, float]:
    """Shares of the allowed languages and the log-likelihood of one text's segments, step by step."""
    share = {k: 1 / len(allowed) for k in allowed}
    for _ in range(rounds):
        new = dict.fromkeys(allowed, 0.0)
        for row in like:
            p = {k: share[k] * np.exp(row[k] - row.max()) for k in allowed}
            for k in allowed:
                new[k] += p[k] / sum(p.values()) / len(like)
        share = new
    total = sum(np.log(sum(share[k] * np.exp(row[k] - row.max()) for k in allowed)) + row.max() for row in like)
    return np.array([share.get(k, 0.0) for k in range(like.shape[1])]), total


def test_language_sets_are_chosen_by_penalised_likelihood():
    rng = np.random.default_rng(3)
    words = [["la", "les", "une", "dans"], ["the", "of", "and", "that"], ["der", "die", "und", "nicht"], ["el", "los", "una", "pero"]]
    make = lambda k, n: " ".join(rng.choice(words[k], n))
    names, table = language.fit([make(k, 400) for k in range(4)], ["a", "b", "c", "d"])
    texts = [make(0, 40), make(1, 60) + " " + make(2, 30), make(3, 20) + " " + make(0, 50) + " " + make(2, 40), make(2, 3), make(0, 200) + " " + make(1, 4)]
    pred, score = language.infer(texts, table)
    for i, t in enumerate(texts):
        bucket, word, _ = language.grams([t])
        like = np.zeros((int(word.max()) // language.SEGMENT + 1, 4))
        np.add.at(like, word // language.SEGMENT, table[bucket])
        whole, _ = plain_mixture(like, [0, 1, 2, 3], language.ROUNDS)
        order = np.argsort(-whole, kind="stable")
        best = None
        for m in range(1, 5):
            share, total = plain_mixture(like, sorted(order[:m]), language.ROUNDS)
            share = np.where(np.isin(np.arange(4), order[:m]), share if m > 1 else whole, 0.0)
            value = total - (m - 1) * language.PRICE * np.log(len(like) + 2.0)
            if best is None or value > best[0]:
                best = (value, share)
        assert pred[i] == best[1].argmax() and abs(score[i] - best[1].max()) < 1e-6


def test_toxic_texts_are_found_in_the_held_out_part(spark):
    df = toxicity.op7_toxicity(spark, SF).join(common.read_docs(spark, SF, "labels"), "doc_id").toPandas()
    held = df[df.held_out & df.toxic.notna()]
    yes, no = held[held.toxic == 1], held[held.toxic == 0]
    order = held.score.rank()
    area = (order[held.toxic == 1].sum() - len(yes) * (len(yes) + 1) / 2) / (len(yes) * len(no))
    assert len(yes) > 100 and (yes.predicted == 1).mean() >= 0.8 and (held[held.predicted == 1].toxic == 1).mean() >= 0.85 and area >= 0.88


def segmentations(voc: pieces.Vocabulary, raw: bytes):
    """Every way to cut raw into pieces, as piece ids; characters without a piece fall to bytes."""
    by_bytes = {b: i for i, b in enumerate(voc.bytes) if b and i not in set(voc.byte_id.tolist())}
    if not raw:
        yield ()
        return
    for n in range(1, len(raw) + 1):
        if raw[:n] in by_bytes:
            for rest in segmentations(voc, raw[n:]):
                yield (by_bytes[raw[:n]], *rest)


def test_inclusion_and_order_match_enumeration():
    """The first draw follows the segmentations' weights; all of them come out where more are asked for than there are."""
    voc = pieces.vocabulary(MODEL)
    ways = list(segmentations(voc, b" abc"))
    weight = np.exp([sum(voc.log[i] for i in w) for w in ways])
    chance = dict(zip(ways, weight / weight.sum(), strict=True))
    n = 4000
    got = pieces.sample(voc, ["abc"] * n, np.arange(n), len(ways))
    first = {}
    for draws in got:
        assert {tuple(d[0].tolist()) for d in draws} == set(ways) and [d[2] for d in draws] == sorted((d[2] for d in draws), reverse=True)
        for ids, log, _, _ in draws:
            assert abs(np.exp(log) - chance[tuple(ids.tolist())]) < 1e-9
        key = tuple(draws[0][0].tolist())
        first[key] = first.get(key, 0) + 1
    assert all(abs(first.get(w, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3 for w, p in chance.items())


def test_long_words_are_one_lattice():
    """An unspaced text: log-probabilities are those of the whole word's lattice, summed step by step."""
    voc = pieces.vocabulary(MODEL)
    for text in ("日本語の文章はとても長い" * 60, "x" * 3000, "abcdefghij" * 7000):
        (draws,) = pieces.sample(voc, [text], [7], 2)
        raw = pieces.normal(text)
        assert all(voc.decode(d[0]) == raw for d in draws) and len({tuple(d[0].tolist()) for d in draws}) == len(draws) == (1 if text[0] == "日" else 2)
        if len(raw) > 5000:
            continue
        lattice = pieces.Lattice(voc, np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
        total = np.full(len(raw) + 1, -np.inf)
        total[-1] = 0.0
        for at in range(len(raw) - 1, -1, -1):
            edges = range(lattice.first[at], lattice.first[at] + lattice.count[at])
            values = [voc.log[lattice.id[e]] + total[at + lattice.size[e]] for e in edges]
            total[at] = np.logaddexp.reduce(values) if values else -np.inf
        for ids, log, _, _ in draws:
            assert abs(log - min(0.0, voc.log[ids].sum() - total[0])) < 1e-6


def test_segmentations_are_enumerated_without_loss():
    voc = pieces.vocabulary(MODEL)
    raw = b" the"
    ways = set(segmentations(voc, raw))
    pieces_of = [b for b in voc.bytes if b]
    some = {w for n in range(1, 5) for w in itertools.product([i for i, b in enumerate(voc.bytes) if b and b in raw and i not in set(voc.byte_id.tolist())], repeat=n) if b"".join(voc.bytes[i] for i in w) == raw}
    assert pieces_of and {tuple(voc.bytes[i] for i in w) for w in some} == {tuple(voc.bytes[i] for i in w) for w in ways}


def test_edges_of_one_distance_lie_together_and_draws_stay():
    import zlib

    import pyarrow.parquet as pq

    voc = pieces.vocabulary(MODEL)
    raw = np.frombuffer(" the catégories 日本".encode(), np.uint8)
    cut = np.array([0, 4, len(raw) - 7, len(raw)])
    lattice = pieces.Lattice(voc, raw, cut[:-1], cut[1:])
    left = np.repeat(cut[1:], np.diff(cut)) - np.arange(len(raw))
    own = np.flatnonzero(lattice.count)
    order = own[np.argsort(lattice.first[own])]
    assert (np.diff(left[order]) >= 0).all() and (lattice.first[order] == np.cumsum(lattice.count[order]) - lattice.count[order]).all()
    # the draws are those of the code that kept edges in order of place and padded rows of chances
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60] + [None, "", "a", "日本" * 40]
    draws = pieces.sample(voc, texts, np.arange(len(texts)))
    assert zlib.crc32(b"".join(d[0].astype("<u4").tobytes() for t in draws for d in t)) == 2044862680
