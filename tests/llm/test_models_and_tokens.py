"""Operators 2, 3, 5, 7, 8 and 9: round trips, held-out accuracy, brute force."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridsurf.llm import common, decontaminate, language, pieces, quality, token_files, toxicity

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- 2 -------------------------------------------------------------------------


def test_pieces_round_trip_and_are_distinct(docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = pieces.encode_samples(docs.withColumn("ids", F.lit(1)), MODEL, k=3).collect()
    by: dict = {}
    for r in rows:
        assert r.round_trip and r.n_pieces == len(r.ids) and 0 <= r.inclusion <= 1 and r.log_prob <= 0
        assert sp.decode(list(r.ids)) == (texts[r.doc_id] or "").replace("▁", " ")
        by.setdefault(r.doc_id, []).append(tuple(r.ids))
    assert set(by) == set(texts) and all(len(set(v)) == len(v) for v in by.values())
    assert len(by[304]) == 3 and len(by[401]) == 1
    again = {(r.doc_id, r.draw): tuple(r.ids) for r in pieces.encode_samples(docs.repartition(7), MODEL, k=3).collect()}
    assert again == {(r.doc_id, r.draw): tuple(r.ids) for r in rows}  # seeded by the key alone


def test_draws_follow_the_lattice():
    voc = pieces.vocabulary(MODEL)
    n = 3000
    got = pieces.sample(voc, ["the ab"] * n, np.arange(n), 3)
    logs = {tuple(s[0]): s[1] for d in got for s in d}
    assert sum(np.exp(v) for v in logs.values()) > 0.999
    first = Counter(tuple(d[0][0]) for d in got)
    for s, c in first.most_common(4):
        p = np.exp(logs[s])
        assert abs(c / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
    # the inclusion scores weigh the drawn ones back to all
    assert abs(np.mean([sum(np.exp(s[1]) / s[3] for s in d) for d in got]) - 1) < 0.02
    assert all(a[2] >= b[2] for d in got for a, b in zip(d, d[1:]))


def test_pieces_decode_and_edges(spark, odd, empty, docs, texts):
    out = pieces.decode_rows(pieces.encode_samples(docs, MODEL, k=1), MODEL)
    assert {r.doc_id: r.text for r in out.collect()} == {k: (t or "").replace("▁", " ") for k, t in texts.items()}
    assert pieces.encode_samples(empty, MODEL).count() == 0
    assert len({(r.doc_id, r.draw, r.ids_crc32) for r in pieces.encode_samples(odd, MODEL, k=2).collect() if r.doc_id == 3}) == 2


# --- 3 -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scored(spark):
    return quality.op3_quality(spark, SF).join(common.read_docs(spark, SF, "labels"), "doc_id", "left").toPandas()


def test_quality_is_learned(scored):
    held = scored[scored.held_out & scored.quality.notna()]
    assert ((held.predicted == held.quality).mean() > 0.93) and len(scored) == 1000
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(scored.doc_id, scored.held_out, strict=True))


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(5)
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    u, edge = rng.normal(size=7), rng.normal(size=(2, 2))
    got = quality.sigmoid(quality.marginals(u, edge, quality.Chain(doc, 3))[0])
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total, good = 0.0, np.zeros(len(at))
        for m in range(1 << len(at)):
            y = np.array([m >> i & 1 for i in range(len(at))])
            w = np.exp((u[at] * y).sum() + sum(edge[a, b] for a, b in zip(y, y[1:])))
            total, good = total + w, good + w * y
        assert np.allclose(got[at], good / total)


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    model = quality.learn(odd, labels)
    rows = quality.predict(odd, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert quality.predict(empty, model).count() == 0
    none = quality.learn(odd, labels.filter("false"))
    assert {r.score for r in quality.predict(odd, none).collect()} == {0.5}
    assert quality.fit(["a", "b"], np.array([1, 1])) == 1.0


# --- 5 -------------------------------------------------------------------------


def words(t):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


def grams(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_containment_matches_brute_force(spark, texts):
    items = {1: " ".join(words(texts[304])[500:540]), 2: " ".join(words(texts[304])[900:930] + ["new", "words"] * 3), 3: "ho ho", 4: "one two", 5: None, 6: "", 7: texts[6], 8: "Absent words of no document at all here", 9: "日本語"}
    rows = [(k, t, "clash") for k, t in [*texts.items(), (304, "ho ho ho")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {}
    for i, t in items.items():
        w = words(t)
        if not w:
            continue
        q = grams(w, min(5, len(w)))
        for k in texts:
            x = set().union(*(grams(words(r[1]), min(5, len(w))) for r in rows if r[0] == k))
            if len(q & x) * 5 >= len(q) * 4:
                want[k, i] = (len(q & x), len(q))
    got = {(r.doc_id, r.item_id): (r.shared, r.shingles) for r in decontaminate.contained(docs, bench).collect()}
    assert got == want and (304, 1) in got


def test_containment_edges(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (None, "other words")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained(odd, bench).collect()} == {(3, 1), (None, None)}
    assert decontaminate.contained(empty, bench).count() == 0
    assert decontaminate.contained(odd, bench.filter("false")).count() == 0


# --- 7 -------------------------------------------------------------------------


def test_toxicity_is_learned_from_positives_and_unlabelled_text():
    rng = np.random.default_rng(6)
    from tests.llm.conftest import prose

    bad = ["idiotic", "wretched", "scummy"]

    def toxic():
        w = prose(rng, 80).split()
        for i in rng.choice(80, 5, replace=False):
            w[i] = bad[rng.integers(0, 3)]
        return " ".join(w)

    positive = [toxic() for _ in range(150)]
    plain = [prose(rng, 80) if rng.random() > 0.2 else toxic() for _ in range(600)]
    model = toxicity.fit(positive, plain, 0.2)
    good, evil = [prose(rng, 80) for _ in range(200)], [toxic() for _ in range(200)]
    assert (toxicity.score(good, model) < 0.7).mean() > 0.97 and (toxicity.score(evil, model) >= 0.7).mean() > 0.97


def test_toxicity_of_a_small_language_is_learned():
    rng = np.random.default_rng(8)
    from tests.llm.conftest import prose

    def text(small, toxic):
        w = prose(rng, 80).split()
        if small:
            w = [x[::-1] + "o" for x in w]
        for i in rng.choice(80, 5, replace=False) if toxic else []:
            w[i] = (["bomente", "bocodra"] if small else ["idiotic", "wretched", "scummy"])[rng.integers(0, 2 + (not small))]
        return " ".join(w)

    # 8 of 300 toxic texts: under 3 in a hundred
    positive = [text(k < 8, True) for k in range(300)]
    plain = [text(rng.random() < 8 / 300, rng.random() < 0.1) for _ in range(2000)]
    model = toxicity.fit(positive, plain, 0.1)
    for small in (True, False):
        evil, good = ([text(small, t) for _ in range(100)] for t in (True, False))
        assert (toxicity.score(evil, model) >= 0.7).mean() > 0.8, small
        assert (toxicity.score(good, model) < 0.7).mean() > 0.95, small


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    rows = toxicity.predict(odd, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.predict(empty, model).count() == 0
    assert toxicity.learn(odd, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.predict(odd, None).collect()} == {0.0}


# --- 8 -------------------------------------------------------------------------


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = "file://" + str(tmp_path / "tokens")
    token_files.write_token_files(docs.withColumn("part", F.lit("x")), out, public_tokenizers.path("byte_bpe_50k.json"), 2, n_files=3)
    got = {r.doc_id: r for r in token_files.checksums(token_files.read_token_files(spark, out)).collect()}
    start = 0
    for k in sorted(texts):
        ids = [*tok.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        r = got[k]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    seen = []
    for f in files:
        p = pq.ParquetFile(f)
        for g in range(p.metadata.num_row_groups):
            cols = {p.metadata.row_group(g).column(c).path_in_schema: p.metadata.row_group(g).column(c) for c in range(5)}
            assert all(c.has_offset_index and c.has_column_index for c in cols.values())
            assert any("DICTIONARY" in e for e in cols["ids.list.element"].encodings)
            assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings
        seen += p.read(["doc_id"])["doc_id"].to_pylist()
    assert seen == sorted(texts)


def test_token_file_edges(spark, odd, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    clash = odd.select("*", *(F.lit("z").alias(c) for c in ("part", "first", "n_tokens", "ids", "size", "base")))
    for name, df, n in (("odd", clash, 6), ("empty", empty, 0)):
        token_files.write_token_files(df, f"file://{tmp_path}/{name}", path, 2)
        rows = token_files.checksums(token_files.read_token_files(spark, f"file://{tmp_path}/{name}")).collect()
        assert len(rows) == n
        start = 0
        for r in sorted(rows, key=lambda r: r.start):  # one after the other, empty texts as the end id alone
            assert r.start == start and (r.doc_id in (3, None) or (r.n_tokens, r.ids_crc32) == (1, zlib.crc32(b"\2\0\0\0")))
            start += r.n_tokens


@pytest.mark.parametrize("cache", [1 << 20, 10])
def test_chunks_have_the_ids_of_whole_texts(cache):
    """Also where the memory of chunks is full, and in texts that cannot be cut."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = token_files.WordEncoder(path, cache), Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    parts = ["a", "b", " ", "  ", "\n", " ", "é", "É.", "'s", "'", "1", ".", "\t", "\u00a0", "\u2003", "中", "»", "\0", "can't", "\u3000", "\x85", "\x1c", "<|endoftext|>", "(x)"]
    odd = [["a b c d e f"], ["g h i j k l m n", "a  b", "<|endoftext|>x \n y", " lead", "trail ", "  x\t y", "", None], ["w" * 70_000 + " x", "long " * 40_000]]
    for t in [*odd, *(["".join(rng.choice(parts, rng.integers(0, 16))) for _ in range(4)] for _ in range(400))]:
        ids, n = enc.encode(pa.array(t, pa.string()))
        want = [e.ids for e in tok.encode_batch([x or "" for x in t], add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, []), t


# --- 9 -------------------------------------------------------------------------


def test_language_is_learned(spark):
    df = language.op9_language(spark, SF).join(common.read_docs(spark, SF).select("doc_id", "lang"), "doc_id").toPandas()
    held = df[df.held_out & df.lang.notna()]
    assert len(df) == 1000 and (held.lang_pred == held.lang).mean() > 0.97
    assert df.score.between(0, 1).all()


def test_mixed_texts_have_shares(spark):
    d = common.read_docs(spark, SF).filter("lang IN ('en', 'de')").toPandas()
    names, table = language.fit(d.text.tolist()[:300], d.lang.tolist()[:300])
    en, de = (" ".join(" ".join(d[d.lang == k].text.tolist()[300 if k == "en" else 60 :]).split()[:600]) for k in ("en", "de"))
    pred, score = language.infer([en, de, en + " " + de[: len(en) // 3]], table)
    assert [names[p] for p in pred] == ["en", "de", "en"] and score[0] > 0.95 and 0.6 < score[2] < 0.9


def test_language_edges(spark, odd, empty):
    model = language.learn(odd)
    got = [(r.doc_id, r.lang_pred) for r in language.predict(odd, model).collect()]
    assert sorted(got, key=str) == sorted([(None, "und"), (1, "und"), (2, "und"), (3, "en"), (3, "en"), (None, "en")], key=str)
    assert language.predict(empty, model).count() == 0 and language.learn(empty)[0] == []
    blank = spark.createDataFrame([(1, "12 34 !!"), (2, "日本")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(blank, model).collect()} == {1: "und", 2: "en"}
    assert {r.lang_pred for r in language.predict(blank, language.learn(empty)).collect()} == {"und"}


def test_the_query_draws_three_segmentations(spark, tmp_path):
    own = {1: "a text of some words", 2: "and another one, longer than the first", 3: ""}
    spark.createDataFrame([(k, t) for k, t in own.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = pieces.op2_pieces(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.draw) for r in rows) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1)]
    assert len({r.ids_crc32 for r in rows}) == 7 and all(r.round_trip for r in rows)
