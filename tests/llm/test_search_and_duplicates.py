"""Operators 1, 4, 6 and 10 against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsurf.llm import ann, graph, repeats, simhash, substring, suffix_dedup


def clash(df):
    """Columns with the names that operators use inside."""
    names = ["uid", "fp", "hits", "far", "near", "at", "n", "key", "rank", "score", "_text", "w", "s", "h"]
    return df.select("*", *(F.lit("z").alias(c) for c in names if c not in df.columns))


# --- 1 -------------------------------------------------------------------------


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 16)).astype("f4")
    v[700:760] = v[5]  # a common vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = ann.brute([(i, x) for i, x in enumerate(v)], set(range(0, 1500, 20)))
    assert set(got) == set(want)
    hit = 0
    for q, best in got.items():
        best.sort()
        assert [b[0] for b in best] == list(range(1, 21)) and q not in [b[1] for b in best]
        hit += len({b[1] for b in best} & set(want[q]))
        for _, i, s in best:
            assert abs(s - float(v[q].astype("f8") @ v[i].astype("f8"))) < 1e-9
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(best, best[1:]))
    assert hit / (20 * len(want)) >= 0.9
    # copies of the common vector: the smaller ids
    assert [b[1] for b in got[700]][:20] == [5, *range(701, 720)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_search_recall_on_the_supplied_vectors(spark, sf):
    got: dict = {}
    for r in ann.op1_multi_index(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(r.vec_id, np.array(r.embedding, "f8")) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = ann.brute(rows, {i for i, _ in rows if i % 20 == 0})
    assert set(got) == set(want)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) / sum(map(len, want.values())) >= 0.9


def test_search_of_all_cells_is_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20, fraction=1.0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert {q: [m[k] for k in sorted(m)] for q, m in got.items()} == ann.brute(list(enumerate(v)), set(range(0, 300, 20)))


def test_search_of_repeated_ids_and_huge_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0])]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") == 1).collect())
    # two rows ask, each is the other's candidate
    assert got == sorted([(1, 1, 2, 2.0), (1, 2, 1, 0.0), (1, 3, 3, 0.0), (1, 1, 3, 3.0), (1, 2, 1, 0.0), (1, 3, 2, 0.0)])
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [1e300, 1.0]), (2, [1.0, 0.0]), (3, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.search(huge, F.col("vec_id") == 0).collect())
    assert got == [(1, 1, float("inf")), (2, 2, 1e300), (3, 3, float("-inf"))]


def test_search_leaves_out_what_is_no_vector(spark):
    bad = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    df = clash(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 8, 1.0), (0, 2, 7, 0.5), (0, 3, 20, 0.0), (0, 4, 20, 0.0)]
    assert ann.search(df.filter("false"), F.col("vec_id") == 0).count() == 0


def test_walk_passes_cells_in_order_of_their_sum():
    rng = np.random.default_rng(2)
    d1, d2, size = rng.random(9), rng.random(7), rng.integers(0, 5, (9, 7))
    sums = sorted((d1[i] + d2[j], size[i, j]) for i in range(9) for j in range(7))
    for wanted in (1, 10, 40):
        got, total = ann.walk(d1, d2, size, wanted), 0
        for s, n in sums:
            total += n
            if total >= wanted:
                assert abs(got - s) < 1e-12
                break
    assert ann.walk(d1, d2, size, 10**6) == np.inf


# --- 4 -------------------------------------------------------------------------


def test_fingerprint_definition():
    import xxhash

    t = "A b\tC d\na B c"
    w = "a b c d a b c".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(t) == want
    assert simhash.fingerprint("Ä B") == xxhash.xxh64_intdigest("Ä b".encode(), 42)
    assert simhash.fingerprint(" \n") == simhash.fingerprint(None) == 0


def test_components_match_brute_force(spark, docs, texts):
    want = simhash.brute(texts)
    rows = simhash.near_duplicates(clash(docs)).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and len(rows) == len(texts)
    assert all(r.fingerprint == f"{simhash.fingerprint(texts[r.doc_id]):016x}" for r in rows)


@pytest.mark.parametrize("block", [512, 4])
def test_links_connect_all_within_distance(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds[:12].tolist():  # chains and crowds
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                s ^= 1 << b
            fps.add(s)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    root = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    label = {f: i for i, f in enumerate(fps)}
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                old, new = label[b], label[a]
                label = {k: new if v == old else v for k, v in label.items()}
    sign = lambda f: int(np.uint64(f).view(np.int64))
    got = {f: root.get(sign(f), sign(f)) for f in fps}
    assert len(set(zip(label.values(), got.values(), strict=True))) == len(set(label.values())) == len(set(got.values()))


def test_simhash_edges(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 6 and {r.fingerprint for r in rows if r.doc_id in (1, 2)} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(4).permutation(n).tolist()
    df = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {r.root for r in graph.components(df).collect()} == {0}


# --- 6 and 10 --------------------------------------------------------------------


def test_passages_match_brute_force(docs, texts):
    want = substring.brute(list(texts.items()))
    rows = substring.remove_passages(clash(docs)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want and len(rows) == len(texts)
    assert sum(w[1] for w in want.values()) > 500


def test_strings_match_brute_force(docs, texts):
    want = suffix_dedup.brute(texts)
    rows = suffix_dedup.remove_repeats(clash(docs)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want and len(rows) == len(texts)
    assert sum(w[1] for w in want.values()) > 5000


def shuffled(spark) -> int:
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_edges_of_repeats_are_not_shuffled_string_by_string(spark):
    rng = np.random.default_rng(10)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts, edges = {}, 0
    for k in range(48):  # twins that share all sizes about the threshold, at all distances from their edges
        shared = noise(int(rng.integers(396, 440)) if k % 3 else 1500)
        for j in range(2):
            texts[10 * k + j] = noise(int(rng.integers(0, 300))) + shared + noise(int(rng.integers(0, 300)))
        edges += len(texts[10 * k]) + len(texts[10 * k + 1]) - 798
    texts |= {1000 + k: texts[0][5 * k :] + noise(k) for k in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    before = shuffled(spark)
    rows = suffix_dedup.remove_repeats(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == suffix_dedup.brute(texts)
    moved = shuffled(spark) - before
    assert moved < edges / 4  # each string apart: over a third


@pytest.mark.parametrize("block", [1, 7, 400])
def test_stretches_of_any_length(docs, texts, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == suffix_dedup.brute(texts)


def test_repeats_edges(odd, empty):
    assert substring.remove_passages(empty).count() == suffix_dedup.remove_repeats(empty).count() == 0
    a, b = substring.remove_passages(odd).collect(), suffix_dedup.remove_repeats(odd).collect()
    assert len(a) == len(b) == 6 and all(r.n_removed == 0 for r in [*a, *b])


def test_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(120))
    df = spark.createDataFrame([(1, t), (1, t), (2, "short")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substring.remove_passages(df).collect()} == {(1, 0), (2, 0)}  # one document
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()} == {(1, len(t)), (2, 0)}  # two occurrences


@pytest.mark.parametrize("seed", range(6))
def test_every_window_belongs_to_one_item(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(0, 120, 12)
    first = np.append(0, np.cumsum(size))
    sym = rng.integers(0, 1 << 63, 5, dtype=np.uint64)[rng.integers(0, 3 if seed % 2 else 5, first[-1])]
    t, at, n, near, far, _ = repeats.items(sym, first, 20, 1, 10)
    cover = sorted((a, p + i) for a, p, k in zip(t.tolist(), at.tolist(), n.tolist(), strict=True) for i in range(k))
    assert cover == [(d, p) for d, k in enumerate(size.tolist()) for p in range(k - 19)]
    # equal windows have equal near ranks
    ranks: dict[tuple, set] = {}
    for a, p, k, r in zip(t.tolist(), at.tolist(), n.tolist(), near.tolist(), strict=True):
        for i in range(k):
            s = first[a] + p + i
            ranks.setdefault(tuple(sym[s : s + 20].tolist()), set()).add(r)
    assert all(len(r) == 1 for r in ranks.values())


def test_long_walks_are_not_gone_cell_by_cell(monkeypatch):
    rng = np.random.default_rng(4)
    size = rng.integers(0, 3, (256, 256))
    d1, d2 = rng.random(256), rng.random(256)
    pops = []
    pop = ann.heapq.heappop
    monkeypatch.setattr(ann.heapq, "heappop", lambda heap: pops.append(1) or pop(heap))
    sums = (d1[:, None] + d2).ravel()
    order = np.argsort(sums, kind="stable")
    reached = np.cumsum(size.ravel()[order])
    for share in (0.001, 0.3, 0.67, 1.0):
        wanted = share * size.sum()
        assert ann.walk(d1, d2, size, wanted) == sums[order[np.searchsorted(reached, wanted)]]
    assert ann.walk(d1, d2, size, size.sum() + 1) == np.inf
    assert len(pops) <= 5 * 512


def test_routed_passages_are_read_by_column_and_found():
    import pyarrow as pa

    runs = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("at", pa.int32())]))
    run = lambda start, words, doc, uid, at: {"start": start, "words": words, "doc_id": doc, "uid": uid, "at": at}
    schema = pa.schema([("lo", pa.int32()), ("content", pa.binary()), ("runs", runs)])
    rows = [(10, b"a b\tc d e f g h", [run(10, 8, 1, 5, 10), run(11, 7, 0, 6, 3)]), (0, b"x y", []), (4, b"c d e f g h a", [run(4, 7, None, 7, 4)])]
    table = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    table = pa.concat_tables([table.slice(0, 1), table.slice(1)])
    got = substring.routed_passages(table)
    assert got == [(c.split(), [(r["start"] - lo, r["words"], (r["doc_id"], r["uid"], r["at"])) for r in rs]) for lo, c, rs in rows]
    assert substring.routed_passages(table.slice(0, 0)) == substring.routed_passages(schema.empty_table()) == []
    words = b"z a b c d e f g h a z".split()
    assert sorted(substring.locate([words, [], [b"a"]], got)[0], key=repr) == [(1, 9, (1, 5, 10)), (2, 9, (0, 6, 3)), (3, 10, (None, 7, 4))]
    # as many words as need all digits
    many = [str(i).encode() for i in range(40_000)]
    assert substring.locate([many[39_980:]], [(many, [(39_975, 25, (0, 0, 0)), (39_985, 15, (0, 0, 1))])]) == [[(5, 20, (0, 0, 1))]]
