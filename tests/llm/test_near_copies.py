"""The pipeline's near-duplicate stage: five-word shingles at similarity 0.8, against brute force."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from gridsurf.llm import near, simhash
from tests.llm.conftest import SCHEMA, prose


def hash_of(line: bytes, band: int) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(line, band)


def edited(rng, text: str, share: float) -> str:
    w = text.split()
    for i in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[i] = f"edit{rng.integers(1 << 30)}"
    return " ".join(w)


def test_edited_copies_are_one_document(spark, texts):
    rng = np.random.default_rng(31)
    own = dict(texts)
    for k in range(60):
        own[1000 + 10 * k] = base = prose(rng, 1000 if k % 2 else 300)
        own |= {1000 + 10 * k + j: edited(rng, base, share) for j, share in enumerate((0.005, 0.01, 0.02, 0.05), 1)}
    want = near.brute(own)
    copies = [(i, j) for i in range(1000, 1600, 10) for j in range(i + 1, i + 5) if want[j] == want[i]]
    assert len(copies) > 170 and len({want[i] for i in own}) < len(own) - 170
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in own.items()], SCHEMA).repartition(3)
    assert {r.doc_id: r.component_id for r in near.near_copies(docs).collect()} == want
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert left == {k for k, c in want.items() if k == c}


def test_pairs_that_no_head_connects_are_found(spark, monkeypatch):
    # every text shares every band; blocks of two classes
    monkeypatch.setattr(near, "BLOCK", 2)
    monkeypatch.setattr(near, "bands", lambda lines: np.tile(np.arange(near.BANDS, dtype=np.uint64), (len(lines), 1)))
    rng = np.random.default_rng(32)
    own = {}
    for k in range(6):
        own[10 * k] = prose(rng, 200)
        own[10 * k + 1] = edited(rng, own[10 * k], 0.01)
    want = near.brute(own)
    assert len(set(want.values())) == 6
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in own.items()], SCHEMA)
    assert {r.doc_id: r.component_id for r in near.near_copies(docs).collect()} == want


def test_edges(spark, odd, empty):
    assert near.near_copies(empty).count() == 0
    got = sorted(((r.doc_id, r.component_id) for r in near.near_copies(odd).collect()), key=str)
    assert got == sorted([(None, 1), (1, 1), (2, 1), (3, 3), (3, 3), (None, None)], key=str)


def test_the_stage_takes_the_links_of_operator_4(spark, monkeypatch):
    # no text shares a band: only fingerprints that operator 4 links lead to copies
    monkeypatch.setattr(near, "bands", lambda lines: np.array([[hash_of(x, b) for b in range(near.BANDS)] for x in lines], np.uint64))
    rng = np.random.default_rng(33)
    base = prose(rng, 1000)
    copy = next(c for c in (edited(rng, base, 0.001) for _ in range(200)) if (simhash.fingerprint(base) ^ simhash.fingerprint(c)).bit_count() <= simhash.DISTANCE)
    # a line repeated outweighs the rest: equal fingerprints, but no near copies
    line = "one two three four five " * 100
    own = {1: base, 2: copy, 3: line + "a tail of the first text", 4: line + "other words at the end"}
    assert simhash.brute(own) == {1: 1, 2: 1, 3: 3, 4: 3} and near.brute(own) == {1: 1, 2: 1, 3: 3, 4: 4}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in own.items()], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3, 4}
