"""Near copies by exact Jaccard similarity of word shingles, and candidates by operator 4's SimHash and by minimum hashes (the corpus pipeline's near-duplicate stage).

Two texts are linked where the sets of their shingles of SHINGLE = 5 words have
a Jaccard similarity of SIMILAR = 0.8 at least. Candidates share a band of
minimum hashes: BANDS = 20 bands of ROWS = 5 miss a pair of similarity 0.8 once
in 2,780, one of 0.9 less than once in 10^7. Every candidate is verified on the
shingles themselves (as 64-bit hashes). Texts of the same words are one class
from the start. In each band the class of the least id is compared with the
others first; then all classes of a band that are not yet connected are
compared, in blocks, each of which gives a spanning forest in place of pairs. No group is cut or sampled.

Deletion variants of a 64-bit SimHash do not reach this far: texts of
similarity 0.8 differ in about 10 bits, and segments that leave one of them to
the wildcard are too short to tell millions of texts apart. With `hashed` their links
(operator 4's, at its distance) are candidates as well, verified like those of the bands: fingerprints may be equal
where one repeated line outweighs all else.

Cases: null, empty and wordless texts are copies of each other; texts of one to
four words are one shingle; rows with the same doc_id each keep a row; a null
doc_id never names a component unless it holds no other; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsurf.llm import common, graph, simhash

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
#: Classes of a band that are compared in one block.
BLOCK = 512

_rng = np.random.default_rng(20240501)
_ODD = _rng.integers(1, 1 << 63, (2, BANDS * ROWS + SHINGLE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in turn, and how many each text has."""
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ws, we, first = common.word_bounds(raw, offsets)
    word, n = common.word_hashes(raw, ws, we), np.diff(first)
    begin, end, at = np.repeat(first[:-1], n), np.repeat(first[1:], n), np.arange(len(word))
    acc = np.zeros(len(word), np.uint64)
    for j in range(size):
        ok = np.flatnonzero(at + j < end)
        acc[ok] += word[ok + j] * _ODD[0, -1 - j]
    return common.mix64(acc[(at + size <= end) | (at == begin)]), np.where(n >= size, n - size + 1, np.minimum(n, 1))


def bands(texts: list[bytes]) -> np.ndarray:
    """BANDS keys of each text; texts without words have none that count."""
    h, n = shingles(texts)
    out = np.zeros((len(texts), BANDS), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    at = (np.cumsum(n) - n)[some]
    for band in range(BANDS):
        key = np.full(len(some), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = common.mix64(key * _ODD[1, -1] + np.minimum.reduceat((h ^ _ODD[1, k]) * _ODD[0, k], at))
        out[some, band] = key
    return out


def similarity(a: bytes, b: bytes, size: int = SHINGLE) -> float:
    x, y = np.unique(shingles([a], size)[0]), np.unique(shingles([b], size)[0])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _classes(docs: DataFrame, own, hashed: bool) -> DataFrame:
    """doc_id, own (a hash of the row), cid (hash of the folded words), line (the words), bands and, with `hashed`, fp (operator 4's fingerprint) of each row."""
    common.tune(docs.sparkSession)

    def scan(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest as h

        for b in batches:
            for a, z in common.slices(b.column(2), 1 << 19):
                lines = [b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) for t in b.column(2).slice(a, z - a).to_pylist()]
                cid = np.array([h(t) for t in lines], np.uint64).view(np.int64)
                keys = bands(lines).view(np.int64)
                fp = simhash.fingerprints(lines).view(np.int64) if hashed else np.zeros(len(lines), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(cid), pa.array(lines, pa.binary()), lists, pa.array(fp)], ["doc_id", "own", "cid", "line", "bands", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, own long, cid long, line binary, bands array<long>, fp long")


def _hashed(each: DataFrame) -> DataFrame:
    """Pairs a, b of classes that connect all whose fingerprints operator 4 links."""
    heads, path = common.write_table(each.groupBy("fp").agg(F.min("cid").alias("head")), "near-prints")
    same = each.select("fp", "cid").join(heads, "fp").filter("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b"))
    named = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    far = simhash.links(heads.select("fp")).join(named("a"), "a").join(named("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    out, _ = common.write_table(same.unionByName(far), "near-hashed")
    common.drop_table(each.sparkSession, path)
    return out


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those pairs a, b whose lines are similar."""
    side = lambda c: lines.select(F.col("cid").alias(c), F.col("line").alias(f"line_{c}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "line_a", "line_b")

    def verify(batches):
        import pyarrow as pa

        for t in batches:
            close = [similarity(x.as_py(), y.as_py()) >= SIMILAR for x, y in zip(t.column(2), t.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(close, pa.bool_()))

    return met.mapInArrow(verify, "a long, b long")


def _across(crowd: DataFrame, lines: DataFrame) -> DataFrame:
    """A spanning forest, for each key and pair of blocks, of the links a, b between classes that have other roots."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = crowd.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.join(lines.select("cid", "line"), "cid")
    rows = rows.select("key", "cid", "root", "own", "line", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    item = F.struct("cid", "root", "own", "line")
    met = rows.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(item).alias("l"))

    def verify(batches):
        import pyarrow as pa

        for t in batches:
            for r in range(t.num_rows):
                apart, flat = t.column(1)[r].as_py() != t.column(2)[r].as_py(), t.column(3)[r].values
                cid, root, own = (flat.field(k).to_numpy() for k in range(3))
                got = forest(cid, root, own if apart else None, flat.field(3).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["a", "b"])

    return met.mapInArrow(verify, "a long, b long").distinct()


def forest(cid: np.ndarray, root: np.ndarray, own: np.ndarray | None, lines: list[bytes]) -> list[tuple[int, int]]:
    """Links that connect all similar classes, where own is given those of other blocks; pairs connected by then are not compared."""
    sets = [np.unique(shingles([x])[0]) for x in lines]
    size = np.array([len(x) for x in sets])
    group, out = np.unique(root, return_inverse=True)[1], []
    for k in range(len(cid)):
        met = (group != group[k]) & (np.arange(len(cid)) > k) & (np.minimum(size, size[k]) >= SIMILAR * np.maximum(size, size[k]))
        for j in np.flatnonzero(met if own is None else met & (own != own[k])).tolist():
            if group[j] == group[k]:
                continue
            both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
            if both / (size[k] + size[j] - both) >= SIMILAR:
                group[group == group[j]] = group[k]
                out.append((int(cid[k]), int(cid[j])))
    return out


def near_copies(docs: DataFrame, own=None, hashed: bool = False) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable by links), own and `leads` for each row of docs.

    own: a hash that tells rows apart, of doc_id and text unless given. Of a component the rows with the smallest doc_id
    (null after all others), and of those the ones with the smallest hash, lead: one row, or rows that are equal in what is hashed.
    hashed: the links of operator 4 are candidates as well.
    """
    marked, _ = common.write_table(_classes(docs, F.xxhash64("doc_id", "text") if own is None else own, hashed), "near")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")
    each = marked.groupBy("cid").agg(F.min(place).alias("low"), F.first("line").alias("line"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    each, _ = common.write_table(each, "near-classes")
    prints = _hashed(each) if hashed else None
    rows = each.filter(F.length("line") > 0).select("cid", F.explode("bands").alias("key"))
    # summed before the shuffle and written, so that Spark may split a band key that many share
    heads, _ = common.write_table(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("head")).filter("n > 1"), "near-heads")
    crowd = rows.join(heads, "key")
    crowd, _ = common.write_table(crowd, "near-bands")
    stars = crowd.filter("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    one, _ = common.write_table(_verified(stars if prints is None else stars.unionByName(prints).distinct(), each), "near-links")
    found, _ = common.write_table(graph.components(one), "near-roots")
    # the head is compared with all of its band; what is not connected by now is compared pair by pair
    rest = crowd.filter("cid <> head").join(found.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rest, _ = common.write_table(rest, "near-rest")
    apart, _ = common.write_table(rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key"), "near-apart")
    rest = rest.join(apart, "key")
    two, _ = common.write_table(_across(rest, each), "near-links")
    found = graph.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(two))
    root_low = found.join(each.select(F.col("cid").alias("node"), "low"), "node").select("node", "root", "low")
    named = root_low.join(root_low.groupBy("root").agg(F.min("low").alias("component")), "root").select(F.col("node").alias("cid"), "component")
    # written, so that the last join reads two plain shuffles and Spark may split a class that many share
    named, _ = common.write_table(each.select("cid", "low").join(named, "cid", "left").select("cid", F.coalesce("component", "low").alias("component")), "near-components")
    return marked.select("doc_id", "own", "cid").join(named, "cid").select("doc_id", F.col("component.doc_id").alias("component_id"), "own", (place == F.col("component")).alias("leads"))


def brute(texts: dict[int, str | None]) -> dict[int, int]:
    """All pairs, for tests: the component of each document, by sets of the words themselves."""
    ids = sorted(texts)
    words = {i: (texts[i] or "").encode("utf-8", "surrogatepass").lower().split() for i in ids}
    sets = {i: {tuple(w[k : k + SHINGLE]) for k in range(max(len(w) - SHINGLE + 1, 1))} for i, w in words.items()}
    label = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if label[a] != label[b] and len(sets[a] & sets[b]) >= SIMILAR * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label
