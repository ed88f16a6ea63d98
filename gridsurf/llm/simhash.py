"""SimHash near-duplicates by deletion-variant signatures (operator 4).

Fingerprints of 64 bits that differ in DISTANCE = 3 bits at most differ in one
bit at most in one of two 32-bit segments. For either segment every value is
indexed under its 32 one-wildcard variants (one bit deleted); fingerprints that
meet under a variant are verified by their whole distance. Only distinct
fingerprints are indexed, so copies cost nothing; a crowded variant is cut into
blocks, pairs of blocks are compared apart, and each gives a spanning forest of
its links in place of all pairs, which keeps every connection.

Cases: null, empty and wordless texts have the fingerprint zero, linked like
any other; texts of one or two words are one shingle; rows with the same doc_id
each keep a row; a null doc_id never names a component unless it stands alone;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsurf.llm import common, graph

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a variant that are compared in one block.
BLOCK = 512


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    return int(fingerprints([text or ""], size)[0])


def fingerprints(texts: list[str] | list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints: XXH64 of each shingle votes on each bit, over half the votes set it."""
    from xxhash import xxh64_intdigest as h

    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        words = (t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")).lower().split()
        n = len(words)
        if not n:
            continue
        line = b" ".join(words)
        if n <= size:
            got = [h(line, SEED)]
        else:
            at = np.cumsum([len(w) + 1 for w in words]).tolist()
            got = [h(line[a : b - 1], SEED) for a, b in zip([0, *at], at[size - 1 :])]
        votes = np.zeros(64, np.int64)
        for s in range(0, len(got), 8192):
            part = np.array(got[s : s + 8192], ">u8")
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[i] = np.packbits(votes * 2 > len(got)).view(">u8")[0]
    return out


def with_fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for each row of docs."""
    common.tune(docs.sparkSession)

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1).to_pylist(), size).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, "doc_id long, fp long")


def forest(x: np.ndarray, y: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """A spanning forest, as values, of the links within x, or between x and y."""
    values = x if y is None else np.concatenate([x, y])
    n, first = len(values), 0 if y is None else len(x)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(x)):
        j0 = i + 1 if y is None else first
        for j in (np.flatnonzero(np.bitwise_count(values[j0:] ^ values[i]) <= distance) + j0).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((int(values[i]), int(values[j])))
    return out


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links a, b between the distinct fingerprints fp that connect all within `distance` (3 at most)."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard find distances up to 3")
    half = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))]
    # segment, wildcard's place and the value without that bit, in one long
    key = lambda s, bit: F.lit((s << 5 | bit) << 32).bitwiseOR(half[s].bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << bit))))
    rows = distinct.select("fp", F.explode(F.array(*[key(s, bit) for s in (0, 1) for bit in range(32)])).alias("key"))
    # counts are summed before the shuffle and written: no variant's fingerprints need meet to be counted, and Spark may split the join
    crowded, _ = common.write_table(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-crowded")
    crowd = rows.join(crowded, "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = crowd.withColumn("blocks", blocks).withColumn("own", own).select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    # a group holds two blocks at most
    met = pairs.groupBy("key", "i", "j").agg(F.collect_list(F.when(F.col("own") == F.col("i"), F.col("fp"))).alias("x"), F.collect_list(F.when(F.col("own") != F.col("i"), F.col("fp"))).alias("y"))
    met = met.filter("i = j OR (size(x) > 0 AND size(y) > 0)").select("i", "j", "x", "y")
    common.tune(distinct.sparkSession)

    def verify(batches):
        import pyarrow as pa

        for b in batches:
            i, j = b.column(0).to_numpy(), b.column(1).to_numpy()
            xs, ys = b.column(2), b.column(3)
            n = pa.compute.list_value_length(xs).to_numpy()
            flat = xs.flatten().to_numpy().view(np.uint64)
            at = np.cumsum(n) - n
            pair = (n == 2) & (i == j)
            u, v = flat[at[pair]], flat[at[pair] + 1]
            close = np.bitwise_count(u ^ v) <= distance
            a, c = [u[close].view(np.int64)], [v[close].view(np.int64)]
            for r in np.flatnonzero(~pair & (n > 0)).tolist():
                x = flat[at[r] : at[r] + n[r]]
                y = None if i[r] == j[r] else ys[r].values.to_numpy().view(np.uint64)
                if (got := forest(x, y, distance)):
                    e = np.array(got, np.uint64).view(np.int64)
                    a.append(e[:, 0]), c.append(e[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], ["a", "b"])

    return met.mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable by links) for each row of docs."""
    marked, _ = common.write_table(with_fingerprints(docs, size), "simhash")
    each = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    each, _ = common.write_table(each, "simhash-distinct")
    found = graph.components(links(each.select("fp"), distance))
    root_low = found.join(each.withColumnRenamed("fp", "node"), "node").select("node", "root", "low")
    low = root_low.groupBy("root").agg(F.min("low").alias("component"))
    named = root_low.join(low, "root").select(F.col("node").alias("fp"), "component")
    # written, so that the last join reads two plain shuffles and Spark may split a fingerprint that many share
    all_fps, _ = common.write_table(each.join(named, "fp", "left").select("fp", F.coalesce("component", "low").alias("component")), "simhash-components")
    return marked.join(all_fps, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def brute(texts: dict[int, str | None], distance: int = DISTANCE) -> dict[int, int]:
    """All pairs, for tests: the component of each document."""
    ids = sorted(texts)
    fp = [fingerprint(texts[i]) for i in ids]
    label = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                if (fp[a] ^ fp[b]).bit_count() <= distance and label[ids[a]] != label[ids[b]]:
                    label[ids[a]] = label[ids[b]] = min(label[ids[a]], label[ids[b]])
                    changed = True
    return label


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_docs(spark, sf_dir))
