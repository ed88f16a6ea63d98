"""Suffix-array dedup by distributed prefix doubling: bytes of strings that occur again are removed (operator 10).

Doubling over every byte would sort some 16 bytes a round for each byte of text. The positions
ranked are synchronised ones: of each run of SPAN grams the least-hashed one, a choice
that depends on the run's bytes alone, so that equal strings have theirs at equal places.
The string from a position to the next (its gram included) is a block.

- Round 0 ranks positions by their block (two 64-bit fingerprints).
- Round a ranks positions by the pair of ranks at position k and at position k + 2 ** (a - 1),
  which names the strings of 2 ** a blocks. Spark groups the pairs, and every group gets a number of its own.
- A position whose rank is unique leaves all later rounds, as does one whose string is
  past the threshold. Rounds end when no position is left.

A string of `width` bytes holds a run of blocks, first to last synchronised position in it;
two overlapping strings of 2 ** a blocks that begin and end that run name it, as in a
table of range minima. Successive strings with one run are an item; strings whose run is unique are dropped by
now. Items that recur are settled at growing lengths (near rank: the run; far rank: all bytes of the item):

- A far rank that occurs twice: all strings of its items recur.
- Other items of a run that several far ranks share are cut into stretches of BLOCK strings, by their distance from the
  run. A stretch has a core, the bytes that all of its BLOCK strings share, and the few bytes around it.
- A core that occurs once: none of the stretch's strings recurs. Cores with the same bytes around them: all do.
- What is left (an edge of a repeat runs through the stretch) is compared string by string: the core and
  the BLOCK - 1 bytes around it that belong to the string.

The result is that of all suffixes.

Cases: null and empty texts have no bytes; texts shorter than the threshold lose
nothing; equal strings within one document count, overlapping ones too; repeated
rows remove each other's strings; an empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsurf.llm import common, repeats

WIDTH = 400
GRAM = 16
#: Grams of a synchronising run: half of those of a string, so that each string holds two positions at least.
SPAN = 192
#: Strings of a stretch.
BLOCK = 16


def symbols(column) -> tuple[np.ndarray, np.ndarray]:
    raw, first = common.text_buffer(column)
    return common.BYTE_MIX[raw], first


class Positions:
    """Synchronised positions of a run of texts. choice: of the run of grams from a place on; at, text: the positions and their texts; lead: of each text its first position's number."""

    def __init__(self, sym: np.ndarray, first: np.ndarray, gram: int, span: int):
        need = gram + span - 1
        self.prints = repeats.Prints(sym)
        if len(sym) < need:
            self.choice = self.at = self.text = np.empty(0, np.int64)
        else:
            self.choice = repeats.least_grams(self.prints, len(sym), gram, span)
            room = np.maximum(np.diff(first) - need + 1, 0)
            text = np.repeat(np.arange(len(room)), room)
            start = np.arange(len(text)) - np.repeat(np.cumsum(room) - room, room) + first[text]
            got = self.choice[start]
            new = np.append(True, np.diff(got) != 0)[: len(got)]  # choices never go back, and those of two texts differ
            self.at, self.text = got[new], text[new]
        self.lead = np.searchsorted(self.text, np.arange(len(first)))


def blocks(docs: DataFrame, gram: int, span: int) -> DataFrame:
    """uid, copies, k, at, stop, fa, fb: the block of each synchronised position of docs(uid, copies, text) but the last of a text."""
    common.tune(docs.sparkSession)

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            for s, e in common.slices(b.column(2)):
                sym, first = symbols(b.column(2).slice(s, e - s))
                p = Positions(sym, first, gram, span)
                k = np.flatnonzero(np.diff(p.text) == 0)
                text, start, stop = p.text[k], p.at[k], p.at[k + 1] + gram
                second = repeats.Prints((sym ^ (sym >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))
                fa, fb = p.prints.of(start, stop).view(np.int64), second.of(start, stop).view(np.int64)
                own = pa.array(text)
                cols = [b.column(0).slice(s, e - s).take(own), b.column(1).slice(s, e - s).take(own), pa.array((k - p.lead[text]).astype(np.int32)), pa.array((start - first[text]).astype(np.int32)), pa.array((stop - first[text]).astype(np.int32)), pa.array(fa), pa.array(fb)]
                yield pa.RecordBatch.from_arrays(cols, ["uid", "copies", "k", "at", "stop", "fa", "fb"])

    return docs.select("uid", "copies", "text").mapInArrow(scan, "uid long, copies int, k int, at int, stop int, fa long, fb long")


def ranked(rows: DataFrame, pair: list[str], name: str) -> tuple[DataFrame | None, str | None]:
    """rows whose pair others share, with `rank`, a number for each such pair, in place of it; None if there are none."""
    spark = rows.sparkSession
    rows, rows_path = common.write_table(rows, f"{name}-pairs")
    names = rows.groupBy(*pair).agg(F.sum("copies").alias("_n")).filter("_n > 1").select(*pair, F.monotonically_increasing_id().alias("rank"))
    names, names_path = common.write_table(names, f"{name}-ranks")  # numbers are fixed once written
    out = path = None
    if not names.isEmpty():
        out, path = common.write_table(rows.join(names, pair).drop(*pair), name)
    common.drop_table(spark, rows_path)
    common.drop_table(spark, names_path)
    common.free(spark)
    return out, path


def double(docs: DataFrame, width: int, gram: int, span: int) -> list[tuple[DataFrame, str]]:
    """uid, copies, k, at, stop, rank of each round, round 0 first: strings of 1, 2, 4, ... blocks that recur and are no longer than width."""
    out = []
    level, path = ranked(blocks(docs, gram, span).filter(F.col("stop") - F.col("at") <= width), ["fa", "fb"], "doubling-0")
    while level is not None:
        out.append((level, path))
        step = 1 << (len(out) - 1)
        ahead = level.select("uid", (F.col("k") - step).alias("k"), F.col("rank").alias("next"), F.col("stop").alias("_stop"))
        pairs = level.join(ahead, ["uid", "k"]).select("uid", "copies", "k", "at", F.col("_stop").alias("stop"), "rank", "next").filter(F.col("stop") - F.col("at") <= width)
        level, path = ranked(pairs.withColumnRenamed("rank", "own"), ["own", "next"], f"doubling-{len(out)}")
    return out


def run_items(docs: DataFrame, levels: list[DataFrame], width: int, gram: int, span: int) -> DataFrame:
    """near, far, uid, at, n, lead, copies of the items of docs(uid, copies, text) whose run of blocks may recur. lead: from `at` to the run's first position."""
    held = None
    for a, level in enumerate(levels):
        own = level.select("uid", F.struct(F.lit(a).alias("a"), "k", "rank").alias("e"))
        held = own if held is None else held.unionByName(own)
    held = held.groupBy("uid").agg(F.collect_list("e").alias("ranks"))
    n_levels = len(levels)
    reach = width - span - gram + 1  # from the first synchronising run of a string to its last

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            for s, e in common.slices(b.column(2)):
                part = b.slice(s, e - s)
                sym, first = symbols(part.column(2))
                p = Positions(sym, first, gram, span)
                rank = np.full((n_levels, len(p.at) + 1), -1, np.int64)
                flat = part.column(3).flatten()
                row = np.repeat(np.arange(e - s), pa.compute.list_value_length(part.column(3)).to_numpy())
                a, k, r = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                rank[a, p.lead[row] + k] = r
                room = np.maximum(np.diff(first) - width + 1, 0)
                text = np.repeat(np.arange(len(room)), room)
                start = np.arange(len(text)) - np.repeat(np.cumsum(room) - room, room) + first[text]
                kf = np.searchsorted(p.at, p.choice[start]) if len(start) else start
                kl = np.searchsorted(p.at, p.choice[start + reach]) if len(start) else start
                # strings with one run of blocks are an item
                head = np.flatnonzero(np.append(True, (np.diff(kf) != 0) | (np.diff(kl) != 0) | (np.diff(text) != 0))[: len(start)])
                tail = np.append(head[1:], len(start))[: len(head)] - 1
                kf, m = kf[head], (kl - kf)[head]
                level = np.frexp(m.astype(np.float64))[1] - 1  # 2 ** level <= m
                known = level < n_levels
                level = np.where(known, level, 0)
                r1, r2 = rank[level, kf], rank[level, np.maximum(kf + m - (1 << level), 0)]
                live = known & (r1 >= 0) & (r2 >= 0)
                head, tail, kf, m, r1, r2 = (x[live] for x in (head, tail, kf, m, r1, r2))
                lo, hi, at, t = start[head], start[tail], p.at[kf], text[head]
                near = common.mix64(common.mix64(r1.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + m.astype(np.uint64)) + r2.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
                far = common.mix64(p.prints.of(lo, hi + width) ^ common.mix64((at - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)))
                own = pa.array(t)
                cols = [pa.array(near.view(np.int64)), pa.array(far.view(np.int64)), part.column(0).take(own), pa.array((lo - first[t]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32)), pa.array((at - lo).astype(np.int32)), part.column(1).take(own)]
                yield pa.RecordBatch.from_arrays(cols, ["near", "far", "uid", "at", "n", "lead", "copies"])

    common.tune(docs.sparkSession)
    return docs.select("uid", "copies", "text").join(held, "uid").mapInArrow(scan, "near long, far long, uid long, at int, n int, lead int, copies int")


def stretches(docs: DataFrame, items: DataFrame, width: int, block: int) -> DataFrame:
    """near, core, far, times, uid, at, n, lead, around of the stretches of items(near, times, uid, at, n, lead) in docs(uid, text).

    lead: from `at` to the core; around: the bytes of the stretch's strings before the core and after it.
    """
    held = items.groupBy("uid").agg(F.collect_list(F.struct("near", "times", "at", "n", "lead")).alias("own"))
    size = width - block + 1  # of a core

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            for s, e in common.slices(b.column(1)):
                part = b.slice(s, e - s)
                raw, _ = common.text_buffer(part.column(1))
                sym, first = symbols(part.column(1))
                prints = repeats.Prints(sym)
                flat = part.column(2).flatten()
                row = np.repeat(np.arange(e - s), pa.compute.list_value_length(part.column(2)).to_numpy())
                at, n, lead = (flat.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (2, 3, 4))
                # an item's strings are `lead`, lead - 1, ... away from its run; those of one quotient by `block` are a stretch
                top, low = lead // block, (lead - n + 1) // block
                count = top - low + 1
                item = np.repeat(np.arange(len(at)), count)
                j = top[item] - (np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count))
                far_off, near_off = np.minimum(lead[item], j * block + block - 1), np.maximum((lead - n + 1)[item], j * block)
                place = (at + lead)[item] - far_off  # the first string of the stretch
                begin = first[row[item]] + place
                before, after = far_off - j * block, block - 1 - (near_off - j * block)
                core = begin + before
                whole = prints.of(begin, core + size + after) ^ common.mix64(before.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64))
                name = common.mix64(prints.of(core, core + size) + j.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                # bytes before and after the core
                off = np.append(0, np.cumsum(before + after))
                step = np.arange(off[-1]) - np.repeat(off[:-1], before + after)
                around = raw[np.repeat(begin, before + after) + step + np.where(step < np.repeat(before, before + after), 0, size)]
                around = pa.Array.from_buffers(pa.binary(), len(item), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(around))])
                own = pa.array(item)
                cols = [flat.field(0).take(own), pa.array(name.view(np.int64)), pa.array(whole.view(np.int64)), flat.field(1).take(own), part.column(0).take(pa.array(row[item])), pa.array(place.astype(np.int32)), pa.array((far_off - near_off + 1).astype(np.int32)), pa.array(before.astype(np.int32)), around]
                yield pa.RecordBatch.from_arrays(cols, ["near", "core", "far", "times", "uid", "at", "n", "lead", "around"])

    common.tune(docs.sparkSession)
    return docs.select("uid", "text").join(held, "uid").mapInArrow(scan, "near long, core long, far long, times long, uid long, at int, n int, lead int, around binary")


def cut(text: bytes, cover: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs (start, stop) and the bytes kept. cover: starts and stops of spans, any order."""
    if not len(cover):
        return [], text
    cover = cover[np.argsort(cover[:, 0], kind="stable")]
    reach = np.maximum.accumulate(cover[:, 1])
    new = np.append(True, cover[1:, 0] > reach[:-1])
    start, stop = cover[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(cover) - 1)]
    gone = list(zip(start.tolist(), stop.tolist(), strict=True))
    last = [0, *(z for _, z in gone)]
    return gone, b"".join([text[z:a] for z, a in zip(last, [*(a for a, _ in gone), len(text)], strict=True)])


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, span: int = SPAN, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; with `texts` also the removed spans (start, stop) and the bytes kept."""
    if width - span - gram + 1 < span:
        raise ValueError("a string must hold two synchronised positions")
    spark = docs.sparkSession
    own = repeats.with_uid(docs)
    # rows equal in doc_id and text are ranked once, with their number
    repeated = bool(own.groupBy("uid").count().filter("count > 1").limit(1).count())
    once = own.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").cast("int").alias("copies")) if repeated else own.withColumn("copies", F.lit(1))
    levels = double(once, width, gram, span)
    if not levels:
        spans, path = common.write_table(spark.createDataFrame([], "uid long, hits array<struct<at:int,n:int>>"), "repeat-spans")
    else:
        spans, path = recurring(once, levels, width, gram, span)
    return finish_rows(own, spans, width, texts)


def recurring(once: DataFrame, levels: list[tuple[DataFrame, str]], width: int, gram: int, span: int) -> tuple[DataFrame, str]:
    """uid and hits (at, n): the n strings from `at` on recur."""
    spark = once.sparkSession
    met, met_path = common.write_table(run_items(once, [x for x, _ in levels], width, gram, span), "doubled")
    for _, path in levels:
        common.drop_table(spark, path)
    common.free(spark)
    # n and lead are part of the far rank
    each = met.groupBy("near", "far").agg(F.sum("copies").alias("times"), *(F.first(c).alias(c) for c in ("uid", "at", "n", "lead")))
    each, each_path = common.write_table(each, "repeat-classes")
    kinds = each.groupBy("near").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 AND least < 2").select("near")
    kinds, kinds_path = common.write_table(kinds, "repeat-kinds")
    common.free(spark)

    block = min(BLOCK, width)
    parts, parts_path = common.write_table(stretches(once, each.join(kinds, "near"), width, block), "repeat-stretches")
    common.drop_table(spark, kinds_path)
    common.free(spark)
    # counts are written, so that the joins read two plain shuffles and Spark may split a core that many share
    cores = parts.groupBy("near", "core").agg(F.sum("times").alias("all"), F.min("far").alias("a"), F.max("far").alias("b")).filter("all > 1")
    cores, cores_path = common.write_table(cores.select("near", "core", (F.col("a") == F.col("b")).alias("same")), "repeat-cores")
    common.free(spark)
    shared, shared_path = common.write_table(parts.join(cores, ["near", "core"]).filter("NOT same OR times < 2").drop("far"), "repeat-edges")
    common.drop_table(spark, parts_path)
    common.drop_table(spark, cores_path)
    common.free(spark)

    # the i-th string of a stretch has `lead` - i bytes before the core
    rank = F.expr(f"xxhash64(core, lead - i, substring(around, i + 1, {block - 1}))").alias("rank")
    windows = shared.filter("NOT same").select("near", "core", "times", "uid", "at", "lead", "around", F.explode(F.expr("sequence(0, n - 1)")).alias("i")).select("near", rank, "times", "uid", (F.col("at") + F.col("i")).alias("at"))
    again, again_path = common.write_table(windows.groupBy("near", "rank").agg(F.sum("times").alias("all")).filter("all > 1").select("near", "rank"), "repeat-windows")
    common.free(spark)  # the windows' shuffle, before they are shuffled again
    one = windows.filter("times < 2").join(again, ["near", "rank"]).select("uid", "at", F.lit(1).alias("n"))
    some = shared.filter("same").select("uid", "at", "n")
    every = met.join(each.filter("times > 1").select("near", "far"), ["near", "far"]).select("uid", "at", "n")
    hits = every.unionByName(some).unionByName(one)
    spans, path = common.write_table(hits.groupBy("uid").agg(F.collect_list(F.struct("at", "n")).alias("hits")), "repeat-spans")
    for done in (met_path, each_path, shared_path, again_path):
        common.drop_table(spark, done)
    common.free(spark)
    return spans, path


def finish_rows(own: DataFrame, spans: DataFrame, width: int, texts: bool) -> DataFrame:
    def finish(batches):
        import pyarrow as pa

        for b in batches:
            text, hits = b.column(1), b.column(2)
            flat = hits.flatten()
            at, n = (flat.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(2))
            cover = np.stack([at, at + n - 1 + width], axis=1)
            last = np.append(0, np.cumsum(pa.compute.list_value_length(hits).fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
            rows = [cut(text[i].as_py().encode("utf-8", "surrogatepass"), cover[last[i] : last[i + 1]]) for i in range(b.num_rows)]
            size = [sum(z - a for a, z in r[0]) for r in rows]
            cols = [b.column(0), pa.array([len(r[1]) + g for r, g in zip(rows, size, strict=True)], pa.int64()), pa.array(size, pa.int64()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string())]
            if texts:
                cols += [pa.array([[{"start": a, "stop": z} for a, z in r[0]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([r[1] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * texts)

    common.tune(own.sparkSession)
    whole = own.join(spans, "uid", "left").select("doc_id", "text", "hits")
    return whole.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long,stop:long>>, kept binary" * texts)


def brute(texts: dict[int, str | None], width: int = WIDTH) -> dict[int, tuple[int, int, int, str]]:
    """Every string counted, for tests."""
    from collections import Counter

    raw = {k: (t or "").encode() for k, t in texts.items()}
    count = Counter(b[i : i + width] for b in raw.values() for i in range(len(b) - width + 1))
    out = {}
    for k, b in raw.items():
        spans = [(i, i + width) for i in range(len(b) - width + 1) if count[b[i : i + width]] > 1]
        gone, kept = cut(b, np.array(spans, np.int64).reshape(-1, 2))
        out[k] = (len(b), len(b) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
    return out


#: Every string of every text, by its MD5 number; texts as hexadecimal digits, as strings may cut characters.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
dup AS (SELECT doc_id, i FROM win JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
grp AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM dup)),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 400 AS z FROM grp GROUP BY doc_id, g),
part AS (SELECT doc_id, g, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM span),
gone AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS tail FROM span GROUP BY doc_id),
head AS (SELECT p.doc_id, string_agg(substring(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS t FROM part p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head.t, '') || substring(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN head USING (doc_id)
"""


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read_docs(spark, sf_dir))
