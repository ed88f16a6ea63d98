"""Recurring windows of a fixed length in all documents, exactly, by ranks at synchronised positions.

Every window of `width` symbols has an anchor: its least-hashed gram of `gram`
symbols (the leftmost of equals). It depends on the window's content alone, so
equal windows have their anchor at the same distance. Successive windows with one
anchor and one block of distances are an item; ranking items in place of windows
divides the rows by tens, and no window lacks an anchor, periodic text included.

Items are ranked at growing lengths. The near rank is that of the symbols common
to all windows of such a block (shorter than a window); the far rank that of all
symbols its windows cover (longer). Ranks are 64-bit fingerprints of the content,
so that a rank at a greater length needs no look-up at a shifted position.

- A near rank that occurs once: none of the windows recurs.
- A far rank that occurs twice under a near rank: all of them do.
- What is left over (an edge of a repeat) is ranked window by window, one
  representative for each far rank under a near rank that has several.

Far ranks and windows are compared under their near rank alone, so that two
64-bit fingerprints of different lengths must agree, and no near rank, far rank
or window is gathered: counts are summed before the shuffle and joined back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsurf.llm import common

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_MUL, _INV):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                more = min(done, size - done)
                p[done : done + more] = p[:more] * np.uint64(pow(base, done, 1 << 64))
                done += more
            out.append(p)
        _POW[:] = out
    return _POW[0][:n], _POW[1][:n]


class Prints:
    """Fingerprints of any run of symbols, from one prefix sum."""

    def __init__(self, sym: np.ndarray):
        up, self.down = _powers(len(sym) + 1)
        self.sum = np.zeros(len(sym) + 1, np.uint64)
        np.cumsum(sym * up[:-1], out=self.sum[1:])

    def raw(self, start, stop) -> np.ndarray:
        return (self.sum[stop] - self.sum[start]) * self.down[start]

    def of(self, start, stop) -> np.ndarray:
        return common.mix64(self.raw(start, stop) + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def least_grams(prints: Prints, n: int, gram: int, span: int) -> np.ndarray:
    """For each place the place of the least-hashed gram (the leftmost of equals) among `span` grams from there on.

    A gram's hash counts with 32 bits whatever the number of symbols, so that equal content has equal choices everywhere.
    """
    low = np.uint64((1 << 32) - 1)
    key = (common.mix64((prints.sum[gram:] - prints.sum[: n - gram + 1]) * prints.down[: n - gram + 1]) & ~low) | np.arange(n - gram + 1, dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    return (key & low).astype(np.int64)


def items(sym: np.ndarray, first: np.ndarray, width: int, gram: int, block: int):
    """Items of a run of texts: text, start of the first window in it, windows, near and far rank.

    sym: symbols of all texts; first: n + 1 offsets of the texts in them.
    """
    none = np.empty(0, np.int64)
    n, span = len(sym), width - gram + 1
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), None
    prints = Prints(sym)
    least = least_grams(prints, n, gram, span)
    # windows that lie in one text
    room = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(room)), room)
    start = np.arange(len(text)) - np.repeat(np.cumsum(room) - room, room) + first[text]
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), None
    anchor = least[start]
    part = (anchor - start) // block
    new = np.append(True, (np.diff(anchor) != 0) | (np.diff(part) != 0) | (np.diff(text) != 0))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    lo, hi, a, j, t = start[head], start[tail], anchor[head], part[head], text[head]
    begin = a - j * block
    near = common.mix64(prints.of(begin, begin - block + 1 + width) + j.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    far = common.mix64(prints.of(lo, hi + width) ^ common.mix64((a - lo).astype(np.uint64) << np.uint64(32) | (a - hi).astype(np.uint64)))
    return t, lo - first[t], hi - lo + 1, near, far, prints


UID = "xxhash64(doc_id, text)"
LOW = np.iinfo(np.int64).min


def with_uid(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text: rows that are equal in doc_id and text share their uid."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.select(F.expr(UID).alias("uid"), "doc_id", "text")


def near_ranks(docs: DataFrame, symbols, width: int, gram: int, block: int) -> DataFrame:
    """The near ranks that more than one item of docs(uid, doc_id, text) has. One row for each rank in a slice of texts is shuffled."""
    common.tune(docs.sparkSession)

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            for s, e in common.slices(b.column(0)):
                near = np.sort(items(*symbols(b.column(0).slice(s, e - s)), width, gram, block)[3])
                head = np.flatnonzero(np.append(True, near[1:] != near[:-1])[: len(near)])
                yield pa.RecordBatch.from_arrays([pa.array(near[head].view(np.int64)), pa.array(np.diff(np.append(head, len(near))).astype(np.int32))], ["near", "times"])

    return docs.select("text").mapInArrow(scan, "near long, times int").groupBy("near").agg(F.sum("times").alias("times")).filter("times > 1").select("near")


def scan_items(docs: DataFrame, symbols, width: int, gram: int, block: int) -> DataFrame:
    """near, far, doc_id, uid, at and n (windows) of each item of docs(uid, doc_id, text); symbols: Arrow string column to symbols and offsets."""
    common.tune(docs.sparkSession)

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            text = b.column(2)
            for s, e in common.slices(text):
                t, at, n, near, far, _ = items(*symbols(text.slice(s, e - s)), width, gram, block)
                uid, doc = b.column(0).slice(s, e - s).to_numpy()[t], b.column(1).slice(s, e - s).fill_null(LOW).to_numpy()[t]
                yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(far.view(np.int64)), pa.array(doc), pa.array(uid), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["near", "far", "doc_id", "uid", "at", "n"])

    return docs.select("uid", "doc_id", "text").mapInArrow(scan, "near long, far long, doc_id long, uid long, at int, n int")


def met_items(docs: DataFrame, symbols, width: int, gram: int, block: int) -> tuple[DataFrame, str]:
    """The items of docs whose near rank others share, as a table, and its path."""
    # a rank that many share is summed before the shuffle; its rows then meet it in a join, which Spark may split
    near, near_path = common.write_table(near_ranks(docs, symbols, width, gram, block), "repeat-near")
    met = common.write_table(scan_items(docs, symbols, width, gram, block).join(near, "near").withColumn("copies", F.lit(1)), "repeat-items")
    common.drop_table(docs.sparkSession, near_path)
    return met


#: Symbols of a piece of content: items that start in the same stretch of so many symbols share it.
PIECE = 256


class Repeats:
    """What recurs in docs(uid, doc_id, text), as tables in the shared folder.

    met: items (near, far, doc_id, uid, at, n, copies: rows of that text), those at least whose near rank others share.
    classes: of each (near, far) how many items have it, the first of them by doc_id, uid
    and at, and `edge`: i, doc_id, uid, at of its windows i that recur, and where each
    occurs first; null where the near rank has no other far rank.
    pieces: uid, bucket, lo, content: the symbols from `lo` on that the first items starting in that stretch of PIECE symbols cover
    (what content(text, row, at, size) cuts out), where content is given.
    """

    def __init__(self, docs: DataFrame, met: tuple[DataFrame, str], symbols, width: int, content=None):
        """met: a table that write_table has written, and its path."""
        spark = docs.sparkSession
        self.met, self.met_path = met
        common.free(spark)

        each = self.met.groupBy("near", "far").agg(F.sum("copies").alias("times"), F.min(F.struct("doc_id", "uid", "at", "n")).alias("first"))
        each, each_path = common.write_table(each.select("near", "far", "times", "first.*"), "repeat-classes")
        # counts are written, so that the joins read two plain shuffles and Spark may split a rank that many share
        kinds, kinds_path = common.write_table(each.groupBy("near").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "repeat-kinds")
        each = each.join(kinds, "near", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1))).filter("times > 1 OR kinds > 1")
        wanted = each.groupBy("uid").agg(F.collect_list(F.struct("near", "far", "times", "at", "n", "kinds")).alias("own"))
        texts = docs.join(wanted, "uid").dropDuplicates(["uid"]).select("uid", "doc_id", "text", "own")

        def ranked(batches):
            import pyarrow as pa

            for b in batches:
                for s, e in common.slices(b.column(2)):
                    part = b.slice(s, e - s)
                    sym, first = symbols(part.column(2))
                    prints, lists = Prints(sym), part.column(3)
                    row = np.repeat(np.arange(e - s), lists.value_lengths().to_numpy())
                    flat = lists.flatten()
                    at = flat.field(3).to_numpy(zero_copy_only=False).astype(np.int64)
                    order = np.lexsort((at, row))
                    row, at, flat = row[order], at[order], flat.take(pa.array(order))
                    n, kinds = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (4, 5))
                    count = np.where(kinds > 1, n, 0)  # windows to rank
                    start = np.repeat(first[row] + at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    rank = prints.of(start, start + width).view(np.int64)
                    ranks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(rank))
                    items_ = pa.StructArray.from_arrays([flat.field(0), flat.field(1), flat.field(2), flat.field(3), flat.field(4), ranks], ["near", "far", "times", "at", "n", "ranks"])
                    # pieces: items of a text that start in one stretch
                    head = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(at // PIECE) != 0))[: len(row)])
                    lo = at[head]
                    hi = np.maximum.reduceat(at + n + (width - 1), head) if len(head) else lo
                    cut = content(part.column(2), row[head], lo, hi - lo) if content else [b""] * len(head)
                    own = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), items_)
                    doc, uid = part.column(1).fill_null(LOW).to_numpy()[row[head]], part.column(0).to_numpy()[row[head]]
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(uid), pa.array((lo // PIECE).astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(cut, pa.binary()), own], ["doc_id", "uid", "bucket", "lo", "content", "own"])

        common.tune(spark)
        held = texts.mapInArrow(ranked, "doc_id long, uid long, bucket int, lo int, content binary, own array<struct<near:long,far:long,times:long,at:int,n:int,ranks:array<long>>>")
        held, self.pieces_path = common.write_table(held, "repeat-pieces")
        common.drop_table(spark, each_path)
        common.drop_table(spark, kinds_path)
        common.free(spark)
        self.pieces = held.select("uid", "bucket", "lo", "content")

        items = held.select("doc_id", "uid", F.explode("own").alias("e")).select("doc_id", "uid", "e.*")
        windows = items.select("near", "far", "times", "doc_id", "uid", "at", F.posexplode("ranks").alias("i", "rank"))
        here = F.struct("doc_id", "uid", (F.col("at") + F.col("i")).alias("at"))
        firsts = windows.groupBy("near", "rank").agg(F.count("*").alias("kinds"), F.min(here).alias("first")).filter("kinds > 1")
        firsts, firsts_path = common.write_table(firsts, "repeat-firsts")
        common.free(spark)  # the windows' shuffle, before they are shuffled again
        # a window of one kind recurs if its item does, and then its own place is the first
        found = windows.join(firsts, ["near", "rank"], "left").filter("kinds > 1 OR times > 1").withColumn("first", F.coalesce("first", here))
        edges = found.groupBy("near", "far").agg(F.collect_list(F.struct("i", "first.doc_id", "first.uid", "first.at")).alias("edge"))
        done = items.drop("ranks").join(edges, ["near", "far"], "left").filter("times > 1 OR edge IS NOT NULL")
        self.classes, self.classes_path = common.write_table(done, "repeat-edges")
        common.drop_table(spark, firsts_path)
        common.free(spark)
