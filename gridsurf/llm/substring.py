"""Substring dedup by repeated-phrase automata (operator 6).

Passages of `width` words or more that recur are confirmed over all documents
(see repeats.py: symbols are word fingerprints), each with its words and the place
where it occurs first. Documents are dealt into shards of about SHARD bytes by their
row hash. Each shard gets the confirmed passages of which it holds the fingerprint
somewhere, as words (pieces of their first document, so that passages that overlap there travel
once); they are compiled into Aho-Corasick automata with pyahocorasick,
of PASSAGE_WORDS words at most, and all documents of the shard stream through
them. An automaton finds the first HEAD words of a passage, and the others are compared on the
spot. This alone says where a passage occurs, by its words: a fingerprint
shared by chance brings a passage to a shard where nothing matches it. A word
goes if an occurrence covers it that is not the first one of its window.

Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. The first
occurrence is that in the smallest doc_id, then (rows with the same doc_id and
different texts) in the smaller row hash, then the earliest start; rows equal in
doc_id and text are one document, and each returns its result.

Cases: null, empty and wordless texts have no words, nothing is removed and the hash is
that of no bytes; a null doc_id comes before all others; texts shorter than a window
lose nothing; an empty table gives no rows; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsurf.llm import common, repeats

WIDTH = 20
GRAM = 1
BLOCK = 10
#: Bytes of text of a shard, on average.
SHARD = 4 << 20
#: Words of a passage that stand in the automaton.
HEAD = 6
#: Words of passages in one automaton, whose distinct words are numbered by SIGNS digits of 32.
PASSAGE_WORDS = 1 << 20
SIGNS = 4


def symbols(column) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = common.text_buffer(column)
    starts, ends, first = common.word_bounds(raw, offsets)
    return common.word_hashes(raw, starts, ends), first


def content(column, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[bytes]:
    """`size` words from word `at` of text `row`, with the white space between them."""
    raw, offsets = common.text_buffer(column)
    starts, ends, first = common.word_bounds(raw, offsets)
    text, begin = raw.tobytes(), first[row] + at
    return [text[a:z] for a, z in zip(starts[begin].tolist(), ends[begin + size - 1].tolist(), strict=True)]


def _signs():
    """Numbers from 1 on as SIGNS characters each, those of each place its own 32, as a node of the automaton looks through its children one by one."""
    digits = [[chr(k * 32 + i) for i in range(32)] for k in range(SIGNS)]
    return itertools.islice(map("".join, itertools.product(*digits)), 1, None)


#: A word that no passage holds.
NO_SIGNS = "\xff" * SIGNS


def locate(words: list[list[bytes]], passages: list[tuple[list[bytes], list[tuple[int, int, tuple]]]]) -> list[list[tuple[int, int, tuple]]]:
    """Start, stop and value of each occurrence, in each text, of the passages.

    passages: words, and of each run of them to be found its start, its size and its value; of equal runs the least value counts.
    The automaton holds the first HEAD words of each run; what follows them is compared where they are met.
    """
    import ahocorasick

    hits: list[list[tuple[int, int, tuple]]] = [[] for _ in words]
    at = 0
    while at < len(passages):
        signs: dict[bytes, str] = defaultdict(_signs().__next__)
        keys: dict[str, tuple] = {}
        size = 0
        while at < len(passages) and (not size or size + len(passages[at][0]) <= PASSAGE_WORDS):
            own, runs = passages[at]
            line = "".join(map(signs.__getitem__, own))
            for start, n, value in runs:
                key = line[start * SIGNS : (start + n) * SIGNS]
                old = keys.setdefault(key, value)
                if value < old:
                    keys[key] = value
            size += len(own)
            at += 1
        heads: dict[str, list[tuple[str, int, tuple]]] = defaultdict(list)
        for key, value in keys.items():
            heads[key[: HEAD * SIGNS]].append((key, len(key) // SIGNS, value))
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for head, tails in heads.items():
            machine.add_word(head, (len(head) - 1, tails))
        machine.make_automaton()
        for found, ws in zip(hits, words, strict=True):
            line = "".join(map(signs.get, ws, itertools.repeat(NO_SIGNS)))
            begins = line.startswith
            for end, (back, tails) in machine.iter(line):
                start = end - back
                word = start // SIGNS
                for key, n, value in tails:
                    if begins(key, start):
                        found.append((word, word + n, value))
    return hits


def routed_passages(right) -> list[tuple[list[bytes], list[tuple[int, int, tuple]]]]:
    """What locate() takes, of an Arrow table lo, content, runs."""
    import pyarrow as pa

    runs = right["runs"].combine_chunks()
    if isinstance(runs, pa.ChunkedArray):
        runs = pa.concat_arrays(runs.chunks) if runs.num_chunks else pa.array([], runs.type)
    size = runs.value_lengths().fill_null(0).to_numpy()
    flat = dict(zip((f.name for f in runs.type.value_type), runs.flatten().flatten(), strict=True))
    start = flat["start"].to_numpy() - np.repeat(right["lo"].to_numpy(), size)
    values = zip(*(flat[c].to_pylist() if flat[c].null_count else flat[c].to_numpy().tolist() for c in ("doc_id", "uid", "at")), strict=True)
    each = iter(zip(start.tolist(), flat["words"].to_numpy().tolist(), values, strict=True))
    return [(c.split(), list(itertools.islice(each, n))) for c, n in zip(right["content"].to_pylist(), size.tolist(), strict=True)]


def cut(words: list[bytes], owner: tuple[int, int], found: list[tuple[int, int, tuple]]) -> tuple[int, int, bytes]:
    """words, removed words and the rest of one text; owner: its doc_id and row hash."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, stop, value in found:
        if (*owner, start) > value:  # not the first occurrence
            edge[start] += 1
            edge[stop] -= 1
    keep = np.cumsum(edge)[:-1] == 0
    kept = words if keep.all() else list(itertools.compress(words, keep.tolist()))
    return len(words), len(words) - len(kept), b" ".join(kept)


def confirmed(found: repeats.Repeats, width: int) -> DataFrame:
    """near, far, of0, bucket (of the piece that holds the words) and runs of the passages: start, words, and doc_id, uid, at of the first occurrence."""
    here = lambda i: F.struct(F.col("doc_id"), F.col("uid"), F.col("at") + i)
    earlier = F.filter(F.coalesce("edge", F.array().cast("array<struct<i:int,doc_id:bigint,uid:bigint,at:int>>")), lambda e: F.struct(e["doc_id"], e["uid"], e["at"]) < here(e["i"]))
    whole = F.struct(F.col("at").alias("start"), (F.col("n") + (width - 1)).alias("words"), "doc_id", "uid", "at")
    some = F.transform(earlier, lambda e: F.struct((F.col("at") + e["i"]).alias("start"), F.lit(width).alias("words"), e["doc_id"].alias("doc_id"), e["uid"].alias("uid"), e["at"].alias("at")))
    runs = F.when(F.col("times") > 1, F.concat(F.array(whole), some)).otherwise(some)
    return found.classes.select("near", "far", F.col("uid").alias("of0"), F.floor(F.col("at") / repeats.PIECE).cast("int").alias("bucket"), runs.alias("runs")).filter("size(runs) > 0")


def remove(docs: DataFrame, keep: list[str], texts: bool, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """The columns `keep`, n_words, n_removed, kept_sha256 and, with `texts`, the kept text of each row of docs(uid, doc_id, text, ...)."""
    spark = docs.sparkSession
    own = docs.select("uid", "doc_id", "text")
    found = repeats.Repeats(own, repeats.met_items(own, symbols, width, gram, block), symbols, width, content)
    bytes_all = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(common.n_parts(spark), -(-bytes_all // SHARD))
    shard = F.pmod(F.col("uid"), F.lit(shards)).alias("shard")
    # which shard needs which runs of which piece: a row for each class that it holds, then one for each piece
    asked = found.met.select(shard, "near", "far").distinct().join(confirmed(found, width), ["near", "far"])
    asked = asked.groupBy("shard", "of0", "bucket").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    asked, asked_path = common.write_table(asked, "passages-asked")
    common.drop_table(spark, found.met_path)
    common.drop_table(spark, found.classes_path)
    common.free(spark)
    pieces = found.pieces.withColumnRenamed("uid", "of0")
    routed, _ = common.write_table(asked.join(pieces, ["of0", "bucket"]).select("shard", "lo", "content", "runs"), "passages")
    common.drop_table(spark, asked_path)
    common.drop_table(spark, found.pieces_path)
    common.free(spark)

    # rows equal in doc_id and text would meet in one shard, however many they are: one of them goes there
    repeated = bool(docs.groupBy("uid").count().filter("count > 1").limit(1).count())
    kinds = dict(docs.dtypes)
    carried = [] if repeated else keep
    own = docs.select("uid", "doc_id", "text", shard, *(F.col(c).alias(f"_keep_{k}") for k, c in enumerate(carried)))
    if repeated:
        own = own.dropDuplicates(["uid"])
    names = ["uid", *(f"_keep_{k}" for k in range(len(carried))), "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts
    schema = "uid long, " + "".join(f"_keep_{k} {kinds[c]}, " for k, c in enumerate(carried)) + "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts

    def stream(left, right):
        import pyarrow as pa

        words = [t.split() for t in left["text"].cast(pa.binary()).to_pylist()]
        passages = routed_passages(right)
        owners = zip(left["doc_id"].fill_null(repeats.LOW).to_pylist(), left["uid"].to_pylist(), strict=True)
        got = [cut(w, owner, f) for w, owner, f in zip(words, owners, locate(words, passages), strict=True)]
        cols = [left["uid"], *(left[f"_keep_{k}"] for k in range(len(carried)))]
        cols += [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())]
        if texts:
            cols.append(pa.array([g[2].decode("utf-8", "replace") for g in got], pa.string()))
        return pa.Table.from_arrays(cols, names)

    out = own.groupBy("shard").cogroup(routed.groupBy("shard")).applyInArrow(stream, schema)
    if repeated:
        rows = docs.select("uid", *(F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)))
        out = rows.join(out, "uid")
    return out.select(*(F.col(f"_keep_{k}").alias(c) for k, c in enumerate(keep)), *names[1 + len(carried) :])


def remove_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    return remove(repeats.with_uid(docs), ["doc_id"], texts=False)


def brute(texts: list[tuple[int, str | None]], width: int = WIDTH) -> dict[int, tuple[int, int, str]]:
    """Every window looked up, for tests; doc_ids are distinct."""
    first: dict[tuple, tuple] = {}
    out = {}
    for doc, t in sorted(texts, key=lambda x: x[0]):
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if first.setdefault(tuple(ws[i : i + width]), (doc, i)) < (doc, i):
                gone[i : i + width] = [True] * width
        out[doc] = (len(ws), sum(gone), hashlib.sha256(b" ".join([w for w, g in zip(ws, gone, strict=True) if not g])).hexdigest())
    return out


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
seen AS (SELECT k, min({'d': doc_id, 'i': i}) AS early, count(*) AS n FROM win GROUP BY k HAVING count(*) > 1),
dup AS (SELECT doc_id, i FROM win JOIN seen USING (k) WHERE {'d': doc_id, 'i': i} > early),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM dup, range(20) r(o)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT words.doc_id, count(*) AS n_words, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (gone.j IS NULL) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j GROUP BY words.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(common.read_docs(spark, sf_dir))
