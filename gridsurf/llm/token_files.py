"""Token-ID / binary output (operator 8): Parquet files of token ids.

File format: one Parquet file per range of doc_id, files and rows in ascending
doc_id order. Columns: part INT, doc_id BIGINT, first BIGINT (ids of the same
file before this document), n_tokens BIGINT (with the end id), ids ARRAY<INT>.
`ids` is dictionary encoded (a vocabulary fits a dictionary page), the other
columns use the delta encodings of format v2; row groups and pages have set
sizes and every page has column and offset indexes, so that a reader can take
n_tokens alone, or the ids of a range of doc_id alone.

Cases: null or empty texts give the end id alone; rows with the same doc_id
stand side by side, ordered by their text's hash; a null doc_id sorts first; an empty table
gives empty files; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsurf.llm import common

FILE_SCHEMA = "part int, doc_id long, first long, n_tokens long, ids array<int>"

#: Layout of the files: bytes of a row group and of a page, and rows of a page at most.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",
}

#: Chunks that a worker remembers the ids of; beyond it the memory starts afresh.
CACHE_CHUNKS = 1 << 20

#: White space beyond ASCII as the pre-tokeniser sees it (fixed values).
_WIDE_SPACE = re.compile("[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Characters that some libraries take for white space and others do not (fixed values).
_UNSURE = re.compile("[\x1c-\x1f\x85\u180e]")

#: ASCII letters and digits; ASCII punctuation but for the apostrophe, which may start a contraction.
_ALNUM, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POINT[[c for c in range(0x21, 0x7F) if c != 0x27]] = True
_POINT &= ~_ALNUM


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which encodes each new chunk once.

    A chunk is a run of white space and what follows it up to the next one, or punctuation
    that follows a letter or digit. The byte-level pre-tokeniser never joins what stands on
    the two sides of such a cut, so that the ids of a text are those of its chunks.
    Texts that cannot be cut so (another pre-tokeniser, a special token spelled in the
    text, characters of which it is unsure whether they are white space) go to the library whole.
    """

    def __init__(self, path: str, cache: int = CACHE_CHUNKS):
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        marks = self.tok.get_added_tokens_decoder()
        self.marks = [t.content for t in marks.values()]
        self.mark = next(((t.content, i) for i, t in marks.items() if not (t.lstrip or t.rstrip or t.single_word)), None)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and self.mark is not None
        if self.plain:
            # chunks that the pre-tokeniser leaves whole skip it: the same model, told where they end by the sign of a zero byte
            shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that a byte-level vocabulary spells as themselves; the others follow from 0x100 on
            self.letters = {b: b if b in shown else 0x100 + sum(c not in shown for c in range(b)) for b in range(256)}
            self.zero = self.tok.token_to_id(chr(self.letters[0]))
            self.direct = Tokenizer.from_file(path)
            self.direct.pre_tokenizer = pre_tokenizers.Split(chr(self.letters[0]), "isolated")
            self.single = regex.compile(r" ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}'\x00]+)").fullmatch
        self.cache = cache
        self.forget()

    def forget(self) -> None:
        """Drops all remembered chunks: their numbers, and start and size of their ids in a pool."""
        self.known: dict[bytes, int] = {}
        self.at = np.empty((1 << 12, 2), np.int64)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, chunks: list[bytes]) -> None:
        """Encodes new chunks in a few calls and remembers them."""
        texts = [c.decode("utf-8", "surrogatepass") for c in chunks]
        one = [self.zero is not None and bool(self.single(t)) for t in texts]
        for direct in (True, False):
            own = [k for k, x in enumerate(one) if x is direct]
            for s in range(0, len(own), 16_384):
                part = own[s : s + 16_384]
                if direct:
                    spelled = b"\0".join([chunks[k] for k in part]).decode("latin-1").translate(self.letters)
                    ids, mark = np.array(self.direct.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.uint32), self.zero
                else:
                    ids, mark = self._whole(self.mark[0].join([texts[k] for k in part])), self.mark[1]
                cut = np.flatnonzero(ids == mark)
                if len(cut) != len(part) - 1:
                    raise ValueError("chunks and ids do not fit")
                start, stop = np.append(0, cut + 1), np.append(cut, len(ids))
                need = len(self.known) + len(part)
                if need > len(self.at):
                    self.at = np.concatenate([self.at, np.empty((need, 2), np.int64)])
                if self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.empty(max(len(ids), len(self.ids)), np.uint32)])
                self.ids[self.used : self.used + len(ids)] = ids
                self.at[len(self.known) : need, 0], self.at[len(self.known) : need, 1] = self.used + start, stop - start
                self.used += len(ids)
                self.known.update(zip([chunks[k] for k in part], range(len(self.known), need), strict=True))

    def _chunked(self, raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has."""
        import pyarrow as pa

        space = common.SPACE[raw]
        letter = _ALNUM[raw]
        if int(raw.max()) >= 0x80:
            accent = np.flatnonzero(raw[:-1] == 0xC3) + 1  # letters with accents, two bytes each, but for two signs
            letter[accent[(raw[accent] != 0x97) & (raw[accent] != 0xB7)]] = True
            text = raw.tobytes()
            if _WIDE_SPACE.search(text.decode("utf-8", "ignore")):
                for a in np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3)).tolist():
                    n = 2 if raw[a] == 0xC2 else 3
                    if _WIDE_SPACE.match(text[a : a + n].decode("utf-8", "ignore")):
                        space[a : a + n] = True
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[1:] |= _POINT[raw[1:]] & letter[:-1]
        begin[first[:-1][np.diff(first) > 0]] = True
        start = np.flatnonzero(begin)
        column = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(raw)).astype(np.int32)), pa.py_buffer(raw)])
        coded = column.dictionary_encode()
        values = coded.dictionary.to_pylist()
        number = list(map(self.known.get, values))
        new = [k for k, x in enumerate(number) if x is None]
        if new:
            if len(self.known) + len(new) > self.cache and self.known:
                self.forget()
                new = list(range(len(values)))
            self._learn([values[k] for k in new])
            for k in new:
                number[k] = self.known[values[k]]
        row = self.at[np.array(number, np.int64)][coded.indices.to_numpy()]
        before = np.append(0, np.cumsum(row[:, 1]))
        return self.ids[_runs(row[:, 0], row[:, 1])], np.diff(before[np.searchsorted(start, first)])

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string column in turn, and how many each has."""
        raw, first = common.text_buffer(column)
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(len(first) - 1, np.int64)
        text = raw.tobytes().decode("utf-8", "surrogatepass")
        if self.plain and not _UNSURE.search(text) and not any(m in text for m in self.marks):
            return self._chunked(raw, first)
        each = []
        for k, t in enumerate(column.to_pylist()):
            if not t:
                each.append(np.empty(0, np.uint32))
            elif self.plain and not _UNSURE.search(t) and not any(m in t for m in self.marks):
                each.append(self._chunked(raw[first[k] : first[k + 1]], np.array([0, first[k + 1] - first[k]]))[0])
            else:
                each.append(self._whole(t))
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of `size` places."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int, n_files: int | None = None) -> None:
    """Encodes docs(doc_id, text) and writes the files below `out`, n_files of them at most."""
    spark = docs.sparkSession
    common.tune(spark)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("h", F.xxhash64("text"))  # many rows may share a doc_id, or lack one
        .repartitionByRange(n_files or common.n_parts(spark), "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
    )

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        for whole in batches:
            for s, e in common.slices(whole.column(1), 2 << 20):
                b = whole.slice(s, e - s)
                ids, n = enc.encode(b.column(1))
                stop = np.cumsum(n + 1)
                values = np.insert(ids, np.cumsum(n), end_id).astype(np.int32)
                before = first + stop - n - 1
                first += len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), b.column(0), pa.array(before), pa.array(n + 1), pa.ListArray.from_arrays(pa.array(np.append(0, stop).astype(np.int32)), pa.array(values))],
                    ["part", "doc_id", "first", "n_tokens", "ids"],
                )

    writer = ordered.mapInArrow(encode, FILE_SCHEMA).write
    for k, v in LAYOUT.items():
        writer = writer.option(k, v)
    writer.parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def document_starts(files: DataFrame) -> DataFrame:
    """part and base: the ids of all files before. Reads the metadata columns alone; a row for each file."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))


def checksums(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the files."""
    common.tune(files.sparkSession)

    def crc(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column(4)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))
            starts = np.append(0, ends[:-1]) if len(ends) else ends
            got = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
            count = np.asarray(ends - starts, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(count), pa.array(got, pa.int64())], ["part", "doc_id", "first", "n_tokens", "ids_crc32"])

    rows = files.select("part", "doc_id", "first", "n_tokens", "ids").mapInArrow(crc, "part int, doc_id long, first long, n_tokens long, ids_crc32 long")
    # a row for each file, at most the partitions of the write
    return rows.join(F.broadcast(document_starts(files)), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = common.new_path(spark, "tokens")
    write_token_files(common.read_docs(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return checksums(read_token_files(spark, out))
