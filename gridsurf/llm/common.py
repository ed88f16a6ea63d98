"""Shared helpers: shared-folder tables, Arrow batches and vectorised text scanning."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch sent to a Python worker; a longer text is a batch of its own.
ARROW_ROWS = 512
ARROW_BYTES = 2 << 20

_own_shared: dict[str, str] = {}
#: Tables written by write_table and not dropped yet.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster is refused."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_shared:
        _own_shared[app] = "file://" + tempfile.mkdtemp(prefix="gridsurf-")
    return _own_shared[app]


def tune(spark: SparkSession) -> None:
    """Short Arrow batches for the Python stages that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/gridsurf/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if not _written:
        atexit.register(_drop_rest, spark)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table written by write_table; whatever reads it must be done."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def written() -> list[str]:
    """The tables that have been written and not dropped."""
    return list(_written)


def _drop_rest(spark: SparkSession) -> None:
    """At the end of the program: results are read by then, or never will be."""
    for path in written():
        try:
            drop_table(spark, path)
        except Exception:  # the session has ended; its owner cleans the shared folder
            return


def free(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_fold(col, mod: int):
    """crc32 of the value as text, modulo mod; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return bool(_LETTER.search(text.encode("utf-8", "ignore"))) or any(c.isalpha() for c in text)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, nulls as empty, and the n + 1 offsets into them."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes other than ASCII white space) and the first word of each text (n + 1 values)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    starts = np.flatnonzero(start)
    end = np.ones(n, bool)
    end[:-1] = ~inside[1:] | first[1:n]
    ends = np.flatnonzero(inside & end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_rng = np.random.default_rng(20240229)
#: Random odd multipliers for byte values and for positions in a word.
BYTE_MIX = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POS_MIX = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same for the same bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    at = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else None
    if at is None:
        head = np.zeros(starts[0], np.int64)
        at = np.concatenate([head, np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))])
    value = BYTE_MIX[raw] * POS_MIX[at & 4095] ^ (BYTE_MIX[raw] >> np.uint64(23)) * (at.astype(np.uint64) + np.uint64(1))
    value[SPACE[raw]] = 0
    return mix64(np.add.reduceat(value, starts) + length.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def slices(column, limit: int = 1 << 20):
    """Row ranges of an Arrow string column with about `limit` bytes of text each, one row at least."""
    _, offsets = text_buffer(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(stop, n)
        row = min(stop, n)


def joined(texts: list[str | None], gap: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by gap; starts and ends of the texts in them."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(size + len(gap)) - size - len(gap)
    return np.frombuffer(gap.join(parts) + gap, np.uint8), starts, starts + size


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, the same for the same input: those whose key hashes lowest."""
    return df.orderBy(F.xxhash64(F.col(key)), key).limit(rows)


#: Bytes of text that a fit may take to the driver.
SAMPLE_BYTES = 64 << 20


def within_bytes(rows: DataFrame, key: str, limit: int = SAMPLE_BYTES) -> DataFrame:
    """Of a bounded sample rows(key, text, ...) those, lowest hash first, whose texts hold `limit` bytes together."""
    order = Window.orderBy(F.xxhash64(F.col(key)), key)
    total = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_total", total).filter(F.col("_total") <= limit).drop("_total")
