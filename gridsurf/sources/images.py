"""PNG images as bytes: 8-bit grey, RGB and RGBA, not interlaced.

The codec is a pair of functions, so that another one can take its place (`CODECS`).
Damaged or foreign bytes raise ValueError; decodable() tells without raising.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the format's colour type.
SAMPLES = {0: 1, 2: 3, 6: 4}


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def to_png(pixels: np.ndarray) -> bytes:
    """Height x width x 1, 3 or 4 bytes."""
    h, w, k = pixels.shape
    kind = next(t for t, n in SAMPLES.items() if n == k)
    lines = np.zeros((h, 1 + w * k), np.uint8)  # each line begins with its filter, 0: none
    lines[:, 1:] = pixels.reshape(h, w * k)
    return SIGN + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, k: int) -> np.ndarray:
    """Bytes of the lines without their filters; lines: filter, then bytes; k: bytes of a pixel."""
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(lines.shape[1] - 1, np.int64)
    for y, line in enumerate(lines):
        rule, own = int(line[0]), line[1:].astype(np.int64)
        if rule == 2:
            own = own + above & 255
        elif rule == 1:
            own = np.cumsum(own.reshape(-1, k), 0).reshape(-1) & 255
        elif rule in (3, 4):
            for x in range(len(own)):
                a, b, c = (own[x - k], above[x], above[x - k]) if x >= k else (0, above[x], 0)
                if rule == 3:
                    guess = (a + b) // 2
                else:  # of left, above and upper left the one nearest to left + above - upper left
                    guess = min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
                own[x] = own[x] + guess & 255
        elif rule:
            raise ValueError("an unknown line filter")
        out[y], above = own, own
    return out


def from_png(b: bytes) -> np.ndarray:
    """Height x width x samples."""
    if b[:8] != SIGN:
        raise ValueError("not a PNG file")
    at, head, data = 8, None, []
    while at + 12 <= len(b):
        size = struct.unpack_from(">I", b, at)[0]
        name, body = b[at + 4 : at + 8], b[at + 8 : at + 8 + size]
        if at + 12 + size > len(b) or zlib.crc32(name + body) != struct.unpack_from(">I", b, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            data.append(body)
        elif name == b"IEND":
            break
        at += 12 + size
    else:
        raise ValueError("the file is cut short")
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise ValueError("only 8-bit grey, RGB and RGBA without interlace")
    w, h, k = head[0], head[1], SAMPLES[head[3]]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError("the pixels are damaged") from e
    if len(raw) != h * (1 + w * k):
        raise ValueError("the pixels are cut short")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(h, 1 + w * k), k).reshape(h, w, k)


#: Encoder and decoder by name.
CODECS: dict[str, tuple[Callable[[np.ndarray], bytes], Callable[[bytes], np.ndarray]]] = {"png": (to_png, from_png)}


def encode_planes(df: DataFrame, key: str, codec: str = "png") -> DataFrame:
    """key, content: an image of each plane of pixels(key, x, y, r, g, b, a)."""
    put = CODECS[codec][0]
    e = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b", "a"))).alias("p"))

    def write(batches):
        for t in batches:
            out = []
            for p in t.p:
                rows = np.array([[q[k] for k in ("y", "x", "r", "g", "b", "a")] for q in p], np.int64)
                image = np.zeros((rows[:, 0].max() + 1, rows[:, 1].max() + 1, 4), np.uint8)
                image[rows[:, 0], rows[:, 1]] = rows[:, 2:]
                out.append(put(image))
            yield pd.DataFrame({key: t[key], "content": out})

    return e.mapInPandas(write, f"`{key}` {dict(df.dtypes)[key]}, content binary")


def decode_images(files: DataFrame, key: str, codec: str = "png") -> DataFrame:
    """key, width, height, x, y, r, g, b, a of each pixel of files(key, content); grey and RGB images are opaque."""
    get = CODECS[codec][1]

    def read(batches):
        for t in batches:
            for k, b in zip(t[key], t.content, strict=True):
                image = get(b)
                h, w, n = image.shape
                rgba = np.full((h, w, 4), 255, np.uint8)
                rgba[:, :, :3], rgba[:, :, 3:] = image[:, :, : min(n, 3)], image[:, :, 3:] if n == 4 else 255
                y, x = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({key: k, "width": w, "height": h, "x": x, "y": y, **{c: rgba[:, :, i].ravel().astype("i4") for i, c in enumerate("rgba")}})

    return files.select(key, "content").mapInPandas(read, f"`{key}` {dict(files.dtypes)[key]}, width int, height int, x int, y int, r int, g int, b int, a int")


def decodable(content: Column, codec: str = "png") -> Column:
    """Whether the bytes are a whole image."""
    get = CODECS[codec][1]

    @F.pandas_udf("boolean")
    def test(s: pd.Series) -> pd.Series:
        def one(b):
            try:
                return b is not None and get(bytes(b)) is not None
            except ValueError:
                return False

        return s.map(one)

    return test(content)


def letterbox(pixels: DataFrame, key: str, side: int) -> DataFrame:
    """Images(key, width, height, x, y, r, g, b, a) scaled by their long side and centred in side x side, by the nearest pixel;
    what lies beside them repeats the border's colour with alpha 0.
    """
    k = F.lit(float(side)) / F.greatest("width", "height")
    size = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * k + 0.5)).cast("int")
    off = lambda c: F.floor((side - size(c)) / 2).cast("int")

    def spread(c: str, n: str) -> Column:
        # target places that read source place c; the first and the last take the margin too
        lo, hi = F.ceil(F.col(c) * size(n) / F.col(n)), F.ceil((F.col(c) + 1) * size(n) / F.col(n)) - 1
        lo = F.when(F.col(c) == 0, F.lit(0)).otherwise(lo + off(n))
        hi = F.when(F.col(c) == F.col(n) - 1, F.lit(side - 1)).otherwise(hi + off(n))
        return F.explode(F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))))

    out = pixels.select("*", spread("x", "width").alias("tx")).select("*", spread("y", "height").alias("ty"))
    inside = (F.col("tx") >= off("width")) & (F.col("tx") < off("width") + size("width")) & (F.col("ty") >= off("height")) & (F.col("ty") < off("height") + size("height"))
    return out.select(key, F.col("tx").alias("x"), F.col("ty").alias("y"), "r", "g", "b", F.when(inside, F.col("a")).otherwise(0).alias("a"))
