"""Point-cloud files as bytes: whole blocks of rows in, whole blocks out.

Each writer makes one file of each Arrow batch of rows, so that a cloud of any size is a
folder of files; readers take the rows of Spark's binaryFile source (path, content).
Layouts are fixed by the formats: 32-byte .splat records, 17-float .ply vertices, .spz
version 2 columns, and a chunked container of a JSON manifest and named chunks.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLY_FIELDS = ("x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")
SPLAT = np.dtype([("pos", "<f4", 3), ("scale", "<f4", 3), ("rgba", "u1", 4), ("rot", "u1", 4)])
SPZ_MAGIC = 0x5053474E
PGS_MAGIC, PGS_MAJOR = b"PGS1", 1


def to_splat(p: pd.DataFrame) -> bytes:
    """x, y, z, s0, s1, s2 floats and r, g, b, a, q0..q3 bytes."""
    out = np.zeros(len(p), SPLAT)
    out["pos"], out["scale"] = p[["x", "y", "z"]], p[["s0", "s1", "s2"]]
    out["rgba"], out["rot"] = p[["r", "g", "b", "a"]], p[["q0", "q1", "q2", "q3"]]
    return out.tobytes()


def from_splat(b: bytes) -> pd.DataFrame:
    if len(b) % SPLAT.itemsize:
        raise ValueError("not a whole number of 32-byte records")
    a = np.frombuffer(b, SPLAT)
    cols = {c: a["pos"][:, i].astype("f8") for i, c in enumerate("xyz")} | {f"s{i}": a["scale"][:, i].astype("f8") for i in range(3)}
    return pd.DataFrame(cols | {c: a["rgba"][:, i].astype("i4") for i, c in enumerate("rgba")} | {f"q{i}": a["rot"][:, i].astype("i4") for i in range(4)})


SPLAT_COLUMNS = "x double, y double, z double, s0 double, s1 double, s2 double, r int, g int, b int, a int, q0 int, q1 int, q2 int, q3 int"


def to_ply(p: pd.DataFrame) -> bytes:
    head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {len(p)}", *(f"property float {f}" for f in PLY_FIELDS), "end_header", ""])
    return head.encode() + p[list(PLY_FIELDS)].to_numpy("<f4").tobytes()


def from_ply(b: bytes) -> pd.DataFrame:
    """Columns as the header names them."""
    cut = b.index(b"end_header\n") + len(b"end_header\n")
    lines = b[:cut].decode("ascii").splitlines()
    n = next(int(x.split()[2]) for x in lines if x.startswith("element vertex"))
    names = [x.split()[2] for x in lines if x.startswith("property float")]
    return pd.DataFrame(np.frombuffer(b, "<f4", n * len(names), cut).reshape(n, len(names)).astype("f8"), columns=names)


def to_spz(p: pd.DataFrame) -> bytes:
    """fx, fy, fz fixed-point integers and byte columns alpha, c0..c2, l0..l2, q1..q3, one column after another."""
    fixed = p[["fx", "fy", "fz"]].to_numpy("<i4").reshape(-1, 1).view("u1")[:, :3].tobytes()
    cols = [p[c].to_numpy("u1").tobytes() for c in (["alpha"], ["c0", "c1", "c2"], ["l0", "l1", "l2"], ["q1", "q2", "q3"])]
    return struct.pack("<IIIBBBB", SPZ_MAGIC, 2, len(p), 0, 12, 0, 0) + fixed + b"".join(cols)


def spz_header(b: bytes) -> dict:
    magic, version, n, degree, bits, flags, _ = struct.unpack_from("<IIIBBBB", b)
    if magic != SPZ_MAGIC or version != 2:
        raise ValueError("not a version 2 file")
    return {"n": n, "sh_degree": degree, "fraction_bits": bits, "antialiased": bool(flags & 1)}


def to_pgs(manifest: dict, chunks: dict[str, bytes]) -> bytes:
    """Magic, version, manifest length and text, then id, length and bytes of each chunk."""
    text = json.dumps(manifest, sort_keys=True).encode()
    out = [PGS_MAGIC, struct.pack("<HHI", PGS_MAJOR, 0, len(text)), text]
    for name, body in chunks.items():
        if len(name) != 4 or not name.isascii():
            raise ValueError("chunk names have four letters")
        out += [name.encode(), struct.pack("<I", len(body)), body]
    return b"".join(out)


def from_pgs(b: bytes) -> tuple[dict, dict[str, bytes]]:
    """Manifest and chunks; unknown chunks are kept, newer major versions and trailing bytes refused."""
    if b[:4] != PGS_MAGIC:
        raise ValueError("not a container")
    major, _, size = struct.unpack_from("<HHI", b, 4)
    if major > PGS_MAJOR:
        raise ValueError("written by a newer major version")
    at = 12 + size
    manifest, chunks = json.loads(b[12:at]), {}
    while at < len(b):
        if at + 8 > len(b):
            raise ValueError("trailing bytes")
        name, n = b[at : at + 4].decode("ascii"), struct.unpack_from("<I", b, at + 4)[0]
        if at + 8 + n > len(b):
            raise ValueError("a chunk is cut short")
        chunks[name] = b[at + 8 : at + 8 + n]
        at += 8 + n
    return manifest, chunks


def blocks(rows: DataFrame, write) -> DataFrame:
    """n, content: a file's bytes for each Arrow batch of rows."""

    def pack(batches):
        for p in batches:
            if len(p):
                yield pd.DataFrame({"n": [len(p)], "content": [write(p)]})

    return rows.mapInPandas(pack, "n long, content binary")


def rows_of(files: DataFrame, read, schema: str) -> DataFrame:
    """The rows of each file's bytes (column content)."""

    def unpack(batches):
        for p in batches:
            for b in p.content:
                yield read(b)

    return files.select("content").mapInPandas(unpack, schema)


def binary_scan(spark, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


PLANE_FILES = ("json", "alpha.u8", "raw.f32", "color.rgba8")


def to_plane_files(slot, width: int, height: int, alpha, raw, rgba, **meta) -> list[tuple[str, bytes]]:
    """Names and bytes of a view's raw planes and their JSON sidecar."""
    side = json.dumps({"width": width, "height": height, **meta}, sort_keys=True).encode()
    body = (side, np.asarray(alpha, "u1").tobytes(), np.asarray(raw, "<f4").tobytes(), np.asarray(rgba, "u1").tobytes())
    return [(f"{slot}.{end}", b) for end, b in zip(PLANE_FILES, body, strict=True)]


def plane_scan(files: DataFrame) -> DataFrame:
    """slot, x, y, alpha, raw, r, g, b of the raw planes among files(path, content); a slot without a sidecar or a plane is passed over.

    Planes that are not as long as the sidecar says raise an error.
    """
    pattern = r"([^/]+)\.(json|alpha\.u8|raw\.f32|color\.rgba8)$"
    part = lambda k: F.regexp_extract("path", pattern, k)
    each = files.select(part(1).alias("slot"), part(2).alias("kind"), "content").filter("slot <> ''")
    whole = each.groupBy("slot").agg(*(F.first(F.when(F.col("kind") == k, F.col("content")), ignorenulls=True).alias(f"f{i}") for i, k in enumerate(PLANE_FILES)))

    def unpack(batches):
        for p in batches:
            for slot, meta, alpha, raw, rgba in zip(p.slot, p.f0, p.f1, p.f2, p.f3, strict=True):
                m = json.loads(meta)
                n = m["width"] * m["height"]
                if (len(alpha), len(raw), len(rgba)) != (n, 4 * n, 4 * n):
                    raise ValueError(f"planes of {slot} do not have the size of their sidecar")
                y, x = np.divmod(np.arange(n), m["width"])
                c = np.frombuffer(rgba, "u1").reshape(n, 4).astype("i4")
                yield pd.DataFrame({"slot": slot, "x": x, "y": y, "alpha": np.frombuffer(alpha, "u1").astype("i4"), "raw": np.frombuffer(raw, "<f4").astype("f8"), "r": c[:, 0], "g": c[:, 1], "b": c[:, 2]})

    full = whole.dropna(subset=["f0", "f1", "f2", "f3"])
    return full.mapInPandas(unpack, "slot string, x int, y int, alpha int, raw double, r int, g int, b int")


def file_walk(spark, path: str) -> DataFrame:
    """path, bytes and gzipped bytes (level 9) of every file below a folder."""
    import zlib

    @F.pandas_udf("long")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda b: len(zlib.compress(bytes(b), 9, wbits=31)))

    return binary_scan(spark, path).select("path", F.col("length").alias("bytes"), packed("content").alias("gzip_bytes"))


#: Writer, bytes of a row, whether the file is gzipped.
WRITERS = {"splat": (to_splat, 32, False), "ply": (to_ply, 68, False), "spz": (to_spz, 19, True)}


def write_as(rows: DataFrame, kind: str) -> DataFrame:
    """n, content: files of rows in the format named, each format with its own rows and compression."""
    import gzip

    write, _, packed = WRITERS[kind]
    return blocks(rows, (lambda p: gzip.compress(write(p), mtime=0)) if packed else write)
