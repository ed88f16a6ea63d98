"""Queries of sources, sinks, catalogs, calibration and whole pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridsurf.functions import packing as P
from gridsurf.operators import cloud, stats
from gridsurf.operators import windows as N
from gridsurf.plans.clouds import _MOVE, _QT, _SRC, _vox, moved, quad, with_slot
from gridsurf.plans.fixtures import planes, points, r6, sql, table
from gridsurf.plans.grids import _L1, _box, fit_plane, normals, rim_calm, subject
from gridsurf.plans.scalars import _POSES, _ROT, poses
from gridsurf.sources import formats
from gridsurf.streaming import gestures

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return add


# --- sources and sinks ---------------------------------------------------------


@query("src_binary_scan", "SELECT count(*) FILTER (length > 0) AS files, bool_and(length > 0) AS filled FROM (SELECT 1 AS length FROM range(1))")
def _(s, d):
    f = formats.binary_scan(s, d, "region.parquet")
    return f.select("length").agg(F.count_if(F.col("length") > 0).alias("files"), F.bool_and(F.col("length") > 0).alias("filled"))


@query("src_validate_inputs", sql("planes", "SELECT vec_id, count(*) = 64 AS complete, min(alpha) >= 0 AND max(alpha) <= 255 AS ranged FROM planes GROUP BY vec_id"))
def _(s, d):
    whole = (F.max("x") + 1) * (F.max("y") + 1)
    return planes(s, d).groupBy("vec_id").agg((F.count("*") == whole).alias("complete"), ((F.min("alpha") >= 0) & (F.max("alpha") <= 255)).alias("ranged"))


def splat_rows(df):
    """Rows of the 32-byte record, and the key that viewers load by."""
    sx, sy = F.col("x") / 50, F.col("y") / 50
    w, x, y, z = P.unit_quaternion(F.col("nx"), F.col("ny"), F.col("nz"))
    rot = [P.clamp(P.half_up(c * 128 + 128), 0, 255).cast("int").alias(f"q{i}") for i, c in enumerate((w, x, y, z))]
    f = lambda c: c.cast("float").cast("double")
    thick = P.thickness(sx, sy)
    return df.select("pid", *(f(F.col(c)).alias(c) for c in "xyz"), f(sx).alias("s0"), f(sy).alias("s1"), f(thick).alias("s2"), "r", "g", "b", "a", *rot, (sx * sy * thick * (F.col("a") / 255.0)).alias("weight"))


_QW = "CASE WHEN nz > 0.999999 THEN {0} WHEN nz < -0.999999 THEN {1} ELSE {2} END"
_U8 = "CAST(least(255, greatest(0, floor(({0}) * 128 + 128 + 0.5))) AS INT)"
_QS = ", ".join(f"{_U8.format(_QW.format(*t))} AS q{i}" for i, t in enumerate(((1, 0, "sqrt((1 + nz) * 2) / 2"), (0, 1, "-ny / sqrt((1 + nz) * 2)"), (0, 0, "nx / sqrt((1 + nz) * 2)"), (0, 0, "0"))))
_TH = "greatest(0.35::DOUBLE * greatest(x / 50, y / 50), 1e-6::DOUBLE)"


@query("sink_splat_rows", sql("pts", f"SELECT pid, r, g, b, a, {_QS}, round(x / 50, 5) AS s0, round(x / 50 * (y / 50) * {_TH} * (a / 255.0::DOUBLE) * 1e6, 4) AS weight FROM pts"))
def _(s, d):
    df = splat_rows(points(s, d))
    # largest and most opaque first; the order is that of the files written
    df = df.orderBy(F.desc("weight"), "pid")
    return df.select("pid", "r", "g", "b", "a", "q0", "q1", "q2", "q3", F.round("s0", 5).alias("s0"), P.rounded(F.col("weight") * 1e6, 4).alias("weight"))


@query("codec_splat_decode", sql("pts", f"SELECT round(CAST(CAST(z AS FLOAT) AS DOUBLE), 5) AS z, r, g, b, a, {_QS} FROM pts"))
def _(s, d):
    rows = splat_rows(points(s, d)).drop("pid", "weight")
    return formats.rows_of(formats.blocks(rows, formats.to_splat), formats.from_splat, formats.SPLAT_COLUMNS).select(F.round("z", 5).alias("z"), "r", "g", "b", "a", "q0", "q1", "q2", "q3")


def ply_rows(df):
    sx, sy = F.greatest(F.col("x") / 50, F.lit(1e-6)), F.greatest(F.col("y") / 50, F.lit(1e-6))
    w, x, y, z = P.unit_quaternion(F.col("nx"), F.col("ny"), F.col("nz"))
    cols = ["x", "y", "z", "nx", "ny", "nz"]
    cols = [F.col(c) for c in cols] + [P.sh_dc(F.col(c) / 255.0) for c in "rgb"] + [P.logit(F.col("a") / 255.0), F.ln(sx), F.ln(sy), F.ln(P.thickness(sx, sy)), w, x, y, z]
    return df.select("pid", *(c.cast("double").alias(n) for c, n in zip(cols, formats.PLY_FIELDS, strict=True)))


_DC = "({0} / 255.0::DOUBLE - 0.5) / 0.28209479177387814::DOUBLE"
_OP = "ln(least(0.999::DOUBLE, greatest(0.001::DOUBLE, a / 255.0::DOUBLE)) / (1 - least(0.999::DOUBLE, greatest(0.001::DOUBLE, a / 255.0::DOUBLE))))"


@query("sink_ply_rows", sql("pts", f"SELECT pid, round({_DC.format('r')}, 6) AS f_dc_0, round({_DC.format('g')}, 6) AS f_dc_1, round({_OP}, 6) AS opacity, round(ln(greatest(x / 50, 1e-6::DOUBLE)), 6) AS scale_0, round({_QW.format(1, 0, 'sqrt((1 + nz) * 2) / 2')}, 6) AS rot_0 FROM pts"))
def _(s, d):
    return ply_rows(points(s, d)).select("pid", *(r6(F.col(c), c) for c in ("f_dc_0", "f_dc_1", "opacity", "scale_0", "rot_0")))


@query("codec_ply_decode", sql("pts", f"SELECT round(CAST(CAST({_DC.format('r')} AS FLOAT) AS DOUBLE), 4) AS f_dc_0, round(CAST(CAST({_OP} AS FLOAT) AS DOUBLE), 4) AS opacity, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 4) AS z FROM pts"))
def _(s, d):
    rows = ply_rows(points(s, d)).drop("pid")
    got = formats.rows_of(formats.blocks(rows, formats.to_ply), formats.from_ply, ", ".join(f"{c} double" for c in formats.PLY_FIELDS))
    return got.select(*(F.round(c, 4).alias(c) for c in ("f_dc_0", "opacity", "z")))


def spz_rows(df):
    """Quantised columns of the compressed format."""
    sx, sy = F.greatest(F.col("x") / 50, F.lit(1e-6)), F.greatest(F.col("y") / 50, F.lit(1e-6))
    logs = [P.u8_cut(P.half_up((F.ln(c) + 10) * 16)).alias(f"l{i}") for i, c in enumerate((sx, sy, P.thickness(sx, sy)))]
    quat = P.unit_quaternion(F.col("nx"), F.col("ny"), F.col("nz"))
    sign = F.when(quat[0] < 0, -1.0).otherwise(1.0)
    rot = [P.u8_cut(P.half_up(quat[i] * sign * 127.5 + 127.5)).alias(f"q{i}") for i in (1, 2, 3)]
    fixed = [P.half_up(F.col(c) * 4096).cast("int").alias(f"f{c}") for c in "xyz"]
    return df.select("pid", *fixed, F.col("a").alias("alpha"), *(P.spz_colour(F.col(c) / 255.0).alias(f"c{i}") for i, c in enumerate("rgb")), *logs, *rot)


_SPZ_C = "CAST(least(255, greatest(0, floor(" + _DC + " * 0.15::DOUBLE * 255 + 127.5 + 0.5))) AS INT)"
_SPZ_F = "CAST(floor({0} * 4096 + 0.5) AS INT) AS f{0}"
_SPZ_L = "CAST(least(255, greatest(0, floor((ln({0}) + 10) * 16 + 0.5))) AS INT)"
_SPZ_S = [f"greatest({c} / 50, 1e-6::DOUBLE)" for c in "xy"]
_SPZ_Q = "CAST(least(255, greatest(0, floor(({0}) * 127.5 + 127.5 + 0.5))) AS INT)"
_SPZ = ["pid", *(_SPZ_F.format(c) for c in "xyz"), "a AS alpha", *(f"{_SPZ_C.format(c)} AS c{i}" for i, c in enumerate("rgb"))]
_SPZ += [f"{_SPZ_L.format(c)} AS l{i}" for i, c in enumerate([*_SPZ_S, f"greatest(0.35::DOUBLE * greatest({', '.join(_SPZ_S)}), 1e-6::DOUBLE)"])]
_SPZ += [f"{_SPZ_Q.format(_QW.format(*t))} AS q{i}" for i, t in enumerate(((0, 1, "-ny / sqrt((1 + nz) * 2)"), (0, 0, "nx / sqrt((1 + nz) * 2)"), (0, 0, "0")), 1)]


@query("sink_spz_rows", sql("pts", f"SELECT {', '.join(_SPZ)} FROM pts"))
def _(s, d):
    return spz_rows(points(s, d))


@query("codec_spz_header", sql("pts", "SELECT count(*) AS n, true AS sized, 12 AS fraction_bits FROM pts"))
def _(s, d):
    files = formats.blocks(spz_rows(points(s, d)).drop("pid"), formats.to_spz)
    # the header is read by expressions
    by = lambda at, k: F.conv(F.hex(F.substring("content", at + k, 1)), 16, 10).cast("long")
    u32 = lambda at: by(at, 0) + by(at, 1) * 256 + by(at, 2) * 65536 + by(at, 3) * 16777216
    h = files.select(u32(1).alias("magic"), u32(5).alias("version"), u32(9).alias("n"), by(14, 0).alias("bits"), F.octet_length("content").alias("size"))
    h = h.filter((F.col("magic") == formats.SPZ_MAGIC) & (F.col("version") == 2))
    return h.agg(F.sum("n").alias("n"), F.bool_and(F.col("size") == 16 + F.col("n") * 19).alias("sized"), F.max("bits").cast("int").alias("fraction_bits"))


def containers(s, d):
    """One container of each plane: depth in two byte planes and alpha."""
    code = P.half_up(F.col("depth") * 65535).cast("int")
    hi, lo = P.depth_split(code, 12)
    e = planes(s, d).select("vec_id", F.struct("y", "x", hi.cast("int").alias("hi"), lo.cast("int").alias("lo"), "alpha").alias("p")).groupBy("vec_id").agg(F.array_sort(F.collect_list("p")).alias("p"))

    def write(batches):
        import pandas as pd

        for b in batches:
            out = []
            for p in b.p:
                size = {"width": max(q["x"] for q in p) + 1, "height": max(q["y"] for q in p) + 1, "depthBits": 12}
                body = {name: bytes(q[k] for q in p) for name, k in (("DPTH", "hi"), ("DPTL", "lo"), ("ALFA", "alpha"))}
                out.append(formats.to_pgs(size, body))
            yield pd.DataFrame({"vec_id": b.vec_id, "content": out})

    return e.mapInPandas(write, "vec_id long, content binary")


@query("sink_pgs_manifest", "SELECT vec_id, 'DPTH' AS first_chunk, 8 AS width FROM embeddings")
def _(s, d):
    f = containers(s, d)
    size = F.conv(F.hex(F.substring("content", 9, 1)), 16, 10).cast("int") + 256 * F.conv(F.hex(F.substring("content", 10, 1)), 16, 10).cast("int")
    text = F.substring("content", F.lit(13), size).cast("string")
    return f.select("vec_id", F.substring("content", 13 + size, F.lit(4)).cast("string").alias("first_chunk"), F.get_json_object(text, "$.width").cast("int").alias("width"))


@query("codec_pgs_chunks", sql("planes", "SELECT vec_id, sum(CAST(floor(depth * 65535 + 0.5) AS INT) >> 8) AS high, sum(((CAST(floor(depth * 65535 + 0.5) AS INT) >> 4) & 15) << 4) AS low, sum(alpha) AS alpha FROM planes GROUP BY vec_id"))
def _(s, d):
    def read(batches):
        import pandas as pd

        for b in batches:
            rows = [formats.from_pgs(c)[1] for c in b.content]
            yield pd.DataFrame({"vec_id": b.vec_id, **{n: [sum(r[k]) for r in rows] for n, k in (("high", "DPTH"), ("low", "DPTL"), ("alpha", "ALFA"))}})

    return containers(s, d).mapInPandas(read, "vec_id long, high long, low long, alpha long")


MANIFEST = """{"models": [
 {"id": "depth", "role": "depth", "variants": [{"mode": "fp16", "file": "depth_fp16.onnx", "bytes": 1200}, {"mode": "uint8", "file": "depth_u8.onnx", "bytes": 700}], "byBackend": {"webgpu": "depth_fp16.onnx", "wasm": "depth_u8.onnx"}},
 {"id": "matte", "role": "matte", "variants": [{"mode": "uint8", "file": "matte_u8.onnx", "bytes": 300}], "byBackend": {}},
 {"id": "inpaint", "role": "inpaint", "variants": [{"mode": "fp32", "file": "inpaint.onnx", "bytes": 900}, {"mode": "fp32", "file": "depth_u8.onnx", "bytes": 700}], "byBackend": {"webgpu": "inpaint.onnx"}}]}"""
_VAR = "array<struct<mode:string,file:string,bytes:bigint>>"
_MODELS = "m(id, role, webgpu, wasm, first) AS (VALUES ('depth', 'depth', 'depth_fp16.onnx', 'depth_u8.onnx', 'depth_fp16.onnx'), ('matte', 'matte', NULL, NULL, 'matte_u8.onnx'), ('inpaint', 'inpaint', 'inpaint.onnx', NULL, 'inpaint.onnx')), v(id, mode, file, bytes) AS (VALUES ('depth', 'fp16', 'depth_fp16.onnx', 1200), ('depth', 'uint8', 'depth_u8.onnx', 700), ('matte', 'uint8', 'matte_u8.onnx', 300), ('inpaint', 'fp32', 'inpaint.onnx', 900), ('inpaint', 'fp32', 'depth_u8.onnx', 700))"


def manifest(s):
    """One row for each model of a manifest text."""
    kind = f"struct<models:array<struct<id:string,role:string,variants:{_VAR},byBackend:map<string,string>>>>"
    return s.createDataFrame([(MANIFEST,)], "text string").select(F.explode(F.from_json("text", kind)["models"]).alias("m")).select("m.*")


@query("catalog_manifest", "WITH " + _MODELS + " SELECT id, role, mode, file, CAST(bytes AS BIGINT) AS bytes FROM m JOIN v USING (id)")
def _(s, d):
    return manifest(s).select("id", "role", F.explode("variants").alias("v")).select("id", "role", "v.*")


@query("catalog_registry", "WITH " + _MODELS + ", b AS (SELECT id, 'webgpu' AS backend, coalesce(webgpu, wasm, first) AS file FROM m UNION ALL SELECT id, 'wasm', coalesce(wasm, webgpu, first) FROM m) SELECT * FROM b")
def _(s, d):
    return chosen(s)


def chosen(s):
    """The file of each model for each backend: its own, else any other backend's, else the first variant."""
    m = manifest(s).select("id", "variants", "byBackend", F.explode(F.array(F.lit("webgpu"), F.lit("wasm"))).alias("backend"))
    any_ = F.get(F.map_values("byBackend"), 0)
    return m.select("id", "backend", F.coalesce(F.col("byBackend")[F.col("backend")], any_, F.col("variants")[0]["file"]).alias("file"))


@query("catalog_bytes", "WITH " + _MODELS + ", b AS (SELECT id, 'webgpu' AS backend, coalesce(webgpu, wasm, first) AS file FROM m UNION ALL SELECT id, 'wasm', coalesce(wasm, webgpu, first) FROM m) SELECT backend, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT backend, b.file, bytes FROM b JOIN v ON v.file = b.file) GROUP BY backend")
def _(s, d):
    size = manifest(s).select(F.explode("variants").alias("v")).select("v.file", "v.bytes").dropDuplicates(["file"])
    return chosen(s).select("backend", "file").distinct().join(size, "file").groupBy("backend").agg(F.sum("bytes").alias("bytes"))


# --- calibration ---------------------------------------------------------------


@query("calib_flatten_bands", sql("planes", """bd AS (SELECT unnest([0, 1, 2]) AS b), q AS (SELECT vec_id, bd.b AS b, list_sort(list(depth)) AS v FROM planes, bd WHERE alpha >= 128 AND y BETWEEN 2 * bd.b AND 2 * bd.b + 3 GROUP BY vec_id, bd.b HAVING count(*) >= 4),
st AS (SELECT vec_id, b, v[len(v) // 2 + 1] AS med, v[CAST(floor(0.98::DOUBLE * (len(v) - 1) + 0.5) AS INT) + 1] - v[CAST(floor(0.02::DOUBLE * (len(v) - 1) + 0.5) AS INT) + 1] AS spread FROM q),
sm AS (SELECT a.vec_id, a.b, avg(c.med) AS med, avg(c.spread) AS spread FROM st a JOIN st c ON c.vec_id = a.vec_id AND abs(c.b - a.b) <= 1 GROUP BY ALL),
wt AS (SELECT y, b, w FROM (VALUES (0, 0, 1.0), (1, 0, 1.0), (2, 0, 0.75), (2, 1, 0.25), (3, 0, 0.25), (3, 1, 0.75), (4, 1, 0.75), (4, 2, 0.25), (5, 1, 0.25), (5, 2, 0.75), (6, 2, 1.0), (7, 2, 1.0)) t(y, b, w)),
ro AS (SELECT vec_id, y, sum(w * med) / sum(w) AS med, sum(w * spread) / sum(w) AS spread FROM sm JOIN wt USING (b) GROUP BY ALL)
SELECT p.vec_id, p.x, p.y, round(CASE WHEN ro.spread > 0.7::DOUBLE * 0.5 THEN ro.med + (depth - ro.med) * (0.7::DOUBLE * 0.5) / ro.spread ELSE depth END, 6) AS depth FROM planes p LEFT JOIN ro USING (vec_id, y) WHERE p.alpha >= 128"""))
def _(s, d):
    return flatten_bands(planes(s, d).filter(subject()), 0.35, 8).select("vec_id", "x", "y", r6(F.col("depth"), "depth"))


def flatten_bands(df, limit: float, height: int):
    """Compresses rows of planes of that height whose spread, smoothed over half-overlapping bands of four rows, passes the limit."""
    last = height // 2 - 2
    bands = df.select("vec_id", "depth", F.explode(F.filter(F.array(F.floor(F.col("y") / 2) - 1, F.floor(F.col("y") / 2)), lambda b: (b >= 0) & (b <= last))).alias("b"))
    q = bands.groupBy("vec_id", "b").agg(F.array_sort(F.collect_list("depth")).alias("v")).filter("size(v) >= 4")
    q = q.select("vec_id", "b", F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("med"), (stats.nearest_rank(F.col("v"), 0.98) - stats.nearest_rank(F.col("v"), 0.02)).alias("spread"))
    w = Window.partitionBy("vec_id").orderBy("b").rangeBetween(-1, 1)
    q = q.select("vec_id", "b", F.avg("med").over(w).alias("med"), F.avg("spread").over(w).alias("spread"))
    # rows between band centres take both bands' values by distance: each band spreads its weight over its rows
    row = F.explode(F.sequence(F.col("b") * 2 - 2, F.col("b") * 2 + 5))
    e = q.select("*", row.alias("y")).filter(F.col("y").between(0, height - 1))
    gap = F.abs(F.col("y") - (F.col("b") * 2 + 1.5))
    beyond = ((F.col("b") == 0) & (F.col("y") <= 1)) | ((F.col("b") == last) & (F.col("y") >= 2 * last + 2))
    e = e.withColumn("w", F.when(beyond, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - gap / 2))).filter("w > 0")
    r = e.groupBy("vec_id", "y").agg((F.sum(F.col("w") * F.col("med")) / F.sum("w")).alias("med"), (F.sum(F.col("w") * F.col("spread")) / F.sum("w")).alias("spread"))
    z = F.when(F.col("spread") > limit, F.col("med") + (F.col("depth") - F.col("med")) * limit / F.col("spread")).otherwise(F.col("depth"))
    return df.join(r, ["vec_id", "y"], "left").withColumn("depth", z)


_LUM = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"


@query("geom_hair_smooth", sql("planes", f"""fc AS (SELECT vec_id, list_sort(list({_LUM})) AS l FROM planes WHERE alpha >= 128 AND x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 GROUP BY vec_id HAVING count(*) >= 4),
h0 AS (SELECT p.vec_id, p.x, p.y, p.depth AS z, p.alpha >= 128 AND p.y <= 4 AND NOT (p.x BETWEEN 2 AND 5 AND p.y BETWEEN 2 AND 5) AND {_LUM} < 0.75::DOUBLE * fc.l[len(fc.l) // 2 + 1] AS hair FROM planes p LEFT JOIN fc USING (vec_id)),
""" + ", ".join(f"h{k} AS (SELECT a.vec_id, a.x, a.y, CASE WHEN a.hair THEN (SELECT avg(b.z) FROM h{k - 1} b WHERE b.vec_id = a.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.hair) ELSE a.z END AS z, a.hair FROM h{k - 1} a)" for k in (1, 2, 3)) + " SELECT vec_id, x, y, round(z, 6) AS z FROM h3"))
def _(s, d):
    return hair_smooth(planes(s, d), (2, 5), (2, 5), 4).select("vec_id", "x", "y", r6(F.col("z"), "z"))


def hair_smooth(df, face_x: tuple[int, int], face_y: tuple[int, int], lowest: int):
    """z: depths with hair smoothed; hair is what is darker than the face's median outside its box, down to row `lowest`."""
    df = df.withColumn("luma", P.luminance(F.col("r"), F.col("g"), F.col("b")))
    inner = F.col("x").between(*face_x) & F.col("y").between(*face_y)
    face = df.filter(subject() & inner).groupBy("vec_id").agg(F.array_sort(F.collect_list("luma")).alias("l")).filter("size(l) >= 4")
    face = face.select("vec_id", F.element_at("l", (F.floor(F.size("l") / 2) + 1).cast("int")).alias("skin"))
    df = df.join(face, "vec_id", "left").withColumn("hair", F.coalesce(subject() & (F.col("y") <= lowest) & ~inner & (F.col("luma") < 0.75 * F.col("skin")), F.lit(False))).withColumn("z", F.col("depth"))
    for _ in range(3):
        df = N.masked_box_mean(df, F.col("z"), F.col("hair"), 1, "m").withColumn("z", F.when(F.col("hair"), F.col("m")).otherwise(F.col("z"))).drop("m")
    return df


_PLANE = "(SELECT vec_id, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS bx, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS by_ FROM (SELECT vec_id, count(*) * sum(x * x) - sum(x) * sum(x) AS xx, count(*) * sum(x * y) - sum(x) * sum(y) AS xy, count(*) * sum(y * y) - sum(y) * sum(y) AS yy, count(*) * sum(x * {z}) - sum(x) * sum({z}) AS xz, count(*) * sum(y * {z}) - sum(y) * sum({z}) AS yz FROM (SELECT vec_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, {z} FROM sf) GROUP BY vec_id))"


@query("geom_face_relief", sql("planes", f"""sf AS (SELECT vec_id, x, y, depth, g / 255.0::DOUBLE AS face FROM planes), pf AS {_PLANE.format(z='face')}, pd AS {_PLANE.format(z='depth')},
tr AS (SELECT a.vec_id, a.x, a.y, avg(b.face) AS trend {_box('', 2, 'sf')} GROUP BY ALL)
SELECT sf.vec_id, sf.x, sf.y, round(depth + least(1.0, (least(sf.x, sf.y, 7 - sf.x, 7 - sf.y) + 0.5) / 3.0)::DOUBLE * ((face - trend) * (1 + depth) / 9 + least(0.05::DOUBLE, greatest(-0.05::DOUBLE, pf.bx - pd.bx)) * (sf.x - 3.5) + least(0.05::DOUBLE, greatest(-0.05::DOUBLE, pf.by_ - pd.by_)) * (sf.y - 3.5)), 6) AS z FROM sf JOIN tr USING (vec_id, x, y) JOIN pf USING (vec_id) JOIN pd USING (vec_id)"""))
def _(s, d):
    df = planes(s, d).withColumn("face", F.col("g") / 255.0)
    one = F.lit(1.0)
    pf = fit_plane(df, ["vec_id"], one, "face").select("vec_id", F.col("bx").alias("fx"), F.col("by").alias("fy"))
    pd = fit_plane(df, ["vec_id"], one, "depth").select("vec_id", F.col("bx").alias("dx"), F.col("by").alias("dy"))
    df = N.box_mean(df, "face", 2, "trend").join(pf, "vec_id").join(pd, "vec_id")
    w = F.least(one, (F.least("x", "y", 7 - F.col("x"), 7 - F.col("y")) + 0.5) / 3.0)
    tilt = P.clamp(F.col("fx") - F.col("dx"), -0.05, 0.05) * (F.col("x") - 3.5) + P.clamp(F.col("fy") - F.col("dy"), -0.05, 0.05) * (F.col("y") - 3.5)
    return df.select("vec_id", "x", "y", r6(F.col("depth") + w * ((F.col("face") - F.col("trend")) * (1 + F.col("depth")) / 9 + tilt), "z"))


def clipped(df):
    """Depth held to the robust range: the median and three scaled deviations, within the 1st and 99th ranked percents."""
    e = df.filter(subject()).groupBy("vec_id").agg(F.array_sort(F.collect_list("depth")).alias("v"))
    mid = (F.floor(F.size("v") / 2) + 1).cast("int")
    e = e.withColumn("med", F.element_at("v", mid))
    e = e.withColumn("sg", 1.4826 * F.element_at(F.array_sort(F.transform("v", lambda z: F.abs(z - F.col("med")))), mid))
    lo = F.greatest(stats.nearest_rank(F.col("v"), 0.01), F.col("med") - 3 * F.col("sg"))
    hi = F.least(stats.nearest_rank(F.col("v"), 0.99), F.col("med") + 3 * F.col("sg"))
    e = e.select("vec_id", lo.alias("lo"), hi.alias("hi"))
    return df.join(e, "vec_id").withColumn("depth", F.greatest("lo", F.least("hi", "depth"))).drop("lo", "hi")


def calibrated(df):
    """Clipped, calmed at the rim and coded in 16 bits over the subject's range."""
    df = rim_calm(clipped(df), "depth", 2, 3)
    w = Window.partitionBy("vec_id")
    df = df.select("*", F.min(F.when(subject(), F.col("depth"))).over(w).alias("near"), F.max(F.when(subject(), F.col("depth"))).over(w).alias("far"))
    unit = P.clamp((F.col("depth") - F.col("near")) / F.greatest(F.col("far") - F.col("near"), F.lit(1e-9)), 0.0, 1.0)
    return df.withColumn("unit", F.when(subject(), unit).otherwise(1.0))


_CALIB = f"""q0 AS (SELECT vec_id, list_sort(list(depth)) AS v FROM planes WHERE alpha >= 128 GROUP BY vec_id), q1 AS (SELECT *, v[len(v) // 2 + 1] AS med FROM q0), q2 AS (SELECT *, 1.4826::DOUBLE * list_sort(list_transform(v, lambda z: abs(z - med)))[len(v) // 2 + 1] AS sg FROM q1),
cl AS (SELECT p.vec_id, p.x, p.y, p.alpha, greatest(greatest(q2.v[CAST(floor(0.01::DOUBLE * (len(q2.v) - 1) + 0.5) AS INT) + 1], med - 3 * sg), least(least(q2.v[CAST(floor(0.99::DOUBLE * (len(q2.v) - 1) + 0.5) AS INT) + 1], med + 3 * sg), depth)) AS depth FROM planes p JOIN q2 USING (vec_id)),
mm AS (SELECT a.vec_id, a.x, a.y, max(a.depth) AS z, max(a.alpha) AS alpha, coalesce(avg(CASE WHEN b.alpha >= 128 THEN b.depth END), max(a.depth)) AS mean {_box('', 2, 'cl')} GROUP BY ALL),
rc AS (SELECT mm.vec_id, mm.x, mm.y, alpha, CASE WHEN alpha >= 128 AND dd < 3 THEN z * dd / 3.0::DOUBLE + mean * (1 - dd / 3.0::DOUBLE) ELSE z END AS z FROM mm JOIN (SELECT vec_id, x, y, CASE WHEN l1 = 0 THEN 0 WHEN l1 < 3 THEN l1 - 1 ELSE 3 END AS dd FROM l) USING (vec_id, x, y)),
ca AS (SELECT *, CASE WHEN alpha >= 128 THEN least(1, greatest(0, (z - near) / greatest(far - near, 1e-9::DOUBLE))) ELSE 1 END AS unit FROM (SELECT *, min(CASE WHEN alpha >= 128 THEN z END) OVER (PARTITION BY vec_id) AS near, max(CASE WHEN alpha >= 128 THEN z END) OVER (PARTITION BY vec_id) AS far FROM rc))"""


@query("calib_full", sql("planes", _L1 + ", " + _CALIB + " SELECT vec_id, x, y, round(unit, 5) AS unit, round(near, 5) AS near, round(far, 5) AS far FROM ca"))
def _(s, d):
    return calibrated(planes(s, d)).select("vec_id", "x", "y", F.round("unit", 5).alias("unit"), F.round("near", 5).alias("near"), F.round("far", 5).alias("far"))


@query("pipeline_single", sql("planes", _QT + ", cs AS (SELECT vec_id, count(*) AS cells, sum(inside) AS pixels, min(1 + m) AS near, max(1 + m) AS far FROM ce GROUP BY vec_id), n AS (SELECT vec_id, count(*) AS k FROM planes WHERE alpha >= 128 GROUP BY vec_id) SELECT vec_id, cells, CAST(pixels AS BIGINT) AS pixels, round(near, 6) AS near, round(far, 6) AS far, k AS normals FROM cs JOIN n USING (vec_id)"))
def _(s, d):
    df = planes(s, d)
    cells = quad(df).groupBy("vec_id").agg(F.count("*").alias("cells"), F.sum("inside").alias("pixels"), r6(F.min(1 + F.col("m_depth")), "near"), r6(F.max(1 + F.col("m_depth")), "far"))
    return cells.join(normals(df).groupBy("vec_id").agg(F.count("*").alias("normals")), "vec_id")


@query("pipeline_multi", sql("pts", _MOVE.format(on=f"slot = {_SRC}") + ", un AS (SELECT pid, source, wx AS x, wy AS y, wz AS z, nx, ny, nz, face_on FROM mv), " + _vox("un", "v1", "0.0") + ", " + _vox("v1", "v2", "0.025::DOUBLE") + " SELECT source, count(*) AS kept, round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(avg(z), 6) AS z FROM v2 GROUP BY source", _POSES + ", " + _ROT))
def _(s, d):
    m = moved(with_slot(points(s, d)), poses(s)).select("pid", "source", *(F.col(f"w{c}").alias(c) for c in "xyz"), "nx", "ny", "nz", "face_on")
    kept = cloud.voxel_pass(cloud.voxel_pass(m, 0.05, 0.0), 0.05, 0.5)
    return kept.groupBy("source").agg(F.count("*").alias("kept"), r6(F.min("x"), "x0"), r6(F.max("x"), "x1"), r6(F.avg("z"), "z"))


_GEST = """p AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('view', 'signup') THEN 'down' WHEN event_type IN ('click', 'purchase') THEN 'move' ELSE 'up' END AS op, CAST(event_id % 2 AS INT) AS pointer, value AS px, value * 0.5 AS py FROM events),
m AS (SELECT a.event_id, a.user_id, a.pointer, a.px, a.py, arg_max({'op': b.op, 'px': b.px, 'py': b.py}, (b.ts, b.event_id)) AS k FROM p a JOIN p b ON a.user_id = b.user_id AND a.pointer = b.pointer AND b.op <> 'move' AND (b.ts, b.event_id) < (a.ts, a.event_id) WHERE a.op = 'move' GROUP BY ALL)
SELECT event_id, user_id, pointer, round(px - k.px, 6) AS dx, round(py - k.py, 6) AS dy FROM m WHERE k.op = 'down'"""


@query("stream_gesture_state", "WITH " + _GEST)
def _(s, d):
    return gestures.offsets(gestures.from_events(table(s, d, "events"))).select("event_id", "user_id", "pointer", r6(F.col("dx"), "dx"), r6(F.col("dy"), "dy"))
