"""Properties and edge cases of the engine's own operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsurf.functions import packing as P
from gridsurf.operators import cloud, graph, pyramid, stats
from gridsurf.operators import windows as N
from gridsurf.sources import formats
from gridsurf.streaming import gestures


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_half_floats_match_numpy(spark):
    v = np.concatenate([np.float32([0, 1, -1, 65504, 65520, 1e9, 6e-5, 1e-8, 0.1, 2049, -0.333, 1.0009765]), np.random.default_rng(1).normal(0, 10, 300).astype("f4")])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", P.half_code(F.col("v")).alias("c"))
    for r in df.collect():
        want = int(np.float32(r.v).astype(np.float16).view(np.uint16))
        if (want >> 10) & 31 == 0:  # subnormals go to zero
            want &= 0x8000
        assert r.c == want, r


def test_octahedral_round_trip(spark):
    rng = np.random.default_rng(2)
    n = rng.normal(size=(500, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    df = spark.createDataFrame(n.tolist(), "x double, y double, z double").withColumn("c", P.oct_encode(F.col("x"), F.col("y"), F.col("z")))
    x, y, z = P.oct_decode(F.col("c"))
    got = df.select(((x * F.col("x")) + y * F.col("y") + z * F.col("z")).alias("d"), "c").collect()
    assert min(r.d for r in got) > 1 - 1e-8 and all(0 <= r.c < 2**32 for r in got)
    assert one(spark, c=P.oct_encode(F.lit(0.0), F.lit(0.0), F.lit(0.0))).c == 32768 * 65536 + 32768


def test_rounding_rules(spark):
    r = one(spark, up=P.half_up(F.lit(-2.5)), even=P.u8(F.lit(2.5)), odd=P.u8(F.lit(3.5)), over=P.u8(F.lit(300.0)), cut=P.u8_cut(F.lit(2.9)))
    assert (r.up, r.even, r.odd, r.over, r.cut) == (-2, 2, 4, 255, 2)


@pytest.mark.parametrize("bits", [8, 10, 12, 16])
def test_depth_split_round_trip(spark, bits):
    df = spark.range(0, 65536, 97).select(F.col("id").cast("int").alias("c"))
    hi, lo = P.depth_split(F.col("c"), bits)
    df = df.select("c", hi.alias("h"), lo.alias("l"))
    worst = df.select(F.max(F.abs(P.depth_merge(F.col("h"), F.col("l"), bits) - F.col("c")))).first()[0]
    assert worst <= (1 << (16 - bits)) // 2 + (bits < 16)


def test_line_fit_is_the_identity_where_it_is_not_determined(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 1.0, 1.0), (2, 2.0, 3.0), (2, 3.0, 5.0)], "k int, x double, y double")
    got = {r.k: r for r in stats.fit_line(df, ["k"], F.col("x"), F.col("y")).collect()}
    assert got[1].slope == 1 and got[1].shift == 0 and got[1].rmse == float("inf")
    assert abs(got[2].slope - 2) < 1e-12 and abs(got[2].shift + 1) < 1e-12 and got[2].rmse < 1e-6


def plane(spark, a: np.ndarray, vec: int = 0):
    rows = [(vec, x, y, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "vec_id long, x int, y int, v double")


def grid(df, col, shape):
    out = np.zeros(shape)
    for r in df.select("x", "y", col).collect():
        out[r.y, r.x] = r[col]
    return out


def test_components_of_random_masks(spark):
    rng = np.random.default_rng(3)
    for diagonal in (False, True):
        a = (rng.random((20, 24)) < 0.5).astype(float)
        got = {(r.y, r.x): r.root for r in graph.label(plane(spark, a), F.col("v") > 0, diagonal).collect()}
        seen, groups = {}, 0
        for y, x in zip(*np.nonzero(a), strict=True):
            if (y, x) in seen:
                continue
            groups += 1
            stack = [(y, x)]
            while stack:
                p = stack.pop()
                if p in seen:
                    continue
                seen[p] = groups
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        q = (p[0] + dy, p[1] + dx)
                        if (diagonal or dy == 0 or dx == 0) and 0 <= q[0] < 20 and 0 <= q[1] < 24 and a[q] and q not in seen:
                            stack.append(q)
        assert set(got) == set(seen)
        assert len({(seen[k], got[k]) for k in seen}) == groups == len(set(got.values()))


def test_distance_and_nearest_match_brute_force(spark):
    rng = np.random.default_rng(4)
    a = (rng.random((9, 11)) < 0.8).astype(float)
    df = plane(spark, a)
    got = grid(graph.distance(df, F.col("v") == 0, "d"), "d", a.shape)
    out = np.argwhere(a == 0)
    want = np.array([[np.sqrt(((out - (y, x)) ** 2).sum(1).min()) for x in range(11)] for y in range(9)])
    assert np.allclose(got, want)
    near = grid(graph.nearest(df, F.col("v") == 0, F.col("y") * 100.0 + F.col("x"), "n"), "n", a.shape)
    for y in range(9):
        for x in range(11):
            k = min(out.tolist(), key=lambda p: ((p[0] - y) ** 2 + (p[1] - x) ** 2, p[0], p[1]))
            assert near[y, x] == k[0] * 100 + k[1]
    full = plane(spark, np.ones((3, 3)))
    assert (grid(graph.distance(full, F.col("v") == 0, "d"), "d", (3, 3)) == 1e10).all()


def test_border_distance_is_repeated_erosion(spark):
    rng = np.random.default_rng(5)
    a = (rng.random((12, 12)) < 0.85).astype(float)
    got = grid(N.border_distance(plane(spark, a), F.col("v") > 0, 4, "d"), "d", a.shape)
    cur, want = a > 0, np.where(a > 0, 4, 0)
    for k in range(1, 4):
        p = np.pad(cur, 1)
        nxt = cur & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
        want[cur & ~nxt & (want > k - 1)] = k - 1
        cur = nxt
    assert (got == want).all()


def test_pyramid_of_an_odd_plane_collapses_to_itself(spark):
    a = np.random.default_rng(6).normal(size=(7, 7))
    got = grid(pyramid.collapse(pyramid.laplacian(plane(spark, a), 7)), "v", (7, 7))
    assert np.allclose(got, a)


def test_quadtree_cells_tile_the_subject(spark):
    rng = np.random.default_rng(7)
    a = rng.random((8, 8))
    a[:4, :4] = 0.5
    df = plane(spark, a).withColumn("inside", F.lit(True))
    cells = pyramid.cells(pyramid.nodes(df, 3, ["v"]), 3, F.col("s_v") > 1e-3).collect()
    cover = np.zeros((8, 8), int)
    for c in cells:
        k = 1 << c.level
        cover[c.cy * k : (c.cy + 1) * k, c.cx * k : (c.cx + 1) * k] += 1
    assert (cover == 1).all() and any(c.level == 2 for c in cells)


def test_voxels_keep_the_source_that_faces_best(spark):
    p = spark.createDataFrame([("a", 0, 0.01, 0.01, 0.01, 0.0, 0.0, 1.0, 0.9), ("b", 1, 0.02, 0.02, 0.02, 0.0, 0.0, 1.0, 0.5), ("c", 1, 0.02, 0.02, 0.02, 0.0, 0.0, -1.0, 0.4), ("d", 1, 0.9, 0.9, 0.9, 0.0, 0.0, 1.0, 0.1)], "pid string, source int, x double, y double, z double, nx double, ny double, nz double, face_on double")
    assert {r.pid for r in cloud.voxel_pass(p, 0.05, 0.0).collect()} == {"a", "c", "d"}


def test_composite_equals_the_fold(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), float(z), float(c), float(a)) for k, z, c, a in zip(rng.integers(0, 3, 40), rng.random(40), rng.random(40), rng.random(40), strict=True)]
    got = {r.k: (r.c, r.cover) for r in cloud.composite(spark.createDataFrame(rows, "k int, z double, c double, a double"), ["k"], ["z"], "c", "a").collect()}
    for k in got:
        c = cover = 0.0
        for _, _, v, a in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            c, cover = c * (1 - a) + v * a, cover * (1 - a) + a
        assert abs(got[k][0] - c) < 1e-6 and abs(got[k][1] - cover) < 1e-6


def test_containers_round_trip_and_refuse_damage():
    b = formats.to_pgs({"w": 3}, {"ALFA": b"abc", "XTRA": b""})
    assert formats.from_pgs(b) == ({"w": 3}, {"ALFA": b"abc", "XTRA": b""})
    for bad in (b"nope" + b[4:], b + b"z", b[:-1], b[:4] + b"\x09\x00" + b[6:]):
        with pytest.raises(ValueError):
            formats.from_pgs(bad)
    with pytest.raises(ValueError):
        formats.from_splat(b"x" * 33)


def test_files_are_written_and_scanned(spark, tmp_path):
    import pandas as pd

    p = pd.DataFrame({f: np.arange(5, dtype=float) for f in formats.PLY_FIELDS})
    (tmp_path / "a.ply").write_bytes(formats.to_ply(p))
    files = formats.binary_scan(spark, str(tmp_path), "*.ply")
    got = formats.rows_of(files, formats.from_ply, ", ".join(f"{c} double" for c in formats.PLY_FIELDS))
    assert got.count() == 5 and got.agg(F.sum("rot_3")).first()[0] == 10


def test_gesture_stream_equals_the_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("user_id < 20")
    src = str(tmp_path / "in")
    ev.coalesce(1).write.parquet(src)
    stream = gestures.stream_offsets(gestures.from_events(spark.readStream.schema(ev.schema).parquet(src)))
    q = stream.writeStream.format("memory").queryName("gestures").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT event_id, user_id, pointer, round(dx, 6), round(dy, 6) FROM gestures").collect()}
    want = {tuple(r) for r in gestures.offsets(gestures.from_events(ev)).selectExpr("event_id", "user_id", "pointer", "round(dx, 6)", "round(dy, 6)").collect()}
    assert got == want and want


def test_empty_planes(spark):
    e = spark.createDataFrame([], "vec_id long, x int, y int, v double")
    assert N.box_mean(e, "v", 1, "m").count() == 0
    assert graph.label(e, F.col("v") > 0, True).count() == 0


def test_labels_of_wide_planes(spark):
    """Pixels that only a 12-bit place would join."""
    rows = [(7, 0, 1, 255), (7, 4096, 0, 255), (7, 5000, 3, 255), (7, 5001, 3, 255), (7, 5002, 4, 255), (8, 0, 1, 255)]
    got = graph.label(spark.createDataFrame(rows, "vec_id long, x int, y int, alpha int"), F.col("alpha") >= 128, True).collect()
    by = {(r.vec_id, r.x, r.y): r.root for r in got}
    assert len(set(by.values())) == 4 and by[(7, 5000, 3)] == by[(7, 5001, 3)] == by[(7, 5002, 4)]


def test_nearest_sites_of_a_row_match_brute_force():
    from gridsurf.operators.graph import lower

    rng = np.random.default_rng(9)
    for _ in range(400):
        xs = sorted(rng.choice(60, rng.integers(1, 20), replace=False).tolist())
        y = int(rng.integers(0, 9))
        sites = [(x, sy, (sy - y) ** 2) for x, sy in zip(xs, rng.integers(0, 9, len(xs)).tolist(), strict=True)]
        got = lower(sites, list(range(60)))
        want = [min(range(len(sites)), key=lambda k: (sites[k][2] + (sites[k][0] - p) ** 2, sites[k][1], sites[k][0])) for p in range(60)]
        assert got == want


def test_pyramids_of_any_size_match_the_kernel(spark):
    """Down and up of planes 64 x 48 cut to squares of odd and even sides, against sums over mirrored places."""
    rng = np.random.default_rng(4)
    kernel = np.array([1, 4, 6, 4, 1]) / 16
    mirror = lambda c, n: -1 - c if c < 0 else 2 * n - 1 - c if c >= n else c

    def taps(n, gain):
        m = np.zeros((n, n))
        for t in range(n):
            for k in range(-2, 3):
                m[t, mirror(t + k, n)] += kernel[k + 2] * gain
        return m

    for n in (2, 3, 5, 8, 13, 48):
        v = rng.random((n, n))
        df = spark.createDataFrame([(1, x, y, float(v[y, x])) for y in range(n) for x in range(n)], "vec_id long, x int, y int, v double")
        low = (taps(n, 1) @ v @ taps(n, 1).T)[::2, ::2]
        got = {(r.x, r.y): r.v for r in pyramid.down(df, n).collect()}
        assert len(got) == low.size and all(abs(got[(x, y)] - low[y, x]) < 1e-12 for y, x in np.ndindex(low.shape))
        wide = np.zeros((n, n))
        wide[::2, ::2] = low
        wide = taps(n, 2) @ wide @ taps(n, 2).T
        got = {(r.x, r.y): r.v for r in pyramid.up(pyramid.down(df, n), n).collect()}
        assert len(got) == n * n and all(abs(got[(x, y)] - wide[y, x]) < 1e-12 for y, x in np.ndindex(wide.shape))


def test_png_codec_and_its_filters():
    import struct
    import zlib

    from gridsurf.sources import images

    rng = np.random.default_rng(1)
    for k in (1, 3, 4):
        image = rng.integers(0, 256, (48, 64, k)).astype(np.uint8)
        assert (images.from_png(images.to_png(image)) == image).all()
    # lines filtered by hand, rule after rule
    image = rng.integers(0, 256, (5, 7, 3)).astype(np.int64)
    lines = b""
    for y in range(5):
        row, up = image[y].ravel(), image[y - 1].ravel() if y else np.zeros(21, np.int64)
        left, corner = np.concatenate([np.zeros(3, np.int64), row[:-3]]), np.concatenate([np.zeros(3, np.int64), up[:-3]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [np.zeros(21, np.int64), left, up, (left + up) // 2, near][y]
        lines += bytes([y]) + ((row - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    png = images.SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (images.from_png(png) == image).all()
    for bad in (b"", png[:-12], png[:-1], png[:40] + b"?" + png[41:], b"GIF89a"):
        with pytest.raises(ValueError):
            images.from_png(bad)


def test_raw_planes_are_scanned_from_files(spark, tmp_path):
    from gridsurf.sources import formats

    rng = np.random.default_rng(2)
    w, h = 64, 48
    alpha, raw, rgba = rng.integers(0, 256, w * h), rng.random(w * h).astype("f4"), rng.integers(0, 256, (w * h, 4))
    for slot in ("front", "left"):
        for name, body in formats.to_plane_files(slot, w, h, alpha, raw, rgba, focalPx=50.0):
            if not (slot == "left" and name.endswith("u8")):
                (tmp_path / name).write_bytes(body)
    got = formats.plane_scan(formats.binary_scan(spark, f"file://{tmp_path}")).toPandas().sort_values(["y", "x"])
    assert set(got.slot) == {"front"} and len(got) == w * h
    assert (got.alpha.to_numpy() == alpha).all() and np.allclose(got.raw, raw) and (got[["r", "g", "b"]].to_numpy() == rgba[:, :3]).all()
    walked = formats.file_walk(spark, f"file://{tmp_path}").collect()
    assert len(walked) == 7 and sum(r.bytes for r in walked) == sum(p.stat().st_size for p in tmp_path.iterdir()) and all(r.gzip_bytes > 0 for r in walked)


def test_worst_views_go_until_the_rest_agrees():
    from gridsurf.plans.extras import solve_with_drops

    table = {("a", "b", "c"): {"a": 0.95, "b": 0.7, "c": 0.92}, ("a", "c"): {"a": 0.93, "c": 0.9}}
    assert solve_with_drops(["a", "b", "c"], "a", lambda v: table[tuple(v)])[:2] == (["a", "c"], ["b"])
    assert solve_with_drops(["a", "b", "c"], "b", lambda v: table[tuple(v)])[:2] == (["a", "b", "c"], [])  # the reference is the worst
