"""Queries against their SQL on rows that the supplied small tables lack; every row must be equal."""

from __future__ import annotations

import duckdb
import pytest

from gridsurf.plans import registry
from gridsurf.sources import formats

LINES = "SELECT {key} AS l_orderkey, 7::BIGINT AS l_partkey, 5::BIGINT AS l_suppkey, {line} AS l_linenumber, {quantity}::DOUBLE AS l_quantity, {price}::DOUBLE AS l_extendedprice, {discount}::DOUBLE AS l_discount, {tax}::DOUBLE AS l_tax"
SOURCE = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM '/root/testdata/sf0.001/lineitem.parquet'"


def line(key=1, line=1, quantity=25, price=25500, discount=0.05, tax=0.04) -> str:
    return LINES.format(**locals())


def equal(spark, folder, name: str, tables: dict[str, str]) -> int:
    """The rows of query and SQL over these tables are the same; how many there are."""
    con = duckdb.connect()
    for t, body in tables.items():
        con.execute(f"COPY ({body}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    got, want = order(got.select(*names).collect()), order(want.fetchall())
    assert got == want
    return len(got)


#: A point in the middle of the box has no normal (the zero vector); one behind it has the normal (0, 0, -1).
CENTRE = {"lineitem": " UNION ALL ".join([SOURCE + " WHERE l_orderkey < 300", line(), line(2, 2, tax=0)])}


@pytest.mark.parametrize("name", ["geo_quat_from_normal", "codec_ply_decode", "codec_splat_decode", "codec_spz_header", "sink_dispatch", "sink_ply_rows", "sink_spz_rows", "pack_oct_decode", "pack_oct_encode", "sink_splat_rows"])
def test_points_without_a_normal(spark, tmp_path, name):
    assert equal(spark, tmp_path, name, CENTRE) > 0



def test_partners_across_cells_and_without_a_normal(spark, tmp_path):
    rows = [line(1, 1), line(2, 2), line(3, 1, price=25515), line(4, 2, price=25534, tax=0), line(5, 3, 10, 1515, 0.01, 0.02), line(6, 3, 10, 1515, 0.01, 0.02), line(7, 1, 11, 1516, 0.01, 0.02)]
    more = f"SELECT * FROM ({SOURCE}) UNION ALL SELECT l_orderkey + 150000, l_partkey, l_suppkey, l_linenumber + 1, l_quantity, l_extendedprice + 3, l_discount, l_tax FROM ({SOURCE})"
    assert equal(spark, tmp_path, "join_double_rate_semi", {"lineitem": " UNION ALL ".join([more, *rows])}) == 1



def test_weights_round_as_doubles(spark, tmp_path):
    # 0.16065 at four decimals is the decimal 0.1607, but the double lies below it
    assert equal(spark, tmp_path, "sink_splat_rows", {"lineitem": line(448483, 4, 18, 1531.25)}) == 1



def test_composites_of_crowded_pixels(spark, tmp_path):
    many = "SELECT l_orderkey + i AS l_orderkey, l_partkey, l_suppkey, (i % 7 + 1)::INT AS l_linenumber, (1 + i % 2)::DOUBLE AS l_quantity, 10.0 + i % 9 AS l_extendedprice, (i % 11) / 100.0 AS l_discount, 0.05 AS l_tax FROM (" + line() + "), range(60000) t(i)"
    assert equal(spark, tmp_path, "render_composite", {"lineitem": many + " UNION ALL " + SOURCE + " WHERE l_orderkey < 300"}) > 1



def test_fragments_on_the_rim(spark, tmp_path):
    assert equal(spark, tmp_path, "render_fragment", {"lineitem": line(1, 6, 45, 49500) + " UNION ALL " + line(2, 4, 45, 47500) + " UNION ALL " + line(3, 4)}) == 1



def test_boxes_without_a_subject_and_planes_that_share_an_id(spark, tmp_path):
    at = "SELECT {i}::BIGINT AS vec_id, list_transform(range(64), lambda p: (CASE WHEN {subject} THEN 0.2 ELSE -0.2 END)::FLOAT) AS embedding, {label}::INT AS label"
    planes = [at.format(i=1, label=1, subject="p % 8 > 5"), at.format(i=3, label=3, subject="false"), at.format(i=7, label=0, subject="p < 20"), at.format(i=7, label=2, subject="p > 30")]
    assert equal(spark, tmp_path, "geo_recrop_fixpoint", {"embeddings": " UNION ALL ".join(planes)}) == 3


def test_spz_rows_hold_every_column_of_the_format(spark, tmp_path):
    body = ["fx", "fy", "fz", "alpha", "c0", "c1", "c2", "l0", "l1", "l2", "q1", "q2", "q3"]
    assert equal(spark, tmp_path, "sink_spz_rows", CENTRE) > 0
    rows = registry.QUERIES["sink_spz_rows"](spark, str(tmp_path))
    assert rows.columns == ["pid", *body]
    # one column after another, as the format lays them out
    p = rows.orderBy("pid").toPandas()
    file = formats.to_spz(p)
    n = len(p)
    assert len(file) == 16 + 19 * n
    at = 16 + 9 * n + n
    for group in (["c0", "c1", "c2"], ["l0", "l1", "l2"], ["q1", "q2", "q3"]):
        assert list(file[at : at + 3 * n]) == p[group].to_numpy().ravel().tolist()
        at += 3 * n
