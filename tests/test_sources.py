import gzip
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.wkb import dumps, from_line, from_rings, loads, to_wkt
from gridloom.operators.layer import Layer
from gridloom.sources import osm, sinks, vector

XML = """<?xml version="1.0"?>
<osm version="0.6">
<node id="1" version="2" timestamp="2031-01-01T00:00:00Z" lat="1.5" lon="2.5"><tag k="highway" v="crossing"/></node>
<node id="2" lat="1.6" lon="2.6"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="name" v="A &amp; B"/><tag k="highway" v="primary"/></way>
<relation id="20"><member type="way" ref="10" role="outer"/><member type="node" ref="1" role=""/></relation>
</osm>
"""


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_xml_plain_and_bzip2(spark, tmp_path):
    import bz2

    (tmp_path / "a.osm").write_text(XML)
    (tmp_path / "a.osm.bz2").write_bytes(bz2.compress(XML.encode()))
    for name in ("a.osm", "a.osm.bz2"):
        el = osm.read_xml(spark, str(tmp_path / name))
        got = {(r.type, r.id): r for r in el.collect()}
        assert got[("node", 1)].lat == 1.5 and got[("node", 1)].tags == {"highway": "crossing"}
        assert got[("way", 10)].nodes == [1, 2, 3] and got[("way", 10)].tags["name"] == "A & B"
        assert [(m.type, m.ref) for m in got[("relation", 20)].members] == [("way", 10), ("node", 1)]


def test_pbf_round_trip(spark, tmp_path):
    (tmp_path / "a.osm").write_text(XML)
    el = osm.read_xml(spark, str(tmp_path / "a.osm"))
    sinks.write_pbf(el, str(tmp_path / "a.osm.pbf"), per_block=2)
    back = osm.read_pbf(spark, str(tmp_path / "a.osm.pbf"))
    key = lambda df: {(r.type, r.id, tuple(r.nodes or ()), tuple((m.type, m.ref, m.role) for m in r.members or ()), tuple(sorted(r.tags.items()))) for r in df.collect()}
    assert key(back) == key(el)
    assert back.where("id = 1").first().lat == pytest.approx(1.5)
    lines = osm.road_lines(back).collect()
    assert [(r.osm_id, to_wkt(loads(r.geometry))) for r in lines] == [(10, "LINESTRING (2.5 1.5, 2.6 1.6)")]


def test_dense_nodes():
    strings = b"".join(sinks._f(1, s) for s in (b"", b"k", b"v"))
    z = lambda xs: b"".join(sinks._v(sinks._z(x)) for x in xs)
    dense = sinks._f(1, z([5, 2])) + sinks._f(8, z([15_000_000, 1])) + sinks._f(9, z([-25_000_000, 0])) + sinks._f(10, b"\1\2\0\0")
    block = sinks._f(1, strings) + sinks._f(2, sinks._f(2, dense))
    a, b = osm.decode_block(block)
    assert a[:2] == ("node", 5) and a[5] == pytest.approx(1.5) and a[6] == pytest.approx(-2.5) and a[7] == {"k": "v"}
    assert b[1] == 7 and b[7] == {}


def test_gpkg_and_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "a", 1.5, from_line([[0, 0], [1, 1]])), (2, None, None, from_rings([[0, 0], [2, 0], [2, 2]])), (3, "c", 0.0, None)],
        "id bigint, name string, x double, geometry binary",
    )
    for name, read in (("a.gpkg", lambda p: vector.read_gpkg(spark, p)), ("a.geojson", lambda p: vector.read_geojson(spark, p, 3857))):
        path = sinks.save_layer(Layer(df, 3857), str(tmp_path / name))
        back = read(path)
        assert back.epsg == 3857
        got = {r.id: (r.name, r.x, bytes(r.geometry) if r.geometry else None) for r in back.df.collect()}
        assert got == {r.id: (r.name, r.x, bytes(r.geometry) if r.geometry else None) for r in df.collect()}


def test_load_osm_edges_needs_its_columns(spark, tmp_path):
    df = spark.createDataFrame([("7", "e", 2.0, "x", from_line([[0, 0], [1, 1]]))], "osmid string, edge_id string, length double, more string, geometry binary")
    sinks.write_gpkg(Layer(df, 3857), str(tmp_path / "e.gpkg"), "edges")
    out = vector.load_osm_edges(spark, str(tmp_path / "e.gpkg")).df
    assert out.columns == ["osm_id", "edge_id", "edge_length", "geometry"] and out.first().osm_id == 7
    sinks.write_gpkg(Layer(df.drop("length"), 3857), str(tmp_path / "f.gpkg"), "edges")
    with pytest.raises(ValueError, match="length"):
        vector.load_osm_edges(spark, str(tmp_path / "f.gpkg"))


def test_shapefile(spark, tmp_path):
    ring = np.array([[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]], "f8")  # turns right: a shell
    body = struct.pack("<i4dii", 5, 0, 0, 2, 2, 1, 5) + struct.pack("<i", 0) + ring.tobytes()
    rec = struct.pack(">ii", 1, len(body) // 2) + body
    (tmp_path / "z.shp").write_bytes(b"\0" * 100 + rec)
    field = b"ZONE".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    num = b"N".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([4, 0]) + b"\0" * 14
    (tmp_path / "z.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, 1, 32 + 64 + 1, 10) + field + num + b"\r" + b" " + b"00123" + b"   7")
    r = vector.read_shapefile(spark, str(tmp_path / "z.shp"), 4326).df.first()
    assert (r.ZONE, r.N) == ("00123", 7) and to_wkt(loads(r.geometry)).startswith("POLYGON ((0 0")


def test_tables_and_text(spark, tmp_path):
    with gzip.open(tmp_path / "n.csv.gz", "wt") as f:
        f.write("linkId,attributeOrigId\n1,5\n2,\n")
    df = vector.read_csv(spark, str(tmp_path / "n.csv.gz"))
    assert dict(df.dtypes)["linkId"] == "int" and df.count() == 2
    geo = spark.createDataFrame([(1, from_line([[0, 0], [1, 2]])), (2, None)], "id int, geometry binary")
    sinks.save_table(geo, str(tmp_path / "out.csv"))
    back = {r.id: r.geometry_wkt for r in vector.read_csv(spark, str(tmp_path / "out.csv")).collect()}
    assert back == {1: "LINESTRING (0 0, 1 2)", 2: None}
    with pytest.raises(TypeError):
        vector.load_layer(spark, 5, 4326)


def test_export_network(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.3, 0.4), (3, 0.5, 0.6)], "node_id bigint, x double, y double")
    line = from_line([[0, 0], [1, 1]])
    edges = spark.createDataFrame(
        [(1, 2, 0, [9, 7], "primary", True, 10.5, line), (2, 3, 0, [7], None, None, 2.0, line)],
        "u bigint, v bigint, key int, osmid array<bigint>, highway string, oneway boolean, length double, geometry binary",
    )
    out = sinks.export_network(nodes, Layer(edges, 4326), str(tmp_path), "net", ["highway", "oneway", "length"])
    assert set(out) == set(sinks.FORMATS)
    for path in (out["osm"], out["pbf"]):
        el = osm.read_pbf(spark, path) if path.endswith("pbf") else osm.read_xml(spark, path)
        ways = {tuple(r.nodes): r.tags for r in el.where("type = 'way'").collect()}
        assert ways == {(1, 2): {"highway": "primary", "oneway": "yes", "length": "10.5"}, (2, 3): {"oneway": "no", "length": "2"}}
    assert {r.osmid for r in vector.read_gpkg(spark, out["gpkg"]).df.collect()} == {7}
    with pytest.raises(ValueError):
        sinks.export_network(nodes, Layer(edges, 4326), str(tmp_path), "net", [], ("doc",))


def test_merged_ways(spark):
    edges = spark.createDataFrame([(2, 3, 5, "b", 1.25), (1, 2, 5, "a", 2.0), (8, 9, 6, None, 1.0)], "u bigint, v bigint, way bigint, name string, length double")
    got = {r.id: (r.nodes, r.tags) for r in sinks.as_ways(edges, ["name", "length"], merge_by="way").collect()}
    assert got == {5: ([1, 2, 3], {"name": "a", "length": "3.25"}), 6: ([8, 9], {"length": "1"})}


def test_order_of_way_nodes():
    w = sinks.way_nodes
    assert w([(1, 2)]) == [1, 2] and w([(1, 2), (2, 3), (2, 4)]) == [1, 2, 3, 4] and w([(2, 3), (1, 2)]) == [1, 2, 3]
    assert w([(1, 2), (10, 11), (11, 12)]) == [10, 11, 12]  # the largest part
    assert w([(1, 2), (2, 3), (3, 1)]) == [1, 2, 3, 1]  # a ring, from its first edge
    assert w([(1, 2), (2, 1), (2, 3), (3, 2)]) == [1, 2]  # circles all over
    assert w([(5, 5)]) == [5, 5]


def test_ways_with_branches_and_aggregates(spark):
    edges = spark.createDataFrame([(1, 2, 5, 1.0, 3), (2, 3, 5, 2.0, 9), (2, 4, 5, 4.5, 1)], "u bigint, v bigint, way bigint, length double, lanes int")
    got = sinks.as_ways(edges, ["length", "lanes"], "way", {"length": F.max, "lanes": F.sum}).first()
    assert got.nodes == [1, 2, 3, 4] and got.tags == {"length": "4.5", "lanes": "13", "oneway": "no"} or got.tags == {"length": "4.5", "lanes": "13"}


def test_one_file_formats_of_many_partitions(spark, tmp_path):
    rows = [(i, f'n "{i}"\n<&>', float(i), from_line([[i, 0], [i, 1]])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, name string, x double, geometry binary").repartition(7)
    sinks.write_geojson(Layer(df, 3857), str(tmp_path / "m.geojson"))
    back = vector.read_geojson(spark, str(tmp_path / "m.geojson"), 3857).df
    assert {(r.id, r.name, bytes(r.geometry)) for r in back.collect()} == {(i, n, g) for i, n, _, g in rows}
    nodes = df.selectExpr("id AS node_id", "x / 10 AS x", "x / 20 AS y", "name AS highway")
    ways = df.selectExpr("id + 1000 AS id", "array(id, id) AS nodes", "map('name', name) AS tags")
    sinks.write_osm_xml(nodes, ways, str(tmp_path / "m.osm"))
    el = osm.read_xml(spark, str(tmp_path / "m.osm"))
    assert {r.id: r.tags["name"] for r in el.where("type = 'way'").collect()} == {i + 1000: n for i, n, _, _ in rows}
    assert {(r.id, r.lat, r.tags["highway"]) for r in el.where("type = 'node'").collect()} == {(i, round(x / 20, 7), n) for i, n, x, _ in rows}
    sinks.write_pbf(el, str(tmp_path / "m.osm.pbf"), 50)
    pbf = osm.read_pbf(spark, str(tmp_path / "m.osm.pbf"))
    key = lambda d: sorted((r.type, r.id, r.lat and round(r.lat, 7), sorted(r.tags.items()), r.nodes or []) for r in d.collect())
    assert key(pbf) == key(el)


def test_road_lines_keep_their_other_tags(spark):
    schema = "type string, id bigint, lat double, lon double, tags map<string,string>, nodes array<bigint>, members array<struct<type:string,ref:bigint,role:string>>"
    rows = [("node", i, float(i), 0.0, None, None, None) for i in (1, 2)] + [("way", 7, None, None, {"highway": "primary", "edge_id": 'e"1', "length": "12.5"}, [1, 2, 5], None), ("way", 8, None, None, {"highway": "x"}, [2, 1], None)]
    lines = {r.osm_id: r for r in osm.road_lines(spark.createDataFrame(rows, schema)).collect()}
    assert lines[7].other_tags == '"edge_id"=>"e\\"1","length"=>"12.5"' and lines[8].other_tags is None and lines[7].highway == "primary"


def test_cache_sidecar(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    key = sinks.cache_key(left=df, label="a")
    assert not sinks.cached(path, key)
    df.write.parquet(path)
    sinks.note_cache(path, key)
    assert sinks.cached(path, key)
    assert not sinks.cached(path, sinks.cache_key(left=df.withColumn("x", F.col("x") + 1), label="a"))
    (tmp_path / "r.parquet.cache.json").write_text("{")
    assert not sinks.cached(path, key)
    assert len(sinks.config_digest({"b": 1, "a": 2})) == 10 and sinks.config_digest({"a": 2, "b": 1}) == sinks.config_digest({"b": 1, "a": 2})


def test_gpkg_blob_envelopes():
    w = dumps(("point", [np.array([[1.0, 2.0]])]))
    assert vector.gpkg_geometry(b"GP\0\3" + b"\0" * 4 + b"\0" * 32 + w) == w
    assert sqlite3.sqlite_version


def test_shapefile_round_trip(spark, tmp_path):
    hole = from_rings([[0, 0], [9, 0], [9, 9], [0, 9]], [[1, 1], [2, 1], [2, 2]])
    two = dumps(("polygon", [[np.array([[0, 0], [1, 0], [1, 1], [0, 0]], "f8")], [np.array([[5, 5], [6, 5], [6, 6], [5, 5]], "f8")]]))
    rows = [(2**60 + 1, "Zürich " * 50, 0.1, True, hole), (None, None, None, None, two), (3, "", -2.5e-7, False, None)]
    schema = "a_long_identifier bigint, a_long_identity string, x double, ok boolean, geometry binary"
    df = spark.createDataFrame([(*r[:4], r[4] and bytearray(r[4])) for r in rows], schema).coalesce(1)
    path = sinks.save_layer(Layer(df, 3857), str(tmp_path / "z.shp"))
    back = vector.read_shapefile(spark, path, 3857).df
    assert back.columns == ["a_long_ide", "a_long_i_1", "x", "ok", "geometry"]
    got = [(r[0], r[1], r[2], r[3], loads(r[4])) for r in back.collect()]
    assert [g[0] for g in got] == [2**60 + 1, None, 3] and [g[2] for g in got] == [0.1, None, -2.5e-7] and got[0][1].startswith("Zürich Zür") and [g[3] for g in got] == ["True", None, "False"]
    from gridloom.functions import kernels

    assert [kernels.area(g[4]) if g[4][0] == "polygon" else 0 for g in got] == [81 - 0.5, 1.0, 0] and [len(p) for p in got[0][4][1]] == [2]
    lines = spark.createDataFrame([(1, bytearray(from_line([[0, 0], [1, 2]], [[5, 5], [6, 6]])))], "id int, geometry binary")
    sinks.write_shapefile(Layer(lines, 3857), str(tmp_path / "l.shp"))
    assert bytes(vector.read_shapefile(spark, str(tmp_path / "l.shp"), 3857).df.first().geometry) == from_line([[0, 0], [1, 2]], [[5, 5], [6, 6]])
    with pytest.raises(ValueError):
        sinks.write_shapefile(Layer(df.select("geometry").unionByName(lines.select("geometry")), 3857), str(tmp_path / "m.shp"))
