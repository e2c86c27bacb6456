"""Queries that write a layer or an extract in a format and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recipes
from ..operators.layer import Layer
from ..runtime import shared_dir, stored, table
from ..sources import osm, sinks, vector
from . import fixtures as fx


def _at(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; one-file formats need it mounted."""
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return f"{folder.rstrip('/')}/trips/{uuid.uuid4().hex}/{name}"


def gpkg_edges(s, d):
    """Road edges written as a GeoPackage and loaded as such."""
    layer = fx.lines(s, d)
    df = layer.df.select(F.col("osm_id").cast("string").alias("osmid"), "edge_id", F.length("name").cast("double").alias("length"), "name", "geometry")
    path = _at(s, "edges.gpkg")
    sinks.write_gpkg(Layer(df, 3857), path, "edges")
    return vector.load_osm_edges(s, path).df.select("osm_id", "edge_id", "edge_length")


def geojson_layer(s, d):
    path = _at(s, "zones.geojson")
    sinks.save_layer(fx.zones(s, d), path)
    back = vector.load_layer(s, path, 3857)
    return sinks.with_wkt(back.df).select("zone_id", "zone_name", "geometry_wkt")


def shapefile_layer(s, d):
    path = _at(s, "roads.shp")
    sinks.save_layer(fx.roads(s, d), path)
    back = vector.load_layer(s, path, 3857)
    return sinks.with_wkt(back.df).select("link_id", "brand", "road_class", "length", F.length("geometry_wkt").alias("size"))


def csv_with_geometry(s, d):
    path = _at(s, "lines.csv")
    sinks.save_table(fx.lines(s, d).df, path)
    return vector.read_csv(s, path).select(F.col("edge_id").cast("bigint").alias("edge_id"), F.col("osm_id").cast("bigint").alias("osm_id"), "name", "geometry_wkt")


def saved_layer(s, d):
    path = _at(s, "roads.parquet")
    sinks.save_layer(fx.roads(s, d), path)
    return vector.load_layer(s, path, 3857).df.select("link_id", "brand", "length")


def _network(s, d):
    nodes = fx.derived(s, d, fx.NODES).withColumn("highway", F.when(F.col("node_id") % 7 == 0, "stop"))
    edges = fx.derived(s, d, fx.GRAPH).select("edge_id", "u", "v", (F.col("edge_id") % 100).cast("double").alias("length"), F.when(F.col("edge_id") % 3 == 0, "primary").alias("highway"))
    return nodes, edges


def xml_network(s, d):
    """Nodes and ways of a network written as XML: places, tags and node lists."""
    nodes, edges = _network(s, d)
    path = _at(s, "net.osm")
    sinks.write_osm_xml(nodes, sinks.as_ways(edges, ["highway", "length", "oneway"]), path)
    el = osm.read_xml(s, path)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    own = F.when(F.col("type") == "node", F.col("id"))
    return el.select("type", own.alias("id"), "lat", "lon", text.alias("tags"), F.col("nodes")[0].alias("u"), F.col("nodes")[1].alias("v"))


def graphml_network(s, d):
    nodes, edges = _network(s, d)
    path = _at(s, "net.graphml")
    sinks.write_graphml(nodes, edges, path)
    n, e = osm.load_graph(s, path)
    return e.join(n.select(F.col("node_id").alias("u"), "x", F.col("highway").alias("stop")), "u").select("u", "v", "length", "highway", "x", "stop")


def _latest(s, d):
    el = table(s, d, "osm_elements").where("id IS NOT NULL AND ts IS NOT NULL")
    one = el.groupBy("type", "id").agg(F.max_by(F.struct("lat", "lon", "tags", "nodes", "members", "visible"), F.struct("ts", F.coalesce("version", F.lit(-1)), "rec_id")).alias("l"))
    return one.select("type", "id", "l.*").where("coalesce(visible, true)").drop("visible")


def pbf_extract(s, d):
    """The current elements written as an extract and read by its blocks."""
    path = _at(s, "now.osm.pbf")
    sinks.write_pbf(_latest(s, d), path)
    el = osm.read_pbf(s, path)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return el.select(
        "type", "id", F.round("lat", 6).alias("lat"), F.greatest(size("tags"), F.lit(0)).alias("n_tags"), F.try_element_at("tags", F.lit("highway")).alias("highway"),
        F.greatest(size("nodes"), F.lit(0)).alias("n_nodes"), F.try_element_at("nodes", F.lit(1)).alias("first"), F.greatest(size("members"), F.lit(0)).alias("n_members"),
    )


def extract_lines(s, d):
    """The lines layer of an extract: ways of at least two known nodes, with the bag
    of their other tags, and what is parsed from it."""
    lines = recipes.line_ids(osm.road_lines(_latest(s, d)))
    return lines.select("osm_id", "highway", "name", "other_tags", "edge_id", F.octet_length("geometry").alias("bytes"))


def merged_ways(s, d):
    """Edges of one id as one way: tags of the first, lengths added up, the nodes in
    order (here of paths, so from their start on)."""
    e = fx.derived(s, d, fx.NODES).select((F.floor("node_id") / 10).cast("bigint").alias("way"), F.col("node_id").alias("u"), (F.col("node_id") + 1).alias("v"), F.col("x").alias("length"), F.concat(F.lit("n"), F.col("node_id") % 3).alias("name"))
    w = sinks.as_ways(e, ["name", "length"], "way")
    return w.select("id", F.array_join("nodes", "-").alias("nodes"), F.col("tags")["name"].alias("name"), F.col("tags")["length"].cast("double").alias("length"))


def network_files(s, d):
    """What an export writes, read back: rows per format."""
    nodes, edges = _network(s, d)
    line = fx.shaped(edges.withColumns({"x0": F.col("u") * 1.0, "y0": F.col("v") * 1.0, "x1": F.col("u") + 1.0, "y1": F.col("v") + 2.0}), "line")
    line = stored(line.withColumn("osmid", F.array("edge_id", F.col("edge_id") + 1)), "edges")
    out = sinks.export_network(nodes, Layer(line, 4326), _at(s, "net").rsplit("/", 1)[0], "net", ["highway", "length"])
    counts = [
        ("geojson", vector.load_layer(s, out["geojson"], 4326).df), ("gpkg", vector.read_gpkg(s, out["gpkg"]).df), ("graphml", osm.load_graph(s, out["graphml"])[1]),
        ("osm", osm.read_xml(s, out["osm"])), ("parquet", s.read.parquet(out["parquet"])), ("pbf", osm.read_pbf(s, out["pbf"])),
    ]
    rows = None
    for name, df in counts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("format"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


_G, _N, _Z, _L, _R = (fx.duck(x) for x in (fx.GRAPH, fx.NODES, fx.ZONES, fx.LINES, fx.ROADS))
_NOW = """SELECT * FROM osm_elements WHERE id IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY type, id ORDER BY ts DESC, coalesce(version, -1) DESC, rec_id DESC) = 1"""
_NUM = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
_PT = lambda x, y: f"{_NUM(x)} || ' ' || {_NUM(y)}"
_NET = f"""n AS ({_N}), e AS (SELECT edge_id, u, v, CAST(edge_id % 100 AS DOUBLE) AS length, CASE WHEN edge_id % 3 = 0 THEN 'primary' END AS highway FROM ({_G}))"""
_ALL = (gpkg_edges, geojson_layer, shapefile_layer, csv_with_geometry, saved_layer, xml_network, graphml_network, pbf_extract, extract_lines, merged_ways, network_files)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {
    "gpkg_edges": f"SELECT osm_id, edge_id, CAST(length(name) AS DOUBLE) AS edge_length FROM ({_L})",
    "geojson_layer": f"""SELECT zone_id, zone_name, 'POLYGON ((' || {_PT('xmin', 'ymin')} || ', ' || {_PT('xmax', 'ymin')} || ', ' || {_PT('xmax', 'ymax')} || ', ' || {_PT('xmin', 'ymax')} || ', ' || {_PT('xmin', 'ymin')} || '))' AS geometry_wkt
FROM ({_Z})""",
    "shapefile_layer": f"""SELECT link_id, brand, road_class, length, CAST(length('POLYGON ((' || {_PT('xmin', 'ymin')} || ', ' || {_PT('xmax', 'ymin')} || ', ' || {_PT('xmax', 'ymax')} || ', ' || {_PT('xmin', 'ymax')} || ', ' || {_PT('xmin', 'ymin')} || '))') AS INTEGER) AS size
FROM ({_R})""",
    "csv_with_geometry": f"SELECT edge_id, osm_id, name, 'LINESTRING (' || {_PT('x0', 'y0')} || ', ' || {_PT('x1', 'y1')} || ')' AS geometry_wkt FROM ({_L})",
    "saved_layer": f"SELECT link_id, brand, length FROM ({_R})",
    "xml_network": f"""WITH {_NET} SELECT 'node' AS type, node_id AS id, y AS lat, x AS lon, CASE WHEN node_id % 7 = 0 THEN 'highway=stop' ELSE '' END AS tags, NULL::BIGINT AS u, NULL::BIGINT AS v FROM n
UNION ALL SELECT 'way', NULL, NULL, NULL, CASE WHEN highway IS NOT NULL THEN 'highway=primary,' ELSE '' END || 'length=' || CAST(length AS BIGINT) || ',oneway=no', u, v FROM e""",
    "graphml_network": f"WITH {_NET} SELECT u, v, length, e.highway, x, CASE WHEN node_id % 7 = 0 THEN 'stop' END AS stop FROM e JOIN n ON u = node_id",
    "pbf_extract": f"""SELECT type, id, CASE WHEN type = 'node' THEN round(coalesce(lat, 0), 6) END AS lat, CAST(coalesce(cardinality(tags), 0) AS INTEGER) AS n_tags, tags['highway'] AS highway,
CAST(CASE WHEN type = 'way' THEN coalesce(len(nodes), 0) ELSE 0 END AS INTEGER) AS n_nodes, CASE WHEN type = 'way' THEN nodes[1] END AS first, CAST(CASE WHEN type = 'relation' THEN coalesce(len(members), 0) ELSE 0 END AS INTEGER) AS n_members
FROM ({_NOW}) WHERE coalesce(visible, true)""",
    "extract_lines": f"""WITH now AS (SELECT * FROM ({_NOW}) WHERE coalesce(visible, true)), p AS (SELECT id, tags, unnest(nodes) AS node FROM now WHERE type = 'way'),
w AS (SELECT id, any_value(tags) AS tags, count(*) AS n FROM p WHERE node IN (SELECT id FROM now WHERE type = 'node' AND lat IS NOT NULL AND lon IS NOT NULL) GROUP BY id HAVING count(*) > 1),
b AS (SELECT *, list_filter(list_sort(map_entries(tags)), lambda t: t.key NOT IN ('highway', 'name') AND t.value IS NOT NULL) AS rest FROM w)
SELECT id AS osm_id, tags['highway'] AS highway, tags['name'] AS name, nullif(array_to_string(list_transform(rest, lambda t: '"' || replace(replace(t.key, '\\', '\\\\'), '"', '\\"') || '"=>"' || replace(replace(t.value, '\\', '\\\\'), '"', '\\"') || '"'), ','), '') AS other_tags,
tags['edge_id'] AS edge_id, CAST(9 + 16 * n AS INTEGER) AS bytes FROM b""",
    "merged_ways": f"""SELECT node_id // 10 AS id, string_agg(CAST(node_id AS VARCHAR), '-' ORDER BY node_id) || '-' || (max(node_id) + 1) AS nodes, arg_min('n' || (node_id % 3), node_id) AS name, sum(x) AS length FROM ({_N}) GROUP BY 1""",
    "network_files": f"""WITH {_NET}, k AS (SELECT (SELECT count(*) FROM e) AS ne, (SELECT count(*) FROM n) AS nn)
SELECT unnest(['geojson', 'gpkg', 'graphml', 'osm', 'parquet', 'pbf']) AS format, unnest([ne, ne, ne, ne + nn, ne, ne + nn]) AS n FROM k""",
}
