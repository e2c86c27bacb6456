"""Queries of graph, join and diagnosis operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnose as dg
from ..operators import graph as gr
from ..runtime import table
from . import fixtures as fx


def _edges(s: SparkSession, d: str) -> DataFrame:
    return fx.derived(s, d, fx.GRAPH)


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return fx.derived(s, d, fx.NODES)


def self_loops(s, d):
    return gr.self_loops(_edges(s, d))


def isolates(s, d):
    return gr.isolates(_nodes(s, d), _edges(s, d)).select("node_id")


def wcc(s, d):
    return gr.components(_edges(s, d), _nodes(s, d))


def largest_component(s, d):
    return gr.largest_component(gr.components(_edges(s, d), _nodes(s, d))).select("node_id")


def reachability(s, d):
    return gr.reachable(_edges(s, d), _nodes(s, d).where("x < 2")).select("node_id")


def scc(s, d):
    return gr.strong_components(table(s, d, "edges").select("u", "v"))


def fragment_report(s, d):
    e = _edges(s, d).withColumn("length", F.col("edge_id").cast("double"))
    return gr.fragment_report(e, gr.components(e))


def edge_id_dedupe(s, d):
    e = _edges(s, d).select((F.col("edge_id") % 100).alias("edge_id"), F.col("edge_id").alias("seq"), "u")
    return gr.unique_edge_ids(e, ["seq"]).select("edge_id", "seq")


def duplicate_ids(s, d):
    return gr.duplicate_ids(table(s, d, "edges"), "edge_id")


def duplicate_coords(s, d):
    return gr.duplicate_coordinates(_nodes(s, d))


def close_nodes(s, d):
    return gr.close_nodes(_nodes(s, d), 0.6)


def knn_nodes(s, d):
    return gr.nearest_nodes(_nodes(s, d), 100.0, 100.0, 20.0)


def invalid_coords(s, d):
    n = _nodes(s, d).withColumns({"x": F.col("x") - 100, "y": F.when(F.col("node_id") % 10 == 0, None).otherwise(F.col("y") - 100)})
    return gr.invalid_coordinates(n).select("node_id")


def graph_compose(s, d):
    e = _edges(s, d)
    a = e.select("u", "v", F.lit("main").alias("layer_role"), F.col("edge_id").alias("main_id")).groupBy("u", "v").agg(F.max("layer_role").alias("layer_role"), F.max("main_id").alias("main_id"))
    b = a.where("u % 3 = 0").select("u", "v", F.lit("local").alias("layer_role"))
    return gr.compose([a, b], ["u", "v"])


def speeds_imputed(s, d):
    e = table(s, d, "edges").select("rec_id", "highway", F.when(F.col("rec_id") % 3 != 0, (F.col("rec_id") % 7) * 16.0).alias("speed_kph"))
    return gr.impute_speeds(e).select("rec_id", F.round("speed_kph", 6).alias("speed_kph"))


def simplified_chains(s, d):
    """Chains of single roads between crossings of the mapped graph."""
    e = table(s, d, "edges").where("u IS NOT NULL AND v IS NOT NULL").groupBy("u", "v").agg(F.min("rec_id").alias("edge_id"), F.max("length").alias("length"))
    return gr.simplify(e).select("chain", "u", "v", "n_edges", "length")


def consolidated_nodes(s, d):
    return gr.consolidate(_nodes(s, d), _edges(s, d), 0.4)[0]


def network_validation(s, d):
    e = _edges(s, d).withColumn("length", (F.col("edge_id") % 200).cast("double"))
    return gr.validate(_nodes(s, d), e)


def edge_quality(s, d):
    return dg.edge_quality(table(s, d, "edges").select("edge_id", "length", "oneway", "geometry"))


def highway_top8(s, d):
    return dg.top_values(table(s, d, "edges"), F.array(F.coalesce("highway", F.lit("None"))), 8)


def id_join_network(s, d):
    n = table(s, d, "network").select("rec_id", "linkId", "attributeOrigId")
    z = table(s, d, "edge_zones").select("rec_id", "edge_osm_id", "edge_link_length_m")
    return dg.join_by_id(n, z, "attributeOrigId", "edge_osm_id").select("rec_id_x", "rec_id_y", "linkId", "edge_osm_id", "edge_link_length_m")


def match_rate(s, d):
    n = table(s, d, "network").select("attributeOrigId", "linkId")
    m = dg.join_by_id(n, table(s, d, "edge_zones").select("edge_osm_id"), "attributeOrigId", "edge_osm_id")
    return dg.match_rate(m, n, "attributeOrigId")


def dangling_refs(s, d):
    return dg.dangling_way_nodes(table(s, d, "osm_elements"))


def length_classes(s, d):
    out = dg.length_classes(table(s, d, "edges"), "length", plotted=200)
    return out.select("class", "count", "min", "max", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


def length_histogram(s, d):
    return dg.length_histogram(table(s, d, "edges"), "length")


def summary_delta(s, d):
    count = lambda y: table(s, d, "orders").where(F.year("o_orderdate") == y).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return dg.summary_delta(count(1995), count(1996))


def long_tags(s, d):
    return dg.long_tags(table(s, d, "documents").select("url", "text", "source"))


def _density(s, d):
    areas = table(s, d, "nation").select(F.col("n_nationkey").alias("geoid"), F.lit(65536.0).alias("area_m2"))
    pop = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("geoid")).agg(F.count(F.lit(1)).alias("population"))
    return dg.with_density(areas, pop)


def density_percentile(s, d):
    return _density(s, d).select("geoid", "population", F.round("density", 6).alias("density"), "percentile")


def density_filter(s, d):
    return dg.dense_areas(_density(s, d), 900.0).select("geoid", "population")


def density_statistics(s, d):
    out = dg.density_statistics(_density(s, d))
    return out.select([F.round(c, 6).alias(c) for c in out.columns])


def share_kept(s, d):
    x = _density(s, d)
    return dg.share_kept(dg.dense_areas(x, 900.0), x)


_G, _N = f"g AS ({fx.duck(fx.GRAPH)})", f"n AS ({fx.duck(fx.NODES)})"
_WCC = f"""WITH RECURSIVE {_G}, {_N}, b AS (SELECT u AS x, v AS y FROM g UNION SELECT v, u FROM g), a AS (SELECT node_id AS x FROM n UNION SELECT u FROM g UNION SELECT v FROM g),
r(x, y) USING KEY (x) AS (SELECT x, x FROM a UNION (SELECT DISTINCT ON (p.x) p.x, q.y FROM recurring.r AS p, r AS q, b WHERE b.x = p.x AND b.y = q.x AND q.y < p.y ORDER BY p.x, q.y)),
c AS (SELECT x AS node_id, y AS component FROM r)"""
_DENS = """x AS (SELECT n_nationkey AS geoid, count(*) AS population, count(*) / (65536.0 / 1e6) AS density FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)"""

_ALL = (
    self_loops, isolates, wcc, largest_component, reachability, scc, fragment_report, edge_id_dedupe, duplicate_ids, duplicate_coords,
    close_nodes, knn_nodes, invalid_coords, graph_compose, speeds_imputed, simplified_chains, consolidated_nodes, network_validation,
    edge_quality, highway_top8, id_join_network, match_rate, dangling_refs, length_classes, length_histogram, summary_delta, long_tags,
    density_percentile, density_filter, density_statistics, share_kept,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {
    "self_loops": f"WITH {_G} SELECT * FROM g WHERE u = v",
    "isolates": f"WITH {_G}, {_N} SELECT node_id FROM n WHERE node_id NOT IN (SELECT u FROM g UNION SELECT v FROM g)",
    "wcc": f"{_WCC} SELECT node_id, component FROM c",
    "largest_component": f"{_WCC}, s AS (SELECT component, count(*) k FROM c GROUP BY 1 ORDER BY k DESC, component LIMIT 1) SELECT node_id FROM c WHERE component = (SELECT component FROM s)",
    "reachability": f"""WITH RECURSIVE {_G}, {_N}, r(x) AS (SELECT node_id FROM n WHERE x < 2 UNION SELECT g.v FROM r JOIN g ON r.x = g.u) SELECT x AS node_id FROM r""",
    "fragment_report": f"""{_WCC}, e AS (SELECT component, count(*) ne, sum(edge_id)::DOUBLE le FROM g JOIN c ON u = node_id GROUP BY 1),
k AS (SELECT component, count(*) nn FROM c WHERE node_id IN (SELECT u FROM g UNION SELECT v FROM g) GROUP BY 1) SELECT component, nn AS n_nodes, ne AS n_edges, le AS length FROM k JOIN e USING (component)""",
    "edge_id_dedupe": f"""WITH {_G}, r AS (SELECT edge_id % 100 AS i, edge_id AS seq, row_number() OVER (PARTITION BY edge_id % 100 ORDER BY edge_id) - 1 AS k FROM g)
SELECT CASE WHEN k = 0 THEN i::VARCHAR ELSE i || '_' || k END AS edge_id, seq FROM r""",
    "duplicate_ids": "SELECT edge_id, count(*) AS count FROM edges WHERE edge_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "duplicate_coords": f"WITH {_N}, f AS (SELECT *, min(node_id) OVER (PARTITION BY x, y) AS first_id FROM n) SELECT first_id, node_id FROM f WHERE node_id <> first_id",
    "close_nodes": f"WITH {_N} SELECT p.node_id AS a, q.node_id AS b FROM n p JOIN n q ON p.node_id < q.node_id AND q.x BETWEEN p.x - 0.6 AND p.x + 0.6 AND q.y BETWEEN p.y - 0.6 AND p.y + 0.6",
    "knn_nodes": f"WITH {_N}, k AS (SELECT node_id, (x - 100) ** 2 + (y - 100) ** 2 AS d2 FROM n) SELECT * FROM k WHERE d2 <= 400 ORDER BY d2, node_id LIMIT 10",
    "invalid_coords": f"WITH {_N} SELECT node_id FROM n WHERE node_id % 10 = 0 OR NOT (x - 100 BETWEEN -180 AND 180 AND y - 100 BETWEEN -90 AND 90)",
    "graph_compose": f"WITH {_G} SELECT u, v, CASE WHEN u % 3 = 0 THEN 'local' ELSE 'main' END AS layer_role, max(edge_id) AS main_id FROM g GROUP BY u, v",
    "speeds_imputed": """WITH e AS (SELECT rec_id, highway, CASE WHEN rec_id % 3 <> 0 THEN (rec_id % 7) * 16.0::DOUBLE END AS s FROM edges),
a AS (SELECT highway h, avg(s) m FROM e GROUP BY 1) SELECT rec_id, round(coalesce(s, m, (SELECT avg(s) FROM e)), 6) AS speed_kph FROM e LEFT JOIN a ON highway IS NOT DISTINCT FROM h""",
    "edge_quality": """SELECT count_if(edge_id IS NULL) AS missing_edge_id, count_if(length IS NULL) AS missing_length, count_if(length <= 0) AS nonpositive_length,
count_if(length < 10) AS short_links_lt_10m, count_if(length < 5) AS very_short_links_lt_5m, count_if(length > 10000) AS long_links_gt_10km, count(*) AS missing_speed_kph,
NULL::DOUBLE AS speed_kph_min, NULL::DOUBLE AS speed_kph_max, count_if(coalesce(oneway, 'None') NOT IN ('yes', 'no', '-1')) AS invalid_oneway_values, count_if(geometry IS NULL) AS missing_geometry FROM edges""",
    "highway_top8": "SELECT coalesce(highway, 'None') AS value, count(*) AS count FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    "id_join_network": """SELECT n.rec_id AS rec_id_x, z.rec_id AS rec_id_y, linkId, edge_osm_id, edge_link_length_m FROM network n JOIN edge_zones z
ON coalesce(TRY_CAST(trim(attributeOrigId) AS BIGINT), CAST(TRY_CAST(attributeOrigId AS DOUBLE) AS BIGINT)) = edge_osm_id WHERE lower(trim(attributeOrigId)) <> 'nan'""",
    "dangling_refs": "SELECT DISTINCT n AS node_id FROM (SELECT unnest(nodes) n FROM osm_elements WHERE type = 'way') WHERE n NOT IN (SELECT id FROM osm_elements WHERE type = 'node')",
    "length_classes": """WITH e AS (SELECT length l FROM edges), c AS (SELECT 'all' k, l FROM e UNION ALL SELECT 'short', l FROM e WHERE l < 15 UNION ALL SELECT 'long', l FROM e WHERE l > 10000
UNION ALL SELECT 'plotted', l FROM e WHERE l <= 200) SELECT k AS class, count(l) AS count, min(l) AS min, max(l) AS max, round(avg(l), 6) AS mean, round(median(l), 6) AS median FROM c GROUP BY 1""",
    "length_histogram": "SELECT least(CAST(floor(length / 10.0) AS BIGINT), 49) AS bin, count(*) AS count FROM edges WHERE length BETWEEN 0 AND 500 GROUP BY 1",
    "summary_delta": """WITH a AS (SELECT o_orderpriority m, count(*) v FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), b AS (SELECT o_orderpriority m, count(*) v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
SELECT coalesce(a.m, b.m) AS metric, a.v AS a, b.v AS b FROM a FULL JOIN b ON a.m = b.m WHERE a.v IS DISTINCT FROM b.v""",
    "long_tags": """WITH m AS (SELECT 'url' c, max(length(url)) l FROM documents UNION ALL SELECT 'text', max(length(text)) FROM documents UNION ALL SELECT 'source', max(length(source)) FROM documents)
SELECT c AS column, l AS longest FROM m WHERE l >= 250""",
    "density_percentile": f"""WITH {_DENS} SELECT geoid, population, round(density, 6) AS density,
round_even((rank() OVER (ORDER BY density) + (count(*) OVER (PARTITION BY density) - 1) / 2.0) / count(*) OVER () * 100.0::DOUBLE, 1) AS percentile FROM x""",
    "density_filter": f"WITH {_DENS} SELECT geoid, population FROM x WHERE density >= 900",
    "density_statistics": f"""WITH {_DENS} SELECT round(avg(density), 6) AS mean, round(stddev_samp(density), 6) AS std, round(min(density), 6) AS min, round(max(density), 6) AS max,
round(quantile_cont(density, 0.25), 6) AS q25, round(quantile_cont(density, 0.5), 6) AS q50, round(quantile_cont(density, 0.75), 6) AS q75 FROM x""",
    "share_kept": f"WITH {_DENS} SELECT CAST(sum(population) FILTER (density >= 900) AS BIGINT) AS kept, CAST(sum(population) AS BIGINT) AS total, coalesce(sum(population) FILTER (density >= 900), 0)::DOUBLE / sum(population) AS share FROM x",
    "scc": """WITH RECURSIVE e AS (SELECT DISTINCT u AS x, v AS y FROM edges WHERE u IS NOT NULL AND v IS NOT NULL), p(x, y) AS (SELECT x, y FROM e WHERE x <> y UNION SELECT p.x, e.y FROM p JOIN e ON p.y = e.x),
a AS (SELECT u AS x FROM edges WHERE u IS NOT NULL UNION SELECT v FROM edges WHERE v IS NOT NULL), m AS (SELECT p.x, p.y FROM p JOIN p q ON p.x = q.y AND p.y = q.x)
SELECT a.x AS node_id, least(a.x, coalesce(min(m.y), a.x)) AS component FROM a LEFT JOIN m ON m.x = a.x GROUP BY a.x""",
    "match_rate": """WITH n AS (SELECT attributeOrigId AS t, coalesce(TRY_CAST(trim(attributeOrigId) AS BIGINT), CAST(TRY_CAST(CASE WHEN lower(trim(attributeOrigId)) NOT IN ('nan', 'inf', 'infinity') THEN attributeOrigId END AS DOUBLE) AS BIGINT)) AS i FROM network),
a AS (SELECT count(DISTINCT coalesce(i, TRY_CAST(regexp_extract(trim(t), '^[A-Za-z]+/?([0-9]+)$', 1) AS BIGINT))) AS asked FROM n),
m AS (SELECT count(DISTINCT i) AS matched FROM n WHERE i IN (SELECT edge_osm_id FROM edge_zones))
SELECT asked, matched, CASE WHEN asked > 0 THEN matched::DOUBLE / asked ELSE 0 END AS rate FROM a, m""",
}
