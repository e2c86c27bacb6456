"""Queries of the tag functions and tag aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as ag
from ..functions import tags as tg
from ..runtime import table
from . import fixtures as fx


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return fx.derived(spark, d, fx.TAGS)


def parse_other_tags(spark: SparkSession, d: str) -> DataFrame:
    m = tg.parse_other_tags(F.col("other_tags"))
    return _tags(spark, d).select("edge_id", F.try_element_at(m, F.lit("highway")).alias("highway"), tg.tag_as_float(F.col("other_tags"), "length").alias("length"))


def split_tag_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("edge_id", F.explode(F.map_entries(tg.split_tag_pairs(F.col("other_tags")))).alias("e")).select("edge_id", "e.key", "e.value")


def std_oneway(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("edge_id", tg.standard_oneway(F.col("oneway")).alias("oneway"))


def std_maxspeed(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("maxspeed")
    return _tags(spark, d).select("edge_id", tg.standard_maxspeed(c).alias("maxspeed"), tg.standard_maxspeed(c, 40.0).alias("with_default"), tg.standard_maxspeeds(F.split(c, ";")).alias("of_list"))


def std_weight(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("maxweight")
    return _tags(spark, d).select("edge_id", tg.standard_weight(c, "lbs").alias("lbs"), tg.standard_weight(c, "kg").alias("kg"))


def std_access(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("edge_id", tg.standard_access(F.col("access_tag")).alias("access"))


def std_hgv(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("edge_id", tg.standard_hgv(F.col("access_tag")).alias("hgv"))


def process_tags(spark: SparkSession, d: str) -> DataFrame:
    out = tg.process_tags(_tags(spark, d).withColumnRenamed("access_tag", "access"))
    return out.select("edge_id", "oneway", "motor_vehicle", "maxspeed", "access", "maxweight", "mdv", "hgv")


def edge_id_md5(spark: SparkSession, d: str) -> DataFrame:
    g = fx.derived(spark, d, fx.GRAPH)
    return g.select("edge_id", tg.edge_id(F.col("u"), F.col("v"), F.array("edge_id", F.col("u") + 7)).alias("id"))


def ferry_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _tags(spark, d).select("edge_id", F.col("access_tag").alias("motor_vehicle"), "maxspeed")
    return tg.ferry_edges(e).select("edge_id", "motor_vehicle", "maxspeed", "highway", "oneway", "lanes", "hgv", "mdv", "reversed")


def protected_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _tags(spark, d)
    hw = F.array(F.try_element_at(tg.parse_other_tags(F.col("other_tags")), F.lit("highway")))
    none = F.lit(None).cast("string")
    return e.select("edge_id", tg.protected_edge(hw, none, F.lit(False), F.col("oneway"), none).alias("protected"))


def _chains(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select(
        (F.col("edge_id") % 500).alias("chain"), F.col("edge_id").alias("seq"), tg.standard_maxspeed(F.col("maxspeed")).alias("maxspeed"),
        tg.standard_oneway(F.col("oneway")).alias("oneway"), F.col("maxweight"), F.col("access_tag").alias("bridge"),
        F.col("edge_id").cast("double").alias("length"), (F.col("edge_id") % 3 != 0).alias("hgv"), (F.col("edge_id") % 50 == 0).alias("protected_backbone"),
        F.concat_ws(";", (F.col("edge_id") % 5).cast("string"), F.when(F.col("edge_id") % 4 == 0, "x").otherwise((F.col("edge_id") % 3).cast("string"))).alias("lanes"),
    )


def edge_merge_aggs(spark: SparkSession, d: str) -> DataFrame:
    return ag.merge_edges(_chains(spark, d), "chain").drop("lanes")


def median_lanes(spark: SparkSession, d: str) -> DataFrame:
    return ag.merge_edges(_chains(spark, d), "chain").select("chain", "lanes")


def most_restrictive_access(spark: SparkSession, d: str) -> DataFrame:
    e = _tags(spark, d).withColumn("chain", F.col("edge_id") % 1000)
    return e.groupBy("chain").agg(
        ag.most_restrictive_access(F.col("access_tag"), F.col("edge_id")).alias("access"), ag.most_restrictive_flag(F.col("oneway")).alias("flag")
    )


def tag_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the latest elements: counts, distinct values, share of elements."""
    el = table(spark, d, "osm_elements")
    n = el.groupBy("type").agg(F.count(F.lit(1)).alias("elements"))
    per_value = el.select("type", F.explode("tags").alias("tag", "value")).groupBy("type", "tag", "value").agg(F.count(F.lit(1)).alias("c"))
    per_tag = per_value.groupBy("type", "tag").agg(
        F.sum("c").alias("count"), F.count(F.lit(1)).alias("unique_values"), F.max_by("value", F.struct("c", "value")).alias("top_value")
    )
    share = F.rint(100.0 * F.col("count") / F.col("elements") * 100.0) / 100.0
    return per_tag.join(F.broadcast(n), "type").select("type", "tag", "count", "unique_values", "top_value", share.alias("percent_present"))


_T = f"t AS ({fx.duck(fx.TAGS)})"
_SPEED = """CASE WHEN regexp_full_match(m, '[0-9]+(\\.[0-9]+)?\\s*mph') THEN round_even(CAST(regexp_extract(m, '^[0-9.]+') AS DOUBLE), 0)
 WHEN regexp_full_match(m, '[0-9]+(\\.[0-9]+)?\\s*(kmh|km/h|kph)?') THEN round_even(CAST(regexp_extract(m, '^[0-9.]+') AS DOUBLE) / 1.60934, 0) END"""
_WEIGHT = """CASE WHEN regexp_full_match(w, '[0-9.]+') THEN CAST(w AS DOUBLE) * 1000.0
 WHEN regexp_matches(w, '^[0-9.]+ *t') THEN CAST(regexp_extract(w, '^[0-9.]+') AS DOUBLE) * 1000.0
 WHEN regexp_matches(w, '^[0-9.]+ *lb') THEN CAST(regexp_extract(w, '^[0-9.]+') AS DOUBLE) * 0.453592 END"""
_ONEWAY = """CASE WHEN oneway IN ('yes', 'yes;yes') THEN 'yes' WHEN oneway IN ('-1', 'reverse') THEN '-1' ELSE 'no' END"""
_ACCESS = "CASE WHEN access_tag IN ('private', 'yes;private', 'no') THEN 'no' ELSE 'yes' END"
_CHAINS = f"""c AS (SELECT edge_id % 500 AS chain, edge_id AS seq, {_SPEED} AS mph, {_ONEWAY} AS oneway, maxweight, access_tag AS bridge, edge_id AS length,
 edge_id % 3 <> 0 AS hgv, edge_id % 50 = 0 AS pb FROM (SELECT *, lower(trim(maxspeed)) m FROM t))"""

QUERIES = {
    f.__name__: f
    for f in (
        parse_other_tags, split_tag_pairs, std_oneway, std_maxspeed, std_weight, std_access, std_hgv, process_tags, edge_id_md5,
        ferry_edges, protected_edges, edge_merge_aggs, median_lanes, most_restrictive_access, tag_statistics,
    )
}
SQL = {
    "parse_other_tags": f"""WITH {_T} SELECT edge_id, regexp_extract(other_tags, '"highway"=>"([^"]+)"', 1) AS highway,
 CAST(regexp_extract(other_tags, '"length"=>"([^"]+)"', 1) AS DOUBLE) AS length FROM t""",
    "split_tag_pairs": f"""WITH {_T} SELECT edge_id, 'highway' AS key, regexp_extract(other_tags, '"highway"=>"([^"]+)"', 1) AS value FROM t
UNION ALL SELECT edge_id, 'length', regexp_extract(other_tags, '"length"=>"([^"]+)"', 1) FROM t""",
    "std_oneway": f"WITH {_T} SELECT edge_id, {_ONEWAY} AS oneway FROM t",
    "std_maxspeed": f"""WITH {_T}, s AS (SELECT edge_id, maxspeed, CAST({_SPEED} AS BIGINT) AS v FROM (SELECT *, lower(trim(maxspeed)) m FROM t))
SELECT edge_id, v || ' mph' AS maxspeed, coalesce(v, 25) || ' mph' AS with_default,
 CASE WHEN maxspeed = '30;50' THEN '25 mph' WHEN maxspeed IS NULL THEN NULL ELSE v || ' mph' END AS of_list FROM s""",
    "std_weight": f"WITH {_T} SELECT edge_id, kg * 2.20462 AS lbs, kg FROM (SELECT edge_id, {_WEIGHT} AS kg FROM (SELECT *, maxweight AS w FROM t))",
    "std_access": f"WITH {_T} SELECT edge_id, {_ACCESS} AS access FROM t",
    "std_hgv": f"WITH {_T} SELECT edge_id, coalesce(access_tag <> 'no', true) AS hgv FROM t",
    "process_tags": f"""WITH {_T}, s AS (SELECT edge_id, {_ONEWAY} AS oneway, 'yes' AS motor_vehicle, CAST({_SPEED} AS BIGINT) || ' mph' AS maxspeed, {_ACCESS} AS access,
 {_WEIGHT} * 2.20462 AS maxweight FROM (SELECT *, lower(trim(maxspeed)) m, maxweight AS w FROM t))
SELECT *, NOT coalesce(maxweight <= 26000, false) AS mdv, NOT coalesce(maxweight <= 80000, false) AS hgv FROM s""",
    "edge_id_md5": f"""WITH g AS ({fx.duck(fx.GRAPH)}) SELECT edge_id, md5(u || '_' || v || '_' || least(edge_id::varchar, (u + 7)::varchar) || '_' || greatest(edge_id::varchar, (u + 7)::varchar))[1:12] AS id FROM g""",
    "ferry_edges": f"""WITH {_T} SELECT edge_id, access_tag AS motor_vehicle, '10 mph' AS maxspeed, 'unclassified' AS highway, 'no' AS oneway, '2' AS lanes, false AS hgv, true AS mdv, false AS reversed
FROM t WHERE access_tag IS DISTINCT FROM 'no'""",
    "protected_edges": f"""WITH {_T} SELECT edge_id, (regexp_matches(other_tags, '=>"(primary|motorway)"') OR coalesce(oneway = 'yes', false)) AS protected FROM t""",
    "edge_merge_aggs": f"""WITH {_T}, {_CHAINS} SELECT chain, count(*) AS n_edges, CAST(sum(length) AS DOUBLE) AS length, CAST(round_even(avg(mph), 0) AS BIGINT) || ' mph' AS maxspeed,
 bool_and(hgv) AS hgv, bool_or(pb) AS protected_backbone, CASE WHEN bool_or(oneway = 'no') THEN 'no' ELSE 'yes' END AS oneway,
 coalesce(CAST(min(TRY_CAST(maxweight AS DOUBLE)) AS VARCHAR), arg_min(maxweight, seq)) AS maxweight, arg_min(bridge, seq) AS bridge FROM c GROUP BY chain""",
    "median_lanes": f"""WITH {_T}, n AS (SELECT edge_id % 500 AS chain, unnest(CASE WHEN edge_id % 4 = 0 THEN [edge_id % 5] ELSE [edge_id % 5, edge_id % 3] END) AS n FROM t)
SELECT chain, CAST(floor(median(n)) AS BIGINT) AS lanes FROM n GROUP BY chain""",
    "most_restrictive_access": f"""WITH {_T} SELECT edge_id % 1000 AS chain, arg_min(access_tag, CASE access_tag WHEN 'no' THEN 1 WHEN 'private' THEN 2 WHEN 'customers' THEN 6 WHEN 'permissive' THEN 10 ELSE 9.5 END) AS access,
 CASE WHEN bool_or(oneway = 'no') THEN 'no' WHEN count(oneway) > 0 THEN 'yes' END AS flag FROM t GROUP BY 1""",
    "tag_statistics": """WITH e AS (SELECT type, count(*) n FROM osm_elements GROUP BY 1),
x AS (SELECT type, unnest(map_entries(tags)) kv FROM osm_elements), v AS (SELECT type, kv.key AS tag, kv.value AS value, count(*) c FROM x GROUP BY ALL)
SELECT type, tag, CAST(sum(c) AS BIGINT) AS count, count(*) AS unique_values, arg_max(value, (c, value)) AS top_value, round_even(100.0 * sum(c) / any_value(n), 2) AS percent_present
FROM v JOIN e USING (type) GROUP BY type, tag""",
}
