"""Queries of study areas, network builds, masks and general geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import tags as tg
from ..functions.wkb import from_rings, loads
from ..operators import diagnose as dg
from ..operators import graph as gr
from ..operators import masks, overlay, recipes
from ..operators.layer import Layer
from ..runtime import table
from . import fixtures as fx
from .graph_queries import _G, _N, _WCC, _edges, _nodes


def _measures(df: DataFrame) -> DataFrame:
    """Area and border length of each geometry, to a hundredth."""

    @F.pandas_udf("double")
    def border(s):
        return s.map(lambda w: kernels.length(kernels.boundary(loads(w)))).astype("float64")

    sized = masks.areas(Layer(df.withColumn("border", border("geometry")), 3857))
    return sized.withColumns({"area_m2": F.round("area_m2", 2), "border": F.round("border", 2)})


# -- general geometry ---------------------------------------------------------------

# slanted lines, and zones of the tiling with a square hole
SLANTED = "select edge_id, osm_id, x0, y0, x0 + 16 + (edge_id*29)%512 x1, y0 - 200 + (osm_id*31)%400 y1 from ({lines})".format(lines=fx.LINES)
HOLE = (64.0, 192.0)


def _hollow(s, d) -> Layer:
    z = fx.derived(s, d, fx.ZONES).select("zone_id", "xmin", "ymin")

    @F.pandas_udf("binary")
    def ring(x, y):
        lo, hi = HOLE
        square = lambda a, b, k0, k1: [[a + k0, b + k0], [a + k1, b + k0], [a + k1, b + k1], [a + k0, b + k1]]
        return x.combine(y, lambda a, b: from_rings(square(a, b, 0, 256), square(a, b, lo, hi)))

    return Layer(z.select("zone_id", ring("xmin", "ymin").alias("geometry")), 3857)


def hollow_line_overlap(s, d):
    """Slanted lines cut by zones with holes."""
    lines = Layer(fx.shaped(fx.derived(s, d, SLANTED), "line"), 3857)
    out = overlay.intersect_lines_with_zones(lines, _hollow(s, d)).df
    return out.select("edge_id", F.col("zone_zone_id").alias("zone_id"), F.round("zone_link_length_m", 1).alias("length"))


def hollow_polygon_overlap(s, d):
    """Road polygons cut by zones with holes."""
    out = overlay.intersect_polygons_of_roads_with_zones(fx.roads(s, d), _hollow(s, d), prefilter=False, length_col="length").df
    return out.select(F.col("edge_link_id").alias("link_id"), F.col("zone_zone_id").alias("zone_id"), "zone_surface_m2")


def polygon_zone_voids(s, d):
    """Road polygons with the zones in their box that they do not meet."""
    from .overlay_queries import _CORNERS

    corners = Layer(fx.shaped(fx.derived(s, d, _CORNERS), "box"), 3857)
    out = overlay.intersect_polygons_of_roads_with_zones(fx.roads(s, d), corners, length_col="length").df
    return out.select("edge_link_id", F.col("zone_zone_id").alias("zone_id"), "zone_surface_m2")


def polygon_cascade_voids(s, d):
    from .overlay_queries import _CORNERS

    corners = Layer(fx.shaped(fx.derived(s, d, _CORNERS), "box"), 3857)
    out = overlay.cascade_polygons_with_zones(fx.roads(s, d), corners).df
    return out.select("link_id", F.col("zone_zone_id").alias("zone_id"), "zone_surface_m2")


def border_crossers(s, d):
    """Lines that meet the border of a zone."""
    return overlay.crossing_boundaries(fx.lines(s, d), fx.zones(s, d)).df.select("edge_id")


def dissolved_regions(s, d):
    """Zones of one region as one outline."""
    region = table(s, d, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_regionkey").alias("region"))
    z = fx.zones(s, d)
    return _measures(masks.dissolve(Layer(z.df.join(region, "zone_id"), 3857), ["region"]).df).select("region", "area_m2", "border")


def area_mask(s, d):
    """All zones widened by 100 m as one mask."""
    return _measures(masks.area_mask(fx.zones(s, d), buffer_m=100.0).df).select("mask_name", "include_water", "buffer_m", "area_m2", "border")


def water_mask(s, d):
    """The hull of every fourth zone, which fills what lies between."""
    z = fx.zones(s, d)
    return _measures(masks.area_mask(Layer(z.df.where("zone_id % 4 = 0"), 3857), include_water=True, name="wet").df).select("mask_name", "include_water", "area_m2")


def mask_overlap(s, d):
    """The ground that two widened masks have in common."""
    z = fx.zones(s, d)
    a, b = (masks.area_mask(Layer(z.df.where(c), 3857), buffer_m=64.0, name=n) for c, n in (("zone_id % 5 < 2", "west"), ("zone_id % 5 > 1", "east")))
    pieces = masks.areas(recipes.mask_overlap(a, b))
    return pieces.select("zone_a_mask_name", "zone_b_mask_name", F.round("area_m2", 1).alias("area_m2"))


def reprojected_nodes(s, d):
    """Nodes from web metres to degrees."""
    n = _nodes(s, d).withColumns({"x": F.col("x") * 50_000 - 5e6, "y": F.col("y") * 50_000 - 5e6})
    return recipes.project(n, n, 3857, 4326)[0].select("node_id", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


def spatial_matches(s, d):
    """Lines that meet no zone stay with nulls."""
    some = fx.zones(s, d)
    some = Layer(some.df.where("zone_id < 3"), 3857)
    return overlay.spatial_left_join(fx.lines(s, d), some, zone_label="Few").df.select("edge_id", "few_zone_id")


def hit_zones(s, d):
    return recipes.hit_zones(overlay.intersect_lines_with_zones(fx.lines(s, d), fx.zones(s, d)).df, "zone_zone_id")


# -- study areas --------------------------------------------------------------------

_PARTS = "select lpad(cast(n_regionkey as varchar(9)), 2, '0') as state, lpad(cast(n_nationkey as varchar(9)), 3, '0') as county, n_name as NAME, n_nationkey from {nation}"


def _census(s, d) -> DataFrame:
    n = table(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    raw = fx.derived(s, d, _PARTS).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return raw.withColumn("B01003_001E", F.when(F.col("n_nationkey") % 7 == 3, "n/a").otherwise(F.col("n").cast("string")))


def census_table(s, d):
    return recipes.census_table(_census(s, d), "county", 2031)


def dense_boundaries(s, d):
    """Areas above a density, with their percentile."""
    pop = recipes.census_table(_census(s, d), "county")
    key = F.concat(F.lpad(F.col("n_regionkey").cast("string"), 2, "0"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    areas = fx.zones(s, d).df.join(table(s, d, "nation").select(F.col("n_nationkey").alias("zone_id"), key.alias("GEOID"), "n_regionkey", "n_nationkey"), "zone_id")
    out = recipes.dense_boundaries(Layer(areas.select("GEOID", "geometry"), 3857), pop, 3857, 900.0)
    return out.df.select("GEOID", "population", F.round("density", 6).alias("density"), "percentile")


def county_areas(s, d):
    n = table(s, d, "nation").select("n_nationkey", F.lpad(F.col("n_regionkey").cast("string"), 3, "0").alias("COUNTYFP"), F.lpad((F.col("n_nationkey") % 6).cast("string"), 3, "0").alias("COUNTYFP20"))
    areas = fx.zones(s, d).df.withColumnRenamed("zone_id", "n_nationkey").join(n, "n_nationkey")
    return recipes.boundaries(Layer(areas, 3857), ["1", "5"], 3857).df.select("n_nationkey")


def county_line_overlap(s, d):
    """Lines cut by the counties of a list."""
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("zone_id"), F.lpad(F.col("n_regionkey").cast("string"), 3, "0").alias("COUNTYFP"))
    areas = Layer(fx.zones(s, d).df.join(n, "zone_id"), 3857)
    out = recipes.intersect_with_counties(fx.lines(s, d), areas, ["002"]).df
    return out.select("edge_id", F.col("zone_zone_id").alias("zone_id"), "zone_link_length_m")


def names_and_filters(s, d):
    plan = recipes.NetworkPlan("bay", (recipes.LayerPlan("residential", geo_level="cbg", least_per_km2=5500), recipes.LayerPlan("ferry")))
    return s.range(1).select(F.lit(plan.name).alias("network"), F.lit(tg.highway_filter(["primary", "trunk"])).alias("filter"))


# -- graphs ---------------------------------------------------------------------------


def scc_paths(s, d):
    """Strong components where every node has one way on."""
    return gr.strong_components(_edges(s, d))


def chains_of_paths(s, d):
    """Simplified one-way roads: every node has one way on."""
    e = _edges(s, d).withColumn("length", (F.col("edge_id") % 50).cast("double"))
    return gr.simplify(e).select("chain", "u", "v", "n_edges", "length")


def two_way_chains(s, d):
    """Simplified two-way roads: paths of ten nodes, of which a tag parts some."""
    n = fx.derived(s, d, fx.NODES).where("node_id % 10 <> 9")
    e = n.select("node_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("back")).select(
        (F.col("node_id") * 2 + F.col("back")).alias("edge_id"), (F.col("node_id") + F.col("back")).alias("u"), (F.col("node_id") + 1 - F.col("back")).alias("v"), F.lit(1.0).alias("length"),
        F.when(F.col("node_id") % 20 < 15, "primary").otherwise("service").alias("highway"),
    )
    return gr.simplify(e, ["highway"]).select("u", "v", "n_edges", "length", "highway")


def consolidated_edges(s, d):
    return gr.consolidate(_nodes(s, d), _edges(s, d), 0.4)[1].select("edge_id", "u", "v")


def _tagged(s, d) -> DataFrame:
    tag = F.when(F.col("edge_id") % 11 == 0, "yes")
    return _edges(s, d).withColumns(
        {"length": (F.col("edge_id") % 200).cast("double"), "highway": F.element_at(F.array(*(F.lit(h) for h in ("primary", "service", "residential", "trunk"))), (F.col("edge_id") % 4 + 1).cast("int")), "bridge": tag}
    )


def infrastructure(s, d):
    e = _tagged(s, d)
    rep = gr.infrastructure_report(_nodes(s, d), e, gr.components(e, _nodes(s, d)))
    return rep.select("component", "n_nodes", "n_edges", "length", "major", "bridge_tunnel", F.coalesce(F.try_element_at("classes", F.lit("service")), F.lit(0)).alias("service"), "west", "north")


def bridge_tunnel_counts(s, d):
    return gr.bridge_tunnel_counts(_tagged(s, d))


def clean_topology(s, d):
    e = _tagged(s, d).withColumn("edge_id", F.col("edge_id") % 500)
    return gr.clean_topology(_nodes(s, d), e)[1].select("edge_id", "u", "v")


def network_part(s, d):
    """The edges among the nodes of a box."""
    box = (50.0, 50.0, 150.0, 200.0)
    inside = recipes.nodes_in_box(_nodes(s, d), box).select("node_id")
    e = _edges(s, d)
    return e.join(inside.withColumnRenamed("node_id", "u"), "u", "left_semi").join(inside.withColumnRenamed("node_id", "v"), "v", "left_semi").select("edge_id", "u", "v")


def lines_in_box(s, d):
    return recipes.edges_in_box(fx.lines(s, d).df, (300.0, 300.0, 420.0, 350.0)).select("edge_id")


def end_gaps(s, d):
    e = fx.derived(s, d, fx.GRAPH).withColumns({"x0": (F.col("u") * 97) % 1000 * 0.25, "y0": (F.col("u") * 61) % 1000 * 0.25, "x1": (F.col("v") * 97) % 1000 * 0.25 + (F.col("edge_id") % 40) * 0.5, "y1": (F.col("v") * 61) % 1000 * 0.25})
    return recipes.end_gaps(e, _nodes(s, d), 1.0, 1.0, 200).select("edge_id", "gap_m")


def near_major_nodes(s, d):
    return recipes.near_nodes(_nodes(s, d), _tagged(s, d), (100.0, 100.0), 30.0)


def line_parts(s, d):
    """Parts that lines joined at equal ends make: how many of each size."""
    parts = recipes.line_diagnostics(fx.lines(s, d))[1]
    return parts.groupBy("n_nodes", "n_edges").agg(F.count(F.lit(1)).alias("parts"))


def line_lengths(s, d):
    out = recipes.line_diagnostics(fx.lines(s, d))[0]
    return out.select("class", "count", "min", "max", F.round("mean", 6).alias("mean"), "median")


def longest_links(s, d):
    """The twenty longest links, of equal ones those with the smallest record."""
    return table(s, d, "edges").where("length IS NOT NULL").orderBy(F.desc("length"), "rec_id").limit(20).select("rec_id", "length")


# -- tags --------------------------------------------------------------------------------


def tag_report(s, d):
    """The three most frequent values of each tag."""
    rep = recipes.tag_report(table(s, d, "osm_elements"), 3)
    return rep.select("type", "tag", "count", "unique_values", "percent_present", F.explode("top_values").alias("value", "n"))


def long_rows(s, d):
    return dg.long_rows(table(s, d, "documents").select("doc_id", "url", "text", "source"), 2000).select("doc_id", "total_length")


TRUCKS = """select edge_id, oneway, maxspeed, access_tag as access, maxweight, case when edge_id%5 = 0 then 'no' when edge_id%5 = 1 then 'yes|private' when edge_id%5 = 2 then ' ' end motor_vehicle,
 case when edge_id%4 = 0 then 'yes;no' when edge_id%4 = 1 then 'private' end hgv, case when edge_id%13 = 0 then '12' end maxlength, case when edge_id%6 = 0 then '20t' end `maxweight:hgv` from ({tags})"""


def truck_tags(s, d):
    e = fx.derived(s, d, TRUCKS.format(tags=fx.TAGS))
    return tg.process_tags(e).select("edge_id", "motor_vehicle", "access", "maxweight", "mdv", "hgv")


def edge_speeds(s, d):
    """Speeds from tags, missing ones from their road class."""
    bag = tg.parse_other_tags(F.col("other_tags"))
    e = fx.derived(s, d, fx.TAGS).select("edge_id", tg.standard_maxspeed(F.col("maxspeed")).alias("maxspeed"), F.try_element_at(bag, F.lit("highway")).alias("highway"))
    return recipes.with_speeds(e).select("edge_id", F.round("speed_kph", 4).alias("speed_kph"))


def first_classes(s, d):
    h = F.when(F.col("edge_id") % 3 > 0, F.filter(F.array("maxspeed", "oneway"), lambda v: v.isNotNull()))
    return fx.derived(s, d, fx.TAGS).select("edge_id", tg.first_class(h).alias("class"), F.size(tg.highway_set(F.array("oneway", "oneway", "maxspeed"))).alias("classes"))


_ALL = (
    hollow_line_overlap, hollow_polygon_overlap, polygon_zone_voids, polygon_cascade_voids, border_crossers, dissolved_regions, area_mask, water_mask, mask_overlap, reprojected_nodes,
    spatial_matches, hit_zones, census_table, dense_boundaries, county_areas, county_line_overlap, names_and_filters, scc_paths, chains_of_paths, two_way_chains, consolidated_edges,
    infrastructure, bridge_tunnel_counts, clean_topology, network_part, lines_in_box, end_gaps, near_major_nodes, line_parts, line_lengths, longest_links, tag_report, long_rows,
    truck_tags, edge_speeds, first_classes,
)
QUERIES = {f.__name__: f for f in _ALL}

_Z, _L, _R, _T = fx.duck(fx.ZONES), fx.duck(fx.LINES), fx.duck(fx.ROADS), fx.duck(fx.TAGS)


def _inside(x0: str, y0: str, x1: str, y1: str, xa: str, ya: str, xb: str, yb: str) -> str:
    """Length of the stretch of a segment in a box: each pair of sides leaves a range
    of the parameter."""
    span = lambda a, b, lo, hi, k: f"CASE WHEN {a} = {b} THEN CASE WHEN {a} BETWEEN {lo} AND {hi} THEN {k}::DOUBLE ELSE 2.0 - 3 * {k} END ELSE {'least' if not k else 'greatest'}(({lo} - {a}) / ({b} - {a}), ({hi} - {a}) / ({b} - {a})) END"
    t0 = f"greatest(0.0, {span(x0, x1, xa, xb, 0)}, {span(y0, y1, ya, yb, 0)})"
    t1 = f"least(1.0, {span(x0, x1, xa, xb, 1)}, {span(y0, y1, ya, yb, 1)})"
    return f"greatest({t1} - {t0}, 0.0) * sqrt(({x1} - {x0}) ** 2 + ({y1} - {y0}) ** 2)"


_LO, _HI = (int(v) for v in HOLE)
_COMPONENTS = """r(x, y) USING KEY (x) AS (SELECT x, x FROM a UNION (SELECT DISTINCT ON (p.x) p.x, q.y FROM recurring.r AS p, r AS q, b WHERE b.x = p.x AND b.y = q.x AND q.y < p.y ORDER BY p.x, q.y))"""
_CLOSE = f"""WITH RECURSIVE {_G}, {_N}, k AS (SELECT p.node_id AS x, q.node_id AS y FROM n p JOIN n q ON p.node_id <> q.node_id AND q.x BETWEEN p.x - 0.8 AND p.x + 0.8 AND q.y BETWEEN p.y - 0.8 AND p.y + 0.8
 WHERE (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 0.64 + 1e-12), a AS (SELECT node_id AS x FROM n), b AS (SELECT * FROM k), {_COMPONENTS},
g1 AS MATERIALIZED (SELECT x AS node_id, y AS c FROM r), b2 AS (SELECT u AS x, v AS y FROM g JOIN g1 p ON u = p.node_id JOIN g1 q ON v = q.node_id WHERE p.c = q.c), b3 AS (SELECT x, y FROM b2 UNION SELECT y, x FROM b2),
r2(x, y) USING KEY (x) AS (SELECT x, x FROM a UNION (SELECT DISTINCT ON (p.x) p.x, q.y FROM recurring.r2 AS p, r2 AS q, b3 WHERE b3.x = p.x AND b3.y = q.x AND q.y < p.y ORDER BY p.x, q.y)), c AS (SELECT x AS node_id, y AS c FROM r2)"""
_TAGGED = f"""e AS (SELECT *, CAST(edge_id % 200 AS DOUBLE) AS length, ['primary', 'service', 'residential', 'trunk'][edge_id % 4 + 1] AS highway, CASE WHEN edge_id % 11 = 0 THEN 'yes' END AS bridge FROM g)"""


def _chains(edges: str, passes: str) -> str:
    """Chains of ``e(edge_id, u, v, length)`` along the passages ``l(x, y, node)``."""
    return f"""WITH RECURSIVE {edges}, {passes}, b AS (SELECT x, y FROM l UNION SELECT y, x FROM l), a AS (SELECT edge_id AS x FROM e), {_COMPONENTS},
m AS (SELECT e.*, y AS chain FROM e JOIN r ON edge_id = x)
SELECT chain, coalesce(min(u) FILTER (u NOT IN (SELECT node FROM l)), min(u)) AS u, coalesce(min(v) FILTER (v NOT IN (SELECT node FROM l)), min(u)) AS v, count(*) AS n_edges, sum(length) AS length FROM m GROUP BY chain"""


_PASS = """deg AS (SELECT n, sum(i) AS i, sum(o) AS o, min(lo) FILTER (i = 1) AS ilo, max(lo) FILTER (i = 1) AS ihi, min(lo) FILTER (o = 1) AS olo, max(lo) FILTER (o = 1) AS ohi
 FROM (SELECT v AS n, 1 AS i, 0 AS o, u AS lo FROM e UNION ALL SELECT u, 0, 1, v FROM e) GROUP BY n),
th AS (SELECT n, i FROM deg WHERE ((i = 1 AND o = 1 AND ilo <> olo) OR (i = 2 AND o = 2 AND ilo < ihi AND ilo = olo AND ihi = ohi)) AND n NOT IN (ilo, ihi)),
l0 AS (SELECT p.edge_id AS x, q.edge_id AS y, n AS node, i FROM th JOIN e p ON p.v = n JOIN e q ON q.u = n WHERE p.u <> q.v),
l AS (SELECT x, y, node FROM l0 QUALIFY count(*) OVER (PARTITION BY node) = i)"""
_SPEED = """CASE WHEN regexp_full_match(m, '[0-9]+(\\.[0-9]+)?\\s*mph') THEN round_even(CAST(regexp_extract(m, '^[0-9.]+') AS DOUBLE), 0)
 WHEN regexp_full_match(m, '[0-9]+(\\.[0-9]+)?\\s*(kmh|km/h|kph)?') THEN round_even(CAST(regexp_extract(m, '^[0-9.]+') AS DOUBLE) / 1.60934, 0) END"""
_CIRCLE = "32 * sin(2 * pi() / 64)"  # area of the polygon drawn for a circle of radius 1

SQL = {
    "hollow_line_overlap": f"""WITH z AS ({_Z}), l AS ({fx.duck(SLANTED)}), p AS (SELECT edge_id, zone_id, {_inside('x0', 'y0', 'x1', 'y1', 'xmin', 'ymin', 'xmax', 'ymax')} AS outer_,
 {_inside('x0', 'y0', 'x1', 'y1', f'xmin + {_LO}', f'ymin + {_LO}', f'xmin + {_HI}', f'ymin + {_HI}')} AS hole FROM l JOIN z ON least(x0, x1) <= xmax AND greatest(x0, x1) >= xmin AND least(y0, y1) <= ymax AND greatest(y0, y1) >= ymin)
SELECT edge_id, zone_id, round(round_even(outer_ - hole, 2), 1) AS length FROM p WHERE outer_ - hole > 1e-9""",
    "hollow_polygon_overlap": f"""WITH z AS ({_Z}), r AS ({_R}), o AS (SELECT link_id, zone_id,
 greatest(least(r.xmax, z.xmax) - greatest(r.xmin, z.xmin), 0) * greatest(least(r.ymax, z.ymax) - greatest(r.ymin, z.ymin), 0)
 - greatest(least(r.xmax, z.xmin + {_HI}) - greatest(r.xmin, z.xmin + {_LO}), 0) * greatest(least(r.ymax, z.ymin + {_HI}) - greatest(r.ymin, z.ymin + {_LO}), 0) AS s FROM r, z)
SELECT link_id, zone_id, round_even(s, 2) AS zone_surface_m2 FROM o WHERE s > 0""",
    "border_crossers": f"""WITH l AS ({_L}), k AS (SELECT 256.0 * unnest(range(0, 6)) AS b)
SELECT DISTINCT edge_id FROM l, k WHERE (b BETWEEN least(x0, x1) AND greatest(x0, x1)) OR (b BETWEEN least(y0, y1) AND greatest(y0, y1))""",
    "dissolved_regions": f"""WITH z AS (SELECT n_nationkey AS i, n_regionkey AS region FROM nation), t AS (SELECT p.region, count(*) AS n FROM z p JOIN z q ON p.region = q.region AND ((q.i = p.i + 1 AND q.i % 5 > 0) OR q.i = p.i + 5) GROUP BY 1)
SELECT region, count(*) * 65536.0::DOUBLE AS area_m2, (4 * count(*) - 2 * coalesce(any_value(n), 0)) * 256.0::DOUBLE AS border FROM z LEFT JOIN t USING (region) GROUP BY region""",
    "area_mask": f"""SELECT 'study_area' AS mask_name, false AS include_water, 100.0::DOUBLE AS buffer_m, round(1638400 + 4 * 1280 * 100 + 10000 * {_CIRCLE}, 2) AS area_m2,
round(4 * 1280 + 64 * 2 * 100 * sin(pi() / 64), 2) AS border""",
    "water_mask": f"SELECT 'wet' AS mask_name, true AS include_water, (max(xmax) - min(xmin)) * (max(ymax) - min(ymin)) AS area_m2 FROM ({_Z}) WHERE zone_id % 4 = 0",
    "mask_overlap": f"SELECT 'west' AS zone_a_mask_name, 'east' AS zone_b_mask_name, round(128 * 1280 + 64 * 64 * {_CIRCLE}, 1) AS area_m2",
    "reprojected_nodes": f"""WITH {_N} SELECT node_id, round(degrees((x * 50000 - 5e6) / 6378137.0), 8) AS x, round(degrees(2 * atan(exp((y * 50000 - 5e6) / 6378137.0)) - pi() / 2), 8) AS y FROM n""",
    "spatial_matches": f"""WITH l AS ({_L}), z AS (SELECT * FROM ({_Z}) WHERE zone_id < 3) SELECT edge_id, zone_id AS few_zone_id FROM l LEFT JOIN z
ON least(x0, x1) <= xmax AND greatest(x0, x1) >= xmin AND least(y0, y1) <= ymax AND greatest(y0, y1) >= ymin""",
    "hit_zones": f"""WITH l AS ({_L}), z AS ({_Z}), p AS (SELECT zone_id, least(greatest(x0, x1), xmax) - greatest(least(x0, x1), xmin) + least(greatest(y0, y1), ymax) - greatest(least(y0, y1), ymin) AS n
 FROM l JOIN z ON least(x0, x1) <= xmax AND greatest(x0, x1) >= xmin AND least(y0, y1) <= ymax AND greatest(y0, y1) >= ymin) SELECT count(DISTINCT zone_id) AS zones, count(*) AS pieces FROM p WHERE n > 0""",
    "census_table": f"""SELECT state || county AS GEOID, NAME AS name, CASE WHEN n_nationkey % 7 <> 3 THEN CAST(count(*) AS DOUBLE) END AS population, 2031 AS year FROM ({fx.duck(_PARTS)}) JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""".replace(" GROUP BY ALL", " GROUP BY state, county, NAME, n_nationkey"),
    "dense_boundaries": f"""WITH x AS (SELECT state || county AS GEOID, CASE WHEN n_nationkey % 7 <> 3 THEN CAST(count(*) AS DOUBLE) END AS population FROM ({fx.duck(_PARTS)}) JOIN customer ON c_nationkey = n_nationkey GROUP BY state, county, n_nationkey),
y AS (SELECT *, population / (65536.0 / 1e6) AS density FROM x WHERE population IS NOT NULL)
SELECT * FROM (SELECT GEOID, population, round(density, 6) AS density, round_even((rank() OVER (ORDER BY density) + (count(*) OVER (PARTITION BY density) - 1) / 2.0) / count(*) OVER () * 100.0::DOUBLE, 1) AS percentile FROM y) WHERE density >= 900""",
    "county_areas": "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 5) OR n_nationkey % 6 IN (1, 5)",
    "county_line_overlap": f"""WITH l AS ({_L}), z AS (SELECT z.* FROM ({_Z}) z JOIN nation ON n_nationkey = zone_id WHERE n_regionkey = 2),
p AS (SELECT edge_id, zone_id, least(greatest(x0, x1), xmax) - greatest(least(x0, x1), xmin) + least(greatest(y0, y1), ymax) - greatest(least(y0, y1), ymin) AS n
 FROM l JOIN z ON least(x0, x1) <= xmax AND greatest(x0, x1) >= xmin AND least(y0, y1) <= ymax AND greatest(y0, y1) >= ymin) SELECT edge_id, zone_id, round_even(n, 2) AS zone_link_length_m FROM p WHERE n > 0""",
    "names_and_filters": """SELECT 'bay-cbg5500-ferry-weakConn-network' AS network, '["highway"~"primary|trunk"]' AS filter""",
    "scc_paths": f"""WITH RECURSIVE {_G}, e AS (SELECT u AS x, v AS y FROM g), p(x, y) AS (SELECT x, y FROM e UNION SELECT p.x, e.y FROM p JOIN e ON p.y = e.x),
a AS (SELECT x FROM e UNION SELECT y FROM e), m AS (SELECT p.x, p.y FROM p JOIN p q ON p.x = q.y AND p.y = q.x) SELECT a.x AS node_id, least(a.x, coalesce(min(m.y), a.x)) AS component FROM a LEFT JOIN m ON m.x = a.x GROUP BY a.x""",
    "chains_of_paths": _chains(f"{_G}, e AS (SELECT *, CAST(edge_id % 50 AS DOUBLE) AS length FROM g)", _PASS),
    "two_way_chains": f"""WITH {_N}, s AS (SELECT node_id // 10 AS way, node_id AS n, CASE WHEN node_id % 20 < 15 THEN 'primary' ELSE 'service' END AS highway FROM n WHERE node_id % 10 <> 9),
c AS (SELECT highway, min(n) AS a, max(n) + 1 AS b, count(*) AS k FROM s GROUP BY way, highway) SELECT a AS u, b AS v, k AS n_edges, k::DOUBLE AS length, highway FROM c UNION ALL SELECT b, a, k, k, highway FROM c""",
    "consolidated_edges": f"{_CLOSE} SELECT edge_id, p.c AS u, q.c AS v FROM g JOIN c p ON u = p.node_id JOIN c q ON v = q.node_id WHERE p.c <> q.c OR u = v",
    "infrastructure": f"""{_WCC}, {_TAGGED}, k AS (SELECT component, count(*) AS ne, sum(length) AS le, count_if(highway IN ('primary', 'trunk')) AS ma, count_if(bridge = 'yes') AS br, count_if(highway = 'service') AS se FROM e JOIN c ON u = node_id GROUP BY 1),
h AS (SELECT component, count(*) AS nn, min(x) AS west, max(y) AS north FROM n JOIN c USING (node_id) GROUP BY 1)
SELECT component, nn AS n_nodes, coalesce(ne, 0) AS n_edges, coalesce(le, 0) AS length, coalesce(ma, 0) AS major, coalesce(br, 0) AS bridge_tunnel, coalesce(se, 0) AS service, west, north FROM h LEFT JOIN k USING (component)""",
    "bridge_tunnel_counts": f"WITH {_G}, {_TAGGED} SELECT count_if(bridge = 'yes') AS bridges, 0 AS tunnels FROM e",
    "clean_topology": f"""WITH {_G}, {_TAGGED}, k AS (SELECT edge_id % 500 AS i, u, v, row_number() OVER (PARTITION BY edge_id % 500 ORDER BY u, v) - 1 AS n FROM e WHERE u <> v OR highway IN ('primary', 'trunk') OR bridge = 'yes')
SELECT CASE WHEN n = 0 THEN i::VARCHAR ELSE i || '_' || n END AS edge_id, u, v FROM k""",
    "network_part": f"WITH {_G}, {_N}, i AS (SELECT node_id FROM n WHERE x BETWEEN 50 AND 150 AND y BETWEEN 50 AND 200) SELECT edge_id, u, v FROM g WHERE u IN (SELECT node_id FROM i) AND v IN (SELECT node_id FROM i)",
    "lines_in_box": f"SELECT edge_id FROM ({_L}) WHERE least(x0, x1) <= 420 AND greatest(x0, x1) >= 300 AND least(y0, y1) <= 350 AND greatest(y0, y1) >= 300",
    "end_gaps": f"WITH {_G} SELECT edge_id, (edge_id % 40) * 0.5::DOUBLE AS gap_m FROM g WHERE (edge_id % 40) * 0.5 > 1 ORDER BY gap_m DESC, u, v LIMIT 200",
    "near_major_nodes": f"""WITH {_G}, {_N}, {_TAGGED}, m AS (SELECT u AS node_id FROM e WHERE highway IN ('primary', 'trunk') UNION SELECT v FROM e WHERE highway IN ('primary', 'trunk')), k AS (SELECT node_id, (x - 100) ** 2 + (y - 100) ** 2 AS d2 FROM n SEMI JOIN m USING (node_id))
SELECT * FROM k WHERE d2 <= 900 ORDER BY d2, node_id LIMIT 10""",
    "line_lengths": f"""WITH e AS (SELECT abs(x1 - x0) + abs(y1 - y0) AS l FROM ({_L})), c AS (SELECT 'all' AS k, l FROM e UNION ALL SELECT 'short', l FROM e WHERE l < 15 UNION ALL SELECT 'long', l FROM e WHERE l > 10000 UNION ALL SELECT 'plotted', l FROM e WHERE l <= 500)
SELECT k AS class, count(*) AS count, min(l) AS min, max(l) AS max, round(avg(l), 6) AS mean, median(l) AS median FROM c GROUP BY 1""",
    "line_parts": f"""WITH RECURSIVE l AS (SELECT edge_id AS i, x0 || ' ' || y0 AS p, x1 || ' ' || y1 AS q FROM ({_L})), t AS (SELECT s, row_number() OVER (ORDER BY s) AS x FROM (SELECT p AS s FROM l UNION SELECT q FROM l)),
k AS MATERIALIZED (SELECT t1.x AS x, t2.x AS y FROM l JOIN t t1 ON p = t1.s JOIN t t2 ON q = t2.s), b AS (SELECT x, y FROM k UNION SELECT y, x FROM k), a AS (SELECT x FROM t), {_COMPONENTS},
e AS (SELECT r.y AS c, count(*) AS n FROM k JOIN r ON k.x = r.x GROUP BY 1), m AS (SELECT y AS c, count(*) AS n FROM r GROUP BY 1) SELECT m.n AS n_nodes, e.n AS n_edges, count(*) AS parts FROM m JOIN e USING (c) GROUP BY 1, 2""",
    "longest_links": "SELECT rec_id, length FROM edges WHERE length IS NOT NULL ORDER BY length DESC, rec_id LIMIT 20",
    "tag_report": """WITH t AS (SELECT type, count(*) AS n FROM osm_elements GROUP BY 1), x AS (SELECT type, unnest(map_entries(tags)) AS kv FROM osm_elements), v AS (SELECT type, kv.key AS tag, kv.value AS value, count(*) AS n FROM x GROUP BY ALL)
SELECT type, tag, CAST(sum(v.n) OVER w AS BIGINT) AS count, count(*) OVER w AS unique_values, round_even(sum(v.n) OVER w / t.n * 100, 2) AS percent_present, value, v.n AS n FROM v JOIN t USING (type)
WINDOW w AS (PARTITION BY type, tag) QUALIFY row_number() OVER (PARTITION BY type, tag ORDER BY v.n DESC, value) <= 3""",
    "long_rows": "SELECT * FROM (SELECT doc_id, coalesce(length(doc_id::VARCHAR), 0) + coalesce(length(url), 0) + coalesce(length(text), 0) + coalesce(length(source), 0) AS total_length FROM documents) WHERE total_length >= 2000",
    "truck_tags": f"""WITH t AS ({_T}), s AS (SELECT edge_id, CASE WHEN edge_id % 5 IN (0, 1) THEN 'no' ELSE 'yes' END AS motor_vehicle, CASE WHEN access_tag IN ('private', 'yes;private', 'no') THEN 'no' ELSE 'yes' END AS access,
 CASE WHEN edge_id % 6 = 0 THEN 20000.0 ELSE CASE WHEN regexp_full_match(maxweight, '[0-9.]+') THEN CAST(maxweight AS DOUBLE) * 1000.0 WHEN regexp_matches(maxweight, '^[0-9.]+ *t') THEN CAST(regexp_extract(maxweight, '^[0-9.]+') AS DOUBLE) * 1000.0
 WHEN regexp_matches(maxweight, '^[0-9.]+ *lb') THEN CAST(regexp_extract(maxweight, '^[0-9.]+') AS DOUBLE) * 0.453592 END END * 2.20462 AS maxweight FROM t)
SELECT *, NOT coalesce(maxweight <= 26000, false) AS mdv, NOT coalesce(maxweight <= 80000, false) AND edge_id % 4 <> 0 AND edge_id % 13 <> 0 AS hgv FROM s""",
    "edge_speeds": f"""WITH t AS (SELECT *, lower(trim(maxspeed)) AS m FROM ({_T})), s AS (SELECT edge_id, regexp_extract(other_tags, '"highway"=>"([^"]+)"', 1) AS h, {_SPEED} * 1.60934 AS k FROM t), a AS (SELECT h, avg(k) AS m FROM s GROUP BY 1)
SELECT edge_id, round(coalesce(k, m, (SELECT avg(k) FROM s)), 4) AS speed_kph FROM s LEFT JOIN a USING (h)""",
    "first_classes": f"""SELECT edge_id, CASE WHEN edge_id % 3 > 0 THEN coalesce(trim(maxspeed), oneway, 'unknown') ELSE 'unknown' END AS class, CAST(CASE WHEN oneway IS NULL THEN 0 ELSE 1 END + CASE WHEN maxspeed IS NULL OR maxspeed IS NOT DISTINCT FROM oneway THEN 0 ELSE 1 END AS INTEGER) AS classes FROM ({_T})""",
}


def _later() -> None:
    """SQL that builds on that of other queries."""
    from . import graph_queries as gq
    from .overlay_queries import _AREAS, _CORNERS, _Z as zones

    corners = fx.duck(_CORNERS).replace("select zone_id,", "select zone_id, null as zone_name,", 1)
    met = f"""WITH {_AREAS.replace(zones, corners)}, b AS (SELECT min(xmin) AS a, max(xmax) AS b, min(ymin) AS c, max(ymax) AS d FROM r),
w AS (SELECT link_id, zone_id, round_even(za, 2) AS zone_surface_m2 FROM q) SELECT link_id AS LINK, zone_id, zone_surface_m2 FROM w
UNION ALL SELECT NULL, zone_id, NULL FROM z, b WHERE xmax >= a AND xmin <= b AND ymax >= c AND ymin <= d AND zone_id NOT IN (SELECT zone_id FROM w)"""
    SQL["polygon_zone_voids"], SQL["polygon_cascade_voids"] = met.replace("LINK", "edge_link_id"), met.replace("LINK", "link_id")
    gq.SQL["consolidated_nodes"] = f"{_CLOSE} SELECT c AS node_id, avg(x) AS x, avg(y) AS y, count(*) AS n_nodes FROM n JOIN c USING (node_id) GROUP BY c"
    gq.SQL["simplified_chains"] = _chains("e AS (SELECT u, v, min(rec_id) AS edge_id, max(length) AS length FROM edges WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY u, v)", _PASS)
    gq.SQL["network_validation"] = f"""{_WCC}, e AS (SELECT *, CAST(edge_id % 200 AS DOUBLE) AS length FROM g), q AS (SELECT count_if(edge_id IS NULL) AS missing_edge_id, count_if(length IS NULL) AS missing_length, count_if(length <= 0) AS nonpositive_length,
 count_if(length < 10) AS short_links_lt_10m, count_if(length < 5) AS very_short_links_lt_5m, count_if(length > 10000) AS long_links_gt_10km, count(*) AS missing_speed_kph, NULL::DOUBLE AS speed_kph_min, NULL::DOUBLE AS speed_kph_max,
 count(*) AS invalid_oneway_values, count(*) AS missing_geometry, count(*) AS edges, count_if(u = v) AS self_loops, 0 AS protected_self_loops, count_if(u = v) AS unprotected_self_loops FROM e)
SELECT q.*, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE node_id NOT IN (SELECT u FROM g UNION SELECT v FROM g)) AS isolates,
(SELECT count(*) - count(DISTINCT (x, y)) FROM n) AS duplicate_coordinates, (SELECT count(*) FROM n a JOIN n b ON a.node_id < b.node_id AND b.x BETWEEN a.x - 0.5 AND a.x + 0.5 AND b.y BETWEEN a.y - 0.5 AND a.y + 0.5) AS close_pairs,
(SELECT count(DISTINCT component) FROM c) AS components FROM q"""


_later()
