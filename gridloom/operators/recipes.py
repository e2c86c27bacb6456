"""Compositions: study areas, network builds, corridors, comparisons, reports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..functions import tags as tg
from ..functions.tags import MAJOR_ROADS, truthy
from ..runtime import files, stored
from . import diagnose, graph, masks, overlay
from .layer import Layer
from .spatial_join import with_box

# -- study areas ------------------------------------------------------------------

# Parts of a census area's identifier by level.
GEOID_PARTS = {"county": ("state", "county"), "tract": ("state", "county", "tract"), "cbg": ("state", "county", "tract", "block group")}


def census_table(raw: DataFrame, level: str, year: int | None = None) -> DataFrame:
    """Population by area from a census extract: identifiers joined from their
    parts as text, population as a number, null where it is none."""
    if level not in GEOID_PARTS:
        raise ValueError(f"unknown level {level!r}; one of {', '.join(GEOID_PARTS)}")
    pop = F.expr("try_cast(B01003_001E AS double)")
    parts = [F.col(f"`{c}`").cast("string") for c in GEOID_PARTS[level]]
    more = [F.lit(year).alias("year")] if year is not None else []
    return raw.select(F.concat(*parts).alias("GEOID"), F.col("NAME").alias("name"), pop.alias("population"), *more)


def kept_table(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once: read from ``path`` if it is there, identifiers as
    text, else made and written."""
    if not files(spark, path).has("_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Levels that boundaries come at.
LEVELS = ("county", "tract", "cbg", "taz")


def boundaries(layer: Layer, counties: Sequence[str] | str, epsg: int = 4326, level: str = "county") -> Layer:
    """Areas of the counties, in the system asked for; a row is kept if any of its
    county columns names one. Codes may be given without leading zeros."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; one of {', '.join(LEVELS)}")
    counties = [str(c).zfill(3) for c in ([counties] if isinstance(counties, (str, int)) else counties)]
    return overlay.reproject(Layer(diagnose.in_counties(layer.df, counties), layer.epsg), epsg)


def boundary_file(state: str, level: str, year: int, cartographic: bool = False) -> str:
    """Name of the archive a state's boundaries are published in; block groups come
    in the cartographic form only."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; one of {', '.join(LEVELS)}")
    kind, fips = {"cbg": "bg"}.get(level, level), str(state).zfill(2)
    if level == "taz":
        return f"tl_{year}_{fips}_taz10.zip"
    where = "us" if level == "county" else fips
    return f"cb_{year}_{where}_{kind}_500k.zip" if cartographic or level == "cbg" else f"tl_{year}_{where}_{kind}.zip"


def dense_boundaries(areas: Layer, population: DataFrame, utm: int, least_per_km2: float, key: str = "GEOID") -> Layer:
    """Areas whose population density reaches a least value, with density and
    percentile, in degrees."""
    flat = overlay.reproject(areas, utm)
    sized = masks.areas(flat).withColumn(key, F.col(key).cast("string"))
    rated = diagnose.with_density(sized, population.withColumn(key, F.col(key).cast("string")), key)
    kept = diagnose.dense_areas(rated, least_per_km2)
    shapes = areas.df.select(F.col(key).cast("string").alias(key), "geometry")
    return overlay.reproject(Layer(kept.join(shapes, key), areas.epsg), 4326)


def intersect_with_counties(network: Layer, counties: Layer, fips: Sequence[str] | str, prefilter: bool = False) -> Layer:
    return overlay.intersect_lines_with_zones(network, boundaries(counties, fips, network.epsg), prefilter)


def county_mask(counties: Layer, fips: Sequence[str] | str, name: str, include_water: bool = False, buffer_m: float = 0.0, utm: int | None = None) -> Layer:
    return masks.area_mask(boundaries(counties, fips, counties.epsg), include_water, buffer_m, name, utm)


def mask_overlap(a: Layer, b: Layer) -> Layer:
    """The common areas of two masks, with the attributes of both."""
    return overlay.intersect_zones_with_zones(a, b)


def first_that_works(call: Callable[[str], object], endpoints: Sequence[str]):
    """Calls with each endpoint in order, each once, until one works; raises one
    error with all failures. Without endpoints calls once with an empty one."""
    wrong = []
    for e in dict.fromkeys(endpoints) or [""]:
        try:
            return call(e)
        except Exception as err:  # noqa: BLE001
            wrong.append(f"{e or 'default'}: {err}")
    raise RuntimeError("no endpoint worked: " + "; ".join(wrong))


# -- building a network ---------------------------------------------------------------


@dataclass(frozen=True)
class LayerPlan:
    """One layer of a network: its role and the road classes it takes."""

    role: str
    highways: tuple[str, ...] = ()
    geo_level: str | None = None
    least_per_km2: float = 0.0
    buffer_m: float = 0.0


def usual_layers(least_per_km2: float, ferries: bool = False) -> tuple[LayerPlan, ...]:
    """Backbone, connecting and local roads, of which the last are dense areas'."""
    local = (*tg.LAYER_ROADS["main"], *tg.LAYER_ROADS["residential"])
    return (
        LayerPlan("backbone", tg.LAYER_ROADS["backbone"], "county", buffer_m=5000.0),
        LayerPlan("connector", tg.LAYER_ROADS["connector"], "county", buffer_m=180.0),
        *((LayerPlan("ferry", (), "county", buffer_m=10_000.0),) if ferries else ()),
        LayerPlan("residential", local, "cbg", least_per_km2, 20.0),
    )


@dataclass(frozen=True)
class NetworkPlan:
    area: str
    layers: tuple[LayerPlan, ...]
    tolerance_m: float = 2.0
    strongly_connected: bool = False
    weight_unit: str = "lbs"
    mdv_max: float = 26_000.0
    hdv_max: float = 80_000.0
    utm: int | None = None
    same: tuple[str, ...] = field(default=("highway", "lanes", "maxspeed", "bridge", "tunnel", "layer_role", "protected_backbone"))

    @classmethod
    def read(cls, path: str) -> NetworkPlan:
        """A plan from a JSON file: the fields of the plan, ``layers`` as a list of
        the fields of layers."""
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        known = {k.name for k in fields(cls)}
        if wrong := set(given) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(wrong))}")
        layers = tuple(LayerPlan(**{k: tuple(v) if isinstance(v, list) else v for k, v in p.items()}) for p in given.pop("layers"))
        return cls(layers=layers, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    @property
    def name(self) -> str:
        """Names the product after its area, density, ferries and connectivity; the
        format is a fixed value."""
        res = next((p for p in self.layers if p.role == "residential"), None)
        dense = f"-{res.geo_level}{res.least_per_km2:g}" if res else ""
        ferry = "-ferry" if any(p.role == "ferry" for p in self.layers) else ""
        return f"{self.area}{dense}{ferry}-{'strong' if self.strongly_connected else 'weak'}Conn-network"


ROLES = ("main", "backbone", "connector", "residential", "ferry")


def edges_in_area(edges: Layer, area: Layer, buffer_m: float = 0.0) -> DataFrame:
    """Edges whose line meets the area, widened by so many metres."""
    shape = overlay.reproject(area, edges.epsg)
    shape = masks.widened(shape, buffer_m) if buffer_m else shape
    one = masks.dissolve(shape).df  # one outline, so no edge is met twice
    out = overlay.spatial_left_join(edges, Layer(one.withColumn("_in", F.lit(True)), edges.epsg), zone_label="_area")
    met = next(c for c in out.df.columns if c not in edges.df.columns)
    return out.df.where(F.col(f"`{met}`")).drop(met)


def _layered(edges: DataFrame, plan: NetworkPlan, areas: dict[str, Layer] | None = None, epsg: int = 3857) -> DataFrame:
    """The layers of a plan put together; the latest one's values count. ``areas``:
    where the roads of a role are taken from; all of them without."""
    picked = []
    for p in plan.layers:
        if p.role not in ROLES:
            raise ValueError(f"unknown layer role {p.role!r}")
        e = edges.where(F.col("highway").isin(*p.highways)) if p.highways else edges
        if p.role == "ferry":
            e = tg.ferry_edges(e.where("route = 'ferry'") if "route" in e.columns else e)
        if areas and p.role in areas:
            e = edges_in_area(Layer(e, epsg), areas[p.role], p.buffer_m)
        e = e.withColumns({"layer_role": F.lit(p.role), "protected_backbone": F.lit(p.role == "backbone")})
        picked.append(e.select([F.col(f"`{c}`").cast("string").alias(c) if c in ("lanes", "hgv", "mdv", "reversed") else F.col(f"`{c}`") for c in e.columns]))
    return graph.compose(picked, ["edge_id"])


def with_speeds(edges: DataFrame) -> DataFrame:
    """``speed_kph`` from the standard maxspeed, missing ones by road class."""
    said = tg.speed_kph(F.col("maxspeed")) if "maxspeed" in edges.columns else F.lit(None).cast("double")
    given = F.coalesce(said, F.col("speed_kph").cast("double")) if "speed_kph" in edges.columns else said
    return graph.impute_speeds(edges.withColumn("speed_kph", given))


def project(nodes: DataFrame, edges: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """Nodes ``x, y`` and the lines of edges in another system."""
    at = [nodes.columns.index(c) for c in ("x", "y")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            moved = crs.transform(*(b.column(k).to_numpy(zero_copy_only=False) for k in at), source, target)
            for k, v in zip(at, moved):
                b = b.set_column(k, b.schema.field(k).name, pa.array(v, pa.float64()))
            yield b

    if source == target:
        return nodes, edges
    lines = crs.transform_column(edges, source, target) if "geometry" in edges.columns else edges
    return nodes.where("x IS NOT NULL AND y IS NOT NULL").mapInArrow(run, nodes.schema), lines


def build_network(nodes: DataFrame, edges: DataFrame, plan: NetworkPlan, areas: dict[str, Layer] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a plan from raw ones: layers by road class composed, tags
    made standard, speeds filled, crossings merged, chains simplified, ids made of
    nodes and ways, the topology cleaned, and the largest component kept.

    ``nodes (node_id, x, y)``; ``edges (edge_id, u, v, highway, oneway, ...)``; in
    degrees if the plan names a ``utm`` system, to work in and to come back from,
    else in metres. ``areas``: by role, as of :func:`dense_boundaries`, where its
    roads are taken from, widened as the plan says.
    """
    if plan.utm:
        nodes, edges = project(nodes, edges, 4326, plan.utm)
    whole = tg.process_tags(_layered(edges, plan, areas, plan.utm or 3857), plan.weight_unit, plan.mdv_max, plan.hdv_max)
    whole = stored(with_speeds(whole), "layers")
    at, led = graph.consolidate(graph.used_nodes(nodes, whole), whole, plan.tolerance_m)
    led = graph.without_self_loops(led, graph.protected(led))
    chains = graph.simplify(led, [c for c in plan.same if c in led.columns])
    ids = F.col("osmid") if "osmid" in chains.columns else F.array(F.col("chain").cast("string"))
    chains = stored(chains.withColumns({"edge_id": tg.edge_id(F.col("u"), F.col("v"), ids), "key": F.col("chain")}), "chains")
    at, chains = graph.clean_topology(stored(at, "nodes"), chains)
    part = graph.strong_components(chains) if plan.strongly_connected else graph.components(chains)
    inside = stored(graph.largest_component(part).select("node_id"), "kept")
    kept = chains.join(inside.withColumnRenamed("node_id", "u"), "u", "left_semi").join(inside.withColumnRenamed("node_id", "v"), "v", "left_semi")
    out = at.join(inside, "node_id", "left_semi"), kept.drop("chain")
    return project(*out, plan.utm, 4326) if plan.utm else out


# -- corridors ----------------------------------------------------------------------


def edges_in_box(edges: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Edges whose box meets ``(west, south, east, north)``."""
    w, s, e, n = box
    boxed = with_box(edges)
    return boxed.where((F.col("xmin") <= e) & (F.col("xmax") >= w) & (F.col("ymin") <= n) & (F.col("ymax") >= s)).select(edges.columns)


def nodes_in_box(nodes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    w, s, e, n = box
    return nodes.where(F.col("x").between(w, e) & F.col("y").between(s, n))


def near_nodes(nodes: DataFrame, edges: DataFrame, at: tuple[float, float], radius: float, k: int = 10) -> DataFrame:
    """The nearest ends of major roads, or of any if there are none near."""
    major = graph.used_nodes(nodes, edges.where(F.col("highway").isin(*MAJOR_ROADS)))
    near = graph.nearest_nodes(major, *at, radius, k)
    return near if not near.isEmpty() else graph.nearest_nodes(nodes, *at, radius, k)


def _marked(edges: DataFrame) -> Column:
    marks = [truthy(F.col(c)) for c in ("bridge", "tunnel") if c in edges.columns]
    return marks[0] | marks[1] if len(marks) == 2 else marks[0] if marks else F.lit(False)


# What a corridor's edges say of it.
CORRIDOR_STATES = {"tagged": "OK", "untagged": "no bridge/tunnel tag", "none": "MISSING"}


def check_corridor(
    nodes: DataFrame, edges: DataFrame, name: str, entry: tuple[float, float], exit_: tuple[float, float], box: tuple[float, float, float, float], radius: float
) -> dict:
    """Whether a bridge or tunnel is there, tagged, and can be driven through."""
    n = edges_in_box(edges, box).agg(F.count(F.lit(1)).alias("edges"), F.count_if(_marked(edges)).alias("marked")).first()
    start, goal = near_nodes(nodes, edges, entry, radius), near_nodes(nodes, edges, exit_, radius)
    routed = not graph.reachable(edges, start.select("node_id")).join(goal, "node_id", "left_semi").isEmpty()
    state = "tagged" if n.marked else "untagged" if n.edges else "none"
    return {"name": name, "edges": n.edges, "marked": n.marked, "nodes": nodes_in_box(nodes, box).count(), "routable": routed, "status": CORRIDOR_STATES[state]}


def corridor_edges(nodes: DataFrame, edges: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Edges in a box with the places of their ends, by ends."""
    at = lambda c: nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y"))
    inside = edges_in_box(edges, box)
    shown = [c for c in ("highway", "bridge", "tunnel", "oneway", "reversed", "length") if c in edges.columns]
    return inside.join(at("u"), "u", "left").join(at("v"), "v", "left").select("u", "u_x", "u_y", "v", "v_x", "v_y", *shown).orderBy("u", "v")


def trace_approach(
    nodes: DataFrame, edges: DataFrame, entry: tuple[float, float], exit_: tuple[float, float], box: tuple[float, float, float, float], pad: float = 0.02
) -> dict:
    """How the major roads around both ends of a corridor connect with it: nodes
    they start from, nodes in its box, how many of those are reached from the entry
    side and reach the exit side, and the start nodes nearest to the entry."""
    def around(p: tuple[float, float]) -> DataFrame:
        wide = (min(p[0], box[0]) - pad, min(p[1], box[1]) - pad, max(p[0], box[2]) + pad, max(p[1], box[3]) + pad)
        major = edges.where(F.col("highway").isin(*MAJOR_ROADS)).select(F.col("u").alias("node_id"))
        return nodes_in_box(nodes, wide).join(major, "node_id", "left_semi")

    inside, start, goal = nodes_in_box(nodes, box).select("node_id"), around(entry), around(exit_)
    forth = graph.reachable(edges, start.select("node_id")).join(inside, "node_id", "left_semi").count()
    back = graph.reachable(edges, goal.select("node_id"), backward=True).join(inside, "node_id", "left_semi").count()
    d2 = F.pow(F.col("x") - entry[0], 2) + F.pow(F.col("y") - entry[1], 2)
    nearest = [r.node_id for r in start.orderBy(d2, "node_id").limit(5).collect()]
    return {"approach_nodes": start.count(), "corridor_nodes": inside.count(), "reached": forth, "reaching": back, "nearest": nearest}


def end_gaps(edges: DataFrame, nodes: DataFrame, least_m: float, metres_per_unit: float = 111_000.0, k: int = 30) -> DataFrame:
    """Edges whose geometry ends away from their nodes, the worst first. ``edges``
    carry ``x0, y0, x1, y1`` of their geometry's ends."""
    n = lambda c: nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    gap = lambda a, b, c: F.hypot(F.col(a) - F.col(f"{c}x"), F.col(b) - F.col(f"{c}y")) * metres_per_unit
    both = edges.join(n("u"), "u").join(n("v"), "v").withColumn("gap_m", F.greatest(gap("x0", "y0", "u"), gap("x1", "y1", "v")))
    return both.where(F.col("gap_m") > least_m).orderBy(F.desc("gap_m"), "u", "v").limit(k).drop("ux", "uy", "vx", "vy")


# -- comparing and reporting ----------------------------------------------------------


def long_summary(summary: DataFrame) -> DataFrame:
    """A one-row summary as ``(metric, value)`` rows."""
    cells = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in summary.columns))
    return summary.select(F.inline(cells))


def compare_networks(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Metrics of two networks ``(nodes, edges)`` that differ."""
    return diagnose.summary_delta(long_summary(graph.validate(*a)), long_summary(graph.validate(*b)))


def tag_report(elements: DataFrame, top: int = 10) -> DataFrame:
    """Per kind of element and tag: count, different values, the most frequent
    values with their counts, and the share of elements, two decimals.

    Values are counted before they are ranked, and only the first ``top`` of a
    tag are put into its map."""
    total = elements.groupBy("type").agg(F.count(F.lit(1)).alias("_n"))
    per = elements.select("type", F.explode("tags").alias("tag", "value")).groupBy("type", "tag", "value").agg(F.count(F.lit(1)).alias("c"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("type", "tag").orderBy(F.desc("c"), "value"))
    best = per.withColumn("r", rank).where(F.col("r") <= top).groupBy("type", "tag").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "c")))).alias("top_values"))
    sums = per.groupBy("type", "tag").agg(F.sum("c").alias("count"), F.count(F.lit(1)).alias("unique_values"))
    share = F.rint(F.col("count") / F.col("_n") * 10_000.0) / 100.0
    return sums.join(best, ["type", "tag"]).join(F.broadcast(total), "type").withColumn("percent_present", share).drop("_n")


def delta_report(delta: DataFrame) -> str:
    """Metrics that differ as ``name: A=... | B=...`` lines."""
    rows = delta.orderBy("metric").collect()  # one row per metric
    return "\n".join(f"{r.metric}: A={r.a} | B={r.b}" for r in rows) or "no differences"


def text_report(rows: Sequence[dict], most: int = 50) -> str:
    """Rows as lines of ``name: value``, long values cut with dots."""
    cut = lambda v: s if len(s := str(v)) <= most else s[: most - 3] + "..."
    return "\n".join(f"{k}: {cut(v)}" for r in rows for k, v in r.items())


def way_counts(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """``(name, ways, path)`` of the first extract by name of every folder under
    ``root``, besides archives and what ``known`` lists by ``path``; an extract
    that cannot be read has 0. The listing is a table of file names; every extract
    is counted by the executors block by block."""
    from ..sources.osm import read_pbf

    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.osm.pbf").load(root).select("path")
    place = F.regexp_replace("path", "^file:/*", "/")
    folder = F.regexp_extract(place, "^(.*)/[^/]*$", 1)
    first = listing.select(place.alias("path"), folder.alias("folder")).where(~F.lower("folder").contains("archive")).groupBy("folder").agg(F.min("path").alias("path"))
    if known is not None:
        first = first.join(known.select("path"), "path", "left_anti")
    rows = []
    for r in first.orderBy("path").collect():  # one row per extract
        try:
            ways = read_pbf(spark, r.path).where("type = 'way'").count()
        except Exception:  # noqa: BLE001
            ways = 0
        rows.append((os.path.basename(r.folder), ways, r.path))
    return spark.createDataFrame(rows, "name string, ways bigint, path string")


def append_counts(counts: DataFrame, list_csv: str) -> DataFrame:
    """Adds counts to a CSV folder of them; gives the whole list."""
    counts.coalesce(1).write.mode("append").csv(list_csv, header=True)
    return known_counts(counts.sparkSession, list_csv)


def known_counts(spark: SparkSession, list_csv: str) -> DataFrame:
    schema = "name string, ways bigint, path string"
    have = files(spark, list_csv).names()
    return spark.read.schema(schema).csv(list_csv, header=True) if have else spark.createDataFrame([], schema)


def line_ids(lines: DataFrame) -> DataFrame:
    """Lines of an extract with ``osm_id`` as a number and ``edge_id`` and
    ``edge_length`` taken from their tag bag."""
    bag = F.col("other_tags")
    return lines.withColumns(
        {
            "osm_id": F.expr("try_cast(osm_id AS bigint)"),
            "edge_id": F.try_element_at(tg.parse_other_tags(bag), F.lit("edge_id")),
            "edge_length": tg.tag_as_float(bag, "length"),
        }
    )


def hit_zones(pieces: DataFrame, zone_column: str) -> DataFrame:
    """One row: zones with a piece, and pieces."""
    return pieces.agg(F.count_distinct(zone_column).alias("zones"), F.count(F.lit(1)).alias("pieces"))


def map_network(network: DataFrame, layer: DataFrame, network_id: str = "attributeOrigId") -> tuple[DataFrame, DataFrame]:
    """A network table joined to map lines by way id, and its match rate."""
    key = "edge_osm_id" if "edge_osm_id" in layer.columns else "osm_id"
    out = diagnose.join_by_id(network, layer, network_id, key)
    return out, diagnose.match_rate(out, network, network_id, network_id if network_id in out.columns else f"{network_id}_x")


def line_diagnostics(layer: Layer, utm: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Length classes of a line layer, and the sizes of the parts that lines
    joined at equal ends make: ``(component, n_nodes, n_edges, length)``."""
    import numpy as np

    from ..functions.wkb import line_length, line_parts

    flat = overlay.reproject(layer, utm) if utm else layer

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*p[0][0], *p[-1][-1], line_length(p)) for w in b.column(0).to_pylist() if (p := line_parts(w))]
            a = np.array(rows, "f8").reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, k]) for k in range(5)], names=["x0", "y0", "x1", "y1", "length"])

    lines = flat.df.select("geometry").mapInArrow(ends_of, "x0 double, y0 double, x1 double, y1 double, length double")
    edges = lines.select(F.xxhash64("x0", "y0").alias("u"), F.xxhash64("x1", "y1").alias("v"), "length")
    return diagnose.length_classes(edges, "length"), graph.fragment_report(edges, graph.components(edges))


# Names of the diagnosis of an extract.
_CLASS_NAMES = {"short": "short_links", "plotted": "links_le_500m"}


def extract_diagnosis(elements: DataFrame, utm: int) -> DataFrame:
    """One row on an extract's roads: how many, the parts they make, and length
    statistics of short links and of those up to 500 m; null where there are none."""
    from ..sources.osm import road_lines

    roads = Layer(road_lines(elements).where("highway IS NOT NULL").select("geometry"), 4326)
    lengths, parts = line_diagnostics(roads, utm)
    parts = stored(parts, "parts")
    of = lambda c, k, n: F.max(F.when(F.col("class") == c, F.col(k))).alias(n)
    row = lengths.agg(
        F.coalesce(of("all", "count", "x"), F.lit(0)).alias("retrieved_edges"), F.coalesce(of("short", "count", "x"), F.lit(0)).alias("short_links_lt_15m"),
        F.coalesce(of("long", "count", "x"), F.lit(0)).alias("long_links_gt_10km"), F.coalesce(of("plotted", "count", "x"), F.lit(0)).alias("links_le_500m_count"),
        *(of(c, k, f"{n}_{k}_m") for c, n in _CLASS_NAMES.items() for k in ("min", "max", "mean", "median")),
    )
    sizes = parts.agg(
        F.count(F.lit(1)).alias("connected_components"), F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("graph_nodes"), F.coalesce(F.sum("n_edges"), F.lit(0)).alias("graph_edges"),
        F.max("n_nodes").alias("largest_component_nodes"), F.max_by("n_edges", F.struct("n_nodes", "n_edges")).alias("largest_component_edges"),
    )
    top = parts.orderBy(F.desc("n_nodes")).limit(10).agg(F.reverse(F.array_sort(F.collect_list("n_nodes"))).alias("top_component_sizes"))
    n = elements.where("type = 'node'").agg(F.count(F.lit(1)).alias("retrieved_nodes"))
    return n.join(F.broadcast(row)).join(F.broadcast(sizes)).join(F.broadcast(top))  # one row each


def extreme_links(edges: DataFrame, length: str, short: float = 15, long: float = 10_000) -> tuple[DataFrame, DataFrame]:
    """Short links from the shortest on, and long ones from the longest on."""
    return edges.where(F.col(length) < short).orderBy(length), edges.where(F.col(length) > long).orderBy(F.desc(length))
