"""Calls by file paths, for scripts: each reads its inputs by their ending, runs one
operator and writes the result where it is asked to, once.

Arguments may be paths, layers or DataFrames in the system given beside them. The
session is the active one, or a local one is started. Results are DataFrames whose
``geometry`` is WKB.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import diagnose, graph, overlay, recipes
from .operators.layer import Layer
from .runtime import session, ship
from .sources import osm, sinks, vector

Source = DataFrame | Layer | str


def _spark() -> SparkSession:
    spark = SparkSession.getActiveSession() or session("gridloom")
    ship(spark)
    return spark


def _once(path: str | None, key: dict, make: Callable[[], Layer]) -> DataFrame:
    """The layer at ``path`` if it was made of the same inputs, else made anew; an
    empty result is neither written nor remembered."""
    spark = _spark()
    if path and sinks.cached(path, known := sinks.cache_key(**key)):
        return vector.load_layer(spark, path, key["epsg"]).df
    out = make()
    if not path:
        return out.df
    if out.df.isEmpty():
        return out.df
    sinks.save_layer(out, path)
    sinks.note_cache(path, known)
    return vector.load_layer(spark, path, out.epsg).df


def _overlay(operator: Callable, left: Source, left_epsg: int, zones: Source, zones_epsg: int | None, output_path: str | None, output_epsg: int | None, **kw) -> DataFrame:
    spark = _spark()
    key = {"operator": operator.__name__, "left": left, "left_epsg": left_epsg, "zones": zones, "epsg": output_epsg or left_epsg, **kw}
    return _once(
        output_path, key, lambda: operator(vector.load_layer(spark, left, left_epsg), vector.load_layer(spark, zones, zones_epsg or left_epsg), output_epsg=output_epsg, **kw)
    )


def intersect_road_network_with_zones(
    road_network: Source, road_network_epsg: int, zones: Source, output_path: str | None = None, output_epsg: int | None = None,
    prefilter_zones_to_network_bbox: bool = False, zone_label: str | None = None, zones_epsg: int | None = None,
) -> DataFrame:
    return _overlay(
        overlay.intersect_lines_with_zones, road_network, road_network_epsg, zones, zones_epsg, output_path, output_epsg, prefilter=prefilter_zones_to_network_bbox, zone_label=zone_label
    )


def intersect_road_polygons_with_zones(
    road_network: Source, road_network_epsg: int, zones: Source, output_path: str | None = None, output_epsg: int | None = None,
    prefilter_zones_to_network_bbox: bool = True, edge_length_col: str | None = None, zone_label: str | None = None, zones_epsg: int | None = None,
) -> DataFrame:
    return _overlay(
        overlay.intersect_polygons_of_roads_with_zones, road_network, road_network_epsg, zones, zones_epsg, output_path, output_epsg,
        prefilter=prefilter_zones_to_network_bbox, length_col=edge_length_col, zone_label=zone_label,
    )


def intersect_polygons_with_zones(
    polygons: Source, polygons_epsg: int, zones: Source, output_path: str | None = None, output_epsg: int | None = None,
    prefilter_zones_to_network_bbox: bool = True, piece_length_col: str | None = None, zone_label: str | None = None, zones_epsg: int | None = None,
) -> DataFrame:
    return _overlay(
        overlay.cascade_polygons_with_zones, polygons, polygons_epsg, zones, zones_epsg, output_path, output_epsg,
        prefilter=prefilter_zones_to_network_bbox, length_col=piece_length_col, zone_label=zone_label,
    )


def spatial_left_join_with_zones(
    gdf: Source, gdf_epsg: int, zones: Source, output_path: str | None = None, output_epsg: int | None = None, zone_label: str | None = None, zones_epsg: int | None = None
) -> DataFrame:
    return _overlay(overlay.spatial_left_join, gdf, gdf_epsg, zones, zones_epsg, output_path, output_epsg, zone_label=zone_label)


def intersect_zones_with_zones(
    zones_a: Source, zones_a_epsg: int, zones_b: Source, zones_b_epsg: int, output_path: str | None = None, output_epsg: int | None = None
) -> DataFrame:
    return _overlay(overlay.intersect_zones_with_zones, zones_a, zones_a_epsg, zones_b, zones_b_epsg, output_path, output_epsg)


def intersect_road_network_with_county_zones(
    road_network: Source, road_network_epsg: int, counties: Source, county_fips_codes: Sequence[str] | str, counties_epsg: int = 4269,
    output_path: str | None = None, output_epsg: int | None = None, prefilter_zones_to_network_bbox: bool = False,
) -> DataFrame:
    """Counties come from a boundary file instead of a download."""
    spark = _spark()
    key = {"operator": "counties", "left": road_network, "zones": counties, "fips": county_fips_codes, "epsg": output_epsg or road_network_epsg, "prefilter": prefilter_zones_to_network_bbox}

    def make() -> Layer:
        network = vector.load_layer(spark, road_network, road_network_epsg)
        out = recipes.intersect_with_counties(network, vector.load_layer(spark, counties, counties_epsg), county_fips_codes, prefilter_zones_to_network_bbox)
        return overlay.reproject(out, output_epsg or road_network_epsg)

    return _once(output_path, key, make)


def build_area_mask_from_counties(
    counties: Source, county_fips_codes: Sequence[str] | str, area_name: str = "study_area", output_epsg: int = 4326, include_water: bool = False,
    buffer_m: float = 0.0, output_path: str | None = None, counties_epsg: int = 4269, utm_epsg: int | None = None,
) -> DataFrame:
    spark = _spark()
    mask = recipes.county_mask(vector.load_layer(spark, counties, counties_epsg), county_fips_codes, area_name, include_water, buffer_m, utm_epsg)
    mask = overlay.reproject(mask, output_epsg)
    if output_path:
        sinks.save_layer(mask, output_path)
    return mask.df


def _map_layer(spark: SparkSession, path: str) -> Layer:
    if path.lower().endswith(".pbf"):
        return Layer(recipes.line_ids(osm.road_lines(osm.read_pbf(spark, path)).drop("tags")), 4326)
    layer = vector.load_osm_edges(spark, path) if path.lower().endswith(".gpkg") else vector.load_layer(spark, path, 4326)
    return Layer(recipes.line_ids(layer.df), layer.epsg) if "other_tags" in layer.df.columns else layer


def map_osm_with_network(osm_path: str, network_path: str, network_osm_id_col: str = "attributeOrigId", output_path: str | None = None) -> DataFrame:
    """A network table joined to the lines of an extract or layer by way id; prints
    the share of ids that match."""
    spark = _spark()
    network = vector.read_csv(spark, network_path) if ".csv" in network_path.lower() else spark.read.parquet(network_path)
    layer = _map_layer(spark, osm_path)
    out, rate = recipes.map_network(network, layer.df, network_osm_id_col)
    print(recipes.text_report([rate.first().asDict()]))
    if output_path:
        sinks.save_table(out, output_path, layer.epsg)
    return out


def map_network_csv_to_osm_pbf(network_csv_path: str, osm_pbf_path: str, output_path: str, network_osm_id_col: str = "attributeOrigId") -> DataFrame:
    if not osm_pbf_path.lower().endswith(".pbf"):
        raise ValueError(f"the extract must be a .pbf file, not {osm_pbf_path}")
    if not output_path.lower().endswith((".parquet", ".gpkg", ".geojson")):
        raise ValueError("the result must be written to .parquet, .gpkg or .geojson")
    return map_osm_with_network(osm_pbf_path, network_csv_path, network_osm_id_col, output_path)


def read_extract(path: str) -> DataFrame:
    return osm.read_pbf(_spark(), path) if path.lower().endswith(".pbf") else osm.read_xml(_spark(), path)


def diagnose_osm(pbf_path: str, epsg_utm: int) -> DataFrame:
    """Prints and gives the diagnosis of an extract."""
    out = recipes.extract_diagnosis(read_extract(pbf_path), epsg_utm)
    print(recipes.text_report([out.first().asDict()], 200))
    return out


def _built(pbf_path: str, utm: int, graph_path: str | None, osm_xml: str | None) -> DataFrame | None:
    """The judgement of the network beside an extract, if there is one."""
    beside = osm.sidecars(pbf_path)
    at, xml = graph_path or beside["graph"], osm_xml or beside["osm"]
    if not at or not os.path.exists(at):
        print("no built network is beside the extract")
        return None
    nodes, edges = osm.load_graph(_spark(), at)
    plane, _ = recipes.project(nodes, edges.drop("geometry"), 4326, utm)
    return graph.validate(nodes, edges, extract=read_extract(xml) if xml and os.path.exists(xml) else None, plane=plane)


def diagnose_built_osm_pbf(pbf_path: str, epsg_utm: int, graph_path: str | None = None, osm_xml_path: str | None = None, skip_pbf_diagnostics: bool = False) -> None:
    """Judges the network beside an extract, raising what is wrong, and diagnoses
    the extract."""
    summary = _built(pbf_path, epsg_utm, graph_path, osm_xml_path)
    if summary is not None:
        print(recipes.text_report([summary.first().asDict()]))
        graph.assert_valid(summary)
    if not skip_pbf_diagnostics:
        diagnose_osm(pbf_path, epsg_utm)


def compare_osm_pbf_artifacts(
    pbf_a: str, pbf_b: str, epsg_utm_a: int, epsg_utm_b: int | None = None, graph_a: str | None = None, graph_b: str | None = None, osm_xml_a: str | None = None, osm_xml_b: str | None = None
) -> str:
    """Metrics in which two extracts and the networks beside them differ."""
    a, b = _built(pbf_a, epsg_utm_a, graph_a, osm_xml_a), _built(pbf_b, epsg_utm_b or epsg_utm_a, graph_b, osm_xml_b)
    parts = [recipes.delta_report(diagnose.summary_delta(recipes.long_summary(a), recipes.long_summary(b)))] if a is not None and b is not None else []
    sides = [recipes.extract_diagnosis(read_extract(p), e).drop("top_component_sizes") for p, e in ((pbf_a, epsg_utm_a), (pbf_b, epsg_utm_b or epsg_utm_a))]
    parts.append(recipes.delta_report(diagnose.summary_delta(*map(recipes.long_summary, sides))))
    print("\n".join(parts))
    return "\n".join(parts)


def build_network_from_extract(
    extract_path: str, plan_path: str, work_dir: str, formats: tuple[str, ...] = sinks.FORMATS, areas: dict[str, Source] | None = None, areas_epsg: int = 4326
) -> dict[str, str]:
    """Builds the network of a plan file from an extract, the roads of a role from
    within its area if one is given, and writes it; format -> path."""
    plan = recipes.NetworkPlan.read(plan_path)
    within = {role: vector.load_layer(_spark(), a, areas_epsg) for role, a in (areas or {}).items()}
    nodes, edges = recipes.build_network(*osm.road_graph(read_extract(extract_path)), plan, within)
    wrong = graph.invalid_coordinates(nodes).count() if plan.utm else 0
    if wrong:
        print(f"{wrong} nodes have no valid coordinates")
    tags = ["highway", "name", "lanes", "maxspeed", "oneway", "access", "bridge", "tunnel", "length", "edge_id", "hgv", "mdv"]
    layer = Layer(edges.drop("reversed"), 4326 if plan.utm else 3857)
    return sinks.export_network(nodes, layer, f"{work_dir.rstrip('/')}/network/{plan.name}", plan.name, tags, formats, {"length": F.sum})


def match_road_network_geometries(*_: object, **__: object) -> None:
    """Not offered; records without keys are matched by the linkage operator."""
    raise NotImplementedError("networks are matched by their ids, or by the linkage operator")
