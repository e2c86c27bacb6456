"""Command line: ``python -m gridloom.cli COMMAND``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import graph, recipes
from .runtime import scope, session, ship
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom", description="Road-network and zonal analytics on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("build", help="build a network from an extract")
    s.add_argument("extract")
    s.add_argument("plan", help="JSON file of the plan")
    s.add_argument("work_dir")
    s.add_argument("--area", nargs=2, action="append", default=[], metavar=("ROLE", "LAYER"), help="where the roads of a role are taken from")
    s.add_argument("--area-epsg", type=int, default=4326)
    s.add_argument("--formats", nargs="+", default=list(sinks.FORMATS), choices=sinks.FORMATS)
    for mode in ("intersect", "intersect-polygons", "cascade", "left-join"):
        s = sub.add_parser(mode, help=f"{mode} of a layer with zones")
        s.add_argument("network")
        s.add_argument("zones")
        s.add_argument("output")
        s.add_argument("--epsg", type=int, required=True, help="projected system of the network")
        s.add_argument("--zones-epsg", type=int)
        s.add_argument("--output-epsg", type=int)
        s.add_argument("--label")
        if mode != "left-join":
            s.add_argument("--prefilter", action="store_true")
        if mode in ("intersect-polygons", "cascade"):
            s.add_argument("--length-col")
    s = sub.add_parser("map", help="join a network table to map lines by way id")
    s.add_argument("network")
    s.add_argument("layer", help="GeoPackage, GeoJSON, Parquet or PBF")
    s.add_argument("output")
    s.add_argument("--network-id", default="attributeOrigId")
    s = sub.add_parser("map-pbf", help="the same for a table in CSV and an extract")
    s.add_argument("network")
    s.add_argument("extract")
    s.add_argument("output")
    s.add_argument("--network-id", default="attributeOrigId")
    s = sub.add_parser("diagnose", help="connectivity, lengths and tags of an extract")
    s.add_argument("extract")
    s.add_argument("--utm", type=int, required=True)
    s = sub.add_parser("diagnose-built", help="judge the network beside an extract, and diagnose the extract")
    s.add_argument("extract")
    s.add_argument("--utm", type=int, required=True)
    s.add_argument("--graph")
    s.add_argument("--osm-xml")
    s.add_argument("--skip-extract", action="store_true")
    s = sub.add_parser("compare-pbf", help="metrics in which two extracts and their networks differ")
    s.add_argument("a")
    s.add_argument("b")
    s.add_argument("--utm-a", type=int, required=True)
    s.add_argument("--utm-b", type=int)
    for side in "ab":
        s.add_argument(f"--graph-{side}")
        s.add_argument(f"--osm-xml-{side}")
    s = sub.add_parser("validate", help="judge a network of node and edge tables")
    s.add_argument("nodes")
    s.add_argument("edges")
    s = sub.add_parser("convert", help="write an extract in another format")
    s.add_argument("extract")
    s.add_argument("output")
    return p


def run(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    spark = session("gridloom-cli")
    ship(spark)
    with scope(spark):
        return _run(spark, a)


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "build":
        for kind, path in api.build_network_from_extract(a.extract, a.plan, a.work_dir, tuple(a.formats), dict(a.area), a.area_epsg).items():
            print(f"{kind}: {path}")
    elif a.command == "intersect":
        api.intersect_road_network_with_zones(a.network, a.epsg, a.zones, a.output, a.output_epsg, a.prefilter, a.label, a.zones_epsg)
    elif a.command == "intersect-polygons":
        api.intersect_road_polygons_with_zones(a.network, a.epsg, a.zones, a.output, a.output_epsg, a.prefilter, a.length_col, a.label, a.zones_epsg)
    elif a.command == "cascade":
        api.intersect_polygons_with_zones(a.network, a.epsg, a.zones, a.output, a.output_epsg, a.prefilter, a.length_col, a.label, a.zones_epsg)
    elif a.command == "left-join":
        api.spatial_left_join_with_zones(a.network, a.epsg, a.zones, a.output, a.output_epsg, a.label, a.zones_epsg)
    elif a.command == "map":
        api.map_osm_with_network(a.layer, a.network, a.network_id, a.output)
    elif a.command == "map-pbf":
        api.map_network_csv_to_osm_pbf(a.network, a.extract, a.output, a.network_id)
    elif a.command == "diagnose":
        api.diagnose_osm(a.extract, a.utm)
        recipes.tag_report(api.read_extract(a.extract)).orderBy(F.desc("count"), "type", "tag").show(30, truncate=50)
    elif a.command == "diagnose-built":
        try:
            api.diagnose_built_osm_pbf(a.extract, a.utm, a.graph, a.osm_xml, a.skip_extract)
        except RuntimeError as e:
            print(e, file=sys.stderr)
            return 1
    elif a.command == "compare-pbf":
        api.compare_osm_pbf_artifacts(a.a, a.b, a.utm_a, a.utm_b, a.graph_a, a.graph_b, a.osm_xml_a, a.osm_xml_b)
    elif a.command == "validate":
        summary = graph.validate(spark.read.parquet(a.nodes), spark.read.parquet(a.edges))
        summary.show(vertical=True)
        try:
            graph.assert_valid(summary)
        except RuntimeError as e:
            print(e, file=sys.stderr)
            return 1
    elif a.command == "convert":
        el = api.read_extract(a.extract)
        if a.output.endswith(".pbf"):
            sinks.write_pbf(el, a.output)
        else:
            sinks.save_table(el, a.output)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
