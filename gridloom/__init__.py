"""Spatial network analytics on Spark; the calls of :mod:`gridloom.api` by name."""

from importlib import import_module

_ELSEWHERE = {"create_osm_highway_filter": ("functions.tags", "highway_filter"), "export_network": ("sources.sinks", "export_network")}
__all__ = [  # noqa: F822
    "build_area_mask_from_counties", "build_network_from_extract", "compare_osm_pbf_artifacts", "create_osm_highway_filter", "diagnose_built_osm_pbf", "diagnose_osm", "export_network",
    "intersect_polygons_with_zones", "intersect_road_network_with_county_zones", "intersect_road_network_with_zones", "intersect_road_polygons_with_zones", "intersect_zones_with_zones",
    "map_network_csv_to_osm_pbf", "map_osm_with_network", "match_road_network_geometries", "spatial_left_join_with_zones",
]


def __getattr__(name: str) -> object:
    if name not in __all__:
        raise AttributeError(name)
    module, own = _ELSEWHERE.get(name, ("api", name))
    return getattr(import_module(f"{__name__}.{module}"), own)
