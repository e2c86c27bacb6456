"""Overlay queries on the derived layers, and the closed-form SQL for boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlay
from ..operators.layer import Layer
from . import fixtures as fx

_LINE = ["edge_id", "zone_id", "edge_link_length_m", "zone_link_length_m", "zone_edge_proportion"]


def _lines(spark: SparkSession, d: str, **kw) -> DataFrame:
    out = overlay.intersect_lines_with_zones(fx.lines(spark, d), fx.zones(spark, d), **kw).df
    return out.withColumnRenamed("zone_zone_id", "zone_id")


def line_zone_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select(_LINE)


# zones of two regions shrunk to corners that no line meets
_CORNERS = "select zone_id, xmin, ymin, case when n_regionkey < 2 then xmin + 0.25 else xmax end xmax, case when n_regionkey < 2 then ymin + 0.25 else ymax end ymax from ({zones}) join {{nation}} on n_nationkey = zone_id".format(zones=fx.ZONES)


def line_zone_overlap_voids(spark: SparkSession, d: str) -> DataFrame:
    """Zones in the network's box without a piece get a row of nulls."""
    corners = Layer(fx.shaped(fx.derived(spark, d, _CORNERS), "box"), 3857)
    out = overlay.intersect_lines_with_zones(fx.lines(spark, d), corners, prefilter=True).df
    return out.select("edge_id", F.col("zone_zone_id").alias("zone_id"), *_LINE[2:])


def line_zone_chained(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of a first overlay cut by half zones: labels, no stacked prefixes."""
    first = overlay.intersect_lines_with_zones(fx.lines(spark, d), fx.zones(spark, d))
    halves = fx.shaped(
        fx.derived(spark, d, fx.ZONES).withColumn("xmax", F.col("xmin") + 128).withColumnRenamed("zone_id", "half_id").drop("zone_name"), "box"
    )
    second = overlay.intersect_lines_with_zones(first, Layer(halves, 3857), zone_label="Half").df
    return second.select(
        "edge_id", "zone_zone_id", "half_id", "half_edge_link_length_m", "half_zone_link_length_m", "half_zone_edge_proportion"
    )


def polygon_zone_overlap(spark: SparkSession, d: str) -> DataFrame:
    out = overlay.intersect_polygons_of_roads_with_zones(fx.roads(spark, d), fx.zones(spark, d), prefilter=False, length_col="length").df
    return out.select(
        "edge_link_id", F.col("zone_zone_id").alias("zone_id"), "edge_link_length_m", "zone_link_length_m", "zone_edge_proportion",
        "edge_surface_m2", "zone_surface_m2",
    )


def polygon_cascade(spark: SparkSession, d: str) -> DataFrame:
    out = overlay.cascade_polygons_with_zones(fx.roads(spark, d), fx.zones(spark, d), prefilter=False).df
    return out.select(
        "link_id", "brand", F.col("zone_zone_id").alias("zone_id"), "piece_link_length_m", "zone_piece_length_m",
        "zone_piece_proportion", "piece_surface_m2", "zone_surface_m2",
    )


def spatial_left_join(spark: SparkSession, d: str) -> DataFrame:
    return overlay.spatial_left_join(fx.lines(spark, d), fx.zones(spark, d)).df.select("edge_id", "osm_id", F.col("zone_zone_id").alias("zone_id"))


def zone_zone_overlay(spark: SparkSession, d: str) -> DataFrame:
    out = overlay.intersect_zones_with_zones(fx.zones(spark, d), fx.roads(spark, d)).df
    return out.select(F.col("zone_a_zone_id").alias("zone_id"), F.col("zone_b_link_id").alias("link_id"))


# a tiling four times as wide, of which the lines reach a part
_WIDE = "select zone_id, zone_name, xmin * 4 xmin, xmax * 4 xmax, ymin * 4 ymin, ymax * 4 ymax from ({zones})".format(zones=fx.ZONES)


def bbox_prefilter(spark: SparkSession, d: str) -> DataFrame:
    wide = Layer(fx.shaped(fx.derived(spark, d, _WIDE), "box"), 3857)
    return overlay.prefilter_to_bounds(wide, fx.lines(spark, d)).df.select("zone_id", "zone_name")


_Z, _L, _R = fx.duck(fx.ZONES), fx.duck(fx.LINES), fx.duck(fx.ROADS)
_PIECES = f"""z AS ({_Z}), l AS ({_L}),
p AS (SELECT l.*, z.zone_id, zone_name, xmin, xmax, ymin, ymax,
 greatest(least(x0, x1), xmin) ax, least(greatest(x0, x1), xmax) bx, greatest(least(y0, y1), ymin) ay, least(greatest(y0, y1), ymax) by_
 FROM l JOIN z ON least(x0, x1) <= xmax AND greatest(x0, x1) >= xmin AND least(y0, y1) <= ymax AND greatest(y0, y1) >= ymin),
q AS (SELECT *, round_even(abs(x1 - x0) + abs(y1 - y0), 2) el, round_even((bx - ax) + (by_ - ay), 2) zl FROM p WHERE (bx - ax) + (by_ - ay) > 0)"""
_AREAS = f"""z AS ({_Z}), r AS ({_R}),
p AS (SELECT r.*, z.zone_id, (r.xmax - r.xmin) * (r.ymax - r.ymin) ea,
 (least(r.xmax, z.xmax) - greatest(r.xmin, z.xmin)) * (least(r.ymax, z.ymax) - greatest(r.ymin, z.ymin)) za
 FROM r JOIN z ON r.xmin < z.xmax AND z.xmin < r.xmax AND r.ymin < z.ymax AND z.ymin < r.ymax),
q AS (SELECT *, round_even(za / ea, 4) s FROM p)"""

QUERIES = {
    f.__name__: f
    for f in (
        line_zone_overlap, line_zone_overlap_voids, line_zone_chained, polygon_zone_overlap, polygon_cascade,
        spatial_left_join, zone_zone_overlay, bbox_prefilter,
    )
}
SQL = {
    "line_zone_overlap": f"WITH {_PIECES} SELECT edge_id, zone_id, el AS edge_link_length_m, zl AS zone_link_length_m, round_even(zl / el, 4) AS zone_edge_proportion FROM q",
    "line_zone_overlap_voids": f"""WITH {_PIECES.replace(_Z, fx.duck(_CORNERS).replace("select zone_id,", "select zone_id, null as zone_name,", 1))},
b AS (SELECT min(least(x0, x1)) a, max(greatest(x0, x1)) b, min(least(y0, y1)) c, max(greatest(y0, y1)) d FROM l)
SELECT edge_id, zone_id, el AS edge_link_length_m, zl AS zone_link_length_m, round_even(zl / el, 4) AS zone_edge_proportion FROM q
UNION ALL SELECT NULL, zone_id, NULL, NULL, NULL FROM z, b WHERE xmax >= a AND xmin <= b AND ymax >= c AND ymin <= d AND zone_id NOT IN (SELECT zone_id FROM q)""",
    "line_zone_chained": f"""WITH {_PIECES}, h AS (SELECT zone_id AS half_id, xmin hx, xmin + 128 hX2, ymin hy, ymax hY2 FROM z),
c AS (SELECT edge_id, zone_id, half_id, (bx - ax) + (by_ - ay) pl, (least(bx, hX2) - greatest(ax, hx)) + (least(by_, hY2) - greatest(ay, hy)) cl
 FROM q JOIN h ON ax <= hX2 AND bx >= hx AND ay <= hY2 AND by_ >= hy)
SELECT edge_id, zone_id AS zone_zone_id, half_id, round_even(pl, 2) AS half_edge_link_length_m, round_even(cl, 2) AS half_zone_link_length_m,
 round_even(cl / pl, 4) AS half_zone_edge_proportion FROM c WHERE cl > 0""",
    "polygon_zone_overlap": f"""WITH {_AREAS} SELECT link_id AS edge_link_id, zone_id, length AS edge_link_length_m, rint_even(length * s) AS zone_link_length_m,
 s AS zone_edge_proportion, ea AS edge_surface_m2, za AS zone_surface_m2 FROM q""".replace("rint_even(length * s)", "round_even(length * s * 100, 0) / 100"),
    "polygon_cascade": f"""WITH {_AREAS} SELECT link_id, brand, zone_id, length AS piece_link_length_m, round_even(length * s * 100, 0) / 100 AS zone_piece_length_m,
 s AS zone_piece_proportion, ea AS piece_surface_m2, za AS zone_surface_m2 FROM q""",
    "spatial_left_join": f"WITH {_PIECES} SELECT l.edge_id, l.osm_id, p.zone_id FROM l LEFT JOIN p ON l.edge_id = p.edge_id",
    "zone_zone_overlay": f"WITH {_AREAS} SELECT zone_id, link_id FROM q",
    "bbox_prefilter": f"""WITH l AS ({_L}), b AS (SELECT min(least(x0, x1)) a, max(greatest(x0, x1)) b, min(least(y0, y1)) c, max(greatest(y0, y1)) d FROM l)
SELECT zone_id, zone_name FROM ({fx.duck(_WIDE)}), b WHERE xmax >= a AND xmin <= b AND ymax >= c AND ymin <= d""",
}
