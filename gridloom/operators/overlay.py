"""Overlays of lines and polygons with zones, with proportional measures.

Zones that are counted to be few are held by every worker in a tree of boxes:
the other side is then read once and never moved. Beyond that slim rows of ids and
boxes meet by the grid join, geometries are joined to the pairs for the exact
test, and attributes to what is left of them. Pieces are computed in Arrow
batches. Names of both sides are made unique first, so equal names never collide.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import crs, kernels
from ..functions.core import half_even
from ..functions.planar import BoxTree
from ..functions.wkb import EMPTY_WKB, dumps, loads
from ..runtime import stored
from .layer import Layer, edge_name, label_prefix, length_column, metric_names, need_projected, zone_name
from .spatial_join import box_pairs, with_box


def reproject(layer: Layer, epsg: int) -> Layer:
    """The layer in another system; unchanged if it is in that one."""
    return layer if layer.epsg == epsg else Layer(crs.transform_column(layer.df, layer.epsg, epsg), epsg)


def _prefixed(layer: Layer, p: str) -> DataFrame:
    """All columns under a prefix of their own, without dots."""
    return layer.df.select([F.col(f"`{c}`").alias(p + c.replace(".", "·")) for c in layer.df.columns])


def _own(side: str, column: str) -> str:
    return f"`{side}·{column.replace('.', '·')}`"


def prefilter_to_bounds(zones: Layer, network: Layer) -> Layer:
    """Zones that meet the box of the whole network, exactly; none if either is
    empty. The box is one row, so it is a literal in the plan."""
    b = with_box(network.df.select("geometry")).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    if b is None or b[0] is None:
        return Layer(zones.df.limit(0), zones.epsg)
    frame = ("polygon", [[np.array([[b[0], b[1]], [b[2], b[1]], [b[2], b[3]], [b[0], b[3]], [b[0], b[1]]])]])
    near = with_box(zones.df).where((F.col("xmax") >= b[0]) & (F.col("xmin") <= b[2]) & (F.col("ymax") >= b[1]) & (F.col("ymin") <= b[3]))
    at = near.columns.index("geometry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            geoms = (loads(w) for w in batch.column(at).to_pylist())
            yield batch.filter(pa.array([g is not None and kernels.intersects(g, frame) for g in geoms], pa.bool_()))

    return Layer(near.mapInArrow(run, near.schema).select(zones.df.columns), zones.epsg)


#: Zones every worker may hold: how many, and bytes of all their columns.
HELD_ZONES, HELD_BYTES = 50_000, 64_000_000
#: Rows looked up in the tree at once.
ROWS_AT_ONCE = 4_000

_trees: dict[str, tuple[pa.Table, kernels.Areas, BoxTree, np.ndarray]] = {}

_PIECE = [T.StructField("_geometry", T.BinaryType()), T.StructField("_of_a", T.DoubleType()), T.StructField("_of_both", T.DoubleType())]


def _held(zones: DataFrame, geometry: str) -> pa.Table | None:
    """The zones if they are counted to be few and small."""
    rest = [F.col(f"`{c}`") for c in zones.columns if c != geometry]
    size = F.coalesce(F.octet_length(f"`{geometry}`"), F.lit(0)) + F.octet_length(F.to_json(F.struct(*rest))) if rest else F.octet_length(f"`{geometry}`")
    n = zones.select(size.cast("bigint").alias("size")).limit(HELD_ZONES + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    return zones.toArrow() if n.n <= HELD_ZONES and (n.size or 0) <= HELD_BYTES else None


def _tree_of(mark: str, table: pa.Table, geometry: str) -> tuple[pa.Table, kernels.Areas, BoxTree, np.ndarray]:
    """What a worker holds of the zones; of a few overlays at a time."""
    if mark not in _trees:
        wkb = table.column(geometry).to_pylist()
        box = kernels.wkb_boxes(wkb)
        some = np.flatnonzero(~np.isnan(box[:, 0]))
        while len(_trees) > 3:
            _trees.pop(next(iter(_trees)))
        _trees[mark] = table.combine_chunks(), kernels.Areas(wkb), BoxTree(box[some]), some
    return _trees[mark]


def _pairs_in_place(left: DataFrame, a: str, zones: DataFrame, table: pa.Table, b: str, test: Callable, outer: bool, extra: list[T.StructField]) -> DataFrame:
    """Rows of the left with each zone whose box theirs meets and that passes the
    test, and what the test measures; with ``outer`` also rows without any."""
    shared, mark, at = left.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex, left.columns.index(a)
    fields = left.schema.fields + zones.schema.fields + extra
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, areas, tree, some = _tree_of(mark, shared.value, b)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                wkb = batch.column(at).to_pylist()
                box = kernels.wkb_boxes(wkb)
                known = np.flatnonzero(~np.isnan(box[:, 0]))
                ask, hit = tree.query(box[known])
                ask, hit = known[ask], some[hit]
                keep, *measures = test([wkb[i] for i in ask], areas, hit)
                ask, zone = ask[keep], hit[keep]
                if outer:
                    alone = np.setdiff1d(np.arange(batch.num_rows), ask)
                    ask, zone = np.concatenate([ask, alone]), np.concatenate([zone, np.full(len(alone), -1)])
                pick = pa.array(zone, pa.int64(), mask=zone < 0)
                theirs = [c.combine_chunks().take(pick) if isinstance(c, pa.ChunkedArray) else c.take(pick) for c in held.columns]
                made = [pa.array(m, pa.binary() if isinstance(m, list) else pa.float64()) for m in measures]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(ask, pa.int64())).columns, *theirs, *made], names=names)

    return left.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]))


def _pairs_by_cells(left: DataFrame, a: str, zones: DataFrame, b: str, test: Callable, outer: bool, extra: list[T.StructField]) -> DataFrame:
    """The same through the grid join of slim rows."""
    sides, slim = [], []
    for df, column, p in ((left, a, "a·"), (zones, b, "b·")):
        df = stored(with_box(df.withColumn(f"{p}_id", F.monotonically_increasing_id()), column, f"{p}_"), "boxed")  # ids stay, as they are stored
        sides.append(df.drop(*(f"{p}_{c}" for c in ("xmin", "ymin", "xmax", "ymax"))))
        slim.append(df.select(f"{p}_id", *(f"{p}_{c}" for c in ("xmin", "ymin", "xmax", "ymax"))))
    pairs = box_pairs(*slim, "a·_", "b·_").select("a·_id", "b·_id")
    shapes = pairs.join(sides[0].select("a·_id", F.col(f"`{a}`").alias("_a")), "a·_id").join(sides[1].select("b·_id", F.col(f"`{b}`").alias("_b")), "b·_id")
    shapes = shapes.select("a·_id", "b·_id", "_a", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, *measures = test(batch.column(2).to_pylist(), *kernels.Areas.of(batch.column(3).to_pylist()))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            made = [pa.array(m, pa.binary() if isinstance(m, list) else pa.float64()) for m in measures]
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *made], names=["a·_id", "b·_id", *(f.name for f in extra)])

    ids = [T.StructField(c, T.LongType()) for c in ("a·_id", "b·_id")]
    met = shapes.mapInArrow(run, T.StructType(ids + extra))
    out = sides[0].join(met, "a·_id", "left" if outer else "inner").join(sides[1], "b·_id", "left" if outer else "inner")
    return out.select(*(F.col(f"`{c}`") for c in [*left.columns, *zones.columns, *(f.name for f in extra)]))


def _pairs(left: DataFrame, a: str, zones: DataFrame, b: str, test: Callable, outer: bool = False, extra: list[T.StructField] = _PIECE) -> DataFrame:
    table = _held(zones, b)
    if table is not None:
        return _pairs_in_place(left, a, zones, table, b, test, outer, extra)
    return _pairs_by_cells(left, a, zones, b, test, outer, extra)


def _meets(wkb: list, areas: kernels.Areas, which: np.ndarray) -> tuple[np.ndarray]:
    return (kernels.meeting_areas(wkb, areas, which),)


def _ratio(part: Column, whole: Column) -> Column:
    return half_even(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), 4)


def _named_zones(columns: list[str], taken: list[str], label: str | None) -> list[tuple[str, str]]:
    out, seen = [], set(taken)
    for c in columns:
        name = zone_name(c, seen, label_prefix(label))
        seen.add(name)
        out.append((c, name))
    return out


def _with_voids(result: DataFrame, zones: Layer, hit: DataFrame, named: list[tuple[str, str]]) -> DataFrame:
    """Adds a row for each zone without a piece: null measures and left-hand
    attributes, an empty geometry. Zones are told apart by all their values."""
    marked = zones.df.withColumn("_z", F.xxhash64(*[F.col(f"`{c}`") for c in zones.df.columns]))
    void = marked.join(hit.distinct(), "_z", "left_anti")
    cols = {n: F.col(f"`{c}`") for c, n in named}
    row = [
        (F.lit(EMPTY_WKB) if f.name == "geometry" else cols.get(f.name, F.lit(None).cast(f.dataType))).alias(f.name)
        for f in result.schema.fields
    ]
    return result.unionByName(void.select(row))


def _overlay(
    left: Layer, zones: Layer, kernel: Callable, prefilter: bool, output_epsg: int | None,
    outputs: Callable[[], tuple[list[Column], list[tuple[str, str]]]],
) -> Layer:
    zones = reproject(zones, left.epsg)
    if prefilter:
        zones = prefilter_to_bounds(zones, left)
    b = _prefixed(zones, "b·")
    if prefilter:
        b = b.withColumn("b·_z", F.xxhash64(*[F.col(f"`{c}`") for c in b.columns]))
    met = _pairs(_prefixed(left, "a·"), "a·geometry", b, "b·geometry", kernel)
    cols, named = outputs()
    if prefilter:
        met = stored(met, "pieces")
    result = met.select(cols)
    if prefilter:
        result = _with_voids(result, zones, met.select(F.col("b·_z").alias("_z")), named)
    return reproject(Layer(result, left.epsg), output_epsg or left.epsg)


def intersect_lines_with_zones(
    network: Layer, zones: Layer, prefilter: bool = False, zone_label: str | None = None, output_epsg: int | None = None
) -> Layer:
    """One row per line and zone that share a stretch: its length, the line's and
    their ratio (2 and 4 decimals, half to even; 0 for lines without a length),
    the piece and all attributes. With ``prefilter`` zones in the network's box
    but without a piece get a row with null measures. Input measures are replaced.
    """
    need_projected(network, "network")
    m = metric_names("line", zone_label)

    def outputs():
        edges = [c for c in network.attributes if edge_name(c) not in m.values()]
        names = [edge_name(c) for c in edges]
        whole, part = half_even(F.col("_of_a"), 2), half_even(F.col("_of_both"), 2)
        named = _named_zones([c for c in zones.attributes], [*m.values(), *names], zone_label)
        cols = [
            _ratio(part, whole).alias(m["proportion"]), whole.alias(m["edge_length"]), part.alias(m["zone_length"]),
            F.col("_geometry").alias("geometry"), *(F.col(_own("a", c)).alias(n) for c, n in zip(edges, names)),
            *(F.col(_own("b", c)).alias(n) for c, n in named),
        ]
        return cols, named

    return _overlay(network, zones, kernels.lines_in_areas, prefilter, output_epsg, outputs)


def intersect_polygons_of_roads_with_zones(
    network: Layer, zones: Layer, prefilter: bool = True, length_col: str | None = None, zone_label: str | None = None, output_epsg: int | None = None
) -> Layer:
    """Road polygons cut by zones: shares by area, link length times the share,
    and both surfaces. The length is multiplied before it is rounded."""
    need_projected(network, "network")
    m = metric_names("polygon", zone_label)
    lc = length_column(network.attributes, length_col)

    def outputs():
        edges = [c for c in network.attributes if edge_name(c) not in m.values()]
        names = [edge_name(c) for c in edges]
        whole, part = half_even(F.col("_of_a"), 2), half_even(F.col("_of_both"), 2)
        link, share = F.col(_own("a", lc)).try_cast("double"), _ratio(part, whole)
        named = _named_zones([c for c in zones.attributes], [*m.values(), *names], zone_label)
        cols = [
            share.alias(m["proportion"]), half_even(link, 2).alias(m["edge_length"]), half_even(link * share, 2).alias(m["zone_length"]),
            whole.alias(m["edge_surface"]), part.alias(m["zone_surface"]), F.col("_geometry").alias("geometry"),
            *(F.col(_own("a", c)).alias(n) for c, n in zip(edges, names)), *(F.col(_own("b", c)).alias(n) for c, n in named),
        ]
        return cols, named

    return _overlay(network, zones, kernels.polygons_in_areas, prefilter, output_epsg, outputs)


def cascade_polygons_with_zones(
    polygons: Layer, zones: Layer, prefilter: bool = True, length_col: str | None = None, zone_label: str | None = None, output_epsg: int | None = None
) -> Layer:
    """Pieces of an earlier overlay cut again: all their columns stay, five
    measures and the zone's attributes are added. Here the length is rounded
    before it is multiplied."""
    need_projected(polygons, "polygons")
    m = metric_names("cascade", zone_label)
    lc = length_column(polygons.attributes, length_col, cascade=True)

    def outputs():
        kept = [c for c in polygons.attributes if c not in m.values()]
        whole, part = half_even(F.col("_of_a"), 2), half_even(F.col("_of_both"), 2)
        piece, share = half_even(F.col(_own("a", lc)).try_cast("double"), 2), _ratio(part, whole)
        named = _named_zones([c for c in zones.attributes], [*m.values(), *kept], zone_label)
        cols = [
            *(F.col(_own("a", c)).alias(c) for c in kept), share.alias(m["proportion"]), piece.alias(m["piece_length"]),
            half_even(piece * share, 2).alias(m["zone_length"]), whole.alias(m["piece_surface"]), part.alias(m["zone_surface"]),
            F.col("_geometry").alias("geometry"), *(F.col(_own("b", c)).alias(n) for c, n in named),
        ]
        return cols, named

    return _overlay(polygons, zones, kernels.polygons_in_areas, prefilter, output_epsg, outputs)


def spatial_left_join(layer: Layer, zones: Layer, zone_label: str | None = None, output_epsg: int | None = None) -> Layer:
    """Every row of the layer with the attributes of each zone it meets (borders
    count), null where it meets none; geometries stay whole."""
    zones = reproject(zones, layer.epsg)
    named = _named_zones(zones.attributes, layer.df.columns, zone_label)
    out = _pairs(_prefixed(layer, "a·"), "a·geometry", _prefixed(zones, "b·"), "b·geometry", _meets, outer=True, extra=[])
    cols = [F.col(_own("a", c)).alias(c) for c in layer.df.columns] + [F.col(_own("b", c)).alias(n) for c, n in named]
    return reproject(Layer(out.select(cols), layer.epsg), output_epsg or layer.epsg)


def intersect_zones_with_zones(a: Layer, b: Layer, output_epsg: int | None = None) -> Layer:
    """Common areas of two zone layers with the attributes of both, prefixed
    ``zone_a_`` and ``zone_b_``; no measures, any system."""
    epsg = output_epsg or a.epsg
    a, b = reproject(a, epsg), reproject(b, epsg)

    def outputs():
        cols = [F.col(_own("a", c)).alias(f"zone_a_{c}") for c in a.attributes] + [F.col(_own("b", c)).alias(f"zone_b_{c}") for c in b.attributes]
        return [*cols, F.col("_geometry").alias("geometry")], []

    return _overlay(a, b, kernels.polygons_in_areas, False, epsg, outputs)


def crossing_boundaries(layer: Layer, zones: Layer) -> Layer:
    """Rows of the layer that meet the border of any zone: those of which an
    overlay cuts something. The others lie whole in one zone or in none."""
    zones = reproject(zones, layer.epsg)
    at = zones.df.columns.index("geometry")

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w in b.column(at).to_pylist():
                g = loads(w)
                out.append(dumps(("line", [r for p in g[1] for r in p])) if g and g[0] == "polygon" else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["geometry"])

    borders = zones.df.mapInArrow(rings, "geometry binary").where("geometry IS NOT NULL").withColumnRenamed("geometry", "b·geometry")
    left = layer.df.withColumn("_row", F.expr("uuid()"))
    left = stored(left, "left-rows")  # ids stay the same when read again
    slim = left.select(F.col("_row").alias("a·_row"), F.col("geometry").alias("a·geometry"))
    hit = _pairs(slim, "a·geometry", borders, "b·geometry", _meets, extra=[]).select(F.col("a·_row").alias("_row")).distinct()
    return Layer(left.join(hit, "_row", "left_semi").drop("_row"), layer.epsg)
