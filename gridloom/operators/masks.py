"""Study-area masks: union or hull of a layer, widened, in one row.

Hulls are folded partition by partition first, so only hull points meet in one
task; points that are inside a partition's hull cannot be on the whole hull.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crs, kernels
from ..functions.wkb import dumps, loads
from .layer import Layer
from .overlay import reproject


def _points(g) -> np.ndarray:
    kind, parts = g
    if kind == "mixed":
        got = [_points(x) for x in parts]
    else:
        got = [r for p in parts for r in (p if kind == "polygon" else [p])]
    return np.concatenate(got) if got else np.empty((0, 2))


def hull_points(df: DataFrame) -> DataFrame:
    """``(x, y)``: points of the convex hulls of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2))
        for b in batches:
            pts = [_points(g) for g in (loads(w) for w in b.column(0).to_pylist()) if g is not None]
            held = kernels.hull(np.concatenate([held, *pts]))
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], names=["x", "y"])

    return df.select("geometry").mapInArrow(run, "x double, y double")


def convex_hull(layer: Layer) -> np.ndarray:
    """The hull of a whole layer as an open ring. What reaches the driver are the
    corners of each partition's hull, further thinned in two rounds."""
    pts = hull_points(layer.df)
    as_geo = pts.select(F.col("x"), F.col("y")).coalesce(8)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2))
        for b in batches:
            held = kernels.hull(np.concatenate([held, np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)]))
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], names=["x", "y"])

    rows = as_geo.mapInArrow(again, "x double, y double").collect()
    return kernels.hull(np.array([(r.x, r.y) for r in rows]).reshape(-1, 2))


#: Geometries that are put together at once.
FOLD = 256


def _united(rows: Iterator[tuple[tuple, bytes | None]]) -> dict[tuple, list]:
    """The geometries of each key, folded to one whenever there are FOLD of them."""
    held: dict[tuple, list] = {}
    for key, w in rows:
        g = loads(w)
        if g is not None and g[0] != "empty":
            own = held.setdefault(key, [])
            own.append(g)
            if len(own) >= FOLD:
                held[key] = [kernels.union(own)]
    return {k: [kernels.union(v)] for k, v in held.items()}


def dissolve(layer: Layer, by: list[str] | None = None) -> Layer:
    """The union of the polygons of each value of ``by``, of all without it, in one
    row ``(by, geometry)``. Null, empty and unreadable geometries, lines and points
    add nothing; a group without a polygon has no row.

    Each partition puts its own polygons together first, so what meets in one task
    is one outline of a group per partition.
    """
    by = by or []
    rows = layer.df.select(*(F.col(f"`{c}`") for c in by), "geometry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[tuple, bytes | None]]:
            for b in batches:
                keys = zip(*(c.to_pylist() for c in b.columns[:-1])) if by else iter(lambda: (), None)
                yield from zip(keys, b.column(len(by)).to_pylist())

        got = [(k, g[0]) for k, g in _united(each()).items() if g[0][0] != "empty"]
        cols = [pa.array([k[i] for k, _ in got], rows_schema[i]) for i in range(len(by))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([dumps(g) for _, g in got], pa.binary())], names=[*by, "geometry"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows_schema = [to_arrow_type(f.dataType) for f in rows.schema.fields]
    part = rows.mapInArrow(run, rows.schema)
    whole = part.repartition(*(F.col(f"`{c}`") for c in by)) if by else part.repartition(1)
    return Layer(whole.mapInArrow(run, rows.schema), layer.epsg)


def widened(layer: Layer, by: float) -> Layer:
    """Each geometry widened by so many units of the layer's plane system."""
    if layer.geographic:
        raise ValueError("a buffer in metres needs a projected system")
    at = layer.df.columns.index("geometry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = [dumps(kernels.buffer(g, by)) if (g := loads(w)) is not None else None for w in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at).name, pa.array(wide, pa.binary()))

    return Layer(layer.df.mapInArrow(run, layer.df.schema), layer.epsg)


def area_mask(layer: Layer, include_water: bool = False, buffer_m: float = 0.0, name: str = "study_area", utm: int | None = None, output_epsg: int | None = None) -> Layer:
    """One row ``mask_name, include_water, buffer_m, geometry``. With water the
    hull of all areas, which fills bays, else their union; widened by ``buffer_m``
    metres. A buffer in degrees is refused: give a ``utm`` system."""
    if buffer_m < 0:
        raise ValueError("the buffer must not be negative")
    if buffer_m and layer.geographic and utm is None:
        raise ValueError("a buffer in metres needs a projected system; pass utm")
    work = reproject(layer, utm) if utm and layer.geographic else layer
    if include_water:
        ring = convex_hull(work)
        ring = kernels.buffer_convex(ring, buffer_m) if buffer_m and len(ring) > 2 else ring
        geom = ("polygon", [[np.vstack([ring, ring[:1]])]]) if len(ring) > 2 else ("empty", [])
    else:
        one = dissolve(widened(work, buffer_m) if buffer_m else work).df.first()
        geom = loads(one.geometry) if one else ("empty", [])
    out = crs.transform_geometry(geom, work.epsg, output_epsg or layer.epsg)
    row = [(name, include_water, float(buffer_m), bytearray(dumps(out)))]
    return Layer(layer.df.sparkSession.createDataFrame(row, "mask_name string, include_water boolean, buffer_m double, geometry binary"), output_epsg or layer.epsg)


def hull_in_metres(layer: Layer, utm: int, metres: float) -> np.ndarray:
    """The hull of a layer in degrees, widened by as many degrees as ``metres``
    are at its middle."""
    ring = convex_hull(layer)
    c = kernels.centroid(("polygon", [[np.vstack([ring, ring[:1]])]]))
    return kernels.buffer_convex(ring, crs.metres_to_degrees(c[0], c[1], utm, metres)) if metres and c else ring


def areas(layer: Layer, column: str = "area_m2") -> DataFrame:
    """The layer's attributes with the area of each geometry."""

    @F.pandas_udf("double")
    def area(s):
        return s.map(lambda w: kernels.area(loads(w)) if w else 0.0).astype("float64")

    need = layer.df.withColumn(column, area("geometry"))
    return need.drop("geometry")
