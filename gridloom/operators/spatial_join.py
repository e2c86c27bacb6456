"""Pairs of geometries whose boxes meet, by an equi-join on grid cells.

Every geometry has a level: the smallest power of two that its box fits in. At a
level at or above its own it covers at most four cells. A pair is joined at the
higher of both levels, so neither large nor small geometries explode, and is
kept only in the cell that holds the lower left corner of what both boxes share,
so no distinct is needed. AQE splits busy cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import wkb_boxes

BOX = ("xmin", "ymin", "xmax", "ymax")


def with_box(df: DataFrame, column: str = "geometry", prefix: str = "") -> DataFrame:
    """Adds ``xmin, ymin, xmax, ymax`` of a WKB column; null if it has no points."""
    names = [prefix + c for c in BOX]
    if all(c in df.columns for c in names):
        return df
    at = df.columns.index(column)
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.DoubleType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            box = wkb_boxes(b.column(at).to_pylist())
            cols = [pa.array(box[:, k], mask=np.isnan(box[:, k])) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def _level(prefix: str) -> Column:
    extent = F.greatest(F.col(f"{prefix}xmax") - F.col(f"{prefix}xmin"), F.col(f"{prefix}ymax") - F.col(f"{prefix}ymin"))
    return F.ceil(F.log2(F.greatest(extent, F.lit(1e-3)))).cast("int")


def _cells(df: DataFrame, prefix: str, levels: list[int]) -> DataFrame:
    """One row per cell at each level in use at or above the geometry's own."""
    wide = df.withColumn("_own", _level(prefix)).where(F.col("_own").isNotNull())
    higher = F.filter(F.array(*(F.lit(k) for k in levels)), lambda k: k >= F.col("_own"))
    wide = wide.withColumn("_lev", F.explode(higher)).withColumn("_size", F.pow(F.lit(2.0), F.col("_lev")))
    for axis in "xy":
        low, high = (F.floor(F.col(f"{prefix}{axis}{m}") / F.col("_size")) for m in ("min", "max"))
        wide = wide.withColumn(f"_c{axis}", F.explode(F.sequence(low, high)))
    return wide


def box_pairs(left: DataFrame, right: DataFrame, left_prefix: str, right_prefix: str, reach: float = 0.0) -> DataFrame:
    """Inner join of rows whose boxes meet (closed) or lie within ``reach``.
    Both sides have box columns under their prefix and no other name in common.
    They are read twice, as the levels in use are looked up first: give stored
    tables of ids and boxes, to which the rest is joined back afterwards."""
    if reach:
        for m, sign in (("min", -reach), ("max", reach)):
            for axis in "xy":
                left = left.withColumn(f"{left_prefix}{axis}{m}", F.col(f"{left_prefix}{axis}{m}") + sign)
    used = [d.select(_level(p).alias("k")).where("k IS NOT NULL").distinct() for d, p in ((left, left_prefix), (right, right_prefix))]
    levels = sorted(r.k for r in used[0].union(used[1]).distinct().collect())  # at most one per power of two
    a = _cells(left, left_prefix, levels)
    b = _cells(right, right_prefix, levels)
    b = b.withColumnRenamed("_own", "_own_b").drop("_size")
    pairs = a.join(b, ["_lev", "_cx", "_cy"])
    A, B = (lambda c, p=left_prefix: F.col(p + c)), (lambda c, p=right_prefix: F.col(p + c))
    meets = (A("xmin") <= B("xmax")) & (B("xmin") <= A("xmax")) & (A("ymin") <= B("ymax")) & (B("ymin") <= A("ymax"))
    own = (F.floor(F.greatest(A("xmin"), B("xmin")) / F.col("_size")) == F.col("_cx")) & (
        F.floor(F.greatest(A("ymin"), B("ymin")) / F.col("_size")) == F.col("_cy")
    )
    return pairs.where((F.col("_lev") == F.greatest("_own", "_own_b")) & meets & own).drop(
        "_lev", "_cx", "_cy", "_own", "_own_b", "_size"
    )
