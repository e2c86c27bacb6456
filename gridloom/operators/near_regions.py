"""Lines in, near or across regions, among very many of both.

Regions are cut into triangles by ear clipping. Triangles are ordered in a
bounding-volume hierarchy; a line finds the triangles its box meets, which are
then tested exactly. Of a region with several triangles, and of several regions
whose shared border a point lies on, a line is assigned once.

Up to ``broadcast_triangles`` triangles (counted first) every worker holds the
whole hierarchy and lines are not moved at all. Beyond that the upper part of
the hierarchy is cut by planes through a sample of bounded size, so that its
leaves hold about as many triangles each wherever they are crowded. Leaves are
the keys by which triangles and the lines that meet their boxes come together;
leaves with many lines, or with triangles that no plane parts, are salted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planar import BoxTree, boxes_of, clip_to_triangles, distance_to_triangles, points_in_triangles, triangulate
from ..functions.wkb import line_parts, loads
from ..runtime import stored

#: Triangles every worker may hold (64 bytes each, and as much again for the tree).
BROADCAST_TRIANGLES = 400_000
#: Triangles of the sample through which the upper hierarchy is cut (it only
#: evens out the leaves; every triangle is placed), and the triangles and lines
#: one task gets of a leaf, about.
SAMPLE, LEAF_TRIANGLES, LEAF_LINES = 200_000, 20_000, 50_000

#: The hierarchy a Python worker holds for the query it works on.
_held: dict[str, tuple] = {}

_TRI = "zone_id string, kind string, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double"


def zone_triangles(zones: DataFrame) -> DataFrame:
    """``(zone_id, kind, x0, y0, x1, y1, x2, y2)``: triangles of each region; of
    several records of a region the latest with a geometry counts. Regions with
    a null id or without an area have none."""
    one = (
        zones.where("zone_id IS NOT NULL AND octet_length(geometry) > 0")
        .groupBy("zone_id")
        .agg(F.max_by(F.struct("geometry", "zone_kind"), F.struct("loaded_at", "rec_id")).alias("z"))
        .select("zone_id", "z.zone_kind", "z.geometry")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, tris = [], [], [np.empty((0, 6))]
            for z, k, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                geom = loads(g)
                for part in geom[1] if geom and geom[0] == "polygon" else []:
                    t = triangulate(part)
                    tris.append(t.reshape(-1, 6))
                    ids += [z] * len(t)
                    kinds += [k] * len(t)
            t = np.concatenate(tris)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(kinds, pa.string()), *(pa.array(t[:, c]) for c in range(6))],
                names=["zone_id", "kind", "x0", "y0", "x1", "y1", "x2", "y2"],
            )

    return one.mapInArrow(run, _TRI)


class _Lines:
    """Lines of a batch as flat arrays."""

    def __init__(self, geometries: list):
        first, seg, owner = [], [], []
        self.rows = []
        for i, g in enumerate(geometries):
            parts = line_parts(g)
            if parts:
                k = len(self.rows)
                self.rows.append(i)
                first.append(parts[0][0])
                for p in parts:
                    seg.append(np.concatenate([p[:-1], p[1:]], axis=1))
                    owner.append(np.full(len(p) - 1, k))
        n = len(self.rows)
        self.first = np.array(first).reshape(n, 2)
        self.seg = np.concatenate(seg) if seg else np.empty((0, 4))
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        self.seg_len = np.hypot(self.seg[:, 2] - self.seg[:, 0], self.seg[:, 3] - self.seg[:, 1])
        self.length = np.bincount(self.owner, self.seg_len, n) if n else np.empty(0)

    def boxes(self, reach: float) -> np.ndarray:
        """Boxes of the lines and of their first points with ``reach`` around."""
        cut = np.searchsorted(self.owner, np.arange(len(self.rows)))
        s = self.seg
        lo = np.minimum.reduceat(np.minimum(s[:, :2], s[:, 2:]), cut)
        hi = np.maximum.reduceat(np.maximum(s[:, :2], s[:, 2:]), cut)
        return np.concatenate([np.minimum(lo, self.first - reach), np.maximum(hi, self.first + reach)], axis=1)


class Regions:
    """Triangles of regions with their hierarchy; what each line has of each."""

    def __init__(self, zone: np.ndarray, tri: np.ndarray):
        self.names, self.zone = np.unique(zone.astype(str), return_inverse=True)
        self.tri = tri
        self.tree = BoxTree(boxes_of(tri) if len(tri) else np.empty((0, 4)))

    def meet(self, lines: _Lines, reach: float) -> tuple[np.ndarray, ...]:
        """``(line, zone, in, distance, length)`` per line and region that its
        box meets: ``in`` 2 inside, 1 on the border, of the first point."""
        if not len(lines.rows):
            e = np.empty(0)
            return e.astype(int), e.astype(int), e, e, e
        ask, hit = self.tree.query(lines.boxes(reach))
        key = ask * len(self.names) + self.zone[hit]
        pair, back = np.unique(key, return_inverse=True)
        tri, p = self.tri[hit], lines.first[ask]
        inside, dist = np.zeros(len(pair)), np.full(len(pair), np.inf)
        np.maximum.at(inside, back, points_in_triangles(p, tri))
        np.minimum.at(dist, back, distance_to_triangles(p, tri))
        cut = np.searchsorted(lines.owner, np.arange(len(lines.rows) + 1))
        n = cut[ask + 1] - cut[ask]
        which = np.repeat(np.arange(len(ask)), n)
        seg = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + cut[ask][which]
        s = lines.seg[seg]
        t0, t1 = clip_to_triangles(s[:, :2], s[:, 2:], tri[which])
        inner = np.bincount(back[which], np.maximum(t1 - t0, 0) * lines.seg_len[seg], len(pair))
        return pair // len(self.names), pair % len(self.names), inside, dist, inner


def _relations(df: DataFrame, reach: float, share: float) -> DataFrame:
    said = F.array(
        F.when(F.col("inside") > 0, F.lit("inside")),
        F.when((F.col("inside") == 0) & (F.col("dist") <= reach), F.lit("near")),
        F.when((F.col("total") > 0) & (F.col("inner") >= share * F.col("total")), F.lit("through")),
    )
    return df.select("rec_id", "zone_id", F.explode(F.filter(said, lambda r: r.isNotNull())).alias("relation"))


_MET = "rec_id bigint, zone_id string, kind string, inside int, dist double, inner double, total double"


def _batch(rec: np.ndarray, lines: _Lines, regions: Regions, kinds: dict, reach: float) -> pd.DataFrame:
    li, zo, inside, dist, inner = regions.meet(lines, reach)
    keep = (inside > 0) | (dist <= reach) | (inner > 0)
    li, zo = li[keep], zo[keep]
    names = regions.names[zo].astype(object)
    return pd.DataFrame(
        {
            "rec_id": rec[np.asarray(lines.rows, np.int64)[li]] if len(li) else np.empty(0, np.int64),
            "zone_id": names,
            "kind": np.array([kinds.get(z) for z in names], object),
            "inside": inside[keep].astype("i4"),
            "dist": dist[keep],
            "inner": inner[keep],
            "total": lines.length[li],
        }
    )


def _once(df: pd.DataFrame) -> pd.DataFrame:
    """A first point on borders only is given to one region of each kind."""
    border = np.flatnonzero(df["inside"].to_numpy() == 1)
    if len(border):
        rec, kind, zone = df["rec_id"].to_numpy(), df["kind"].to_numpy(), df["zone_id"].to_numpy()
        of = set(rec[border].tolist())
        strict = {(rec[i], kind[i]) for i in np.flatnonzero(df["inside"].to_numpy() == 2) if rec[i] in of}
        least: dict[tuple, str] = {}
        for i in border:
            key = (rec[i], kind[i])
            least[key] = min(least.get(key, zone[i]), zone[i])
        lost = [i for i in border if (rec[i], kind[i]) in strict or zone[i] != least[rec[i], kind[i]]]
        inside = df["inside"].to_numpy(copy=True)
        inside[lost] = 0
        df = df.assign(inside=inside)
    return df


def line_regions(
    edges: DataFrame,
    zones: DataFrame,
    reach: float = 150.0,
    share: float = 0.01,
    broadcast_triangles: int = BROADCAST_TRIANGLES,
) -> DataFrame:
    """``(rec_id, zone_id, relation)``: ``inside`` (the line's first point lies in
    the region, holes are outside), ``near`` (it is outside, at most ``reach``
    away) and ``through`` (at least ``share`` of the line's length lies in it).

    Null, empty and unreadable lines and lines of one point have no row; repeated
    records each have theirs. A first point on a border shared by regions of one
    kind is inside the one with the smallest id.
    """
    spark = edges.sparkSession
    tris = stored(zone_triangles(zones), "triangles")
    n = tris.count()
    slim = edges.where("rec_id IS NOT NULL AND octet_length(geometry) > 9").select("rec_id", "geometry")
    if n <= broadcast_triangles:
        held = tris.toPandas()
        shared = spark.sparkContext.broadcast(held)
        mark = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if mark not in _held:
                t = shared.value
                _held.clear()
                _held[mark] = Regions(t["zone_id"].to_numpy(), t.iloc[:, 2:].to_numpy().reshape(-1, 3, 2)), dict(zip(t["zone_id"], t["kind"]))
            regions, kinds = _held[mark]
            for b in batches:
                for at in range(0, b.num_rows, 4000):
                    part = b.slice(at, 4000)
                    got = _once(_batch(part.column(0).to_numpy(), _Lines(part.column(1).to_pylist()), regions, kinds, reach))
                    yield pa.RecordBatch.from_pandas(got, schema=_met_schema(), preserve_index=False)

        return _relations(slim.mapInArrow(run, _MET), reach, share)
    return _relations(_by_leaves(slim, tris, reach), reach, share)


def _met_schema() -> pa.Schema:
    return pa.schema(
        [("rec_id", pa.int64()), ("zone_id", pa.string()), ("kind", pa.string()), ("inside", pa.int32()), ("dist", pa.float64()), ("inner", pa.float64()), ("total", pa.float64())]
    )


class Planes:
    """The upper hierarchy: planes that halve a sample of points along their longer
    spread until there are enough leaves, or no plane parts what is left."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.axis, self.value, self.child = [], [], []  # child: two node numbers, or -1 - leaf
        self.leaves = 0
        self.root = self._node(points, max(1, leaves))

    def _node(self, points: np.ndarray, leaves: int) -> int:
        axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) else 0
        if leaves > 1 and len(points) > 1:
            v = np.sort(points[:, axis])
            value = v[len(v) * ((leaves + 1) // 2) // leaves]
            value = value if value > v[0] else v[np.searchsorted(v, value, "right") :][:1]
            if np.size(value):
                value = float(np.ravel(value)[0])
                at = len(self.axis)
                self.axis.append(axis)
                self.value.append(value)
                self.child.append((0, 0))
                low = points[:, axis] < value
                self.child[at] = (self._node(points[low], (leaves + 1) // 2), self._node(points[~low], leaves // 2))
                return at
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, counted from 0."""
        at = np.full(len(points), self.root)
        axis, value, child = np.array(self.axis, int), np.array(self.value), np.array(self.child, int).reshape(-1, 2)
        while (inner := np.flatnonzero(at >= 0)).size:
            k = at[inner]
            at[inner] = child[k, (points[inner, axis[k]] >= value[k]).astype(int)]
        return -1 - at


def _by_leaves(slim: DataFrame, tris: DataFrame, reach: float, most: int | None = None) -> DataFrame:
    """The same through a shuffle by leaves of the upper hierarchy."""
    most = most or LEAF_TRIANGLES
    cx, cy = (F.col("x0") + F.col("x1") + F.col("x2")) / 3, (F.col("y0") + F.col("y1") + F.col("y2")) / 3
    n = tris.count()
    some = tris.select(cx, cy).sample(min(1.0, SAMPLE / max(n, 1)), 1).limit(2 * SAMPLE).collect()
    planes = Planes(np.array(some, "f8").reshape(-1, 2), -(-n // most))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xy = np.stack([b.column(k).to_numpy() for k in range(2, 8)], axis=1).reshape(-1, 3, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(planes.leaf_of(xy.mean(axis=1)), pa.int32())], names=[*b.schema.names, "leaf"])

    side = stored(tris.mapInArrow(place, f"{_TRI}, leaf int"), "placed")
    # triangles of one leaf beyond what fits one task, as none of the planes parts them, are split by hash
    pieces = side.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * most)).cast("int").alias("pieces"))
    side = side.join(F.broadcast(pieces), "leaf").withColumn("piece", F.pmod(F.xxhash64("zone_id", "x0", "y0", "x1"), F.col("pieces")).cast("int"))
    box = side.groupBy("leaf").agg(F.min(F.least("x0", "x1", "x2")), F.min(F.least("y0", "y1", "y2")), F.max(F.greatest("x0", "x1", "x2")), F.max(F.greatest("y0", "y1", "y2")))
    found = sorted(tuple(r) for r in box.collect())  # as many rows as leaves
    ids, frames = np.array([r[0] for r in found]), np.array([r[1:] for r in found], "f8")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = BoxTree(frames)
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                part = b.slice(at, 20_000)
                lines = _Lines(part.column(1).to_pylist())
                if lines.rows:
                    ask, hit = tree.query(lines.boxes(reach))
                    take = pa.array(np.asarray(lines.rows)[ask])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(ids[hit], pa.int32())], names=["rec_id", "geometry", "leaf"])

    routed = stored(slim.mapInArrow(route, "rec_id bigint, geometry binary, leaf int"), "routed")
    salts = routed.groupBy("leaf").agg((1 + F.floor(F.count(F.lit(1)) / LEAF_LINES)).cast("int").alias("salts"))
    leaf = F.broadcast(pieces.join(salts, "leaf"))  # as many rows as leaves
    left = routed.join(leaf, "leaf").withColumn("salt", F.pmod(F.xxhash64("rec_id", "geometry"), F.col("salts")).cast("int"))
    left = left.select("rec_id", "geometry", "leaf", "salt", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    right = side.drop("pieces").join(F.broadcast(salts), "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def test(a: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        xy = t[["x0", "y0", "x1", "y1", "x2", "y2"]].to_numpy().reshape(-1, 3, 2)
        regions = Regions(t["zone_id"].to_numpy(), xy)
        kinds = dict(zip(t["zone_id"], t["kind"]))
        rec, geo = a["rec_id"].to_numpy(), a["geometry"].tolist()
        out = [_batch(rec[k : k + 4000], _Lines(geo[k : k + 4000]), regions, kinds, reach) for k in range(0, len(rec), 4000)]
        if not out:
            return pa.Table.from_pylist([], _met_schema()).to_pandas()
        return pd.concat(out, ignore_index=True)

    keys = ["leaf", "piece", "salt"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(test, _MET)
    whole = met.groupBy("rec_id", "zone_id", "kind").agg(
        F.max("inside").alias("inside"), F.min("dist").alias("dist"), F.sum("inner").alias("inner"), F.max("total").alias("total")
    )
    whole = stored(whole, "met")
    border = whole.where("inside > 0").groupBy(F.col("rec_id").alias("b_rec"), F.col("kind").alias("b_kind")).agg(
        F.max("inside").alias("best"), F.min(F.when(F.col("inside") == 1, F.col("zone_id"))).alias("least"), F.count(F.lit(1)).alias("n")
    ).where("n > 1 AND least IS NOT NULL").drop("n")
    out = whole.join(border, (F.col("rec_id") == F.col("b_rec")) & F.col("kind").eqNullSafe(F.col("b_kind")), "left")
    drop = (F.col("inside") == 1) & F.col("best").isNotNull() & ((F.col("best") == 2) | (F.col("zone_id") != F.col("least")))
    return out.withColumn("inside", F.when(drop, 0).otherwise(F.col("inside")))
