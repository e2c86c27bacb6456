"""Feature layers from files: GeoPackage, GeoJSON, shapefile, Parquet, CSV."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.wkb import EMPTY, collect, dumps, open_polygons
from ..operators.layer import Layer

ROWS_PER_PARTITION = 100_000


def _ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def gpkg_geometry(blob: bytes | None) -> bytes | None:
    """The WKB within a GeoPackage blob."""
    if blob is None or blob[:2] != b"GP":
        return blob
    return blob[8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] :]


class GpkgSource(DataSource):
    """``format("gpkg").option("layer", name).load(path)``, by ranges of row ids."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def _open(self) -> tuple[sqlite3.Connection, str, str]:
        con = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        layers = con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
        want = self.options.get("layer")
        for table, column in layers:
            if want in (None, table):
                return con, table, column
        raise ValueError(f"no layer {want!r} in {self.options['path']}")

    def schema(self) -> T.StructType:
        con, table, geom = self._open()
        fields = []
        for _, name, kind, *_ in con.execute(f"PRAGMA table_info({_ident(table)})"):
            kind = kind.upper()
            t = T.BinaryType() if name == geom else T.LongType() if "INT" in kind else T.DoubleType() if kind in ("REAL", "DOUBLE", "FLOAT") else T.StringType()
            fields.append(T.StructField("geometry" if name == geom else name, t))
        return T.StructType(fields)

    def reader(self, schema) -> DataSourceReader:
        con, table, geom = self._open()
        lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {_ident(table)}").fetchone()
        names = [r[1] for r in con.execute(f"PRAGMA table_info({_ident(table)})")]
        return _GpkgReader(self.options["path"], table, names, names.index(geom), lo, hi)


class _GpkgReader(DataSourceReader):
    def __init__(self, path, table, names, geom, lo, hi):
        self.path, self.table, self.names, self.geom, self.lo, self.hi = path, table, names, geom, lo, hi

    def partitions(self) -> list[InputPartition]:
        if self.lo is None:
            return [InputPartition((0, -1))]
        return [InputPartition((a, min(a + ROWS_PER_PARTITION - 1, self.hi))) for a in range(self.lo, self.hi + 1, ROWS_PER_PARTITION)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        cols = ", ".join(map(_ident, self.names))
        for row in con.execute(f"SELECT {cols} FROM {_ident(self.table)} WHERE rowid BETWEEN ? AND ?", partition.value):
            yield tuple(gpkg_geometry(v) if i == self.geom else v for i, v in enumerate(row))


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None) -> Layer:
    spark.dataSource.register(GpkgSource)
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    layers = con.execute("SELECT table_name, srs_id FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
    epsg = next((s for t, s in layers if layer in (None, t)), 4326)
    r = spark.read.format("gpkg")
    return Layer((r.option("layer", layer) if layer else r).load(path), int(epsg))


def load_osm_edges(spark: SparkSession, path: str) -> Layer:
    """The ``edges`` layer of a GeoPackage as ``osm_id, edge_id, edge_length,
    geometry``; ids that are no whole number are an error."""
    layer = read_gpkg(spark, path, "edges")
    missing = {"osmid", "edge_id", "length"} - set(layer.df.columns)
    if missing:
        raise ValueError(f"edges lack {', '.join(sorted(missing))}")
    df = layer.df.select(F.col("osmid").cast("bigint").alias("osm_id"), "edge_id", F.col("length").alias("edge_length"), "geometry")
    return Layer(df, layer.epsg)


def read_geojson(spark: SparkSession, path: str, epsg: int = 4326) -> Layer:
    """A FeatureCollection; properties become columns."""
    feats = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    has_props = "properties" in feats.schema["f"].dataType.names
    props = [f.name for f in feats.schema["f"].dataType["properties"].dataType] if has_props else []
    flat = feats.select(*(F.col(f"f.properties.`{p}`").alias(p) for p in props), F.to_json("f.geometry").alias("_g"))
    at = len(props)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            geo = [dumps(geojson_geometry(json.loads(g))) if g else None for g in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(geo, pa.binary())], names=[*props, "geometry"])

    schema = T.StructType([*flat.schema.fields[:at], T.StructField("geometry", T.BinaryType())])
    return Layer(flat.mapInArrow(run, schema), epsg)


def _numbers(c):
    """Coordinates; where a file mixes kinds the reader gives inner lists as text."""
    if isinstance(c, str):
        return json.loads(c)
    return [_numbers(x) for x in c] if isinstance(c, list) else c


def geojson_geometry(g: dict):
    kind, c = g.get("type"), _numbers(g.get("coordinates"))
    if kind == "GeometryCollection":
        return collect([geojson_geometry(x) for x in g.get("geometries", [])])
    if not c:
        return EMPTY
    one = lambda p: np.asarray(p, "f8").reshape(len(p), -1)[:, :2]
    if kind.endswith("Point"):
        return "point", [one([p]) for p in (c if kind.startswith("Multi") else [c])]
    if kind.endswith("LineString"):
        return "line", [one(p) for p in (c if kind.startswith("Multi") else [c])]
    return "polygon", [[one(r) for r in p] for p in (c if kind.startswith("Multi") else [c])]


class ShapefileSource(DataSource):
    """``format("shapefile").load("x.shp")`` with the attributes of ``x.dbf``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        kinds = {"N": T.DoubleType(), "F": T.DoubleType()}
        fields = [T.StructField(n, T.LongType() if k == "N" and not dec else kinds.get(k, T.StringType())) for n, k, _, dec in _dbf_fields(self._dbf())[0]]
        return T.StructType([*fields, T.StructField("geometry", T.BinaryType())])

    def _dbf(self) -> str:
        return self.options["path"].removesuffix(".shp") + ".dbf"

    def reader(self, schema) -> DataSourceReader:
        return _ShapefileReader(self.options["path"], self._dbf())


class _ShapefileReader(DataSourceReader):
    def __init__(self, shp: str, dbf: str):
        self.shp, self.dbf = shp, dbf

    def read(self, partition) -> Iterator[tuple]:
        with open(self.shp, "rb") as f:
            f.seek(100)
            for row in _dbf_rows(self.dbf):
                head = f.read(8)
                if len(head) < 8:
                    return
                yield (*row, dumps(_shape(f.read(2 * struct.unpack(">ii", head)[1]))))


def _dbf_fields(path: str):
    with open(path, "rb") as f:
        head = f.read(32)
        n, size, rec = struct.unpack_from("<IHH", head, 4)
        fields = []
        for _ in range((size - 33) // 32):
            d = f.read(32)
            fields.append((d[:11].split(b"\0")[0].decode(), chr(d[11]), d[16], d[17]))
    return fields, n, size, rec


def _dbf_rows(path: str) -> Iterator[tuple]:
    fields, n, size, rec = _dbf_fields(path)
    with open(path, "rb") as f:
        f.seek(size)
        for _ in range(n):
            r, at, row = f.read(rec), 1, []
            for _, kind, width, dec in fields:
                v = r[at : at + width].decode("utf-8", "replace").strip(" \0")
                at += width
                if kind in "NF":
                    v = None if not v or "*" in v else float(v) if dec or kind == "F" else int(v) if v.lstrip("-").isdigit() else int(float(v))
                row.append(v if v != "" else None)
            yield tuple(row)


def _shape(b: bytes):
    kind = struct.unpack_from("<i", b)[0] % 10
    if kind == 0:
        return EMPTY
    if kind == 1:
        return "point", [np.frombuffer(b, "<f8", 2, 4).reshape(1, 2)]
    if kind == 8:
        n = struct.unpack_from("<i", b, 36)[0]
        return "point", [p.reshape(1, 2) for p in np.frombuffer(b, "<f8", 2 * n, 40).reshape(n, 2)]
    parts, n = struct.unpack_from("<ii", b, 36)
    cuts = [*struct.unpack_from(f"<{parts}i", b, 44), n]
    xy = np.frombuffer(b, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    pieces = [xy[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
    return ("line", pieces) if kind == 3 else open_polygons(pieces)


def read_shapefile(spark: SparkSession, path: str, epsg: int) -> Layer:
    spark.dataSource.register(ShapefileSource)
    return Layer(spark.read.format("shapefile").load(path), epsg)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header, types inferred, plain or gzip."""
    return spark.read.csv(path, header=True, inferSchema=True)


def load_layer(spark: SparkSession, source: DataFrame | Layer | str, epsg: int) -> Layer:
    """A layer from a table, a layer or a file by its ending."""
    if isinstance(source, Layer):
        return source
    if isinstance(source, DataFrame):
        return Layer(source, epsg)
    if not isinstance(source, str):
        raise TypeError(f"cannot read a layer from {type(source).__name__}")
    if source.endswith(".gpkg"):
        return read_gpkg(spark, source)
    if source.endswith(".parquet"):
        return Layer(spark.read.parquet(source), epsg)
    if source.endswith((".geojson", ".json")):
        return read_geojson(spark, source, epsg)
    if source.endswith(".shp"):
        return read_shapefile(spark, source, epsg)
    raise ValueError(f"unknown kind of layer file: {source}")
