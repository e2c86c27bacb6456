"""Map extracts: XML (plain or bzip2) and PBF."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ELEMENTS = (
    "type string, id bigint, version int, ts timestamp, visible boolean, lat double, lon double, "
    "tags map<string,string>, nodes array<bigint>, members array<struct<type:string,ref:bigint,role:string>>"
)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Nodes, ways and relations of an XML extract in one table of elements."""
    attrs = "_id bigint, _version int, _timestamp timestamp, _visible boolean"
    tag = "tag array<struct<_k:string,_v:string>>"
    shapes = {
        "node": f"{attrs}, _lat double, _lon double, {tag}",
        "way": f"{attrs}, {tag}, nd array<struct<_ref:bigint>>",
        "relation": f"{attrs}, {tag}, member array<struct<_type:string,_ref:bigint,_role:string>>",
    }
    out = None
    for kind, schema in shapes.items():
        df = spark.read.format("xml").option("rowTag", kind).schema(schema).load(path)
        has = set(df.columns)
        get = lambda c, t: F.col(c) if c in has else F.lit(None).cast(t)
        tags = F.coalesce(F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"]))), F.create_map().cast("map<string,string>"))
        one = df.select(
            F.lit(kind).alias("type"), F.col("_id").alias("id"), F.col("_version").alias("version"), F.col("_timestamp").alias("ts"),
            F.col("_visible").alias("visible"), get("_lat", "double").alias("lat"), get("_lon", "double").alias("lon"), tags.alias("tags"),
            (F.transform("nd", lambda n: n["_ref"]) if "nd" in has else F.lit(None).cast("array<bigint>")).alias("nodes"),
            (
                F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
                if "member" in has
                else F.lit(None).cast("array<struct<type:string,ref:bigint,role:string>>")
            ).alias("members"),
        )
        out = one if out is None else out.unionByName(one)
    return out


# -- protocol buffers: just what the format needs ---------------------------------


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i += 1
        out |= (c & 127) << shift
        if c < 128:
            return out, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            v, i = b[i : i + n], i + n
        yield key >> 3, v


def _packed(b: bytes) -> list[int]:
    out, i = [], 0
    while i < len(b):
        v, i = _varint(b, i)
        out.append(v)
    return out


def _zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _running(values: list[int]) -> list[int]:
    out, at = [], 0
    for v in values:
        at += _zigzag(v)
        out.append(at)
    return out


_KINDS = ("node", "way", "relation")


def decode_block(data: bytes) -> Iterator[tuple]:
    """Elements of one block, as tuples in the order of ELEMENTS."""
    strings: list[str] = []
    groups, gran, lat0, lon0 = [], 100, 0, 0
    for f, v in _fields(data):
        if f == 1:
            strings = [s.decode("utf-8", "replace") for _, s in _fields(v)]
        elif f == 2:
            groups.append(v)
        elif f == 17:
            gran = v
        elif f == 19:
            lat0 = _signed(v)
        elif f == 20:
            lon0 = _signed(v)
    degree = lambda off, x: 1e-9 * (off + gran * x)
    for g in groups:
        for f, v in _fields(g):
            if f == 2:
                p = {k: x for k, x in _fields(v)}
                ids, lats, lons = (_running(_packed(p.get(k, b""))) for k in (1, 8, 9))
                kv, at, tags = _packed(p.get(10, b"")), 0, []
                for _ in ids:
                    t = {}
                    while at < len(kv) and kv[at]:
                        t[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    tags.append(t)
                for i, la, lo, t in zip(ids, lats, lons, tags):
                    yield "node", i, None, None, None, degree(lat0, la), degree(lon0, lo), t, None, None
            elif f in (1, 3, 4):
                p = {k: x for k, x in _fields(v)}
                t = {strings[a]: strings[b] for a, b in zip(_packed(p.get(2, b"")), _packed(p.get(3, b"")))}
                if f == 1:
                    yield "node", _zigzag(p[1]), None, None, None, degree(lat0, _zigzag(p[8])), degree(lon0, _zigzag(p[9])), t, None, None
                elif f == 3:
                    yield "way", _signed(p[1]), None, None, None, None, None, t, _running(_packed(p.get(8, b""))), None
                else:
                    m = [
                        (_KINDS[k], r, strings[s])
                        for s, r, k in zip(_packed(p.get(8, b"")), _running(_packed(p.get(9, b""))), _packed(p.get(10, b"")))
                    ]
                    yield "relation", _signed(p[1]), None, None, None, None, None, t, None, m


def blobs(path: str) -> list[tuple[int, int, str]]:
    """Place, size and kind of each blob; only their short headers are read."""
    out = []
    with open(path, "rb") as f:
        while head := f.read(4):
            header = dict(_fields(f.read(struct.unpack(">I", head)[0])))
            out.append((f.tell(), header[3], header[1].decode()))
            f.seek(header[3], 1)
    return out


def inflate(blob: bytes) -> bytes:
    p = dict(_fields(blob))
    if 1 in p:
        return p[1]
    if 3 in p:
        return zlib.decompress(p[3])
    raise ValueError("the blob's compression is not supported; zlib and none are")


class PbfSource(DataSource):
    """``spark.read.format("osm_pbf").load(path)``: a partition per few blobs."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return ELEMENTS

    def reader(self, schema) -> DataSourceReader:
        return _PbfReader(self.options["path"])


class _PbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        data = [(at, n) for at, n, kind in blobs(self.path) if kind == "OSMData"]
        return [InputPartition(data[i : i + 4]) for i in range(0, len(data), 4)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            for at, n in partition.value:
                f.seek(at)
                yield from decode_block(inflate(f.read(n)))


def read_pbf(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a PBF extract at a path that all executors see."""
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").load(path)


def road_lines(elements: DataFrame) -> DataFrame:
    """Tagged ways as lines: ``(osm_id, highway, name, tags, other_tags, geometry)``,
    points in way order; ``other_tags`` is the bag of the tags without a column.
    Nodes that are missing are left out; ways of one point have none."""
    import pyarrow as pa

    from ..functions.wkb import from_line

    ways = elements.where("type = 'way'").select(F.col("id").alias("osm_id"), "tags", F.posexplode("nodes").alias("pos", "node"))
    nodes = elements.where("type = 'node' AND lat IS NOT NULL AND lon IS NOT NULL").select(F.col("id").alias("node"), "lon", "lat").dropDuplicates(["node"])
    points = ways.join(nodes, "node").groupBy("osm_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"), F.first("tags").alias("tags")  # a way's own points
    )
    flat = points.where(F.size("p") > 1).select(
        "osm_id", F.try_element_at("tags", F.lit("highway")).alias("highway"), F.try_element_at("tags", F.lit("name")).alias("name"), "tags",
        F.transform("p", lambda x: x["lon"]).alias("xs"), F.transform("p", lambda x: x["lat"]).alias("ys"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            geo = [from_line(list(zip(x, y))) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(geo, pa.binary())], names=["osm_id", "highway", "name", "tags", "geometry"])

    lines = flat.mapInArrow(run, "osm_id bigint, highway string, name string, tags map<string,string>, geometry binary")
    return lines.select("osm_id", "highway", "name", "tags", tag_bag(F.col("tags"), ("highway", "name")).alias("other_tags"), "geometry")


def tag_bag(tags: Column, without: tuple[str, ...] = ()) -> Column:
    """Tags as one text of ``"key"=>"value"`` pairs by key; null without any."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    rest = F.array_sort(F.map_entries(F.map_filter(tags, lambda k, v: ~k.isin(*without) & v.isNotNull())))
    pairs = F.transform(rest, lambda e: F.concat(quoted(e["key"]), F.lit("=>"), quoted(e["value"])))
    return F.when(F.size(pairs) > 0, F.array_join(pairs, ","))


# Tags of ways that become columns of a road graph.
GRAPH_TAGS = (
    "highway", "name", "oneway", "maxspeed", "lanes", "access", "motor_vehicle", "motorcar", "hgv", "maxweight", "maxweight:hgv", "maxlength",
    "maxheight", "maxwidth", "bridge", "tunnel", "foot", "bicycle", "sidewalk", "cycleway", "junction", "route",
)


def road_graph(elements: DataFrame, tags: tuple[str, ...] = GRAPH_TAGS) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node_id, x, y)`` in degrees and directed edges between consecutive
    nodes of ways with a road class or a route: ``(edge_id, u, v, osmid, key,
    reversed, tags..., length, geometry)``. Ways that are not one-way are led both
    ways; edges to nodes that are missing are left out; lengths are on the globe."""
    import numpy as np
    import pyarrow as pa

    place = elements.where("type = 'node' AND lat IS NOT NULL AND lon IS NOT NULL").select(F.col("id").alias("node_id"), F.col("lon").alias("x"), F.col("lat").alias("y")).dropDuplicates(["node_id"])
    ways = elements.where("type = 'way'").where("tags['highway'] IS NOT NULL OR tags['route'] = 'ferry'")
    steps = F.arrays_zip(F.slice("nodes", F.lit(1), F.greatest(F.size("nodes") - 1, F.lit(0))).alias("u"), F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 1, F.lit(0))).alias("v"))
    cols = [F.try_element_at("tags", F.lit(t)).alias(t) for t in tags]
    sides = ways.select(F.col("id").alias("osmid"), F.posexplode(steps).alias("seq", "s"), *cols).select("osmid", "seq", F.col("s.u").alias("u"), F.col("s.v").alias("v"), *(F.col(f"`{t}`") for t in tags))
    from ..functions.tags import standard_oneway

    way = standard_oneway(F.coalesce("oneway", F.when(F.col("junction") == "roundabout", "yes"))) if "oneway" in tags and "junction" in tags else F.lit("no")
    both = F.when(way == "no", F.array(F.lit(False), F.lit(True))).when(way == "-1", F.array(F.lit(True))).otherwise(F.array(F.lit(False)))
    led = sides.withColumn("reversed", F.explode(both))
    led = led.withColumns({"u": F.when(F.col("reversed"), F.col("v")).otherwise(F.col("u")), "v": F.when(F.col("reversed"), F.col("u")).otherwise(F.col("v"))})
    at = lambda c: place.select(F.col("node_id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    led = led.join(at("u"), "u").join(at("v"), "v")
    rad = lambda c: F.radians(F.col(c))
    half = F.pow(F.sin((rad("vy") - rad("uy")) / 2), 2) + F.cos(rad("uy")) * F.cos(rad("vy")) * F.pow(F.sin((rad("vx") - rad("ux")) / 2), 2)
    out = led.select(
        F.xxhash64("osmid", "seq", "reversed").alias("edge_id"), "u", "v", "osmid", F.lit(0).alias("key"), "reversed", *(F.col(f"`{t}`") for t in tags),
        (F.lit(2 * 6_371_009.0) * F.asin(F.sqrt(half))).alias("length"), "ux", "uy", "vx", "vy",
    )
    names = [c for c in out.columns if c not in ("ux", "uy", "vx", "vy")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = b"\x01\x02\x00\x00\x00\x02\x00\x00\x00"
        for b in batches:
            xy = np.stack([b.column(k).to_numpy() for k in range(b.num_columns - 4, b.num_columns)], axis=1).astype("<f8")
            geo = pa.array([head + r.tobytes() for r in np.ascontiguousarray(xy)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-4], geo], names=[*names, "geometry"])

    from pyspark.sql import types as T

    schema = T.StructType([f for f in out.schema.fields if f.name in names] + [T.StructField("geometry", T.BinaryType())])
    edges = out.mapInArrow(run, schema)
    used = sides.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return place.join(used, "node_id", "left_semi"), edges


def sidecars(pbf: str) -> dict[str, str | None]:
    """Files that belong to an extract: its graph and its XML, where they exist."""
    stem = pbf.removesuffix(".pbf").removesuffix(".osm")
    find = lambda *ends: next((stem + e for e in ends if Path(stem + e).exists()), None)
    return {"graph": find(".parquet", ".graphml"), "osm": find(".osm")}


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node_id, data)`` and edges ``(u, v, data)`` of a GraphML file, the
    attributes as a map of texts by the names its keys give."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = read("key", "_id string, `_attr.name` string")
    names = {r[0]: r[1] for r in keys.select("_id", F.col("`_attr.name`")).collect()}  # one row per attribute
    known = F.create_map(*(F.lit(x) for kv in (names or {"": ""}).items() for x in kv))
    data = F.coalesce(
        F.map_from_entries(F.transform("data", lambda d: F.struct(F.coalesce(F.try_element_at(known, d["_key"]), d["_key"]), d["_VALUE"]))),
        F.create_map().cast("map<string,string>"),
    )
    inner = "data array<struct<_VALUE:string,_key:string>>"
    nodes = read("node", f"_id bigint, {inner}").select(F.col("_id").alias("node_id"), data.alias("data"))
    edges = read("edge", f"_source bigint, _target bigint, {inner}").select(F.col("_source").alias("u"), F.col("_target").alias("v"), data.alias("data"))
    return nodes, edges


# Attributes of graphs that are numbers.
_GRAPH_NUMBERS = {"x": "double", "y": "double", "length": "double", "speed_kph": "double", "key": "bigint", "n_edges": "bigint"}


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a built network: ``NAME.parquet`` with its nodes beside it
    in ``NAME.nodes.parquet``, or GraphML, whose attributes become columns."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path.removesuffix(".parquet") + ".nodes.parquet"), spark.read.parquet(path)
    if not path.endswith(".graphml"):
        raise ValueError(f"a graph is read from .parquet or .graphml, not {path}")
    out = []
    for df in read_graphml(spark, path):
        names = sorted(r.k for r in df.select(F.explode(F.map_keys("data")).alias("k")).distinct().collect())  # one per attribute
        cols = [F.try_element_at("data", F.lit(n)).try_cast(_GRAPH_NUMBERS.get(n, "string")).alias(n) for n in names]
        out.append(df.select(*(c for c in df.columns if c != "data"), *cols))
    return out[0], out[1]
