"""Writers: tables and layers by file ending, map extracts, result caches.

Parquet, CSV and JSON are written by the executors. Of formats that are one file
by definition, executors make the blocks of GeoJSON, XML, PBF and GraphML and the
driver puts them together; GeoPackage and shapefile are streamed through the
driver row by row. Their size is bounded by the disk only.
"""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
import struct
import warnings
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.planar import signed_area
from ..functions.wkb import loads, to_wkt
from ..operators.layer import Layer


def with_wkt(df: DataFrame, column: str = "geometry", name: str = "geometry_wkt") -> DataFrame:
    """Geometry as text instead of WKB."""
    at = df.columns.index(column)
    fields = [f for f in df.schema.fields if f.name != column] + [T.StructField(name, T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wkt = pa.array([to_wkt(loads(w)) for w in b.column(at).to_pylist()], pa.string())
            rest = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, wkt], names=[f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))


def _made(path: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    return path


def _geojson(g) -> dict | None:
    if g is None:
        return None
    kind, parts = g
    if kind == "empty":
        return {"type": "GeometryCollection", "geometries": []}
    if kind == "mixed":
        return {"type": "GeometryCollection", "geometries": [_geojson(x) for x in parts]}
    name = {"point": "Point", "line": "LineString", "polygon": "Polygon"}[kind]
    c = [[r.tolist() for r in p] if kind == "polygon" else (p[0].tolist() if kind == "point" else p.tolist()) for p in parts]
    return {"type": name, "coordinates": c[0]} if len(c) == 1 else {"type": f"Multi{name}", "coordinates": c}


def _lines_of(df: DataFrame, text: Callable[[dict], str]) -> Iterator[str]:
    """Lines that the executors make of the rows, block by block and in order."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist(maps_as_pydicts="lossy") for c in b.columns]
            made = "\n".join(text(dict(zip(names, r))) for r in zip(*cols))
            yield pa.RecordBatch.from_arrays([pa.array([made] if b.num_rows else [], pa.string())], names=["t"])

    for r in df.mapInArrow(run, "t string").toLocalIterator(prefetchPartitions=True):
        yield r.t


def _feature(r: dict) -> str:
    geo = _geojson(loads(r.pop("geometry")))
    return json.dumps({"type": "Feature", "properties": r, "geometry": geo}, default=str)


def write_geojson(layer: Layer, path: str) -> None:
    """One file; features are made by the executors, the driver only puts their
    blocks together."""
    with open(_made(path), "w", encoding="utf-8") as f:
        f.write('{"type": "FeatureCollection", "features": [')
        for i, block in enumerate(_lines_of(layer.df, _feature)):
            f.write(("," if i else "") + "\n" + block.replace("\n", ",\n"))
        f.write("\n]}\n")


def write_gpkg(layer: Layer, path: str, name: str = "layer") -> None:
    if os.path.exists(path):
        os.remove(path)
    con = sqlite3.connect(_made(path))
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER", "binary": "BLOB"}
    q = lambda c: '"' + c.replace('"', '""') + '"'
    cols = [(f.name, kinds.get(f.dataType.simpleString(), "TEXT")) for f in layer.df.schema.fields]
    con.executescript(
        "PRAGMA application_id = 1196444487;"
        "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER);"
        "CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);"
        "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT);"
        f"CREATE TABLE {q(name)} ({', '.join(f'{q(c)} {k}' for c, k in cols)});"
    )
    con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (name, name, layer.epsg))
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geometry', 'GEOMETRY', ?, 0, 0)", (name, layer.epsg))
    con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, '')", (f"EPSG:{layer.epsg}", layer.epsg, layer.epsg))
    head = b"GP\0\1" + struct.pack("<i", layer.epsg)

    def value(field: str, v):
        if field == "geometry":
            return None if v is None else head + bytes(v)
        return v if v is None or isinstance(v, (int, float, str)) else str(v)

    rows = (tuple(value(c, r[c]) for c, _ in cols) for r in layer.df.toLocalIterator(prefetchPartitions=True))
    con.executemany(f"INSERT INTO {q(name)} VALUES ({', '.join('?' * len(cols))})", rows)
    con.commit()
    con.close()


#: Shape types of the format by kind of geometry.
_SHAPES = {"point": 1, "line": 3, "polygon": 5}


def _shape_record(g) -> tuple[int, bytes, list[float] | None]:
    """Shape type, content and box of a geometry; shells turn right, holes left."""
    if g is None or g[0] == "empty":
        return 0, struct.pack("<i", 0), None
    kind, parts = g
    if kind not in _SHAPES or (kind == "point" and len(parts) > 1):
        raise ValueError("a shapefile holds single points, lines or polygons")
    if kind == "point":
        x, y = parts[0][0].tolist()
        return 1, struct.pack("<i2d", 1, x, y), [x, y, x, y]
    if kind == "polygon":
        rings = [r if (signed_area(r) < 0) == (i == 0) else r[::-1] for p in parts for i, r in enumerate(p)]
    else:
        rings = parts
    at = np.cumsum([0, *(len(r) for r in rings)])
    xy = np.concatenate(rings)
    box = [*xy.min(axis=0).tolist(), *xy.max(axis=0).tolist()]
    head = struct.pack("<i4dii", _SHAPES[kind], *box, len(rings), len(xy)) + struct.pack(f"<{len(rings)}i", *at[:-1].tolist())
    return _SHAPES[kind], head + np.ascontiguousarray(xy, "<f8").tobytes(), box


def _dbf_names(names: list[str]) -> list[str]:
    """Names of at most ten bytes, told apart by a number."""
    out: list[str] = []
    for n in names:
        short, k = n.encode()[:10].decode("utf-8", "ignore"), 1
        while short in out:
            short = n.encode()[: 9 - len(str(k))].decode("utf-8", "ignore") + f"_{k}"
            k += 1
        out.append(short)
    return out


def write_shapefile(layer: Layer, path: str) -> None:
    """A shapefile of one kind of geometry, with its table and index. The format
    cuts names to ten bytes and text to 254, and has no null text."""
    stem = _made(path).removesuffix(".shp")
    fields = [f for f in layer.df.schema.fields if f.name != "geometry"]
    kinds = []
    for f in fields:
        whole = isinstance(f.dataType, T.IntegralType)
        number = isinstance(f.dataType, T.NumericType)
        kinds.append((b"N", 20, 0) if whole else (b"F", 24, 15) if number else (b"C", 254, 0))
    kind, box, n, at = 0, [np.inf, np.inf, -np.inf, -np.inf], 0, 50
    with open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx, open(f"{stem}.dbf", "wb") as dbf:
        shp.write(b"\0" * 100)
        shx.write(b"\0" * 100)
        dbf.write(b"\0" * 32)
        for name, (k, width, dec) in zip(_dbf_names([f.name for f in fields]), kinds):
            dbf.write(name.encode().ljust(11, b"\0") + k + b"\0" * 4 + bytes([width, dec]) + b"\0" * 14)
        dbf.write(b"\r")
        for r in layer.df.toLocalIterator(prefetchPartitions=True):
            own, body, b = _shape_record(loads(r["geometry"]))
            if own and kind and own != kind:
                raise ValueError("a shapefile holds geometries of one kind")
            kind = own or kind
            if b:
                box = [*np.minimum(box[:2], b[:2]), *np.maximum(box[2:], b[2:])]
            n += 1
            shp.write(struct.pack(">ii", n, len(body) // 2) + body)
            shx.write(struct.pack(">ii", at, len(body) // 2))
            at += 4 + len(body) // 2
            row = b" "
            for f, (k, width, _) in zip(fields, kinds):
                v = r[f.name]
                text = b"" if v is None else (repr(float(v)) if k == b"F" else str(v)).encode()[:width].decode("utf-8", "ignore").encode()
                row += text.ljust(width) if k == b"C" else text.rjust(width)
            dbf.write(row)
        dbf.write(b"\x1a")
        dbf.seek(0)
        dbf.write(struct.pack("<4BIHH20x", 3, 70, 1, 1, n, 33 + 32 * len(fields), 1 + sum(w for _, w, _ in kinds)))
        frame = struct.pack("<8d", *(box if np.isfinite(box).all() else [0.0] * 4), 0, 0, 0, 0)
        for out, words in ((shp, at), (shx, 50 + 4 * n)):
            out.seek(0)
            out.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, kind) + frame)


def save_layer(layer: Layer, path: str) -> str:
    """A layer by the path's ending; unknown endings give a GeoPackage."""
    end = Path(path).suffix.lower()
    if end == ".parquet":
        layer.df.write.mode("overwrite").parquet(path)
    elif end == ".csv":
        with_wkt(layer.df).write.mode("overwrite").csv(path, header=True)
    elif end in (".geojson", ".json"):
        write_geojson(layer, path)
    elif end == ".shp":
        write_shapefile(layer, path)
    else:
        write_gpkg(layer, path)
    return path


def save_table(df: DataFrame, path: str, epsg: int = 4326) -> str:
    """A table by the path's ending; with a geometry as a layer, unknown endings
    give CSV."""
    end = Path(path).suffix.lower()
    if "geometry" in df.columns and end in (".gpkg", ".geojson"):
        return save_layer(Layer(df, epsg), path)
    if end == ".parquet":
        df.write.mode("overwrite").parquet(path)
    elif end == ".json":
        df.write.mode("overwrite").json(path)
    else:
        (with_wkt(df) if "geometry" in df.columns else df).write.mode("overwrite").csv(path, header=True)
    return path


# -- map extracts ----------------------------------------------------------------

#: What the format wants of every element.
_EDIT = 'version="1" timestamp="1970-01-01T00:00:00Z" changeset="1" uid="1" user="gridloom"'


def oneway_text(v: Column) -> Column:
    t = F.lower(v.cast("string"))
    return F.when(v.isNull(), "no").when(t == "true", "yes").when(t == "false", "no").otherwise(v.cast("string"))


def _largest_part(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs of the connected part with the most nodes, the first of equals."""
    root: dict[int, int] = {}

    def find(n: int) -> int:
        while root.setdefault(n, n) != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for u, v in pairs:
        root[find(v)] = find(u)
    size: dict[int, int] = {}
    for n in list(root):
        size[find(n)] = size.get(find(n), 0) + 1
    best = max(size, key=lambda r: size[r])
    return [p for p in pairs if find(p[0]) == best]


def _in_order(pairs: list[tuple[int, int]]) -> list[int] | None:
    """The nodes so that every pair goes forward; None if they go in a circle."""
    onward: dict[int, list[int]] = {}
    due: dict[int, int] = {}
    for u, v in pairs:
        onward.setdefault(u, []).append(v)
        due.setdefault(u, 0)
        due[v] = due.get(v, 0) + 1
    ready, out = [n for n, k in due.items() if not k], []
    for n in ready:
        out.append(n)
        for m in onward.get(n, ()):
            due[m] -= 1
            if not due[m]:
                ready.append(m)
    return out if len(out) == len(due) else None


def way_nodes(pairs: list[tuple[int, int]]) -> list[int]:
    """Nodes of a way from its edges in their order: all of its largest connected
    part, so that every edge goes forward. Of a circle the first edge's start comes
    before the order of the rest; if there is none, only the first edge is left."""
    if len(pairs) > 1:
        line = _in_order(_largest_part(pairs))
        if line is None:
            rest = _in_order(_largest_part(pairs[1:]))
            line = None if rest is None else [pairs[0][0], *rest]
        if line is not None:
            return line
    return list(pairs[0])


def as_ways(edges: DataFrame, way_tags: list[str], merge_by: str | None = None, aggregates: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``(id, nodes, tags)`` of edges ``u, v`` to be written as ways. By default
    each edge is its own way; with ``merge_by`` edges of one id become one way,
    whose first edge gives the tags; ``aggregates`` say how others come from all
    its edges, by default that lengths add up."""
    aggregates = {"length": F.sum} if aggregates is None else aggregates
    e = edges.withColumn("oneway", oneway_text(F.col("oneway"))) if "oneway" in edges.columns else edges.withColumn("oneway", F.lit("no"))
    number = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = lambda c, kind: number(c) if isinstance(kind, T.FractionalType) else c.cast("string")
    have = [c for c in way_tags if c in e.columns]
    kind = {c: e.schema[c].dataType for c in have}
    if merge_by is None:
        tags = F.map_filter(F.create_map(*(x for c in have for x in (F.lit(c), plain(F.col(c), kind[c])))), lambda k, v: v.isNotNull())
        return e.select(F.xxhash64("u", "v", *[c for c in ("key", "edge_id") if c in e.columns]).alias("id"), F.array("u", "v").alias("nodes"), tags.alias("tags"))
    seq = F.struct("u", "v")
    agg = [(aggregates[c](F.col(c)) if c in aggregates else F.min_by(F.col(c), seq)).alias(c) for c in have]
    g = e.groupBy(F.col(merge_by).alias("id")).agg(F.array_sort(F.collect_list(seq)).alias("_e"), *agg)  # a way's own edges

    @F.pandas_udf("array<bigint>")
    def ordered(s):
        return s.map(lambda way: way_nodes([(p["u"], p["v"]) for p in way]))

    made = {f.name: f.dataType for f in g.schema.fields}
    tags = F.map_filter(F.create_map(*(x for c in have for x in (F.lit(c), plain(F.col(c), made[c])))), lambda k, v: v.isNotNull())
    return g.select("id", ordered("_e").alias("nodes"), tags.alias("tags"))


def _xml_node(r: dict) -> str:
    tag = f"<tag k=\"highway\" v={quoteattr(str(r['highway']))}/>" if r.get("highway") is not None else ""
    return f'<node id="{r["node_id"]}" {_EDIT} lat="{round(r["y"], 7)}" lon="{round(r["x"], 7)}">{tag}</node>'


def _xml_way(r: dict) -> str:
    nds = "".join(f'<nd ref="{n}"/>' for n in r["nodes"])
    tags = "".join(f"<tag k={quoteattr(t['key'])} v={quoteattr(t['value'])}/>" for t in r["tags"])
    return f'<way id="{r["id"]}" {_EDIT}>{nds}{tags}</way>'


def write_osm_xml(nodes: DataFrame, ways: DataFrame, path: str) -> None:
    """An extract of ``nodes (node_id, x, y[, highway])`` and ``ways``; places are
    rounded to seven decimals, null tags are left out."""
    if "oneway" in ways.columns:
        warnings.warn("ways should be made by as_ways", stacklevel=2)
    with open(_made(path), "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6" generator="gridloom">\n')
        for block in _lines_of(nodes, _xml_node):
            f.write(block + "\n")
        for block in _lines_of(ways.select("id", "nodes", F.array_sort(F.map_entries("tags")).alias("tags")), _xml_way):
            f.write(block + "\n")
        f.write("</osm>\n")


def _v(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _z(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def _f(field: int, v: int | bytes) -> bytes:
    return _v(field << 3) + _v(v) if isinstance(v, int) else _v(field << 3 | 2) + _v(len(v)) + v


def write_pbf(elements: DataFrame, path: str, per_block: int = 8000) -> None:
    """An extract in blocks of at most ``per_block`` elements, made and compressed
    by the executors."""

    def blob(kind: bytes, data: bytes) -> bytes:
        body = _f(2, len(data)) + _f(3, zlib.compress(data))
        head = _f(1, kind) + _f(3, len(body))
        return struct.pack(">I", len(head)) + head + body

    def block(rows: list) -> bytes:
        strings: dict[str, int] = {"": 0}
        sid = lambda s: strings.setdefault(s or "", len(strings))
        group = b""
        for r in rows:
            tags = sorted((r["tags"] or {}).items())
            kv = _f(2, b"".join(_v(sid(k)) for k, _ in tags)) + _f(3, b"".join(_v(sid(v)) for _, v in tags)) if tags else b""
            if r["type"] == "node":
                group += _f(1, _f(1, _z(r["id"])) + kv + _f(8, _z(round((r["lat"] or 0) * 1e7))) + _f(9, _z(round((r["lon"] or 0) * 1e7))))
            elif r["type"] == "way":
                refs = r["nodes"] or []
                group += _f(3, _f(1, r["id"]) + kv + _f(8, b"".join(_v(_z(b - a)) for a, b in zip([0, *refs], refs))))
            else:
                m = r["members"] or []
                ids = [x["ref"] for x in m]
                group += _f(
                    4,
                    _f(1, r["id"]) + kv + _f(8, b"".join(_v(sid(x["role"])) for x in m)) + _f(9, b"".join(_v(_z(b - a)) for a, b in zip([0, *ids], ids)))
                    + _f(10, b"".join(_v(("node", "way", "relation").index(x["type"])) for x in m)),
                )
        table = b"".join(_f(1, s.encode()) for s in strings)
        return blob(b"OSMData", _f(1, table) + _f(2, group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, per_block):
                rows = b.slice(k, per_block).to_pylist(maps_as_pydicts="lossy")
                yield pa.RecordBatch.from_arrays([pa.array([block(rows)], pa.binary())], names=["b"])

    with open(_made(path), "wb") as f:
        f.write(blob(b"OSMHeader", _f(4, b"OsmSchema-V0.6") + _f(16, b"gridloom")))
        for r in elements.select("type", "id", "tags", "lat", "lon", "nodes", "members").mapInArrow(run, "b binary").toLocalIterator(prefetchPartitions=True):
            f.write(r.b)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One file; elements are made by the executors."""
    skip = {"geometry", "u", "v", "node_id"}

    def element(what: str) -> Callable[[dict], str]:
        def text(r: dict) -> str:
            at = f'id="{r["node_id"]}"' if what == "node" else f'source="{r["u"]}" target="{r["v"]}"'
            data = "".join(f'<data key="{what}_{c}">{_xml(v)}</data>' for c, v in r.items() if c not in skip and v is not None)
            return f"<{what} {at}>{data}</{what}>"

        return text

    with open(_made(path), "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for what, df in (("node", nodes), ("edge", edges)):
            for c in df.columns:
                if c not in skip:
                    f.write(f'<key id="{what}_{c}" for="{what}" attr.name={quoteattr(c)} attr.type="string"/>\n')
        f.write('<graph edgedefault="directed">\n')
        for what, df in (("node", nodes), ("edge", edges)):
            for block in _lines_of(df, element(what)):
                f.write(block + "\n")
        f.write("</graph>\n</graphml>\n")


def _xml(v) -> str:
    return str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def least_of_lists(df: DataFrame) -> DataFrame:
    """Array columns as their least value, as single-valued formats need."""
    return df.select([F.array_min(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields])


FORMATS = ("parquet", "graphml", "gpkg", "osm", "pbf", "geojson")


def export_network(
    nodes: DataFrame, edges: Layer, folder: str, name: str, tags: list[str], formats: tuple[str, ...] = FORMATS,
    aggregates: dict[str, Callable[[Column], Column]] | None = None, way: str | None = None,
) -> dict[str, str]:
    """The network in each format; gives format -> path. PBF and GeoJSON bring XML
    along. ``way``: a column whose equal values are one way in XML and PBF."""
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(sorted(unknown))}")
    flat = Layer(least_of_lists(edges.df), edges.epsg)
    base, out = f"{folder}/{name}", {}
    ways = as_ways(flat.df, tags, way, aggregates)
    if "parquet" in formats:
        nodes.write.mode("overwrite").parquet(f"{base}.nodes.parquet")
        out["parquet"] = save_layer(edges, f"{base}.parquet")
    if "graphml" in formats:
        write_graphml(nodes, flat.df, out.setdefault("graphml", f"{base}.graphml"))
    if "gpkg" in formats:
        write_gpkg(flat, out.setdefault("gpkg", f"{base}.gpkg"), "edges")
    if {"osm", "pbf", "geojson"} & set(formats):
        write_osm_xml(nodes, ways, out.setdefault("osm", f"{base}.osm"))
    if "pbf" in formats:
        n = nodes.select(F.lit("node").alias("type"), F.col("node_id").alias("id"), F.col("y").alias("lat"), F.col("x").alias("lon"))
        w = ways.select(F.lit("way").alias("type"), F.col("id").cast("bigint").alias("id"), "tags", "nodes")
        both = n.unionByName(w, allowMissingColumns=True)
        write_pbf(both.withColumn("members", F.lit(None).cast("array<struct<type:string,ref:bigint,role:string>>")), out.setdefault("pbf", f"{base}.osm.pbf"))
    if "geojson" in formats:
        write_geojson(flat, out.setdefault("geojson", f"{base}.geojson"))
    return out


# -- result caches -----------------------------------------------------------------

CACHE_VERSION = 1


def fingerprint(source: DataFrame | Layer | str) -> dict:
    """What tells whether an input changed: of a file its place, size and time; of
    a table its columns, rows and a hash over all values."""
    if isinstance(source, str):
        st = os.stat(source)
        return {"path": os.path.abspath(source), "size": st.st_size, "mtime_ns": st.st_mtime_ns}
    df = source.df if isinstance(source, Layer) else source
    h = F.xxhash64(*[F.col(f"`{c}`") if not isinstance(df.schema[c].dataType, T.MapType) else F.map_entries(f"`{c}`") for c in df.columns])
    mix = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(2**31))).alias("s")).first()
    epsg = source.epsg if isinstance(source, Layer) else None
    return {"columns": df.columns, "rows": mix.n, "xor": mix.x, "sum": mix.s, "epsg": epsg}


def cache_key(**what) -> dict:
    return {"version": CACHE_VERSION, **{k: fingerprint(v) if isinstance(v, (DataFrame, Layer)) or (isinstance(v, str) and os.path.exists(v)) else v for k, v in what.items()}}


def sidecar(path: str) -> str:
    return path + ".cache.json"


def cached(path: str, key: dict) -> bool:
    """Whether ``path`` holds the result of ``key``; damaged notes do not count."""
    try:
        with open(sidecar(path), encoding="utf-8") as f:
            return os.path.exists(path) and json.load(f) == json.loads(json.dumps(key))
    except (OSError, ValueError):
        return False


def note_cache(path: str, key: dict) -> None:
    with open(_made(sidecar(path)), "w", encoding="utf-8") as f:
        json.dump(key, f, indent=1, sort_keys=True)


def config_digest(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:10]
