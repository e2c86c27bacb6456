"""Layers derived from the star-schema tables, which hold no geometry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.wkb import dumps
from ..operators.layer import Layer

ZONES = """select n_nationkey as zone_id, n_name as zone_name, cast((n_nationkey%5)*256 as double) xmin, cast((n_nationkey%5)*256+256 as double) xmax,
 cast(floor(n_nationkey/5.0)*256 as double) ymin, cast(floor(n_nationkey/5.0)*256+256 as double) ymax from {nation}"""
LINES = """select o_orderkey as edge_id, o_custkey as osm_id, o_orderpriority as name,
 cast((o_orderkey*37)%1280 as double)+0.5 x0, cast((o_custkey*53)%1280 as double)+0.5 y0,
 case when o_orderkey%2=0 then cast((o_orderkey*37)%1280 as double)+0.5+16+(o_orderkey*29)%512 else cast((o_orderkey*37)%1280 as double)+0.5 end x1,
 case when o_orderkey%2=1 then cast((o_custkey*53)%1280 as double)+0.5+16+(o_orderkey*29)%512 else cast((o_custkey*53)%1280 as double)+0.5 end y1
 from {orders}"""
ROADS = """select p_partkey as link_id, p_brand as brand, p_type as road_class,
 cast((p_partkey*41)%1280 as double)+0.5 xmin, cast((p_partkey*41)%1280 as double)+0.5+16+(p_partkey*29)%512 xmax,
 cast((p_partkey*67)%1280 as double)+0.5 ymin, cast((p_partkey*67)%1280 as double)+0.5+4*(1+p_partkey%8) ymax,
 cast(16+(p_partkey*29)%512 as double) length from {part}"""
TAGS = """select p_partkey as edge_id,
 case p_partkey%9 when 0 then '50' when 1 then '25 mph' when 2 then '80 km/h' when 3 then 'signals' when 4 then null when 5 then '40 kph' when 6 then 'walk' when 7 then '30;50' else ' 60 MPH ' end maxspeed,
 case p_partkey%8 when 0 then 'yes' when 1 then 'no' when 2 then '-1' when 3 then 'reverse' when 4 then 'yes;yes' when 5 then 'yes;no' when 6 then null else 'alternating' end oneway,
 case p_partkey%7 when 0 then '5' when 1 then '3.5' when 2 then '20t' when 3 then '50 tons' when 4 then '10000 lbs' when 5 then null else 'heavy' end maxweight,
 case p_partkey%6 when 0 then 'private' when 1 then 'yes;private' when 2 then 'permissive' when 3 then null when 4 then 'no' else 'customers' end access_tag,
 concat('"highway"=>"', case p_size%4 when 0 then 'primary' when 1 then 'residential' when 2 then 'motorway' else 'tertiary' end, '","length"=>"', cast(p_size as varchar(20)), '"') other_tags from {part}"""
GRAPH = """select c_custkey as edge_id, c_custkey as u, (c_custkey+c_nationkey*977)%(select count(*) from {customer}) as v from {customer}"""
NODES = """select c_custkey as node_id, cast((c_custkey*97)%1000 as double)*0.25 x, cast((c_custkey*61)%1000 as double)*0.25 y from {customer}"""

_TABLES = ("nation", "orders", "part", "customer", "events", "lineitem", "supplier")


def duck(sql: str) -> str:
    """The same text over DuckDB's views."""
    return sql.format(**{t: t for t in _TABLES})


def derived(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(**{t: f"parquet.`{d}/{t}.parquet`" for t in _TABLES}))


def shaped(df: DataFrame, kind: str) -> DataFrame:
    """Adds ``geometry`` and drops the coordinates: ``line`` of x0, y0, x1, y1, or
    ``box`` of xmin, xmax, ymin, ymax."""
    wide = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < wide:  # a table in few files would be one task
        df = df.repartition(wide)
    names = ["x0", "y0", "x1", "y1"] if kind == "line" else ["xmin", "ymin", "xmax", "ymax"]
    rest = [c for c in df.columns if c not in names]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            xy = np.stack([t[c].to_numpy() for c in names], axis=1)
            if kind == "line":
                geo = [dumps(("line", [r.reshape(2, 2)])) for r in xy]
            else:
                geo = [dumps(("polygon", [[np.array([[p, q], [r, q], [r, s], [p, s], [p, q]])]])) for p, q, r, s in xy]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(geo, pa.binary())], names=[*rest, "geometry"])

    return df.mapInArrow(run, f"{fields}, geometry binary")


def zones(spark: SparkSession, d: str) -> Layer:
    return Layer(shaped(derived(spark, d, ZONES), "box"), 3857)


def lines(spark: SparkSession, d: str) -> Layer:
    return Layer(shaped(derived(spark, d, LINES), "line"), 3857)


def roads(spark: SparkSession, d: str) -> Layer:
    return Layer(shaped(derived(spark, d, ROADS), "box"), 3857)
