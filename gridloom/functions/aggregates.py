"""Aggregates that merge the tags of edges; all combine map-side.

``seq`` columns give the order where the first value counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Access values from the most to the least restrictive. Others
# rank between "discouraged" and "permissive".
ACCESS_ORDER = ("no", "private", "permit", "destination", "delivery", "customers", "forestry", "agricultural", "discouraged", "permissive", "yes")


def bool_all(v: Column) -> Column:
    return F.coalesce(F.bool_and(v), F.lit(True))


def bool_any(v: Column) -> Column:
    return F.coalesce(F.bool_or(v), F.lit(False))


def yes_no_all(v: Column) -> Column:
    """``no`` if any value is, else ``yes``."""
    return F.when(bool_any(v == "no"), "no").otherwise("yes")


def most_restrictive_flag(v: Column) -> Column:
    """``no`` if any value says so, ``yes`` if there are values, else null."""
    t = F.lower(F.trim(v))
    return F.when(bool_any(t.isin("no", "false", "0")), "no").when(F.count(F.when(t != "", 1)) > 0, "yes")


def min_number_or_text(v: Column, seq: Column) -> Column:
    """The least number as text; without one the first text."""
    n = v.try_cast("double")
    low = F.min(F.when(~F.isnan(n), n))
    return F.coalesce(low.cast("string"), F.min_by(v, F.when(v.isNotNull(), seq)))


def first_valid(v: Column, seq: Column) -> Column:
    ok = v.isNotNull() & (F.trim(v) != "")
    return F.min_by(F.when(ok, v), F.when(ok, seq))


def median_lanes(v: Column) -> Column:
    """Median of all whole numbers in ``;`` lists, cut to a whole number. The
    numbers are counted per value first, so the state stays small."""
    return F.floor(F.median(v)).cast("bigint")


def whole_numbers(v: Column) -> Column:
    return F.filter(F.transform(F.split(v, ";", -1), lambda p: F.trim(p).try_cast("bigint")), lambda x: x.isNotNull())


def most_restrictive_access(v: Column, seq: Column) -> Column:
    t = F.lower(F.trim(v))
    rank = F.array_position(F.array(*(F.lit(a) for a in ACCESS_ORDER)), t).cast("double")
    rank = F.when(rank == 0, 9.5).otherwise(rank)
    ok = t.isNotNull() & ~t.isin("", "nan")
    return F.min_by(F.when(ok, t), F.when(ok, F.struct(rank, seq)))


def mean_maxspeed(v: Column) -> Column:
    n = F.regexp_extract(F.lower(F.trim(v)), r"^(\d+(?:\.\d+)?)\s*mph$", 1).try_cast("double")
    return F.concat(F.rint(F.avg(n)).cast("bigint").cast("string"), F.lit(" mph"))


def merge_edges(edges: DataFrame, by: str, seq: str = "seq", more: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Edges of one chain as one: lengths add up, flags and tags combine. Columns
    that are missing are left out. ``more``: rules of further columns, or others."""
    s = F.col(seq)
    # Which columns are merged by which rule.
    rules = {
        "length": F.sum, "travel_time": F.sum, "speed_kph": F.avg, "maxspeed": mean_maxspeed,
        "hgv": bool_all, "mdv": bool_all, "reversed": bool_all, "protected_backbone": bool_any,
        **{c: yes_no_all for c in ("oneway", "access", "foot", "bicycle", "motor_vehicle")},
        **{c: (lambda v: min_number_or_text(v, s)) for c in ("maxweight", "maxheight", "maxwidth")},
        **{c: (lambda v: first_valid(v, s)) for c in ("bridge", "tunnel", "sidewalk", "cycleway", "source_layer", "layer_role", "highway", "name")},
    }
    rules |= more or {}
    aggs = [f(F.col(c)).alias(c) for c, f in rules.items() if c in edges.columns]
    out = edges.groupBy(by).agg(F.count(F.lit(1)).alias("n_edges"), *aggs)
    if "lanes" in edges.columns:
        lanes = edges.select(by, F.explode(whole_numbers(F.col("lanes").cast("string"))).alias("n")).groupBy(by).agg(median_lanes(F.col("n")).alias("lanes"))
        out = out.join(lanes, by, "left")
    return out
