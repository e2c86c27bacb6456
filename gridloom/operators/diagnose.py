"""Joins by id, statistics and integrity reports of network tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import half_even
from ..runtime import stored


def edge_quality(edges: DataFrame) -> DataFrame:
    """One row of anomaly counts, in one pass. A column that is missing counts
    every edge; for short and long links it counts none; speeds are null."""
    has = set(edges.columns)
    every = F.count(F.lit(1))

    def count(column: str, cond: Column, missing: Column = every) -> Column:
        return F.count_if(F.coalesce(cond, F.lit(False))) if column in has else missing

    col = lambda c: F.col(c) if c in has else F.lit(None)
    none = F.lit(0).cast("bigint")
    speed = lambda f: f("speed_kph").cast("double") if "speed_kph" in has else F.lit(None).cast("double")
    oneway = F.coalesce(col("oneway").cast("string"), F.lit("None"))
    return edges.agg(
        count("edge_id", col("edge_id").isNull()).alias("missing_edge_id"),
        count("length", col("length").isNull()).alias("missing_length"),
        count("length", col("length") <= 0).alias("nonpositive_length"),
        count("length", col("length") < 10, F.max(none)).alias("short_links_lt_10m"),
        count("length", col("length") < 5, F.max(none)).alias("very_short_links_lt_5m"),
        count("length", col("length") > 10_000, F.max(none)).alias("long_links_gt_10km"),
        count("speed_kph", col("speed_kph").isNull()).alias("missing_speed_kph"),
        (speed(F.min) if "speed_kph" in has else F.max(F.lit(None).cast("double"))).alias("speed_kph_min"),
        (speed(F.max) if "speed_kph" in has else F.max(F.lit(None).cast("double"))).alias("speed_kph_max"),
        count("oneway", ~oneway.isin("yes", "no", "-1")).alias("invalid_oneway_values"),
        count("geometry", col("geometry").isNull()).alias("missing_geometry"),
    )


def top_values(df: DataFrame, values: Column, k: int) -> DataFrame:
    """The k most frequent values of an array column, ties by value."""
    return df.select(F.explode(values).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(k)


def whole_number(c: str) -> Column:
    """The id as a whole number, blanks around it and a fraction cut off; null for others."""
    return F.expr(f"coalesce(try_cast(`{c}` AS bigint), try_cast(try_cast(`{c}` AS double) AS bigint))")


def join_by_id(network: DataFrame, layer: DataFrame, network_id: str, layer_id: str) -> DataFrame:
    """Inner join on whole-number ids; null ids and ids that are no number match
    nothing. Names that both sides have get ``_x`` and ``_y``."""
    for df, c in ((network, network_id), (layer, layer_id)):
        if c not in df.columns:
            raise ValueError(f"there is no column {c!r} to join by")
    both = set(network.columns) & set(layer.columns) - ({network_id} if network_id == layer_id else set())
    left = network.withColumn(network_id, whole_number(network_id)).where(F.col(network_id).isNotNull())
    right = layer.withColumn(layer_id, whole_number(layer_id)).where(F.col(layer_id).isNotNull())
    left = left.select([F.col(f"`{c}`").alias(f"{c}_x" if c in both else c) for c in left.columns])
    right = right.select([F.col(f"`{c}`").alias(f"{c}_y" if c in both else c) for c in right.columns])
    lk, rk = (network_id + "_x" if network_id in both else network_id), (layer_id + "_y" if layer_id in both else layer_id)
    if lk == rk:
        return left.join(right, lk)
    return left.join(right, F.col(lk) == F.col(rk))


def match_rate(matched: DataFrame, network: DataFrame, network_id: str, matched_id: str | None = None) -> DataFrame:
    """Distinct ids asked for and matched, and their ratio. Asked for is every
    number that ``join_by_id`` reads, and that of ``way/123`` and ``w123``, which
    it does not."""
    way = F.regexp_extract(F.trim(F.col(network_id).cast("string")), r"^[A-Za-z]+/?([0-9]+)$", 1).try_cast("bigint")
    asked = network.agg(F.count_distinct(F.coalesce(whole_number(network_id), way)).alias("asked"))
    got = matched.agg(F.count_distinct(matched_id or network_id).alias("matched"))
    rate = F.when(F.col("asked") > 0, F.col("matched") / F.col("asked")).otherwise(0.0)
    return asked.join(F.broadcast(got)).withColumn("rate", rate)


def dangling_way_nodes(elements: DataFrame) -> DataFrame:
    """Distinct node ids that ways list and no node element has."""
    used = elements.where("type = 'way'").select(F.explode("nodes").alias("node_id")).distinct()
    have = elements.where("type = 'node'").select(F.col("id").alias("node_id")).distinct()
    return used.join(have, "node_id", "left_anti")


def exact_quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, between neighbouring values in proportion;
    nulls count nothing. Values are counted, ordered by ranges over all tasks and
    numbered by running sums, so no group is held by one task."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    counted = stored(counted.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()), "value-counts")
    per_part = counted.groupBy(*group, "_part").agg(F.sum("_n").alias("_n"))  # one row per group and range
    line = Window.partitionBy(*group).orderBy("_part")
    per_part = per_part.select(
        *group, "_part", (F.sum("_n").over(line) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("_total")
    )
    here = counted.join(F.broadcast(per_part), [*group, "_part"])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy(value))
    here = here.select(*group, value, upto.alias("_upto"), "_total")
    aggs, out = [], []
    for name, q in shares.items():
        at = (F.col("_total") - 1) * F.lit(q)
        aggs += [F.min(F.when(F.col("_upto") > f(at), F.col(value))).alias(f"_{k}_{name}") for k, f in (("lo", F.floor), ("hi", F.ceil))]
        h = (F.col("_rows") - 1) * F.lit(q)
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (h - F.floor(h))).alias(name))
    return here.groupBy(*group).agg(F.max("_total").alias("_rows"), *aggs).select(*group, *out)


def length_classes(edges: DataFrame, length: str, short: float = 15, long: float = 10_000, plotted: float = 500) -> DataFrame:
    """Count, least, most, mean and median length of the classes of links."""
    classes = F.array(
        F.lit("all"),
        F.when(F.col(length) < short, F.lit("short")),
        F.when(F.col(length) > long, F.lit("long")),
        F.when(F.col(length) <= plotted, F.lit("plotted")),
    )
    rows = edges.select(F.explode(F.filter(classes, lambda c: c.isNotNull())).alias("class"), F.col(length).alias("l"))
    total = rows.groupBy("class").agg(F.count("l").alias("count"), F.min("l").alias("min"), F.max("l").alias("max"), F.avg("l").alias("mean"))
    return total.join(F.broadcast(exact_quantiles(rows, ["class"], "l", {"median": 0.5})), "class", "left")  # four rows


def length_histogram(edges: DataFrame, length: str, most: float = 500, bins: int = 50) -> DataFrame:
    width = most / bins
    at = F.least(F.floor(F.col(length) / width), F.lit(bins - 1))
    return edges.where(F.col(length).between(0, most)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def summary_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(metric, a, b)`` of metrics that differ between two long summaries."""
    x, y = a.select("metric", F.col("value").alias("a")), b.select("metric", F.col("value").alias("b"))
    return x.join(y, "metric", "full").where(~F.col("a").eqNullSafe(F.col("b")))


def long_tags(df: DataFrame, most: int = 250) -> DataFrame:
    """Longest text per column, of columns where it reaches ``most``."""
    lens = df.agg(*(F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(c) for c in df.columns if c != "geometry"))
    stack = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("bigint").alias("longest")) for c in lens.columns))
    return lens.select(F.inline(stack)).where(F.col("longest") >= most)


def long_rows(df: DataFrame, most: int = 250) -> DataFrame:
    """Rows whose texts together reach ``most`` characters; null counts nothing."""
    total = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns if c != "geometry"), F.lit(0))
    return df.withColumn("total_length", total).where(F.col("total_length") >= most)


def with_density(areas: DataFrame, population: DataFrame, key: str = "geoid") -> DataFrame:
    """Areas (``area_m2``) with population: density per square kilometre and its
    percentile rank, ties sharing their mean rank, one decimal.

    Ranks come from counts per density value, ordered by ranges over all tasks."""
    joined = areas.join(population, key).withColumn("density", F.col("population") / (F.col("area_m2") / 1e6))
    per = joined.where("density IS NOT NULL").groupBy(F.col("density").alias("_d")).agg(F.count(F.lit(1)).alias("_ties"))
    per = stored(per.repartitionByRange("_d").withColumn("_part", F.spark_partition_id()), "densities")
    line = Window.partitionBy(F.lit(0)).orderBy("_part")
    parts = per.groupBy("_part").agg(F.sum("_ties").alias("_n"))  # one row per range
    parts = parts.select("_part", (F.sum("_n").over(line) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    below = F.sum("_ties").over(Window.partitionBy("_part").orderBy("_d")) - F.col("_ties") + F.col("_before")
    ranked = per.join(F.broadcast(parts), "_part").withColumn("_below", below)
    rank = ranked.select("_d", half_even((F.col("_below") + (F.col("_ties") + 1) / 2) / F.col("_total") * 100.0, 1).alias("percentile"))
    return joined.join(rank, F.col("density") == F.col("_d"), "left").drop("_d")


def dense_areas(with_density: DataFrame, least: float) -> DataFrame:
    return with_density.where(F.col("density") >= least) if least > 0 else with_density


def density_statistics(with_density: DataFrame) -> DataFrame:
    d = F.col("density")
    one = with_density.select(F.lit(0).alias("_all"), d.alias("_d"))
    quart = exact_quantiles(one, ["_all"], "_d", {f"q{int(q * 100)}": q for q in (0.25, 0.5, 0.75)})
    total = one.agg(F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("std"), F.min("_d").alias("min"), F.max("_d").alias("max"), F.lit(0).alias("_all"))
    return total.join(F.broadcast(quart), "_all", "left").drop("_all")  # one row


def share_kept(kept: DataFrame, all_areas: DataFrame) -> DataFrame:
    a, b = kept.agg(F.sum("population").alias("kept")), all_areas.agg(F.sum("population").alias("total"))
    return a.join(F.broadcast(b)).withColumn("share", F.when(F.col("total") > 0, F.coalesce("kept", F.lit(0)) / F.col("total")))


def in_counties(df: DataFrame, counties: list[str]) -> DataFrame:
    """Rows of which any ``COUNTYFP*`` column names one of the counties."""
    cols = [c for c in df.columns if c.upper().startswith("COUNTYFP")]
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.col(c).isin(*counties), F.lit(False))
    return df.where(cond)
