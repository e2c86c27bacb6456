"""References to records that are missing, deleted or not there yet.

Every change of an element is a delta of two signed counts per key ``(type,
id)``: a version takes away the references of the version before it and adds its
own, and it adds to or takes from the existence of its element what its state is
less the state before it. A key with positive references and zero existence is
an orphan. The deltas of several batches add up to those of all their changes in
one, in whatever order they come, so a report is kept current by adding deltas to
old counts (:func:`change_deltas`, :func:`add_deltas`, :func:`orphans`). For a
reference of the past both counts are taken at its time: the existence is the
running sum of the deltas so far.

Hot keys: points in time of one key are made distinct with partial aggregation
before they are shuffled, and keys that hold more than a thousandth of all
points (at most a thousand keys, so they may be broadcast) are cut into ranges
of time that carry their last state over. No key's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import small_side, stored

KEY = ("type", "id")
#: A key is hot with more than this share of all points in time, if there are at
#: least HOT_LEAST of them; it is cut into RANGES pieces.
HOT_SHARE, HOT_LEAST, RANGES = 1000, 50_000, 64


def element_references(elements: DataFrame) -> DataFrame:
    """References made by each version of a way's nodes and a relation's members,
    distinct per record; null ids and unknown member types make none."""
    node = F.transform(
        F.array_distinct(F.coalesce("nodes", F.array().cast("array<bigint>"))),
        lambda n: F.struct(F.lit("osm_elements.nodes").alias("src"), F.lit("node").alias("type"), n.alias("id")),
    )
    member = F.transform(
        F.array_distinct(
            F.transform(
                F.coalesce("members", F.expr("CAST(array() AS array<struct<type:string,ref:bigint,role:string>>)")),
                lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref")),
            )
        ),
        lambda m: F.struct(F.lit("osm_elements.members").alias("src"), m["type"].alias("type"), m["ref"].alias("id")),
    )
    return (
        elements.select("rec_id", F.col("ts").alias("at"), F.inline(F.concat(node, member)))
        .where("id IS NOT NULL AND at IS NOT NULL AND type IN ('node', 'way', 'relation')")
        .select("src", "rec_id", "type", "id", "at")
    )


def network_references(network: DataFrame) -> DataFrame:
    """References of network links to ways; ids without a number make none."""
    return (
        network.select(
            F.lit("network.attributeOrigId").alias("src"),
            "rec_id",
            F.lit("way").alias("type"),
            F.expr("try_cast(nullif(regexp_extract(attributeOrigId, '([0-9]+)', 1), '') AS bigint)").alias("id"),
            F.col("loaded_at").alias("at"),
        )
        .where("id IS NOT NULL AND at IS NOT NULL")
    )


def element_states(elements: DataFrame) -> DataFrame:
    """``(type, id, at, state)``: the last record of each element at each point
    in time, by version and record id; state 1 exists, 0 is deleted."""
    return (
        elements.where("type IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL")
        .groupBy("type", "id", F.col("ts").alias("at"))
        .agg(
            F.max_by(
                F.when(F.coalesce("visible", F.lit(True)), 1).otherwise(0),
                F.struct(F.coalesce("version", F.lit(-1)), F.coalesce("rec_id", F.lit(-1))),
            ).alias("state")
        )
    )


# -- counts kept current -----------------------------------------------------

#: The last record of each element, as far as its deltas need it.
LATEST = "type string, id bigint, at timestamp, version int, rec_id bigint, state int, refs array<struct<type:string,id:bigint>>"
COUNTS = "type string, id bigint, refs bigint, existence bigint"


def latest_records(elements: DataFrame) -> DataFrame:
    """The last record of each element, by time, version and record id, with its
    state and the different keys it refers to."""
    of = lambda kind, refs: F.transform(refs, lambda i: F.struct(F.lit(kind).alias("type"), i.alias("id")))
    members = F.coalesce("members", F.expr("CAST(array() AS array<struct<type:string,ref:bigint,role:string>>)"))
    members = F.transform(members, lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("id")))
    refs = F.concat(of("node", F.coalesce("nodes", F.array().cast("array<bigint>"))), members)
    refs = F.array_distinct(F.filter(refs, lambda r: r["id"].isNotNull() & r["type"].isin("node", "way", "relation")))
    order = F.struct(F.col("ts").alias("at"), F.coalesce("version", F.lit(-1)).alias("version"), F.coalesce("rec_id", F.lit(-1)).alias("rec_id"))
    state = F.when(F.coalesce("visible", F.lit(True)), 1).otherwise(0)
    return (
        elements.where("type IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL")
        .groupBy("type", "id")
        .agg(F.max_by(F.struct(order.alias("o"), state.alias("state"), refs.alias("refs")), order).alias("l"))
        .select("type", "id", "l.o.*", "l.state", "l.refs")
    )


def newer_records(latest: DataFrame, known: DataFrame) -> DataFrame:
    """What ``latest`` records change about ``known`` ones: both states and both
    lists of references, of elements whose record is newer."""
    old = known.select(*KEY, F.struct("at", "version", "rec_id").alias("_o"), F.col("state").alias("old_state"), F.col("refs").alias("old_refs"))
    both = latest.join(old, list(KEY), "left")
    return both.where(F.col("_o").isNull() | (F.struct("at", "version", "rec_id") > F.col("_o"))).drop("_o")


def change_deltas(newer: DataFrame) -> DataFrame:
    """Signed deltas of changes: -1 for each reference of the record before, +1 for
    each of the new one; the new state less the old one. Those that add up to
    nothing go."""
    ref = lambda refs, n: F.transform(
        F.coalesce(refs, F.expr("CAST(array() AS array<struct<type:string,id:bigint>>)")),
        lambda r: F.struct(r["type"].alias("type"), r["id"].alias("id"), F.lit(n).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("existence")),
    )
    state = (F.col("state") - F.coalesce("old_state", F.lit(0))).cast("bigint")
    own = F.array(F.struct("type", "id", F.lit(0).cast("bigint").alias("refs"), state.alias("existence")))
    return add_deltas(newer.select(F.inline(F.concat(own, ref(F.col("old_refs"), -1), ref(F.col("refs"), 1)))))


def latest_of(newer: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` records with the newer ones in their place."""
    return known.join(newer, list(KEY), "left_anti").unionByName(newer.select(known.columns))


def reference_deltas(refs: DataFrame) -> DataFrame:
    """Deltas of references whose records are never replaced."""
    return refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("refs"), F.lit(0).cast("bigint").alias("existence"))


def add_deltas(*counts: DataFrame) -> DataFrame:
    """Counts per key of all given counts and deltas together; zero ones go."""
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return (
        total.groupBy(*KEY)
        .agg(F.sum("refs").alias("refs"), F.sum("existence").alias("existence"))
        .where("refs <> 0 OR existence <> 0")
    )


def is_orphan(refs: Column | str = "refs", existence: Column | str = "existence") -> Column:
    """Positive references and zero existence."""
    return (F.coalesce(refs, F.lit(0)) > 0) & (F.coalesce(existence, F.lit(0)) <= 0)


def orphans(counts: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence."""
    return counts.where(is_orphan()).select(*KEY, "refs")


# -- existence at the time of reference ----------------------------------------


def _counts_at(states: DataFrame, points: DataFrame) -> DataFrame:
    """``(type, id, at, refs, existence)`` for each point ``(type, id, at, refs)``;
    the existence count is null before the key's first record."""
    moments = states.select(*KEY, "at", "state", F.lit(0).alias("asked"), F.lit(0).cast("bigint").alias("refs")).unionByName(
        points.select(*KEY, "at", F.lit(None).cast("int").alias("state"), F.lit(1).alias("asked"), "refs")
    )
    moments = stored(moments, "moments")
    per_key = moments.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    total = moments.count()
    hot = per_key.where(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).select(*KEY)  # at most HOT_SHARE rows
    cuts = (
        moments.join(F.broadcast(hot), list(KEY))
        .groupBy(*KEY)
        .agg(F.percentile_approx(F.col("at").cast("double"), [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"))
    )
    span = F.when(F.col("cuts").isNull(), 0).otherwise(
        F.size(F.filter("cuts", lambda c: c <= F.col("at").cast("double")))
    )
    moments = moments.join(F.broadcast(cuts), list(KEY), "left").withColumn("span", span).drop("cuts")

    # what each range leaves: its last state, carried over to those after it
    left = moments.where("state IS NOT NULL").groupBy(*KEY, "span").agg(F.max_by("state", "at").alias("last"))
    hot_spans = moments.join(F.broadcast(hot), list(KEY), "left_semi").select(*KEY, "span").distinct()
    before = Window.partitionBy(*KEY).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a key
    carried = (
        hot_spans.join(left, [*KEY, "span"], "left")
        .select(*KEY, "span", F.last("last", True).over(before).alias("carried"))
        .where("carried IS NOT NULL")
    )
    moments = moments.join(F.broadcast(carried), [*KEY, "span"], "left")  # at most HOT_SHARE * RANGES rows

    order = Window.partitionBy(*KEY, "span").orderBy("at", "asked")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # a record's delta is its state less the state before it; records come before
    # references of the same time
    earlier = F.coalesce(F.last("state", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"), F.lit(0))
    deltas = moments.withColumn("delta", F.when(F.col("state").isNotNull(), F.col("state") - earlier))
    count = F.coalesce(F.col("carried"), F.lit(0)) + F.coalesce(F.sum("delta").over(upto), F.lit(0))
    known = F.col("carried").isNotNull() | (F.count("delta").over(upto) > 0)
    return (
        deltas.select(*KEY, "at", "refs", "asked", F.when(known, count).alias("existence")).where("asked = 1").drop("asked")
    )


def orphan_references(refs: DataFrame, states: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """``(src, rec_id, ref_type, ref, status, period)`` of each reference whose
    key did not exist at its time: ``missing`` (no record at all), ``late`` (the
    first record is later) or ``deleted`` (the last record so far deletes it).

    ``always``: ``(type, id)`` that exist at any time. Repeated references of one
    record count once. ``period`` is the month of reference in UTC.
    """
    if always is not None:
        refs = refs.join(small_side(always.where("type IS NOT NULL AND id IS NOT NULL").select(*KEY).distinct()), list(KEY), "left_anti")
    points = refs.groupBy(*KEY, "at").agg(F.count(F.lit(1)).alias("refs"))
    found = _counts_at(states, points).where(is_orphan())
    ever = states.select(*KEY).distinct().withColumn("ever", F.lit(True))
    status = F.when(F.col("existence").isNotNull(), "deleted").when(F.col("ever"), "late").otherwise("missing")
    judged = found.join(ever, list(KEY), "left").select(*KEY, "at", status.alias("status"))
    return (
        refs.join(judged, [*KEY, "at"])
        .select(
            "src",
            "rec_id",
            F.col("type").alias("ref_type"),
            F.col("id").alias("ref"),
            "status",
            F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM").alias("period"),
        )
        .distinct()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per table and period."""
    return found.groupBy("src", "period", "status").agg(
        F.count(F.lit(1)).alias("n_references"), F.count_distinct("ref_type", "ref").alias("n_keys")
    )
