"""Free-form map tags as routing attributes, as JVM-side expressions.

Each function takes and gives a Column; null and blank inputs have the result
stated. Booleans are expected as the strings ``true`` and ``false``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import let

MPH_IN_KPH = 1.60934

# Kilograms in a unit, and units in a kilogram.
KG_IN = {"lbs": 0.453592, "kg": 1.0, "tons": 1000.0, "stone": 6.35029}
IN_KG = {"lbs": 2.20462, "kg": 1.0, "tons": 0.001, "stone": 1 / 6.35029}

# Tag values by what they mean.
YES = ("yes", "true", "1")
BACKWARD = ("-1", "reverse")
CLOSED = ("no", "false", "0", "private")
CLOSED_TO_TRUCKS = ("no", "false", "0")
MAJOR_ROADS = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link")


def _clean(v: Column) -> Column:
    return F.lower(F.trim(v))


def _blank(v: Column) -> Column:
    return v.isNull() | (F.trim(v) == "")


def _items(v: Column, pattern: str = ";") -> Column:
    return F.transform(F.split(v, pattern, -1), _clean)


def parse_other_tags(bag: Column) -> Column:
    """Map of the ``"k"=>"v"`` pairs of a tag bag; the last of a repeated key
    counts, empty values and embedded quotes do not match, null gives an empty map."""
    pairs = lambda g: F.regexp_extract_all(bag, F.lit('"([^"]+)"=>"([^"]+)"'), F.lit(g))
    keys, values = F.reverse(pairs(1)), F.reverse(pairs(2))
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    # keep the first of the reversed list, that is the last written
    once = F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    return F.coalesce(F.map_from_entries(F.transform(once, lambda e: F.struct(e["k"], e["v"]))), F.create_map().cast("map<string,string>"))


def tag_as_float(bag: Column, key: str) -> Column:
    return F.try_element_at(parse_other_tags(bag), F.lit(key)).try_cast("double")


def split_tag_pairs(bag: Column) -> Column:
    """Map of the comma-separated parts of a bag outside quotes that hold exactly
    one arrow; keys and values without blanks and quotes around them."""
    bare = lambda x: F.regexp_replace(F.trim(x), '^[" ]+|[" ]+$', "")
    parts = F.split(bag, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    good = F.filter(parts, lambda p: F.size(F.split(p, "=>", -1)) == 2)
    halves = F.transform(good, lambda p: F.struct(bare(F.split(p, "=>", -1)[0]).alias("k"), bare(F.split(p, "=>", -1)[1]).alias("v")))
    keys = F.transform(halves, lambda e: e["k"])
    last = F.filter(halves, lambda e, i: F.size(keys) - F.array_position(F.reverse(keys), e["k"]) == i)
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def standard_oneway(v: Column) -> Column:
    """``yes``, ``-1`` (backward) or ``no``; of several values all must agree."""
    parts = _items(v)
    return (
        F.when(F.coalesce(v, F.lit("")) == "", "no")
        .when(F.forall(parts, lambda p: p.isin(*YES)), "yes")
        .when(F.forall(parts, lambda p: p.isin(*BACKWARD)), "-1")
        .otherwise("no")
    )


def standard_access(v: Column) -> Column:
    """``no`` if any of the values closes the road to the public, else ``yes``;
    also for motor vehicles."""
    return F.when(_blank(v), "yes").when(F.exists(_items(v, r"[;|]"), lambda p: p.isin(*CLOSED)), "no").otherwise("yes")


standard_motor_vehicle = standard_access


def standard_hgv(v: Column) -> Column:
    """Whether trucks may use the road; private roads are not closed to them."""
    return _blank(v) | ~F.exists(_items(v), lambda p: p.isin(*CLOSED_TO_TRUCKS))


def standard_maxspeed(v: Column, default_kph: float | None = None) -> Column:
    """``N mph`` of one value; a bare number is km/h; what cannot be read gives
    the default, or null."""
    mph = lambda x: F.concat(F.rint(x).cast("bigint").cast("string"), F.lit(" mph"))
    pattern = r"^(\d+(?:\.\d+)?)\s*(mph|kmh|km/h|kph)?$"
    default = mph(F.lit(default_kph / MPH_IN_KPH)) if default_kph is not None else F.lit(None).cast("string")

    def read(t: Column) -> Column:
        n = F.regexp_extract(t, pattern, 1).try_cast("double")
        return mph(F.when(F.regexp_extract(t, pattern, 2) == "mph", n).otherwise(n / MPH_IN_KPH))

    return F.coalesce(let(_clean(v), read), default)


def standard_maxspeeds(values: Column, default_kph: float | None = None) -> Column:
    """``N mph`` of an array: the mean of its rounded speeds, rounded again."""
    mph = F.filter(F.transform(values, lambda v: F.split(standard_maxspeed(v, default_kph), " ")[0].cast("bigint")), lambda x: x.isNotNull())
    mean = F.aggregate(mph, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.size(mph)
    default = F.rint(F.lit(default_kph / MPH_IN_KPH)) if default_kph is not None else F.lit(None).cast("double")
    return F.concat(F.coalesce(F.when(F.size(mph) > 0, F.rint(mean)), default).cast("bigint").cast("string"), F.lit(" mph"))


def standard_weight(v: Column, unit: str) -> Column:
    """A weight in ``lbs``, ``kg``, ``tons`` or ``stone``; a bare number is metric
    tons, other text that begins with a number too, else null. An unknown unit
    asked for gives kilograms."""
    pattern = r"^(\d+\.?\d*)\s*(tons?|t|kg|lbs?|st|stone)"
    to = F.lit(IN_KG.get(unit, 1.0))

    def read(t: Column) -> Column:
        n = F.regexp_extract(t, pattern, 1).try_cast("double")
        u = F.regexp_extract(t, pattern, 2)
        kg = F.when(u.startswith("t"), n * KG_IN["tons"]).when(u.startswith("lb"), n * KG_IN["lbs"]).when(u == "kg", n).otherwise(n * KG_IN["stone"])
        bare = F.regexp_extract(t, r"^(\d+\.?\d*)", 1).try_cast("double") * KG_IN["tons"]
        # a bare number asked for in stone stays in kilograms
        return F.when(t.rlike(r"^[\d.]+$"), bare * F.lit(IN_KG[unit] if unit in ("lbs", "kg", "tons") else 1.0)).otherwise(F.coalesce(kg, bare) * to)

    return let(F.lower(v), read)


def truthy(v: Column) -> Column:
    return F.coalesce(_clean(v).isin(*YES), F.lit(False))


def protected_edge(highways: Column, layer_role: Column, backbone: Column, bridge: Column, tunnel: Column) -> Column:
    """Edges that cleaning must keep: backbone, major roads, bridges, tunnels."""
    major = F.exists(highways, lambda h: h.isin(*MAJOR_ROADS))
    return F.coalesce(backbone, F.lit(False)) | F.coalesce(layer_role == "backbone", F.lit(False)) | F.coalesce(major, F.lit(False)) | truthy(bridge) | truthy(tunnel)


def edge_id(u: Column, v: Column, osmids: Column, key: Column | None = None) -> Column:
    """Twelve hexadecimal digits that tell an edge apart; ``osmids`` an array."""
    ids = F.array_join(F.array_sort(F.transform(osmids, lambda x: x.cast("string"))), "_")
    parts = [u.cast("string"), v.cast("string"), *([key.cast("string")] if key is not None else []), ids]
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 12)


def process_tags(edges: DataFrame, unit: str = "lbs", mdv_max: float = 26000.0, hdv_max: float = 80000.0) -> DataFrame:
    """Standard ``oneway, motor_vehicle, maxspeed, access, hgv, mdv, maxweight``.
    ``oneway`` is needed; other missing columns count as null. Trucks are barred
    where medium vehicles are, by weight up to ``hdv_max`` and by any maxlength."""
    if "oneway" not in edges.columns:
        raise ValueError("edges have no oneway column")
    col = lambda c: F.col(f"`{c}`") if c in edges.columns else F.lit(None).cast("string")
    weight = standard_weight(F.coalesce(col("maxweight:hgv"), col("maxweight")).cast("string"), unit)
    out = edges.withColumns(
        {
            "oneway": standard_oneway(col("oneway").cast("string")),
            "motor_vehicle": standard_motor_vehicle(col("motor_vehicle").cast("string")),
            "maxspeed": standard_maxspeed(col("maxspeed").cast("string")),
            "access": standard_access(col("access").cast("string")),
            "maxweight": weight,
            "_truck": standard_hgv(col("hgv").cast("string")) & col("maxlength").isNull(),
        }
    )
    out = out.withColumn("mdv", ~F.coalesce(F.col("maxweight") <= mdv_max, F.lit(False)))
    return out.withColumn("hgv", F.col("_truck") & F.col("mdv") & ~F.coalesce(F.col("maxweight") <= hdv_max, F.lit(False))).drop("_truck")


def speed_kph(maxspeed: Column) -> Column:
    """Kilometres per hour of a standard speed in miles per hour."""
    return F.regexp_extract(F.lower(F.trim(maxspeed)), r"^(\d+(?:\.\d+)?)\s*mph$", 1).try_cast("double") * 1.60934


def highway_set(highway: Column) -> Column:
    """The different road classes of an array or of one text, without nulls."""
    return F.array_distinct(F.filter(highway, lambda h: h.isNotNull()))


def first_class(highway: Column) -> Column:
    """The first road class of an array, ``unknown`` without one."""
    return F.coalesce(F.trim(F.get(highway, F.lit(0))), F.lit("unknown"))


# Road classes of the layers a network is usually made of.
LAYER_ROADS = {
    "main": (
        "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified",
    ),
    "backbone": ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"),
    "connector": ("primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified"),
    "residential": ("residential",),
}


def highway_filter(types: list[str]) -> str:
    """The filter text that asks a map service for these road classes."""
    return f'["highway"~"{"|".join(types)}"]'


# What a ferry link is given.
FERRY = {"reversed": False, "maxspeed": "10 mph", "highway": "unclassified", "oneway": "no", "lanes": "2", "hgv": False, "mdv": True}


def ferry_edges(edges: DataFrame) -> DataFrame:
    """Ferry links that cars may use, with a ferry's attributes; null allows."""
    open_ = [~F.col(c).eqNullSafe("no") for c in ("motorcar", "motor_vehicle") if c in edges.columns]
    out = edges
    for cond in open_:
        out = out.where(cond)
    return out.withColumns({c: F.lit(v) for c, v in FERRY.items()})
