"""Quantities recorded in different units, brought to common ones.

Units are nodes of a graph and conversions its edges, each an affine function
``y = a x + b``. For every unit the shortest composition to the target of its
kind is computed once, every cycle is checked to be consistent, and cells are
converted by an equi-join on (source unit, target).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..runtime import literal_table, small_side

# Conversions (from, to, a, b). Those between non-target units
# close cycles and so are checked against the others.
CONVERSIONS = [
    ("mi/h", "km/h", 1.609344, 0.0),
    ("kn", "km/h", 1.852, 0.0),
    ("m/s", "km/h", 3.6, 0.0),
    ("km/min", "km/h", 60.0, 0.0),
    ("ft/s", "m/s", 0.3048, 0.0),
    ("mi/h", "ft/s", 5280 / 3600, 0.0),
    ("kn", "m/s", 1852 / 3600, 0.0),
    ("tenth of km/h", "km/h", 0.1, 0.0),
    ("tenth of mi/h", "mi/h", 0.1, 0.0),
    ("tenth of m/s", "m/s", 0.1, 0.0),
    ("tenth of kn", "kn", 0.1, 0.0),
    ("lane per direction", "lane", 2.0, 0.0),
    ("tenth of lane", "lane", 0.1, 0.0),
    ("ft", "m", 0.3048, 0.0),
    ("in", "ft", 1 / 12, 0.0),
    ("in", "m", 0.0254, 0.0),
]
TARGETS = {"maxspeed": "km/h", "lanes": "lane"}


@dataclass(frozen=True)
class Affine:
    a: float
    b: float

    def then(self, g: Affine) -> Affine:
        return Affine(self.a * g.a, g.a * self.b + g.b)

    def inverse(self) -> Affine:
        return Affine(1 / self.a, -self.b / self.a)

    def near(self, g: Affine, tol: float = 1e-9) -> bool:
        return abs(self.a - g.a) <= tol * max(abs(self.a), abs(g.a)) and abs(self.b - g.b) <= tol * max(1.0, abs(self.b))


class UnitGraph:
    """Units and conversions; small by nature, held on the driver."""

    def __init__(self, conversions: list[tuple[str, str, float, float]]):
        self.edges: dict[str, list[tuple[str, Affine]]] = {}
        for u, v, a, b in conversions:
            if not a:
                raise ValueError(f"the conversion from {u} to {v} cannot be undone")
            f = Affine(a, b)
            self.edges.setdefault(u, []).append((v, f))
            self.edges.setdefault(v, []).append((u, f.inverse()))

    def to(self, target: str) -> dict[str, Affine]:
        """For each unit that reaches ``target`` the shortest composition to it.
        Raises if two ways round disagree."""
        found, queue = {target: Affine(1.0, 0.0)}, deque([target])
        while queue:
            v = queue.popleft()
            for u, back in self.edges.get(v, []):
                if u not in found:
                    found[u] = back.inverse().then(found[v])
                    queue.append(u)
        for u, f in found.items():
            for v, step in self.edges.get(u, []):
                if not step.then(found[v]).near(f):
                    raise ValueError(f"conversions of {u} and {v} to {target} disagree")
        return found

    def rows(self, targets: list[str]) -> list[tuple[str, str, float, float]]:
        return [(u, t, f.a, f.b) for t in sorted(set(targets)) for u, f in sorted(self.to(t).items())]


# -- what the notes of a source say of figures standing alone ----------------

_SPEEDS = [  # fixed values: how the units are written, the more special first
    ("km/min", r"km\s*/\s*min|kilomet(?:re|er)s?\s*(?:per|a|an|/)\s*min"),
    ("km/h", r"km\s*/\s*h|kmh|kph|km\.?p\.?h|kilomet(?:re|er)s?"),
    ("ft/s", r"ft\s*/\s*s|\bfps\b|f(?:ee|oo)t\s*(?:per|a|/)\s*s"),
    ("m/s", r"\bm\s*/\s*s|\bmps\b|met(?:re|er)s?\s*(?:per|a|/)\s*s"),
    ("mi/h", r"mph|m\.\s*p\.\s*h|mi\s*/\s*h|miles?"),
    ("kn", r"\bk(?:n|t|ts|nots?)\b|nautical"),
]


def _first(text: Column, cases: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for unit, pattern in reversed(cases):
        out = F.when(text.rlike(pattern), F.lit(unit)).otherwise(out)
    return out


def read_notes(notes: DataFrame) -> DataFrame:
    """``(source, field, plain_unit, lane_width, width_unit)`` from what a source
    says about a field in words; of several notes the first in order counts."""
    n = F.lower("note")
    tenth = F.when(n.rlike(r"tenths?\b"), F.lit("tenth of ")).otherwise(F.lit(""))
    speed = F.concat(tenth, _first(n, _SPEEDS))
    wide = r"one lane (?:being|is|has)?\s*([0-9.]+)\s*(feet|foot|ft|met(?:re|er)s?|m)\b"
    width_unit = lambda w: F.when(w.rlike("^(f|ft)"), F.lit("ft")).when(w.rlike("^m"), F.lit("m"))
    plain_width = width_unit(F.regexp_extract(n, r"(?:figure|number|value)s? (?:is|are) in (feet|ft|met|m)", 1))
    lanes = (
        F.when(n.contains("width"), plain_width)
        .when(n.rlike(r"tenths?\b"), F.lit("tenth of lane"))
        .when(n.rlike(r"(?:of|in|for) (?:one|each|a single) (?:direction|way)|per direction"), F.lit("lane per direction"))
        .when(n.contains("lane") | n.contains("total"), F.lit("lane"))
    )
    return (
        notes.where("source IS NOT NULL AND field IS NOT NULL AND note IS NOT NULL")
        .select(
            "source",
            "field",
            "note",
            F.when(F.col("field") == "maxspeed", speed).otherwise(lanes).alias("plain_unit"),
            F.expr("try_cast(nullif(regexp_extract(lower(note), '" + wide.replace("\\", "\\\\") + "', 1), '') AS double)").alias("lane_width"),
            width_unit(F.regexp_extract(n, wide, 2)).alias("width_unit"),
        )
        .groupBy("source", "field")
        .agg(F.min(F.struct("note", "plain_unit", "lane_width", "width_unit")).alias("m"))
        .select("source", "field", "m.plain_unit", "m.lane_width", "m.width_unit")
    )


# -- what a cell states ---------------------------------------------------------

_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_FULL = "０１２３４５６７８９．，－＋"
_HALF = "0123456789.,-+"
_NUMBER = r"\d+(?:\.\d+)?|\.\d+"


def _tidy(cell: Column) -> Column:
    t = F.lower(F.translate(F.regexp_replace(cell, r"^[\s ]+|[\s ]+$", ""), _FULL + "′’", _HALF + "''"))
    return F.regexp_replace(t, r"(\d),(\d)", "$1.$2")


def _in_words(t: Column) -> Column:
    """A number written in words, null if there is none."""
    ones = F.create_map(*(x for i, w in enumerate(_ONES) for x in (F.lit(w), F.lit(float(i)))))
    tens = F.create_map(*(x for i, w in enumerate(_TENS) for x in (F.lit(w), F.lit(20.0 + 10 * i))))
    one = F.try_element_at(ones, F.regexp_extract(t, rf"\b({'|'.join(_ONES)})\b", 1))
    ten = F.try_element_at(tens, F.regexp_extract(t, rf"\b({'|'.join(_TENS)})\b", 1))
    hundred = F.when(t.rlike(r"\bhundred\b"), F.lit(100.0))
    last = F.element_at(F.split(t, "hundred"), -1)
    low = lambda x: F.coalesce(F.try_element_at(ones, F.regexp_extract(x, rf"\b({'|'.join(_ONES)})\b", 1)), F.lit(0.0))
    return F.when(hundred.isNotNull(), hundred * F.greatest(low(F.split(t, "hundred")[0]), F.lit(1.0)) + low(last) + F.coalesce(ten, F.lit(0.0))).when(
        one.isNotNull() | ten.isNotNull(), F.coalesce(one, F.lit(0.0)) + F.coalesce(ten, F.lit(0.0))
    )


def _roman(t: Column) -> Column:
    """Value of a Roman numeral, null for anything else."""
    value = F.create_map(*(x for c, v in (("i", 1.0), ("v", 5.0), ("x", 10.0), ("l", 50.0), ("", 0.0)) for x in (F.lit(c), F.lit(v))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("prev"))
    step = lambda acc, c: let(
        value[c], lambda v: F.struct(F.when(v < acc["prev"], acc["sum"] - v).otherwise(acc["sum"] + v).alias("sum"), v.alias("prev"))
    )
    return F.when(t.rlike(r"^(?:x{0,3})(?:ix|iv|v?i{0,3})$") & (t != ""), F.aggregate(F.reverse(F.split(t, "")), start, step)["sum"])


def _numbers(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(rf"({_NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def _speed(t: Column) -> Column:
    """``struct<value, unit>``; unit null: a figure standing alone."""
    value = F.coalesce(F.get(_numbers(t), F.lit(0)), _in_words(t))
    return F.struct(
        F.when(~t.rlike(r"(?:^|[^\w])-\s*\d") & ~t.rlike(r"^9{3,}(?:\.0*)?$"), value).alias("value"), _first(t, _SPEEDS).alias("unit")
    )


def _lane_count(t: Column) -> Column:
    numbers = _numbers(t)
    single = F.coalesce(F.get(numbers, F.lit(0)), _in_words(t), _roman(t))
    total = F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x)
    width = r"^\D*[\d.]+\s*"
    by_direction = t.rlike(r"\d\s*[+/]\s*\D*\d|forward|back|\b[nsew]b\b|bound") & (F.size(numbers) > 1)
    unit = (
        F.when(t.rlike(width + r"(?:ft|feet|foot|')"), F.lit("ft"))
        .when(t.rlike(width + r"(?:m|met(?:re|er)s?)(?:\W|$)"), F.lit("m"))
        .when(by_direction, F.lit("lane"))
        .when(t.rlike(r"per direction|each (?:way|direction)|(?:either|both) ways?|per way"), F.lit("lane per direction"))
        .when(t.rlike(r"\blanes?\b|total"), F.lit("lane"))
    )
    return F.struct(
        F.when(~t.rlike(r"(?:^|[^\w])-\s*\d") & ~t.rlike(r"^9{2,}(?:\.0*)?$"), F.when(by_direction, total).otherwise(single)).alias("value"),
        unit.alias("unit"),
    )


def common_units(df: DataFrame, notes: DataFrame, id_col: str = "rec_id", conversions: list | None = None) -> DataFrame:
    """``(id_col, field, quantity)``: speeds in km/h and lanes of the whole road.

    One row per cell of ``maxspeed`` and ``lanes`` that states a positive
    quantity, rounded to a whole number. A unit in the cell goes before the note
    of the row's ``source``; a figure alone of a source without a note, words
    without a number, zero, negative numbers and fillers (all nines) have none.
    A width becomes lanes by the lane width in the note: it is converted to the
    note's unit and divided by it. Conversions are constants; the notes, one per
    source and field, are broadcast only if they are counted to be few.
    """
    steps = list(CONVERSIONS if conversions is None else conversions)
    widths = [u for u in ("ft", "m") if any(u in s[:2] for s in steps)]
    table = literal_table(df.sparkSession, UnitGraph(steps).rows([*TARGETS.values(), *widths]), "unit string, target string, a double, b double")
    told = small_side(read_notes(notes).withColumnsRenamed({"source": "n_source", "field": "n_field"}))

    cell = lambda field, parse: let(
        _tidy(F.col(field).cast("string")),
        lambda t: F.struct(F.lit(field).alias("field"), F.lit(TARGETS[field]).alias("goal"), parse(t).alias("said")),
    )
    cells = df.select(
        F.col(id_col).alias("_id"), F.col("source").alias("_source"), F.inline(F.array(cell("maxspeed", _speed), cell("lanes", _lane_count)))
    ).where(F.col("said.value") > 0)
    cells = cells.join(told, (F.col("_source") == F.col("n_source")) & (F.col("field") == F.col("n_field")), "left")
    unit = F.coalesce("said.unit", "plain_unit")
    wide = (F.col("field") == "lanes") & unit.isin("ft", "m")
    per_lane = F.when(~wide, 1.0).when(F.col("lane_width") > 0, F.col("lane_width"))
    return (
        cells.select(
            "_id", "field", F.col("said.value").alias("x"), unit.alias("unit"), per_lane.alias("per_lane"),
            F.when(wide, F.col("width_unit")).otherwise(F.col("goal")).alias("target"),
        )
        .join(F.broadcast(table), ["unit", "target"])  # constants
        .select(F.col("_id").alias(id_col), "field", F.round((F.col("a") * F.col("x") + F.col("b")) / F.col("per_lane")).try_cast("bigint").alias("quantity"))
        .where("quantity > 0")
    )
