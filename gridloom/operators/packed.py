"""Several values packed in one field, split into rows with their position.

A cell is split on quote characters. Odd pieces are literals and stay as they
are; in even pieces delimiters become one separator mark, brackets go, and for
tag bags the sign between key and value becomes another mark. Folding the pieces
back gives a string in which only real separators are marked, whose split is the
list of values with ordinals. All of it is array SQL inside one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let

# Marks from the control range; such characters in a cell are blanks.
_SEP, _ARROW, _EQUALS, _QUOTE, _SLASH = "\u0003", "\u0004", "\u0005", "\u0001", "\u0002"

#: Delimiters of plain lists, and of lists of ids, which never hold a blank or
#: an underscore.
LIST_DELIMITERS = r"[;,|/&\n；，｜、]"
ID_DELIMITERS = r"[;,|/&_\s；，｜、]"
#: In a tag bag a delimiter counts if a key or a quoted piece follows it.
TAG_DELIMITERS = r"[;,|\n](?=[^=;,|\n]*=)|[;,|\n](?=[\s\[\]{}]*$)"
_BRACKETS = r"[\[\]{}()]"
# a single quote that opens or closes a value
_SINGLE = r"(?:(?<=^)|(?<=[\[{(,;|/&=>:\s]))'|'(?=\s*(?:$|[\]}),;|/&=:]))"


def _marked(cell: Column, delimiters: str, tags: bool) -> Column:
    """The cell with marks for separators, without quotes and brackets."""
    guarded = F.replace(F.replace(F.regexp_replace(cell, "[\u0001-\u0005]", " "), F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def even_single(p: Column) -> Column:
        found = F.size(F.regexp_extract_all(p, F.lit(_SINGLE), F.lit(0)))
        return F.when((found > 0) & (found % 2 == 0), F.regexp_replace(p, _SINGLE, '"')).otherwise(p)

    # single quotes outside double ones become double ones, so one split serves both
    def unified(g: Column) -> Column:
        return F.when(
            g.contains("'"),
            F.array_join(F.transform(F.split(g, '"', -1), lambda p, i: F.when(i % 2 == 0, even_single(p)).otherwise(p)), '"'),
        ).otherwise(g)

    def outside(p: Column) -> Column:
        # with quotes on both sides, a blank separates and two quotes in a row are one quote
        if tags:
            p = F.regexp_replace(p, r"^\s*:\s*$", _ARROW)
        p = F.regexp_replace(p, delimiters, _SEP)
        if tags:
            p = F.regexp_replace(F.regexp_replace(p, "=>", _ARROW), "=", _EQUALS)
        return F.regexp_replace(p, _BRACKETS, "")

    def fold(pieces: Column) -> Column:
        last = F.size(pieces) - 1
        inner = lambda i: (i > 0) & (i < last)
        one = lambda p, i: (
            F.when(i % 2 == 1, p)
            .when(inner(i) & (p == ""), F.lit('"'))
            .when(inner(i) & p.rlike(r"^\s+$"), F.lit(_SEP))
            .otherwise(outside(p))
        )
        return F.array_join(F.transform(pieces, one), "")

    return let(unified(guarded), lambda g: let(F.split(g, '"', -1), fold))


def _restored(x: Column) -> Column:
    x = F.replace(F.replace(x, F.lit(_ARROW), F.lit("=>")), F.lit(_EQUALS), F.lit("="))
    x = F.replace(F.replace(x, F.lit(_QUOTE), F.lit('"')), F.lit(_SLASH), F.lit("\\"))
    return F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")


def packed_values(cell: Column, kind: str = "list") -> Column:
    """``array<struct<tag, item>>`` of the non-empty values of a cell, in order.

    ``kind``: ``list`` (any text values), ``ids`` (digits; a fraction is cut off
    and what has no digit is dropped) or ``tags`` (key-value pairs; keys and
    values without the other part are dropped). A delimiter inside quotes belongs
    to the value; doubled or escaped quotes are one quote; an unclosed quote runs
    to the end. Null and empty cells give an empty array; repeats are kept.
    """
    if kind not in ("list", "ids", "tags"):
        raise ValueError(f"unknown kind of packed field: {kind}")
    tags = kind == "tags"
    delimiters = {"list": LIST_DELIMITERS, "ids": ID_DELIMITERS, "tags": TAG_DELIMITERS}[kind]
    parts = F.split(_marked(F.coalesce(cell, F.lit("")), delimiters, tags), _SEP, -1)
    if tags:
        cut = f"^([^{_ARROW}{_EQUALS}]*)[{_ARROW}{_EQUALS}]((?s).*)$"
        pairs = F.transform(
            parts,
            lambda p: F.struct(
                _restored(F.regexp_extract(p, cut, 1)).alias("tag"), _restored(F.regexp_extract(p, cut, 2)).alias("item")
            ),
        )
        return F.filter(pairs, lambda p: (p["tag"] != "") & (p["item"] != ""))
    if kind == "ids":
        parts = F.transform(parts, lambda p: F.regexp_extract(p, r"(\d+)", 1))
    items = F.transform(parts, lambda p: F.struct(F.lit("").alias("tag"), _restored(p).alias("item")))
    return F.filter(items, lambda p: p["item"] != "")


def unpack(df: DataFrame, fields: dict[str, tuple[str, str]], id_col: str = "rec_id", least: int = 2) -> DataFrame:
    """``(id_col, field, pos, tag, item)``: one row per value of each cell that
    holds at least ``least`` values. ``fields`` maps a column to the name it gets
    in ``field`` and its kind. One narrow pass; other columns are not read."""
    cells = F.array(
        *(F.struct(F.lit(name).alias("field"), packed_values(F.col(c).cast("string"), kind).alias("v")) for c, (name, kind) in fields.items())
    )
    return (
        df.select(F.col(id_col), F.inline(cells))
        .where(F.size("v") >= least)
        .select(id_col, "field", F.posexplode("v").alias("pos", "x"))
        .select(id_col, "field", F.col("pos").cast("bigint").alias("pos"), "x.tag", "x.item")
    )


def packed_rows(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """Packed way ids and road classes of edges and tag bags of map lines."""
    a = unpack(edges, {"osmid": ("edges.osmid", "ids"), "highway": ("edges.highway", "list")})
    b = unpack(lines, {"other_tags": ("osm_lines.other_tags", "tags")})
    return a.unionByName(b)
