"""Texts that look the same but differ in their characters.

``plain`` maps width forms, blanks, invisible characters, ligatures and letters
of other scripts to one written form, all with JVM-side expressions. What is
then left of the difference, joined against separate accents, is settled by
grouping under the accent- and case-sensitive ``UNICODE`` collation; each class
takes its smallest document as canonical member, which is joined back.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..runtime import cut, small_side, stored

#: Ids of texts with a near twin are broadcast up to this count, else shuffled.
NEAR_BROADCAST = 200_000
#: Members of a class that one block of a pairs join has, about.
BLOCK = 2_000

# Letters drawn alike in common fonts, Cyrillic, Greek, Armenian
# and phonetic letters against the Latin letter of the same shape.
ALIKE = {
    "аеорсухіѕјһԁԛԝ": "aeopcyxisjhdqw",
    "АВЕКМНОРСТУХІЅЈԚԜҮ": "ABEKMHOPCTYXISJQWY",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",
    "ονϲϳ": "ovcj",
    "ոսօՕհ": "nuoOh",
    "ɡ": "g",
}


@lru_cache(1)
def _tables() -> tuple[str, str, str, dict[str, str]]:
    """Characters with one character instead, the dropped ones after them, and
    those with several instead; all by rule from the Unicode database."""
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    for theirs, ours in ALIKE.items():
        one.update({a: b for a, b in zip(theirs, ours)})
    shown = {0x00AD: False}  # the soft hyphen shows only at a line's end
    dropped = []
    for cp in range(0xA0, sys.maxunicode + 1):
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat == "Zs":
            one[c] = " "
        elif cat == "Cf" and not (0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x8E2) or 0x110BD <= cp <= 0x110CD) or shown.get(cp) is False:
            dropped.append(c)
        elif 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0x17B4, 0x17B5) or 0x180B <= cp <= 0x180F:
            dropped.append(c)
    for cp in range(0xFF01, 0xFFEF):  # full and half width forms
        c = chr(cp)
        if cp in (0xFF9E, 0xFF9F):  # separate voicing marks become combining ones
            one[c] = chr(0x3099 + cp - 0xFF9E)
        elif cp == 0xFFA0:
            dropped.append(c)
        elif (w := unicodedata.normalize("NFKC", c)) != c and len(w) == 1:
            one[c] = one.get(w, w)
        elif cp == 0xFFE3:
            one[c] = "¯"
    for cp in range(0xFB00, 0xFB07):  # ligatures
        many[chr(cp)] = unicodedata.normalize("NFKD", chr(cp)).replace("ſ", "s") if cp == 0xFB06 else unicodedata.normalize("NFKD", chr(cp))
    for cp in (0x132, 0x133, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC):
        many[chr(cp)] = unicodedata.normalize("NFKD", chr(cp))
    for cp in chain_ranges((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)):  # accented look-alikes, written joined
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0] in one:
            w = unicodedata.normalize("NFC", one[d[0]] + d[1:])
            if len(w) == 1:
                one[chr(cp)] = w
            else:
                many[chr(cp)] = w
    dropped = [c for c in dropped if c not in one]
    return "".join(one), "".join(one.values()), "".join(dropped), many


def chain_ranges(*spans: tuple[int, int]):
    for a, b in spans:
        yield from range(a, b)


def _class_of(chars: str) -> str:
    """A regular-expression class of these characters, in ranges."""
    cps, spans = sorted(map(ord, set(chars))), []
    for c in cps:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


#: Ranges that hold every mapped character; few, as each costs time per
#: character. Dashes, quotes, bullets and CJK signs lie between them.
_SUSPECT = (
    r"[\x{A0}\x{AD}\x{130}-\x{133}\x{1C7}-\x{1CC}\x{250}-\x{1FFF}\x{2000}-\x{2012}\x{2028}-\x{202F}\x{205F}-\x{206F}"
    r"\x{3000}\x{3164}\x{FB00}-\x{FFFB}\x{110BD}-\x{110CD}\x{13430}-\x{1345F}\x{1BCA0}-\x{1BCAF}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
)


def plain(text: Column) -> Column:
    """The text with look-alikes, width forms, blanks, ligatures and invisible
    characters in one form. Case, accents, punctuation, digits, line breaks and
    the number of blanks stay. Null gives null, empty gives empty."""
    src, dst, dropped, many = _tables()
    basic = "".join(c for c in dropped if ord(c) < 0xE0000)  # the rest by pattern
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in many.items()))

    def body(t: Column) -> Column:
        apart = F.when(
            t.rlike(_class_of("".join(many))), F.aggregate(pairs, t, lambda acc, p: F.replace(acc, p["k"], p["v"]))
        ).otherwise(t)
        tagless = F.regexp_replace(apart, r"[\x{E0000}-\x{E0FFF}]", "")
        # characters without a counterpart are deleted by translate
        return F.when(t.rlike(_SUSPECT), F.translate(tagless, src + basic, dst)).otherwise(t)

    return let(text, body)


#: Ranges of the characters that canonical composition may change: marks, parts
#: of Hangul syllables and characters that always stand decomposed or as another
#: one. The first range spares most texts the rest.
_COMPOSABLE = (
    r"[\x{300}-\x{10FFFF}&&[\p{M}\x{374}\x{37E}\x{387}\x{958}-\x{95F}\x{9DC}-\x{9DF}\x{A33}-\x{A5E}\x{B5C}\x{B5D}\x{F43}-\x{FB9}\x{1100}-\x{11FF}"
    r"\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}-\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]]"
)


def _normalizer(method: str, text: Column) -> Column:
    """A static method of the Unicode library that Spark itself brings for its
    collations, called in the JVM for each text."""
    return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(False))


def joined(text: Column) -> Column:
    """The canonical composition (NFC) of a text: accents joined to their letters,
    however many, parts of Hangul to syllables. Only texts that hold a character
    it may change are touched."""
    return F.when(text.rlike(_COMPOSABLE), _normalizer("compose", text)).otherwise(text)


@lru_cache(1)
def _small_twins() -> tuple[str, str]:
    """Small letters of other scripts whose capitals are drawn like Latin ones, and
    the small Latin letters instead. Greek nu stays: it is drawn like a v."""
    drawn = {a: b for theirs, ours in ALIKE.items() for a, b in zip(theirs, ours)}
    pairs = {a.lower(): b.lower() for a, b in drawn.items() if a != a.lower() and a.lower() not in drawn}
    return "".join(pairs), "".join(pairs.values())


#: Greek letters that no Latin letter is drawn like.
_GREEK_ONLY = r"[\x{393}\x{394}\x{398}\x{39B}\x{39E}\x{3A0}\x{3A3}\x{3A6}\x{3A8}\x{3A9}\x{3B1}-\x{3BC}\x{3BE}\x{3C0}-\x{3CE}\x{386}-\x{390}]"


def caseless(text: Column) -> Column:
    """One form of a text whatever its case and whichever of its letters are drawn
    alike. What a small letter is drawn like differs from what its capital is
    drawn like in other scripts, so small ones follow their capitals. Only the
    Greek nu is a v when small and an N when not: a capital one with a letter that
    can only be Greek within twenty characters counts as Greek, hence as small."""
    near = rf"(?s)Ν(?=.{{0,20}}?{_GREEK_ONLY})|(?<={_GREEK_ONLY}.{{0,20}})Ν"
    nu = F.when(text.contains("Ν"), F.regexp_replace(joined(text), near, "ν")).otherwise(text)
    src, dst = _small_twins()

    def small(t: Column) -> Column:
        apart = F.translate(_normalizer("decompose", t), src + "ς", dst + "σ")
        other = F.when(t.rlike(r"[\x{370}-\x{52F}\x{1F00}-\x{1FFF}]"), _normalizer("compose", apart)).otherwise(t)
        return F.when(t.rlike(r"[ßi]"), F.replace(F.replace(other, F.lit("ß"), F.lit("ss")), F.lit("i\u0307"), F.lit("i"))).otherwise(other)

    return let(let(plain(nu), lambda p: F.lower(joined(p))), small)


def skeleton(form: Column) -> Column:
    """A hash that is equal for texts of one class, cheap, and nearly never equal
    for others: the letters and digits of all scripts, composed, and the visible
    ASCII characters."""
    return F.xxhash64(F.regexp_replace(joined(form), r"[^\x21-\x7E\p{L}\p{N}]+", ""))


def look_alike_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, class_id, text_id)`` of every text that has a look-alike which
    is not the same string. ``class_id`` is the smallest id of the class,
    ``text_id`` tells the different strings of a class apart.

    Null texts and texts of blanks only have no class. Rows with a null id are
    left out; repeated rows count once. Other columns are not read.

    The first pass over the texts keeps only hashes, which are pre-aggregated;
    only texts whose skeleton occurs with different strings are read again and
    grouped by collation, so nearly nothing of the corpus is moved. No group is
    gathered into a list; hot classes are plain aggregation and join keys.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_t")).where(
        F.col("_id").isNotNull() & F.col("_t").isNotNull()
    )
    seen = docs.select(
        "_id",
        F.xxhash64("_t").alias("_h"),
        let(plain(F.col("_t")), lambda p: F.when(p.rlike(r"\S"), skeleton(p))).alias("_k"),
    )
    seen = stored(seen.where("_k IS NOT NULL"), "skeletons")
    mixed = seen.groupBy("_k").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).where("lo <> hi").select("_k")
    ids = stored(seen.join(mixed, "_k", "left_semi").select("_id").distinct(), "near-ids")
    near = docs.join(small_side(ids, NEAR_BROADCAST), "_id", "left_semi")
    near = near.select("_id", F.xxhash64("_t").alias("_h"), plain(F.col("_t")).alias("_p"))
    near = stored(near, "near-texts").withColumn("_c", F.expr("collate(_p, 'UNICODE')"))
    classes = near.groupBy("_c").agg(F.min("_id").alias("class_id"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
    classes = classes.where("lo <> hi").select("_c", "class_id")
    return near.join(classes, "_c").select(F.col("_id").alias(id_col), "class_id", F.col("_h").alias("text_id")).distinct()


def look_alike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_a, doc_b)``, ``doc_a < doc_b``: both look the same throughout and
    are not the same string. A class of more than BLOCK members is joined block by
    block, so that its pairs are made by many tasks."""
    m = cut(look_alike_classes(df, id_col, text_col))
    size = m.groupBy("class_id").agg((F.floor((F.count(F.lit(1)) - 1) / BLOCK) + 1).cast("int").alias("_n"))
    m = m.join(size, "class_id").withColumn("_own", F.pmod(F.xxhash64(id_col), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = m.select("class_id", F.col(id_col).alias("doc_a"), F.col("text_id").alias("ta"), F.col("_own").alias("_a"), every.alias("_b"))
    b = m.select("class_id", F.col(id_col).alias("doc_b"), F.col("text_id").alias("tb"), F.col("_own").alias("_b"), every.alias("_a"))
    return a.join(b, ["class_id", "_a", "_b"]).where("doc_a < doc_b AND ta <> tb").select("doc_a", "doc_b").distinct()
