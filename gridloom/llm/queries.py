"""Queries of this subpackage, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import lookalike
from .leaks import leaked_items, near_items
from .linkage import linked_edges
from .lookalike import look_alike_classes, look_alike_pairs
from .tokens import encode_texts


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_edges(table(spark, d, "network"), table(spark, d, "edges")).select("edge_id", "link_id")


def p3_confidence(spark: SparkSession, d: str) -> DataFrame:
    return linked_edges(table(spark, d, "network"), table(spark, d, "edges"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return near_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_classes(table(spark, d, "documents")).select("doc_id", "class_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_confidence, p7_ids, p8_found, p8_near, p9_found, p9_classes)}


def _plain_sql(column: str) -> str:
    """The same characters mapped in DuckDB, accents joined by its own function."""
    src, dst, dropped, many = lookalike._tables()
    text, dst = column, dst.replace("'", "''")
    for k, v in many.items():
        text = f"replace({text}, '{k}', '{v}')"
    return f"nfc_normalize(translate({text}, '{src}{dropped}', '{dst}'))"


def oracle_sql() -> dict[str, str]:
    same = f"t AS (SELECT doc_id, text, {_plain_sql('text')} AS k FROM documents WHERE text IS NOT NULL)"
    small, latin = lookalike._small_twins()
    low = lambda c: f"replace(replace(translate(lower({_plain_sql(c)}), '{small}ς', '{latin}σ'), 'ß', 'ss'), 'i\u0307', 'i')"
    words = lambda c: f"list_filter(string_split_regex({low(c)}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    posts = lambda k, t, c: f"(SELECT {k}, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos, len(w) AS size FROM (SELECT {k}, {words(c)} AS w FROM {t}))"
    runs = lambda k, t, c: f"(SELECT {k}, unnest(range(1, len(w) - 11)) AS i, w FROM (SELECT {k}, {words(c)} AS w FROM {t}))"
    gram = "array_to_string(w[i : i + 12], ' ')"
    return {
        "p8_found": f"""WITH d AS (SELECT DISTINCT doc_id, {gram} AS g FROM {runs('doc_id', 'documents', 'text')}),
e AS (SELECT DISTINCT item_id, {gram} AS g FROM {runs('item_id', 'eval_items', 'passage')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)""",
        "p8_near": f"""WITH d AS {posts('doc_id', 'documents', 'text')}, e AS {posts('item_id', 'eval_items', 'passage')},
m AS (SELECT doc_id, item_id, e.pos AS ipos, e.size AS size, CAST(floor((d.pos - e.pos) / 6.0) AS BIGINT) AS b FROM d JOIN e USING (term)),
h AS (SELECT DISTINCT doc_id, item_id, size, ipos, b - k AS b FROM m, (VALUES (0), (1)) AS v(k)),
c AS (SELECT doc_id, item_id, size, count(*) OVER (PARTITION BY doc_id, item_id, b ORDER BY ipos RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS n FROM h)
SELECT doc_id, item_id, max(n) AS terms FROM c WHERE size >= 6 AND n >= ceil(least(size, 13) * 10 / 13.0 - 1e-9) GROUP BY ALL""",
        "p9_found": f"""WITH {same} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM t a JOIN t b ON a.k = b.k AND a.doc_id < b.doc_id AND a.text <> b.text
WHERE regexp_matches(a.k, '\\S')""",
        "p9_classes": f"""WITH {same}, c AS (SELECT k, min(doc_id) AS class_id FROM t WHERE regexp_matches(k, '\\S') GROUP BY k HAVING count(DISTINCT text) > 1)
SELECT DISTINCT doc_id, class_id FROM t JOIN c USING (k)""",
    }
