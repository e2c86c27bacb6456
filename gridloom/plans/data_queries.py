"""Queries of the data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import near_regions, nested, packed, references, units
from ..runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.packed_rows(table(spark, d, "edges"), table(spark, d, "osm_lines"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(table(spark, d, "edges"), table(spark, d, "source_notes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_children(table(spark, d, "raw_elements"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_regions.line_regions(table(spark, d, "edges"), table(spark, d, "zones"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    elements = table(spark, d, "osm_elements")
    refs = references.element_references(elements).unionByName(references.network_references(table(spark, d, "network")))
    ways = table(spark, d, "backbone_ways").select(F.lit("way").alias("type"), F.col("osm_id").alias("id"))
    return refs, references.element_states(elements), ways


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*_references(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(p6_found(spark, d))


def p6_current(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are referred to and do not exist now."""
    _, _, ways = _references(spark, d)
    given = ways.select("type", "id", F.lit(0).cast("bigint").alias("refs"), F.lit(1).cast("bigint").alias("existence"))
    elements = references.latest_records(table(spark, d, "osm_elements"))
    changes = references.change_deltas(references.newer_records(elements, spark.createDataFrame([], references.LATEST)))
    links = references.reference_deltas(references.network_references(table(spark, d, "network")))
    return references.orphans(references.add_deltas(changes, links, given))


_REFS = """
el AS (SELECT * FROM osm_elements),
refs AS (
  SELECT DISTINCT 'osm_elements.nodes' src, rec_id, 'node' ty, n AS id, ts AS tt FROM (SELECT rec_id, ts, unnest(nodes) n FROM el) WHERE n IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'osm_elements.members', rec_id, m.type, m.ref, ts FROM (SELECT rec_id, ts, unnest(members) m FROM el) WHERE m.ref IS NOT NULL
  UNION ALL
  SELECT 'network.attributeOrigId', rec_id, 'way', TRY_CAST(regexp_extract(attributeOrigId, '([0-9]+)', 1) AS BIGINT), loaded_at AS tt
  FROM network WHERE regexp_matches(attributeOrigId, '[0-9]')
),
st AS (SELECT type ty, id, ts AS tt, arg_max(CASE WHEN coalesce(visible, true) THEN 1 ELSE 0 END, coalesce(version, -1) * 1e12 + rec_id) AS state FROM el GROUP BY ALL),
fir AS (SELECT ty, id, min(tt) f FROM st GROUP BY ALL),
orphan AS (
  SELECT r.*, CASE WHEN f IS NULL THEN 'missing' WHEN f > r.tt THEN 'late' WHEN s.state = 0 THEN 'deleted' END AS status
  FROM refs r LEFT JOIN fir USING (ty, id)
  ASOF LEFT JOIN st s ON r.ty = s.ty AND r.id = s.id AND r.tt >= s.tt
  WHERE NOT (r.ty = 'way' AND r.id IN (SELECT osm_id FROM backbone_ways))
)
"""
_FOUND = (
    "SELECT DISTINCT src, rec_id, ty AS ref_type, id AS ref, status, strftime(tt AT TIME ZONE 'UTC', '%Y-%m') AS period "
    "FROM orphan WHERE status IS NOT NULL"
)

QUERIES = {f.__name__: f for f in (p1_found, p2_found, p4_found, p5_found, p6_found, p6_report, p6_current)}
_PACKED = """
v AS (
  SELECT rec_id, 'edges.osmid' AS field, list_transform(regexp_extract_all(osmid, '[0-9]+(?:\\.[0-9]+)?'), lambda x: {'tag': '', 'item': split_part(x, '.', 1)}) AS vs FROM edges
  UNION ALL
  SELECT rec_id, 'edges.highway', list_filter(list_transform(regexp_extract_all(highway, '"(?:[^"]|"")*"|''[^'']*''|[^;,|/&"\\[\\]{}]+'),
    lambda x: {'tag': '', 'item': replace(regexp_replace(trim(x), '^["''](.*)["'']$', '\\1'), '""', '"')}), lambda x: x.item <> '') FROM edges
  UNION ALL
  SELECT rec_id, 'osm_lines.other_tags', list_transform(CASE
    WHEN contains(other_tags, '"') THEN list_transform(regexp_extract_all(other_tags, '"(?:[^"\\\\]|\\\\.)*"\\s*(?:=>|:)\\s*"(?:[^"\\\\]|\\\\.)*"'),
      lambda x: [regexp_extract(x, '^"((?:[^"\\\\]|\\\\.)*)"', 1), regexp_extract(x, '(?:=>|:)\\s*"((?:[^"\\\\]|\\\\.)*)"$', 1)])
    WHEN contains(other_tags, chr(39)) THEN list_transform(regexp_extract_all(other_tags, '[^'',]+''=>''[^'']*'), lambda x: string_split(x, chr(39) || '=>' || chr(39)))
    ELSE list_transform(list_filter(string_split_regex(other_tags, ', |;| \\| |\n'), lambda x: x <> ''), lambda x: string_split_regex(x, '=>?')) END,
    lambda x: {'tag': trim(x[1]), 'item': replace(trim(x[2]), '\\"', '"')}) FROM osm_lines
),
w AS (SELECT rec_id, field, vs, unnest(range(len(vs))) AS pos FROM v WHERE len(vs) > 1)
SELECT rec_id, field, pos, vs[pos + 1].tag AS tag, vs[pos + 1].item AS item FROM w"""
_UNITS = """
n AS (SELECT source, field, lower(note) AS note FROM source_notes),
ns AS (SELECT source, CASE WHEN note LIKE '%metres per second%' THEN 3.6 WHEN regexp_matches(note, 'mile|mph') THEN 1.609344 WHEN regexp_matches(note, 'kilomet|km') THEN 1.0 END
 * CASE WHEN note LIKE '%tenth%' THEN 0.1 ELSE 1.0 END AS f FROM n WHERE field = 'maxspeed'),
nl AS (SELECT source, CASE WHEN note LIKE '%width%' THEN 1.0 / CAST(regexp_extract(note, 'being ([0-9]+) feet', 1) AS DOUBLE) WHEN note LIKE '%tenth%' THEN 0.1
 WHEN note LIKE '%of one direction%' THEN 2.0 ELSE 1.0 END AS f, note LIKE '%width%' AS wide FROM n WHERE field = 'lanes'),
words AS (SELECT * FROM (VALUES ('one', 1), ('two', 2), ('three', 3), ('four', 4), ('five', 5), ('six', 6), ('fifteen', 15), ('twenty', 20), ('twenty-five', 25), ('thirty', 30),
 ('thirty-five', 35), ('forty', 40), ('forty-five', 45), ('fifty', 50), ('fifty-five', 55), ('sixty', 60), ('sixty-five', 65), ('seventy', 70), ('i', 1), ('ii', 2), ('iii', 3), ('iv', 4), ('v', 5), ('vi', 6)) AS v(word, val)),
c AS (SELECT rec_id, source, 'maxspeed' AS field, maxspeed AS raw FROM edges UNION ALL SELECT rec_id, source, 'lanes', lanes FROM edges),
t AS (SELECT *, regexp_replace(lower(trim(translate(raw, '０１２３４５６７８９．', '0123456789.'))), '([0-9]),([0-9])', '\\1.\\2', 'g') AS s FROM c WHERE raw IS NOT NULL),
x AS (SELECT t.*, coalesce(TRY_CAST(nullif(regexp_extract(s, '[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE), val) AS v,
 list_sum(list_transform(regexp_extract_all(s, '[0-9]+'), lambda e: CAST(e AS BIGINT))) AS total
 FROM t LEFT JOIN words ON word = regexp_extract(s, '^([a-z]+(-[a-z]+)?)', 1) WHERE NOT regexp_matches(s, '^-|^999+$')),
m AS (SELECT rec_id, field, v * CASE WHEN regexp_matches(s, 'km/min') THEN 60.0 WHEN regexp_matches(s, 'km|kph|kilomet') THEN 1.0 WHEN regexp_matches(s, 'ft/s|fps|feet per') THEN 0.3048 * 3.6
 WHEN regexp_matches(s, 'm/s|metres/s') THEN 3.6 WHEN regexp_matches(s, 'mph|m\\.p\\.h|mi/h|miles') THEN 1.609344 WHEN regexp_matches(s, 'k(n|t)') THEN 1.852 ELSE f END AS q
 FROM x LEFT JOIN ns USING (source) WHERE field = 'maxspeed'),
l AS (SELECT rec_id, field, CASE WHEN regexp_matches(s, '[0-9] ?(ft|feet|'')') THEN CASE WHEN wide THEN v * f END WHEN regexp_matches(s, '[0-9] ?m$') THEN CASE WHEN wide THEN v / 0.3048 * f END
 WHEN regexp_matches(s, '\\+|forward|nb') THEN total WHEN regexp_matches(s, 'per direction|each way') THEN 2 * v WHEN regexp_matches(s, 'lane') THEN v ELSE v * f END AS q
 FROM x LEFT JOIN nl USING (source) WHERE field = 'lanes')
SELECT rec_id, field, CAST(floor(q + 0.5) AS BIGINT) AS quantity FROM (FROM m UNION ALL FROM l) WHERE floor(q + 0.5) > 0"""
_ITEMS = lambda j: f"CASE WHEN json_type({j}) = 'ARRAY' THEN json_extract({j}, '$[*]') WHEN json_type({j}) IS NULL OR json_type({j}) = 'NULL' THEN [] ELSE [{j}] END"
_NAMED = lambda j: f"coalesce({j}->>'$.id', {j}->>'$.ref')"
_NESTED = f"""WITH RECURSIVE src AS (SELECT rec_id, ltrim(payload, chr(65279)) AS t FROM raw_elements),
r(rec_id, kind, el, j) AS (
  SELECT rec_id, NULL::VARCHAR, false, CAST(t AS JSON) FROM src WHERE json_valid(t)
  UNION ALL
  SELECT rec_id, x.kind, x.kind IS NOT NULL OR (json_type(x.j) = 'OBJECT' AND x.j->>'$.type' IN ('node', 'way', 'relation') AND {_NAMED('x.j')} IS NOT NULL), x.j
  FROM (
    SELECT rec_id, kind, unnest(json_extract(j, '$[*]')) AS j FROM r WHERE NOT el AND json_type(j) = 'ARRAY'
    UNION ALL
    SELECT rec_id, e.key, unnest({_ITEMS('e.value')}) FROM r, json_each(r.j) e WHERE NOT r.el AND json_type(r.j) = 'OBJECT' AND e.key IN ('node', 'way', 'relation')
    UNION ALL
    SELECT rec_id, NULL, e.value FROM r, json_each(r.j) e WHERE NOT r.el AND json_type(r.j) = 'OBJECT' AND e.key NOT IN ('node', 'way', 'relation') AND json_type(e.value) IN ('ARRAY', 'OBJECT')
    UNION ALL
    SELECT rec_id, coalesce(m->>'$.type', ''), m FROM (SELECT rec_id, unnest({_ITEMS("json_extract(j, '$.members')")}) AS m FROM r WHERE el)
  ) x WHERE json_type(x.j) IN ('ARRAY', 'OBJECT')
),
p AS (SELECT rec_id, coalesce(j->>'$.type', kind) AS parent_type, TRY_CAST({_NAMED('j')} AS BIGINT) AS parent_id, j FROM r WHERE el),
q AS (SELECT * FROM p WHERE parent_type <> '' AND parent_id IS NOT NULL),
t AS (
  SELECT rec_id, parent_type, parent_id, e.key AS k, e.value AS v FROM q, json_each(json_extract(q.j, '$.tags')) e WHERE json_type(q.j, '$.tags') = 'OBJECT' AND list_sort(json_keys(q.j, '$.tags')) <> ['k', 'v']
  UNION ALL
  SELECT rec_id, parent_type, parent_id, x->>'$.k', json_extract(x, '$.v') FROM (SELECT *, unnest({_ITEMS("json_extract(j, '$.tags')")}) AS x FROM q WHERE json_type(j, '$.tags') = 'ARRAY' OR list_sort(json_keys(j, '$.tags')) = ['k', 'v'])
),
n AS (SELECT *, unnest(range(len(xs))) AS i FROM (SELECT *, {_ITEMS("json_extract(j, '$.nodes')")} AS xs FROM q)),
m AS (SELECT *, unnest(range(len(xs))) AS i FROM (SELECT *, {_ITEMS("json_extract(j, '$.members')")} AS xs FROM q))
SELECT DISTINCT rec_id, parent_type, parent_id, 'tag' AS kind, 0 AS pos, k AS name, v->>'$' AS item FROM t WHERE k IS NOT NULL AND json_type(v) NOT IN ('NULL', 'ARRAY', 'OBJECT')
UNION ALL
SELECT DISTINCT rec_id, parent_type, parent_id, 'node', i, '', CASE WHEN json_type(xs[i + 1]) = 'OBJECT' THEN coalesce(xs[i + 1]->>'$.ref', xs[i + 1]->>'$.id') ELSE xs[i + 1]->>'$' END AS item FROM n WHERE item IS NOT NULL
UNION ALL
SELECT DISTINCT rec_id, parent_type, parent_id, 'member', i, coalesce(xs[i + 1]->>'$.role', ''), (xs[i + 1]->>'$.type') || '/' || coalesce(xs[i + 1]->>'$.ref', xs[i + 1]->>'$.id') AS item FROM m WHERE item IS NOT NULL"""
SQL = {
    "p4_found": _NESTED,
    "p1_found": f"WITH {_PACKED}",
    "p2_found": f"WITH {_UNITS}",
    "p6_found": f"WITH {_REFS} {_FOUND}",
    "p6_report": f"""WITH {_REFS}, found AS ({_FOUND})
SELECT src, period, status, count(*) AS n_references, count(DISTINCT (ref_type, ref)) AS n_keys FROM found GROUP BY ALL""",
    "p6_current": f"""WITH {_REFS},
lat AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY type, id ORDER BY ts DESC, coalesce(version, -1) DESC, rec_id DESC) = 1),
now AS (SELECT rec_id, 'node' ty, unnest(nodes) id FROM lat UNION SELECT rec_id, m.type, m.ref FROM (SELECT rec_id, unnest(members) m FROM lat)
 UNION ALL SELECT rec_id, ty, id FROM refs WHERE src = 'network.attributeOrigId'),
n AS (SELECT ty, id, count(*) refs FROM now WHERE id IS NOT NULL GROUP BY ALL),
e AS (SELECT type AS ty, id, CASE WHEN coalesce(visible, true) THEN 1 ELSE 0 END AS ex FROM lat)
SELECT n.ty AS type, n.id, n.refs FROM n LEFT JOIN e USING (ty, id)
WHERE coalesce(ex, 0) = 0 AND NOT (n.ty = 'way' AND n.id IN (SELECT osm_id FROM backbone_ways))""",
}
