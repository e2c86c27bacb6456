"""Dealt operators of the core: brute force, edge cases, empty tables."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions.planar import BoxTree, boxes_of, points_in_triangles, polygon_area, signed_area, triangulate
from gridloom.functions.wkb import dumps, from_line, from_rings
from gridloom.operators import near_regions, nested, packed, references, units


def values(spark, cells, kind):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "rec_id bigint, cell string")
    got = {i: [] for i in range(len(cells))}
    for r in packed.unpack(df, {"cell": ("f", kind)}, least=1).orderBy("rec_id", "pos").collect():
        assert r.pos == len(got[r.rec_id])
        got[r.rec_id].append((r.tag, r["item"]) if kind == "tags" else r["item"])
    return [got[i] for i in range(len(cells))]


def test_packed_ids(spark):
    cells = ["1;2", "[1.0, 2.0]", "['1', '2']", '["1", "2", "2"]', '"1" "2"', "{1,2}", "1_2_1", "1 / 2", "1; 2|3", "1;2;", " 7 ", "7.0", "", None, "nan", ";;"]
    want = [["1", "2"]] * 3 + [["1", "2", "2"]] + [["1", "2"]] * 2 + [["1", "2", "1"], ["1", "2"], ["1", "2", "3"], ["1", "2"], ["7"], ["7"], [], [], [], []]
    assert values(spark, cells, "ids") == want


def test_packed_lists(spark):
    cells = [
        'residential;"ramp ""B"", steep"', '"service, gated","path & steps"', "'residential', 'primary';service", "living_street|trunk", ";a; b;;c",
        "it's;b", '"busway|shared" | "a"', '"open;a', "a & b", '"";a', None, "   ",
    ]
    want = [
        ["residential", 'ramp "B", steep'], ["service, gated", "path & steps"], ["residential", "primary", "service"], ["living_street", "trunk"], ["a", "b", "c"],
        ["it's", "b"], ["busway|shared", "a"], ["open;a"], ["a", "b"], ["a"], [], [],
    ]
    assert values(spark, cells, "list") == want


def test_packed_tags(spark):
    cells = [
        '"a"=>"1","b"=>"x, y"', '"a" => "1", "note"=>"signed \\"Slow\\""', '{"a": "1", "b": "2:3"}', "a=>1, b=>K 9", "a=1;b=2", "a=1 | b=2", "a=1\nb=2",
        "'a'=>'1','b'=>'2'", '"note"=>"a=>b means one way","c"=>"a=b"', "d=Fallow;Inlet;lit=yes", '"a"=>""', "junk", None, "",
    ]
    want = [
        [("a", "1"), ("b", "x, y")], [("a", "1"), ("note", 'signed "Slow"')], [("a", "1"), ("b", "2:3")], [("a", "1"), ("b", "K 9")],
        *[[("a", "1"), ("b", "2")]] * 4, [("note", "a=>b means one way"), ("c", "a=b")], [("d", "Fallow;Inlet"), ("lit", "yes")], [], [], [], [],
    ]
    assert values(spark, cells, "tags") == want


def test_packed_only_cells_with_two_and_long_cells(spark):
    long = ";".join(str(i) for i in range(20_000))
    df = spark.createDataFrame([(1, "5", "a", "z"), (2, long, None, "z"), (2, long, None, "z"), (None, "1;2", "b", "z")], "rec_id bigint, osmid string, highway string, pos string")
    out = packed.unpack(df, {"osmid": ("o", "ids"), "highway": ("h", "list")})
    n = {r.rec_id: r["count"] for r in out.groupBy("rec_id").count().collect()}
    assert n == {2: 40_000, None: 2}
    assert packed.unpack(df.limit(0), {"osmid": ("o", "ids")}).count() == 0
    with pytest.raises(ValueError):
        packed.packed_values(F.col("x"), "other")


NOTES = [
    ("a", "maxspeed", "A speed without a unit is in kilometres per hour."), ("b", "maxspeed", "Plain speeds were keyed in as tenths of a mile per hour."),
    ("c", "maxspeed", "Plain speeds come from the probe feed in metres per second."), ("a", "lanes", "Counts all lanes of the road, both directions together."),
    ("b", "lanes", "A plain figure counts the lanes of one direction; the other direction has as many."),
    ("c", "lanes", "The column holds the width of the carriageway, one lane being 12 feet; a plain figure is in feet."), ("d", "lanes", "Plain figures are tenths of a lane."),
]


def quantities(spark, rows, field):
    n = spark.createDataFrame(NOTES, "source string, field string, note string")
    other = "lanes" if field == "maxspeed" else "maxspeed"
    df = spark.createDataFrame([(i, s, c, None) for i, (s, c) in enumerate(rows)], f"rec_id bigint, source string, {field} string, {other} string")
    got = {r.rec_id: r.quantity for r in units.common_units(df, n).collect()}
    return [got.get(i) for i in range(len(rows))]


def test_speeds(spark):
    rows = {
        ("a", "50"): 50, ("b", "250"): 40, ("c", "13.9"): 50, ("a", "30 mph"): 48, ("b", "29,8 km/h"): 30, ("a", "0.52 km/min"): 31, ("a", "MPH: 35"): 56,
        ("c", "limit 30 mi/h, signed"): 48, ("a", "44 ft/s"): 48, ("a", "27 kn"): 50, ("a", "27 kt"): 50, ("a", "14.0 m/sec"): 50, ("a", "thirty-five miles an hour"): 56,
        ("a", "one hundred twenty km/h"): 120, ("a", "３０"): 30, ("c", "１３.９"): 50, ("a", "25 m.p.h."): 40, ("a", "walk"): None, ("a", "999"): None, ("b", "9999"): None,
        ("a", "0"): None, ("a", "-1"): None, ("a", ""): None, ("a", None): None, ("zz", "50"): None, (None, "50"): None, ("zz", "50 km/h"): 50, ("a", "XX:urban"): None,
        ("a", "5" * 5000): None,
    }
    got = quantities(spark, list(rows), "maxspeed")
    assert got[:-1] == list(rows.values())[:-1]


def test_lanes(spark):
    rows = {
        ("a", "2"): 2, ("b", "2.0"): 4, ("c", "24"): 2, ("d", "20"): 2, ("c", "7,3 m"): 2, ("c", "24'"): 2, ("c", "36 feet"): 3, ("b", "2 lanes"): 2, ("a", "1 per direction"): 2,
        ("d", "2 each way"): 4, ("c", "3 forward, 1 back"): 4, ("b", "1+2"): 3, ("a", "NB 2 / SB 1"): 3, ("a", "2 (two)"): 2, ("a", "IV"): 4, ("a", "TWO"): 2, ("d", "two lanes"): 2,
        ("b", "2 lanes in total"): 2, ("a", "varies"): None, ("a", "?"): None, ("a", "n/a"): None, ("a", "-1"): None, ("a", "0"): None, ("a", "24 ft"): None, ("a", "05"): 5,
    }
    assert quantities(spark, list(rows), "lanes") == list(rows.values())


def test_units_with_more_notes_than_are_broadcast(spark, monkeypatch):
    n = spark.createDataFrame(NOTES, "source string, field string, note string")
    df = spark.createDataFrame([(i, s, "50", c) for i, (s, c) in enumerate([("a", "2"), ("c", "24"), ("c", "7.3 m"), ("b", "2.0"), ("z", "24 ft"), (None, "2")])], "rec_id bigint, source string, maxspeed string, lanes string")
    want = sorted(map(tuple, units.common_units(df, n).collect()))
    monkeypatch.setattr(units, "small_side", lambda x: x)
    assert want and sorted(map(tuple, units.common_units(df, n).collect())) == want


def test_unit_graph_checks_cycles():
    g = units.UnitGraph([("c", "k", 1.0, 273.15), ("f", "c", 5 / 9, -160 / 9), ("f", "k", 5 / 9, 273.15 - 160 / 9)])
    f = g.to("k")["f"]
    assert f.a * 212 + f.b == pytest.approx(373.15)
    with pytest.raises(ValueError, match="disagree"):
        units.UnitGraph([("a", "b", 2.0, 0.0), ("b", "c", 2.0, 0.0), ("a", "c", 5.0, 0.0)]).to("c")
    with pytest.raises(ValueError):
        units.UnitGraph([("a", "b", 0.0, 1.0)])


def test_units_repeats_and_empty(spark):
    n = spark.createDataFrame(NOTES, "source string, field string, note string")
    df = spark.createDataFrame([(1, "a", "50", "2", 9.0), (1, "a", "50", "2", 9.0)], "rec_id bigint, source string, maxspeed string, lanes string, quantity double")
    assert units.common_units(df, n).count() == 4
    assert units.common_units(df.limit(0), n).count() == 0
    assert units.common_units(df, n.limit(0)).count() == 0


# -- nested -------------------------------------------------------------------


def by_path(cols):
    tables, made = nested.by_ancestor(cols)
    return {s.path if s else (): {made.ordinals(i): leaves for i, leaves in rows.items()} for s, rows in tables.items()}


def test_levels_and_reconstruction():
    record = [{"id": "1", "tags": [{"k": "a"}, {"k": "b"}]}, {"id": "2"}, {"id": "3", "tags": [{"k": "c"}]}]
    cols = nested.shred(record)
    path = ("[]", "tags", "[]", "k")
    assert [(r, v) for r, _, v in {s.path: c for s, c in cols.items()}[path]] == [(0, "a"), (2, "b"), (1, None), (1, "c")]
    tables = by_path(cols)
    assert tables[("[]",)] == {(0,): {("id",): "1"}, (1,): {("id",): "2"}, (2,): {("id",): "3"}}
    assert tables[("[]", "tags", "[]")] == {(0, 0): {("k",): "a"}, (0, 1): {("k",): "b"}, (2, 0): {("k",): "c"}}


TREE = st.recursive(
    st.none() | st.text("ab", max_size=2),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("xyz"), x, max_size=3),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(st.lists(TREE, max_size=4))
def test_every_leaf_keeps_its_place(tree):
    want = {}

    def walk(node, path, at):
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, (*path, k), at)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                walk(v, (*path, "[]"), (*at, i))
        elif node is not None:
            want[(path, at)] = node

    walk(tree, (), ())
    got = {}
    for anc, rows in by_path(nested.shred(tree)).items():
        for at, leaves in rows.items():
            for rest, v in leaves.items():
                got[((*anc, *rest), at)] = v
    assert got == want


def test_payload_shapes(spark):
    way = {"type": "way", "id": 5, "tags": {"k": "a", "v": "b"}, "nodes": [7, {"ref": "8"}, 7]}
    rel = {"type": "relation", "id": 6, "tags": [{"k": "n", "v": 1.50}], "members": [{"type": "way", "ref": 5, "role": None, "nodes": 9}, {"type": "node", "ref": 7, "role": "stop"}]}
    payloads = [
        json.dumps([way]), json.dumps({"osm": {"way": {k: v for k, v in way.items() if k != "type"}}}), "﻿" + json.dumps({"elements": [rel]}),
        json.dumps([way])[:-5], "", None, "null", "[]", "{}", json.dumps({"a": {"elements": [way]}}), "[" * 5000 + "]" * 5000, '"text"',
    ]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "rec_id bigint, payload string, kind string")
    out = {}
    for r in nested.flat_children(df).collect():
        out.setdefault(r.rec_id, []).append(tuple(r)[1:])
    w = {("way", 5, "tag", 0, "a", "b"), ("way", 5, "node", 0, "", "7"), ("way", 5, "node", 1, "", "8"), ("way", 5, "node", 2, "", "7")}
    assert set(out[0]) == set(out[1]) == set(out[9]) == w and len(out[0]) == 4
    assert set(out[2]) == {
        ("relation", 6, "tag", 0, "n", "1.5"), ("relation", 6, "member", 0, "", "way/5"), ("relation", 6, "member", 1, "stop", "node/7"), ("way", 5, "node", 0, "", "9"),
    }
    assert set(out) == {0, 1, 2, 9}
    assert nested.element_children('[{"type":"node","id":1,"tags":{"a":1.0,"b":true,"c":null,"d":1e3}}]') == [
        ("node", 1, "tag", 0, "a", "1.0"), ("node", 1, "tag", 0, "b", "true"), ("node", 1, "tag", 0, "d", "1e3"),
    ]
    assert nested.flat_children(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [3, 520, 1200])
def test_members_of_any_depth(depth):
    inner = '{"type":"node","id":0}'
    for i in range(1, depth):
        inner = f'{{"type":"relation","id":{i},"tags":{{"n":"{i}"}},"members":[{{"type":"node","ref":7}},{inner}]}}'
    rows = set(nested.element_children(f"[{inner}]"))
    want = {("relation", i, "tag", 0, "n", str(i)) for i in range(1, depth)} | {("relation", i, "member", 0, "", "node/7") for i in range(1, depth)}
    want |= {("relation", i, "member", 1, "", f"{'relation' if i > 1 else 'node'}/{i - 1}") for i in range(1, depth)}
    assert rows == want


@settings(max_examples=200, deadline=None)
@given(TREE | st.dictionaries(st.text(max_size=3), st.integers() | st.floats(allow_nan=False) | st.booleans() | TREE, max_size=3))
def test_deep_reader_reads_as_the_library_does(tree):
    text = json.dumps(tree, indent=1)
    assert nested._read_deep(text) == nested.read_json(text)
    for broken in (text[:-1], text + "]", text.replace(":", "", 1), "[1,]", "{a:1}", "[01]", ""):
        try:
            want = json.loads(broken, parse_int=nested._Text, parse_float=nested._Text)
        except ValueError:
            with pytest.raises((ValueError, LookupError)):
                nested._read_deep(broken)
        else:
            assert nested._read_deep(broken) == want


def test_ids_beyond_64_bits_lose_only_their_own_rows(spark):
    p = json.dumps([{"type": "way", "id": 10**30, "nodes": [1]}, {"type": "way", "id": 4, "nodes": [10**30]}])
    df = spark.createDataFrame([(1, p), (2, '[{"type":"way","id":5,"nodes":[1]}]')], "rec_id bigint, payload string")
    assert {(r.rec_id, r.parent_id, r["item"]) for r in nested.flat_children(df).collect()} == {(1, 4, str(10**30)), (2, 5, "1")}


# -- references ---------------------------------------------------------------


def _elements(spark, rows):
    schema = "rec_id bigint, type string, id bigint, version int, ts timestamp, visible boolean, nodes array<bigint>, members array<struct<type:string,ref:bigint,role:string>>, status string"
    return spark.createDataFrame([(*r, "x") for r in rows], schema).withColumn("ts", F.col("ts"))


def _brute(states, refs):
    out = set()
    for src, rec, kind, ref, at in refs:
        own = sorted((t, v, r, vis) for (k, i, t, v, r, vis) in states if (k, i) == (kind, ref))
        if not own:
            out.add((src, rec, kind, ref, "missing"))
        elif own[0][0] > at:
            out.add((src, rec, kind, ref, "late"))
        elif not [x for x in own if x[0] <= at][-1][3]:
            out.add((src, rec, kind, ref, "deleted"))
    return out


def test_orphans_against_brute_force(spark, monkeypatch):
    import datetime as dt
    import random

    rnd = random.Random(3)
    day = lambda n: dt.datetime(2031, 1, 1) + dt.timedelta(days=n)
    rows, states, refs = [], [], []
    for i in range(400):
        kind, ident, at = rnd.choice(["node", "way"]), rnd.choice([1, 1, 1, 2, 3, 4, 5, None]), day(rnd.randrange(90))
        vis, nodes = rnd.choice([None, True, False]), [rnd.choice([1, 2, 7, None, 1]) for _ in range(3)] if kind == "way" else None
        members = [("way", rnd.choice([1, 3, 9]), None)] if i % 7 == 0 else None
        rows.append((i, kind, ident, i, at, vis, nodes, members))
        if ident is not None:
            states.append((kind, ident, at, i, i, vis is not False))
        refs += [("osm_elements.nodes", i, "node", n, at) for n in nodes or [] if n is not None]
        refs += [("osm_elements.members", i, "way", m[1], at) for m in members or []]
    el = _elements(spark, rows)
    el = el.unionByName(el.limit(20))
    want = _brute(states, refs)
    for least, share in ((50_000, 1000), (10, 5)):  # without and with hot keys cut into ranges
        monkeypatch.setattr(references, "HOT_LEAST", least)
        monkeypatch.setattr(references, "HOT_SHARE", share)
        found = references.orphan_references(references.element_references(el), references.element_states(el))
        got = [tuple(r)[:5] for r in found.collect()]
        assert set(got) == want and len(got) == len(set(got))
    none = references.orphan_references(references.element_references(el.limit(0)), references.element_states(el))
    assert none.count() == 0


def test_reference_texts_and_always(spark):
    import datetime as dt

    at = dt.datetime(2031, 5, 1)
    texts = ["w12", "way/12", " 12 ", "12.0", "12", "nan", "", None, "n/a"]
    net = spark.createDataFrame([(i, t, at) for i, t in enumerate(texts)], "rec_id bigint, attributeOrigId string, loaded_at timestamp")
    refs = references.network_references(net)
    assert [r.id for r in refs.orderBy("rec_id").collect()] == [12] * 5
    el = _elements(spark, []).limit(0)
    st_ = references.element_states(el)
    assert {r.status for r in references.orphan_references(refs, st_).collect()} == {"missing"}
    always = spark.createDataFrame([("way", 12)], "type string, id bigint")
    assert references.orphan_references(refs, st_, always).count() == 0
    rep = references.orphan_report(references.orphan_references(refs, st_)).collect()
    assert [tuple(r) for r in rep] == [("network.attributeOrigId", "2031-05", "missing", 5, 1)]


def test_batches_of_changes_equal_one(spark):
    """Create, update and delete one by one leave no existence, in any order."""
    import datetime as dt

    day = lambda n: dt.datetime(2031, 1, n)
    rows = [(1, "way", 1, 1, day(1), None, [4], None), (2, "way", 1, 2, day(2), True, [4, 5], None), (3, "way", 1, 3, day(3), False, None, None), (4, "relation", 2, 1, day(1), None, None, [("way", 1, "")])]
    none = spark.createDataFrame([], references.LATEST)
    for order in ((0, 1, 2, 3), (2, 1, 0, 3), (3, 2, 0, 1), (1, 3, 2, 0)):
        known, counts = none, spark.createDataFrame([], references.COUNTS)
        for k in order[:3]:
            newer = references.newer_records(references.latest_records(_elements(spark, [rows[k]])), known)
            counts, known = references.add_deltas(counts, references.change_deltas(newer)), references.latest_of(newer, known)
        rest = references.change_deltas(references.newer_records(references.latest_records(_elements(spark, [rows[order[3]]])), known))
        assert {tuple(r) for r in references.add_deltas(counts, rest).collect()} == {("way", 1, 1, 0), ("relation", 2, 0, 1)}


def test_counts_add_up(spark):
    c = lambda rows: spark.createDataFrame(rows, "type string, id bigint, refs bigint, existence bigint")
    old = c([("way", 1, 2, 1), ("way", 2, 1, 0), ("node", 3, 0, 1)])
    new = references.add_deltas(old, c([("way", 1, 0, -1), ("way", 2, -1, 0), ("node", 3, 1, 0)]))
    assert sorted(map(tuple, new.collect())) == [("node", 3, 1, 1), ("way", 1, 2, 0)]
    assert [tuple(r) for r in references.orphans(new).collect()] == [("way", 1, 2)]


# -- regions ----------------------------------------------------------------------


def _star(seed, n=12, hole=True):
    rnd = np.random.default_rng(seed)
    a = (np.arange(n) + rnd.uniform(0.1, 0.9, n)) * (2 * np.pi / n)
    r = rnd.uniform(5, 10, n)
    shell = np.stack([r * np.cos(a), r * np.sin(a)], axis=1)
    rings = [np.vstack([shell, shell[:1]])]
    if hole:
        h = np.array([[1, 0.5], [-1, 0.5], [0, -1], [1, 0.5]]) * 0.8
        rings.append(h)
    return rings


@pytest.mark.parametrize("seed", range(25))
def test_triangles_cover_the_polygon(seed):
    rings = _star(seed)
    if seed % 2:
        rings = [r[::-1] for r in rings]
    t = triangulate(rings)
    assert sum(signed_area(x) for x in t) == pytest.approx(polygon_area(rings))
    assert all(signed_area(x) > 0 for x in t)


def test_triangulate_odd_rings():
    sq = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], "f8")
    assert len(triangulate([np.empty((0, 2))])) == 0 and len(triangulate([])) == 0
    assert len(triangulate([np.array([[0, 0], [1, 1], [2, 2], [0, 0]], "f8")])) == 0
    spread = np.insert(sq, [1, 1, 2], [[1, 0], [1, 0], [2, 1]], axis=0)
    assert sum(signed_area(x) for x in triangulate([spread])) == pytest.approx(4)
    two = [sq * 5, np.array([[1, 1], [2, 1], [2, 2], [1, 1]], "f8"), np.array([[5, 5], [6, 5], [6, 6], [5, 6], [5, 5]], "f8")]
    assert sum(signed_area(x) for x in triangulate(two)) == pytest.approx(100 - 0.5 - 1)


def test_holes_that_touch():
    """Areas of valid polygons whose holes touch the shell or each other."""
    sq = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]], "f8")
    side = np.array([[0, 5], [4, 3], [4, 7], [0, 5]], "f8")
    corner = np.array([[0, 0], [3, 1], [1, 3], [0, 0]], "f8")
    pair = [np.array([[2, 2], [5, 5], [5, 3], [2, 2]], "f8"), np.array([[5, 5], [8, 8], [8, 6], [5, 5]], "f8")]
    chain = [np.array([[x, 5], [x + 1, 4], [x + 2, 5], [x + 1, 6], [x, 5]], "f8") for x in (0, 2, 4, 6, 8)]  # parts the square
    for holes in ([side], [corner], pair, [corner, *pair], chain, [sq(0, 2, 2)], [sq(2, 2, 2), sq(4, 2, 2)]):
        for flip in (False, True):
            rings = [sq(0, 0, 10), *(h[::-1] if flip else h for h in holes)]
            t = triangulate(rings)
            assert sum(signed_area(x) for x in t) == pytest.approx(polygon_area(rings)), holes
            middle = np.array([h[:-1].mean(axis=0) for h in holes])
            assert all(points_in_triangles(np.repeat(p[None], len(t), 0), t).max() < 2 for p in middle)


def test_long_rings_take_little_time():
    import time

    rnd, n = np.random.default_rng(4), 20_000
    r = 100 + np.cumsum(rnd.normal(0, 0.02, n))
    r += (r[0] - r[-1]) * np.linspace(0, 1, n)
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    ring = np.stack([r * np.cos(a), r * np.sin(a)], axis=1)
    began = time.time()
    t = triangulate([ring])
    assert sum(signed_area(x) for x in t) == pytest.approx(abs(signed_area(ring))) and time.time() - began < 10


def test_planes_part_crowded_places():
    rnd = np.random.default_rng(2)
    crowd = np.concatenate([rnd.normal(0, 0.001, (5000, 2)), rnd.uniform(-1e6, 1e6, (500, 2)), np.zeros((300, 2))])
    p = near_regions.Planes(crowd, 40)
    size = np.bincount(p.leaf_of(crowd), minlength=p.leaves)
    assert 35 <= p.leaves == len(size) <= 40 and 300 <= size.max() < 450 and size.min() > 0  # the 300 are one place
    assert near_regions.Planes(np.zeros((9, 2)), 5).leaves == 1 and near_regions.Planes(np.empty((0, 2)), 1).leaf_of(crowd).max() == 0


def test_tree_finds_what_meets():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 100, 1000):
        lo = rnd.uniform(0, 100, (n, 2))
        boxes = np.concatenate([lo, lo + rnd.uniform(0, 5, (n, 2))], axis=1)
        q = np.concatenate([lo[:20], lo[:20] + 8], axis=1)
        a, b = BoxTree(boxes).query(q)
        want = {(i, j) for i, x in enumerate(q) for j, y in enumerate(boxes) if (x[:2] <= y[2:]).all() and (y[:2] <= x[2:]).all()}
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def _zone_table(spark, rows):
    return spark.createDataFrame(
        [(i, z, k, g, None, "x") for i, (z, k, g) in enumerate(rows)], "rec_id bigint, zone_id string, zone_kind string, geometry binary, loaded_at timestamp, leaf string"
    )


def test_lines_and_regions(spark, monkeypatch):
    sq = lambda x, y, s=10: [[x, y], [x + s, y], [x + s, y + s], [x, y + s]]
    hole = [[2, 2], [4, 2], [4, 4], [2, 4]]
    zones = _zone_table(
        spark,
        [("A", "taz", from_rings(sq(0, 0), hole)), ("B", "taz", from_rings(sq(10, 0))), ("B", "taz", from_rings(sq(10, 0))), ("C", "district", from_rings(sq(0, 0, 20))),
         ("E", "taz", None), (None, "taz", from_rings(sq(0, 0))), ("F", "taz", b"\x01junk")],
    )
    lines = {
        1: from_line([[1, 1], [9, 1]]), 2: from_line([[3, 3], [3, 3.5]]), 3: from_line([[5, 5], [15, 5]]), 4: from_line([[10, 5], [12, 5]]), 5: from_line([[-20, 5], [-30, 5]]),
        6: from_line([[-200, 5], [300, 5]]), 7: None, 8: b"", 9: dumps(("empty", [])), 10: from_line([[1, 1], [1, 1]]), 11: from_line([[1, 8], [2, 8]], [[100, 8], [101, 8]]),
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None, "q") for k, v in lines.items()], "rec_id bigint, geometry binary, zone_id string")
    want = {
        (1, "A", "inside"), (1, "A", "through"), (1, "C", "inside"), (1, "C", "through"), (1, "B", "near"),
        (2, "A", "near"), (2, "B", "near"), (2, "C", "inside"), (2, "C", "through"),
        (3, "A", "inside"), (3, "A", "through"), (3, "B", "near"), (3, "B", "through"), (3, "C", "inside"), (3, "C", "through"),
        (4, "A", "inside"), (4, "B", "through"), (4, "B", "near"), (4, "C", "inside"), (4, "C", "through"),
        (5, "A", "near"), (5, "B", "near"), (5, "C", "near"),
        (6, "A", "through"), (6, "B", "through"), (6, "C", "through"),
        (10, "A", "inside"), (10, "B", "near"), (10, "C", "inside"),
        (11, "A", "inside"), (11, "A", "through"), (11, "B", "near"), (11, "C", "inside"), (11, "C", "through"),
    }
    got = [tuple(r) for r in near_regions.line_regions(df, zones).collect()]
    assert set(got) == want and len(got) == len(want)
    monkeypatch.setattr(near_regions, "LEAF_TRIANGLES", 3)
    monkeypatch.setattr(near_regions, "LEAF_LINES", 2)
    leaves = [tuple(r) for r in near_regions.line_regions(df, zones, broadcast_triangles=0).collect()]
    assert set(leaves) == want and len(leaves) == len(want)
    assert near_regions.line_regions(df.limit(0), zones).count() == 0
    assert near_regions.line_regions(df, zones.limit(0)).count() == 0
