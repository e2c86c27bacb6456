"""Overlay, tags, aggregates, graphs and reports on small layers with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import aggregates as ag
from gridloom.functions import crs, kernels
from gridloom.functions import tags as tg
from gridloom.functions.wkb import EMPTY_WKB, dumps, from_line, from_rings, loads, to_wkt
from gridloom.functions.planar import signed_area, triangulate
from gridloom.operators import diagnose, graph, masks, overlay
from gridloom.operators.layer import Layer, edge_name, length_column, metric_names, zone_name


def box(x0, y0, x1, y1):
    return bytearray(from_rings([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]))


def lines(spark, rows, cols="osm_id bigint, edge_id bigint, edge_length double"):
    return Layer(spark.createDataFrame([(*r[:-1], bytearray(from_line(*r[-1]))) for r in rows], cols + ", geometry binary"), 3857)


def zones(spark, rows, cols="zone_id string"):
    return Layer(spark.createDataFrame(rows, cols + ", geometry binary"), 3857)


ONE = (1, 10, 10.0, [[[0, 0], [10, 0]]])


def test_half_of_a_line(spark):
    out = overlay.intersect_lines_with_zones(lines(spark, [ONE]), zones(spark, [("z", box(0, -1, 5, 1))]))
    r = out.df.first()
    assert (r.edge_link_length_m, r.zone_link_length_m, r.zone_edge_proportion) == (10.0, 5.0, 0.5)
    assert out.df.columns == ["zone_edge_proportion", "edge_link_length_m", "zone_link_length_m", "geometry", "edge_osm_id", "edge_id", "edge_length", "zone_zone_id"]
    assert to_wkt(loads(r.geometry)) == "LINESTRING (0 0, 5 0)"


def test_touch_is_no_piece_and_border_is(spark):
    z = zones(spark, [("touch", box(10, 0, 11, 1)), ("border", box(2, 0, 8, 4)), ("far", box(100, 100, 101, 101))])
    got = {r.zone_zone_id: r.zone_link_length_m for r in overlay.intersect_lines_with_zones(lines(spark, [ONE]), z).df.collect()}
    assert got == {"border": 6.0}


def test_voids_and_prefilter(spark):
    z = zones(spark, [("hit", box(0, -1, 5, 1)), ("void", box(10, 0, 11, 1)), ("far", box(1000, 0, 1010, 1))])
    assert [r.zone_id for r in overlay.prefilter_to_bounds(z, lines(spark, [ONE])).df.orderBy("zone_id").collect()] == ["hit", "void"]
    got = {r.zone_zone_id: r for r in overlay.intersect_lines_with_zones(lines(spark, [ONE]), z, prefilter=True).df.collect()}
    assert set(got) == {"hit", "void"} and got["void"].zone_edge_proportion is None and bytes(got["void"].geometry) == EMPTY_WKB
    assert overlay.prefilter_to_bounds(z, Layer(lines(spark, [ONE]).df.limit(0), 3857)).df.count() == 0


def test_holes_parts_and_concave_zones(spark):
    hole = bytearray(from_rings([[0, -5], [10, -5], [10, 5], [0, 5]], [[4, -1], [6, -1], [6, 1], [4, 1]]))
    ell = bytearray(from_rings([[0, -1], [10, -1], [10, 3], [7, 3], [7, 1], [3, 1], [3, 3], [0, 3]]))
    two = bytearray(dumps(("polygon", [loads(box(0, -1, 1, 1))[1][0], loads(box(8, -1, 9, 1))[1][0]])))
    rows = [(1, 1, 10.0, [[[0, 0], [10, 0]]]), (2, 2, 10.0, [[[0, 2], [10, 2]]]), (3, 3, 4.0, [[[0, 0], [2, 0]], [[8, 0], [10, 0]]])]
    got = {(r.edge_id, r.zone_zone_id): r.zone_link_length_m for r in overlay.intersect_lines_with_zones(lines(spark, rows), zones(spark, [("hole", hole), ("ell", ell), ("two", two)])).df.collect()}
    assert got == {(1, "hole"): 8.0, (2, "hole"): 10.0, (3, "hole"): 4.0, (1, "ell"): 10.0, (2, "ell"): 6.0, (3, "ell"): 4.0, (1, "two"): 2.0, (3, "two"): 2.0}


def test_geographic_systems_are_refused(spark):
    bad = Layer(lines(spark, [ONE]).df, 4326)
    with pytest.raises(ValueError, match="projected"):
        overlay.intersect_lines_with_zones(bad, zones(spark, [("z", box(0, 0, 1, 1))]))


def test_chained_names_and_labels(spark):
    z1 = Layer(zones(spark, [("z", box(0, -1, 5, 1))], "NAME string").df, 3857)
    first = overlay.intersect_lines_with_zones(lines(spark, [ONE]), z1)
    second = overlay.intersect_lines_with_zones(first, z1)
    assert "zone_NAME" in second.df.columns and "zone2_NAME" in second.df.columns and not [c for c in second.df.columns if c.startswith("edge_edge") or "zone_zone" in c]
    assert second.df.first().edge_link_length_m == 5.0
    cells = zones(spark, [("c", box(0, -1, 2, 1))], "grid_cell_id string")
    lab = overlay.intersect_lines_with_zones(lines(spark, [ONE]), cells, zone_label=" Grid ")
    assert {"grid_cell_id", "grid_zone_edge_proportion", "grid_edge_link_length_m"} <= set(lab.df.columns)
    clash = overlay.intersect_lines_with_zones(lines(spark, [ONE]), zones(spark, [(7, box(0, -1, 2, 1))], "osm_id bigint"))
    assert clash.df.select("edge_osm_id", "zone_osm_id").first() == (1, 7)


def test_names():
    assert edge_name("edge_x") == "edge_x" and edge_name("zone_x") == "zone_x" and edge_name("v") == "edge_v" and edge_name("piece_surface_m2") == "piece_surface_m2"
    assert zone_name("N", {"zone_N", "zone2_N"}) == "zone3_N" and zone_name("a_b", set(), "a") == "a_b" and zone_name("a_b", {"a_b"}, "a") == "a_a_b"
    assert metric_names("line", " X ")["proportion"] == "x_zone_edge_proportion"
    assert length_column(["length", "edge_length"]) == "edge_length" and length_column(["q_zone_piece_length_m"], cascade=True) == "q_zone_piece_length_m"
    for bad in ({"columns": ["x"]}, {"columns": ["x"], "asked": "y"}):
        with pytest.raises(ValueError):
            length_column(**bad)


def test_road_polygons_and_cascade(spark):
    road = Layer(spark.createDataFrame([(1, 10.0, 3.0, box(0, 0, 10, 2))], "edge_id bigint, edge_length double, zone_link_length_m double, geometry binary"), 3857)
    z = zones(spark, [("half", box(0, 0, 5, 2)), ("touch", box(10, 0, 12, 2))])
    r = overlay.intersect_polygons_of_roads_with_zones(Layer(road.df.drop("zone_link_length_m"), 3857), z, prefilter=False).df.collect()
    assert len(r) == 1 and (r[0].zone_edge_proportion, r[0].zone_link_length_m, r[0].edge_surface_m2, r[0].zone_surface_m2) == (0.5, 5.0, 20.0, 10.0)
    c = overlay.cascade_polygons_with_zones(road, z, prefilter=True).df
    got = {x.zone_zone_id: x for x in c.collect()}
    assert (got["half"].zone_piece_proportion, got["half"].zone_piece_length_m, got["half"].edge_length) == (0.5, 1.5, 10.0) and got["touch"].zone_piece_length_m is None


def test_left_join_keeps_all(spark):
    df = spark.createDataFrame([(1, box(1, 1, 2, 2)), (2, box(50, 50, 51, 51)), (3, None), (1, box(1, 1, 2, 2))], "piece_id bigint, geometry binary")
    z = zones(spark, [("a", box(0, 0, 5, 5)), ("b", box(2, 2, 9, 9))])
    got = sorted((r.piece_id, r.zone_zone_id or "") for r in overlay.spatial_left_join(Layer(df, 3857), z).df.collect())
    assert got == [(1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, ""), (3, "")]


def test_zone_overlay(spark):
    a, b = zones(spark, [("a", box(0, 0, 4, 4))], "county_id string"), zones(spark, [("g", box(2, 2, 6, 6))], "grid_id string")
    r = overlay.intersect_zones_with_zones(a, b).df.first()
    assert (r.zone_a_county_id, r.zone_b_grid_id) == ("a", "g") and kernels.area(loads(r.geometry)) == 4.0


def test_polygon_overlap_of_random_shapes():
    rnd = np.random.default_rng(4)
    for _ in range(30):
        p, q = (kernels.hull(rnd.uniform(0, 10, (8, 2))) for _ in range(2))
        g = kernels.polygon_overlap(("polygon", [[np.vstack([p, p[:1]])]]), ("polygon", [[np.vstack([q, q[:1]])]]))
        pts = rnd.uniform(0, 10, (20_000, 2))
        both = kernels.inside_rings(pts, [np.vstack([p, p[:1]])]) & kernels.inside_rings(pts, [np.vstack([q, q[:1]])])
        assert kernels.area(g) == pytest.approx(both.mean() * 100, abs=2.0)


def test_pieces_of_a_tiling_add_up(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, i, 0.0, [rnd.uniform(0, 100, (4, 2)).tolist()]) for i in range(40)]
    tiles = [(f"{i}-{j}", box(i * 20, j * 20, i * 20 + 20, j * 20 + 20)) for i in range(5) for j in range(5)]
    out = overlay.intersect_lines_with_zones(lines(spark, rows), zones(spark, tiles)).df
    for r in out.groupBy("edge_id").agg(F.sum("zone_link_length_m").alias("s"), F.first("edge_link_length_m").alias("l")).collect():
        assert r.s == pytest.approx(r.l, abs=0.2)


def test_systems():
    x, y = crs.transform([-122.0], [37.0], 4326, 26910)
    assert x[0] == pytest.approx(588977.32, abs=1) and y[0] == pytest.approx(4095339.69, abs=1)
    for epsg in (3857, 32610, 32756, 26910):
        lon, lat = (-122.5, 37.5) if epsg != 32756 else (151.2, -33.9)
        back = crs.transform(*crs.transform([lon], [lat], 4326, epsg), epsg, 4326)
        assert back[0][0] == pytest.approx(lon, abs=1e-9) and back[1][0] == pytest.approx(lat, abs=1e-9)
    with pytest.raises(ValueError, match="32048"):
        crs.transform([0], [0], 4326, 32048)


def test_masks(spark):
    apart = zones(spark, [("a", box(0, 0, 1, 1)), ("b", box(3, 0, 4, 1))])
    dry, wet = masks.area_mask(apart).df.first(), masks.area_mask(apart, include_water=True).df.first()
    assert kernels.area(loads(dry.geometry)) == 2.0 and kernels.area(loads(wet.geometry)) == 4.0 and wet.include_water
    wide = masks.area_mask(apart, include_water=True, buffer_m=1.0).df.first()
    assert kernels.area(loads(wide.geometry)) == pytest.approx(4 + 2 * 5 + np.pi, rel=0.01)
    with pytest.raises(ValueError):
        masks.area_mask(apart, buffer_m=-1)
    with pytest.raises(ValueError, match="projected"):
        masks.area_mask(Layer(apart.df, 4326), buffer_m=5)
    assert [r.area_m2 for r in masks.areas(apart).collect()] == [1.0, 1.0]
    near = zones(spark, [("a", box(0, 0, 1000, 1000)), ("b", box(1000, 0, 2000, 1000)), ("c", None)])
    mask = masks.area_mask(near, buffer_m=100.0)
    assert kernels.area(loads(mask.df.first().geometry)) == pytest.approx(2e6 + 2 * 100 * 3000 + np.pi * 1e4, rel=1e-3)
    own = zones(spark, [("z", box(0, 1050, 1000, 2050))])
    piece = overlay.intersect_zones_with_zones(mask, own).df.first().geometry
    assert kernels.area(loads(piece)) == pytest.approx(50 * 1000, rel=0.01)  # no more than the zone's own ground
    assert loads(masks.area_mask(Layer(near.df.limit(0), 3857)).df.first().geometry)[0] == "empty"


def test_dissolve(spark):
    rows = [(k, i, box(x, y, x + 1, y + 1)) for k in "pq" for i, (x, y) in enumerate((x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1))]
    rows += [("r", 1, box(0, 0, 2, 2)), ("r", 2, box(1, 1, 3, 3)), ("r", 2, None), (None, 3, box(5, 5, 6, 6)), ("s", 1, None)]
    df = spark.createDataFrame([(k, i, bytearray(g) if g else None) for k, i, g in rows], "kind string, n bigint, geometry binary").repartition(5)
    got = {r.kind: loads(r.geometry) for r in masks.dissolve(Layer(df, 3857), ["kind"]).df.collect()}
    assert {k: round(kernels.area(g), 6) for k, g in got.items()} == {"p": 8.0, "q": 8.0, "r": 7.0, None: 1.0}
    assert [len(p) for p in got["p"][1]] == [2] and len(got["r"][1][0][0]) == 9
    one = masks.dissolve(Layer(df, 3857)).df.collect()
    assert len(one) == 1 and kernels.area(loads(one[0].geometry)) == pytest.approx(10.0)
    assert masks.dissolve(Layer(df.limit(0), 3857)).df.count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_union_covers_what_its_parts_cover(seed):
    rnd = np.random.default_rng(seed)
    parts = []
    for _ in range(10):
        a = np.sort(rnd.uniform(0, 2 * np.pi, rnd.integers(3, 9)))
        r = np.stack([np.cos(a), np.sin(a)], axis=1) * rnd.uniform(1, 5, (len(a), 1)) + rnd.uniform(0, 15, 2)
        parts.append(("polygon", [[np.vstack([r, r[:1]])]]))
    whole, p = kernels.union(parts), rnd.uniform(-6, 21, (20_000, 2))
    want, got = np.zeros(len(p), bool), np.zeros(len(p), bool)
    for g in parts:
        want |= kernels.inside_rings(p, g[1][0])
    for rings in whole[1]:
        got ^= kernels.inside_rings(p, rings)
    assert (want == got).all() and kernels.area(whole) == pytest.approx(sum(abs(signed_area(t)) for part in whole[1] for t in triangulate(part)))
    x = kernels.representative_point(whole)
    assert any(kernels.inside_rings(np.array([x]), rings)[0] for rings in whole[1])


@pytest.mark.parametrize("far", [False, True])
def test_slanted_lines_holes_and_hollows(spark, far, monkeypatch):
    """General clipping in place and through the grid join, against fine steps."""
    if far:
        monkeypatch.setattr(overlay, "HELD_ZONES", 0)
    rnd = np.random.default_rng(5)
    hollow = from_rings([[0, 0], [10, 0], [10, 10], [5, 3], [0, 10]], [[4, 1], [6, 1], [5, 2]])
    z = zones(spark, [("hollow", hollow), ("slant", from_rings([[3, -2], [14, 4], [9, 12]])), ("none", None), ("far", box(100, 100, 101, 101))])
    paths = {i: rnd.uniform(-3, 15, (rnd.integers(2, 5), 2)) for i in range(40)}
    df = spark.createDataFrame([(i, bytearray(from_line(p))) for i, p in paths.items()] + [(99, None)], "id bigint, geometry binary")
    out = overlay.intersect_lines_with_zones(Layer(df, 3857), z).df
    got = {(r.edge_id, r.zone_zone_id): r.zone_link_length_m for r in out.collect()}
    for i, p in paths.items():
        for name, w in (("hollow", hollow), ("slant", from_rings([[3, -2], [14, 4], [9, 12]]))):
            rings = loads(w)[1][0]
            length = 0.0
            for a, b in zip(p[:-1], p[1:]):
                t = (np.arange(4000) + 0.5) / 4000
                length += kernels.inside_rings(a + t[:, None] * (b - a), rings).mean() * np.hypot(*(b - a))
            assert got.get((i, name), 0.0) == pytest.approx(length, abs=0.03)
    joined = overlay.spatial_left_join(Layer(df, 3857), z).df.collect()
    met = {(r.id, r.zone_zone_id) for r in joined}
    assert {k for k in got} <= met and (99, None) in met and len(joined) == len(met) and {r.id for r in joined} == {*paths, 99}


@pytest.mark.parametrize(
    "value, want",
    [("50", "31 mph"), ("80 km/h", "50 mph"), ("40 kph", "25 mph"), ("25 mph", "25 mph"), (" 60 MPH ", "60 mph"), ("signals", None), ("30;50", None), ("", None), (None, None)],
)
def test_maxspeed(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(tg.standard_maxspeed(F.col("v"))).first()[0] == want


def test_tag_tables(spark):
    def run(f, cells):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, v string")
        return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]

    assert run(tg.standard_oneway, ["yes", "True", "-1", "reverse", "yes;1", "yes;no", "reverse;-1", "x", "", None]) == ["yes", "yes", "-1", "-1", "yes", "no", "-1", "no", "no", "no"]
    assert run(tg.standard_access, ["private", "yes|no", "a;0", "permissive", " ", None]) == ["no", "no", "no", "yes", "yes", "yes"]
    assert run(tg.standard_hgv, ["no", "private", "yes;0", "true", "", None]) == [False, True, False, True, True, True]
    got = run(lambda c: tg.standard_weight(c, "lbs"), ["5", "3.5t", "10000 lbs", "1000 kg", "10 st", "heavy", "7 foo", None])
    want = [11023.1, 7716.17, 10000.0, 2204.62, 140.0, None, 15432.34, None]
    assert all((a is None and b is None) or a == pytest.approx(b, rel=1e-4) for a, b in zip(got, want))
    assert run(tg.parse_other_tags, ['"a"=>"1","a"=>"2","b"=>""', None, ""]) == [{"a": "2"}, {}, {}]
    assert run(tg.split_tag_pairs, ['"a"=>"1, 2","b"=>"3","c"', "a=>1=>2", None]) == [{"a": "1, 2", "b": "3"}, {}, {}]
    assert run(lambda c: tg.standard_maxspeeds(F.split(c, ",")), ["50,100", "x", None]) == ["46 mph", None, None]


def test_process_tags(spark):
    df = spark.createDataFrame([(1, "yes", "5t", None, None), (2, "no", "20t", None, None), (3, None, "50t", None, None), (4, "no", None, "5t", None), (5, "no", None, None, "9")], "id int, oneway string, maxweight string, `maxweight:hgv` string, maxlength string")
    got = {r.id: (r.mdv, r.hgv) for r in tg.process_tags(df).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (True, True), 4: (False, False), 5: (True, False)}
    with pytest.raises(ValueError):
        tg.process_tags(df.drop("oneway"))
    assert tg.highway_filter(["a", "b"]) == '["highway"~"a|b"]'


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "3", "no", True, "20 mph"), (2, "30 tons", "permit", None, "25 mph"), (3, None, "weird", False, "x")], "seq int, w string, a string, b boolean, s string")
    r = df.agg(
        ag.bool_all(F.col("b")).alias("all"), ag.bool_any(F.col("b")).alias("any"), ag.min_number_or_text(F.col("w"), F.col("seq")).alias("w"), ag.most_restrictive_access(F.col("a"), F.col("seq")).alias("a"),
        ag.mean_maxspeed(F.col("s")).alias("s"), ag.first_valid(F.col("w"), F.col("seq")).alias("f"), ag.yes_no_all(F.col("a")).alias("y"),
    ).first()
    assert tuple(r) == (False, True, "3.0", "no", "22 mph", "3", "no")
    e = df.limit(0).agg(ag.bool_all(F.col("b")), ag.bool_any(F.col("b")), ag.mean_maxspeed(F.col("s"))).first()
    assert tuple(e) == (True, False, None)


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (6, 6), (8, 9), (None, 1)], "u bigint, v bigint")
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 8, 9)], "node_id bigint")
    comp = {r.node_id: r.component for r in graph.components(e, n).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 8: 8, 9: 8}
    assert {r.node_id for r in graph.largest_component(graph.components(e, n)).collect()} == {1, 2, 3, 4}
    assert {r.node_id: r.component for r in graph.strong_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 6: 6, 8: 8, 9: 9}
    src = spark.createDataFrame([(8,), (3,)], "node_id bigint")
    assert {r.node_id: r.hops for r in graph.reachable(e, src).collect()} == {8: 0, 3: 0, 9: 1, 1: 1, 4: 1, 2: 2}
    assert [r.node_id for r in graph.isolates(n, e).collect()] == [5]
    assert graph.without_self_loops(e).count() == 6 and graph.without_self_loops(e, F.col("u") == 6).count() == 7


def test_long_path_settles(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)], "u bigint, v bigint")
    assert {r.component for r in graph.components(e).collect()} == {0}


def test_places(spark):
    n = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.5), (3, 0.5, -0.5), (4, 3.0, 3.0), (5, 0.5 + 2e-8, 0.5), (6, None, 1.0)], "node_id bigint, x double, y double")
    assert {tuple(r) for r in graph.close_nodes(n, 0.5).collect()} == {(1, 2), (1, 3), (2, 5)}
    assert {tuple(r) for r in graph.close_nodes(n, 0.75, "euclidean").collect()} == {(1, 2), (1, 3), (1, 5), (2, 5)}
    assert [tuple(r) for r in graph.duplicate_coordinates(n).collect()] == [(2, 5)]
    assert [r.node_id for r in graph.nearest_nodes(n, 0.0, 0.0, 1.0, 2).collect()] == [1, 2]
    bad = spark.createDataFrame([(1, 181.0, 0.0), (2, float("nan"), 0.0), (3, 0.0, float("inf")), (4, None, 0.0), (5, 1.0, 1.0)], "node_id bigint, x double, y double")
    assert {r.node_id for r in graph.invalid_coordinates(bad).collect()} == {1, 2, 3, 4}


def test_simplify_and_consolidate(spark):
    e = spark.createDataFrame([(1, 1, 2, 5.0), (2, 2, 3, 5.0), (3, 3, 4, 5.0), (4, 3, 9, 1.0), (5, 20, 21, 1.0), (6, 21, 22, 1.0), (7, 22, 20, 1.0)], "edge_id bigint, u bigint, v bigint, length double")
    got = {r.chain: (r.u, r.v, r.n_edges, r.length) for r in graph.simplify(e).collect()}
    assert got == {1: (1, 3, 2, 10.0), 3: (3, 4, 1, 5.0), 4: (3, 9, 1, 1.0), 5: (20, 20, 3, 3.0)}
    n = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 50.0, 0.0), (4, 50.5, 0.0)], "node_id bigint, x double, y double")
    g = spark.createDataFrame([(1, 2), (2, 3), (4, 3 + 6)], "u bigint, v bigint")
    n = n.unionByName(spark.createDataFrame([(9, 90.0, 0.0)], n.schema))
    nodes, led = graph.consolidate(n, g, 1.0)
    assert {(r.node_id, r.x, r.n_nodes) for r in nodes.collect()} == {(1, 0.5, 2), (3, 50.0, 1), (4, 50.5, 1), (9, 90.0, 1)}
    assert {(r.u, r.v) for r in led.collect()} == {(1, 3), (4, 9)}


@pytest.mark.parametrize("tolerance", [0.05, 0.4, 3.0, 1e-13])
def test_consolidate_without_listing_pairs(spark, monkeypatch, tolerance):
    """Crowded, repeated, scattered and missing places against a plain walk; the
    pairs of a crowd are not listed."""
    if tolerance > 1e-10:
        monkeypatch.setattr(graph, "close_nodes", lambda *_: pytest.fail("the pairs are listed"))
    rnd = np.random.default_rng(5)
    xy = np.concatenate([np.repeat(rnd.integers(-3, 3, (5, 2)) * 0.8, 12, 0), rnd.normal(0, 1.5, (150, 2)), rnd.uniform(-40, 40, (90, 2)), rnd.integers(-9, 9, (60, 2)) * 0.8])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rnd.permutation(xy))]
    rows += [(7, 500.0, 500.0), (400, 500.0, 500.0), (401, None, 0.0), (402, float("nan"), 0.0), (403, float("inf"), 0.0), (404, 0.0, float("-inf"))]
    ids = sorted({r[0] for r in rows})
    pairs = [(int(a), int(b)) for a, b in rnd.choice(ids, (700, 2))] + [(i, j) for i in (7, 401) for j in (400, 403, 404)] + [(402, 402)]

    def parts(links):
        name = {i: i for i in ids}
        for a, b in links:
            old, new = sorted((name[a], name[b]), reverse=True)
            name = {k: new if n == old else n for k, n in name.items()}
        return name

    good = [r for r in rows if r[1] is not None and np.isfinite(r[1:]).all()]
    group = parts((a[0], b[0]) for a in good for b in good if a[0] < b[0] and np.hypot(a[1] - b[1], a[2] - b[2]) <= 2 * tolerance)
    name = parts((u, v) for u, v in pairs if group[u] == group[v])
    n = spark.createDataFrame(rows, "node_id bigint, x double, y double")
    e = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(pairs)], "edge_id bigint, u bigint, v bigint")
    nodes, led = graph.consolidate(n, e, tolerance)
    sizes = {}
    for i, _, _ in rows:
        sizes[name[i]] = sizes.get(name[i], 0) + 1
    assert {r.node_id: r.n_nodes for r in nodes.collect()} == sizes
    assert {tuple(r) for r in led.select("edge_id", "u", "v").collect()} == {(i, name[u], name[v]) for i, (u, v) in enumerate(pairs) if name[u] != name[v] or u == v}


def test_consolidated_edges_of_shared_places(spark, monkeypatch, tmp_path):
    """The query against its SQL where several customers share each place."""
    from gridloom.plans import network_queries

    monkeypatch.setattr(graph, "close_nodes", lambda *_: pytest.fail("the pairs are listed"))
    con = pytest.importorskip("duckdb").connect()
    spark.range(2954).selectExpr("id AS c_custkey", "id % 25 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(con.execute(network_queries.SQL["consolidated_edges"]).fetchall())
    assert sorted(tuple(r) for r in network_queries.consolidated_edges(spark, str(tmp_path)).collect()) == want
    assert len(want) < 2954  # edges within a place are gone


def test_consolidate_reads_edges_once(spark):
    """Groups, the edges within them and the edges led over come of one pass."""
    read = {"u": spark.sparkContext.accumulator(0), "node_id": spark.sparkContext.accumulator(0)}

    def counted(rows, schema):
        df = spark.createDataFrame(rows, schema)
        seen = read[df.columns[-1]]

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    places = [(0.0, 0.0, 1), (0.5, 0.0, 2), (0.9, 0.4, 3), (50.0, 0.0, 4), (50.0, 0.0, 5), (None, 0.0, 6), (7.0, 7.0, None)]
    pairs = [("a", 2, 1), ("b", 3, 2), ("c", 4, 3), ("d", 5, 4), ("e", 6, 5), ("f", 6, 6), ("g", 99, 1), ("h", 3, None), ("i", 3, 3), ("j", 1, 6)]
    nodes, led = graph.consolidate(counted(places, "x double, y double, node_id bigint"), counted([(k, v, u) for k, u, v in pairs], "edge_id string, v bigint, u bigint"), 0.5)
    assert sorted(tuple(r) for r in led.select("edge_id", "u", "v").collect()) == [("c", 4, 1), ("e", 6, 4), ("f", 6, 6), ("i", 1, 1), ("j", 1, 6)]
    assert read["u"].value == len(pairs)
    assert {(r.node_id, r.n_nodes) for r in nodes.collect()} == {(1, 3), (4, 2), (6, 1)}
    assert read["node_id"].value <= 3 * len(places)


def test_compose_and_speeds(spark):
    a = spark.createDataFrame([(1, 2, "main", 5)], "u int, v int, role string, x int")
    b = spark.createDataFrame([(1, 2, "local", None), (2, 3, "local", 7)], "u int, v int, role string, y int")
    got = {(r.u, r.v): (r.role, r.x, r.y) for r in graph.compose([a, b], ["u", "v"]).collect()}
    assert got == {(1, 2): ("local", 5, None), (2, 3): ("local", None, 7)}
    s = spark.createDataFrame([("p", 10.0), ("p", None), ("q", None), (None, 40.0), (None, None)], "highway string, speed_kph double")
    assert sorted((r.highway or "", r.speed_kph) for r in graph.impute_speeds(s).collect()) == [("", 40.0), ("", 40.0), ("p", 10.0), ("p", 10.0), ("q", 25.0)]


def test_validation_gate(spark):
    n = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0)], "node_id bigint, x double, y double")
    g = bytearray(from_line([[0, 0], [5, 0]]))
    schema = "edge_id string, u bigint, v bigint, length double, oneway string, geometry binary, speed_kph double, bridge string"
    ok = spark.createDataFrame([("a", 1, 2, 5.0, "no", g, 30.0, None), ("b", 2, 2, 5.0, "no", g, 30.0, "yes")], schema)
    graph.assert_valid(graph.validate(n, ok))  # the loop is protected
    bad = spark.createDataFrame([(None, 1, 1, -5.0, "maybe", None, None, None)], schema)
    with pytest.raises(RuntimeError) as e:
        graph.assert_valid(graph.validate(n, bad))
    for fault in ("unprotected_self_loops = 1", "isolates = 1", "missing_edge_id = 1", "nonpositive_length = 1", "missing_speed_kph = 1", "invalid_oneway_values = 1", "missing_geometry = 1", "components = 2"):
        assert fault in str(e.value)
    with pytest.raises(RuntimeError, match="missing_speed_kph = 2"):
        graph.assert_valid(graph.validate(n, ok.drop("speed_kph")))
    kind = "type string, id bigint, lat double, lon double, nodes array<bigint>"
    el = spark.createDataFrame([("node", 1, 0.0, 0.0, None), ("node", 2, 0.0, 0.0, None), ("way", 3, None, None, [1, 9])], kind)
    with pytest.raises(RuntimeError, match="xml_duplicate_coordinates = 1, xml_dangling_refs = 1"):
        graph.assert_valid(graph.validate(n, ok, extract=el))


def test_fragments_and_topology(spark):
    n = spark.createDataFrame([(i, float(i), 0.0) for i in (1, 2, 3, 7, 8, 9)], "node_id bigint, x double, y double")
    rows = [("a", 1, 2, "service", None, 1.0), ("a", 2, 3, "primary", "yes", 2.0), (None, 3, 3, "service", None, 1.0), (None, 7, 8, "trunk", None, 5.0), ("b", 9, 9, "service", None, 1.0)]
    e = spark.createDataFrame(rows, "edge_id string, u bigint, v bigint, highway string, tunnel string, length double")
    members = graph.components(e, n)
    rep = {r.component: r for r in graph.infrastructure_report(n, e, members).collect()}
    assert (rep[1].n_nodes, rep[1].n_edges, rep[1].length, rep[1].major, rep[1].bridge_tunnel, rep[1].classes, rep[1].east) == (3, 3, 4.0, 1, 1, {"service": 2, "primary": 1}, 3.0)
    assert [r.component for r in graph.lost_infrastructure(graph.infrastructure_report(n, e, members)).collect()] == [7]
    assert tuple(graph.bridge_tunnel_counts(e).first()) == (0, 1)
    nodes, edges = graph.clean_topology(n, e)
    assert {r.node_id for r in nodes.collect()} == {1, 2, 3, 7, 8} and sorted(r.edge_id or "" for r in edges.collect()) == ["", "a", "a_1"]
    with pytest.raises(ValueError, match="empty"):
        graph.clean_topology(n, e.where("u = v"))


def test_chains_keep_ways_and_lines(spark):
    g = lambda *p: bytearray(from_line(p))
    rows = [(1, 10, 11, 7, g([0, 0], [1, 0])), (2, 11, 12, 8, g([1, 0], [2, 5], [3, 0])), (3, 20, 21, 9, None), (4, 21, 22, 9, g([0, 0], [1, 0]))]
    e = spark.createDataFrame(rows, "edge_id bigint, u bigint, v bigint, osmid bigint, geometry binary")
    got = {r.u: (r.v, r.osmid, r.geometry and bytes(r.geometry)) for r in graph.simplify(e).collect()}
    assert got == {10: (12, ["7", "8"], from_line([[0, 0], [1, 0], [2, 5], [3, 0]])), 20: (22, ["9"], None)}


def test_joins_and_reports(spark):
    a = spark.createDataFrame([("1", "x"), ("2.0", "y"), (None, "z"), ("w", "q")], "attributeOrigId string, name string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (2, "r")], "osm_id bigint, name string")
    j = diagnose.join_by_id(a, b, "attributeOrigId", "osm_id")
    assert j.columns == ["attributeOrigId", "name_x", "osm_id", "name_y"] and sorted(tuple(r) for r in j.collect()) == [(1, "x", 1, "p"), (2, "y", 2, "q"), (2, "y", 2, "r")]
    with pytest.raises(ValueError):
        diagnose.join_by_id(a, b, "nope", "osm_id")
    q = diagnose.edge_quality(spark.createDataFrame([(None, 4.0), ("b", 20_000.0), ("c", None)], "edge_id string, length double")).first().asDict()
    assert (q["missing_edge_id"], q["missing_length"], q["short_links_lt_10m"], q["long_links_gt_10km"], q["missing_geometry"], q["speed_kph_min"]) == (1, 1, 1, 1, 3, None)
    d = diagnose.with_density(spark.createDataFrame([(i, 1e6) for i in range(4)], "geoid int, area_m2 double"), spark.createDataFrame([(0, 5.0), (1, 7.0), (2, 7.0), (3, 9.0)], "geoid int, population double"))
    assert [r.percentile for r in d.orderBy("geoid").collect()] == [25.0, 62.5, 62.5, 100.0]
    assert diagnose.dense_areas(d, 7.0).count() == 3 and diagnose.dense_areas(d, 0).count() == 4
    assert diagnose.share_kept(diagnose.dense_areas(d, 9.0), d).first().share == pytest.approx(9 / 28)
    long = spark.createDataFrame([("a" * 300, "b"), (None, None)], "p string, q string")
    assert [tuple(r) for r in diagnose.long_tags(long).collect()] == [("p", 300)] and diagnose.long_rows(long).count() == 1
    c = spark.createDataFrame([("001", None), (None, "003"), ("005", "007")], "COUNTYFP string, COUNTYFP20 string")
    assert diagnose.in_counties(c, ["001", "003"]).count() == 2


def test_streamed_counts(spark, tmp_path):
    """A stream of element records keeps the counts that all of them in one give."""
    import datetime as dt

    from gridloom.streaming import maintain

    src = tmp_path / "in"
    kind = "rec_id bigint, type string, id bigint, version int, ts timestamp, visible boolean, nodes array<bigint>, members array<struct<type:string,ref:bigint,role:string>>"
    day = lambda n: dt.datetime(2031, 1, n)
    batches = [
        [(1, "way", 1, 1, day(1), None, [5, 6], None), (2, "node", 5, 1, day(1), True, None, None)],
        [(3, "way", 1, 2, day(3), None, [5, 7, 7], None), (4, "node", 5, 2, day(3), False, None, None), (5, "relation", 9, 1, day(2), None, None, [("way", 1, None), (None, 1, None)])],
        [(6, "way", 1, 3, day(4), False, None, None), (7, "node", 7, 1, day(1), None, None, None), (8, "way", 1, 1, day(1), None, [5, 6], None)],
    ]
    counts = maintain.Counts(spark, str(tmp_path / "c"))
    want = [{("node", 6, 1)}, {("node", 5, 1), }, {("way", 1, 1)}]
    for rows, orphans in zip(batches, want):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(src))
        maintain.maintain_references(spark.readStream.schema(kind).parquet(str(src)), str(tmp_path / "c"), str(tmp_path / "p")).awaitTermination(60)
        assert {tuple(r) for r in counts.orphans().collect()} == orphans | ({("node", 7, 1)} if rows is batches[1] else set())
    every = spark.createDataFrame([r for rows in batches for r in rows], kind)
    once = maintain.Counts(spark, str(tmp_path / "once"))
    once.add(every, 0)
    assert sorted(map(tuple, once.read().collect())) == sorted(map(tuple, counts.read().collect()))
    counts.add(spark.createDataFrame([(99, "node", 1, 1, day(9), None, None, None)], kind), 0)  # an old batch again
    assert sorted(map(tuple, once.read().collect())) == sorted(map(tuple, counts.read().collect()))
    assert counts.versions() == [1, 2]  # the newest two


def test_command_line_parses():
    from gridloom.cli import parser

    a = parser().parse_args(["intersect", "n.gpkg", "z.gpkg", "o.parquet", "--epsg", "26910", "--prefilter"])
    assert a.epsg == 26910 and a.prefilter
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])


def two_way(*pairs):
    return [(2 * k + d, *((a, b) if d else (b, a)), float(k + 1), f"t{t}") for k, (a, b, t) in enumerate(pairs) for d in (0, 1)]


def test_simplify_merges_two_way_roads(spark):
    schema = "edge_id bigint, u bigint, v bigint, length double, name string"
    # a road 1-2-3-4 to a fork at 4, a ring 20-21-22, and a dead end 31-30 with a loop at 31
    rows = two_way((1, 2, 0), (2, 3, 0), (3, 4, 1), (4, 5, 0), (4, 6, 0), (20, 21, 0), (21, 22, 0), (22, 20, 0), (30, 31, 0), (31, 32, 0)) + [(99, 31, 31, 1.0, "t0")]
    e = spark.createDataFrame(rows, schema)
    chains = lambda df: sorted((r.u, r.v, r.n_edges, r.length) for r in df.collect())
    rest = [(4, 5, 1, 4.0), (4, 6, 1, 5.0), (5, 4, 1, 4.0), (6, 4, 1, 5.0), (20, 20, 3, 21.0), (20, 20, 3, 21.0)]
    rest += [(30, 31, 1, 9.0), (31, 30, 1, 9.0), (31, 31, 1, 1.0), (31, 32, 1, 10.0), (32, 31, 1, 10.0)]
    assert chains(graph.simplify(e)) == sorted([(1, 4, 3, 6.0), (4, 1, 3, 6.0), *rest])
    assert chains(graph.simplify(e, ["name"])) == sorted([(1, 3, 2, 3.0), (3, 1, 2, 3.0), (3, 4, 1, 3.0), (4, 3, 1, 3.0), *rest])
    # a name that changes in one direction only keeps the node for both
    uneven = spark.createDataFrame([(1, 1, 2, 1.0, "p"), (2, 2, 3, 1.0, "q"), (3, 3, 2, 1.0, "p"), (4, 2, 1, 1.0, "p")], schema)
    assert chains(graph.simplify(uneven, ["name"])) == [(1, 2, 1, 1.0), (2, 1, 1, 1.0), (2, 3, 1, 1.0), (3, 2, 1, 1.0)]


def test_match_rate_asks_for_all_numbered_ids(spark):
    n = spark.createDataFrame([(x,) for x in ("1", " 2", "3 ", "4.0", "4", "5.0", "way/6", "w7", "w1", "nan", "", None)], "id string")
    z = spark.createDataFrame([(1,), (2,), (4,), (6,)], "osm bigint")
    m = diagnose.join_by_id(n, z, "id", "osm")
    assert tuple(diagnose.match_rate(m, n, "id").first()) == (7, 3, 3 / 7)


def test_match_rate_query_counts_what_it_joins(spark, tmp_path):
    from gridloom.plans import graph_queries

    spark.createDataFrame([("1", 1), (" 2", 2), ("3.0", 3), ("w4", 4)], "attributeOrigId string, linkId bigint").write.parquet(f"{tmp_path}/network.parquet")
    spark.createDataFrame([(1,), (2,)], "edge_osm_id bigint").write.parquet(f"{tmp_path}/edge_zones.parquet")
    assert tuple(graph_queries.match_rate(spark, str(tmp_path)).first())[:2] == (4, 2)


@pytest.mark.parametrize("local", [10**6, 3])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_closures_in_one_task_and_over_the_cluster(spark, monkeypatch, local, kind):
    """Components, strong components and reachability against plain walks."""
    if local == 3 and kind == "string":
        pytest.skip("the cluster's way is the same for all kinds")
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rnd = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rnd.integers(0, 40, (45, 2))] + [(50, 51), (51, 50), (60, 60)]
    e = spark.createDataFrame([*pairs, (None, 1), (2, None)], "u bigint, v bigint").select(F.col("u").cast(kind), F.col("v").cast(kind))
    onward, nodes = {}, {x for p in pairs for x in p} | {1, 2}
    for u, v in pairs:
        onward.setdefault(u, set()).add(v)

    def reach(x):
        seen, todo = {x: 0}, [x]
        for y in todo:
            for z in onward.get(y, ()):
                if z not in seen:
                    seen[z] = seen[y] + 1
                    todo.append(z)
        return seen

    far = {x: reach(x) for x in nodes}
    key = (lambda x: str(x)) if kind == "string" else (lambda x: x)
    want = {key(x): min(key(y) for y in nodes if y in far[x] and x in far[y]) for x in nodes}
    assert {r.node_id: r.component for r in graph.strong_components(e).collect()} == want
    weak = {}
    for x in nodes:
        part, todo = {x}, [x]
        for y in todo:
            for z in nodes:
                if z not in part and (z in onward.get(y, ()) or y in onward.get(z, ())):
                    part.add(z)
                    todo.append(z)
        weak[key(x)] = min(map(key, part))
    assert {r.node_id: r.component for r in graph.components(e).collect()} == weak
    some = e.where("u IN (3, 5)").select(F.col("u").alias("node_id"))
    starts = {x for x in (3, 5) if x in onward}
    hops = {key(y): min(far[x][y] for x in starts if y in far[x]) for x in starts for y in far[x]}
    assert {r.node_id: r.hops for r in graph.reachable(e, some).collect()} == hops
    assert graph.components(e.limit(0)).count() == graph.strong_components(e.limit(0)).count() == graph.reachable(e, some.limit(0)).count() == 0


def test_strong_components_of_long_ways(spark, monkeypatch):
    """Long one-way roads and rings over many parts are settled without a round for
    each of their edges."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", 150)
    monkeypatch.setattr(graph, "_spread", lambda *_: pytest.fail("a round for each edge"))
    way = lambda a, b: [(i, i + 1) for i in range(a, b)]
    pairs = way(0, 400) + way(1000, 1399) + [(1399, 1000), (5, 1000), (1200, 1700)] + way(1700, 1750)  # a road to a ring over parts, and one from it
    want = {i: i for i in [*range(401), *range(1700, 1751)]} | dict.fromkeys(range(1000, 1400), 1000)
    for i in range(2000, 2400, 20):  # small rings, linked one way
        pairs += [*way(i, i + 19), (i + 19, i), (i + 7, i + 23)]
        want |= dict.fromkeys(range(i, i + 20), i)
    pairs += [*way(3000, 3300), (3300, 2990), (2990, 2500), (2500, 3000), (2405, 2501)]  # back below its start
    want |= dict.fromkeys([2500, 2990, *range(3000, 3301)], 2500) | {2403: 2403, 2405: 2405, 2501: 2501}
    e = spark.createDataFrame(pairs, "u bigint, v bigint")
    assert {r.node_id: r.component for r in graph.strong_components(e).collect()} == want


def test_quantiles_are_exact(spark):
    rnd = np.random.default_rng(3)
    rows = [(g, float(x)) for g, n in (("a", 501), ("b", 400), ("c", 1)) for x in rnd.integers(0, 50, n) / 4] + [("a", None), ("d", None)]
    got = {r.g: r for r in diagnose.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"q1": 0.1, "q2": 0.5, "q3": 0.97}).collect()}
    for g in "abc":
        want = np.quantile([x for k, x in rows if k == g and x is not None], [0.1, 0.5, 0.97])
        assert [got[g].q1, got[g].q2, got[g].q3] == pytest.approx(want.tolist())
    assert set(got) == set("abc")
