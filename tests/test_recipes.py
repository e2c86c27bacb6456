import pytest
from pyspark.sql import functions as F

from gridloom.functions.wkb import from_line, from_rings
from gridloom.operators import graph, recipes
from gridloom.operators.layer import Layer
from gridloom.sources import sinks


def square(x, y, s=1000.0):
    return bytearray(from_rings([[x, y], [x + s, y], [x + s, y + s], [x, y + s]]))


def test_names():
    plan = recipes.NetworkPlan("bay", (recipes.LayerPlan("residential", geo_level="cbg", least_per_km2=5500), recipes.LayerPlan("ferry")))
    assert plan.name == "bay-cbg5500-ferry-weakConn-network"
    assert recipes.NetworkPlan("x", (), strongly_connected=True).name == "x-strongConn-network"


def test_study_area(spark):
    raw = spark.createDataFrame([("06", "001", "A", "3000"), ("06", "013", "B", "bad"), ("06", "075", "C", "100")], "state string, county string, NAME string, B01003_001E string")
    pop = recipes.census_table(raw, "county")
    assert {r.GEOID: r.population for r in pop.collect()} == {"06001": 3000.0, "06013": None, "06075": 100.0}
    with pytest.raises(ValueError):
        recipes.census_table(raw, "planet")
    rows = [("06001", "001", square(5e5, 4e6)), ("06075", "075", square(5e5 + 3000, 4e6))]
    areas = Layer(spark.createDataFrame(rows, "GEOID string, COUNTYFP string, geometry binary"), 26910)
    kept = recipes.dense_boundaries(areas, pop, 26910, 1000.0)
    assert kept.epsg == 4326 and [r.GEOID for r in kept.df.collect()] == ["06001"]
    assert recipes.boundaries(areas, "075", 26910).df.count() == 1
    net = Layer(spark.createDataFrame([(1, bytearray(from_line([[5e5 + 500, 4e6 + 10], [5e5 + 3500, 4e6 + 10]])))], "edge_id int, geometry binary"), 26910)
    out = recipes.intersect_with_counties(net, areas, ["001", "075"]).df
    assert sorted((r.zone_COUNTYFP, r.zone_link_length_m) for r in out.collect()) == [("001", 500.0), ("075", 500.0)]
    assert recipes.county_mask(areas, ["001"], "m").df.first().mask_name == "m"


def test_endpoints():
    tried = []

    def call(e):
        tried.append(e)
        if e != "c":
            raise OSError("down")
        return "got"

    assert recipes.first_that_works(call, ["a", "a", "c"]) == "got" and tried == ["a", "c"]
    with pytest.raises(RuntimeError, match="a: down; b: down"):
        recipes.first_that_works(call, ["a", "b"])


def _net(spark):
    nodes = spark.createDataFrame([(i, float(i * 100), 0.0) for i in range(1, 7)], "node_id bigint, x double, y double")
    rows = [(i, i, i + 1, "primary" if i < 5 else "service", "no", 100.0, "yes" if i == 2 else None, bytearray(from_line([[i * 100, 0], [i * 100 + 100, 0]]))) for i in range(1, 6)]
    rows.append((9, 3, 3, "service", "no", 5.0, None, None))
    edges = spark.createDataFrame(rows, "edge_id bigint, u bigint, v bigint, highway string, oneway string, length double, bridge string, geometry binary")
    return nodes, edges


def test_build(spark):
    nodes, edges = _net(spark)
    plan = recipes.NetworkPlan("t", (recipes.LayerPlan("backbone", ("primary",)), recipes.LayerPlan("connector", ("service",))), same=("layer_role",))
    n, e = recipes.build_network(nodes, edges, plan)
    got = {(r.u, r.v): (r.n_edges, r.length, r.layer_role) for r in e.collect()}
    assert got == {(1, 5): (4, 400.0, "backbone"), (5, 6): (1, 100.0, "connector")}
    with pytest.raises(ValueError):
        recipes.build_network(nodes, edges, recipes.NetworkPlan("t", (recipes.LayerPlan("other"),)))


def test_build_from_areas_and_with_rules(spark):
    """Local roads come from their area only, widened; further columns merge by
    rules that are given."""
    nodes, edges = _net(spark)
    area = Layer(spark.createDataFrame([(square(490, -5, 5.0),), (square(495, -5, 5.0),)], "geometry binary"), 3857)
    layers = (recipes.LayerPlan("backbone", ("primary",)), recipes.LayerPlan("residential", ("service",), buffer_m=1.0))
    edges = edges.where("geometry IS NOT NULL")
    plan = recipes.NetworkPlan("t", layers, same=("layer_role",))
    got = {(r.u, r.v) for r in recipes.build_network(nodes, edges, plan, {"residential": area})[1].collect()}
    assert got == {(1, 5), (5, 6)}  # the local road starts at 500, a metre of the area's reach
    far = Layer(spark.createDataFrame([(square(0, 50, 5.0),)], "geometry binary"), 3857)
    assert {(r.u, r.v) for r in recipes.build_network(nodes, edges, plan, {"residential": far})[1].collect()} == {(1, 5)}
    usual = recipes.usual_layers(120, ferries=True)
    assert [p.role for p in usual] == ["backbone", "connector", "ferry", "residential"] and "residential" in usual[-1].highways
    e = edges.where("edge_id < 5").withColumn("count", F.col("edge_id") * 10)
    assert graph.simplify(e, more={"count": F.max}).first()["count"] == 40


def test_corridor_and_gaps(spark):
    nodes, edges = _net(spark)
    r = recipes.check_corridor(nodes, edges.where("geometry IS NOT NULL"), "bridge", (100.0, 0.0), (400.0, 0.0), (210.0, -1.0, 290.0, 1.0), 10.0)
    assert r == {"name": "bridge", "edges": 1, "marked": 1, "nodes": 0, "routable": True, "status": "OK"}
    back = recipes.check_corridor(nodes, edges.where("geometry IS NOT NULL"), "back", (400.0, 0.0), (100.0, 0.0), (10.0, 5.0, 20.0, 9.0), 10.0)
    assert (back["routable"], back["status"]) == (False, "MISSING")
    e = edges.where("edge_id < 3").withColumns({"x0": F.col("u") * 100.0, "y0": F.lit(0.0), "x1": F.col("v") * 100.0 + F.col("edge_id") - 1, "y1": F.lit(0.0)})
    assert [(x.edge_id, x.gap_m) for x in recipes.end_gaps(e, nodes, 0.5, 1.0).collect()] == [(2, 1.0)]


def test_reports(spark, tmp_path):
    nodes, edges = _net(spark)
    d = {r.metric: (r.a, r.b) for r in recipes.compare_networks((nodes, edges), (nodes, graph.without_self_loops(edges))).collect()}
    assert d["self_loops"] == (1.0, 0.0) and "nodes" not in d
    el = spark.createDataFrame([("way", 1, {"a": "x", "b": "y"}), ("way", 2, {"a": "x"}), ("way", 3, {"a": "z"}), ("node", 4, None)], "type string, id bigint, tags map<string,string>")
    rep = {r.tag: r for r in recipes.tag_report(el, 1).collect()}
    assert (rep["a"]["count"], rep["a"].unique_values, rep["a"].top_values, rep["b"].percent_present) == (3, 2, {"x": 2}, 33.33)
    assert recipes.text_report([{"a": "x" * 60, "b": 1}]) == "a: " + "x" * 47 + "...\nb: 1"
    (tmp_path / "one").mkdir()
    (tmp_path / "archive").mkdir()
    full = el.selectExpr("type", "id", "tags", "CAST(null AS double) lat", "CAST(null AS double) lon", "array(1L) nodes", "CAST(null AS array<struct<type:string,ref:bigint,role:string>>) members")
    for f in ("one", "archive"):
        sinks.write_pbf(full, str(tmp_path / f / "a.osm.pbf"))
    csv = str(tmp_path / "list.csv")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.osm.pbf").write_bytes(b"junk")
    counts = recipes.way_counts(spark, str(tmp_path), recipes.known_counts(spark, csv))
    assert [tuple(r)[:2] for r in counts.orderBy("name").collect()] == [("bad", 0), ("one", 3)]
    assert recipes.append_counts(counts, csv).count() == 2
    assert recipes.way_counts(spark, str(tmp_path), recipes.known_counts(spark, csv)).count() == 0


def test_boundary_rules(spark):
    assert recipes.boundary_file("6", "cbg", 2018) == "cb_2018_06_bg_500k.zip" and recipes.boundary_file(6, "county", 2018) == "tl_2018_us_county.zip"
    with pytest.raises(ValueError):
        recipes.boundary_file("06", "city", 2018)
    areas = Layer(spark.createDataFrame([("001", square(0, 0))], "COUNTYFP10 string, geometry binary"), 3857)
    assert recipes.boundaries(areas, 1, 3857).df.count() == 1
    with pytest.raises(ValueError):
        recipes.boundaries(areas, 1, 3857, "city")


def test_corridor_traces(spark):
    nodes, edges = _net(spark)
    e = edges.where("geometry IS NOT NULL")
    t = recipes.trace_approach(nodes, e, (100.0, 0.0), (400.0, 0.0), (250.0, -1.0, 350.0, 1.0), 20.0)
    assert t == {"approach_nodes": 3, "corridor_nodes": 1, "reached": 1, "reaching": 1, "nearest": [1, 2, 3]}
    assert [(r.u, r.v, r.u_x, r.bridge) for r in recipes.corridor_edges(nodes, e, (210.0, -1.0, 290.0, 1.0)).collect()] == [(2, 3, 200.0, "yes")]
    short, long = recipes.extreme_links(edges, "length")
    assert [r.edge_id for r in short.collect()] == [9] and long.count() == 0


def test_build_and_diagnose_from_files(spark, tmp_path, capsys):
    """From an extract to a network in all formats, its judgement, a comparison and
    a mapped table, through the command line's own calls."""
    import json

    from gridloom import api

    kind = "type string, id bigint, version int, ts timestamp, visible boolean, lat double, lon double, tags map<string,string>, nodes array<bigint>, members array<struct<type:string,ref:bigint,role:string>>"
    node = lambda i, x, y: ("node", i, 1, None, None, 37.0 + y / 1000, -122.0 + x / 1000, None, None, None)
    way = lambda i, nodes, **t: ("way", i, 1, None, None, None, None, t, nodes, None)
    rows = [node(i, i, 0) for i in range(1, 7)] + [node(7, 3, 1), node(8, 3, 2), node(20, 40, 40), node(21, 41, 40)]
    rows += [way(100, [1, 2, 3], highway="primary", maxspeed="50 mph", lanes="2"), way(101, [3, 4, 5, 6], highway="primary", oneway="yes", maxspeed="80"), way(102, [3, 7, 8], highway="residential")]
    rows += [way(103, [20, 21], highway="primary"), way(104, [1, 99], building="yes")]
    extract = str(tmp_path / "in.osm.pbf")
    sinks.write_pbf(spark.createDataFrame(rows, kind), extract)
    plan = tmp_path / "plan.json"
    plan.write_text(json.dumps({"area": "t", "utm": 32610, "layers": [{"role": "backbone", "highways": ["primary"]}, {"role": "residential", "highways": ["residential"], "geo_level": "cbg", "least_per_km2": 10}]}))
    out = api.build_network_from_extract(extract, str(plan), str(tmp_path))
    assert set(out) == set(sinks.FORMATS) and "t-cbg10-weakConn-network" in out["pbf"]
    edges = spark.read.parquet(out["parquet"])
    got = {(r.u, r.v): r for r in edges.collect()}
    nodes = {r.node_id: (round(r.x, 4), round(r.y, 4)) for r in spark.read.parquet(out["parquet"].replace(".parquet", ".nodes.parquet")).collect()}
    assert set(got) == {(1, 3), (3, 1), (3, 6), (3, 8), (8, 3)} and nodes[6] == (-121.994, 37.0)
    assert got[1, 3].osmid == ["100"] and got[1, 3].maxspeed == "50 mph" and got[1, 3].n_edges == 2 and got[3, 8].speed_kph == pytest.approx(80.467)
    assert got[3, 6].length == pytest.approx(3 * 88.8, rel=0.01) and got[3, 6].geometry is not None and len({r.edge_id for r in got.values()}) == 5
    assert api.compare_osm_pbf_artifacts(out["pbf"], out["pbf"], 32610) == "no differences\nno differences"
    api.diagnose_built_osm_pbf(out["pbf"], 32610)
    assert "retrieved_edges: 5" in capsys.readouterr().out
    with pytest.raises(ValueError):
        recipes.NetworkPlan.read(str(_written(tmp_path, {"area": "t", "layers": [], "colour": 1})))
    (tmp_path / "n.csv").write_text("linkId,attributeOrigId\n1,100\n2,101\n3,555\n")
    mapped = api.map_network_csv_to_osm_pbf(str(tmp_path / "n.csv"), extract, str(tmp_path / "mapped.parquet"))
    assert sorted((r.linkId, r.osm_id) for r in mapped.collect()) == [(1, 100), (2, 101)] and spark.read.parquet(str(tmp_path / "mapped.parquet")).count() == 2
    for args in ((str(tmp_path / "n.csv"), "x.gpkg", "o.parquet"), (str(tmp_path / "n.csv"), extract, "o.csv")):
        with pytest.raises(ValueError):
            api.map_network_csv_to_osm_pbf(*args)


def _written(folder, what):
    import json

    (folder / "w.json").write_text(json.dumps(what))
    return folder / "w.json"


def test_results_of_paths_are_made_once(spark, tmp_path):
    import gridloom

    z = Layer(spark.createDataFrame([("z", square(0, 0, 10.0))], "zone_id string, geometry binary"), 3857)
    net = spark.createDataFrame([(1, bytearray(from_line([[5, 5], [15, 5]])))], "edge_id bigint, geometry binary")
    path = str(tmp_path / "o.parquet")
    one = gridloom.intersect_road_network_with_zones(net, 3857, z, path)
    assert [r.zone_edge_proportion for r in one.collect()] == [0.5] and sinks.cached(path, sinks.cache_key()) is False
    import os

    at = os.path.getmtime(path)
    assert gridloom.intersect_road_network_with_zones(net, 3857, z, path).count() == 1 and os.path.getmtime(path) == at
    assert gridloom.intersect_road_network_with_zones(net.where("edge_id > 5"), 3857, z, str(tmp_path / "e.parquet")).count() == 0 and not (tmp_path / "e.parquet").exists()
    assert callable(gridloom.create_osm_highway_filter) and set(dir(gridloom)) and len(set(gridloom.__all__)) == 16
    with pytest.raises(NotImplementedError):
        gridloom.match_road_network_geometries(1, 2)
    with pytest.raises(AttributeError):
        gridloom.nothing  # noqa: B018


def test_borders_crossed(spark):
    from gridloom.operators import overlay

    zones = Layer(spark.createDataFrame([(square(0, 0, 10.0),), (None,)], "geometry binary"), 3857)
    rows = [(1, [[1, 1], [2, 2]]), (2, [[5, 5], [15, 5]]), (3, [[20, 20], [30, 30]]), (4, [[10, 2], [10, 5]])]
    lines = Layer(spark.createDataFrame([(i, bytearray(from_line(p))) for i, p in rows], "id int, geometry binary"), 3857)
    assert {r.id for r in overlay.crossing_boundaries(lines, zones).df.collect()} == {2, 4}


def test_graphml_and_maps(spark, tmp_path):
    from gridloom.sources import osm

    nodes = spark.createDataFrame([(1, 0.5, None), (2, 1.5, "stop & go")], "node_id bigint, x double, highway string")
    edges = spark.createDataFrame([(1, 2, "A<B", 3.0)], "u bigint, v bigint, name string, length double")
    sinks.write_graphml(nodes, edges, str(tmp_path / "g.graphml"))
    n, e = osm.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.node_id: r.data for r in n.collect()} == {1: {"x": "0.5"}, 2: {"x": "1.5", "highway": "stop & go"}}
    assert [(r.u, r.v, r.data) for r in e.collect()] == [(1, 2, {"name": "A<B", "length": "3.0"})]
    lines = recipes.line_ids(spark.createDataFrame([("7", '"edge_id"=>"e1","length"=>"12.5"'), ("x", None)], "osm_id string, other_tags string"))
    assert {tuple(r) for r in lines.select("osm_id", "edge_id", "edge_length").collect()} == {(7, "e1", 12.5), (None, None, None)}
    net = spark.createDataFrame([("7",), ("8",), (None,)], "attributeOrigId string")
    out, rate = recipes.map_network(net, lines)
    assert out.count() == 1 and tuple(rate.first()) == (2, 1, 0.5)


def test_line_diagnostics(spark):
    rows = [[[0, 0], [3, 4]], [[3, 4], [3, 14]], [[100, 0], [100, 600]]]
    layer = Layer(spark.createDataFrame([(bytearray(from_line(p)),) for p in rows] + [(None,)], "geometry binary"), 3857)
    lengths, parts = recipes.line_diagnostics(layer)
    assert {r["class"]: r["count"] for r in lengths.collect()} == {"all": 3, "short": 2, "plotted": 2}
    assert sorted((r.n_nodes, r.n_edges, r.length) for r in parts.collect()) == [(2, 1, 600.0), (3, 2, 15.0)]
