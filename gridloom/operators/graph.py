"""Road graphs as node and edge tables: cleaning, closure, diagnosis.

Edges are ``(u, v, ...)`` with any other columns, nodes ``(node_id, ...)``.
Closures iterate over DataFrames; each round is cut with a reliable checkpoint.
What is counted to fit one task, at once or after some rounds, is finished there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import merge_edges
from ..functions.tags import MAJOR_ROADS, first_class, protected_edge, truthy
from ..functions.wkb import dumps, line_parts
from ..runtime import cut, few, small_side, stored


#: Edges of a graph that one task closes in memory.
LOCAL_EDGES = 500_000


def _in_one_task(rows: DataFrame, solve: Callable, out: str) -> DataFrame:
    """``(node_id, out)`` of ``solve(u, v, n)`` on rows ``(u, v)`` whose nodes are
    numbered by value; ``v`` is -1 where it is null. ``solve`` gives one number per
    node, below 0 for none; for ``component`` it is the number of a node."""
    kind = rows.schema["u"].dataType
    number = T.IntegerType() if out == "hops" else kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        t = pa.Table.from_batches(rows)
        u, v = t.column(0), t.column(1)
        names = pc.unique(pa.chunked_array([*u.chunks, *v.chunks])).drop_null()
        names = names.take(pc.sort_indices(names))
        at = lambda c: pc.fill_null(pc.index_in(c, value_set=names), -1).to_numpy()
        got = solve(at(u), at(v), len(names))
        some = np.flatnonzero(got >= 0)
        value = pa.array(got[some], pa.int32()) if out == "hops" else names.take(pa.array(got[some]))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), value], names=["node_id", out])

    schema = T.StructType([T.StructField("node_id", kind), T.StructField(out, number)])
    return rows.select("u", "v").repartition(1).mapInArrow(run, schema)


def _weak(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component: every node hooks onto the lesser
    of two labels, labels are followed to their ends, until nothing changes."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def _onward(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours by node: where each node's begin, and all in a row."""
    order = np.argsort(u, kind="stable")
    return np.searchsorted(u[order], np.arange(n + 1)), v[order]


def _strong(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's strong component."""
    return _strong_in_order(u, v, n)[0]


def _strong_in_order(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """The least node of each node's strong component, by one depth-first walk that
    keeps the lowest step each node leads back to; and these least nodes, each after
    those that it leads to."""
    start, near = (x.tolist() for x in _onward(u, v, n))
    step, low, out = [0] * n, [0] * n, [-1] * n
    held: list[int] = []
    order: list[int] = []
    clock = 0
    for root in range(n):
        if step[root]:
            continue
        clock += 1
        step[root] = low[root] = clock
        held.append(root)
        walk, at = [root], [start[root]]
        while walk:
            x = walk[-1]
            if at[-1] < start[x + 1]:
                y = near[at[-1]]
                at[-1] += 1
                if not step[y]:
                    clock += 1
                    step[y] = low[y] = clock
                    held.append(y)
                    walk.append(y)
                    at.append(start[y])
                elif out[y] < 0:
                    low[x] = min(low[x], step[y])
                continue
            walk.pop(), at.pop()
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[x])
            if low[x] == step[x]:
                part = [held.pop()]
                while part[-1] != x:
                    part.append(held.pop())
                least = min(part)
                order.append(least)
                for y in part:
                    out[y] = least
    return np.array(out, np.int64), order


def _hops(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Steps from the sources, the rows without ``v``; -1 where there is no way."""
    out = np.full(n, -1)
    edge = v >= 0
    start, near = _onward(u[edge], v[edge], n)
    front = np.unique(u[~edge])
    k = 0
    while len(front):
        out[front] = k
        size = start[front + 1] - start[front]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[front], size)
        front = np.unique(near[at])
        front = front[out[front] < 0]
        k += 1
    return out


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("u = v")


def without_self_loops(edges: DataFrame, protected: Column | None = None) -> DataFrame:
    """Edges that are no loop, and protected loops; null ends are kept."""
    keep = ~F.coalesce(F.col("u") == F.col("v"), F.lit(False))
    return edges.where(keep if protected is None else keep | F.coalesce(protected, F.lit(False)))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("node_id")).where("node_id IS NOT NULL").distinct()


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges), "node_id", "left_anti")


def used_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges), "node_id", "left_semi")


def unique_edge_ids(edges: DataFrame, order: list[str], column: str = "edge_id") -> DataFrame:
    """Repeated ids get ``_1``, ``_2``, ... in the given order; the first keeps its
    name, null ids stay null."""
    # null ids need no number, so they are spread over as many groups as there are rows
    own = F.when(F.col(column).isNull(), F.xxhash64(*order))
    n = F.row_number().over(Window.partitionBy(column, own).orderBy(*order)) - 1
    name = F.col(column).cast("string")
    return edges.withColumn("_n", n).withColumn(column, F.when(F.col("_n") > 0, F.concat_ws("_", name, "_n")).otherwise(name)).drop("_n")


def duplicate_ids(edges: DataFrame, column: str) -> DataFrame:
    return edges.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("edge_id")).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def components(edges: DataFrame, nodes: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """``(node_id, component)``: weak components, named by their smallest node.

    The graph is contracted round by round: every node hooks onto the least of
    its neighbours in a hashed order, if that is less than itself, and onto what
    that one hooks onto; edges are led to the new names, made distinct and those
    within a name dropped. Each round at least halves what is left, so rounds and
    data shrink together. Hubs are keys of a map-side minimum and of a distinct.
    """
    pair = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = cut(pair.distinct())
    all_nodes = ends(edges) if nodes is None else nodes.select("node_id").where("node_id IS NOT NULL").unionByName(ends(edges)).distinct()
    named = all_nodes.withColumn("label", F.col("node_id"))
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    if few(rest, LOCAL_EDGES):
        least = _in_one_task(rest, _weak, "component")
        return cut(all_nodes.join(least, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component")))
    for _ in range(most_rounds):
        if few(rest, LOCAL_EDGES):
            last = _in_one_task(rest, _weak, "component").select(F.col("node_id").alias("label"), F.col("component").alias("to"))
            named = named.join(last, "label", "left").select("node_id", F.coalesce("to", "label").alias("label"))
            break
        both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        hook = hook.select("u", F.when(F.col("m") < rank("u"), F.col("m.id")).otherwise(F.col("u")).alias("to"))
        onward = hook.select(F.col("u").alias("to"), F.col("to").alias("on"))
        hook = cut(hook.join(onward, "to").select("u", F.col("on").alias("to")))
        named = named.join(hook.withColumnRenamed("u", "label"), "label", "left").select("node_id", F.coalesce("to", "label").alias("label"))
        led = rest.join(hook.withColumnRenamed("to", "cu"), "u").join(hook.select(F.col("u").alias("v"), F.col("to").alias("cv")), "v")
        led = led.where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v"))
        rest = cut(led.distinct())
    else:
        raise RuntimeError("components did not settle")
    named = cut(named)
    least = named.groupBy("label").agg(F.min("node_id").alias("component"))
    return named.join(least, "label").select("node_id", "component")


def largest_component(members: DataFrame) -> DataFrame:
    """Nodes of the largest component, of equal ones that with the smallest name."""
    best = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return members.join(F.broadcast(best.select("component")), "component", "left_semi")  # one row


def reachable(edges: DataFrame, sources: DataFrame, backward: bool = False, most_rounds: int = 10_000) -> DataFrame:
    """``(node_id, hops)`` of all nodes that the sources reach along the edges."""
    step = edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v").distinct()
    if backward:
        step = step.select(F.col("v").alias("u"), F.col("u").alias("v"))
    step = stored(step, "steps")
    if few(step, LOCAL_EDGES) and few(sources, LOCAL_EDGES):
        rows = step.unionByName(sources.where("node_id IS NOT NULL").select(F.col("node_id").alias("u"), F.lit(None).cast(step.schema["v"].dataType).alias("v")))
        return cut(_in_one_task(rows, _hops, "hops"))
    return _reach_by_parts(step, sources, most_rounds)


def _parts(step: DataFrame) -> Callable[[str], Column]:
    """The part of a node by its id, so that about LOCAL_EDGES edges start in each."""
    kind = step.schema["u"].dataType
    parts = step.count() // LOCAL_EDGES + 1
    if isinstance(kind, T.StringType):
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    else:
        cuts = step.agg(F.percentile_approx("u", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
        part = lambda c: sum((F.when(F.col(c) >= F.lit(x), 1).otherwise(0) for x in cuts), F.lit(0)).cast("int") if len(cuts) < 64 else F.size(F.filter(F.array(*(F.lit(x) for x in cuts)), lambda x: x <= F.col(c)))
    return part


def _reach_by_parts(step: DataFrame, sources: DataFrame, most_rounds: int) -> DataFrame:
    """Reachability of a graph that is larger than one task takes. Edges are cut by
    their starts into parts of about LOCAL_EDGES; neighbouring ids, which mostly are
    neighbours on the ground, fall into one part. In a round every part with new
    nodes walks on inside itself until nothing changes, and hands what it reaches
    outside to the next round. So there are as many rounds as the ways change parts,
    not as they have edges; fewer hops found later are led on like new nodes."""
    kind = step.schema["u"].dataType
    part = _parts(step)
    step = stored(step.withColumn("part", part("u")), "parts")
    name = kind.simpleString()
    schema = f"node_id {name}, hops int, outside boolean"

    def walk(edges: pd.DataFrame, front: pd.DataFrame) -> pd.DataFrame:
        ids, code = np.unique(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy(), front["node_id"].to_numpy()]), return_inverse=True)
        n = len(edges)
        start, near = _onward(code[:n], code[n : 2 * n], len(ids))
        own = np.zeros(len(ids), bool)
        own[code[:n]] = True
        never = np.iinfo(np.int64).max // 2
        hops = np.full(len(ids), never)
        np.minimum.at(hops, code[2 * n :], front["hops"].to_numpy(np.int64))
        first = hops.copy()
        at = np.unique(code[2 * n :])
        while len(at):
            size = start[at + 1] - start[at]
            edge = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[at], size)
            to, new = near[edge], np.repeat(hops[at] + 1, size)
            better = new < hops[to]
            np.minimum.at(hops, to[better], new[better])
            at = np.unique(to[better])
        got = np.flatnonzero(hops < first)
        return pd.DataFrame({"node_id": ids[got], "hops": hops[got].astype("i4"), "outside": ~own[got]})

    seen = front = cut(sources.select("node_id").where("node_id IS NOT NULL").distinct().withColumn("hops", F.lit(0)))
    for _ in range(most_rounds):
        front = front.withColumn("part", part("node_id"))
        at = step.join(front.select("part").distinct(), "part", "left_semi")
        new = at.groupBy("part").cogroup(front.groupBy("part")).applyInPandas(lambda e, f: walk(e, f), schema)
        new = new.groupBy("node_id").agg(F.min("hops").alias("hops"), F.max("outside").alias("outside"))
        old = seen.withColumnRenamed("hops", "_old")
        new = cut(new.join(old, "node_id", "left").where("_old IS NULL OR hops < _old").select("node_id", "hops", "outside"))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new.drop("outside")).groupBy("node_id").agg(F.min("hops").alias("hops")))
        front = new.where("outside").drop("outside")
    raise RuntimeError("reachability did not settle")


def strong_components(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """``(node_id, component)``: strong components, named by their smallest node.

    Nodes joined in both directions are in one component and are contracted
    first, which leaves little of a road graph; what does not fit one task then is
    settled part by part.
    """
    directed = stored(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").distinct(), "directed")
    both_ways = directed.intersect(directed.select(F.col("v").alias("u"), F.col("u").alias("v")))
    base = stored(components(both_ways, ends(edges)), "two-way")
    name = lambda c: base.select(F.col("node_id").alias(c), F.col("component").alias(f"c{c}"))
    left = cut(directed.join(name("u"), "u").join(name("v"), "v").where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())
    names = _strong_names(left, most_rounds).select(F.col("node_id").alias("_c"), F.col("component").alias("_name"))
    return cut(base.join(names, F.col("component") == F.col("_c"), "left").select("node_id", F.coalesce("_name", "component").alias("component")))


def _strong_names(left: DataFrame, most_rounds: int) -> DataFrame:
    """``(node_id, component)`` of distinct edges ``(u, v)`` without loops.

    A graph that is larger than one task takes is cut into parts by its ids. Each
    part is reduced to the ways between its border nodes, those with edges to other
    parts, and the reduced graph is settled in the same manner, by fewer parts or in
    one task. Then each part takes border nodes of one component as one node: ways
    through it are closed by that, so its own components are right. A graph that
    its parts do not reduce by a fifth is settled in rounds.
    """
    if few(left, LOCAL_EDGES):
        return _in_one_task(left, _strong, "component")
    part = _parts(left)
    name = left.schema["u"].dataType.simpleString()
    both = stored(left.select("u", "v", part("u").alias("part"), part("v").alias("to")), "strong-parts")
    inner, across = both.where("part = to").select("part", "u", "v"), both.where("part <> to")
    border = across.select(F.explode(F.array(F.struct("part", F.col("u").alias("n")), F.struct(F.col("to").alias("part"), F.col("v").alias("n")))).alias("b")).select("b.part", "b.n").distinct()
    marked = inner.unionByName(border.select("part", F.col("n").alias("u"), F.col("n").alias("v")))
    ways = marked.groupBy("part").applyInPandas(_border_ways, f"u {name}, v {name}")
    less = stored(across.select("u", "v").unionByName(ways), "border-ways")
    if less.count() > 0.8 * both.count():
        return _strong_in_rounds(left, most_rounds)
    known = _strong_names(less, most_rounds).select("node_id", "component", part("node_id").alias("part"))
    named = stored(inner.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(_strong_within, f"node_id {name}, label {name}"), "strong-names")
    least = named.groupBy("label").agg(F.min("node_id").alias("component"))
    return named.join(least, "label").select("node_id", "component")


def _border_ways(rows: pd.DataFrame) -> pd.DataFrame:
    """The edges of a part, of which rows with ``u = v`` name the border nodes, made
    fewer: the same border nodes reach each other. Components are taken as one node
    each; of those without a border node go all that lead to one other or none,
    or are led to from one or none, their ways leading past them."""
    ids, code = np.unique(np.concatenate([rows["u"].to_numpy(), rows["v"].to_numpy()]), return_inverse=True)
    u, v = code[: len(rows)], code[len(rows) :]
    edge = u != v
    border = np.unique(u[~edge])
    comp, order = _strong_in_order(u[edge], v[edge], len(ids))
    held: dict[int, list[int]] = {}
    for b, c in zip(border.tolist(), comp[border].tolist()):
        held.setdefault(c, []).append(b)
    cu, cv = comp[u[edge]], comp[v[edge]]
    start, near = (x.tolist() for x in _onward(cu[cu != cv], cv[cu != cv], len(ids)))
    past: dict[int, int] = {}  # what a node that is left out leads to, -1 for nothing
    outs: dict[int, set[int]] = {}
    for c in order:
        to = {past.get(d, d) for d in near[start[c] : start[c + 1]]} - {-1}
        if c in held or len(to) > 1:
            outs[c] = to
        else:
            past[c] = to.pop() if to else -1
    ins: dict[int, set[int]] = {c: set() for c in outs}
    for c, to in outs.items():
        for d in to:
            ins[d].add(c)
    for c in reversed(order):
        if c in held or c not in outs or len(ins[c]) > 1:
            continue
        to = outs.pop(c)
        for d in to:
            ins[d].discard(c)
        for p in ins.pop(c):
            outs[p].discard(c)
            outs[p] |= to
            for d in to:
                ins[d].add(p)
    at = lambda c: held[c][0] if c in held else c
    ways = [(at(c), at(d)) for c, to in outs.items() for d in to]
    ways += [w for part in held.values() if len(part) > 1 for w in zip(part, [*part[1:], part[0]])]
    a, b = np.array(ways, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"u": ids[a], "v": ids[b]})


def _strong_within(edges: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Names of all nodes of a part, of which some have theirs from outside."""
    columns = [edges["u"], edges["v"], known["node_id"], known["component"]]
    ids, code = np.unique(np.concatenate([c.to_numpy() for c in columns if len(c)]), return_inverse=True)
    u, v, node, label = np.split(code, np.cumsum([len(c) for c in columns])[:-1])
    one = np.arange(len(ids))
    one[node] = label
    comp = _strong(one[u], one[v], len(ids))
    called = np.arange(len(ids))
    called[comp[label]] = label
    own = np.unique(np.concatenate([u, v, node]))
    return pd.DataFrame({"node_id": ids[own], "label": ids[called[comp[one[own]]]]})


def _strong_in_rounds(left: DataFrame, most_rounds: int) -> DataFrame:
    """The least node that reaches each node is spread forward; nodes that also
    reach that one form its component; they are taken out and the rest goes on."""
    rest = cut(ends(left))
    done = rest.limit(0).withColumn("component", F.col("node_id"))
    for _ in range(most_rounds):
        if rest.isEmpty():
            return done
        state = _spread(left, rest)
        part = cut(_same_colour_backward(left, state).select("node_id", F.col("label").alias("component")))
        done = cut(done.unionByName(part))
        rest = cut(rest.join(part, "node_id", "left_anti"))
        left = cut(
            left.join(rest.withColumnRenamed("node_id", "u"), "u", "left_semi").join(rest.withColumnRenamed("node_id", "v"), "v", "left_semi")
        )
    raise RuntimeError("strong components did not settle")


def _spread(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    state = cut(nodes.withColumn("label", F.col("node_id")))
    while True:
        near = edges.join(state.withColumnRenamed("node_id", "u"), "u").groupBy(F.col("v").alias("node_id")).agg(F.min("label").alias("near"))
        new = cut(state.join(near, "node_id", "left").select("node_id", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        state = new.select("node_id", "label")
        if new.where("label <> old").isEmpty():
            return state


def _same_colour_backward(edges: DataFrame, state: DataFrame) -> DataFrame:
    inner = edges.join(state.select(F.col("node_id").alias("u"), F.col("label").alias("lu")), "u").join(
        state.select(F.col("node_id").alias("v"), F.col("label").alias("lv")), "v"
    )
    inner = cut(inner.where("lu = lv").select("u", "v"))
    roots = state.where("node_id = label").select("node_id")
    return reachable(inner, roots, backward=True).select("node_id").join(state, "node_id")


def fragment_report(edges: DataFrame, members: DataFrame, length: str = "length") -> DataFrame:
    """Per component: nodes, edges and their length."""
    n = members.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.join(members.withColumnRenamed("node_id", "u"), "u").groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(length).alias("length"))
    return n.join(e, "component", "left").fillna(0, ["n_edges"])


def infrastructure_report(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per component what a fragment is worth: nodes, edges, length, edges per road
    class, edges of major roads, bridges and tunnels, and its box. Missing columns
    count nothing; edges without a class are ``unknown``."""
    has = set(edges.columns)
    col = lambda c, kind: F.col(c).cast(kind) if c in has else F.lit(None).cast(kind)
    classes = F.col("highway") if "highway" in has and edges.schema["highway"].dataType.typeName() == "array" else F.array(col("highway", "string"))
    at = edges.join(members.withColumnRenamed("node_id", "u"), "u").select(
        "component", first_class(classes).alias("class"), col("length", "double").alias("length"), (truthy(col("bridge", "string")) | truthy(col("tunnel", "string"))).alias("marked")
    )
    per = at.groupBy("component", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.count_if("marked").alias("marked"))
    e = per.groupBy("component").agg(
        F.sum("n").alias("n_edges"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"), F.sum("marked").alias("bridge_tunnel"),
        F.coalesce(F.sum(F.when(F.col("class").isin(*MAJOR_ROADS), F.col("n"))), F.lit(0)).alias("major"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("classes"),  # one entry per road class
    )
    n = nodes.join(members, "node_id").groupBy("component").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north")
    )
    return n.join(e, "component", "left").fillna(0, ["n_edges", "length", "bridge_tunnel", "major"])


def lost_infrastructure(report: DataFrame) -> DataFrame:
    """Fragments besides the largest component that hold major roads, bridges or
    tunnels, the largest first."""
    best = report.agg(F.max_by("component", F.struct("n_nodes", -F.col("component"))).alias("_kept"))
    return report.join(F.broadcast(best)).where((F.col("component") != F.col("_kept")) & ((F.col("major") > 0) | (F.col("bridge_tunnel") > 0))).drop("_kept").orderBy(F.desc("n_nodes"), "component")


def bridge_tunnel_counts(edges: DataFrame) -> DataFrame:
    """One row: edges marked as bridge and as tunnel."""
    mark = lambda c: F.count_if(truthy(F.col(c))) if c in edges.columns else F.count_if(F.lit(False))
    return edges.agg(mark("bridge").alias("bridges"), mark("tunnel").alias("tunnels"))


def protected(edges: DataFrame) -> Column:
    """Whether cleaning must keep an edge, by the columns there are."""
    col = lambda c, kind="string": F.col(c).cast(kind) if c in edges.columns else F.lit(None).cast(kind)
    classes = F.col("highway") if "highway" in edges.columns and edges.schema["highway"].dataType.typeName() == "array" else F.array(col("highway"))
    return protected_edge(classes, col("layer_role"), col("protected_backbone", "boolean"), col("bridge"), col("tunnel"))


def clean_topology(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loops that are not protected and then nodes without an edge go; repeated
    edge ids get suffixes. A network of which nothing is left is an error."""
    kept = without_self_loops(edges, protected(edges))
    used = used_nodes(nodes, kept)
    if used.isEmpty():
        raise ValueError("the network is empty once loops and lone nodes are removed")
    if "edge_id" in kept.columns:
        kept = unique_edge_ids(kept, [c for c in ("u", "v", "key") if c in kept.columns])
    return used, kept


# -- nodes by place -----------------------------------------------------------------


def invalid_coordinates(nodes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Nodes without coordinates on the globe; null, NaN and infinite ones too."""
    ok = F.col(x).between(-180, 180) & F.col(y).between(-90, 90) & ~F.isnan(x) & ~F.isnan(y)
    return nodes.where(~F.coalesce(ok, F.lit(False)))


def duplicate_coordinates(nodes: DataFrame, digits: int = 7) -> DataFrame:
    """``(first_id, node_id)``: nodes at the rounded place of an earlier one."""
    key = [F.rint(F.col(c) * 10.0**digits).cast("bigint") for c in "xy"]
    at = nodes.where("x IS NOT NULL AND y IS NOT NULL").select("node_id", key[0].alias("i"), key[1].alias("j"))
    first = at.groupBy("i", "j").agg(F.min("node_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return at.join(first, ["i", "j"]).where("node_id <> first_id").select("first_id", "node_id")


def close_nodes(nodes: DataFrame, within: float, metric: str = "chebyshev") -> DataFrame:
    """``(a, b)``, a < b: nodes at most ``within`` apart, by an equi-join on grid
    cells of that size; the pair is found in one of the five cells ahead."""
    if metric not in ("chebyshev", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    at = nodes.where("x IS NOT NULL AND y IS NOT NULL").select("node_id", "x", "y", F.floor(F.col("x") / within).alias("i"), F.floor(F.col("y") / within).alias("j"))
    ahead = F.array(*(F.struct(F.lit(a).cast("bigint").alias("di"), F.lit(b).cast("bigint").alias("dj")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    left = at.select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "i", "j", F.inline(ahead))
    left = left.select("a", "ax", "ay", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), ((F.col("di") == 0) & (F.col("dj") == 0)).alias("same"))
    pairs = left.join(at, ["i", "j"]).where((~F.col("same") & (F.col("a") != F.col("node_id"))) | (F.col("a") < F.col("node_id")))
    dx, dy = F.abs(F.col("ax") - F.col("x")), F.abs(F.col("ay") - F.col("y"))
    near = (dx <= within) & (dy <= within) if metric == "chebyshev" else F.hypot(dx, dy) <= within
    return pairs.where(near).select(F.least("a", "node_id").alias("a"), F.greatest("a", "node_id").alias("b"))


def nearest_nodes(nodes: DataFrame, x: float, y: float, radius: float, k: int = 10) -> DataFrame:
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    near = nodes.where(F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius))
    return near.withColumn("d2", d2).where(F.col("d2") <= radius * radius).orderBy("d2", "node_id").limit(k).select("node_id", "d2")


# -- composition, speeds, simplification -------------------------------------------


def compose(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of layers by key; of each attribute the latest layer's value counts."""
    columns = list(dict.fromkeys(c for df in layers for c in df.columns if c not in keys))
    stacked = None
    for i, df in enumerate(layers):
        df = df.withColumn("_layer", F.lit(i))
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_layer"))).alias(c) for c in columns]
    return stacked.groupBy(*keys).agg(*latest)


def impute_speeds(edges: DataFrame, speed: str = "speed_kph", highway: str = "highway") -> DataFrame:
    """Missing speeds from the mean of the road class, else of all roads. Means
    are small tables joined back, so no class meets in one task."""
    per = edges.groupBy(highway).agg(F.avg(speed).alias("_class"))
    total = edges.agg(F.avg(speed).alias("_all"))
    filled = edges.withColumnRenamed(highway, "_hw").join(F.broadcast(total)).join(
        per.withColumnRenamed(highway, "_ph"), F.col("_hw").eqNullSafe(F.col("_ph")), "left"
    )
    return filled.withColumn(speed, F.coalesce(speed, "_class", "_all")).drop("_ph", "_class", "_all").withColumnRenamed("_hw", highway)


def simplify(edges: DataFrame, same: list[str] | None = None, more: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Chains of edges through nodes where the way only goes on, merged: one way
    in and one way out, or a two-way road between exactly two neighbours, each
    direction of which is a chain of its own.

    ``edges`` need a unique ``edge_id``. A chain is cut where a column of ``same``
    differs and where it would turn back; a node that cuts one direction cuts the
    other too. Gives ``(chain, u, v, n_edges, ...)`` with the tags merged; rings
    are kept whole, from their smallest node. ``more``: how further columns merge.
    """
    e = stored(edges.withColumn("seq", F.col("edge_id")), "edges")
    ins = e.groupBy(F.col("v").alias("node_id")).agg(F.count(F.lit(1)).alias("i"), F.min("u").alias("i_lo"), F.max("u").alias("i_hi"))
    outs = e.groupBy(F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("o"), F.min("v").alias("o_lo"), F.max("v").alias("o_hi"))
    one_way = "i = 1 AND o = 1 AND i_lo <> o_lo"
    two_way = "i = 2 AND o = 2 AND i_lo < i_hi AND i_lo = o_lo AND i_hi = o_hi"
    through = ins.join(outs, "node_id").where(f"(({one_way}) OR ({two_way})) AND node_id NOT IN (i_lo, i_hi)").select("node_id", "i")
    a = e.select(F.col("edge_id").alias("before"), F.col("u").alias("u_a"), F.col("v").alias("node_id"), *(F.col(c).alias(f"a_{c}") for c in same or []))
    b = e.select(F.col("edge_id").alias("after"), F.col("u").alias("node_id"), F.col("v").alias("v_b"), *(F.col(c).alias(f"b_{c}") for c in same or []))
    links = through.join(a, "node_id").join(b, "node_id").where("u_a <> v_b")
    for c in same or []:
        links = links.where(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")))
    links = stored(links.select("node_id", "before", "after", "i"), "passages")
    whole = links.groupBy("node_id", "i").agg(F.count(F.lit(1)).alias("n")).where("n = i").select("node_id")
    links = links.join(whole, "node_id")
    links = stored(links.select(F.col("before").alias("u"), F.col("after").alias("v"), "node_id"), "links")
    chains = components(links, e.select(F.col("edge_id").alias("node_id"))).select(F.col("node_id").alias("edge_id"), F.col("component").alias("chain"))
    member = stored(e.join(chains, "edge_id"), "chains")
    passed = links.select("node_id").distinct()
    start = member.join(passed.withColumnRenamed("node_id", "u"), "u", "left_anti").select("chain", "u")
    stop = member.join(passed.withColumnRenamed("node_id", "v"), "v", "left_anti").select("chain", "v")
    ring = member.groupBy("chain").agg(F.min("u").alias("r"))
    merged = merge_edges(member.drop("u", "v"), "chain", more=more).join(start, "chain", "left").join(stop, "chain", "left").join(ring, "chain")
    merged = merged.withColumns({"u": F.coalesce("u", "r"), "v": F.coalesce("v", "r")}).drop("r")
    for c in ("osmid", "geometry"):
        if c not in e.columns:
            continue
        if c == "osmid":
            ids = member.groupBy("chain").agg(F.array_sort(F.collect_set(F.col("osmid").cast("string"))).alias("osmid"))  # a chain's own
            merged = merged.join(ids, "chain", "left")
        else:
            sides = member.groupBy("chain").agg(F.collect_list(F.struct("u", "v", "geometry")).alias("_sides"))  # a chain's own
            merged = merged.join(sides, "chain", "left").withColumn("geometry", _chain_line("u", "_sides")).drop("_sides")
    return merged


def _chain_line(start: str, sides: str) -> Column:
    """The line of a chain from its first node along its edges; null if one of them
    has none."""

    @F.pandas_udf("binary")
    def line(at, chains):
        out = []
        for u, chain in zip(at, chains):
            onward = {s["u"]: s for s in chain}
            points = []
            for _ in range(len(chain)):
                s = onward.get(u)
                parts = line_parts(s["geometry"]) if s is not None else []
                if not parts:
                    points = None
                    break
                for p in parts:
                    points += p.tolist()[1 if points and points[-1] == p[0].tolist() else 0 :]
                u = s["v"]
            out.append(dumps(("line", [np.array(points)])) if points else None)
        return pd.Series(out)

    return line(F.col(start), F.col(sides))


def _near_groups(nodes: DataFrame, within: float) -> DataFrame:
    """``(node_id, component)``: nodes that steps of at most ``within`` (Euclidean)
    connect, each group under one name; its pairs are never listed. A node without a
    place is in no group with others.

    Cells are so small that the nodes of one are near each other, so only cells are
    linked. Of two cells, whose near nodes are at most two cells apart, first the
    outermost nodes of eight directions are tested, which settles cells that are
    full; else the nodes of the one in reach of the other's box meet its nodes.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    placed = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    at = nodes.where("node_id IS NOT NULL").select("node_id", F.when(placed, x).alias("x"), F.when(placed, y).alias("y"))
    places = stored(at.where("x IS NOT NULL").groupBy("x", "y").agg(F.min("node_id").alias("node_id")), "places")
    if not places.where(F.greatest(F.abs("x"), F.abs("y")) > 1e12 * within).isEmpty():  # cells would not be told apart
        return components(close_nodes(at, within, "euclidean").select(F.col("a").alias("u"), F.col("b").alias("v")), at)
    side = 0.6 * within
    grid = lambda df: df.withColumns({"i": F.floor(F.col("x") / side), "j": F.floor(F.col("y") / side)})
    point = F.struct("x", "y")
    outer = [f(point, by) for by in (F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")) for f in (F.min_by, F.max_by)]
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    cells = stored(grid(places).groupBy("i", "j").agg(F.min("node_id").alias("cell"), *box, F.array_distinct(F.array(*outer)).alias("outer")), "cells")
    ahead = F.array(*(F.struct(F.lit(a).cast("bigint").alias("di"), F.lit(b).cast("bigint").alias("dj")) for a in range(3) for b in range(-2, 3) if (a, b) > (0, 0)))
    left = cells.select(F.col("cell").alias("a"), "i", "j", F.inline(ahead)).select("a", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    pairs = left.join(cells.select(F.col("cell").alias("b"), "i", "j"), ["i", "j"]).select("a", "b")
    whole = lambda k: cells.select(F.col("cell").alias(k), *(F.col(c).alias(f"{k}{c}") for c in ("x0", "x1", "y0", "y1", "outer")))
    gap = lambda c: F.greatest(F.col(f"b{c}0") - F.col(f"a{c}1"), F.col(f"a{c}0") - F.col(f"b{c}1"), F.lit(0.0))
    met = F.exists("aouter", lambda p: F.exists("bouter", lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]) <= within))
    near = pairs.join(whole("a"), "a").join(whole("b"), "b").where(F.hypot(gap("x"), gap("y")) <= within)
    near = stored(near.select("a", "b", *(f"b{c}" for c in ("x0", "x1", "y0", "y1")), met.alias("met")), "cell-pairs")
    of = grid(places).join(cells.select("i", "j", "cell"), ["i", "j"])
    p = of.select(F.col("cell").alias("a"), F.col("x").alias("px"), F.col("y").alias("py"))
    q = of.select(F.col("cell").alias("b"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    off = lambda c: F.greatest(F.col(f"b{c}0") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"b{c}1"), F.lit(0.0))
    tried = near.where("NOT met").join(p, "a").where(F.hypot(off("x"), off("y")) <= within).select("a", "b", "px", "py")
    tried = tried.join(q, "b").where(F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy")) <= within)
    links = near.where("met").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(tried.select(F.col("a").alias("u"), F.col("b").alias("v")))
    held = grid(at).join(cells.select("i", "j", "cell"), ["i", "j"], "left").select("node_id", "cell")
    own = stored(held.groupBy("node_id").agg(F.min("cell").alias("u"), F.max("cell").alias("most")), "in-cells")
    apart = own.where("u <> most")
    if not apart.isEmpty():  # an id that stands at several places ties their cells
        links = links.unionByName(held.where("cell IS NOT NULL").withColumnRenamed("cell", "v").join(apart, "node_id").select("u", "v"))
    group = components(stored(links, "cell-links"), cells.select(F.col("cell").alias("node_id"))).withColumnRenamed("node_id", "u")
    return own.join(small_side(group), "u", "left").select("node_id", "component")


def consolidate(nodes: DataFrame, edges: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Nodes whose circles of ``tolerance`` overlap and that the edges among them
    connect become one at their mean place; edges are led to it and those within
    one are dropped."""
    group = stored(_near_groups(nodes, 2 * tolerance), "groups")
    g = lambda c: group.select(F.col("node_id").alias(c), F.col("component").alias(f"g{c}"))
    near = F.coalesce(F.expr("gu = gv AND u <> v"), F.lit(False)).alias("_near")
    known = stored(edges.join(g("u"), "u").join(g("v"), "v").select(*edges.columns, near), "known-edges")
    # mostly few nodes get another's name, so neither edges nor nodes are moved again
    other = small_side(components(known.where("_near").select("u", "v")).where("node_id <> component"))
    merged = nodes.where("node_id IS NOT NULL").join(other, "node_id", "left").groupBy(F.coalesce("component", "node_id").alias("node_id"))
    merged = merged.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n_nodes"))
    c = lambda k: other.select(F.col("node_id").alias(k), F.col("component").alias(f"c{k}"))
    led = known.drop("_near").join(c("u"), "u", "left").join(c("v"), "v", "left").withColumns({f"c{k}": F.coalesce(f"c{k}", k) for k in "uv"})
    led = led.where("cu <> cv OR u = v").drop("u", "v").withColumnsRenamed({"cu": "u", "cv": "v"})
    return merged, led


def validate(
    nodes: DataFrame, edges: DataFrame, within: float = 0.5, extract: DataFrame | None = None, plane: DataFrame | None = None
) -> DataFrame:
    """One row of counts by which a built network is judged; with the elements of
    its ``extract`` also its repeated places and dangling references. ``plane``: the
    nodes in metres, where they are given in degrees."""
    from .diagnose import dangling_way_nodes, edge_quality

    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    loop, kept = F.coalesce(F.col("u") == F.col("v"), F.lit(False)), protected(edges)
    loops = edges.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(loop).alias("self_loops"), F.count_if(loop & kept).alias("protected_self_loops"), F.count_if(loop & ~kept).alias("unprotected_self_loops")
    )
    alone = isolates(nodes, edges).agg(F.count(F.lit(1)).alias("isolates"))
    twins = duplicate_coordinates(nodes).agg(F.count(F.lit(1)).alias("duplicate_coordinates"))
    near = close_nodes(nodes if plane is None else plane, within).agg(F.count(F.lit(1)).alias("close_pairs"))
    parts = components(edges, nodes).agg(F.count_distinct("component").alias("components"))
    out = edge_quality(edges)
    more = [n, loops, alone, twins, near, parts]
    if extract is not None:
        at = extract.where("type = 'node'")
        more.append(at.agg((F.count(F.lit(1)) - F.count_distinct("lat", "lon")).alias("xml_duplicate_coordinates")))
        more.append(dangling_way_nodes(extract).agg(F.count(F.lit(1)).alias("xml_dangling_refs")))
    for one in more:
        out = out.join(F.broadcast(one))  # one row each
    return out


#: Counts that must be zero in a valid network.
FAULTS = (
    "unprotected_self_loops", "isolates", "duplicate_coordinates", "close_pairs", "missing_edge_id", "missing_length", "nonpositive_length",
    "missing_speed_kph", "invalid_oneway_values", "missing_geometry", "xml_duplicate_coordinates", "xml_dangling_refs",
)


def assert_valid(summary: DataFrame) -> None:
    """Raises one error that names every count that must be zero and is not, and
    a network that is not one part."""
    row = summary.first().asDict()
    wrong = [f"{k} = {row[k]}" for k in FAULTS if row.get(k)]
    if row.get("components") != 1:
        wrong.append(f"components = {row.get('components')}")
    if wrong:
        raise RuntimeError("the network is not valid: " + ", ".join(wrong))
