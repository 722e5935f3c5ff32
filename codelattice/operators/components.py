"""Cycles, strongly connected components, feedback cuts and communities."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_table as cut
from ..session import cut_union

# fixed values: how strongly an edge kind ties its ends into one community
TIE_WEIGHTS = {"CALLS": 100, "INHERITS": 80, "IMPLEMENTS": 70, "DEPENDS_ON": 60, "CROSS_ARTIFACT": 60, "IMPORTS_FROM": 50, "TESTED_BY": 40, "CONTAINS": 30}
DEFAULT_TIE = 50

STEPS_PER_CUT = 2  # joins between two checkpoints of a loop
IN_ONE_CALL = 1_000_000  # arcs one task holds as numbers; the way by joins goes on until no more are left, and comes to the same


def trim_acyclic(links: DataFrame, enough: int = 0) -> DataFrame:
    """Links that can lie on a cycle: links out of nodes without a predecessor or into nodes without a successor are peeled off, until at most ``enough`` are left."""
    current = cut(links.select("src", "dst").filter("src <> dst").distinct())
    count = current.count()
    while count > enough:
        for _ in range(STEPS_PER_CUT):
            heads = current.select(F.col("dst").alias("_d")).distinct()
            tails = current.select(F.col("src").alias("_s")).distinct()
            current = current.join(heads, F.col("src") == F.col("_d"), "left_semi").join(tails, F.col("dst") == F.col("_s"), "left_semi")
        current = cut(current)
        left = current.count()
        if left == count:
            break
        count = left
    return current


def numbered(table) -> tuple[list[str], list[np.ndarray]]:
    """The names of an Arrow table's string columns in order, and each column as positions among them."""
    every = pa.chunked_array([c.cast(pa.string()) for column in table.columns for c in column.chunks], pa.string())
    names = every.unique()
    names = names.take(pc.sort_indices(names))
    return names.to_pylist(), [pc.index_in(c, names).to_numpy() for c in table.columns]


def strong_parts(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node of its strongly connected component, by Tarjan's algorithm; -1 where that is one node."""
    order = np.argsort(src, kind="stable")
    heads, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    at, seen, low, on, stack, clock = first[:n], [0] * n, [0] * n, bytearray(n), [], 0
    part = np.full(n, -1)
    for root in range(n):
        path = [] if seen[root] else [root]
        while path:
            node = path[-1]
            if not seen[node]:
                clock += 1
                seen[node] = low[node] = clock
                stack.append(node)
                on[node] = 1
            if at[node] < first[node + 1]:
                head = heads[at[node]]
                at[node] += 1
                if not seen[head]:
                    path.append(head)
                elif on[head] and seen[head] < low[node]:
                    low[node] = seen[head]
                continue
            path.pop()
            if path and low[node] < low[path[-1]]:
                low[path[-1]] = low[node]
            if low[node] == seen[node]:
                members = [stack.pop()]
                while members[-1] != node:
                    members.append(stack.pop())
                for x in members:
                    on[x] = 0
                if len(members) > 1:
                    part[members] = min(members)
    return part


def _strong_parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if held := list(batches):
        names, (src, dst) = numbered(pa.Table.from_batches(held))
        part = strong_parts(len(names), src, dst)
        on_cycle = np.flatnonzero(part >= 0)
        yield pa.RecordBatch.from_pydict({"node": pa.array([names[i] for i in on_cycle], pa.string()), "component": pa.array([names[i] for i in part[on_cycle]], pa.string())})


def strongly_connected(links: DataFrame, in_one_call: int = IN_ONE_CALL) -> DataFrame:
    """``node, component`` for every node on a cycle; the component is its smallest node.

    Colouring: the smallest label is pushed forwards to a fixpoint; within one
    colour, the nodes from which the root can be reached backwards are a
    component; these are taken out and the rest is coloured again. As soon as
    at most ``in_one_call`` links are left, one task finds what they hold.
    """
    rest = trim_acyclic(links, in_one_call)
    found = None
    while rest.count() > in_one_call:
        colour = cut(rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct().withColumn("label", F.col("node")))
        while True:
            before = colour.select(F.col("node").alias("_was"), F.col("label").alias("_label"))
            for _ in range(STEPS_PER_CUT):
                pushed = rest.join(colour, F.col("src") == F.col("node")).select(F.col("dst").alias("_n"), F.col("label").alias("_l")).groupBy("_n").agg(F.min("_l").alias("_l"))
                colour = colour.join(pushed, F.col("node") == F.col("_n"), "left").select("node", F.least("label", "_l").alias("label"))
            joined = cut(colour.join(before, F.col("node") == F.col("_was")).select("node", "label", (F.col("label") < F.col("_label")).alias("moved")))
            colour = joined.select("node", "label")
            if joined.filter("moved").isEmpty():
                break
        a, b = colour.select(F.col("node").alias("_a"), F.col("label").alias("la")), colour.select(F.col("node").alias("_b"), F.col("label").alias("lb"))
        inner = cut(rest.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).filter("la = lb").select("src", "dst", F.col("la").alias("label")))
        back = colour.filter("node = label").select("node", F.col("label").alias("component"))
        frontier = back
        while True:
            step = frontier.select(F.col("node").alias("_to"), "component").join(inner, (F.col("_to") == F.col("dst")) & (F.col("component") == F.col("label"))).select(F.col("src").alias("node"), "component").distinct()
            frontier = cut(step.join(back.select(F.col("node").alias("_seen")), F.col("node") == F.col("_seen"), "left_anti"))
            if frontier.isEmpty():
                break
            back = cut_union(back.unionByName(frontier))
        sizes = back.groupBy("component").count().filter("count > 1").select(F.col("component").alias("_c"))
        part = cut(back.join(sizes, F.col("component") == F.col("_c"), "left_semi"))
        found = part if found is None else found.unionByName(part)
        gone = back.select(F.col("node").alias("_gone"))
        rest = trim_acyclic(rest.join(gone, F.col("src") == F.col("_gone"), "left_anti").join(gone, F.col("dst") == F.col("_gone"), "left_anti"), in_one_call)
    told = cut(rest.repartition(1).mapInArrow(_strong_parts_of, "node string, component string"))
    return told if found is None else found.unionByName(told)


def two_cycles(links: DataFrame) -> DataFrame:
    """Pairs (a < b) that link to each other, with the weight of both ways."""
    weighted = links.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    back = weighted.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("weight").alias("weight_back"))
    return weighted.filter("src < dst").join(back, (F.col("src") == F.col("_d")) & (F.col("dst") == F.col("_s"))).select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight", "weight_back")


def short_cycles(links: DataFrame, max_length: int = 3) -> DataFrame:
    """Simple cycles of up to ``max_length`` nodes, each once from its smallest node, as ``length, path``."""
    step = cut(trim_acyclic(links))
    paths = step.filter("src < dst").select(F.array("src", "dst").alias("nodes"))
    found = None
    for length in range(2, max_length + 1):
        closing = step.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        closed = paths.join(closing, (F.element_at("nodes", -1) == F.col("_s")) & (F.col("nodes")[0] == F.col("_d")), "left_semi").select(F.lit(length).cast("long").alias("length"), F.array_join("nodes", " > ").alias("path"))
        found = closed if found is None else found.unionByName(closed)
        if length < max_length:
            grown = paths.join(closing, F.element_at("nodes", -1) == F.col("_s"))
            paths = cut(grown.filter((F.col("_d") > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col("_d"))).select(F.concat("nodes", F.array("_d")).alias("nodes")))
    return found


def circuits(arcs: list[tuple[str, str]], max_cycles: int, max_steps: int) -> tuple[list[list[str]], bool]:
    """Simple cycles of one graph by Johnson's algorithm, each from its smallest node, and whether a bound ended the search.

    A node is blocked while no cycle through it can close; when one closes,
    the nodes that wait for it are freed. So every cycle costs at most one
    pass over the arcs, also where dead ends abound.
    """
    heads: dict[str, list[str]] = {}
    for a, b in sorted(set(arcs)):
        heads.setdefault(a, []).append(b)
    found: list[list[str]] = []
    steps = 0
    for root in sorted(heads):
        blocked, waits = {root}, {}
        # a frame: node, the heads still to try, whether a cycle closed below it
        stack = [[root, (h for h in heads[root] if h >= root), False]]
        while stack:
            node, todo, _ = stack[-1]
            steps += 1
            if steps > max_steps:
                return found, True
            head = next(todo, None)
            if head is None:
                closed = stack.pop()[2]
                if closed:
                    free = [node]
                    while free:
                        freed = free.pop()
                        blocked.discard(freed)
                        free += waits.pop(freed, ())
                    if stack:
                        stack[-1][2] = True
                else:
                    for h in heads.get(node, ()):
                        if h >= root:
                            waits.setdefault(h, set()).add(node)
            elif head == root:
                if len(found) == max_cycles:
                    return found, True
                found.append([frame[0] for frame in stack])
                stack[-1][2] = True
            elif head not in blocked:
                blocked.add(head)
                stack.append([head, (h for h in heads.get(head, ()) if h >= root), False])
    return found, False


def arcs_within(links: DataFrame, components: DataFrame) -> DataFrame:
    """``component, src, dst`` of the distinct links between nodes of one component."""
    a, b = components.select(F.col("node").alias("_a"), F.col("component").alias("ca")), components.select(F.col("node").alias("_b"), F.col("component").alias("cb"))
    inner = links.filter("src <> dst").select("src", "dst").distinct().join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).filter("ca = cb")
    return inner.select(F.col("ca").alias("component"), "src", "dst")


def simple_cycles(links: DataFrame, components: DataFrame, max_cycles: int = 200, max_steps: int = 500_000) -> DataFrame:
    """Simple cycles of any length, one component per call, as ``component, length, path, truncated``.

    Where a bound ended the search of a component, ``truncated`` is set on all its rows; if nothing was found by then, one row without path says so.
    """

    def search(pdf):
        import pandas as pd

        cycles, truncated = circuits(list(zip(pdf["src"], pdf["dst"])), max_cycles, max_steps)
        told = [(len(x), " > ".join(x)) for x in cycles] or [(None, None)]
        out = pd.DataFrame([(pdf["component"].iloc[0], *x, truncated) for x in told], columns=["component", "length", "path", "truncated"])
        return out.astype({"length": "Int64"})

    return arcs_within(links, components).groupBy("component").applyInPandas(search, "component string, length long, path string, truncated boolean")


def feedback_cut(weighted: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """Arcs whose removal breaks all cycles of one component: those that point backwards in a greedy order of sources and sinks."""
    out: dict[str, dict[str, int]] = {}
    into: dict[str, dict[str, int]] = {}
    left = {x for a, b, _ in weighted for x in (a, b)}
    for a, b, w in weighted:
        if a != b:
            out.setdefault(a, {})[b] = out.get(a, {}).get(b, 0) + w
            into.setdefault(b, {})[a] = out[a][b]
    leaves, enters = {x: sum(out.get(x, {}).values()) for x in left}, {x: sum(into.get(x, {}).values()) for x in left}
    head, tail, sinks, sources, rated = [], [], [], [], []

    def rate(x):
        heapq.heappush(sinks if not leaves[x] else sources if not enters[x] else rated, (enters[x] - leaves[x], x) if leaves[x] and enters[x] else x)

    def take(x):
        left.discard(x)
        for table, degrees in ((out, enters), (into, leaves)):
            for y, w in table.get(x, {}).items():
                if y in left:
                    degrees[y] -= w
                    rate(y)

    for x in left:
        rate(x)
    while left:
        if sinks:
            if (x := heapq.heappop(sinks)) in left:
                tail.append(x)
                take(x)
        elif sources:
            if (x := heapq.heappop(sources)) in left:
                head.append(x)
                take(x)
        else:
            gap, x = heapq.heappop(rated)
            if x in left and gap == enters[x] - leaves[x]:  # else it was rated anew
                head.append(x)
                take(x)
    at = {x: i for i, x in enumerate(head + tail[::-1])}
    return sorted((a, b, w) for a, targets in out.items() for b, w in targets.items() if at[a] > at[b])


def cyclic_arcs(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """:func:`trim_acyclic` of numbered arcs: the positions of those that are left."""
    kept = np.arange(len(src))
    for _ in range(20):
        stays = (np.bincount(dst[kept], minlength=n) > 0)[src[kept]] & (np.bincount(src[kept], minlength=n) > 0)[dst[kept]]
        if stays.all():
            return kept
        kept = kept[stays]
    # long chains are left: node by node
    a, b = src[kept], dst[kept]
    dead = np.zeros(n, bool)
    for tails, heads in ((a, b), (b, a)):
        order = np.argsort(tails, kind="stable")
        ahead, first = heads[order].tolist(), np.searchsorted(tails[order], np.arange(n + 1)).tolist()
        waits = np.bincount(heads[~dead[tails]], minlength=n).tolist()
        free = [x for x in np.flatnonzero(~dead).tolist() if not waits[x]]
        while free:
            x = free.pop()
            dead[x] = True
            for y in ahead[first[x] : first[x + 1]]:
                waits[y] -= 1
                if not waits[y] and not dead[y]:
                    free.append(y)
    return kept[~dead[a] & ~dead[b]]


def local_best_cuts(ties: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`cut_local_bests` of numbered arcs until at most ``largest`` are left: the positions of arcs to cut and of arcs left."""
    n, left, gone = len(ties), np.arange(len(src)), []
    while len(left) > largest:
        a, b, w = src[left], dst[left], weight[left]
        leaves, enters = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(leaves, a, w)
        np.add.at(enters, b, w)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((np.arange(n), ties, np.abs(leaves - enters)))] = np.arange(n)
        best = np.zeros(n, bool)
        best[a] = best[b] = True
        best[np.where(rank[a] < rank[b], a, b)] = False
        cuts = (best & (enters <= leaves))[b] | (best & (enters > leaves))[a]
        gone.append(left[cuts])
        left = left[~cuts]
        left = left[cyclic_arcs(n, src[left], dst[left])]
    return np.concatenate(gone) if gone else left[:0], left


def component_cuts(links: DataFrame, components: DataFrame, largest: int = 5_000, in_one_call: int = IN_ONE_CALL) -> DataFrame:
    """Feedback arcs of every component: those of a greedy order for at most ``largest`` arcs; larger components are first reduced to that by rounds of local cuts.

    One component is one call; the rounds run in it from ``in_one_call`` arcs on, by joins before.
    """
    a, b = components.select(F.col("node").alias("_a"), F.col("component").alias("ca")), components.select(F.col("node").alias("_b"), F.col("component").alias("cb"))
    inner = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).filter("ca = cb AND src <> dst")
    inner = cut(inner.select(F.col("ca").alias("component"), "src", "dst", "weight"))

    def cut_one(table):
        names, (src, dst) = numbered(table.select(["src", "dst"]))
        weight, ties = table["weight"].to_numpy(), np.zeros(len(names), np.int64)
        ties[src], ties[dst] = table["src_tie"].to_numpy(), table["dst_tie"].to_numpy()
        gone, left = local_best_cuts(ties, src, dst, weight, largest)
        arcs = [(names[src[i]], names[dst[i]], int(weight[i])) for i in gone]
        arcs += feedback_cut([(names[src[i]], names[dst[i]], int(weight[i])) for i in left])
        columns = list(zip(*arcs)) or [[], [], []]
        return pa.table({"component": pa.array([table["component"][0].as_py()] * len(arcs), pa.string()), **{c: pa.array(columns[i], pa.int64() if c == "weight" else pa.string()) for i, c in enumerate(("src", "dst", "weight"))}})

    def apart(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
        sizes = arcs.groupBy(F.col("component").alias("_c")).agg(F.count(F.lit(1)).alias("arcs"))
        big = sizes.filter(F.col("arcs") > max(largest, in_one_call))
        return arcs.join(big, F.col("component") == F.col("_c"), "left_anti"), cut(arcs.join(big, F.col("component") == F.col("_c"), "left_semi"))

    small, large = apart(inner)
    found = None
    while not large.isEmpty():
        taken, left = cut_local_bests(large)
        found = taken if found is None else cut_union(found.unionByName(taken))
        rest, large = apart(left)
        small = cut_union(small.unionByName(rest))
    told = small.withColumns({"src_tie": F.xxhash64("src"), "dst_tie": F.xxhash64("dst")}).groupBy("component").applyInArrow(cut_one, "component string, src string, dst string, weight long")
    return told if found is None else told.unionByName(found)


def cut_local_bests(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of the greedy order on all nodes at once: arcs to cut, and the arcs that can still lie on a cycle.

    Nodes whose lighter side saves more than that of any neighbour (ties by
    hash and name) lose the arcs of that side and so lie on no cycle; no two of
    them are neighbours, and the best of all is always among them.
    """
    sides = arcs.select(F.col("src").alias("node"), F.col("weight").alias("out"), F.lit(0).cast("long").alias("into")).unionByName(arcs.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("out"), F.col("weight").alias("into")))
    rated = cut(sides.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).select("node", (F.col("into") <= F.col("out")).alias("leads"), F.struct(F.abs(F.col("out") - F.col("into")).alias("gain"), F.xxhash64("node").alias("tie"), "node").alias("rank")))
    a, b = rated.select(F.col("node").alias("_a"), F.col("rank").alias("ra")), rated.select(F.col("node").alias("_b"), F.col("rank").alias("rb"))
    ranked = arcs.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b"))
    beaten = ranked.select(F.when(F.col("ra") < F.col("rb"), F.col("src")).otherwise(F.col("dst")).alias("_beaten")).distinct()
    best = cut(rated.join(beaten, F.col("node") == F.col("_beaten"), "left_anti").select("node", "leads"))
    heads, tails = best.filter("leads").select(F.col("node").alias("_head")), best.filter("NOT leads").select(F.col("node").alias("_tail"))
    marked = arcs.join(heads, F.col("dst") == F.col("_head"), "left").join(tails, F.col("src") == F.col("_tail"), "left")
    marked = cut(marked.select(*arcs.columns, (F.col("_head").isNotNull() | F.col("_tail").isNotNull()).alias("gone")))
    kept = marked.filter("NOT gone").drop("gone")
    cyclic = trim_acyclic(kept).select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    left = kept.join(cyclic, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_semi")
    return marked.filter("gone").drop("gone"), cut(left)


def tie_weights(edges: DataFrame) -> DataFrame:
    """Undirected weighted pairs (a < b): the strongest kind of a pair counts."""
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in TIE_WEIGHTS.items()], F.lit(DEFAULT_TIE))
    pairs = edges.filter("source_qualified <> target_qualified").select(F.least("source_qualified", "target_qualified").alias("a"), F.greatest("source_qualified", "target_qualified").alias("b"), weight.alias("w"))
    return pairs.groupBy("a", "b").agg(F.max("w").alias("w"))


def directory_communities(nodes: DataFrame, min_size: int = 2, groups: int = 10, max_depth: int = 12) -> DataFrame:
    """``qualified_name, community``: directories at the smallest depth that yields ``groups`` groups of ``min_size``; else the deepest tried."""
    members = nodes.filter("kind <> 'File'").select("qualified_name", F.split("file_path", "/").alias("parts"))
    for depth in range(1, max_depth + 1):
        grouped = members.withColumn("community", F.array_join(F.slice("parts", F.lit(1), F.least(F.lit(depth), F.size("parts") - 1)), "/"))
        if grouped.groupBy("community").count().filter(F.col("count") >= min_size).limit(groups).count() >= groups:
            break
    return grouped.select("qualified_name", "community")
