"""Communities of high modularity: local moves, refinement, aggregation, level by level.

Every level moves nodes between communities while that gains modularity, then
splits each community again into parts that hold together on their own (moves
within it, from single nodes), and goes on with these parts as nodes, each
starting in the community it came from. So a community never falls apart into
pieces without a tie, which plain moving allows.

All nodes of a turn decide on the same state, and only those whose hash has the
turn's parity move, so two nodes do not swap for ever; a phase ends when next to
nobody wants to move, or when the number of those who do finds no new low. Weights are folded per (node, community) before any decision, and a
community's total is one row, so no hub and no crowd is gathered.

Nodes are numbered first. A level of more than ``IN_ONE_CALL`` ties is a plan of
joins a turn; from there on, one task holds the ties as arrays and does the same
turns, with the same answer, for this and all further levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_table as cut
from ..session import salted_rank

PATIENCE = 0  # turns without a new low of restless nodes that are waited for
SETTLED = 0.01  # share of restless nodes at which a phase ends
LEVEL_LEAST = 0.02  # levels end when one merges fewer nodes than this share
RESOLUTION = 1.0
REGION_LIMIT = 0.5  # share of nodes from which a partial run is a whole one
IN_ONE_CALL = 10_000_000  # ties in both directions that one task holds
TIES_AT_ONCE = 1_000_000  # of these, looked at together


def _moves(both: DataFrame, strength: DataFrame, start: DataFrame, total: float, resolution: float) -> DataFrame:
    """``node, community`` after local moves from ``start``; ``both`` (node, other, w) in both directions, ``strength`` (node, k)."""
    labels, low, waited = start, None, 0
    ties = both.filter("node <> other")
    for turn in count():
        placed = labels.join(strength.select(F.col("node").alias("_k"), "k"), F.col("node") == F.col("_k")).select("node", "community", "k")
        sums = placed.groupBy(F.col("community").alias("_c")).agg(F.sum("k").alias("mass"))
        votes = ties.join(labels.select(F.col("node").alias("_o"), "community"), F.col("other") == F.col("_o")).groupBy("node", "community").agg(F.sum("w").alias("w"))
        # staying is an option even where no neighbour shares the community
        options = votes.unionByName(labels.select("node", "community", F.lit(0).cast("double").alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        own = placed.select(F.col("node").alias("_n"), F.col("community").alias("own"), "k")
        rated = options.join(own, F.col("node") == F.col("_n")).join(sums, F.col("community") == F.col("_c"))
        stays = F.col("community") == F.col("own")
        gain = F.col("w") - resolution * F.col("k") * (F.col("mass") - F.when(stays, F.col("k")).otherwise(0.0)) / total
        best = rated.groupBy("node", "own").agg(F.max(F.when(stays, gain)).alias("stay"), F.min(F.struct((-gain).alias("loss"), "community")).alias("b"))
        wants = (-F.col("b.loss") > F.col("stay") + 1e-9) & (F.col("b.community") != F.col("own"))
        on_turn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        after = cut(best.select("node", F.when(wants & on_turn, F.col("b.community")).otherwise(F.col("own")).alias("community"), wants.alias("wants")))
        labels = after.select("node", "community")
        restless, nodes = after.agg(F.count_if("wants"), F.count(F.lit(1))).first()
        if restless <= SETTLED * nodes:
            return labels
        low, waited = (restless, 0) if low is None or restless < low else (low, waited + 1)
        if waited > PATIENCE:
            return labels


def _on_turn(ids: np.ndarray, turn: int) -> np.ndarray:
    """``pmod(xxhash64(id, turn), 2) = 0`` as Spark computes it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mixed(x):
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = mixed(turned((np.uint64(42) + p5 + np.uint64(8)) ^ (turned(ids.astype(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
        h = mixed(turned((h + p5 + np.uint64(4)) ^ (np.uint64(turn) * p1), 23) * p2 + p3)
    return (h & np.uint64(1)) == 0


def _held_moves(ids: np.ndarray, real: np.ndarray, node: np.ndarray, other: np.ndarray, w: np.ndarray, k: np.ndarray, start: np.ndarray, total: float, resolution: float) -> np.ndarray:
    """:func:`_moves` of ties held in the order of ``node``, all as positions in ``ids``; only positions in ``real`` are nodes."""
    n, labels, low, waited = len(ids), start, None, 0
    first = np.searchsorted(node, np.arange(n + 1))
    bounds = [0]
    while bounds[-1] < n:
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(first, first[bounds[-1]] + TIES_AT_ONCE, side="right")) - 1))
    for turn in count():
        mass = np.bincount(labels[real], k[real], minlength=n)
        after, moving, restless = labels.copy(), _on_turn(ids, turn), 0
        for lo, hi in zip(bounds, bounds[1:]):
            at, here = slice(first[lo], first[hi]), real[np.searchsorted(real, lo) : np.searchsorted(real, hi)]
            if not len(here):
                continue
            # staying is an option even where no neighbour shares the community
            key = np.concatenate([(node[at].astype(np.int64) - lo) * n + labels[other[at]], (here - lo) * n + labels[here]])
            order = np.argsort(key)
            key = key[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            votes = np.add.reduceat(np.concatenate([w[at], np.zeros(len(here))])[order], heads)
            who, where = np.divmod(key[heads], n)
            who += lo
            stays = where == labels[who]
            gain = votes - resolution * k[who] * (mass[where] - np.where(stays, k[who], 0.0)) / total
            heads = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            best, stay = np.maximum.reduceat(gain, heads), gain[stays]
            top = np.minimum.reduceat(np.where(gain == np.repeat(best, np.diff(np.r_[heads, len(gain)])), where, n), heads)
            wants = (best > stay + 1e-9) & (top != labels[here])
            moved = here[wants & moving[here]]
            after[moved] = top[wants & moving[here]]
            restless += int(wants.sum())
        labels = after
        if restless <= SETTLED * len(real):
            return labels
        low, waited = (restless, 0) if low is None or restless < low else (low, waited + 1)
        if waited > PATIENCE:
            return labels


def _held_levels(total: float, resolution: float):
    """A function over batches of ties (node, other, w) and of labels (node, community, no w), all of one level: ``node, community`` after this and all further levels."""

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties, named = [[], [], []], [[], []]
        for batch in batches:
            is_tie = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            x, y, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for held, values in zip(ties, (x, y, w)):
                held.append(values[is_tie])
            for held, values in zip(named, (x, y)):
                held.append(values[~is_tie])
        if not named[0] or not sum(map(len, named[0])):
            return
        entered, labels = (np.concatenate(x) for x in named)
        order = np.argsort(entered)
        entered, labels = entered[order], labels[order]
        node, other, w = (np.concatenate(ties.pop(0)) for _ in range(3))
        nodes, members = entered, np.arange(len(entered))
        while True:
            # positions keep the order of the numbers
            ids = np.unique(np.concatenate([nodes, labels]))
            real, start = np.searchsorted(ids, nodes), np.arange(len(ids))
            start[real] = np.searchsorted(ids, labels)
            order = np.argsort(node, kind="stable")
            node, other, w = np.searchsorted(ids, node[order]).astype(np.int32), np.searchsorted(ids, other[order]).astype(np.int32), w[order]
            k, apart = np.bincount(node, w, minlength=len(ids)), node != other
            labels = _held_moves(ids, real, node[apart], other[apart], w[apart], k, start, total, resolution)
            # refinement: moves inside each community, from single nodes
            inside = apart & (labels[node] == labels[other])
            parts = _held_moves(ids, real, node[inside], other[inside], w[inside], k, np.arange(len(ids)), total, resolution)
            left, part_of = np.unique(parts[real], return_inverse=True)
            whole = np.full(len(left), len(ids))
            np.minimum.at(whole, part_of, labels[real])
            members, n, nodes, labels = part_of[members], len(nodes), ids[left], ids[whole]
            if len(left) >= n * (1 - LEVEL_LEAST):
                break
            key = np.searchsorted(left, parts[node]) * len(left) + np.searchsorted(left, parts[other])
            order = np.argsort(key)
            key, w = key[order], w[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            w = np.add.reduceat(w, heads)
            node, other = (nodes[x] for x in np.divmod(key[heads], len(left)))
        yield pa.RecordBatch.from_pydict({"node": pa.array(entered, pa.int64()), "community": pa.array(labels[members], pa.int64())})

    return levels


def modularity_communities(ties: DataFrame, resolution: float = RESOLUTION, in_one_call: int = IN_ONE_CALL) -> DataFrame:
    """``node, community`` of weighted undirected ``ties`` (a, b, w), a community named by its smallest node.

    Ties of a node with itself and ties without a positive weight are left out; an empty frame gives an empty result.
    """
    real = cut(ties.filter("a <> b AND w > 0").select("a", "b", F.col("w").cast("double").alias("w")))
    ids = cut(salted_rank(cut(real.select(F.col("a").alias("name")).union(real.select("b")).distinct()), [], ["name"], "id"))
    p, q = ids.select(F.col("name").alias("_a"), F.col("id").alias("ia")), ids.select(F.col("name").alias("_b"), F.col("id").alias("ib"))
    pairs = real.join(p, F.col("a") == F.col("_a")).join(q, F.col("b") == F.col("_b"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("ia").alias("node"), F.col("ib").alias("other"), "w"), F.struct(F.col("ib").alias("node"), F.col("ia").alias("other"), "w"))).alias("t")).select("t.*")
    both = cut(both.groupBy("node", "other").agg(F.sum("w").alias("w")))
    total, held = both.agg(F.sum("w"), F.count(F.lit(1))).first()
    if not total:
        return real.select(F.col("a").alias("node"), F.col("a").alias("community"))
    labels = ids.select(F.col("id").alias("node"), F.col("id").alias("community"))
    members = ids.select(F.col("id").alias("origin"), F.col("id").alias("node"))
    n = ids.count()
    while held > in_one_call:
        strength = cut(both.groupBy("node").agg(F.sum("w").alias("k")))
        labels = _moves(both, strength, labels, total, resolution)
        # refinement: moves inside each community, from single nodes
        a, b = labels.select(F.col("node").alias("_a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("_b"), F.col("community").alias("cb"))
        inner = cut(both.join(a, F.col("node") == F.col("_a")).join(b, F.col("other") == F.col("_b")).filter("ca = cb").select("node", "other", "w"))
        parts = _moves(inner, strength, strength.select("node", F.col("node").alias("community")), total, resolution)
        members = cut(members.join(parts.select(F.col("node").alias("_n"), F.col("community").alias("_p")), F.col("node") == F.col("_n")).select("origin", F.col("_p").alias("node")))
        left = members.select("node").distinct().count()
        whole = labels.join(parts.select(F.col("node").alias("_n"), F.col("community").alias("part")), F.col("node") == F.col("_n")).groupBy("part").agg(F.min("community").alias("community"))
        labels = cut(whole.select(F.col("part").alias("node"), "community"))
        if left >= n * (1 - LEVEL_LEAST):
            break
        n = left
        p, q = parts.select(F.col("node").alias("_a"), F.col("community").alias("pa")), parts.select(F.col("node").alias("_b"), F.col("community").alias("pb"))
        both = cut(both.join(p, F.col("node") == F.col("_a")).join(q, F.col("other") == F.col("_b")).groupBy(F.col("pa").alias("node"), F.col("pb").alias("other")).agg(F.sum("w").alias("w")))
        held = both.count()
    else:
        level = both.unionByName(labels.select("node", F.col("community").alias("other"), F.lit(None).cast("double").alias("w")))
        labels = cut(level.repartition(1).mapInArrow(_held_levels(total, resolution), "node long, community long"))
    told = members.join(labels.select(F.col("node").alias("_n"), "community"), F.col("node") == F.col("_n")).select("origin", "community")
    told = cut(told.join(ids, F.col("origin") == F.col("id")).select("name", "community"))
    names = told.groupBy(F.col("community").alias("_c")).agg(F.min("name").alias("_name"))
    return cut(told.join(names, F.col("community") == F.col("_c")).select(F.col("name").alias("node"), F.col("_name").alias("community")))


def modularity(ties: DataFrame, labels: DataFrame, resolution: float = RESOLUTION) -> float:
    """Modularity of a partition (node, community) of ``ties``."""
    real = ties.filter("a <> b AND w > 0")
    a, b = labels.select(F.col("node").alias("_a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("_b"), F.col("community").alias("cb"))
    ends = real.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
    inside, whole = ends.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0)), F.sum("w")).first()
    if not whole:
        return 0.0
    mass = ends.select(F.col("ca").alias("c"), "w").unionByName(ends.select(F.col("cb").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("k"))
    return float(inside / whole - resolution * mass.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / (4.0 * whole * whole))


def region_communities(ties: DataFrame, labels: DataFrame, changed: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """``labels`` with the communities of the ``changed`` nodes (a column ``key``) and of nodes new to them found again; all of them if that is most of the graph."""
    known = ties.select(F.col("a").alias("node")).unionByName(ties.select(F.col("b").alias("node"))).distinct()
    now = known.join(labels.select(F.col("node").alias("_n"), "community"), F.col("node") == F.col("_n"), "left").select("node", "community")
    touched = now.join(changed.select("key").distinct(), F.col("node") == F.col("key"), "left_semi").select(F.col("community").alias("_t")).filter("_t IS NOT NULL").distinct()
    marked = cut(now.join(touched, F.col("community") == F.col("_t"), "left").select("node", "community", (F.col("_t").isNotNull() | F.col("community").isNull()).alias("open")))
    total, open_nodes = marked.agg(F.count(F.lit(1)), F.count_if("open")).first()
    if open_nodes > REGION_LIMIT * total:
        return modularity_communities(ties, resolution)
    inside = marked.filter("open").select(F.col("node").alias("_n"))
    again = modularity_communities(ties.join(inside, F.col("a") == F.col("_n"), "left_semi").join(inside, F.col("b") == F.col("_n"), "left_semi"), resolution)
    told = marked.join(again.select(F.col("node").alias("_n"), F.col("community").alias("_new")), F.col("node") == F.col("_n"), "left")
    return told.select("node", F.when(F.col("open"), F.coalesce("_new", "node")).otherwise(F.col("community")).alias("community"))


def split_oversized(ties: DataFrame, labels: DataFrame, share: float = 0.25, least: int = 10, resolution: float = 2.0) -> DataFrame:
    """Communities above ``share`` of all members (and ``least``) are clustered again on their own, named ``<community>-sub-<name>``."""
    total = labels.count()
    large = labels.groupBy("community").count().filter(F.col("count") > max(total * share, least)).select(F.col("community").alias("_large"))
    inside = labels.join(large, F.col("community") == F.col("_large"), "left_semi")
    a, b = inside.select(F.col("node").alias("_a"), F.col("community").alias("ca")), inside.select(F.col("node").alias("_b"), F.col("community").alias("cb"))
    inner = ties.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b")).filter("ca = cb").select("a", "b", "w")
    again = modularity_communities(inner, resolution).select(F.col("node").alias("_n"), F.col("community").alias("_sub"))
    return labels.join(again, F.col("node") == F.col("_n"), "left").select("node", F.when(F.col("_sub").isNotNull(), F.concat("community", F.lit("-sub-"), "_sub")).otherwise(F.col("community")).alias("community"))
