"""Parent-child links to full hierarchies.

Each node first learns the chain of its nearest ancestors by doubling. A
frontier then starts at the roots: a round joins the chains of the nodes that
are still open with the nodes of one depth and settles all levels the chains
span, so deep, thin trees do not cost one job per level. Nodes the frontier
never reaches hang from a loop; doubling over them alone names the loop by its
smallest id. Every round is cut with a checkpoint.

Defined results: rows with a null id are no nodes; of several rows with one id
the caller's choice is expected (see :func:`latest_rows`); a parent that names
no node makes its child a root; a node on or below a loop has null depth, null
path and the smallest id on the loop as its root. An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def latest_rows(df: DataFrame, key: str, recency: str, keep: list[str]) -> DataFrame:
    """The row of each key with the greatest ``recency`` (a null is oldest), ties by the kept columns, greatest first."""
    fields = [recency, *[c for c in keep if c != recency]]
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(*fields)).alias("_latest"))
        .select(key, *[F.col(f"_latest.{c}").alias(c) for c in keep])
    )


def resolve_hierarchy(links: DataFrame, id_col: str = "id", parent_col: str = "parent_id", doublings: int = 4) -> DataFrame:
    """``node, parent, depth, root_id, path (array of ids, root first), in_loop`` for every node of ``links``.

    ``links`` has one row per id. A round settles ``2 ** doublings`` levels.
    """
    span = 1 << doublings
    nodes = links.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("node"), F.col(parent_col).alias("parent"))
    known = nodes.select(F.col("node").alias("_known"))
    tied = cut(nodes.join(known, F.col("parent") == F.col("_known"), "left"))
    roots = tied.filter(F.col("_known").isNull()).select("node", "parent", F.lit(0).cast("long").alias("depth"), F.col("node").alias("root_id"), F.array("node").alias("path"))
    # chain: ancestors from the parent upwards
    chains = tied.filter(F.col("_known").isNotNull()).select("node", "parent", F.array("parent").alias("chain"))
    for _ in range(doublings):
        further = chains.select(F.col("node").alias("_node"), F.col("chain").alias("_chain"))
        joined = chains.join(further, F.element_at("chain", -1) == F.col("_node"), "left")
        chains = cut(joined.select("node", "parent", F.concat("chain", F.coalesce("_chain", F.slice("chain", 1, 0))).alias("chain")))
    reached, frontier, depth, still_open = [roots], roots, 0, chains
    while True:
        above = frontier.select(F.col("node").alias("_above"), F.col("depth").alias("_depth"), "root_id", "path")
        steps = still_open.select("node", "parent", "chain", F.posexplode("chain").alias("_at", "_ancestor"))
        climbed = steps.join(above, F.col("_ancestor") == F.col("_above"))
        between = F.reverse(F.slice("chain", F.lit(1), F.col("_at")))
        found = cut(climbed.select(
            "node", "parent", (F.col("_depth") + F.col("_at") + 1).cast("long").alias("depth"), "root_id", F.concat("path", between, F.array("node")).alias("path")
        ))
        if found.isEmpty():
            break
        reached.append(found)
        depth += span
        frontier = found.filter(F.col("depth") == depth)
        still_open = cut(still_open.join(found.select(F.col("node").alias("_done")), F.col("node") == F.col("_done"), "left_anti"))
    trees = reduce(DataFrame.unionByName, reached).withColumn("in_loop", F.lit(False))
    return trees.unionByName(_loops(still_open, span))


def _loops(stranded: DataFrame, span: int) -> DataFrame:
    """Nodes on or below loops, whose chains never end.

    ``jump`` is ``steps`` parents up and ``least`` the smallest id on the way;
    once ``steps`` reaches the number of stranded nodes, every jump ends on the
    loop and the jump from there goes all the way round it.
    """
    count, steps = stranded.count(), span
    jumps = stranded.select("node", "parent", F.element_at("chain", -1).alias("jump"), F.array_min(F.concat(F.array("node"), "chain")).alias("least"))
    rounds = 0
    while steps < count:
        ahead = jumps.select(F.col("node").alias("_node"), F.col("jump").alias("_jump"), F.col("least").alias("_least"))
        jumps = jumps.join(ahead, F.col("jump") == F.col("_node")).select("node", "parent", F.col("_jump").alias("jump"), F.least("least", "_least").alias("least"))
        steps, rounds = steps * 2, rounds + 1
        if rounds % 3 == 0:
            jumps = cut(jumps)
    ahead = jumps.select(F.col("node").alias("_node"), F.col("least").alias("_least"))
    named = jumps.join(ahead, F.col("jump") == F.col("_node"))
    nothing = F.when(F.lit(False), F.array("node"))
    return named.select("node", "parent", F.lit(None).cast("long").alias("depth"), F.col("_least").alias("root_id"), nothing.alias("path"), F.lit(True).alias("in_loop"))


def ancestor_pairs(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every node of a tree and each node above it; self pairs are left out."""
    return (
        resolved.filter(~F.col("in_loop"))
        .select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("_at", "ancestor"))
        .filter(F.col("_at") < F.col("depth"))
        .select("ancestor", "descendant", (F.col("depth") - F.col("_at")).alias("distance"))
    )
