"""Joins of nodes and edges: adjacency, subgraphs, dependents, line ranges and units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .lookup import is_low_confidence_bridge


def edges_from(edges: DataFrame, keys: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges whose source is in ``keys`` (a column ``key``)."""
    wanted = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    return wanted.join(keys.select("key").distinct(), F.col("source_qualified") == F.col("key"), "left_semi")


def edges_into(edges: DataFrame, keys: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    wanted = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    return wanted.join(keys.select("key").distinct(), F.col("target_qualified") == F.col("key"), "left_semi")


def edges_by_endpoints(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges at either end of the keys with the key and the direction; two joins instead of one with an OR."""
    out = edges.join(keys, F.col("source_qualified") == F.col("key")).withColumn("direction", F.lit("out"))
    into = edges.join(keys, F.col("target_qualified") == F.col("key")).withColumn("direction", F.lit("in"))
    return out.unionByName(into)


def edges_among(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with both ends in ``keys``."""
    return edges_into(edges_from(edges, keys), keys)


def subgraph(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    inner = nodes.join(keys.select("key").distinct(), F.col("qualified_name") == F.col("key"), "left_semi")
    return inner, edges_among(edges, keys)


def edges_by_target_name(edges: DataFrame, names: DataFrame, kind: str, qualified_only: bool = False) -> DataFrame:
    found = edges.filter(F.col("kind") == kind).join(names, F.col("target_name") == F.col("key"), "left_semi")
    return found.filter(F.col("target_qualified") != F.col("target_name")) if qualified_only else found


def edges_with_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes, with the communities of the ends."""
    known = nodes.select("qualified_name", F.col("kind").alias("node_kind"), "community_id")
    left = known.select(F.col("qualified_name").alias("_s"), F.col("node_kind").alias("source_kind"), F.col("community_id").alias("source_community"))
    right = known.select(F.col("qualified_name").alias("_t"), F.col("node_kind").alias("target_kind"), F.col("community_id").alias("target_community"))
    return edges.join(left, F.col("source_qualified") == F.col("_s")).join(right, F.col("target_qualified") == F.col("_t")).drop("_s", "_t")


def call_targets(nodes: DataFrame, edges: DataFrame, include_file_sources: bool = False) -> DataFrame:
    """Distinct targets of calls; calls from files count only on request, calls from unknown sources always."""
    calls = edges.filter(F.col("kind") == "CALLS").select("source_qualified", "target_qualified")
    if include_file_sources:
        return calls.select("target_qualified").distinct()
    kinds = nodes.select(F.col("qualified_name").alias("_s"), F.col("kind").alias("_kind"))
    return calls.join(kinds, F.col("source_qualified") == F.col("_s"), "left").filter(F.col("_kind").isNull() | (F.col("_kind") != "File")).select("target_qualified").distinct()


def community_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of different communities joined by an edge, in both directions."""
    tied = edges_with_communities(nodes, edges).filter("source_community IS NOT NULL AND target_community IS NOT NULL AND source_community <> target_community")
    pairs = tied.select(F.explode(F.array(F.struct(F.col("source_community").alias("a"), F.col("target_community").alias("b")), F.struct(F.col("target_community").alias("a"), F.col("source_community").alias("b")))).alias("p"))
    return pairs.select(F.col("p.a").alias("community_id"), F.col("p.b").alias("neighbour_id")).distinct()


def direct_dependents(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Files that import one of ``files`` (a column ``key``) or use a symbol of it, without these files."""
    symbols = nodes.join(files, F.col("file_path") == F.col("key"), "left_semi").select(F.col("qualified_name").alias("key"))
    importers = edges_into(edges, files, ["IMPORTS_FROM"]).select("file_path")
    users = edges_into(edges, symbols, ["CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS"]).select("file_path")
    return importers.unionByName(users).distinct().join(files, F.col("file_path") == F.col("key"), "left_anti")


def low_confidence_bridges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    low = edges.filter(is_low_confidence_bridge())
    return edges_from(low, seeds).unionByName(edges_into(low, seeds)).select("source_qualified", "target_qualified").distinct()


def nodes_in_ranges(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Nodes whose lines overlap a changed range ``(file_path, range_start, range_end)`` of their file."""
    changed = ranges.select(F.col("file_path").alias("_file"), "range_start", "range_end")
    hit = (F.col("file_path") == F.col("_file")) & (F.col("line_start") <= F.col("range_end")) & (F.col("line_end") >= F.col("range_start"))
    return nodes.filter(F.col("kind") != "File").join(changed, hit, "left_semi")


def deepest_unit(files: DataFrame, units: DataFrame) -> DataFrame:
    """File with the deepest directory of ``units`` (a column ``unit``) above it; a longest-prefix join by exploded ancestors."""
    above = files.select("file_path", F.explode(paths.ancestors(F.col("file_path"))).alias("_dir"))
    hits = above.join(units.select("unit").distinct(), F.col("_dir") == F.col("unit"))
    return hits.groupBy("file_path").agg(F.max_by("unit", F.length("unit")).alias("unit"))


def rolled_up(edges: DataFrame, unit_of: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between different units with counts per kind."""
    home = nodes.select("qualified_name", F.col("file_path").alias("_file")).join(unit_of, F.col("_file") == F.col("file_path")).select("qualified_name", "unit")
    source = home.select(F.col("qualified_name").alias("_s"), F.col("unit").alias("from_unit"))
    target = home.select(F.col("qualified_name").alias("_t"), F.col("unit").alias("to_unit"))
    tied = edges.join(source, F.col("source_qualified") == F.col("_s")).join(target, F.col("target_qualified") == F.col("_t")).filter("from_unit <> to_unit")
    return tied.groupBy("from_unit", "to_unit", "kind").agg(F.count(F.lit(1)).alias("n_edges"))
