"""Counts, risk, cohesion, names and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text
from .adjacency import edges_with_communities

# fixed values: words that say nothing about a community
NAME_STOPWORDS = ["test", "tests", "get", "set", "init", "self", "the", "and", "for", "with", "from", "impl", "new", "main", "run", "is", "to", "of"]


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, key, n): nodes and edges in total and by kind, files and languages."""
    one = F.count(F.lit(1)).alias("n")
    node_rows = nodes.groupBy("kind").agg(one).select(F.lit("node_kind").alias("section"), F.col("kind").alias("key"), "n")
    edge_rows = edges.groupBy("kind").agg(one).select(F.lit("edge_kind").alias("section"), F.col("kind").alias("key"), "n")
    totals = node_rows.unionByName(edge_rows).groupBy(F.when(F.col("section") == "node_kind", "nodes").otherwise("edges").alias("key")).agg(F.sum("n").alias("n"))
    files = nodes.filter("kind = 'File'").agg(F.count_distinct("file_path").alias("n")).select(F.lit("total").alias("section"), F.lit("files").alias("key"), "n")
    languages = nodes.agg(F.count_distinct(F.lower("language")).alias("n")).select(F.lit("total").alias("section"), F.lit("languages").alias("key"), "n")
    return node_rows.unionByName(edge_rows).unionByName(totals.select(F.lit("total").alias("section"), "key", "n")).unionByName(files).unionByName(languages)


def name_counts(nodes: DataFrame, kinds: list[str], include_tests: bool) -> DataFrame:
    wanted = nodes.filter(F.col("kind").isin(kinds))
    return (wanted if include_tests else wanted.filter(~F.coalesce("is_test", F.lit(False)))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def is_security_name(name: Column) -> Column:
    return text.words_match(text.identifier_words(name), text.SECURITY_PREFIXES, text.SECURITY_EXCLUDED)


def risk_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Risk of every function, class and test in hundredths: many callers, no test, a security name; at most 100.

    Both counts are folded per symbol before they meet the nodes.
    """
    counts = edges.filter(F.col("kind").isin("CALLS", "TESTED_BY")).select(
        F.when(F.col("kind") == "CALLS", F.col("target_qualified")).otherwise(F.col("source_qualified")).alias("_key"), (F.col("kind") == "CALLS").cast("long").alias("call"), (F.col("kind") == "TESTED_BY").cast("long").alias("test")
    ).groupBy("_key").agg(F.sum("call").alias("callers"), F.sum("test").alias("tests"))
    scored = nodes.filter(F.col("kind").isin("Function", "Class", "Test")).join(counts, F.col("qualified_name") == F.col("_key"), "left")
    callers, tests = F.coalesce("callers", F.lit(0)), F.coalesce("tests", F.lit(0))
    secure = is_security_name(F.col("name"))
    points = F.when(callers > 10, 30).when(callers > 3, 15).otherwise(0) + F.when(tests == 0, 30).otherwise(0) + F.when(secure, 40).otherwise(0)
    return scored.select("qualified_name", callers.alias("caller_count"), (tests > 0).alias("tested"), secure.alias("security_relevant"), F.least(points, F.lit(100)).alias("risk_percent"))


def community_cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Inner and outer edges of every community; an edge between two counts for both; calls of bare names are left out."""
    real = edges.filter(~((F.col("kind") == "CALLS") & ~F.col("target_qualified").contains("::")))
    members = nodes.filter("community_id IS NOT NULL").select("qualified_name", "community_id")
    source = members.select(F.col("qualified_name").alias("_s"), F.col("community_id").alias("a"))
    target = members.select(F.col("qualified_name").alias("_t"), F.col("community_id").alias("b"))
    tied = real.select("source_qualified", "target_qualified").join(source, F.col("source_qualified") == F.col("_s"), "left").join(target, F.col("target_qualified") == F.col("_t"), "left")
    sides = tied.filter("a IS NOT NULL OR b IS NOT NULL").select(F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))).alias("community_id"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).cast("long").alias("inner_edge"))
    return sides.groupBy("community_id").agg(F.sum("inner_edge").alias("internal"), F.sum(1 - F.col("inner_edge")).alias("external"))


def commonest(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Most frequent value, ties to the smallest."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_b")).select(*keys, F.col("_b.v").alias(out))


def keywords(nodes: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """The commonest words of the names in a group."""
    words = nodes.select(*keys, F.explode(text.identifier_words(F.col("name"))).alias("word")).filter((F.length("word") > 2) & ~F.col("word").isin(NAME_STOPWORDS))
    counted = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*keys).orderBy(F.desc("n"), "word")
    return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def community_profiles(nodes: DataFrame) -> DataFrame:
    """Size, dominant language, directory and top word of every community."""
    members = nodes.filter("community_id IS NOT NULL AND kind <> 'File'").select("community_id", "name", F.lower("language").alias("language"), paths.package_of(F.col("file_path")).alias("directory"))
    sizes = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    tables = [commonest(members, ["community_id"], "language", "dominant_language"), commonest(members, ["community_id"], "directory", "directory"), keywords(members, ["community_id"], 1).select("community_id", F.col("word").alias("top_word"))]
    for t in tables:
        sizes = sizes.join(t, "community_id", "left")
    return sizes


def embedding_coverage(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per provider: vectors, those of a live node that is no file, orphans, and the nodes there are."""
    live = nodes.filter("kind <> 'File'").select(F.col("qualified_name").alias("_live"))
    total = live.agg(F.count(F.lit(1)).alias("n_nodes"))
    stored = vectors.filter("vector IS NOT NULL").select("provider", "qualified_name").distinct().join(live, F.col("qualified_name") == F.col("_live"), "left")
    told = stored.groupBy("provider").agg(F.count(F.lit(1)).alias("n_vectors"), F.count("_live").alias("n_embedded"))
    return told.withColumn("n_nodes", total.scalar()).withColumn("n_orphans", F.col("n_vectors") - F.col("n_embedded"))


def answerability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counters on how much the graph can answer."""
    span = (F.col("kind") == "CROSS_ARTIFACT") & F.col("target_qualified").startswith("<unresolved:")
    e = edges.agg(F.count_if(span).alias("unresolved_bridges"), F.count_if(F.col("target_qualified").startswith("<unresolved:")).alias("unresolved_edges"), F.count(F.lit(1)).alias("edges"))
    n = nodes.agg(F.count_distinct("community_id").alias("communities"), F.count_if(F.col("community_id").isNull() & (F.col("kind") != "File")).alias("unassigned_nodes"))
    return e.join(n, F.lit(True)).withColumn("grade", F.when(F.col("unresolved_edges") * 10 > F.col("edges"), "partial").when(F.col("communities") == 0, "limited").otherwise("full"))


def cross_community_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges inside and between communities, per kind."""
    tied = edges_with_communities(nodes, edges).filter("source_community IS NOT NULL AND target_community IS NOT NULL")
    return tied.groupBy("kind").agg(F.count_if(F.col("source_community") == F.col("target_community")).alias("inside"), F.count_if(F.col("source_community") != F.col("target_community")).alias("between"))
