"""Queries of the training-data problems and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, load
from . import mixing, neighbours, packing, quality, source_filter, tokens

SIMILAR = 0.80


# --- 1: generated, minified or vendored source files -------------------------------------------


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Files nobody wrote by hand, with the reason; a File node without a stored text is judged by its path."""
    listed = load(spark, d, "nodes").filter((F.col("kind") == "File") & F.col("file_path").isNotNull()).select("file_path", F.lower("language").alias("language"))
    listed = listed.groupBy("file_path").agg(F.max("language").alias("language"))
    stored = load(spark, d, "source_files").select("file_path", "language", "content")
    known = stored.select(F.col("file_path").alias("_path")).distinct()
    bare = listed.join(known, F.col("file_path") == F.col("_path"), "left_anti").select("file_path", "language", F.lit(None).cast("string").alias("content"))
    judged = source_filter.classify_sources(stored.unionByName(bare))
    return judged.join(listed.select("file_path"), F.col("path") == F.col("file_path"), "left_semi").select(F.col("path").alias("file_path"), "reason")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_reasons(spark, d).select("file_path").distinct()


# --- 2: most similar vectors for every vector --------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.similar_names(load(spark, d, "node_vectors"), SIMILAR)
    return found.select(F.col("grp").alias("provider"), "name_a", "name_b")


def p2_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar rows of every embedding whose id is divisible by 20, by walking the graph of all rows."""
    rows = load(spark, d, "embeddings").select(F.lit("all").alias("grp"), F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("vec"))
    halves, fixed, copies = neighbours.places(neighbours.usable(rows, "grp", "name", "vec"))
    graph = neighbours.neighbour_graph(halves)
    named = cut(fixed.select(F.col("id").alias("_id"), "names"))
    every = named.filter(F.size("names") == 1).select(F.col("_id").alias("place"), F.col("names")[0].alias("name")).unionByName(copies.select(F.col("id").alias("place"), "name"))
    asked = cut(every.select("place", F.col("name").cast("long").alias("query_id")).filter("query_id % 20 = 0"))
    # equal vectors are searched once; a place offers its first names, its own come first
    starts = halves.join(asked.select(F.col("place").alias("query")).distinct(), F.col("id") == F.col("query")).select("grp", "query", "half")
    hits = neighbours.greedy_search(halves, graph, starts, k=neighbours.NEIGHBOURS + 1).filter("id <> query").select("query", "id", F.col("sim").cast("double").alias("sim"))
    hits = hits.unionByName(starts.select("query", F.col("query").alias("id"), F.lit(1.0).alias("sim")))
    told = hits.join(named, F.col("id") == F.col("_id")).select("query", "id", "sim", F.posexplode("names").alias("at", "name"))
    row = F.struct((F.col("id") != F.col("query")).alias("other"), (-F.col("sim")).alias("far"), "id", "at", F.col("name").cast("long").alias("vec_id"), "sim")
    lists = told.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(row)), 1, neighbours.NEIGHBOURS + 1).alias("rows"))
    unfolded = asked.join(lists, F.col("place") == F.col("query")).select("query_id", F.slice(F.filter("rows", lambda r: r["vec_id"] != F.col("query_id")), 1, neighbours.NEIGHBOURS).alias("rows"))
    return unfolded.select("query_id", F.explode("rows").alias("r")).select("query_id", "r.vec_id", F.col("r.sim").alias("similarity"))


# --- 7: filling fixed-capacity containers ------------------------------------------------------


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Container of every document (or part of one longer than the capacity) for every capacity."""
    capacities = sorted(r[0] for r in load(spark, d, "pack_sizes").select("capacity_tokens").distinct().collect() if r[0] and r[0] > 0)  # a fixed, small table
    sizes = tokens.token_counts(load(spark, d, "documents"), ["doc_id"])
    return packing.pack_all(sizes, capacities, "doc_id", "n_tokens").withColumnRenamed("item", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers and share of space used, per capacity."""
    return packing.packing_report(p7_packing(spark, d))


# --- 8: mixing sources to target weights -------------------------------------------------------


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = load(spark, d, "documents").select("doc_id", mixing.label(F.col("source")).alias("source"), "text")
    sized = cut(tokens.token_counts(documents, ["doc_id", "source"]).withColumnRenamed("doc_id", "doc"))
    targets = load(spark, d, "mix_targets").select(mixing.label(F.col("source")).alias("source"), "target_share", "max_repeats")
    return mixing.mix(sized, targets)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: which part of which document stands in which slot of which shard."""
    return _mixed(spark, d)[0].withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return _mixed(spark, d)[1]


# --- 9: text quality statistics ----------------------------------------------------------------


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Quality statistics and kind of every document."""
    return quality.classify_documents(load(spark, d, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents the mixture does not hold for prose."""
    return p9_statistics(spark, d).filter(F.col("kind") != "prose").select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_reasons": p1_reasons,
    "p2_found": p2_found, "p2_search": p2_search,
    "p7_packing": p7_packing, "p7_report": p7_report,
    "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_statistics": p9_statistics,
}

ORACLES: dict[str, str] = {}
