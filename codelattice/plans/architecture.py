"""Coupling and stability of scopes, untested cores and architecture findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import ranking

DEPENDENCY_KINDS = ["IMPORTS_FROM", "DEPENDS_ON", "INHERITS", "IMPLEMENTS"]
STABLE_LIMIT, DISTANCE_LIMIT, DELTA = 0.35, 0.5, 0.1
FINDINGS_PER_KIND = 10


def scope_of(path: Column, depth: int = 2) -> Column:
    """The first ``depth`` directories of a path, ``<root>`` for none."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1))
    return F.when(F.size(parts) > 1, F.array_join(folders, "/")).otherwise(F.lit("<root>"))


def scope_dependencies(nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(source, target, n_sites): dependencies between different scopes of known nodes."""
    home = nodes.select(F.col("qualified_name").alias("_q"), scope_of(F.col("file_path"), depth).alias("target"))
    used = edges.filter(F.col("kind").isin(DEPENDENCY_KINDS)).select(scope_of(F.col("file_path"), depth).alias("source"), "target_qualified")
    return used.join(home, F.col("target_qualified") == F.col("_q")).filter("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n_sites"))


def stability(dependencies: DataFrame) -> DataFrame:
    """Ca, Ce and I = Ce / (Ca + Ce) of every scope that depends or is depended on, from distinct pairs."""
    pairs = dependencies.select("source", "target").distinct()
    sides = pairs.select(F.explode(F.array(F.struct(F.col("source").alias("scope"), F.lit(0).alias("ca"), F.lit(1).alias("ce")), F.struct(F.col("target").alias("scope"), F.lit(1).alias("ca"), F.lit(0).alias("ce")))).alias("s"))
    folded = sides.groupBy(F.col("s.scope").alias("scope")).agg(F.sum("s.ca").alias("ca"), F.sum("s.ce").alias("ce"))
    return folded.withColumn("instability", F.col("ce") / (F.col("ca") + F.col("ce")))


def stability_violations(dependencies: DataFrame, delta: float = DELTA) -> DataFrame:
    """Dependencies on a scope that is less stable by more than ``delta``."""
    m = stability(dependencies).select("scope", "instability")
    a, b = m.select(F.col("scope").alias("_a"), F.col("instability").alias("source_instability")), m.select(F.col("scope").alias("_b"), F.col("instability").alias("target_instability"))
    told = dependencies.join(a, F.col("source") == F.col("_a")).join(b, F.col("target") == F.col("_b"))
    return told.filter(F.col("target_instability") - F.col("source_instability") > delta).select("source", "target", "n_sites", "source_instability", "target_instability")


def abstractness(nodes: DataFrame, depth: int = 2) -> DataFrame:
    """Na and Nt of every scope over its top-level classes."""
    classes = nodes.filter("kind IN ('Class', 'Type') AND coalesce(parent_name, '') = ''")
    abstract = F.coalesce((F.get_json_object("extra", "$.is_abstract") == "true") | (F.get_json_object("extra", "$.is_contract") == "true"), F.lit(False))
    return classes.groupBy(scope_of(F.col("file_path"), depth).alias("scope")).agg(F.count_if(abstract).alias("na"), F.count(F.lit(1)).alias("nt"))


def distances(nodes: DataFrame, dependencies: DataFrame, depth: int = 2) -> DataFrame:
    """Abstractness, instability and distance from the main sequence, in millionths."""
    a, s = abstractness(nodes, depth), stability(dependencies)
    joined = a.join(s.withColumnRenamed("scope", "_s"), F.col("scope") == F.col("_s")).drop("_s")
    d = F.abs(F.col("na") / F.col("nt") + F.col("instability") - 1)
    return joined.select("scope", "na", "nt", "ca", "ce", "instability", F.floor(d * 1_000_000 + 0.5).cast("long").alias("distance_ppm"))


def profiles(nodes: DataFrame, dependencies: DataFrame, depth: int = 2) -> DataFrame:
    """Whether a scope is stable, should be, and is stable but concrete."""
    s = stability(dependencies)
    d = distances(nodes, dependencies, depth).select(F.col("scope").alias("_d"), "distance_ppm")
    stable = F.col("instability") <= STABLE_LIMIT
    far = F.coalesce(F.col("distance_ppm") >= DISTANCE_LIMIT * 1_000_000, F.lit(False))
    should = (F.col("ca") >= 3) | ((F.col("ca") >= 2) & (F.col("ca") > F.col("ce"))) | (far & stable)
    return s.join(d, F.col("scope") == F.col("_d"), "left").select("scope", stable.alias("stable"), should.alias("should_be_stable"), (stable & far).alias("stable_concrete"))


def untested_core(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Production functions used by at least max(p95, 5) other files without a test."""
    code = nodes.filter(F.col("kind").isin("Function", "Class") & paths.is_production_path(F.col("file_path"), F.col("language"))).select("qualified_name", F.col("file_path").alias("own_file"))
    uses = edges.filter("kind = 'CALLS'").join(code, F.col("target_qualified") == F.col("qualified_name")).filter("file_path <> own_file")
    files = uses.select("qualified_name", "file_path").distinct().groupBy("qualified_name").agg(F.count(F.lit(1)).alias("using_files"))
    p95 = ranking.indexed_percentile(files.withColumn("_all", F.lit(1)), ["_all"], "using_files", 95, "p95").select(F.greatest("p95", F.lit(5)).alias("threshold"))
    tested = edges.filter("kind = 'TESTED_BY'").select(F.col("source_qualified").alias("_t")).distinct()
    return files.filter(F.col("using_files") >= p95.scalar()).join(tested, F.col("qualified_name") == F.col("_t"), "left_anti").select("qualified_name", "using_files")


def broken_doc_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bridges and references from documents to something that is no node, with what is missing."""
    docs = nodes.filter(paths.is_documentation(F.col("language"), F.col("file_path"))).select(F.col("file_path").alias("_doc")).distinct()
    known = nodes.select(F.col("qualified_name").alias("_q"))
    from_docs = edges.filter(F.col("kind").isin("CROSS_ARTIFACT", "REFERENCES")).join(docs, F.col("file_path") == F.col("_doc"), "left_semi")
    lost = from_docs.join(known, F.col("target_qualified") == F.col("_q"), "left_anti")
    t = F.col("target_qualified")
    missing = F.when(t.contains("#"), "section").when(t.contains("::"), "symbol").when(paths.looks_like_file(t), "file").otherwise("symbol")
    return lost.select("source_qualified", "target_qualified", "line", missing.alias("missing"))


def findings(parts: dict[str, DataFrame], per_kind: int = FINDINGS_PER_KIND) -> DataFrame:
    """(kind, subject, weight, place, n_of_kind): the heaviest findings of each kind with the number there are; parts have subject and weight."""
    rows = None
    for kind, df in sorted(parts.items()):
        part = df.select(F.lit(kind).alias("kind"), "subject", F.col("weight").cast("long").alias("weight"))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy(F.col("kind").alias("_k")).agg(F.count(F.lit(1)).alias("n_of_kind"))
    order = W.partitionBy("kind").orderBy(F.desc("weight"), "subject")
    top = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_kind)
    return top.join(counts, F.col("kind") == F.col("_k")).drop("_k")


def architecture_findings(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """Import cycles, unstable dependencies, untested cores and broken document links."""
    deps = scope_dependencies(nodes, edges)
    return findings({
        "import_cycle": components.groupBy("component").agg(F.count(F.lit(1)).alias("weight")).select(F.col("component").alias("subject"), "weight"),
        "unstable_dependency": stability_violations(deps).select(F.concat("source", F.lit(" > "), "target").alias("subject"), F.col("n_sites").alias("weight")),
        "untested_core": untested_core(nodes, edges).select(F.col("qualified_name").alias("subject"), F.col("using_files").alias("weight")),
        "broken_doc_link": broken_doc_links(nodes, edges).groupBy(F.col("target_qualified").alias("subject")).agg(F.count(F.lit(1)).alias("weight")),
    })
