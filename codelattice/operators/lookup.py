"""Point lookups, filters and small projections over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import REPORTABLE_TIERS


def key_candidates(spark, names: list[str], root: str = "") -> DataFrame:
    """(original, candidate, rank): the spellings under which a name may be stored, best first.

    The list is the caller's, so it is small by nature.
    """
    rows = []
    for name in dict.fromkeys(names):
        clean = name.strip().replace("\\", "/")
        spellings = [name, clean, clean.removeprefix("./")]
        if root:
            spellings += [clean.removeprefix(root.rstrip("/") + "/"), f"{root.rstrip('/')}/{clean}"]
        rows += [(name, s, i) for i, s in enumerate(dict.fromkeys(spellings))]
    return spark.createDataFrame(rows or [("", "", 0)], "original string, candidate string, rank int").filter("original <> '' OR candidate <> ''")


def nodes_by_names(nodes: DataFrame, names: list[str], root: str = "") -> DataFrame:
    """Nodes of a list of names with the name asked for; the best spelling of each wins."""
    keys = key_candidates(nodes.sparkSession, names, root)
    hits = nodes.join(keys, F.col("qualified_name") == F.col("candidate"))
    best = W.partitionBy("original").orderBy("rank", "qualified_name")
    return hits.withColumn("_at", F.row_number().over(best)).filter("_at = 1").drop("_at", "candidate", "rank")


def edges_at(edges: DataFrame, names: list[str], root: str = "") -> DataFrame:
    """Edges with a name at either end; an edge that matches twice comes once."""
    keys = key_candidates(edges.sparkSession, names, root).select("candidate").distinct()
    out = edges.join(keys, F.col("source_qualified") == F.col("candidate"), "left_semi")
    into = edges.join(keys, F.col("target_qualified") == F.col("candidate"), "left_semi")
    return out.unionByName(into).dropDuplicates(["id"])


def nodes_by_kind(nodes: DataFrame, kinds: list[str], file_pattern: str | None = None) -> DataFrame:
    found = nodes.filter(F.col("kind").isin(kinds))
    return found.filter(F.col("file_path").contains(file_pattern)) if file_pattern else found


def files_in_directory(nodes: DataFrame, directory: str) -> DataFrame:
    return nodes.filter((F.col("kind") == "File") & paths.direct_children(F.col("file_path"), directory)).select("file_path").distinct()


def files_matching(nodes: DataFrame, ending: str) -> DataFrame:
    return nodes.filter(F.col("file_path").endswith(ending)).select("file_path").distinct()


def members(nodes: DataFrame, parent: str, name: str, kinds: list[str]) -> DataFrame:
    return nodes.filter((F.col("parent_name") == parent) & (F.col("name") == name) & F.col("kind").isin(kinds))


def unresolved_edges(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter((F.col("kind") == kind) & F.col("target_qualified").startswith("<unresolved:"))


def effective_tier(column: str = "confidence_tier", extra: str = "extra") -> Column:
    """The column's tier; where it is blank, the tier in ``extra``; else EXTRACTED."""
    own = F.nullif(F.trim(F.col(column)), F.lit(""))
    return F.upper(F.coalesce(own, F.get_json_object(extra, "$.confidence_tier"), F.lit("EXTRACTED")))


def is_reportable_bridge() -> Column:
    resolved = ~F.col("source_qualified").startswith("<unresolved:") & ~F.col("target_qualified").startswith("<unresolved:")
    return (F.col("kind") == "CROSS_ARTIFACT") & resolved & effective_tier().isin(REPORTABLE_TIERS)


def is_low_confidence_bridge() -> Column:
    return (F.col("kind") == "CROSS_ARTIFACT") & ~is_reportable_bridge()


def bridge_record() -> Column:
    """What a bridge claims and how strongly."""
    field = lambda key: F.get_json_object("extra", f"$.{key}").alias(key)
    return F.struct(
        F.col("source_qualified"), F.col("target_qualified"), field("relationship_role"), field("bridge_kind"), field("evidence_kind"), field("evidence_source"),
        effective_tier().alias("tier"), F.when(is_reportable_bridge(), "hard").otherwise("caveat").alias("claim_strength"),
    )


def import_kind() -> Column:
    return F.coalesce(F.get_json_object("extra", "$.import_kind"), F.get_json_object("extra", "$.import_scope"), F.lit("module"))


def resolve_target(nodes: DataFrame, target: str, limit: int = 20) -> DataFrame:
    """Candidates for a name a user typed, with the way they were found: exact, file, respelled or by name; only the best way is kept."""
    clean = target.strip().replace("\\", "/").removeprefix("./")
    way = (
        F.when(F.col("qualified_name") == target, F.lit(0))
        .when((F.col("kind") == "File") & (F.col("file_path") == clean), F.lit(1))
        .when(F.col("qualified_name") == clean, F.lit(2))
        .when(F.col("name") == clean, F.lit(3))
        .when(F.col("qualified_name").endswith(f"::{clean}") | F.col("qualified_name").endswith(f".{clean}"), F.lit(4))
    )
    found = nodes.withColumn("way", way).filter(F.col("way").isNotNull())
    best = found.agg(F.min("way").alias("best"))
    return found.join(best, F.col("way") == F.col("best"), "left_semi").orderBy("qualified_name").limit(limit)
