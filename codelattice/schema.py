"""Row types, closed vocabularies and the current state of the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import load

# --- fixed values ---
NODE_KINDS = ["File", "Function", "Class", "Type", "Test", "DocSection", "DocBody"]
EDGE_KINDS = ["CALLS", "CONTAINS", "IMPORTS_FROM", "TESTED_BY", "CROSS_ARTIFACT", "REFERENCES", "INHERITS", "IMPLEMENTS", "DEPENDS_ON"]
TIERS = ["EXACT", "EXTRACTED", "HIGH", "MEDIUM", "LOW", "UNKNOWN"]
REPORTABLE_TIERS = ["EXACT", "HIGH", "EXTRACTED"]
EDGE_IDENTITY = ["kind", "source_qualified", "target_qualified", "file_path", "line"]
SCHEMA_VERSION = 20

NODE_SCHEMA = (
    "kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string, parent_name string, params string, "
    "return_type string, modifiers string, is_test boolean, file_hash string, mtime_ns long, extra string, signature string, community_id long, updated_at double"
)
EDGE_SCHEMA = "kind string, source_qualified string, target_qualified string, target_name string, file_path string, line long, extra string, confidence double, confidence_tier string, updated_at double"


def latest(df: DataFrame, keys: list[str], recency: list[str]) -> DataFrame:
    """The most recent row of every key; the rank limit is applied before the exchange too."""
    order = W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in recency])
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def current_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per qualified name: later rows replace earlier ones, copies count once."""
    return latest(load(spark, d, "nodes"), ["qualified_name"], ["updated_at", "file_hash", "mtime_ns"])


def current_edges(spark: SparkSession, d: str) -> DataFrame:
    """One row per (kind, source, target, file, line)."""
    return latest(load(spark, d, "edges"), EDGE_IDENTITY, ["updated_at", "id"])


def tier(column="confidence_tier"):
    """Tier in upper case; blank, null and unknown text count as EXTRACTED."""
    upper = F.upper(F.trim(F.col(column)))
    return F.when(upper.isin(TIERS), upper).otherwise(F.lit("EXTRACTED"))


NODES_CTE = """n AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY updated_at DESC NULLS LAST, file_hash DESC NULLS LAST, mtime_ns DESC NULLS LAST) rk FROM nodes) WHERE rk = 1)"""
EDGES_CTE = """e AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY kind, source_qualified, target_qualified, file_path, line ORDER BY updated_at DESC NULLS LAST, id DESC NULLS LAST) rk FROM edges) WHERE rk = 1)"""
TIER_SQL = "CASE WHEN upper(trim(confidence_tier)) IN ('EXACT','EXTRACTED','HIGH','MEDIUM','LOW','UNKNOWN') THEN upper(trim(confidence_tier)) ELSE 'EXTRACTED' END"
