"""Rank fusion, top-k and ordered merges; every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FUSION_K = 10
FUSION_UNIT = 1_000_000_000  # scores are summed as integers so that the order of the sum cannot matter


def rank_fusion(lists: list[DataFrame], key: str = "id", position: str = "position") -> DataFrame:
    """Reciprocal-rank fusion of lists with 0-based positions; ties keep first-seen order."""
    rows = None
    for number, ranked in enumerate(lists):
        part = ranked.select(key, F.col(position).alias("_p"), F.lit(number).alias("_list"))
        rows = part if rows is None else rows.unionByName(part)
    share = F.round(F.lit(FUSION_UNIT) / (F.lit(FUSION_K + 1) + F.col("_p"))).cast("long")
    return rows.groupBy(key).agg(F.sum(share).alias("fusion_score"), F.min(F.struct("_list", "_p")).alias("first_seen"))


def ranked(df: DataFrame, order: list[Column], partition: list[str] | None = None, out: str = "position") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*(partition or [])).orderBy(*order)) - 1)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys in the order of their first position."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def merge_endpoint_rows(edges: DataFrame, endpoint: str) -> DataFrame:
    """One row per endpoint with its lines, call count and best tier."""
    order = ["EXACT", "EXTRACTED", "HIGH", "MEDIUM", "LOW", "UNKNOWN"]
    tier = F.upper(F.coalesce(F.nullif(F.trim("confidence_tier"), F.lit("")), F.lit("EXTRACTED")))
    rank = F.array_position(F.array(*[F.lit(t) for t in order]), tier)
    return edges.groupBy(F.col(endpoint).alias("endpoint")).agg(
        F.array_join(F.sort_array(F.collect_set("line")).cast("array<string>"), ",").alias("lines"), F.count(F.lit(1)).alias("n_edges"), F.element_at(F.array(*[F.lit(t) for t in order]), F.min(F.when(rank > 0, rank).otherwise(6)).cast("int")).alias("best_tier")
    )


def indexed_percentile(df: DataFrame, group: list[str], value: str, percent: int, out: str) -> DataFrame:
    """The value at index ``floor(n * percent / 100)`` of the sorted list of the group (0-based, at most n - 1), from weighted values.

    Values are counted first, so the window runs over the distinct values of a group.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    inside = W.partitionBy(*group).orderBy(value)
    upto = counted.withColumn("_upto", F.sum("_n").over(inside)).withColumn("_total", F.sum("_n").over(W.partitionBy(*group)))
    index = F.least(F.floor(F.col("_total") * percent / 100), F.col("_total") - 1)
    return upto.filter(F.col("_upto") > index).groupBy(*group).agg(F.min(value).alias(out))


def trim_to_budget(lists: dict[str, list], budget_tokens: int, priorities: list[str]) -> dict[str, dict]:
    """Halve lists, lowest priority first, until the reply fits; replies are small and held by the caller."""
    import json

    kept = {k: list(v) for k, v in lists.items()}
    size = lambda: len(json.dumps(kept, default=str)) // 4
    while size() > budget_tokens and any(len(v) > 1 for v in kept.values()):
        name = next((p for p in reversed(priorities) if len(kept.get(p, [])) > 1), None) or max(kept, key=lambda k: len(kept[k]))
        kept[name] = kept[name][: max(1, len(kept[name]) // 2)]
    return {k: {"rows": v, "kept": len(v), "total": len(lists[k])} for k, v in kept.items()}
