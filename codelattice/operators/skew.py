"""Per-key results when a handful of keys hold most of the rows.

Value-frequency compression: rows are first grouped by (key, value), which
spreads a hot key over as many groups as it has values, and only then by key,
where every task has already folded its part of the key to one row. Exact
distinct counts, modes and percentiles follow from the weighted values.

Nulls are values like any other in keys and in counted tuples (two nulls are
equal); percentiles leave null values out. An empty table gives an empty
result. Columns that are not named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

WEIGHT = "_weight"


def compress(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per distinct (key, value) with the number of rows it stands for."""
    return df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias(WEIGHT))


def distinct_counts(df: DataFrame, keys: list[str], values: list[str], rows: str = "n_rows", distinct: str = "n_distinct") -> DataFrame:
    """Rows and distinct value tuples of each key."""
    return compress(df, keys, values).groupBy(*keys).agg(F.sum(WEIGHT).alias(rows), F.count(F.lit(1)).alias(distinct))


def modes(df: DataFrame, keys: list[str], value: str, out: str = "mode", weight: str = "mode_rows") -> DataFrame:
    """Most frequent non-null value of each key; among equals the smallest. A key with nulls only has a null mode."""
    packed = compress(df, keys, [value])
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(WEIGHT)).alias("w"), F.col(value).alias("v"))))
    return packed.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.v").alias(out), (-F.col("_best.w")).alias(weight))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], partitions: int | None = None) -> DataFrame:
    """Exact discrete percentiles of each key: the smallest value whose running weight reaches ``share`` of the total.

    The weighted values are range-partitioned by (key, value), so a hot key is
    cut at values; the weight before each piece comes from a window over the
    (key, piece) totals, of which a key has at most one per partition.
    """
    packed = compress(df.filter(F.col(value).isNotNull()), keys, [value])
    order = [*keys, value]
    ranged = packed.repartitionByRange(partitions, *order) if partitions else packed.repartitionByRange(*order)
    pieces = cut(ranged.withColumn("_piece", F.spark_partition_id()))
    totals = pieces.groupBy(*keys, "_piece").agg(F.sum(WEIGHT).alias("_piece_weight"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_piece_weight").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_piece_weight").over(W.partitionBy(*keys))
    )
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_p"), "_offset", "_total")
    same: Column = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = W.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    running = pieces.withColumn("_inside", F.sum(WEIGHT).over(inside)).join(totals, same)
    reached = F.col("_offset") + F.col("_inside")
    return running.groupBy(*keys).agg(
        *[F.min(F.when(reached >= F.ceil(F.col("_total") * F.lit(float(q))), F.col(value))).alias(name) for name, q in shares.items()]
    )


def heavy_keys(df: DataFrame, keys: list[str], values: list[str], percent: int) -> DataFrame:
    """Keys that hold at least ``percent`` of 100 of all distinct (key, value) tuples, with both counts.

    One number, the total, goes through the driver.
    """
    counts = cut(distinct_counts(df, keys, values))
    total = counts.agg(F.sum("n_distinct")).first()[0] or 0
    return counts.filter(F.col("n_distinct") * 100 >= F.lit(percent) * F.lit(total)).withColumn("n_total", F.lit(total).cast("long"))


def key_profile(df: DataFrame, keys: list[str], identity: list[str], distinct_of: str, mode_of: str, percentile_of: str) -> DataFrame:
    """Rows, distinct tuples, distinct ``distinct_of``, mode of ``mode_of`` and median of ``percentile_of`` for every key.

    Each measure is compressed on its own, over its own columns; the per-key
    rows are united and folded once, so no join meets a hot key.
    """
    named = {"n_rows": "long", "n_distinct": "long", "n_values": "long", "mode": df.schema[mode_of].dataType.simpleString(), "median": df.schema[percentile_of].dataType.simpleString()}

    def pad(part: DataFrame) -> DataFrame:
        return part.select(*keys, *[(F.col(c) if c in part.columns else F.lit(None)).cast(t).alias(c) for c, t in named.items()])

    parts = [
        distinct_counts(df, keys, identity),
        distinct_counts(df, keys, [distinct_of], "_ignored", "n_values").drop("_ignored"),
        modes(df, keys, mode_of).drop("mode_rows"),
        percentiles(df, keys, percentile_of, {"median": 0.5}),
    ]
    united = pad(parts[0])
    for part in parts[1:]:
        united = united.unionByName(pad(part))
    return united.groupBy(*keys).agg(*[F.max(c).alias(c) for c in named])
