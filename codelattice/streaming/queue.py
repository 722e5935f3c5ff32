"""A work queue as a table of tasks: coalescing, claiming, failing and recovering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3


def coalesced(tasks: DataFrame) -> DataFrame:
    """Pending tasks of one kind become one: greatest priority, earliest creation, all ids."""
    return tasks.filter("state = 'pending'").groupBy("kind").agg(
        F.min("id").alias("id"), F.max("priority").alias("priority"), F.count(F.lit(1)).alias("n_merged"), F.min("created_at").alias("created_at")
    )


def enqueue(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """New requests (kind, priority, created_at) join the pending task of their kind or open one."""
    asked = new.groupBy(F.col("kind").alias("_kind")).agg(F.max("priority").alias("_priority"), F.min("created_at").alias("_at"))
    pending = tasks.filter("state = 'pending'").groupBy(F.col("kind").alias("_k")).agg(F.min("id").alias("_first"))
    held = tasks.join(pending, (F.col("kind") == F.col("_k")) & (F.col("id") == F.col("_first")), "left").join(asked, F.col("_k") == F.col("_kind"), "left")
    merged = held.select(*[F.greatest("priority", "_priority").alias(c) if c == "priority" else F.col(c) for c in tasks.columns])
    opened = asked.join(pending, F.col("_kind") == F.col("_k"), "left_anti")
    last = tasks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last")).scalar()
    fresh = opened.select((last + F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_kind"))).cast("long").alias("id"), F.col("_kind").alias("kind"), F.col("_priority").alias("priority"), F.lit("pending").alias("state"), F.lit(0).cast("long").alias("attempts"), F.col("_at").alias("created_at"))
    return merged.unionByName(fresh, allowMissingColumns=True)


def claimable(tasks: DataFrame, now: float) -> DataFrame:
    """Pending tasks past their backoff, the next one first."""
    return tasks.filter((F.col("state") == "pending") & (F.coalesce("not_before", F.lit(0.0)) <= now)).orderBy(F.desc("priority"), "created_at", "id")


def failed(tasks: DataFrame, failures: DataFrame, now: float, delay: float = 30.0) -> DataFrame:
    """Tasks of ``failures`` (id, error, fatal) go back to pending with a delay, or die when fatal or tried often enough."""
    f = failures.select(F.col("id").alias("_id"), F.col("error").alias("_error"), F.col("fatal").alias("_fatal"))
    joined = tasks.join(f, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    dead = F.col("_fatal") | (F.col("attempts") >= MAX_ATTEMPTS)
    return joined.select(*[
        F.when(hit, F.when(dead, "dead").otherwise("pending")).otherwise(F.col(c)).alias(c) if c == "state"
        else F.when(hit & ~dead, F.lit(now + delay)).otherwise(F.col(c)).alias(c) if c == "not_before" else F.coalesce("_error", c).alias(c) if c == "last_error" else F.col(c) for c in tasks.columns
    ])


def recovered(tasks: DataFrame) -> DataFrame:
    """Tasks left running by a process that died are pending again, or dead after their last attempt."""
    state = F.when(F.col("state") == "running", F.when(F.col("attempts") >= MAX_ATTEMPTS, "dead").otherwise("pending")).otherwise(F.col("state"))
    return tasks.withColumn("state", state)
