"""Table access, lineage cuts and small helpers shared by all operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, set as the context's if it has none.

    A folder of this machine serves only where the setting is unset and all
    tasks run on this machine, as in tests; a cluster must name a shared one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
            folder = tempfile.mkdtemp(prefix="codelattice-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, as many as ``df`` has partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_union(df: DataFrame) -> DataFrame:
    """:func:`cut` for a union of frames that were cut before.

    A loop that unions what it found would add up partitions without end; they
    are merged to ``spark.sql.shuffle.partitions``. The inputs are files of
    small rows, so nothing expensive before them loses its parallelism.
    """
    return cut(df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut_table(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from its files.

    A checkpoint keeps what the optimizer inferred about the columns and its
    estimate of the size, which is a product over joins. Where a frame is
    rewritten by conditions or joined with itself round after round, both grow
    until planning takes longer than running; a table has neither, and its
    size is the true one. What was exchanged for it is deleted at once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    if (passing := _passing.get()) is not None:
        passing.append(path)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Folders of the tables that :func:`cut_table` writes inside are listed, and deleted at the end unless they were taken off the list."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield paths
    finally:
        _passing.reset(token)
        for path in paths:
            drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bucket_count(rows: int, rows_per_bucket: int, least: int = 8) -> int:
    """Number of buckets that keeps each of them near ``rows_per_bucket`` rows."""
    return max(least, math.ceil(rows / max(1, rows_per_bucket)))


def salted_rank(df: DataFrame, group: list[str], order: list[str], out: str, rows_per_bucket: int = 200_000) -> DataFrame:
    """Dense 0-based position of each row within ``group``, without one task per group.

    Rows are spread over hash buckets of ``order`` (which must identify a row);
    positions follow (bucket, order). Only (group, bucket) counts meet in one
    window, so a group that holds most of the rows is ranked by many tasks.
    The result depends on the rows alone, so a recomputed task repeats it.
    """
    return salted_prefix_sum(df, group, order, F.lit(1).cast("long"), out, rows_per_bucket)


def salted_prefix_sum(df: DataFrame, group: list[str], order: list[str], amount, out: str, rows_per_bucket: int = 200_000) -> DataFrame:
    """Sum of ``amount`` over the rows before this one in its group, in the order of :func:`salted_rank`."""
    from pyspark.sql import Window as W

    buckets = bucket_count(df.count(), rows_per_bucket)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(buckets))).withColumn("_amount", amount.cast("long"))
    per_bucket = salted.groupBy(*group, "_salt").agg(F.sum("_amount").alias("_in_bucket"))
    before = W.partitionBy(*group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("_offset", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0))).select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_salt").alias("_s"), "_offset"
    )
    inside = W.partitionBy(*group, "_salt").orderBy(F.xxhash64(*order, F.lit(7)), *order).rowsBetween(W.unboundedPreceding, -1)
    running = salted.withColumn("_before", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    match = F.col("_salt") == F.col("_s")
    for i, c in enumerate(group):
        match = match & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = running.join(offsets, match)
    return joined.withColumn(out, F.col("_offset") + F.col("_before")).select(*df.columns, out)
