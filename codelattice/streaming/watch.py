"""File events to batches: a quiet gap with a cap from the first event, as a stream and as a table.

A batch closes when no event came for ``gap`` seconds, or ``cap`` seconds after
its first event, whichever is first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.store import replace_files, upsert_nodes
from ..session import ensure_checkpoint_dir

BLOCK_GAPS = 64  # length of a block of time in gaps

BATCHES = "key string, batch_start double, batch_end double, n_events long, paths array<string>"


def close_times(times: list[float], gap: float, cap: float) -> list[list[int]]:
    """Positions of ascending ``times`` by batch."""
    batches: list[list[int]] = []
    first = last = None
    for i, t in enumerate(times):
        if first is None or t - last > gap or t - first > cap:
            batches.append([])
            first = t
        batches[-1].append(i)
        last = t
    return batches


def debounced(events: DataFrame, key: str, at: str, gap: float, cap: float) -> DataFrame:
    """``key, batch_start, batch_end, n_events`` of a table of events (``at`` in seconds).

    Quiet gaps cut the events of a key into islands. Neighbours are compared
    within blocks of time; only the first and last event of a block meet in a
    window over the key, so a busy key is spread over as many tasks as it has
    blocks. An island that is longer than the cap is cut again from its first
    event on, by an expression over its own sorted times.
    """
    width = max(gap, 1e-9) * BLOCK_GAPS
    timed = events.select(F.col(key).cast("string").alias(key), F.col(at).cast("double").alias(at)).filter(F.col(at).isNotNull()).withColumn("_block", F.floor(F.col(at) / width))
    order = W.partitionBy(key, "_block").orderBy(at)
    local = timed.withColumn("_new", F.coalesce(F.col(at) - F.lag(at).over(order) > gap, F.lit(False)).cast("long"))
    local = local.withColumn("_inside", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    blocks = local.groupBy(key, "_block").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.sum("_new").alias("_news"))
    over = W.partitionBy(key).orderBy("_block")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(over) > gap, F.lit(True)).cast("long")
    blocks = blocks.withColumn("_opens", opens).withColumn("_before", F.sum(F.col("_opens") + F.col("_news")).over(over.rowsBetween(W.unboundedPreceding, 0)) - F.col("_news"))
    offsets = blocks.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), "_before")
    islands = local.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))).select(key, at, (F.col("_before") + F.col("_inside")).alias("_island"))
    packed = islands.groupBy(key, "_island").agg(F.array_sort(F.collect_list(at)).alias("times"))
    empty = F.array().cast("array<struct<s:double,e:double,n:bigint>>")

    def step(acc, t):
        top = F.element_at(acc, -1)
        fresh = (F.size(acc) == 0) | (t - top["s"] > cap)
        one = F.array(F.struct(t.cast("double").alias("s"), t.cast("double").alias("e"), F.lit(1).cast("long").alias("n")))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(top["s"].alias("s"), t.cast("double").alias("e"), (top["n"] + 1).alias("n"))))
        return F.when(fresh, F.concat(acc, one)).otherwise(grown)

    # try_element_at is null-safe on the first step
    def safe(acc, t):
        return F.when(F.size(acc) == 0, F.array(F.struct(t.cast("double").alias("s"), t.cast("double").alias("e"), F.lit(1).cast("long").alias("n")))).otherwise(step(acc, t))

    cut = packed.select(key, F.explode(F.aggregate("times", empty, safe)).alias("b"))
    return cut.select(F.col(key).alias("key"), F.col("b.s").alias("batch_start"), F.col("b.e").alias("batch_end"), F.col("b.n").alias("n_events"))


def _hold(gap: float, cap: float) -> Callable:
    """State per key: first and last time, number and paths of the open batch."""

    def run(key, frames: Iterator, state):
        import pandas as pd

        out = []
        open_batch = list(state.get) if state.exists else None

        def emit(b):
            out.append((str(key[0]), b[0], b[1], int(b[2]), sorted(set(b[3]))))

        if state.hasTimedOut:
            emit(open_batch)
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("at")
            for at, path in zip(rows["at"], rows["path"]):
                if open_batch is not None and (at - open_batch[1] > gap or at - open_batch[0] > cap):
                    emit(open_batch)
                    open_batch = None
                if open_batch is None:
                    open_batch = [at, at, 0, []]
                open_batch = [open_batch[0], max(at, open_batch[1]), open_batch[2] + 1, [*open_batch[3], path]]
            state.update((float(open_batch[0]), float(open_batch[1]), int(open_batch[2]), list(open_batch[3])))
            deadline = min(open_batch[1] + gap, open_batch[0] + cap)
            state.setTimeoutTimestamp(max(int(deadline * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "batch_start", "batch_end", "n_events", "paths"])

    return run


def debounced_stream(events: DataFrame, gap: float, cap: float, late: str = "10 seconds") -> DataFrame:
    """The same over a stream with ``key``, ``path`` and ``event_time``; a batch is emitted once the watermark passes its deadline."""
    timed = events.withWatermark("event_time", late).select("key", "path", "event_time", (F.unix_micros("event_time") / 1e6).alias("at"))
    return timed.groupBy("key").applyInPandasWithState(_hold(gap, cap), BATCHES, "first double, last double, n long, paths array<string>", "append", "EventTimeTimeout")


def checkpoint_for(spark: SparkSession, name: str) -> str:
    """A folder for the progress of a stream inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/streams/{name}"


def incremental_nodes(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Nodes after a micro-batch: files of the batch are replaced by its rows, all others stay."""
    files = batch.select(F.col("file_path").alias("key")).distinct()
    return upsert_nodes(replace_files(old, batch.limit(0), files), batch)


def run_available(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process what is there, batch by batch, with exactly-once progress, and stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_for(stream.sparkSession, name)).trigger(availableNow=True).start()
    query.awaitTermination()
