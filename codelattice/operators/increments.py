"""Processing only what is new or changed since the last successful run.

Processed sequence numbers are kept as disjoint intervals. A run subtracts
them from the ranges that are available, reads the gaps (late commits fall
into gaps below the highest processed number and are found like any other) and
commits its output together with the merged intervals in one manifest. A
manifest that exists is complete: a run that dies before it leaves files no
reader looks at, and its numbers stay a gap for the next run.

Interval sets are frames (lo, hi) of any size: they are merged and subtracted
in range pieces, and only one row per piece meets the others. Rows find their
interval by range filters where there are few, else by binary search in sorted
arrays, sent whole up to ``ARRAY_INTERVALS`` and by range beyond that.

Sequence numbers are integers (run or commit numbers); a row whose number is
null belongs to no run and is never processed. Rows with one number are
processed together: a number may only be offered once all its rows are there,
a row that comes later under a processed number is not looked at.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

FILTER_INTERVALS = 64  # up to this many are range filters, which reach the scan
ARRAY_INTERVALS = 500_000  # up to this many (8 MB) go to every task
RANGE_INTERVALS = 50_000  # beyond, intervals of one range
RANGE_SALTS = 16  # tasks over which the rows of one range are spread


def _pieces(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in range pieces, ascending by ``order``; cut, so that the pieces stay what they are."""
    return cut(df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()))


def _before_piece(per_piece: DataFrame, **folds) -> DataFrame:
    """``_p`` and each fold over all earlier pieces; one row per piece is all that meets here."""
    earlier = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    return per_piece.select(F.col("_piece").alias("_p"), *[f.over(earlier).alias(name) for name, f in folds.items()])


def islands(df: DataFrame, seq: str, width: int = 1 << 20) -> DataFrame:
    """Disjoint intervals (lo, hi) of the integers in ``seq``; runs of neighbours are found within blocks of ``width`` numbers, then the blocks' intervals are joined."""
    numbers = df.filter(F.col(seq).isNotNull()).select(F.col(seq).cast("long").alias("_n")).distinct().withColumn("_block", F.floor(F.col("_n") / width))
    block = W.partitionBy("_block").orderBy("_n")
    runs = numbers.withColumn("_run", F.col("_n") - F.row_number().over(block))
    short = runs.groupBy("_block", "_run").agg(F.min("_n").alias("lo"), F.max("_n").alias("hi")).select("lo", "hi")
    return join_neighbours(short)


def join_neighbours(intervals: DataFrame) -> DataFrame:
    """Touching or overlapping intervals become one."""
    pieces = _pieces(intervals.filter("lo <= hi").select("lo", "hi"), "lo", "hi")
    reach = _before_piece(pieces.groupBy("_piece").agg(F.max("hi").alias("_hi")), _reach=F.max("_hi"))
    inside = W.partitionBy("_piece").orderBy("lo", "hi")
    so_far = F.greatest(F.max("hi").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.col("_reach"))
    marked = pieces.join(reach, F.col("_piece") == F.col("_p")).withColumn("_far", so_far)
    marked = marked.withColumn("_start", F.when(F.col("_far").isNull() | (F.col("lo") > F.col("_far") + 1), F.col("lo"))).select("lo", "hi", "_piece", "_start")
    # every interval belongs to the last start at or before it
    starts = _before_piece(marked.groupBy("_piece").agg(F.max("_start").alias("_s")), _last=F.max("_s"))
    own = F.coalesce(F.max("_start").over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("_last"))
    return marked.join(starts, F.col("_piece") == F.col("_p")).withColumn("_group", own).groupBy("_group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi")


def gaps_between(available: DataFrame, processed: DataFrame) -> DataFrame:
    """Parts of the ``available`` intervals that no ``processed`` interval covers, as disjoint intervals."""

    def ends(df: DataFrame, a: int, p: int) -> DataFrame:
        one = df.select(F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("sign")))).alias("e"))
        return one.select("e.at", (F.col("e.sign") * a).alias("da"), (F.col("e.sign") * p).alias("dp"))

    steps = ends(available, 1, 0).unionByName(ends(processed, 0, 1)).groupBy("at").agg(F.sum("da").alias("da"), F.sum("dp").alias("dp"))
    pieces = _pieces(steps, "at")
    per_piece = pieces.groupBy("_piece").agg(F.sum("da").alias("_a"), F.sum("dp").alias("_d"), F.min("at").alias("_first"))
    earlier = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_piece.select(
        F.col("_piece").alias("_p"), F.coalesce(F.sum("_a").over(earlier), F.lit(0)).alias("_oa"), F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_od"), F.lead("_first").over(W.orderBy("_piece")).alias("_after")
    )
    order = W.partitionBy("_piece").orderBy("at")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    spans = pieces.join(offsets, F.col("_piece") == F.col("_p")).select(
        "at", F.coalesce(F.lead("at").over(order), "_after").alias("next"), (F.col("_oa") + F.sum("da").over(upto)).alias("a"), (F.col("_od") + F.sum("dp").over(upto)).alias("p")
    )
    open_spans = spans.filter((F.col("a") > 0) & (F.col("p") <= 0) & F.col("next").isNotNull()).select(F.col("at").alias("lo"), (F.col("next") - 1).alias("hi"))
    return join_neighbours(open_spans)


def _probe(batches: Iterator, at: int, los, his) -> Iterator:
    """Adds whether the number in column ``at`` lies in one of the sorted intervals."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        numbers = batch.column(at)
        known = ~np.asarray(numbers.is_null())
        values = numbers.fill_null(0).to_numpy(zero_copy_only=False)
        slot = np.searchsorted(los, values, "right") - 1
        inside = known & (slot >= 0) & (values <= his[np.maximum(slot, 0)]) if len(los) else np.zeros(len(values), bool)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside)], names=[*batch.schema.names, "_inside"])


def mark_within(df: DataFrame, seq: str, intervals: DataFrame, out: str) -> DataFrame:
    """``df`` with a boolean ``out``: whether the number lies in one of the disjoint ``intervals``; false for a null.

    No row is moved unless there are more than ``ARRAY_INTERVALS``.
    """
    held = cut(intervals.select("lo", "hi"))
    n = held.count()
    if n <= FILTER_INTERVALS:
        test = F.lit(False)
        for lo, hi in held.collect():
            test = test | F.col(seq).between(lo, hi)
        return df.withColumn(out, F.coalesce(test, F.lit(False)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    if n <= ARRAY_INTERVALS:
        arrays = held.orderBy("lo").toPandas()  # at most 8 MB
        los, his = arrays["lo"].to_numpy(), arrays["hi"].to_numpy()
        at = df.columns.index(seq)
        return df.mapInArrow(lambda it: _probe(it, at, los, his), ", ".join([*fields, "_inside boolean"])).withColumnRenamed("_inside", out)
    # ranges of intervals; the rows of a range are spread over salts
    ranges = held.repartitionByRange(-(-n // RANGE_INTERVALS), "lo").withColumn("_range", F.spark_partition_id())
    ranges = cut(ranges.groupBy("_range").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_spans")))
    bounds = [r[0] for r in ranges.select(F.col("_spans")[0]["lo"].alias("lo")).orderBy("lo").collect()]  # one number for RANGE_INTERVALS intervals
    table = ranges.select(F.col("_spans")[0]["lo"].alias("_lo"), "_spans", F.explode(F.sequence(F.lit(0), F.lit(RANGE_SALTS - 1))).alias("_salt"))
    at = df.columns.index(seq)
    ranked = df.mapInArrow(lambda it: _rank(it, at, bounds), ", ".join([*fields, "_bound long"]))
    salted = ranked.withColumn("_row_salt", F.pmod(F.monotonically_increasing_id(), F.lit(RANGE_SALTS)).cast("int"))
    joined = salted.join(table, (F.col("_bound") == F.col("_lo")) & (F.col("_row_salt") == F.col("_salt")), "left")
    return joined.withColumn(out, F.coalesce(F.exists("_spans", lambda x: F.col(seq).between(x["lo"], x["hi"])), F.lit(False))).select(*df.columns, out)


def _rank(batches: Iterator, at: int, bounds: list[int]) -> Iterator:
    """Adds the greatest bound that is not above the number in column ``at``; null if there is none."""
    import numpy as np
    import pyarrow as pa

    sorted_bounds = np.array(bounds, "i8")
    for batch in batches:
        numbers = batch.column(at)
        slot = np.searchsorted(sorted_bounds, numbers.fill_null(0).to_numpy(zero_copy_only=False), "right") - 1
        none = np.asarray(numbers.is_null()) | (slot < 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sorted_bounds[np.maximum(slot, 0)], mask=none)], names=[*batch.schema.names, "_bound"])


def rows_within(df: DataFrame, seq: str, intervals: DataFrame) -> DataFrame:
    """Rows whose number lies in one of the disjoint ``intervals``."""
    return mark_within(df, seq, intervals, "_within").filter("_within").select(*df.columns)


class IntervalLedger:
    """Output batches and processed intervals of one incremental job, in a shared folder.

    ``<root>/batch-<id>`` holds the rows of a run, ``<root>/intervals-<id>`` a
    set of processed intervals and ``<root>/manifests/<n>.json`` the n-th
    committed state: the set and all batches that count. A manifest is written
    under a temporary name and renamed to the next number without overwriting,
    so of two runs that race one fails and commits nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _latest(self) -> int:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def state(self) -> dict:
        version = self._latest()
        if not version:
            return {"version": 0, "intervals": None, "batches": []}
        text = self.spark.read.text(f"{self.root}/manifests/{version}.json", wholetext=True).first()[0]
        return {"version": version} | json.loads(text)

    def processed(self, state: dict | None = None) -> DataFrame:
        """The processed intervals (lo, hi)."""
        folder = (state or self.state())["intervals"]
        return self.spark.read.parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], "lo long, hi long")

    def adopt(self, intervals: DataFrame) -> int:
        """Takes over what another record keeps as processed, as the first state of this ledger."""
        return self._commit(1, self._keep(intervals), [])

    def pending(self, source: DataFrame, seq: str, state: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows in the gaps, and the gaps: available numbers no processed interval covers. ``source`` is read twice."""
        gaps = cut(gaps_between(islands(source, seq), self.processed(state)))
        return rows_within(source, seq, gaps), gaps

    def run(self, source: DataFrame, seq: str, process, before_commit=None) -> int:
        """Process the gaps once; the number of the manifest that holds the result (unchanged if there was nothing)."""
        state = self.state()
        rows, gaps = self.pending(source, seq, state)
        if gaps.isEmpty():
            return state["version"]
        batch = f"batch-{uuid.uuid4().hex}"
        process(rows).write.parquet(f"{self.root}/{batch}")
        if before_commit:
            before_commit()
        merged = self._keep(join_neighbours(self.processed(state).unionByName(gaps)))
        return self._commit(state["version"] + 1, merged, [*state["batches"], batch])

    def _keep(self, intervals: DataFrame) -> str:
        name = f"intervals-{uuid.uuid4().hex}"
        intervals.select("lo", "hi").write.parquet(f"{self.root}/{name}")
        return name

    def _commit(self, version: int, intervals: str, batches: list[str]) -> int:
        content = {"intervals": intervals, "batches": batches}
        temporary, final = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{version}.json")
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(final), options)
        return version

    def output(self) -> DataFrame | None:
        """The committed rows, or None before the first commit."""
        batches = self.state()["batches"]
        return self.spark.read.parquet(*[f"{self.root}/{b}" for b in batches]) if batches else None
