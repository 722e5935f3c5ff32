"""Orphan references: keys named in one table that no row of another table has.

Keys are spread over ranges of their 64-bit hash, so ranges are even by
construction and need no sampling pass. Within a range the parents stand as a
sorted array; references, already folded to one row per (key, label), stream
past in Arrow batches and are probed by binary search. Equal hashes are
compared by text, so the answer is exact.

A null key refers to nothing and is left out. Every row counts, copies too; a
hot key is folded before the first exchange. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucket_count

LABELS = ["table_name", "column_name", "period"]


def _probe(batches: Iterator, labels: list[str]) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    current, hashes, names = None, [], []
    sorted_hashes, sorted_names = np.empty(0, "i8"), pa.array([], pa.string())
    frozen = True

    def misses(batch: pa.RecordBatch) -> pa.RecordBatch:
        hs = batch.column("key_hash").to_numpy(zero_copy_only=False)
        keys = batch.column("ref_key")
        found = np.zeros(len(hs), bool)
        if len(sorted_hashes):
            at = np.searchsorted(sorted_hashes, hs, "left")
            live = np.arange(len(hs))
            while len(live):  # more than one round only where different keys share a hash
                inside = at[live] < len(sorted_hashes)
                live = live[inside]
                live = live[sorted_hashes[at[live]] == hs[live]]
                if not len(live):
                    break
                same = pc.equal(pc.take(sorted_names, pa.array(at[live])), pc.take(keys, pa.array(live))).to_numpy(zero_copy_only=False).astype(bool)
                found[live[same]] = True
                live = live[~same]
                at[live] += 1
        return batch.filter(pa.array(~found)).select([*labels, "ref_key", "n_refs"])

    for batch in batches:
        ranges = batch.column("range_id").to_numpy(zero_copy_only=False)
        parent = batch.column("is_ref").to_numpy(zero_copy_only=False) == 0
        cuts = np.flatnonzero((np.diff(ranges) != 0) | (np.diff(parent.astype("i1")) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(ranges)]):
            if lo == hi:
                continue
            if ranges[lo] != current:
                current, hashes, names, frozen = ranges[lo], [], [], False
            part = batch.slice(lo, hi - lo)
            if parent[lo]:
                hashes.append(part.column("key_hash").to_numpy(zero_copy_only=False))
                names.append(part.column("ref_key"))
                continue
            if not frozen:
                sorted_hashes = np.concatenate(hashes) if hashes else np.empty(0, "i8")
                sorted_names = pa.chunked_array(names, pa.string()).combine_chunks() if names else pa.array([], pa.string())
                frozen = True
            yield misses(part)


def orphan_references(references: DataFrame, parents: DataFrame, keys_per_range: int = 50_000, labels: list[str] = LABELS) -> DataFrame:
    """References whose key no parent has, as (labels, ref_key, n_refs).

    ``references`` has the label columns and ``ref_key`` (string), ``parents``
    a column ``ref_key``. Parents may repeat.
    """
    folded = references.filter(F.col("ref_key").isNotNull()).groupBy(*labels, "ref_key").agg(F.count(F.lit(1)).alias("n_refs"))
    known = parents.filter(F.col("ref_key").isNotNull()).select("ref_key")
    ranges = bucket_count(known.count(), keys_per_range, least=64)
    known = known.distinct()

    def placed(df: DataFrame, tag: int) -> DataFrame:
        hashed = F.xxhash64("ref_key")
        # the top 31 bits order the hash space; equal slices of it are the ranges
        return df.withColumn("key_hash", hashed).withColumn(
            "range_id", F.floor((F.shiftrightunsigned(hashed, 33)) * F.lit(ranges) / F.lit(1 << 31)).cast("int")
        ).withColumn("is_ref", F.lit(tag))

    nothing = [F.lit(None).cast(references.schema[c].dataType).alias(c) for c in labels]
    both = placed(known.select(*nothing, "ref_key", F.lit(0).cast("long").alias("n_refs")), 0).unionByName(placed(folded, 1))
    laid = both.repartition("range_id").sortWithinPartitions("range_id", "is_ref", "key_hash")
    fields = ", ".join(f"{c} {references.schema[c].dataType.simpleString()}" for c in labels)
    return laid.mapInArrow(lambda it: _probe(it, labels), f"{fields}, ref_key string, n_refs long")


def orphan_report(references: DataFrame, orphans: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """References, orphan references and orphan keys of each table, column and period."""
    totals = references.filter(F.col("ref_key").isNotNull()).groupBy(*labels).agg(F.count(F.lit(1)).alias("n_refs"))
    lost = orphans.groupBy(*labels).agg(F.sum("n_refs").alias("n_orphan_refs"), F.count(F.lit(1)).alias("n_orphan_keys"))
    empty = F.lit(0).cast("long")
    both = totals.select(*labels, "n_refs", empty.alias("n_orphan_refs"), empty.alias("n_orphan_keys")).unionByName(
        lost.select(*labels, empty.alias("n_refs"), "n_orphan_refs", "n_orphan_keys")
    )
    return both.groupBy(*labels).agg(*[F.sum(c).alias(c) for c in ("n_refs", "n_orphan_refs", "n_orphan_keys")])
