"""Sources mixed to target shares of the total size.

The texts of a source are laid end to end in a pseudorandom order and cut into
blocks of equal length in tokens. The mix has as many blocks as the scarcest
source allows at its share (or fewer, on request). Every output shard draws how
many of its slots go to which source: multinomial counts, conditioned on the
total quota of each source, so the shares hold exactly over all shards. They
are drawn in the tasks by keyed halving of the shards; no list of shards exists
anywhere. The
i-th slot of a source takes block pi(i mod B), pi being a keyed permutation of
the B blocks that changes with every pass over the source; slots and blocks are
joined by that index.

A block is used at most ``max_repeats`` times, so no document is used more
often. Blocks may begin and end inside a document.

Defined results: labels are compared without outer blanks and letter case; a
document without a label, or whose source has no target, is not mixed; a target
without documents, with a null or non-positive share or fewer than one repeat
is reported with a reached share of 0, and the others share the rest in
proportion; repeated targets count once (the greatest share); documents without
tokens take no part; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, salted_prefix_sum

# --- parameters ---

BLOCK_TOKENS = 256
SLOTS_PER_SHARD = 1024
SHARDS_PER_TASK = 1024
SEED = 77

SLOT = "shard long, slot long, source string, pass_no long, block long"


@dataclass
class SourcePlan:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    blocks: int
    quota: int  # slots of the mix


def label(column: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), F.lit(""))


def plan_sources(available: dict[str, int], targets: list[tuple[str, float, int]], block: int, slots: int | None = None) -> list[SourcePlan]:
    """Blocks and slots of every target; the mix is as large as the scarcest source with documents allows."""
    best: dict[str, tuple[float, int]] = {}
    for source, share, repeats in targets:
        if source is not None:
            best[source] = max(best.get(source, (0.0, 0)), (share or 0.0, repeats or 0))
    plans = []
    for source, (share, repeats) in sorted(best.items()):
        tokens = available.get(source, 0)
        plans.append(SourcePlan(source, share, repeats, tokens, -(-tokens // block), 0))
    live = [p for p in plans if p.blocks and p.target_share > 0 and p.max_repeats >= 1]
    whole = sum(p.target_share for p in live)
    if not live:
        return plans
    largest = int(min(p.blocks * p.max_repeats / (p.target_share / whole) for p in live))
    total = largest if slots is None else min(slots, largest)
    # largest remainders, so quotas add up; no quota exceeds what the source may give
    exact = [total * p.target_share / whole for p in live]
    for p, e in zip(live, exact):
        p.quota = min(int(e), p.blocks * p.max_repeats)
    short = total - sum(p.quota for p in live)
    for p, _ in sorted(zip(live, exact), key=lambda x: (int(x[1]) - x[1], x[0].source)):
        if short > 0 and p.quota < p.blocks * p.max_repeats:
            p.quota, short = p.quota + 1, short - 1
    return plans


def permute(index, size: int, key: int):
    """Keyed permutation of ``range(size)``: a Feistel network over the next even power of two, walked until inside."""
    import numpy as np

    index = np.asarray(index, "u8").copy()
    if size <= 1:
        return index.astype("i8")
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    rng = np.random.default_rng(key)
    keys = rng.integers(1, 1 << 62, 6, dtype="u8")
    todo = np.ones(len(index), bool)
    while todo.any():
        x = index[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        index[todo] = (left << np.uint64(half)) | right
        todo[todo] = index[todo] >= size
    return index.astype("i8")


def _stable_key(*parts) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def draw_without_return(rng, good: int, bad: int, drawn: int) -> int:
    """Hypergeometric draw for populations of any size.

    The ratios of neighbouring probabilities are laid out around the mean, far
    enough that what lies beyond is below the precision of a double, and one
    uniform number is looked up in their running sum.
    """
    import numpy as np

    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    share = good / (good + bad)
    mean = drawn * share
    reach = 12 * (mean * (1 - share)) ** 0.5 + 40
    first, last = max(low, int(mean - reach)), min(high, int(mean + reach) + 1)
    k = np.arange(first, last, dtype="f8")
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    running = np.cumsum(np.exp(weight - weight.max()))
    return min(last, first + int(np.searchsorted(running, rng.random() * running[-1], "right")))


def shard_counts(quotas: list[int], shards: int, seed: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, list[int], list[int]]]:
    """``(shard, counts, starts)`` of the shards from ``first`` up to ``last``: slots of every source in the shard and in the shards before it.

    Counts are multinomial given the quotas. The shards are halved again and
    again; the left half draws its counts from those of the whole with a key of
    its own, so any task finds its shards on its own, by as many draws as the
    number of shards has binary digits, and all tasks agree.
    """
    import numpy as np

    total, last = sum(quotas), shards if last is None else last

    def before(shard: int) -> int:
        return total * shard // shards

    pending = [(0, shards, list(quotas), [0] * len(quotas))]
    while pending:
        lo, hi, counts, starts = pending.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, counts, starts
            continue
        middle = (lo + hi) // 2
        rng = np.random.default_rng(_stable_key(seed, "halve", lo, hi))
        size, rest, left = before(middle) - before(lo), sum(counts), []
        for n in counts:
            rest -= n
            taken = draw_without_return(rng, n, rest, size)
            left.append(taken)
            size -= taken
        pending.append((middle, hi, [n - m for n, m in zip(counts, left)], [a + m for a, m in zip(starts, left)]))
        pending.append((lo, middle, left, starts))


def _slots(batches: Iterator, plans: list[SourcePlan], shards: int, seed: int) -> Iterator:
    """The slots of each shard: which source, pass and block; their order within the shard is shuffled."""
    import numpy as np
    import pyarrow as pa

    names = pa.array([p.source for p in plans], pa.string())
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        if not len(numbers):
            continue
        wanted = set(numbers.tolist())
        for shard, counts, starts in shard_counts([p.quota for p in plans], shards, seed, int(numbers.min()), int(numbers.max()) + 1):
            if shard not in wanted:
                continue
            passes, blocks = [], []
            for p, n, start in zip(plans, counts, starts):
                at = np.arange(start, start + n)
                turn = at // p.blocks
                out = np.empty(n, "i8")
                for t in np.unique(turn):
                    here = turn == t
                    out[here] = permute(at[here] % p.blocks, p.blocks, _stable_key(seed, p.source, int(t)))
                passes.append(turn)
                blocks.append(out)
            order = np.random.default_rng(_stable_key(seed, "order", shard)).permutation(sum(counts))
            source = np.repeat(np.arange(len(plans)), counts)[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(order), shard, "i8")), pa.array(np.arange(len(order), dtype="i8")), names.take(pa.array(source)), pa.array(np.concatenate(passes)[order]), pa.array(np.concatenate(blocks)[order])],
                names=["shard", "slot", "source", "pass_no", "block"],
            )


def mix_slots(spark, plans: list[SourcePlan], seed: int = SEED, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """``shard, slot, source, pass_no, block`` for every slot of the mix."""
    live = [p for p in plans if p.quota]
    shards = -(-sum(p.quota for p in live) // slots_per_shard)
    tasks = max(1, min(shards, max(spark.sparkContext.defaultParallelism, -(-shards // SHARDS_PER_TASK))))
    return spark.range(shards, numPartitions=tasks).mapInArrow(lambda it: _slots(it, live, shards, seed), SLOT)


def source_pieces(sized: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """Parts of documents by block: ``source, block, doc, doc_start, piece_tokens``; ``sized`` has doc, source and n_tokens."""
    laid = salted_prefix_sum(sized.filter("n_tokens > 0"), ["source"], ["doc"], F.col("n_tokens"), "before")
    last = F.col("before") + F.col("n_tokens")
    spread = laid.select("*", F.explode(F.sequence(F.floor(F.col("before") / block), F.floor((last - 1) / block))).alias("block"))
    begin = F.greatest(F.col("before"), F.col("block") * block)
    end = F.least(last, (F.col("block") + 1) * block)
    return spread.select("source", "block", "doc", (begin - F.col("before")).alias("doc_start"), (end - begin).alias("piece_tokens"))


def mix(sized: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, slots: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix, piece by piece, and the report of shares.

    ``sized`` (doc, source, n_tokens; read several times, so cut it) and
    ``targets`` (source, target_share, max_repeats), labels as in :func:`label`.
    The targets and one sum per target go through the driver.
    """
    spark = sized.sparkSession
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").distinct().collect()]
    names = [w[0] for w in wanted if w[0] is not None]
    used = sized.filter(F.col("source").isin(names))
    sums = {r["source"]: r["tokens"] for r in used.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
    plans = plan_sources(sums, wanted, block, slots)
    taken = mix_slots(spark, plans, seed).withColumnsRenamed({"source": "_source", "block": "_block"})
    pieces = source_pieces(used, block)
    # both sides grow with the data: neither is sent to all
    mixed = taken.join(pieces.hint("merge"), (F.col("source") == F.col("_source")) & (F.col("block") == F.col("_block"))).select(
        "shard", "slot", "source", "block", "pass_no", "doc", "doc_start", "piece_tokens"
    )
    mixed = cut(mixed)
    reached = mixed.groupBy(F.col("source").alias("_source")).agg(F.sum("piece_tokens").alias("mixed_tokens"), F.max("pass_no").alias("last_pass"))
    total = mixed.agg(F.sum("piece_tokens")).first()[0] or 0
    rows = [(p.source, float(p.target_share), int(p.max_repeats), int(p.tokens), int(p.quota)) for p in plans]
    told = spark.createDataFrame(rows, "source string, target_share double, max_repeats long, available_tokens long, slots long")
    report = told.join(reached, F.col("source") == F.col("_source"), "left").select(
        "source", "target_share", "max_repeats", "available_tokens", "slots", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        (F.coalesce("mixed_tokens", F.lit(0)) / F.lit(max(1, total))).alias("reached_share"), F.coalesce(F.col("last_pass") + 1, F.lit(0)).alias("passes"),
    )
    return mixed, report
