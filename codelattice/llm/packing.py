"""Items of varying size into containers of one capacity, with little unused space.

The plan is made on the histogram of sizes, which has at most ``capacity``
entries however many items there are: first the Martello-Toth reduction fixes
containers whose content dominates every alternative, many equal ones at a
time, then best-fit decreasing places the rest. The plan is a list of
rules (size, first item, items per container, first container), also bounded
by the capacity. Items are numbered within their size over salted buckets and
look their rule up by binary search.

Defined results: an item larger than the capacity fills whole containers and
its remainder is packed like an item (piece numbers tell the parts); an item of
size 0 or null takes no room and gets container -1; equal items are packed one
by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, salted_rank

Rule = tuple[int, int, int, int, int]  # size, first item, items, items per container, first container


class Plan:
    """Rules and counters of one capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.rules, self.containers, self.reduced = capacity, [], 0, 0
        self.next_item: dict[int, int] = {}

    def place(self, size: int, items: int, each: int, first: int) -> None:
        start = self.next_item.get(size, 0)
        self.rules.append((size, start, items, each, first))
        self.next_item[size] = start + items

    def fix(self, content: list[int], times: int) -> None:
        """``times`` new containers, each with the sizes of ``content``."""
        for size in sorted(set(content)):
            each = content.count(size)
            self.place(size, each * times, each, self.containers)
        self.containers += times
        self.reduced += times


class _Stock:
    """Items left by size, with the largest size in stock up to a bound looked up by path halving."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for size, n in counts.items():
            self.left[size] = n
        self.lower = list(range(capacity + 1))

    def largest(self, bound: int) -> int:
        """Largest size in stock of at most ``bound``; 0 if there is none."""
        lower, left, at = self.lower, self.left, bound
        while at and not left[at]:
            step = lower[at]
            if step == at:
                lower[at] = step = at - 1
            elif not left[step]:
                lower[at] = lower[step] if lower[step] != step else max(0, step - 1)
                step = lower[at]
            at = step
        return at

    def beside(self, taken: list[int], bound: int) -> int:
        """The same when the items of ``taken`` are out of stock."""
        at = self.largest(bound)
        while at and self.left[at] <= taken.count(at):
            at = self.largest(at - 1)
        return at

    def smallest(self, how_many: int) -> list[int]:
        out: list[int] = []
        at = self.first
        while len(out) < how_many and at < len(self.left):
            out += [at] * min(self.left[at], how_many - len(out))
            at += 1
        return out

    def settle(self) -> None:
        """Moves the mark of the smallest size in stock."""
        at = getattr(self, "first", 1)
        while at < len(self.left) and not self.left[at]:
            at += 1
        self.first = at


def _pairs_of(stock: _Stock, j: int, room: int, b: int) -> tuple[int, int]:
    """Largest sum of two further items that fit beside ``j``, and of two that are both above ``b``; 0 if there is none."""
    import numpy as np

    left = np.array(stock.left[: room + 1], "i8")
    if j <= room:
        left[j] -= 1
    sizes = np.flatnonzero(left > 0)
    best = [0, 0]
    for i, pool in enumerate((sizes, sizes[sizes > b])):
        if not len(pool):
            continue
        at = np.searchsorted(pool, room - pool, "right") - 1
        own = (at >= 0) & (pool[np.maximum(at, 0)] == pool) & (left[pool] < 2)
        at = np.where(own, at - 1, at)  # a single item is no pair with itself
        sums = np.where(at >= 0, pool + pool[np.maximum(at, 0)], 0)
        best[i] = int(sums.max())
    return best[0], best[1]


def _dominant(stock: _Stock, j: int, capacity: int) -> list[int] | None:
    """The set with ``j`` that dominates every other feasible set with ``j``, or None if none of the tests shows one."""
    room = capacity - j
    k = stock.beside([j], room)
    if not k:
        return [j]  # nothing fits beside it
    if k == room:
        return [j, k]  # whatever else fits has at most the size of k
    low = stock.smallest(4)
    if j in low:
        low.remove(j)
    if sum(low[:2]) > room or len(low) < 2:
        return [j, k]  # no two items fit: the largest dominates every single one
    if sum(low[:3]) <= room and len(low) > 2:
        return None  # sets of three or more fit, and nothing is said about them
    b = stock.beside([j, k], room - k)
    pair, high_pair = _pairs_of(stock, j, room, b)
    if pair <= k:
        return [j, k]  # every pair lies within k
    if b and high_pair <= k:
        return [j, k, b]  # a pair lies in k and b, or both of it within k
    return None


def reduce_dominated(counts: dict[int, int], plan: Plan) -> dict[int, int]:
    """Martello-Toth reduction over a histogram, with sets of up to three items.

    A set with item j dominates another if the other's items can be dealt to
    its members so that each member is at least as large as what it is dealt.
    Sets that dominate all others with j are fixed for as many j as there are;
    where three or more items fit beside j, only an exact fit is fixed.
    """
    capacity = plan.capacity
    stock = _Stock(counts, capacity)
    changed = True
    while changed:
        changed = False
        stock.settle()
        for j in range(capacity, 0, -1):
            while stock.left[j] > 0:
                stock.settle()
                content = _dominant(stock, j, capacity)
                if content is None:
                    break
                times = min(stock.left[s] // content.count(s) for s in set(content))
                plan.fix(content, times)
                for s in content:
                    stock.left[s] -= times
                changed = True
    return {s: n for s, n in enumerate(stock.left) if n > 0}


def best_fit(counts: dict[int, int], plan: Plan) -> None:
    """Best-fit decreasing: the largest items first, each into the fullest container that takes it.

    Containers with equal room and neighbouring numbers are handled together.
    """
    import bisect

    rooms: list[int] = []  # ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first container, containers)]

    def put(room: int, first: int, n: int) -> None:
        if n <= 0 or room <= 0:
            return
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((first, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = plan.capacity // size
                new = -(-n // each)
                full, rest = divmod(n, each)
                if full:
                    plan.place(size, full * each, each, plan.containers)
                    put(plan.capacity - each * size, plan.containers, full)
                if rest:
                    plan.place(size, rest, rest, plan.containers + full)
                    put(plan.capacity - rest * size, plan.containers + full, 1)
                plan.containers += new
                n = 0
                break
            room = rooms[at]
            first, m = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // size
            full = min(m, n // each)
            rest = min(n - full * each, each - 1) if full < m else 0
            if full:
                plan.place(size, full * each, each, first)
                put(room - each * size, first, full)
            if rest:
                plan.place(size, rest, rest, first + full)
                put(room - rest * size, first + full, 1)
            put(room, first + full + (rest > 0), m - full - (rest > 0))
            n -= full * each + rest


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan(capacity)
    if counts.get(capacity):
        plan.fix([capacity], counts[capacity])
    rest = {s: n for s, n in counts.items() if 0 < s < capacity and n > 0}
    best_fit(reduce_dominated(rest, plan), plan)
    return plan


def _assign(batches: Iterator, rules: list[Rule]) -> Iterator:
    import numpy as np
    import pyarrow as pa

    table = np.array(sorted(rules), "i8").reshape(-1, 5)
    sizes, first = np.unique(table[:, 0], return_index=True)
    # items are numbered through all sizes, so any size and any number of items has a key
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(table[:, 2], first) if len(first) else [])]).astype("i8")
    keys = ends[np.searchsorted(sizes, table[:, 0])] + table[:, 1]
    for batch in batches:
        size, at = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
        if not len(size):
            continue
        rule = np.searchsorted(keys, ends[np.searchsorted(sizes, size)] + at, "right") - 1
        if not np.array_equal(table[rule, 0], size):
            raise ValueError("an item has no rule: the sizes changed while they were packed")
        container = table[rule, 4] + (at - table[rule, 1]) // table[rule, 3]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(container)], names=["item", "piece", "size", "container"])


def pack(items: DataFrame, capacity: int, item: str = "item", size: str = "size") -> tuple[DataFrame, Plan]:
    """``item, piece, size, container`` and the plan.

    ``items`` has one row per item and is read twice, so it should be cut.
    """
    kind = items.schema[item].dataType.simpleString()
    sized = items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    empty = sized.filter(F.col("n") <= 0).select("item", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("size"), F.lit(-1).cast("long").alias("container"))
    whole = F.floor(F.col("n") / capacity)
    tail = F.col("n") % capacity
    remainders = sized.filter(tail > 0).filter("n > 0").select("item", whole.cast("long").alias("piece"), tail.alias("size"))
    histogram = {r["size"]: r["count"] for r in remainders.groupBy("size").count().collect()}  # at most capacity rows
    plan = make_plan(histogram, capacity)
    numbered = salted_rank(remainders, ["size"], ["item"], "at")
    rules = plan.rules
    placed = numbered.select("item", "piece", "size", "at").mapInArrow(lambda it: _assign(it, rules), f"item {kind}, piece long, size long, container long")
    # whole containers of items above the capacity: numbered after all others
    large = sized.filter(F.col("n") >= capacity).select("item", F.explode(F.sequence(F.lit(0).cast("long"), (whole - 1).cast("long"))).alias("piece"))
    filled = salted_rank(large, [], ["item", "piece"], "at").select("item", "piece", F.lit(capacity).cast("long").alias("size"), (F.col("at") + F.lit(plan.containers)).alias("container"))
    return placed.unionByName(filled).unionByName(empty), plan


def pack_all(items: DataFrame, capacities: list[int], item: str = "item", size: str = "size") -> DataFrame:
    """The packings of several capacities, with a column ``capacity``."""
    from functools import reduce

    held = cut(items)
    if not capacities:
        return held.limit(0).select(F.lit(0).cast("long").alias("capacity"), F.lit(0).cast("long").alias("container"), F.col(item).alias("item"), F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("size"))
    parts = [pack(held, c, item, size)[0].select(F.lit(c).cast("long").alias("capacity"), "container", "item", "piece", "size") for c in capacities]
    return reduce(DataFrame.unionByName, parts)


def packing_report(packed: DataFrame) -> DataFrame:
    """Items, containers, fewest containers any packing could have, and the share of space used, per capacity."""
    per_container = packed.filter(F.col("container") >= 0).groupBy("capacity", "container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    told = per_container.groupBy("capacity").agg(F.sum("pieces").alias("n_pieces"), F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return told.withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity"))).withColumn("used_share", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
