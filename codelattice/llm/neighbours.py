"""The k most similar vectors of every vector, and search in the resulting graph.

NN-descent: a coarse first graph comes from one random sign code (rows sorted
by code are compared with the few next to them), then rounds of Spark joins
introduce the neighbours of every vector to each other and keep what is better.
Only entries that are new since the last round start a comparison, and a vector
whose neighbours are all old gathers none. Every round also lays the vectors
out by fresh codes: that hands the descent a way into groups so small that
no neighbour of a neighbour leads there. Vectors travel as half floats; who
meets whom is decided by ids. Groups are cut into blocks, so no crowded code
and no hub is compared in one piece; what a cut parts, another round brings
together. Searches walk the graph greedily from entry points, a beam of
candidates per query and round.

Defined results: rows whose vector is null, has another length than most of its
group, holds NaN or infinity, or is all zero take no part, nor do null names;
rows with one (group, name) count once (the greatest vector stays); names with
equal vectors share one place in the graph and are unfolded afterwards, ties in
the order of names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import modes
from ..session import cut

# --- parameters ---

NEIGHBOURS = 10  # length of the lists
CODES = 1  # independent sign codes of the first graph
FRESH_CODES = 2  # further codes in every round
FRESH_LISTS = 4  # entries a fresh code may offer a vector
CODE_BITS = 32
WINDOW = 24  # rows after its own that a row is compared with in the order of a code
ROUNDS = 4
FANOUT = 5  # neighbours a vector introduces itself to in a round
GROUP_BLOCK = 96  # vectors compared at once around one centre
GROUP_TASK = 4096  # guests of one centre that one task takes
LEAST_GAIN = 0.002  # rounds end when fewer list entries than this share are new
SEED = 20240917

GRAPH = "id long, ids array<long>, sims array<float>, fresh array<boolean>"


# --- preparation ---------------------------------------------------------------


def usable(df: DataFrame, group: str, name: str, vector: str) -> DataFrame:
    """(grp, name, vec) with one valid row per (group, name)."""
    rows = df.select(F.col(group).alias("grp"), F.col(name).alias("name"), F.col(vector).cast("array<float>").alias("vec")).filter(
        F.col("grp").isNotNull() & F.col("name").isNotNull() & F.col("vec").isNotNull()
    )
    rows = rows.withColumn("len", F.size("vec"))
    usual = modes(rows.select("grp", "len"), ["grp"], "len", "usual").select(F.col("grp").alias("_grp"), "usual")
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = rows.filter(finite & F.exists("vec", lambda x: x != 0.0)).join(usual, (F.col("grp") == F.col("_grp")) & (F.col("len") == F.col("usual")), "left_semi")
    return valid.groupBy("grp", "name").agg(F.max("vec").alias("vec"))


def _halve(batches: Iterator) -> Iterator:
    """Unit length, half floats, as bytes; vectors of one length are worked on together."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("vec"))
        flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sizes = np.diff(at)
        for size in np.unique(sizes):
            take = np.flatnonzero(sizes == size)
            v = flat[at[take][:, None] + np.arange(size)].astype("f8")
            unit = (v / np.sqrt((v * v).sum(1, keepdims=True))).astype("f2")
            part = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _bytes(unit)], names=["grp", "id", "half"])


def _bytes(rows):
    """An Arrow binary array of the rows of a matrix, without a loop."""
    import numpy as np
    import pyarrow as pa

    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1, dtype="i8") * width).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def places(valid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places of the graph ``(grp, id, half)``, their first names and vectors ``(id, grp, names, vec)``, and ``(id, name)`` of all copies.

    Equal vectors share a place; the copies are those of places with several names.
    """
    rows = cut(valid.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(17), "vec")).withColumn("row", F.monotonically_increasing_id()))
    keep = NEIGHBOURS + 1
    # the first names of a place: kept per salt, then together, so a crowd of copies never gathers
    salted = W.partitionBy("grp", "h1", "h2", "salt").orderBy("name")
    first = rows.select("grp", "h1", "h2", "name", "row", F.pmod(F.xxhash64("name"), F.lit(32)).alias("salt")).withColumn("at", F.row_number().over(salted)).filter(F.col("at") <= keep)
    owners = first.groupBy("grp", "h1", "h2").agg(F.slice(F.sort_array(F.collect_list(F.struct("name", "row"))), 1, keep).alias("members"))
    chosen = cut(owners.select("grp", "h1", "h2", F.col("members")[0]["row"].alias("id"), F.col("members.name").alias("names")))
    vectors = rows.select(F.col("row").alias("_row"), "vec")
    fixed = chosen.select("id", "grp", "names").join(vectors, F.col("id") == F.col("_row")).drop("_row")
    halves = cut(fixed.select("grp", "id", "vec").mapInArrow(_halve, "grp string, id long, half binary"))
    shared = chosen.filter(F.size("names") > 1).select("id", F.col("grp").alias("_grp"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    copies = rows.join(shared, (F.col("grp") == F.col("_grp")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("id", "name")
    return halves, fixed, copies


# --- first graph ---------------------------------------------------------------


def _by_size(column):
    """(positions, matrix) of the half vectors of each length."""
    import numpy as np

    data, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, "u1") if data is not None else np.empty(0, "u1")
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        take = np.flatnonzero(sizes == size)
        rows = raw[offsets[take][:, None] + np.arange(size)] if len(take) < len(sizes) else raw[offsets[0] : offsets[-1]].reshape(len(take), size)
        yield take, np.ascontiguousarray(rows).view("f2").astype("f4")


def _encode(batches: Iterator, first: int, codes: int, bits: int, seed: int) -> Iterator:
    """A row per code: ``grp, code_no, code, id, half``; code number ``c`` has planes of its own."""
    import numpy as np
    import pyarrow as pa

    weights = 1 << np.arange(bits, dtype="i8")[::-1]
    planes: dict = {}
    for batch in batches:
        for take, x in _by_size(batch.column(2)):
            part = batch.take(pa.array(take))
            for c in range(first, first + codes):
                if (x.shape[1], c) not in planes:
                    planes[x.shape[1], c] = np.random.default_rng([seed, x.shape[1], c]).standard_normal((x.shape[1], bits)).astype("f4")
                code = (x @ planes[x.shape[1], c] > 0).astype("i8") @ weights
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(take), c, "i4")), pa.array(code), part.column(1), part.column(2)], names=["grp", "code_no", "code", "id", "half"])


def _matrix(column) -> "np.ndarray":
    """Half vectors of one length as a matrix."""
    ((_, x),) = _by_size(column)
    return x


def _fold(own, ids, sims, fresh, k: int):
    """Arrow batch of the ``k`` best different entries of every owner; an entry that is there twice is fresh only if both are."""
    import numpy as np
    import pyarrow as pa

    order = np.lexsort((fresh, ids, own))
    own, ids, sims, fresh = own[order], ids[order], sims[order], fresh[order]
    single = np.ones(len(own), bool)
    single[1:] = (own[1:] != own[:-1]) | (ids[1:] != ids[:-1])
    own, ids, sims, fresh = own[single], ids[single], sims[single], fresh[single]
    order = np.lexsort((ids, -sims, own))
    own, ids, sims, fresh = own[order], ids[order], sims[order], fresh[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(own)]])))
    good = rank < k
    own, ids, sims, fresh = own[good], ids[good], sims[good], fresh[good]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    offsets = pa.array(np.concatenate([starts, [len(own)]]).astype("i4"))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, sims.astype("f4"), fresh)]
    return pa.RecordBatch.from_arrays([pa.array(own[starts]), *lists], names=["id", "ids", "sims", "fresh"])


def _compare_sorted(batches: Iterator, k: int, window: int) -> Iterator:
    """Rows arrive in the order of their codes; each meets the ``window`` rows after it."""
    import numpy as np

    last_key, last_ids, last_x = None, None, None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            ids, x, known = part.column(3).to_numpy(), _matrix(part.column(4)), 0
            if keys[lo] == last_key:  # goes on from the batch before
                ids, x, known = np.concatenate([last_ids, ids]), np.concatenate([last_x, x]), len(last_ids)
            last_key, last_ids, last_x = keys[lo], ids[-window:], x[-window:]
            found = _neighbours_in_order(ids, x, known, k, window)
            if found is not None:
                yield found


def _neighbours_in_order(ids, x, known: int, k: int, window: int):
    """Lists from the pairs at most ``window`` apart; pairs of the first ``known`` rows were compared before."""
    import numpy as np

    n = len(ids)
    sims = np.full((n, 2 * window), -2.0, "f4")
    at = np.zeros((n, 2 * window), "i8")
    rows = np.arange(n)
    for o in range(1, min(window, n - 1) + 1):
        s = np.einsum("ij,ij->i", x[:-o], x[o:])
        if known > o:
            s[: known - o] = -2.0
        sims[:-o, o - 1], at[:-o, o - 1] = s, rows[o:]
        sims[o:, window + o - 1], at[o:, window + o - 1] = s, rows[:-o]
    best = np.argpartition(-sims, min(k, 2 * window) - 1, axis=1)[:, :k]
    found = np.take_along_axis(sims, best, 1).ravel()
    good = found > -1.5
    if not good.any():
        return None
    owners = np.repeat(ids, best.shape[1])[good]
    return _fold(owners, ids[np.take_along_axis(at, best, 1).ravel()[good]], found[good], np.ones(int(good.sum()), bool), k)


def _merge_lists(batches: Iterator, k: int) -> Iterator:
    """Lists of one id, arriving together, become one list of the k best."""
    import numpy as np

    carry = None
    for batch in batches:
        own = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
        parts = (own, *[batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3)])
        if carry is not None:
            parts = tuple(np.concatenate([a, b]) for a, b in zip(carry, parts))
        if not len(parts[0]):
            continue
        last = parts[0] == parts[0][-1]  # the last id may go on in the next batch
        carry = tuple(a[last] for a in parts)
        if not last.all():
            yield _fold(*(a[~last] for a in parts), k)
    if carry is not None and len(carry[0]):
        yield _fold(*carry, k)


def merge_lists(parts: DataFrame, k: int) -> DataFrame:
    return parts.repartition("id").sortWithinPartitions("id").mapInArrow(lambda it: _merge_lists(it, k), GRAPH)


def code_lists(halves: DataFrame, k: int, first: int, codes: int, seed: int = SEED) -> DataFrame:
    """Lists of the vectors next to each other in the order of each of the ``codes`` codes from number ``first`` on."""
    encoded = halves.mapInArrow(lambda it: _encode(it, first, codes, CODE_BITS, seed), "grp string, code_no int, code long, id long, half binary")
    order = ["grp", "code_no", "code", "id"]
    laid = encoded.repartitionByRange(*order).sortWithinPartitions(*order)
    return laid.mapInArrow(lambda it: _compare_sorted(it, k, WINDOW), GRAPH)


# --- rounds of descent ---------------------------------------------------------


def _compare_around(batches: Iterator, k: int, block: int) -> Iterator:
    """Around each centre, arriving together, guests are compared if one of them is new; what beats a guest's floor goes out.

    Columns: centre, part, turn, guest, fresh, floor, half.
    """
    import numpy as np
    import pyarrow as pa

    def cuts_of(table):
        centre, part = table.column(0).to_numpy(), table.column(1).to_numpy()
        return np.concatenate([[0], np.flatnonzero((np.diff(centre) != 0) | (np.diff(part) != 0)) + 1, [len(centre)]])

    def work(batch):
        guests, fresh, floors = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        cuts = cuts_of(batch)
        starts = np.concatenate([np.arange(lo, hi, block) for lo, hi in zip(cuts, cuts[1:])])
        ends = np.minimum(starts + block, cuts[np.searchsorted(cuts, starts, "right")])
        counts = ends - starts
        found = []
        for take, x in _by_size(batch.column(6)):
            at = np.full(len(guests), -1)
            at[take] = np.arange(len(take))
            mine = at[starts] >= 0  # the guests of a centre have one length
            for n in np.unique(counts[mine]):
                if n < 2:
                    continue
                rows = starts[mine & (counts == n)][:, None] + np.arange(n)  # all groups of one size at once
                v = x[at[rows]]
                s = v @ v.transpose(0, 2, 1)
                new = fresh[rows]
                better = (s > floors[rows][:, :, None]) & (new[:, :, None] | new[:, None, :]) & ~np.eye(n, dtype=bool)
                group, i, j = np.nonzero(better)
                found.append((guests[rows[group, i]], guests[rows[group, j]], s[group, i, j]))
        if not sum(len(own) for own, _, _ in found):
            return None
        own, ids, sims = (np.concatenate(x) for x in zip(*found))
        return _fold(own, ids, sims, np.ones(len(own), bool), k)

    waiting = None
    for batch in batches:
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        cuts = cuts_of(batch)
        last = int(cuts[-2]) if len(cuts) > 1 else 0
        done = work(batch.slice(0, last)) if last else None
        if done is not None:
            yield done
        waiting = batch.slice(last)
    done = work(waiting) if waiting is not None and waiting.num_rows else None
    if done is not None:
        yield done


def descend(halves: DataFrame, graph: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, fanout: int = FANOUT, codes_used: int = CODES, watch=None) -> DataFrame:
    """Neighbours of neighbours, round by round, until next to nothing is new; ``watch(round, graph)`` sees every graph."""
    vectors = halves.select(F.col("id").alias("_id"), "half")
    for turn in range(rounds):
        near = graph.select("id", F.explode(F.slice(F.arrays_zip("ids", "fresh"), 1, fanout)).alias("e")).select("id", F.col("e.ids").alias("other"), F.col("e.fresh").alias("fresh"))
        both = near.select(F.col("other").alias("centre"), F.col("id").alias("guest"), "fresh").unionByName(near.select(F.col("id").alias("centre"), F.col("other").alias("guest"), "fresh"))
        both = cut(both.groupBy("centre", "guest").agg(F.max("fresh").alias("fresh")))
        # centres with something new, and how many parts their guests take
        busy = both.groupBy(F.col("centre").alias("_c")).agg(F.max("fresh").alias("_any"), F.ceil(F.count(F.lit(1)) / GROUP_TASK).alias("_parts")).filter("_any")
        floors = graph.select(F.col("id").alias("_g"), F.when(F.size("sims") >= k, F.element_at("sims", -1)).otherwise(F.lit(-1.0)).cast("float").alias("floor"))
        carried = vectors.join(floors, F.col("_id") == F.col("_g"), "left").select("_id", "half", F.coalesce("floor", F.lit(-1.0).cast("float")).alias("floor"))
        seat = F.xxhash64("guest", F.lit(turn))
        invited = both.join(busy, F.col("centre") == F.col("_c")).select("centre", F.pmod(seat, F.col("_parts")).alias("part"), seat.alias("turn"), "guest", "fresh")
        guests = invited.join(carried, F.col("guest") == F.col("_id")).select("centre", "part", "turn", "guest", "fresh", "floor", "half")
        met = guests.repartition("centre", "part").sortWithinPartitions("centre", "part", "turn").mapInArrow(lambda it: _compare_around(it, k, GROUP_BLOCK), GRAPH)
        laid = code_lists(halves, FRESH_LISTS, codes_used + turn * FRESH_CODES, FRESH_CODES)
        known = graph.withColumn("fresh", F.transform("fresh", lambda x, i: x & (i >= fanout)))
        graph = cut(merge_lists(known.unionByName(met).unionByName(laid), k))
        if watch:
            watch(turn + 1, graph)
        gain, size = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.count(F.lit(1))).first()
        if (gain or 0) <= LEAST_GAIN * size * k:
            break
    return graph


def neighbour_graph(halves: DataFrame, k: int = NEIGHBOURS, codes: int = CODES, rounds: int = ROUNDS, watch=None) -> DataFrame:
    """``id, ids, sims, fresh``: the lists of every place, best first."""
    graph = cut(merge_lists(code_lists(halves, k, 0, codes), k))
    if watch:
        watch(0, graph)
    return descend(halves, graph, k, rounds, codes_used=codes, watch=watch)


def pairs_by_round(df: DataFrame, least: float, group: str = "provider", name: str = "qualified_name", vector: str = "vector", k: int = NEIGHBOURS) -> list[tuple[int, int]]:
    """(round, pairs of places at least ``least`` similar) after the first graph (round 0) and after every round of descent."""
    told: list[tuple[int, int]] = []

    def watch(turn: int, graph: DataFrame) -> None:
        near = graph.select("id", F.explode(F.arrays_zip("ids", "sims")).alias("e")).filter(F.col("e.sims") >= least)
        told.append((turn, near.select(F.least("id", "e.ids"), F.greatest("id", "e.ids")).distinct().count()))

    neighbour_graph(places(usable(df, group, name, vector))[0], k, watch=watch)
    return told


# --- results by name -----------------------------------------------------------


def similar_names(df: DataFrame, least: float, group: str = "provider", name: str = "qualified_name", vector: str = "vector", k: int = NEIGHBOURS) -> DataFrame:
    """``grp, name_a, name_b`` (name_a < name_b), cosine at least ``least``, one among the ``k`` most similar of the other.

    Similarities within 0.002 of ``least`` are computed again from the full vectors.
    """
    halves, fixed, copies = places(usable(df, group, name, vector))
    graph = neighbour_graph(halves, k)
    edges = graph.select("id", F.explode(F.arrays_zip("ids", "sims")).alias("e")).select("id", F.col("e.ids").alias("other"), F.col("e.sims").alias("sim")).filter(F.col("sim") >= least - 0.002)
    edges = cut(edges)
    sure = edges.filter(F.col("sim") > least + 0.002)
    unsure = edges.filter(F.col("sim") <= least + 0.002)
    full = fixed.select(F.col("id").alias("_id"), "vec")
    checked = unsure.join(full.select(F.col("_id").alias("_a"), F.col("vec").alias("va")), F.col("id") == F.col("_a")).join(
        full.select(F.col("_id").alias("_b"), F.col("vec").alias("vb")), F.col("other") == F.col("_b")
    )

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    exact = checked.filter(dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb")) >= least).select("id", "other", "sim")
    names = fixed.select(F.col("id").alias("_id"), "grp", "names")
    # a place offers its first k + 1 names; whoever has copies of its own counts those first
    own = names.select("_id", "grp", F.size("names").alias("n_copies"), "names")
    links = sure.unionByName(exact)
    ahead = W.partitionBy("id").orderBy(F.desc("sim"), "other").rowsBetween(W.unboundedPreceding, -1)
    told = links.join(own.select(F.col("_id").alias("_b"), F.col("names").alias("theirs")), F.col("other") == F.col("_b"))
    told = told.withColumn("before", F.coalesce(F.sum(F.size("theirs")).over(ahead), F.lit(0)))
    told = told.join(own.select(F.col("_id").alias("_a"), "grp", "names", "n_copies"), F.col("id") == F.col("_a"))
    room = F.lit(k) - (F.col("n_copies") - 1) - F.col("before")
    across = told.filter(room > 0).select("grp", F.explode("names").alias("x"), F.slice("theirs", F.lit(1), room.cast("int")).alias("ys")).select("grp", "x", F.explode("ys").alias("y"))
    others = F.slice(F.array_remove(F.col("names"), F.col("name")), 1, k)
    within = copies.join(names, F.col("id") == F.col("_id")).select("grp", F.col("name").alias("x"), F.explode(others).alias("y"))
    pairs = across.unionByName(within)
    return pairs.select("grp", F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b")).distinct()


# --- greedy search -------------------------------------------------------------


def greedy_search(halves: DataFrame, graph: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, beam: int = 32, entries: int = 24, rounds: int = 8) -> DataFrame:
    """``query, id, sim``: the k most similar places of each query ``(grp, query, half)``.

    Each query starts at the same ``entries`` places of its group (those with the
    lowest hash, a fixed number) and walks the symmetric graph: a round expands
    the best places that were not expanded before.
    """
    near = graph.select("id", F.explode("ids").alias("other"))
    links = cut(near.unionByName(near.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    first = W.partitionBy("grp").orderBy(F.xxhash64("id"), "id")
    doors = halves.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= entries).select(F.col("grp").alias("_grp"), F.col("id").alias("cand"))
    asked = cut(queries)
    vectors = halves.select(F.col("id").alias("_id"), "half")

    def scored(pairs: DataFrame) -> DataFrame:
        q = asked.select(F.col("query").alias("_q"), F.col("half").alias("qhalf"))
        full = pairs.join(vectors, F.col("cand") == F.col("_id")).join(q, F.col("query") == F.col("_q")).select("query", "cand", "half", "qhalf")
        return full.mapInArrow(_score, "query long, cand long, sim float")

    best = scored(asked.join(doors, F.col("grp") == F.col("_grp")).select("query", "cand")).withColumn("open", F.lit(True))
    order = W.partitionBy("query").orderBy(F.desc("sim"), "cand")
    for _ in range(rounds):
        best = cut(best.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= beam).drop("at"))
        opened = best.filter("open").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= 8)
        if opened.isEmpty():
            break
        found = opened.join(links, F.col("cand") == F.col("id")).select("query", F.col("other").alias("cand")).distinct()
        new = found.join(best.select(F.col("query").alias("_q"), F.col("cand").alias("_c")), (F.col("query") == F.col("_q")) & (F.col("cand") == F.col("_c")), "left_anti")
        spent = opened.select(F.col("query").alias("_q"), F.col("cand").alias("_c"), F.lit(True).alias("spent"))
        marked = best.join(spent, (F.col("query") == F.col("_q")) & (F.col("cand") == F.col("_c")), "left").select("query", "cand", "sim", (F.col("open") & F.col("spent").isNull()).alias("open"))
        best = marked.unionByName(scored(new).withColumn("open", F.lit(True)))
    return best.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).select("query", F.col("cand").alias("id"), "sim")


def _score(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        sims, b = np.full(batch.num_rows, -1.0, "f4"), batch.column(3)
        for take, x in _by_size(batch.column(2)):
            for other, y in _by_size(b.take(pa.array(take))):
                if y.shape[1] == x.shape[1]:  # vectors of different lengths are not alike
                    sims[take[other]] = np.einsum("ij,ij->i", x[other], y)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["query", "cand", "sim"])
