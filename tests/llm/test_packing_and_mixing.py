from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelattice.llm import mixing, packing, queries, tokens


def simulate(plan, counts):
    load, used = Counter(), Counter()
    for size, start, items, each, first in sorted(plan.rules):
        assert start == used[size]
        used[size] += items
        for i in range(items):
            load[first + i // each] += size
    assert used == Counter({s: n for s, n in counts.items() if n}) and len(load) == plan.containers
    assert all(v <= plan.capacity for v in load.values())
    return plan.containers


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def search(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for load in sorted(set(bins)):
            if load + items[i] <= capacity:
                at = bins.index(load)
                bins[at] += items[i]
                search(i + 1, bins)
                bins[at] -= items[i]
        bins.append(items[i])
        search(i + 1, bins)
        bins.pop()

    search(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(8, 40), st.data())
def test_plans_are_valid_and_the_reduction_keeps_the_optimum(capacity, data):
    items = data.draw(st.lists(st.integers(1, capacity), min_size=1, max_size=8))
    counts = Counter(items)
    best = optimum(items, capacity)
    assert best <= simulate(packing.make_plan(counts, capacity), counts) <= best + 1
    part = packing.Plan(capacity)
    rest = packing.reduce_dominated(dict(counts), part)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert part.containers + (optimum(left, capacity) if left else 0) == best


@settings(max_examples=150, deadline=None)
@given(st.integers(15, 30), st.data())
def test_reduction_with_small_items_keeps_the_optimum(capacity, data):
    items = data.draw(st.lists(st.integers(capacity // 3, capacity), min_size=1, max_size=5)) + data.draw(st.lists(st.integers(1, capacity // 5), min_size=2, max_size=5))
    part = packing.Plan(capacity)
    rest = packing.reduce_dominated(dict(Counter(items)), part)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert part.containers + (optimum(left, capacity) if left else 0) == optimum(items, capacity)


def test_sets_of_three_stop_the_reduction():
    """{10, 7} leaves 2 unused, but 10 with three 3s fills its container: nothing may be fixed."""
    part = packing.Plan(19)
    assert packing.reduce_dominated({10: 1, 7: 1, 3: 7}, part) == {10: 1, 7: 1, 3: 7} and part.rules == []


def test_wide_histogram_is_planned_quickly():
    import time

    counts = Counter(1 + (i * i * 31 + i * 17) % 32_767 for i in range(100_000))
    began = time.perf_counter()
    plan = packing.make_plan(counts, 32_768)
    assert time.perf_counter() - began < 10 and simulate(plan, counts) <= 1.02 * -(-sum(s * n for s, n in counts.items()) // 32_768)


def test_sizes_and_counts_have_no_bound_of_their_own():
    import pyarrow as pa

    rules = [(1 << 40, 0, 1 << 50, 1, 0), (5, 0, 1 << 50, 1 << 20, 1 << 50)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([1 << 40, 5]), pa.array([(1 << 50) - 1, 1 << 49])], names=["item", "piece", "size", "at"])
    (out,) = packing._assign(iter([batch]), rules)
    assert out.column(3).to_pylist() == [(1 << 50) - 1, (1 << 50) + (1 << 29)]


def test_large_histogram_is_packed_tightly():
    counts = Counter(1 + (i * i * 31 + i) % 400 for i in range(60_000))
    plan = packing.make_plan(counts, 512)
    assert simulate(plan, counts) <= 1.02 * -(-sum(s * n for s, n in counts.items()) // 512)


def test_packing_of_documents(spark):
    sizes = [(i, 1 + i * 7 % 50, "x") for i in range(200)] + [(1000, 64, "x"), (1001, 64 * 3, "x"), (1002, 64 * 2 + 5, "x"), (1003, 0, "x"), (1004, None, "x")] + [(2000 + i, 16, "x") for i in range(300)]
    df = spark.createDataFrame(sizes, "item long, n long, container string")
    packed = packing.pack_all(df, [64, 100], "item", "n").collect()
    for capacity in (64, 100):
        rows = [r for r in packed if r.capacity == capacity]
        load, per_item = Counter(), Counter()
        for r in rows:
            if r.container >= 0:
                load[r.container] += r.size
            per_item[r.item] += r.size
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        assert per_item == Counter({i: n or 0 for i, n, _ in sizes})
        pieces = Counter(r.item for r in rows)
        assert all(pieces[i] == max(1, -(-(n or 0) // capacity)) for i, n, _ in sizes)
        assert len(load) <= 1.05 * sum(n or 0 for _, n, _ in sizes) / capacity + 1
    assert packing.pack_all(df.limit(0), [64], "item", "n").count() == 0
    assert packing.pack_all(df, [], "item", "n").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 1 << 40))
def test_permutations_are_bijections(size, key):
    assert sorted(mixing.permute(range(size), size, key).tolist()) == list(range(size))


def test_shard_counts_meet_the_quotas_and_vary():
    rows = list(mixing.shard_counts([500, 300, 200], 10, 3))
    counts = [c for _, c, _ in rows]
    assert [n for n, _, _ in rows] == list(range(10))
    assert [sum(c) for c in zip(*counts)] == [500, 300, 200] and {sum(c) for c in counts} == {100}
    assert len({tuple(c) for c in counts}) > 3
    assert [s for _, _, s in rows] == [[sum(c[i] for c in counts[:n]) for i in range(3)] for n in range(10)]
    assert list(mixing.shard_counts([500, 300, 200], 10, 3, 4, 7)) == rows[4:7]


@pytest.mark.parametrize(("good", "bad", "drawn"), [(30, 50, 20), (3, 2, 4), (1, 999, 10), (400, 600, 500)])
def test_draws_follow_the_hypergeometric_law(good, bad, drawn):
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    seen = Counter(mixing.draw_without_return(rng, good, bad, drawn) for _ in range(4000))
    for k, n in seen.items():
        p = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
        assert abs(n / 4000 - p) < 5 * (p * (1 - p) / 4000) ** 0.5 + 1e-3


def test_huge_mixes_are_drawn_alike():
    """A hundred billion slots: one task's shards come from a few dozen draws, quotas hold in every half."""
    quotas = [60 * 10**9, 30 * 10**9, 10**10, 7]
    rows = list(mixing.shard_counts(quotas, 10**8, 5, 12_345_678, 12_345_698))
    assert len(rows) == 20 and {sum(c) for _, c, _ in rows} <= {1000, 1001}
    assert all(abs(c[0] - 600) < 100 for _, c, _ in rows)
    assert all(abs(s[0] / sum(s) - 0.6) < 1e-4 for _, _, s in rows)


def test_plan_respects_repeats_and_shares():
    plans = {p.source: p for p in mixing.plan_sources({"a": 10_000, "b": 1_000}, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("a", 0.1, 1)], 10)}
    assert plans["c"].quota == 0 and plans["b"].quota <= 200 and plans["a"].quota <= 1000
    assert abs(plans["b"].quota / (plans["a"].quota + plans["b"].quota) - 0.375) < 0.01 and plans["b"].quota >= 199


def corpus(spark):
    words = "the graph keeps every row that was read before ".split()
    data = [(i, " ".join(words * (1 + i % 40)), [" Guide", "guide", "adr", "issue", None, "other"][i % 6], "x") for i in range(240)]
    return spark.createDataFrame(data + [(900, None, "guide", "x"), (901, "", "adr", "x")], "doc_id long, text string, source string, doc string")


def test_mix_reaches_its_shares_without_overuse(spark, tables):
    targets = spark.createDataFrame([("guide", 0.5, 1), ("adr", 0.3, 3), ("ISSUE ", 0.2, 2), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats long")
    d = tables(documents=corpus(spark), mix_targets=targets)
    mixed = queries.p8_mix(spark, d).collect()
    report = {r.source: r for r in queries.p8_shares(spark, d).collect()}
    total = sum(r.piece_tokens for r in mixed)
    sized = {(r.doc_id): r.n_tokens for r in tokens.token_counts(corpus(spark), ["doc_id"]).collect()}
    for source, share in (("guide", 0.5), ("adr", 0.3), ("issue", 0.2)):
        assert abs(report[source].reached_share - share) < 0.03
        assert report[source].mixed_tokens == sum(r.piece_tokens for r in mixed if r.source == source)
    assert report["none"].mixed_tokens == 0 and total == sum(r.mixed_tokens for r in report.values())
    used = Counter()
    for r in mixed:
        for t in range(r.doc_start, r.doc_start + r.piece_tokens):
            used[r.doc_id, t] += 1
        assert r.doc_start + r.piece_tokens <= sized[r.doc_id]
    limit = {"guide": 1, "adr": 3, "issue": 2}
    source_of = {r.doc_id: r.source for r in mixed}
    assert all(n <= limit[source_of[doc]] for (doc, _), n in used.items())
    assert {r.source for r in mixed} == set(limit)
    assert sorted(map(tuple, queries.p8_mix(spark, d).collect())) == sorted(map(tuple, mixed))


def test_mix_of_nothing(spark, tables):
    targets = spark.createDataFrame([("guide", 0.5, 1), ("adr", None, 0)], "source string, target_share double, max_repeats long")
    d = tables(documents=corpus(spark).limit(0), mix_targets=targets)
    assert queries.p8_mix(spark, d).count() == 0 and [r.reached_share for r in queries.p8_shares(spark, d).collect()] == [0, 0]
    d = tables(documents=corpus(spark), mix_targets=targets.limit(0))
    assert queries.p8_mix(spark, d).count() == 0


def test_tokens_are_counted_whole(spark):
    text = "größe 日本 code_x\n" * 3
    pytest.importorskip("tiktoken")
    n = len(tokens.encoding(tokens.VOCABULARY).encode_ordinary(text))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, tokens.token_counts(df, ["doc_id"]).collect())) == [(1, n), (2, 0), (3, 0)]
