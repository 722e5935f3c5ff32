from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codelattice import core_queries
from codelattice.operators import skew
from codelattice.session import salted_prefix_sum, salted_rank
from conftest import rows
from pyspark.sql import functions as F

records = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(records)
def test_counts_modes_and_percentiles_match_brute_force(spark, data):
    df = spark.createDataFrame([(k, v, "x") for k, v in data], "k string, v int, _weight string")
    by = defaultdict(list)
    for k, v in data:
        by[k].append(v)
    assert rows(skew.distinct_counts(df, ["k"], ["v"])) == sorted(((k, len(v), len(set(v))) for k, v in by.items()), key=repr)
    best = {}
    for k, v in by.items():
        c = Counter(x for x in v if x is not None)
        best[k] = min(((-n, x) for x, n in c.items()), default=(None, None))[1]
    assert {r.k: r.mode for r in skew.modes(df, ["k"], "v").collect()} == best
    want = {}
    for k, v in by.items():
        s = sorted(x for x in v if x is not None)
        if s:
            want[k] = (s[-(-len(s) // 2) - 1], s[-(-len(s) * 9 // 10) - 1])
    assert {r.k: (r.p50, r.p90) for r in skew.percentiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}, partitions=3).collect()} == want


def test_heavy_keys_count_each_tuple_once(spark):
    data = [("hot", "CALLS", i % 60) for i in range(200)] + [("hot", "CALLS", None)] * 3 + [(f"t{i}", "CALLS", i) for i in range(150)] + [(None, None, 1), (None, None, 2), (None, None, 3)]
    df = spark.createDataFrame(data, "target string, kind string, line int")
    assert rows(skew.heavy_keys(df, ["target", "kind"], ["line"], 1).select("target", "kind", "n_rows", "n_distinct")) == [("hot", "CALLS", 203, 61), (None, None, 3, 3)]
    assert rows(skew.heavy_keys(df.limit(0), ["target", "kind"], ["line"], 1)) == []


def test_key_profile_over_tables(spark, tables):
    edges = spark.createDataFrame([("a", "CALLS", "s1", "f1", 3, "z"), ("a", "CALLS", "s1", "f1", 3, "z"), ("a", "CALLS", "s2", "f2", None, "z"), ("a", "CALLS", None, None, 9, "z"), (None, None, None, None, None, None)], "target_qualified string, kind string, source_qualified string, file_path string, line long, mode string")
    d = tables(edges=edges)
    assert rows(core_queries.p4_key_profile(spark, d)) == [("a", "CALLS", 4, 3, 3, "f1", 3), (None, None, 1, 1, 1, None, None)]
    assert rows(core_queries.p4_found(spark, d)) == [("a", "CALLS"), (None, None)]
    d = tables(edges=edges.limit(0))
    assert rows(core_queries.p4_key_profile(spark, d)) == [] and rows(core_queries.p4_found(spark, d)) == []


def test_salted_ranks_and_sums_are_dense_for_a_hot_group(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g"), (F.col("id") % 5).alias("n"))
    ranked = salted_rank(df, ["g"], ["id"], "r", rows_per_bucket=50).collect()
    for g, n in (("hot", 700), ("cold", 300)):
        assert sorted(r.r for r in ranked if r.g == g) == list(range(n))
    summed = sorted((r.before, r.n) for r in salted_prefix_sum(df, ["g"], ["id"], F.col("n"), "before", 50).filter("g = 'hot'").collect())
    total = 0
    for before, n in summed:
        assert before <= total
        total = before + n
    assert total == sum(i % 5 for i in range(1000) if i % 10 < 7)
