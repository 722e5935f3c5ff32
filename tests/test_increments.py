import random

import pytest

from codelattice import core_queries
from codelattice.operators import increments as inc
from conftest import rows

def numbers(intervals):
    return {n for lo, hi in intervals for n in range(lo, hi + 1)}


def draw(rng, n):
    return [(a, a + rng.randint(0, 12)) for a in (rng.randint(0, 200) for _ in range(n))]


@pytest.mark.parametrize("seed", range(4))
def test_interval_sets_match_sets_of_numbers(spark, seed):
    rng = random.Random(seed)
    a, b = draw(rng, 25), draw(rng, 15 * (seed % 3))
    frame = lambda x: spark.createDataFrame(x, "lo long, hi long")
    merged, gaps = rows(inc.join_neighbours(frame(a))), rows(inc.gaps_between(frame(a), frame(b)))
    assert numbers(merged) == numbers(a) and numbers(gaps) == numbers(a) - numbers(b)
    for found in (merged, gaps):
        found = sorted(found)
        assert all(lo <= hi for lo, hi in found) and all(x[1] + 1 < y[0] for x, y in zip(found, found[1:]))


@pytest.mark.parametrize(("few", "arrays"), [(64, 1000), (0, 1000), (0, 0)])
def test_membership_by_filters_arrays_and_ranges(spark, monkeypatch, few, arrays):
    monkeypatch.setattr(inc, "FILTER_INTERVALS", few)
    monkeypatch.setattr(inc, "ARRAY_INTERVALS", arrays)
    monkeypatch.setattr(inc, "RANGE_INTERVALS", 3)
    spans = [(3, 4), (9, 22), (29, 40), (50, 50), (10**12, 2 * 10**12), (-5, -3), (60, 61), (70, 71)]
    wanted = [3, 9, 22, 40, 50, 10**12, 10**12 + 7, -4, 60, 71]
    others = [0, 5, 8, 23, 28, 41, 49, 51, -6, -2, 3 * 10**12, None]
    df = spark.createDataFrame([(n, "x") for n in wanted * 3 + others], "seq long, lo string")
    held = spark.createDataFrame(spans, "lo long, hi long")
    assert sorted(r.seq for r in inc.rows_within(df, "seq", held).collect()) == sorted(wanted * 3)
    assert inc.mark_within(df, "seq", held, "hit").count() == len(wanted) * 3 + len(others)
    assert inc.rows_within(df, "seq", held.limit(0)).count() == 0


def test_islands_join_across_blocks_and_ignore_nulls_and_repeats(spark):
    df = spark.createDataFrame([(n,) for n in [1, 2, 3, 3, 5, 9, 10, 11, 12, 20]] + [(None,)], "seq long")
    assert rows(inc.islands(df, "seq", width=4)) == [(1, 3), (20, 20), (5, 5), (9, 12)]
    assert rows(inc.islands(df.limit(0), "seq")) == []


def test_gaps_and_membership_as_frames(spark):
    available = spark.createDataFrame([(1, 10), (20, 30)], "lo long, hi long")
    done = spark.createDataFrame([(3, 4), (9, 22), (29, 40)], "lo long, hi long")
    gaps = inc.gaps_between(available, done)
    assert rows(gaps) == [(1, 2), (23, 28), (5, 8)]
    df = spark.createDataFrame([(n, "x") for n in range(0, 35)] + [(None, "y")], "seq long, lo string")
    assert sorted(r.seq for r in inc.rows_within(df, "seq", gaps).collect()) == [1, 2, 5, 6, 7, 8, 23, 24, 25, 26, 27, 28]
    assert rows(inc.gaps_between(available.limit(0), done)) == []


def test_ledger_processes_each_number_once_despite_failures_and_late_commits(spark, tmp_path):
    root = str(tmp_path / "job")
    ledger = inc.IntervalLedger(spark, root)
    source = lambda ns: spark.createDataFrame([(n, f"r{n}") for n in ns] + [(None, "none")], "seq long, row string")
    assert ledger.output() is None
    assert ledger.run(source([1, 2, 3, 7]), "seq", lambda df: df) == 1

    def die():
        raise RuntimeError("executor lost before the commit")

    with pytest.raises(RuntimeError):
        ledger.run(source([1, 2, 3, 7, 8]), "seq", lambda df: df, before_commit=die)
    assert [r.row for r in ledger.output().orderBy("seq").collect()] == ["r1", "r2", "r3", "r7"]
    # 5 is committed late, 8 was lost before: both are gaps now
    assert ledger.run(source([1, 2, 3, 5, 7, 8]), "seq", lambda df: df) == 2
    assert sorted(r.row for r in ledger.output().collect()) == ["r1", "r2", "r3", "r5", "r7", "r8"]
    assert rows(ledger.processed()) == [(1, 3), (5, 5), (7, 8)]
    assert ledger.run(source([1, 2, 3, 5, 7, 8]), "seq", lambda df: df) == 2
    # a racing run that read the same state cannot commit over it
    with pytest.raises(Exception):  # noqa: B017
        ledger._commit(2, "none", [])
    assert len(ledger.output().collect()) == 6


def test_many_gaps_and_adopted_intervals(spark, tmp_path):
    ledger = inc.IntervalLedger(spark, str(tmp_path / "many"))
    df = spark.createDataFrame([(n,) for n in range(0, 400, 2)], "seq long")
    pending, gaps = ledger.pending(df, "seq")
    assert gaps.count() == 200 and pending.count() == 200
    assert ledger.adopt(spark.createDataFrame([(0, 99), (200, 399)], "lo long, hi long")) == 1 and ledger.output() is None
    assert ledger.run(df, "seq", lambda x: x) == 2
    assert sorted(r.seq for r in ledger.output().collect()) == list(range(100, 200, 2))


def file_tables(spark, tables, nodes, meta, tasks):
    return tables(
        nodes=spark.createDataFrame(nodes, "kind string, file_path string, file_hash string, updated_at double, reason string"),
        file_meta=spark.createDataFrame(meta, "task_id long, file_path string, file_hash string, recorded_at timestamp, change string"),
        tasks=spark.createDataFrame(tasks, "id long, state string, lo long"),
    )


def test_files_new_or_changed_since_finished_runs(spark, tables):
    from datetime import datetime as dt

    nodes = [("File", "a", "1", 1.0, "x"), ("File", "a", "2", 5.0, "x"), ("File", "a", "2", 5.0, "x"), ("File", "b", None, 1.0, None), ("File", "c", "3", 1.0, None), ("File", "late", "9", 2.0, None), ("File", "u", "1", None, None), ("Function", "f", "1", 1.0, None)]
    meta = [(1, "a", "2", dt(2025, 1, 1), ""), (2, "a", "0", dt(2025, 2, 1), ""), (1, "b", None, dt(2025, 1, 1), ""), (1, "c", "4", dt(2025, 1, 1), ""), (3, "c", "3", dt(2025, 1, 2), ""), (None, "late", "9", dt(2025, 1, 1), ""), (77, "late", "9", dt(2025, 1, 1), ""), (1, "gone", "1", dt(2025, 1, 1), ""), (1, "u", "1", None, "")]
    d = file_tables(spark, tables, nodes, meta, [(1, "done", 0), (2, "dead", 0), (3, "done", 0), (4, "running", 0)])
    assert rows(core_queries.p3_found(spark, d)) == [("late",)]
    assert rows(core_queries.p3_changes(spark, d)) == [("late", "new")]


def test_no_runs_and_no_files(spark, tables):
    d = file_tables(spark, tables, [("File", "a", "1", 1.0, "")], [], [])
    assert rows(core_queries.p3_found(spark, d)) == [("a",)]
    assert rows(core_queries.p3_run_intervals(spark, d)) == []
    d = file_tables(spark, tables, [], [], [(1, "done", 0)])
    assert rows(core_queries.p3_found(spark, d)) == []
