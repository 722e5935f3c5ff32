import random

from codelattice import core_queries
from codelattice.operators import hierarchy
from conftest import rows


def brute(links):
    out = {}
    for node in links:
        path, at = [node], links[node]
        while at is not None and at in links and at not in path:
            path.append(at)
            at = links[at]
        if at is None or at not in links:
            out[node] = (len(path) - 1, path[-1], path[::-1], False)
        else:
            loop, x = [at], links[at]
            while x != at:
                loop.append(x)
                x = links[x]
            out[node] = (None, min(loop), None, True)
    return out


def resolved(spark, links, doublings=2):
    df = spark.createDataFrame([(k, v, "x") for k, v in links.items()], "id long, parent_id long, node string")
    return {r.node: (r.depth, r.root_id, r.path, r.in_loop) for r in hierarchy.resolve_hierarchy(df.drop("node"), doublings=doublings).collect()}


def test_chain_branches_loops_and_missing_parents(spark):
    links = {1: None, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 9: 8, 10: 9, 11: 10, 20: 999, 21: 20, 30: 30, 31: 30, 40: 41, 41: 42, 42: 40, 43: 42, 44: 43}
    assert resolved(spark, links) == brute(links)


def test_random_forests_match_brute_force(spark):
    rng = random.Random(5)
    for n in (1, 40):
        links = {i: rng.choice([None, 10_000, *range(n), *range(n), *range(max(0, i - 2), i + 1)]) for i in range(n)}
        assert resolved(spark, links) == brute(links)


def test_long_loops_are_named_by_their_smallest_id(spark):
    links = {i: i + 1 for i in range(100, 139)} | {139: 100} | {500 + i: 500 + i - 1 for i in range(1, 20)} | {500: 120}
    assert resolved(spark, links) == brute(links)


def test_ancestor_pairs(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (9, 9)], "id long, parent_id long")
    assert rows(hierarchy.ancestor_pairs(hierarchy.resolve_hierarchy(df))) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)]


def test_latest_row_counts_and_levels_are_checked(spark, tables):
    from datetime import datetime as dt

    old, new = dt(2025, 1, 1), dt(2025, 6, 1)
    data = [(1, None, 0, new, "p"), (2, 1, 7, old, "p"), (2, 1, 1, new, "p"), (2, 1, 1, new, "p"), (3, 2, 1, new, "p"), (4, 5, 0, new, "p"), (5, 4, 0, new, "p"), (6, 5, 3, None, "p"), (7, 77, None, new, "p"), (None, 1, 1, new, "p")]
    frame = spark.createDataFrame(data, "id long, parent_id long, level long, created_at timestamp, path string")
    d = tables(communities=frame)
    assert rows(core_queries.p5_found(spark, d)) == [(3, 1), (4, 4), (5, 4), (6, 4), (7, 7)]
    assert rows(core_queries.p5_descendants(spark, d)) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    d = tables(communities=frame.limit(0))
    assert rows(core_queries.p5_found(spark, d)) == [] and rows(core_queries.p5_hierarchy(spark, d)) == []
