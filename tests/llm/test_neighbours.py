import numpy as np

from codelattice.llm import neighbours, queries
from conftest import rows


def planted(rng, n, dim=32, clusters=40):
    centres = rng.standard_normal((clusters, dim))
    noise = rng.standard_normal((n, dim))
    x = np.where((np.arange(n) % 3 == 0)[:, None], noise, centres[np.arange(n) % clusters] + 0.35 * noise)
    return (x * rng.uniform(0.5, 3, (n, 1))).astype("f4")


def exact_pairs(names, x, least, k=10):
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f8")
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= least:
                out.add((min(names[i], names[j]), max(names[i], names[j])))
    return out


def frame(spark, rows_):
    return spark.createDataFrame(rows_, "provider string, qualified_name string, vector array<float>, id string")


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = planted(rng, 900)
    names = [f"n{i:04d}" for i in range(len(x))]
    found = {(r.name_a, r.name_b) for r in neighbours.similar_names(frame(spark, [("p", n, v.tolist(), "x") for n, v in zip(names, x)]), 0.8).collect()}
    want = exact_pairs(names, x, 0.8)
    assert len(want) > 500 and len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.01 * len(want)


def test_unusable_rows_copies_and_groups(spark):
    nan, inf = float("nan"), float("inf")
    a, b, c = [1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 0.0, 1.0]
    data = [("p", "a", a), ("p", "a", a), ("p", "b", b), ("p", "c", c), ("p", "null", None), ("p", "short", [1.0]), ("p", "nan", [nan, 1.0, 0.0]), ("p", "inf", [inf, 1.0, 0.0]), ("p", "zero", [0.0, 0.0, 0.0]), ("p", "hole", [None, 1.0, 0.0]), ("p", None, a), (None, "x", a), ("q", "a", b), ("q", "z", a)]
    df = frame(spark, [(*r, "x") for r in data])
    assert rows(neighbours.similar_names(df, 0.8)) == [("p", "a", "b"), ("q", "a", "z")]
    assert rows(neighbours.similar_names(df.limit(0), 0.8)) == []


def test_a_crowd_of_equal_vectors(spark):
    """More copies than a list holds: each has the first names beside it as its ten, nothing else."""
    data = [("p", f"c{i:03d}", [1.0, 0.0, 0.5], "x") for i in range(60)] + [("p", "near", [1.0, 0.05, 0.5], "x"), ("p", "far", [-1.0, 0.0, 0.0], "x")]
    found = rows(neighbours.similar_names(frame(spark, data), 0.8))
    names = [f"c{i:03d}" for i in range(60)]
    want = set()
    for i, n in enumerate(names):
        for m in [x for x in names if x != n][:10]:
            want.add(("p", min(n, m), max(n, m)))
    want |= {("p", n, "near") for n in names[:10]}
    assert set(found) == want


def test_search_recall(spark, tables):
    rng = np.random.default_rng(9)
    x = planted(rng, 800, clusters=25)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    d = tables(embeddings=df)
    hits = {}
    for r in queries.p2_search(spark, d).collect():
        hits.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    recall = np.mean([len(hits[q] & set(np.argsort(-s[q])[:10].tolist())) / 10 for q in range(0, 800, 20)])
    assert set(hits) == set(range(0, 800, 20)) and recall >= 0.9
