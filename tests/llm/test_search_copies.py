import numpy as np

from codelattice.llm import queries


def test_search_asks_every_copy(spark, tables):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16)).astype("f4")
    x[100] = x[20]
    x[200:] = x[7]
    d = tables(embeddings=spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int"))
    hits = {}
    for r in queries.p2_search(spark, d).collect():
        hits.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
    assert set(hits) == set(range(0, 300, 20)) and all(len(v) == len(set(v)) == 10 for v in hits.values())
    assert max(hits[20], key=lambda h: h[1])[0] == 100 and max(hits[100], key=lambda h: h[1])[0] == 20
    crowd = {7, *range(200, 300)}
    assert all({i for i, _ in hits[q]} <= crowd - {q} for q in range(200, 300, 20))
