from codelattice import core_queries
from codelattice.operators import references
from conftest import rows
from pyspark.sql import functions as F


def test_orphans_match_an_anti_join(spark):
    parents = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("ref_key"))
    parents = parents.unionByName(parents.limit(200))
    refs = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 4000).cast("string"))).alias("ref_key"), F.lit("t").alias("table_name"), F.lit("c").alias("column_name"), F.when(F.col("id") % 2 == 0, "2025-01").alias("period"))
    got = rows(references.orphan_references(refs, parents, keys_per_range=40))
    want = refs.groupBy("table_name", "column_name", "period", "ref_key").agg(F.count(F.lit(1)).alias("n")).join(parents.distinct(), "ref_key", "left_anti").select("table_name", "column_name", "period", "ref_key", "n")
    assert got == rows(want) and len(got) > 100


def test_equal_hashes_are_told_apart_by_text():
    import pyarrow as pa

    names = ["table_name", "column_name", "period", "ref_key", "n_refs", "key_hash", "range_id", "is_ref"]

    def batch(keys, tag):
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(["t"] * n), pa.array(["c"] * n), pa.array([None] * n, pa.string()), pa.array(keys), pa.array([1] * n), pa.array([5] * n), pa.array([0] * n, pa.int32()), pa.array([tag] * n, pa.int32())], names=names)

    out = list(references._probe(iter([batch(["a", "b"], 0), batch(["c"], 0), batch(["b", "x", "c", "a"], 1)]), references.LABELS))
    assert [k for b in out for k in b.column(3).to_pylist()] == ["x"]


def test_references_without_a_node_by_table_and_month(spark, tables):
    from datetime import datetime as dt

    jan, feb = 1735787045.0, 1738465445.0
    edges = [
        ("a.py::f", " ./a.py::g ", None, jan, "n"), ("a.py::f", "b\\c.py", "{}", feb, "n"), ("a.py::f", "b\\c.py", "{}", feb, "n"), ("gone.py", "len", '{"external": false}', jan, "n"), ("gone2.py::x", "lost.py", '{"external": true}', jan, "n"),
        ("a.py::f", "<unresolved:a/b>", None, jan, "n"), ("a.py::f", "", None, jan, "n"), (None, None, None, None, None), ("a.py::f", "no/time", "not json", None, "n"), ("././x/y", "a.py::f", "", jan, "n"),
    ]
    frame = spark.createDataFrame(edges, "source_qualified string, target_qualified string, extra string, updated_at double, period string")
    nodes = spark.createDataFrame([("a.py::f", 1, 5), ("a.py::g", 2, 5), (None, None, 5)], "qualified_name string, id long, ref_key int")
    flows = spark.createDataFrame([(1, dt(2025, 3, 31, 23, 59)), (1, dt(2025, 3, 31, 23, 59)), (2, None)], "id long, updated_at timestamp")
    members = spark.createDataFrame([(1, 1), (1, 9), (1, 9), (2, 8), (3, 7), (1, None)], "flow_id long, node_id long")
    d = tables(edges=frame, nodes=nodes, flows=flows, flow_memberships=members)
    assert rows(core_queries.p6_found(spark, d)) == sorted([
        ("edges", "source_qualified", "2025-01", "./x/y"), ("edges", "target_qualified", "2025-02", "b/c.py"),
        ("edges", "target_qualified", None, "no/time"), ("flow_memberships", "node_id", "2025-03", "9"), ("flow_memberships", "node_id", None, "8"), ("flow_memberships", "node_id", None, "7"),
    ], key=repr)
    report = {(r.table_name, r.column_name, r.period): (r.n_refs, r.n_orphan_refs, r.n_orphan_keys) for r in core_queries.p6_report(spark, d).collect()}
    assert report["edges", "target_qualified", "2025-02"] == (2, 2, 1) and report["flow_memberships", "node_id", "2025-03"] == (3, 2, 1)
    d = tables(edges=frame.limit(0), nodes=nodes.limit(0), flows=flows.limit(0), flow_memberships=members.limit(0))
    assert rows(core_queries.p6_found(spark, d)) == [] and rows(core_queries.p6_report(spark, d)) == []
