import json

from codelattice.operators import presentation
from codelattice.plans import receivers
from conftest import rows
from pyspark.sql import functions as F

NODE = "id long, kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string, parent_name string, params string, return_type string, is_test boolean, extra string"
EDGE = "id long, kind string, source_qualified string, target_qualified string, target_name string, file_path string, line long, extra string, confidence double, confidence_tier string"


def nodes_of(spark, *specs):
    out = []
    for i, (qualified, kind, *more) in enumerate(specs):
        path, _, inner = qualified.partition("::")
        parent, _, name = inner.rpartition(".")
        extra = dict(more[0]) if more else {}
        returns = extra.pop("returns", None)
        out.append((i, kind, name or inner or path, qualified, path, 1, 2, None, parent or None, "()", returns, False, json.dumps(extra)))
    return spark.createDataFrame(out, NODE)


def edges_of(spark, *specs):
    out = []
    for i, (kind, source, target, *more) in enumerate(specs):
        out.append((i, kind, source, target, target, source.partition("::")[0], i, json.dumps(more[0] if more else {}), 1.0, "EXTRACTED"))
    return spark.createDataFrame(out, EDGE)


def told(df):
    return {r.id: (r.target_qualified, r.confidence_tier) for r in df.collect()}


def test_receivers_of_known_type(spark):
    nodes = nodes_of(spark, ("a.py", "File"), ("b.py", "File"), ("a.py::f", "Function"), ("b.py::Box.put", "Function"), ("c.py::Box.put", "Function"), ("c.py::Lid.shut", "Function"), ("d.rs::Lid.shut", "Function"), ("e.py::Two.x", "Function"), ("f.py::Two.x", "Function"))
    typed = lambda t: {"receiver_type": t}
    edges = edges_of(spark, ("IMPORTS_FROM", "a.py", "b.py"), ("CALLS", "a.py::f", "put", typed("Box")), ("CALLS", "a.py::f", "<unresolved:shut>", typed("Lid")), ("CALLS", "a.py::f", "x", typed("Two")), ("CALLS", "a.py::f", "put", {"receiver_type": "Box", "external": True}), ("CALLS", "a.py::f", "put"))
    got = told(receivers.typed_receivers(nodes, edges))
    assert got[1] == ("b.py::Box.put", "HIGH") and got[2] == ("c.py::Lid.shut", "MEDIUM") and got[3][0] == "x" and got[4][0] == "put" and got[5][0] == "put" and len(got) == 6


def test_own_members_are_found_up_the_classes(spark):
    nodes = nodes_of(spark, ("a.py::A", "Class"), ("a.py::A.run", "Function"), ("a.py::A.own", "Function"), ("b.py::B", "Class"), ("b.py::B.deep", "Function"), ("b.py::B.own", "Function"), ("c.py::C", "Class"), ("c.py::C.far", "Function"), ("d.py::D.deep", "Function"))
    own, above = {"receiver": "self"}, {"receiver": "super"}
    edges = edges_of(spark, ("INHERITS", "a.py::A", "b.py::B"), ("INHERITS", "b.py::B", "c.py::C"), ("INHERITS", "c.py::C", "a.py::A"), ("CALLS", "a.py::A.run", "own", own), ("CALLS", "a.py::A.run", "deep", own), ("CALLS", "a.py::A.run", "far", own), ("CALLS", "a.py::A.run", "none", own), ("CALLS", "a.py::A.run", "own", above), ("CALLS", "a.py::A.run", "own"))
    got = told(receivers.own_receivers(nodes, edges))
    assert [got[i][0] for i in range(3, 9)] == ["a.py::A.own", "b.py::B.deep", "c.py::C.far", "none", "b.py::B.own", "own"]


def test_receivers_that_calls_return_chain(spark):
    nodes = nodes_of(spark, ("a.py::f", "Function"), ("a.py::make", "Function", {"returns": "Optional[Box]"}), ("a.py::Box.lid", "Function", {"returns": "Lid"}), ("a.py::Lid.shut", "Function"))
    edges = edges_of(spark, ("CALLS", "a.py::f", "a.py::make"), ("CALLS", "a.py::f", "lid", {"receiver_call": "make"}), ("CALLS", "a.py::f", "shut", {"receiver_call": "lid"}), ("CALLS", "a.py::f", "shut", {"receiver_call": "other"}))
    got = told(receivers.returned_receivers(nodes, edges))
    assert got[1][0] == "a.py::Box.lid" and got[2][0] == "a.py::Lid.shut" and got[3][0] == "shut"
    assert told(receivers.returned_receivers(nodes, edges, 1))[2][0] == "shut"


def test_packages_variants_and_what_is_external(spark):
    nodes = nodes_of(spark, ("x/pkg/a.go::Open", "Function"), ("x/pkg/a_test.go::Open", "Function"), ("k.rs::Kind", "Type", {"variants": ["One", "Two"]}), ("k.rs::Wrap", "Class", {"deref_target": "String"}), ("m.py::mine", "Function"))
    edges = edges_of(
        spark, ("IMPORTS_FROM", "m.go", "x/pkg"), ("CALLS", "m.go::f", "pkg.Open"), ("CALLS", "k.rs::f", "Kind::Two"), ("CALLS", "k.rs::f", "Kind::Six"), ("CALLS", "k.rs::f", "trim", {"receiver_type": "Wrap"}), ("CALLS", "k.rs::f", "expect", {"receiver_type": "Store"}), ("CALLS", "k.rs::f", "odd", {"receiver_type": "Store"}),
        ("IMPORTS_FROM", "m.py", "lib", {"external": True, "import_glob": True, "external_package": "lib"}), ("CALLS", "o.py::f", "lib", {"external": True, "external_package": "lib", "external_symbol": "lib::shine"}), ("CALLS", "m.py::f", "shine"), ("CALLS", "m.py::f", "mine"),
        ("CALLS", "o.py::f", "q::glow", {"external": True, "external_package": "q"}), ("CALLS", "p.py::f", "q::glow", {"external": True, "external_package": "q"}), ("CALLS", "p.py::f", "glow"),
    )
    assert told(receivers.package_members(nodes, edges))[1][0] == "x/pkg/a.go::Open"
    got = told(receivers.variant_calls(nodes, edges))
    assert got[2][0] == "k.rs::Kind" and got[3][0] == "Kind::Six"
    deref = {r.id: r for r in receivers.deref_calls(nodes, edges).withColumn("symbol", F.get_json_object("extra", "$.external_symbol")).collect()}
    assert deref[4].symbol == "String::trim" and deref[5].symbol == "Store::expect" and deref[5].target_qualified == "std" and deref[6].target_qualified == "odd"
    got = told(receivers.glob_calls(nodes, edges))
    assert got[9][0] == "lib" and got[10][0] == "mine"
    got = told(receivers.observed_calls(nodes, edges))
    assert got[13] == ("q", "MEDIUM") and got[9][0] == "shine" and len(got) == 14


def test_rows_for_readers(spark):
    nodes = nodes_of(spark, ("a.py::K", "Class"), ("a.py::K.__init__", "Function"), ("a.py::K.plain", "Function"), ("a.py::__getattr__", "Function"), ("a.go::__dir__", "Function"))
    assert rows(presentation.implicit_callers(nodes)) == [("a.py::K.__init__", "a.py::K"), ("a.py::__getattr__", "a.py")]
    sources = spark.createDataFrame([("a.py", "one\r\ntwo\nthree"), ("b.py", None), ("c.py", "")], "file_path string, content string")
    assert rows(presentation.line_counts(sources)) == [("a.py", 3), ("c.py", 1)]
    cut_short = presentation.excerpts(nodes.filter("name = 'K'"), sources, 5).collect()
    assert [(r.excerpt, r.n_lines, r.truncated) for r in cut_short] == [("one\nt", 2, True)]
    docs = spark.createDataFrame([(1, "# A\nx\n## B\ny\n# C\nz"), (2, None)], "id long, t string")
    assert rows(presentation.sections(docs, "id", "t")) == [(1, 1, 1, "a", 4), (1, 3, 2, "b", 2), (1, 5, 1, "c", 2)]
    assert presentation.docs_section(docs, "id", "t", "a").first().section == "# A\nx\n## B\ny" and presentation.docs_section(docs, "id", "t", "a", 3).first().section == "# A"
    files = spark.createDataFrame([("a.py", "python"), ("b.go", "go"), ("c.md", "markdown")], "file_path string, language string")
    stored = spark.createDataFrame([("python", "1"), ("go", "3")], "language string, version string")
    assert rows(presentation.reparse_scope(files, stored, {"python": "2", "go": "3", "markdown": "1"})) == [("a.py", "python"), ("c.md", "markdown")]
    values = spark.createDataFrame([(v,) for v in (None, "null", "0", "[]", "{}", "1", "[0]", "text", "false")], "v string")
    assert [r.t for r in values.select(presentation.truthy(F.col("v")).alias("t")).collect()] == [False] * 5 + [True] * 3 + [False]
