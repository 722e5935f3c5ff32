import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelattice.functions import paths, text
from codelattice.operators import adjacency, aggregates, communities, components, lookup, ranking, search, store, traversal
from codelattice.plans import architecture, changes, passes, refactoring
from conftest import rows
from pyspark.sql import functions as F

NODE = "id long, kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string, parent_name string, params string, return_type string, is_test boolean, file_hash string, mtime_ns long, extra string, signature string, community_id long, updated_at double"
EDGE = "id long, kind string, source_qualified string, target_qualified string, target_name string, file_path string, line long, extra string, confidence double, confidence_tier string, updated_at double"


def nodes_of(spark, names, **more):
    out = []
    for i, spec in enumerate(names):
        q, kind = spec if isinstance(spec, tuple) else (spec, "Function")
        path = q.split("::")[0]
        leaf = q.split("::")[-1]
        out.append((i, kind, leaf.split(".")[-1], q, path, 1 + 10 * i, 8 + 10 * i, "python", leaf.split(".")[0] if "." in leaf and "::" in q else None, "(a, b=1)", None, kind == "Test", "h", 1, json.dumps(more.get(q, {})), None, None, 1.0))
    return spark.createDataFrame(out, NODE)


def edges_of(spark, triples):
    out = []
    for i, (kind, s, t, *more) in enumerate(triples):
        tier, extra = (more + [None, None])[:2]
        out.append((i, kind, s, t, t.split("::")[-1], s.split("::")[0], i + 1, json.dumps(extra or {}), 1.0, tier, 1.0))
    return spark.createDataFrame(out, EDGE)


@pytest.fixture(scope="module")
def diamond(spark):
    names = ["s.py::f", "a.py::a", "b.py::b", "c.py::c", "d.py::d", "z.py::z"]
    links = [("CALLS", "s.py::f", "b.py::b"), ("CALLS", "a.py::a", "s.py::f"), ("CALLS", "a.py::a", "c.py::c"), ("CALLS", "b.py::b", "c.py::c"), ("CALLS", "c.py::c", "d.py::d"), ("CROSS_ARTIFACT", "s.py::f", "z.py::z", "LOW")]
    return nodes_of(spark, names), edges_of(spark, links)


def test_impact_of_a_file(diamond):
    nodes, edges = diamond
    impacted = traversal.impact_radius(nodes, edges, ["s.py"], 2)
    assert rows(impacted) == [("a.py::a", 1, True), ("b.py::b", 1, True), ("c.py::c", 2, True)]
    page, totals = traversal.impact_page(impacted, 2)
    assert [r.qualified_name for r in page.collect()] == ["a.py::a", "b.py::b"] and rows(totals) == [(3, True)]
    seeds = nodes.filter("file_path = 's.py'").select(F.col("qualified_name").alias("key"))
    assert rows(adjacency.low_confidence_bridges(edges, seeds)) == [("s.py::f", "z.py::z")]
    assert rows(traversal.impact_radius(nodes, edges, ["none.py"], 2)) == []


def test_walk_keeps_the_first_depth_and_stops(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), (None, "x")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "key string")
    assert rows(traversal.walk(seeds, links, 9)) == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "c")]
    stop = spark.createDataFrame([("c",)], "key string")
    assert rows(traversal.walk(seeds, links, 9, stop).select("key")) == [("a",), ("b",), ("c",)]
    assert rows(traversal.walk(seeds.limit(0), links, 3)) == []


def test_bridge_tiers(spark):
    triples = [("CROSS_ARTIFACT", "a", "b", "high"), ("CROSS_ARTIFACT", "a", "c", " ", {"confidence_tier": "LOW"}), ("CROSS_ARTIFACT", "a", "d", None), ("CROSS_ARTIFACT", "a", "<unresolved:x>", "EXACT"), ("CALLS", "a", "e", "EXACT"), ("CROSS_ARTIFACT", "a", "f", "HIGH", {"confidence_tier": "LOW"})]
    edges = edges_of(spark, triples)
    hard, caveat = traversal.bridge_partition(edges)
    assert sorted(r.target_qualified for r in hard.collect()) == ["b", "d", "f"] and sorted(r.target_qualified for r in caveat.collect()) == ["<unresolved:x>", "c"]
    assert {r.r.target_qualified: r.r.claim_strength for r in edges.filter("kind <> 'CALLS'").select(lookup.bridge_record().alias("r")).collect()}["c"] == "caveat"


def test_resolution_of_typed_names(spark):
    nodes = nodes_of(spark, [("a.py", "File"), "a.py::run", "b.py::run", "b.py::Box.put"])
    assert [r.qualified_name for r in lookup.resolve_target(nodes, "a.py::run").collect()] == ["a.py::run"]
    assert [r.qualified_name for r in lookup.resolve_target(nodes, "./a.py").collect()] == ["a.py"]
    assert [r.qualified_name for r in lookup.resolve_target(nodes, "run").collect()] == ["a.py::run", "b.py::run"]
    assert lookup.resolve_target(nodes, "missing").count() == 0


def test_identifier_words(spark):
    cases = {"HTTPServerTest": "http server test", "test_parse_URLValue": "test parse url value", "ABcDEf": "a bc d ef", "x2y": "x 2 y", "": "", "größeÄnderung": "gr e nderung"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string")
    got = {r.s: r.w for r in df.select("s", F.array_join(text.identifier_words(F.col("s")), " ").alias("w")).collect()}
    assert got == cases | {None: None}
    risky = spark.createDataFrame([("loginUser",), ("author_list",), ("signalToken",), ("sqlQuery",), ("plain",)], "s string")
    assert [r.r for r in risky.select(aggregates.is_security_name(F.col("s")).alias("r")).collect()] == [True, False, True, True, False]


def test_word_containment_paths_and_shapes(spark):
    df = spark.createDataFrame([("tests/test_app.py", "app"), ("tests/test_application.py", "app")], "h string, n string")
    assert [r.x for r in df.select(text.contains_word(F.col("h"), F.col("n")).alias("x")).collect()] == [True, False]
    p = spark.createDataFrame([("a/b/c.py",), ("c.tar.GZ",), ("Makefile",), ("tests/x.rs",), ("a/vendor/b.go",)], "p string")
    got = p.select(paths.package_of(F.col("p")), paths.suffix(F.col("p")), paths.is_test_path(F.col("p")), paths.is_production_path(F.col("p")), paths.language_of(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("a/b", "py", False, True, "python"), ("<root>", "gz", False, True, None), ("<root>", "", False, True, None), ("tests", "rs", True, False, "rust"), ("a/vendor", "go", False, False, "go")]
    s = spark.createDataFrame([("(self, a, b=2, *rest)",), (None,), ("()",), ("(&mut x: T, y)",)], "p string")
    assert [(r[0].total, r[0].required, list(r[1])) for r in s.select(text.parameter_shape(F.col("p")), text.parameter_list(F.col("p"))).collect()] == [(3, 1, ["a", "b", "*rest"]), (0, 0, []), (0, 0, []), (2, 2, ["x", "y"])]
    h = spark.createDataFrame([("## Über uns: Teil 2!",), ("####### no",), ("#",)], "l string")
    assert [(r[0], r[1]) for r in h.select(text.heading_level(F.col("l")), text.slugify(F.regexp_replace("l", "^#+", ""))).collect()] == [(2, "über-uns-teil-2"), (None, "no"), (1, "")]
    b = spark.createDataFrame([("abc_1 日本語と x",)], "t string")
    assert b.select(text.mixed_bigrams(F.col("t"))).first()[0] == ["abc_1", "x", "日本", "本語", "語と"]
    c = spark.createDataFrame([(["if a:", "  # note", "/* x", "y */", "z = 1 ? 2"],)], "l array<string>")
    assert tuple(c.select(text.branch_lines(F.col("l")), text.comment_lines(F.col("l"))).first()) == (2, 3)


def test_components_cuts_and_cycles(spark):
    df = lambda pairs: spark.createDataFrame(pairs, "src string, dst string")
    links = df([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("y", "a"), ("s", "s")])
    assert rows(components.strongly_connected(links)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert components.strongly_connected(df([("a", "b")])).count() == 0
    weighted = df([("a", "b")] * 3 + [("b", "a")])
    assert rows(components.component_cuts(weighted, components.strongly_connected(weighted))) == [("a", "b", "a", 1)]
    assert rows(components.short_cycles(df([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")]))) == [(2, "a > b"), (3, "a > b > c")]
    assert rows(components.two_cycles(weighted)) == [("a", "b", 3, 1)]
    assert sorted(components.circuits([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")], 200, 1000)[0]) == [["a", "b"], ["a", "b", "c"]]
    full = [(i, j) for i in "abcde" for j in "abcde" if i != j]
    everything, cut_short = components.circuits(full, 200, 500_000)
    assert len(everything) == 84 and not cut_short
    first, cut_short = components.circuits(full, 10, 500_000)
    assert first == everything[:10] and cut_short and components.circuits(full, 200, 20)[1]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")).filter(lambda x: x[0] != x[1]), max_size=16))
def test_circuits_against_all_permutations(arcs):
    from itertools import permutations

    nodes = sorted({x for a in arcs for x in a})
    want = set()
    for n in range(2, len(nodes) + 1):
        for p in permutations(nodes, n):
            if p[0] == min(p) and all((a, b) in arcs for a, b in zip(p, p[1:] + p[:1])):
                want.add(p)
    got, cut_short = components.circuits(list(arcs), 10_000, 1_000_000)
    assert set(map(tuple, got)) == want and len(got) == len(want) and not cut_short


def test_communities(spark):
    ring = [(f"{g}{i}", f"{g}{j}", 100) for g in "abcdef" for i in range(4) for j in range(i + 1, 4)] + [(f"{g}0", f"{h}1", 30) for g, h in zip("abcdef", "bcdefa")]
    ties = spark.createDataFrame(ring, "a string, b string, w int")
    found = communities.modularity_communities(ties)
    labels = {r.node: r.community for r in found.collect()}
    assert labels == {f"{g}{i}": f"{g}0" for g in "abcdef" for i in range(4)}
    assert abs(communities.modularity(ties, found) - (36 * 100 / 3780 - 6 * (1260 / 7560) ** 2)) < 1e-9
    assert communities.modularity_communities(ties.limit(0)).count() == 0
    # a changed node: only its community is looked at again
    more = ties.unionByName(spark.createDataFrame([("a0", "new", 100)], "a string, b string, w int"))
    again = {r.node: r.community for r in communities.region_communities(more, found, spark.createDataFrame([("new",), ("a0",)], "key string")).collect()}
    assert again["new"] == again["a0"] and {n: c for n, c in again.items() if n[0] not in "an"} == {n: c for n, c in labels.items() if n[0] != "a"}
    nodes = nodes_of(spark, [f"src/{g}/m{i}.py::f" for g in "abcdefghijk" for i in range(2)])
    assert components.directory_communities(nodes).select("community").distinct().count() == 11


def test_ranks(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, position int")
    b = spark.createDataFrame([(3, 0), (1, 1), (9, 2)], "id long, position int")
    fused = [r.id for r in ranking.rank_fusion([a, b]).orderBy(F.desc("fusion_score"), "first_seen").collect()]
    assert fused == [1, 3, 2, 9]
    v = spark.createDataFrame([(i,) for i in range(1, 41)] + [(40,)] * 3, "v int").withColumn("g", F.lit(1))
    assert rows(ranking.indexed_percentile(v, ["g"], "v", 95, "p")) == [(1, sorted([*range(1, 41), 40, 40, 40])[43 * 95 // 100])]
    out = ranking.trim_to_budget({"a": list(range(100)), "b": list(range(100))}, 100, ["a", "b"])
    assert out["a"]["kept"] >= out["b"]["kept"] and out["b"]["total"] == 100


def test_stored_index_is_synced_by_owner_and_reads_japanese(spark, tmp_path):
    from codelattice.operators import textindex

    docs = spark.createDataFrame([(1, "a.py", "the graph store"), (2, "b.py", "graph graph rows"), (3, "b.py", None), (4, "c.md", "索引は変更を読む graph"), (5, None, "引")], "id long, file string, t string")
    index = textindex.TextIndex(spark, str(tmp_path / "index"), "id", {"t": 1}, "file")
    assert index.health(docs).first().status == "stale" and index.postings(["graph"]).count() == 0
    assert index.build(docs) == 1
    assert index.health(docs).first().status == "fresh"
    ask = lambda q: [r.doc for r in search.fts_search(index, q, 5)[0].collect()]
    assert sorted(ask("graph")) == [1, 2, 4] and ask("索引") == [4] and ask("変更を") == [4] and ask("引") == [5] and ask("nothing") == []
    assert textindex.query_terms("Graph 索引は graph") == ["graph", "索引", "引は"]
    stored, framed = search.bm25(index, ["graph", "rows"], 9), search.bm25(search.FrameIndex(docs, "id", {"t": 1}), ["graph", "rows"], 9)
    assert rows(stored) == rows(framed)
    newer = spark.createDataFrame([(2, "b.py", "rows only")], "id long, file string, t string")
    assert index.sync(newer, spark.createDataFrame([("b.py",), ("a.py",)], "key string")) == 2
    assert ask("graph") == [4] and ask("rows") == [2] and index.health(docs).first().n_missing == 2
    two = textindex.term_rows(docs, "id", {"t": 1, "file": 2})[0]
    assert sorted((r.term, r.tf, r.dl) for r in two.filter("id = 1" if "id" in two.columns else "doc = 1").collect()) == [("a", 2, 7), ("graph", 1, 7), ("py", 2, 7), ("store", 1, 7), ("the", 1, 7)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "the graph store keeps rows"), (2, "graph graph graph"), (3, "nothing here"), (4, None), (5, "store of rows and more rows")], "doc long, t string")
    hits, mode = search.fts_search(search.FrameIndex(docs, "doc", {"t": 1}), "graph store", 5)
    assert mode == "and" and [r.doc for r in hits.collect()] == [1]
    hits, mode = search.fts_search(search.FrameIndex(docs, "doc", {"t": 1}), "graph nowhere", 5)
    assert mode == "or" and [r.doc for r in hits.collect()] == [2, 1]
    assert search.fts_search(search.FrameIndex(docs, "doc", {"t": 1}), "?!", 5)[1] == "none"
    assert search.plan_query("get the Parser state")[1] == "parser"
    assert [search.query_intent(q) for q in ("", "read_file", "usage of the cache", "reads the rows", "cache writer", "cache", "workflow")] == ["empty", "exact", "documentation", "process_pattern", "purpose", "exact", "purpose"]
    assert search.kind_boosts("Parser") == {"Class": 1.5, "Type": 1.5} and search.kind_boosts("a_b.c") == {"Function": 1.5, "_qualified": 2.0} and search.kind_boosts("HTTP") == {}
    named = spark.createDataFrame([("src/a.py::Box.put",), ("src/put/box.py::x",)], "qualified_name string")
    assert [r.m for r in named.select(search.qualified_name_matches("a.put").alias("m")).collect()] == [True, False]
    assert [r.m for r in named.select(search.qualified_name_matches("src.box.put").alias("m")).collect()] == [True, False]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [2.0, 0.1])], "id long, vector array<double>")
    assert [r.id for r in search.cosine_top_k(vectors, "id", [1.0, 0.0], 2).collect()] == [1, 6]
    nodes = nodes_of(spark, ["a.py::read_graph", ("t.py::test_read", "Test"), "b.py::graph"])
    hits = search.hybrid_search(nodes, spark.createDataFrame([(0, 0), (1, 1)], "id long, position int"), spark.createDataFrame([(2, 0), (1, 1)], "id long, position int"), "read_graph", 3)
    assert [(r.qualified_name, r.source) for r in hits.collect()][0] == ("a.py::read_graph", "text") and hits.count() == 3


def test_passes(spark):
    nodes = nodes_of(spark, [("a.py", "File"), ("b.py", "File"), ("c.py", "File"), "a.py::go", "a.py::own", "b.py::helper", "c.py::helper", "c.py::alone", ("b.py::Base", "Class"), ("t.py::test_go", "Test")])
    edges = edges_of(spark, [("IMPORTS_FROM", "a.py", "b.py"), ("CALLS", "a.py::go", "own"), ("CALLS", "a.py::go", "helper"), ("CALLS", "c.py::helper", "go"), ("CALLS", "a.py::go", "alone", None, {"external": True}), ("INHERITS", "a.py::go", "Base"), ("CALLS", "a.py::go", "nowhere"), ("CALLS", "t.py::test_go", "a.py::go"), ("TESTED_BY", "gone.py::x", "t.py::test_go"), ("CALLS", "a.py::go", "append")])
    bound = {r.id: (r.target_qualified, r.confidence_tier) for r in passes.bare_calls(nodes, edges).collect()}
    assert bound[1] == ("a.py::own", "HIGH") and bound[2] == ("b.py::helper", "HIGH") and bound[3] == ("a.py::go", "MEDIUM") and bound[4][0] == "alone" and bound[6][0] == "nowhere"
    assert {r.id: r.target_qualified for r in passes.bare_inheritance(nodes, edges).collect()}[5] == "b.py::Base"
    demoted = {r.id: (r.confidence, r.confidence_tier) for r in passes.demote_unresolved(nodes, edges).collect()}
    assert demoted[6] == (0.2, "LOW") and demoted[7] == (1.0, "EXTRACTED")
    assert rows(passes.tested_by_from_calls(nodes, edges).select("source_qualified", "target_qualified")) == [("a.py::go", "t.py::test_go")]
    assert passes.drop_orphan_tests(nodes, edges).filter("kind = 'TESTED_BY'").count() == 0
    assert passes.mark_stdlib_calls(nodes, edges).filter(F.get_json_object("extra", "$.stdlib") == "true").select("target_qualified").collect()[0][0] == "append"
    reexport = edges_of(spark, [("IMPORTS_FROM", "a.py", "b.py"), ("IMPORTS_FROM", "b.py", "c.py"), ("CALLS", "x.py::f", "a.py::alone")])
    assert {r.id: r.target_qualified for r in passes.follow_reexports(nodes, reexport).collect()}[2] == "c.py::alone"
    after, changed, warnings = passes.run_passes(nodes, edges)
    assert warnings == [] and changed["bare_calls"] == 3 and after.count() == 9
    again, changed, _ = passes.run_passes(nodes, after)
    assert sum(changed.values()) == 0 and rows(again.select("id", "target_qualified")) == rows(after.select("id", "target_qualified"))
    _, _, warnings = passes.run_passes(nodes, edges, [("broken", lambda n, e: e.select("no_such_column"))])
    assert warnings == ["broken: AnalysisException"]
    uses = spark.createDataFrame([("r1", "open"), ("r1", "close"), ("r2", "open")], "receiver string, member string")
    classes = spark.createDataFrame([("File", "open"), ("File", "close"), ("Door", "open")], "owner string, member string")
    assert rows(passes.receiver_by_members(uses, classes)) == [("r1", "File")]


def test_overlay_by_position(spark):
    edges = edges_of(spark, [("CALLS", "a.py::f", "run"), ("CALLS", "a.py::f", "run")])
    refs = spark.createDataFrame([("a.py", 3, "run", "b.py::run"), ("a.py", 30, "run", "c.py::run")], "file_path string, line long, name string, symbol string")
    assert rows(passes.overlay_positions(edges, refs).select("target_qualified", "confidence_tier")) == [("b.py::run", "EXACT")] * 2


def test_architecture(spark):
    nodes = nodes_of(spark, ["core/x.py::a", "app/y.py::b", "util/z.py::c", ("core/x.py::K", "Class")], **{"core/x.py::K": {"is_abstract": True}})
    edges = edges_of(spark, [("IMPORTS_FROM", "app/y.py", "core/x.py::a"), ("IMPORTS_FROM", "util/z.py", "core/x.py::a"), ("DEPENDS_ON", "core/x.py", "util/z.py::c"), ("IMPORTS_FROM", "app/y.py", "core/x.py::a")])
    deps = architecture.scope_dependencies(nodes, edges, 1)
    assert rows(deps) == [("app", "core", 2), ("core", "util", 1), ("util", "core", 1)]
    assert {r.scope: (r.ca, r.ce, round(r.instability, 3)) for r in architecture.stability(deps).collect()} == {"app": (0, 1, 1.0), "core": (2, 1, 0.333), "util": (1, 1, 0.5)}
    assert rows(architecture.stability_violations(deps).select("source", "target")) == [("core", "util")]
    assert rows(architecture.distances(nodes, deps, 1).select("scope", "na", "nt", "distance_ppm")) == [("core", 1, 1, 333333)]
    assert {r.scope: r.stable for r in architecture.profiles(nodes, deps, 1).collect()} == {"app": False, "core": True, "util": False}


def test_review(spark):
    base = spark.createDataFrame([("a.py::f", "Function", "f", "(a)", "1"), ("a.py::g", "Function", "g", "()", "2"), ("a.py::old", "Function", "old", "()", "9"), ("a.py::s", "Function", "s", "()", "5")], "qualified_name string, kind string, name string, params string, body_hash string")
    now = spark.createDataFrame([("a.py::f", "Function", "f", "(a, b)", "1"), ("a.py::g", "Function", "g", "()", "3"), ("a.py::new", "Function", "new", "()", "9"), ("a.py::s", "Function", "s", "()", "5")], base.schema)
    delta = changes.symbol_delta(base, now)
    assert rows(delta.select("qualified_name", "status")) == [("a.py::f", "reshaped"), ("a.py::g", "edited"), ("a.py::new", "added"), ("a.py::old", "removed"), ("a.py::s", "same")]
    assert rows(changes.rename_candidates(delta, base, now)) == [("a.py::old", "a.py::new")]
    edges = edges_of(spark, [("CALLS", "b.py::x", "a.py::old"), ("CALLS", "a.py::g", "a.py::old"), ("CALLS", "b.py::x", "a.py::f"), ("CALLS", "b.py::y", "old")])
    changed = spark.createDataFrame([("a.py",)], "key string")
    assert rows(changes.dangling_references(delta, edges, changed).select("target", "source_qualified")) == [("a.py::old", "b.py::x")]
    assert rows(changes.unchanged_callers(delta, edges, changed).select("target", "source_qualified")) == [("a.py::f", "b.py::x")]
    content, done = changes.apply_rename("x = old(1)\nolder = old\n", 2, "old", "new")
    assert done and content == "x = old(1)\nolder = new\n" and "+older = new" in changes.preview_diff("a.py", "x = old(1)\nolder = old\n", content)


def test_unused_and_split(spark):
    nodes = nodes_of(spark, ["a.py::used", "a.py::unused", "a.py::main", ("tests/t.py::test_x", "Test"), "a.py::bare", "a.py::__init__"], **{"a.py::main": {}})
    edges = edges_of(spark, [("CALLS", "a.py::main", "a.py::used"), ("CALLS", "b.py::q", "bare"), ("CALLS", "a.py::unused", "a.py::unused")])
    assert [r.qualified_name for r in refactoring.unused_symbols(nodes, edges).collect()] == ["a.py::unused"]
    found = refactoring.mentioned_elsewhere(nodes.filter("name = 'unused'").select("qualified_name", "name"), spark.createDataFrame([("def unused(): pass\nx = unused\n",), (None,)], "content string"))
    assert [r.mentions for r in found.collect()] == [2]
    metrics = spark.createDataFrame([("f", "Function", 80, 20, 0), ("g", "Function", 80, 2, 0), ("K", "Class", 300, 0, 0)], "qualified_name string, kind string, n_lines long, n_branches long, n_comments long")
    assert sorted(r.qualified_name for r in refactoring.split_candidates(metrics, edges).collect()) == ["K", "f"]
    concerns = spark.createDataFrame([("g", 700_000, "many_callee_scopes")], "qualified_name string, score_ppm long, reasons string")
    assert {r.qualified_name: r.pressure_percent for r in refactoring.split_candidates(metrics, edges, concerns).collect()}["g"] == 107


def test_concerns(spark):
    nodes = nodes_of(spark, ["a.py::busy", "x/b.py::p", "y/c.py::q", "z/d.py::r"]).withColumn("community_id", F.col("id")).withColumn("line_start", F.lit(1).cast("long")).withColumn("line_end", F.lit(3).cast("long"))
    edges = edges_of(spark, [("CALLS", "a.py::busy", t) for t in ("x/b.py::p", "y/c.py::q", "z/d.py::r", "<unresolved:w>", "os.environ")])
    sources = spark.createDataFrame([("a.py", "def busy():\n    if open('x') and x:\n        requests.get(y)\n")], "file_path string, content string")
    got = {r.qualified_name: r for r in refactoring.concern_profiles(nodes, edges, sources).collect()}["a.py::busy"]
    assert (got.n_calls, got.n_communities, got.n_scopes, got.n_side_effects, got.role) == (5, 3, 4, 3, "boundary")
    want = 0.45 * (2 / 3 * 0.35 + 2 / 5 * 0.25 + 1 / 12 * 0.2 + 5 / 22 * 0.2) + 0.25 * 3 / 4
    assert abs(got.score_ppm - want * 1e6) <= 1 and got.reasons == "many_callee_communities,side_effect_pressure"


def test_store(spark, tmp_path):
    nodes = nodes_of(spark, ["a.py::f", "b.py::g"])
    table = store.Table(spark, str(tmp_path / "nodes"))
    assert table.write(nodes) == 1 and table.write(store.replace_files(nodes, nodes.limit(0), spark.createDataFrame([("a.py",)], "key string"))) == 2
    assert [r.qualified_name for r in table.read().collect()] == ["b.py::g"]
    newer = nodes.filter("file_path = 'a.py'").withColumn("updated_at", F.lit(9.0)).withColumn("file_hash", F.lit("new"))
    assert {r.qualified_name: r.file_hash for r in store.upsert_nodes(nodes, newer).collect()} == {"a.py::f": "new", "b.py::g": "h"}
    times = spark.createDataFrame([("a.py", 77), ("a.py", 5)], "file_path string, mtime_ns long")
    assert {r.file_path: r.mtime_ns for r in store.update_mtimes(nodes, times).collect()} == {"a.py": 77, "b.py": 1}
    meta = store.put_metadata(spark.createDataFrame([("schema_version", "1")], "key string, value string"), "schema_version", "20")
    store.check_version(meta)
    with pytest.raises(ValueError):
        store.check_version(store.put_metadata(meta, "schema_version", "3"))
    assert [store.graph_freshness(*x) for x in (("a", "a", 0, 0), ("a", "b", 0, 5), ("a", "a", 2, 5), ("a", "a", 0, 5), (None, "a", 0, 5))] == ["unbuilt", "commit_drift", "dirty", "fresh", "unknown"]


def test_tools(diamond, spark):
    from codelattice import api

    nodes, edges = diamond
    g = api.Graph(spark, nodes, edges, sources=spark.createDataFrame([("a.py", "def a():\n    pass\n")], "file_path string, content string"))
    assert [r.endpoint for r in api.call(g, "query_graph_tool", pattern="callers_of", target="c.py::c")["rows"].collect()] == ["a.py::a", "b.py::b"]
    deep = api.call(g, "query_graph_tool", pattern="callers_of", target="d", depth=3)
    assert [(r.key, r.depth) for r in deep["rows"].collect()] == [("c.py::c", 1), ("a.py::a", 2), ("b.py::b", 2), ("s.py::f", 3)]
    assert api.call(g, "query_graph_tool", pattern="children_of", target="zzz") == {"status": "not_found", "target": "zzz"}
    assert "error" in api.call(g, "query_graph_tool", pattern="callers_of", target="x", depth=9) and "error" in api.call(g, "nothing") and "error" in api.call(g, "flow_tool", wrong=1)
    for name, args in (("list_graph_stats_tool", {}), ("flow_tool", {}), ("review_tool", {"changed_files": ["s.py"]}), ("refactor_tool", {"mode": "dead_code"}), ("refactor_tool", {}), ("semantic_search_nodes_tool", {"query": "f"}), ("architecture_analysis_tool", {})):
        answer = api.call(g, name, **args)
        assert "error" not in answer and api.reply(answer)
    assert api.cross_repo_search({"one": g, "two": g}, "s")["rows"].count() >= 1


def test_hotspots(spark):
    from datetime import datetime, timedelta

    nodes = nodes_of(spark, ["a.py::f", "b.py::g"])
    splits = spark.createDataFrame([("a.py::f", 120), ("b.py::g", 150)], "qualified_name string, pressure_percent long")
    now = datetime(2025, 6, 1)
    made = [("a.py", f"c{i}", now - timedelta(days=i)) for i in range(6)] + [("b.py", f"d{i}", now - timedelta(days=200 + i)) for i in range(9)]
    commits = spark.createDataFrame(made, "file_path string, commit_id string, committed_at timestamp")
    assert rows(refactoring.hotspots(splits, commits, nodes)) == [("a.py::f", 120, 6)]
