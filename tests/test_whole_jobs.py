"""Small cases that a bound on size, depth, rounds or names would lose."""

from codelattice import graph_queries, plan_queries
from codelattice.operators import communities, components
from codelattice.plans import changes, passes
from conftest import rows
from pyspark.sql import functions as F
from test_graph import edges_of, nodes_of


def acyclic(arcs):
    left = set(arcs)
    while True:
        heads, tails = {b for _, b in left}, {a for a, _ in left}
        kept = {(a, b) for a, b in left if a in heads and b in tails}
        if kept == left:
            return not left
        left = kept


def test_cuts_of_components_above_the_size_of_one_call(spark):
    ring = [(f"r{i:02d}", f"r{(i + 1) % 30:02d}") for i in range(30)] + [(f"r{i:02d}", f"r{(i * 7 + 3) % 30:02d}") for i in range(30) if (i * 7 + 3) % 30 != i]
    pairs = sorted(set(ring)) + [("x", "y"), ("x", "y"), ("y", "x")]
    links = spark.createDataFrame(pairs, "src string, dst string")
    found = components.component_cuts(links, components.strongly_connected(links), largest=8).collect()
    assert {r.component for r in found} == {"r00", "x"} and [(r.src, r.dst, r.weight) for r in found if r.component == "x"] == [("y", "x", 1)]
    gone = {(r.src, r.dst) for r in found}
    assert len(gone) == len(found) and gone < set(pairs) and acyclic(set(pairs) - gone)
    assert sum(r.component == "r00" for r in found) <= len(set(ring)) / 2


def test_reexports_over_more_than_two_files(spark, tables):
    files = [f"f{i}.py" for i in range(10)]
    nodes = nodes_of(spark, [(f, "File") for f in files] + ["f5.py::deep", "f9.py::beyond"])
    edges = edges_of(spark, [("IMPORTS_FROM", a, b) for a, b in zip(files, files[1:])] + [("CALLS", "x.py::f", "f0.py::deep"), ("CALLS", "x.py::f", "f0.py::beyond")])
    assert rows(plan_queries.reexported_targets(spark, tables(nodes=nodes, edges=edges))) == [(9, "f5.py::deep")]


def test_entries_at_the_end_of_long_chains(spark, tables):
    seed = graph_queries.SEED_CALLEE
    chain = [seed] + [f"m.py::f{i:02d}" for i in range(1, 24)]
    nodes = nodes_of(spark, [*chain, "t.py::above", ("t.py::test_it", "Test")])
    edges = edges_of(spark, [("CALLS", b, a) for a, b in zip(chain, chain[1:])] + [("CALLS", "m.py::f05", "m.py::f20"), ("CALLS", "t.py::test_it", "m.py::f02"), ("CALLS", "t.py::above", "t.py::test_it")])
    assert rows(graph_queries.entries_reaching(spark, tables(nodes=nodes, edges=edges))) == [("m.py::f23", "uncalled", 23)]
    from codelattice import api

    g = api.Graph(spark, nodes, edges)
    assert [r.hops for r in api.call(g, "flow_tool", target=seed)["entries"].collect()] == [23]


def test_versions_are_whole_states(spark, tables):
    nodes = nodes_of(spark, ["m.py::alpha", "m.py::beta", "m.py::alter", "m.py::bound"])
    later = nodes.filter("name IN ('alter', 'beta')").withColumn("updated_at", F.lit(1.75e9))
    later = later.withColumn("file_hash", F.lit("new"))
    d = tables(nodes=nodes.filter("name <> 'alter'").unionByName(later), edges=edges_of(spark, [("CALLS", "x.py::f", "m.py::beta"), ("CALLS", "x.py::f", "m.py::bound")]))
    assert rows(plan_queries.symbol_delta(spark, d)) == [("m.py::alpha", "same"), ("m.py::alter", "added"), ("m.py::beta", "edited"), ("m.py::bound", "same")]
    assert rows(plan_queries.dangling_references(spark, d)) == []
    base, now = plan_queries.versions(spark, d)
    delta = changes.symbol_delta(base, now.filter("name <> 'bound'"))
    outside = spark.createDataFrame([("none.py",)], "key string")
    assert rows(changes.dangling_references(delta, spark.read.parquet(f"{d}/edges.parquet"), outside).select("target")) == [("m.py::bound",)]


def test_cycles_of_four_and_more(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 12:d}") for i in range(12)]
    links = spark.createDataFrame(ring + [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("c", "a"), ("d", "z")], "src string, dst string")
    found = components.simple_cycles(links, components.strongly_connected(links))
    assert rows(found.filter("component = 'a'").select("length", "path", "truncated")) == [(3, "a > b > c", False), (4, "a > b > c > d", False)]
    assert rows(found.filter("component = 'n0'").select("length", "truncated")) == [(12, False)]
    full = spark.createDataFrame([(f"k{i}", f"k{j}") for i in range(5) for j in range(5) if i != j], "src string, dst string")
    parts = components.strongly_connected(full)
    assert components.simple_cycles(full, parts).filter("NOT truncated").count() == 84
    assert rows(components.simple_cycles(full, parts, max_steps=1)) == [("k0", None, None, True)]
    assert "import_cycles" in graph_queries.QUERIES


def test_slugs_of_headings_below_the_first_line(spark, tables):
    text = "intro\r\n# Top One\n```\n# a comment\n```\nmore\n### Deep: Two\n~~~ py\n# open to the end"
    d = tables(documents=spark.createDataFrame([(1, text), (2, "# First\nplain"), (3, None)], "doc_id long, text string"))
    assert rows(graph_queries.heading_slugs(spark, d)) == [(1, 1, "top-one"), (1, 3, "deep-two"), (2, 1, "first")]


def test_components_with_long_ways_back(spark, monkeypatch):
    monkeypatch.setattr(components, "cut", lambda df: spark.createDataFrame(df.toArrow(), df.schema))  # many short rounds, no files
    names = [f"n{i:03d}" for i in range(205)]
    links = spark.createDataFrame([*zip(names, [*names[1:], names[0]]), *((names[0], x) for x in names[2:])], "src string, dst string")
    found = components.strongly_connected(links)
    assert found.count() == 205 and rows(found.select("component").distinct()) == [("n000",)]


def test_large_components_take_few_jobs_and_cuts_are_those_of_the_joins(spark):
    import random

    draw = random.Random(5)
    arcs = [(f"m{draw.randrange(90):02d}", f"m{draw.randrange(90):02d}") for _ in range(330)] + [(f"c{i:02d}", f"c{(i + 1) % 40:02d}") for i in range(40)] + [("m01", "c00")]
    links = spark.createDataFrame(arcs, "src string, dst string")
    context = spark.sparkContext
    context.setJobGroup("cuts", "cuts")
    parts = components.strongly_connected(links)
    found = rows(components.component_cuts(links, parts, largest=20))
    context.setJobGroup("rest", "rest")
    assert len(context.statusTracker().getJobIdsForGroup("cuts")) <= 40
    assert len(found) > 20 and acyclic({(a, b) for a, b in arcs if a != b} - {(a, b) for _, a, b, _ in found})
    assert rows(components.strongly_connected(links, in_one_call=0)) == rows(parts)
    assert rows(components.component_cuts(links, parts, largest=20, in_one_call=50)) == found


def test_numbered_arcs_on_cycles():
    import numpy as np

    chain = [(i, i + 1) for i in range(200)] + [(200, 201), (201, 200)] + [(201, 202)] + [(i, i + 1) for i in range(202, 300)]
    src, dst = (np.array(x) for x in zip(*chain))
    assert [chain[i] for i in components.cyclic_arcs(301, src, dst)] == [(200, 201), (201, 200)]
    assert [i for i, x in enumerate(components.strong_parts(301, src, dst)) if x >= 0] == [200, 201]


def test_communities_take_few_jobs_and_are_those_of_the_joins(spark):
    import random

    import numpy as np

    ids = spark.range(200).select("id", *(F.expr(f"pmod(xxhash64(id, {t}), 2) = 0").alias(f"t{t}") for t in (0, 1, 77)))
    for t in (0, 1, 77):
        assert [r[f"t{t}"] for r in ids.orderBy("id").collect()] == communities._on_turn(np.arange(200), t).tolist()
    draw = random.Random(3)
    pairs = {tuple(sorted((draw.randrange(120), draw.randrange(120)))) for _ in range(60)}
    pairs |= {tuple(sorted((g * 10 + draw.randrange(10), g * 10 + draw.randrange(10)))) for g in range(12) for _ in range(18)}
    ties = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}", draw.choice([30, 50, 100])) for a, b in sorted(pairs)], "a string, b string, w int")
    context = spark.sparkContext
    context.setJobGroup("communities", "communities")
    found = rows(communities.modularity_communities(ties))
    context.setJobGroup("rest", "rest")
    assert len(context.statusTracker().getJobIdsForGroup("communities")) <= 60
    assert 1 < len({c for _, c in found}) < len(found) / 3
    assert rows(communities.modularity_communities(ties, in_one_call=0)) == found
    assert rows(communities.modularity_communities(ties, in_one_call=120)) == found


def test_held_moves_do_not_depend_on_how_many_ties_are_looked_at_together(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(2)
    pairs = np.unique(draw.integers(0, 60, (300, 2)), axis=0)
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    node, other, w = pairs[:, 0], pairs[:, 1], np.ones(len(pairs))
    asked = (np.arange(60), np.arange(60), node, other, w, np.bincount(node, w, minlength=60), np.arange(60), float(len(pairs)), 1.0)
    whole = communities._held_moves(*asked)
    monkeypatch.setattr(communities, "TIES_AT_ONCE", 7)
    assert communities._held_moves(*asked).tolist() == whole.tolist() != list(range(60))


def test_reexports_walk_once_and_for_declared_names_only(spark, monkeypatch):
    held = []

    def counted(was):
        def cut(df):
            out = was(df)
            held.append(out.count())
            return out

        return cut

    monkeypatch.setattr(passes, "cut", counted(passes.cut))
    monkeypatch.setattr(passes, "cut_table", counted(passes.cut_table))
    files = [f"f{i}.py" for i in range(9)] + ["far.py", "twin.py", "self.py"]
    nodes = nodes_of(spark, [(f, "File") for f in files] + ["far.py::deep", "far.py::both", "twin.py::both", "self.py::own", "far.py::near", "f3.py::near"])
    links = [(a, b) for a in files[:9] for b in files[:9] if a != b] + [("f8.py", "far.py"), ("f7.py", "twin.py"), ("self.py", "f0.py"), ("f1.py", "self.py")]
    wanted = ["f0.py::deep", "f0.py::both", "self.py::X::own", "f0.py::near"] + [f"f0.py::nowhere{i}" for i in range(40)]
    edges = edges_of(spark, [("IMPORTS_FROM", a, b) for a, b in links] + [("CALLS", "x.py::f", t) for t in wanted])
    moved = passes.follow_reexports(nodes, edges).join(edges.select(F.col("id").alias("_i"), F.col("target_qualified").alias("was")), F.col("id") == F.col("_i")).filter("was <> target_qualified")
    assert rows(moved.select("was", "target_qualified")) == [("f0.py::deep", "far.py::deep"), ("f0.py::near", "f3.py::near"), ("self.py::X::own", "self.py::own")]
    assert sum(held) < 1000


def test_passes_leave_one_table_and_let_other_rows_by(spark):
    from pathlib import Path

    from codelattice import session

    nodes = nodes_of(spark, [("a.py", "File"), "a.py::f", "b.py::only"])
    edges = edges_of(spark, [("CALLS", "a.py::f", "only"), ("CALLS", "a.py::f", "len"), ("CONTAINS", "a.py", "a.py::f"), ("CALLS", "a.py::f", "lost"), ("NONE", "a.py::f", "only")])
    edges = edges.withColumns({"target_qualified": F.expr("nullif(target_qualified, 'lost')"), "kind": F.expr("nullif(kind, 'NONE')")})
    folder = Path(session.ensure_checkpoint_dir(spark).removeprefix("file:")) / "tables"
    before = set(folder.iterdir()) if folder.exists() else set()
    steps = [("bare_calls", passes.bare_calls), ("broken", lambda n, e: e.select("none")), ("stdlib_calls", passes.mark_stdlib_calls)]
    after, changed, warnings = passes.run_passes(nodes, edges, steps)
    assert changed == {"bare_calls": 1, "stdlib_calls": 1} and len(warnings) == 1 and warnings[0].startswith("broken")
    assert len(set(folder.iterdir()) - before) == 1
    assert rows(after.select("kind", "target_qualified", "confidence_tier")) == rows(edges.select("kind", F.when(F.expr("kind = 'CALLS' AND target_qualified = 'only'"), "b.py::only").otherwise(F.col("target_qualified")), F.when(F.expr("kind = 'CALLS' AND target_qualified IN ('only', 'len')"), "MEDIUM").otherwise(F.col("confidence_tier"))))
