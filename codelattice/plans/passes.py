"""Edge-resolution passes: each takes (nodes, edges) and gives edges back.

A pass only changes targets, confidences and tiers or removes edges; the runner
applies them in order, counts changed rows and turns a failing pass into a
warning. Candidate lists are counted before they are looked at, so a name with
very many candidates costs one row, not a product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schema import latest, tier
from ..session import cut, cut_table, cut_union, drop_table, passing_tables, salted_rank

# fixed values
DIRECT, INFERRED, UNRESOLVED = 0.9, 0.6, 0.2
OTHER_METHODS = {  # by package, names of other languages' standard libraries
    "std": ["unwrap", "expect", "clone", "to_string", "to_owned", "into", "as_str", "as_ref", "iter", "into_iter", "collect", "is_some", "is_none", "is_ok", "is_err", "map_err", "unwrap_or", "unwrap_or_default", "unwrap_or_else", "push_str", "Ok", "Err", "Some"],
    "es": ["forEach", "indexOf", "includes", "slice", "splice", "concat", "reduce", "flatMap", "charCodeAt", "toLowerCase", "toUpperCase", "hasOwnProperty", "parseInt", "parseFloat", "then", "catch", "finally"],
    "go": ["make", "cap", "copy", "panic", "recover", "Errorf", "Sprintf", "Println", "Printf"],
}


def stdlib_methods() -> dict[str, str]:
    """Package by name: built-in functions and public methods of the built-in types, by what the running interpreter has, and ``OTHER_METHODS``."""
    import builtins

    kinds = [str, bytes, list, dict, set, tuple, int, float, frozenset]
    names = {n for n in dir(builtins) if not n.startswith("_") and n[:1].islower()} | {n for k in kinds for n in dir(k) if not n.startswith("_")}
    return {**{n: package for package, known in OTHER_METHODS.items() for n in known}, **{n: "builtins" for n in sorted(names)}}


def is_bare(target: Column) -> Column:
    return ~target.contains("::") & ~target.contains("/") & ~target.startswith("<") & (target != "")


def is_external() -> Column:
    return F.coalesce(F.get_json_object("extra", "$.external") == "true", F.lit(False))


def among(edges: DataFrame, candidate: Column, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change`` of the rows ``candidate`` holds for; all others pass by without an exchange."""
    mark = F.coalesce(candidate, F.lit(False))
    return edges.filter(~mark).unionByName(change(edges.filter(mark)).select(*edges.columns))


def visible_files(edges: DataFrame, nodes: DataFrame, reexport_rounds: int = 0) -> DataFrame:
    """(file, visible): what a file imports, directly and through ``reexport_rounds`` further imports."""
    home = nodes.select(F.col("qualified_name").alias("_q"), F.col("file_path").alias("_f")).distinct()
    direct = edges.filter("kind = 'IMPORTS_FROM'").join(home, F.col("target_qualified") == F.col("_q")).select(F.col("file_path").alias("file"), F.col("_f").alias("visible")).filter("file <> visible").distinct()
    seen = direct
    frontier = direct
    for _ in range(reexport_rounds):
        further = frontier.join(direct.select(F.col("file").alias("_a"), F.col("visible").alias("_b")), F.col("visible") == F.col("_a")).select("file", F.col("_b").alias("visible")).filter("file <> visible").distinct()
        known = seen.select(F.col("file").alias("_x"), F.col("visible").alias("_y"))
        frontier = cut(further.join(known, (F.col("file") == F.col("_x")) & (F.col("visible") == F.col("_y")), "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut_union(seen.unionByName(frontier))
    return seen


def name_index(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """(name, candidate, candidate_file, n_candidates) of symbols by bare name."""
    wanted = nodes.filter(F.col("kind").isin(kinds)).select("name", F.col("qualified_name").alias("candidate"), F.col("file_path").alias("candidate_file"), (F.coalesce("parent_name", F.lit("")) == "").alias("top_level"))
    sizes = wanted.groupBy(F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("n_candidates"))
    return wanted.join(sizes, F.col("name") == F.col("_name")).drop("_name")


def bind_bare(nodes: DataFrame, edges: DataFrame, edge_kinds: list[str], kinds: list[str]) -> DataFrame:
    """Bare targets get the one candidate that is visible: same file or a directly imported one (HIGH), else the only one in the language family (MEDIUM).

    Three equi-joins with unique results, best first, instead of one join with
    all candidates of a name.
    """
    is_target = F.col("kind").isin(edge_kinds) & is_bare(F.col("target_qualified")) & ~is_external()
    bare = edges.filter(is_target).select(F.col("id").alias("eid"), F.col("file_path").alias("efile"), F.col("target_qualified").alias("wanted"))
    index = name_index(nodes, kinds)
    in_file = index.groupBy(F.col("name").alias("n1"), F.col("candidate_file").alias("f1")).agg(F.count(F.lit(1)).alias("c1"), F.min("candidate").alias("own"))
    asked = bare.select("efile", "wanted").distinct()
    own = asked.join(in_file.filter("c1 = 1"), (F.col("wanted") == F.col("n1")) & (F.col("efile") == F.col("f1"))).select("efile", "wanted", "own")
    sight = visible_files(edges, nodes)
    seen = asked.join(sight, F.col("efile") == F.col("file")).join(in_file, (F.col("wanted") == F.col("n1")) & (F.col("visible") == F.col("f1")))
    imported = seen.groupBy("efile", "wanted").agg(F.sum("c1").alias("c"), F.min("own").alias("imported")).filter("c = 1").select(F.col("efile").alias("ef2"), F.col("wanted").alias("w2"), "imported")
    family = index.withColumn("family", paths.family_of(F.col("candidate_file"))).groupBy(F.col("name").alias("n3"), F.col("family").alias("fam3")).agg(F.count(F.lit(1)).alias("c3"), F.min("candidate").alias("alone"))
    lone = asked.withColumn("fam", paths.family_of(F.col("efile"))).join(family.filter("c3 = 1"), (F.col("wanted") == F.col("n3")) & (F.col("fam") == F.col("fam3"))).select(F.col("efile").alias("ef3"), F.col("wanted").alias("w3"), "alone")
    told = asked.select(F.col("efile").alias("ef"), F.col("wanted").alias("w"))
    for part, a, b in ((own.select(F.col("efile").alias("ef1"), F.col("wanted").alias("w1"), "own"), "ef1", "w1"), (imported, "ef2", "w2"), (lone, "ef3", "w3")):
        told = told.join(part, (F.col("ef") == F.col(a)) & (F.col("w") == F.col(b)), "left").drop(a, b)
    near = F.coalesce("own", "imported")
    bound = told.select("ef", "w", F.coalesce(near, "alone").alias("bound"), near.isNotNull().alias("near")).filter("bound IS NOT NULL")
    hit = F.col("bound").isNotNull()
    return among(edges, is_target, lambda part: part.join(bound, (F.col("file_path") == F.col("ef")) & (F.col("target_qualified") == F.col("w")), "left").select(*[
        F.when(hit, F.col("bound")).otherwise(F.col("target_qualified")).alias("target_qualified") if c == "target_qualified"
        else F.when(hit, F.when(F.col("near"), DIRECT).otherwise(INFERRED)).otherwise(F.col("confidence")).alias("confidence") if c == "confidence"
        else F.when(hit, F.when(F.col("near"), "HIGH").otherwise("MEDIUM")).otherwise(F.col("confidence_tier")).alias("confidence_tier") if c == "confidence_tier"
        else F.col(c) for c in edges.columns
    ]))


def bare_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return bind_bare(nodes, edges, ["CALLS"], ["Function", "Class", "Test"])


def bare_inheritance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return bind_bare(nodes, edges, ["INHERITS", "IMPLEMENTS"], ["Class", "Type"])


def demote_unresolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node: tier LOW, confidence at most 0.2."""
    known = nodes.select("qualified_name").distinct()
    s, t = known.select(F.col("qualified_name").alias("_s")), known.select(F.col("qualified_name").alias("_t"))
    joined = edges.join(s, F.col("source_qualified") == F.col("_s"), "left").join(t, F.col("target_qualified") == F.col("_t"), "left")
    lost = F.col("_s").isNull() | F.col("_t").isNull()
    return joined.select(*[
        F.when(lost, F.least(F.coalesce("confidence", F.lit(1.0)), F.lit(UNRESOLVED))).otherwise(F.col("confidence")).alias(c) if c == "confidence"
        else F.when(lost, "LOW").otherwise(tier()).alias(c) if c == "confidence_tier" else F.col(c) for c in edges.columns
    ])


def drop_orphan_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TESTED_BY edges whose covered symbol is no node go."""
    known = nodes.select(F.col("qualified_name").alias("_q"))
    tested = edges.filter("kind = 'TESTED_BY'").join(known, F.col("source_qualified") == F.col("_q"), "left_semi")
    return edges.filter("kind <> 'TESTED_BY'").unionByName(tested)


def tested_by_from_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """New TESTED_BY edges (source, target, file_path, line): a test calls a known symbol that no TESTED_BY edge joins to it yet."""
    tests = nodes.filter("kind = 'Test'").select(F.col("qualified_name").alias("_test"))
    code = nodes.filter("kind IN ('Function', 'Class') AND NOT coalesce(is_test, false)").select(F.col("qualified_name").alias("_code"))
    calls = edges.filter("kind = 'CALLS'").join(tests, F.col("source_qualified") == F.col("_test"), "left_semi").join(code, F.col("target_qualified") == F.col("_code"), "left_semi")
    wanted = calls.groupBy(F.col("target_qualified").alias("source_qualified"), F.col("source_qualified").alias("target_qualified"), "file_path").agg(F.min("line").alias("line"))
    have = edges.filter("kind = 'TESTED_BY'").select(F.col("source_qualified").alias("_a"), F.col("target_qualified").alias("_b")).distinct()
    return wanted.join(have, (F.col("source_qualified") == F.col("_a")) & (F.col("target_qualified") == F.col("_b")), "left_anti")


def sync_tests_with_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TESTED_BY edges with a bare covered name take the target of the one call the test makes to that name in the same file."""
    bare = is_bare(F.col("source_qualified"))
    calls = edges.filter("kind = 'CALLS' AND contains(target_qualified, '::')").select(F.col("source_qualified").alias("_test"), F.col("file_path").alias("_file"), text.endpoint_leaf(F.col("target_qualified")).alias("_leaf"), F.col("target_qualified").alias("_target"))
    one = calls.groupBy("_test", "_file", "_leaf").agg(F.count_distinct("_target").alias("_n"), F.min("_target").alias("_target")).filter("_n = 1").drop("_n")
    hit = (F.col("kind") == "TESTED_BY") & bare & (F.col("target_qualified") == F.col("_test")) & (F.col("file_path") == F.col("_file")) & (text.endpoint_leaf(F.col("source_qualified")) == F.col("_leaf"))
    tested = edges.filter("kind = 'TESTED_BY'").join(one, hit, "left")
    fixed = tested.select(*[F.coalesce("_target", "source_qualified").alias(c) if c == "source_qualified" else F.col(c) for c in edges.columns])
    return edges.filter("kind <> 'TESTED_BY'").unionByName(fixed)


def reexport_targets(nodes: DataFrame, edges: DataFrame, hops: int = 8) -> DataFrame:
    """``original, found``: targets ``file::name`` that no node bears, and the one declaration of that name fewest imports away from the file, at most ``hops``.

    Only names that some file declares are asked for. Questions about one file
    share its walk, which meets every file once, at its least distance: a file
    met again is no nearer, so it can neither settle a name nor make it ambiguous.
    """
    known = nodes.select(F.col("qualified_name").alias("_known"))
    dangling = edges.filter("contains(target_qualified, '::')").select(F.col("target_qualified").alias("original")).distinct().join(known, F.col("original") == F.col("_known"), "left_anti")
    open_names = cut_table(dangling.select("original", F.substring_index("original", "::", 1).alias("at"), F.substring_index("original", "::", -1).alias("leaf")))
    asked = open_names.select(F.col("leaf").alias("_leaf")).distinct()
    declared = nodes.filter("contains(qualified_name, '::')").select(F.col("qualified_name").alias("symbol"), F.substring_index("qualified_name", "::", -1).alias("leaf")).join(asked, F.col("leaf") == F.col("_leaf"), "left_semi").distinct()
    declared = declared.withColumn("home", F.expr("substring(symbol, 1, length(symbol) - length(leaf) - 2)"))
    sight = cut_table(visible_files(edges, nodes))
    ids = cut_table(salted_rank(cut_table(sight.select(F.col("file").alias("path")).union(sight.select("visible")).distinct()), [], ["path"], "number"))
    p, q = ids.select(F.col("path").alias("_p"), F.col("number").alias("here")), ids.select(F.col("path").alias("_q"), F.col("number").alias("ahead"))
    steps = cut_table(sight.join(p, F.col("file") == F.col("_p")).join(q, F.col("visible") == F.col("_q")).select("here", "ahead"))
    declared = cut_table(declared.join(q, F.col("home") == F.col("_q")).select(F.col("leaf").alias("_leaf"), F.col("ahead").alias("_home"), "symbol"))
    starts = open_names.join(declared.select("_leaf").distinct(), F.col("leaf") == F.col("_leaf"), "left_semi").join(p, F.col("at") == F.col("_p"))
    questions = cut_table(starts.select("original", "leaf", F.col("here").alias("start")))
    waiting = cut_table(questions.select("start", "leaf").distinct())
    settled, seen, at = None, None, waiting.select("start", F.col("start").alias("file")).distinct()
    for hop in range(1, hops + 1):
        ahead = at.join(steps, F.col("file") == F.col("here")).select("start", F.col("ahead").alias("file")).distinct()
        if seen is not None:
            ahead = ahead.join(seen.select(F.col("start").alias("_s"), F.col("file").alias("_f")), (F.col("start") == F.col("_s")) & (F.col("file") == F.col("_f")), "left_anti")
        at = cut_table(ahead)
        met = at.join(waiting.select(F.col("start").alias("_s"), "leaf"), F.col("start") == F.col("_s")).join(declared, (F.col("file") == F.col("_home")) & (F.col("leaf") == F.col("_leaf")))
        hit = cut_table(met.groupBy("start", "leaf").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("found")))
        settled = hit if settled is None else settled.unionByName(hit)
        if hop == hops or at.isEmpty():
            break
        done = hit.select(F.col("start").alias("_s"), F.col("leaf").alias("_l"))
        waiting = cut_table(waiting.join(done, (F.col("start") == F.col("_s")) & (F.col("leaf") == F.col("_l")), "left_anti"))
        seen = at if seen is None else seen.unionByName(at)
        at = at.join(waiting.select(F.col("start").alias("_w")).distinct(), F.col("start") == F.col("_w"), "left_semi")
    unique = settled.filter("n = 1").select(F.col("start").alias("_s"), F.col("leaf").alias("_l"), "found")
    return cut_table(questions.join(unique, (F.col("start") == F.col("_s")) & (F.col("leaf") == F.col("_l"))).select("original", "found"))


def follow_reexports(nodes: DataFrame, edges: DataFrame, hops: int = 8) -> DataFrame:
    """Targets ``file::name`` that no node bears follow the imports of that file to the file that declares the name, at most ``hops`` imports away."""
    unique = reexport_targets(nodes, edges, hops).withColumnRenamed("original", "_o")
    found = [F.coalesce("found", "target_qualified").alias(c) if c == "target_qualified" else F.col(c) for c in edges.columns]
    return among(edges, F.col("target_qualified").contains("::"), lambda part: part.join(unique, F.col("target_qualified") == F.col("_o"), "left").select(*found))


def mark_stdlib_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bare calls of names only the standard library has become external, MEDIUM."""
    table = F.create_map(*[F.lit(x) for pair in stdlib_methods().items() for x in pair])
    own = nodes.filter("kind IN ('Function', 'Class')").select(F.col("name").alias("_own")).distinct()
    package = F.try_element_at(table, F.col("target_qualified"))
    hit = F.col("_own").isNull()
    return among(edges, (F.col("kind") == "CALLS") & package.isNotNull() & ~is_external(), lambda part: part.join(own, F.col("target_qualified") == F.col("_own"), "left").select(*[
        F.when(hit, F.to_json(F.struct(F.lit(True).alias("external"), package.alias("external_package"), F.lit(True).alias("stdlib")))).otherwise(F.col("extra")).alias(c) if c == "extra"
        else F.when(hit, "MEDIUM").otherwise(F.col("confidence_tier")).alias(c) if c == "confidence_tier" else F.col(c) for c in edges.columns
    ]))


def observed_packages(edges: DataFrame, least: int = 2, share_percent: int = 90) -> DataFrame:
    """(method, package): the package that dominates the calls of a method name whose package is known."""
    known = edges.filter((F.col("kind") == "CALLS") & is_external()).select(text.endpoint_leaf(F.col("target_qualified")).alias("method"), F.get_json_object("extra", "$.external_package").alias("package")).filter("package IS NOT NULL")
    counted = known.groupBy("method", "package").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy(F.col("method").alias("_m")).agg(F.sum("n").alias("total"))
    return counted.join(whole, F.col("method") == F.col("_m")).filter((F.col("total") >= least) & (F.col("n") * 100 >= F.col("total") * share_percent)).select("method", "package", "n", "total")


def receiver_by_members(uses: DataFrame, classes: DataFrame) -> DataFrame:
    """Relational division: the one class that has every member used on a receiver. ``uses`` (receiver, member), ``classes`` (owner, member)."""
    need = uses.distinct().groupBy(F.col("receiver").alias("_r")).agg(F.count(F.lit(1)).alias("need"))
    owners = uses.distinct().join(classes.distinct().select("owner", F.col("member").alias("_m")), F.col("member") == F.col("_m")).groupBy("receiver", "owner").agg(F.count(F.lit(1)).alias("have"))
    full = owners.join(need, (F.col("receiver") == F.col("_r")) & (F.col("have") == F.col("need")))
    return full.groupBy("receiver").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner")).filter("n = 1").select("receiver", "owner")


def link_foreign_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """CONTAINS edges from a type name without a node in their file move to the one node of that type elsewhere."""
    known = nodes.select(F.col("qualified_name").alias("_q"))
    types = nodes.filter("kind IN ('Class', 'Type')").groupBy(F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("qualified_name").alias("owner")).filter("_n = 1")
    lost = edges.filter("kind = 'CONTAINS' AND contains(source_qualified, '::')").join(known, F.col("source_qualified") == F.col("_q"), "left_anti")
    moved = lost.withColumn("_leaf", text.endpoint_leaf(F.col("source_qualified"))).join(types, F.col("_leaf") == F.col("_name"))
    ids = moved.select(F.col("id").alias("_id"), "owner")
    return among(edges, F.expr("kind = 'CONTAINS' AND contains(source_qualified, '::')"), lambda part: part.join(ids, F.col("id") == F.col("_id"), "left").select(*[
        F.coalesce("owner", "source_qualified").alias(c) if c == "source_qualified"
        else F.when(F.col("owner").isNotNull(), F.to_json(F.struct(F.col("source_qualified").alias("impl_owner_from")))).otherwise(F.col("extra")).alias(c) if c == "extra" else F.col(c) for c in edges.columns
    ]))


def bind_by_name_and_directory(edges: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Bare targets of one edge kind bind to the one node of that name in the same directory (module references)."""
    home = nodes.filter("kind <> 'File'").select(F.col("name").alias("_name"), paths.package_of(F.col("file_path")).alias("_dir"), "qualified_name")
    one = home.groupBy("_name", "_dir").agg(F.count(F.lit(1)).alias("_n"), F.min("qualified_name").alias("bound")).filter("_n = 1").drop("_n")
    hit = (F.col("target_qualified") == F.col("_name")) & (paths.package_of(F.col("file_path")) == F.col("_dir"))
    bound = [F.coalesce("bound", "target_qualified").alias(c) if c == "target_qualified" else F.col(c) for c in edges.columns]
    return among(edges, (F.col("kind") == kind) & is_bare(F.col("target_qualified")), lambda part: part.join(one, hit, "left").select(*bound))


def terraform_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return bind_by_name_and_directory(edges, nodes, "REFERENCES")


def documentation_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bridges from documents to a bare name: the one symbol of that name (HIGH for directives, MEDIUM for code spans), else LOW."""
    one = nodes.filter("kind IN ('Function', 'Class', 'Type')").groupBy(F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("qualified_name").alias("bound")).filter("_n = 1").drop("_n")
    wanted = F.regexp_replace("target_qualified", "^<unresolved:(.*)>$", "$1")
    is_doc = (F.col("kind") == "CROSS_ARTIFACT") & ~F.col("target_qualified").contains("::") & ~F.col("target_qualified").contains("/")
    directive = F.get_json_object("extra", "$.markdown_directive_kind").isNotNull()
    hit = F.col("bound").isNotNull()
    return among(edges, is_doc, lambda part: part.withColumn("_wanted", wanted).join(one, F.col("_wanted") == F.col("_name"), "left").select(*[
        F.coalesce("bound", "target_qualified").alias(c) if c == "target_qualified"
        else F.when(hit, F.when(directive, 0.8).otherwise(0.4)).otherwise(UNRESOLVED).alias(c) if c == "confidence"
        else F.when(hit, F.when(directive, "HIGH").otherwise("MEDIUM")).otherwise("LOW").alias(c) if c == "confidence_tier" else F.col(c) for c in edges.columns
    ]))


def replace_derived(edges: DataFrame, derived: DataFrame, extractor: str) -> DataFrame:
    """All edges of one extractor are replaced by ``derived``; running it twice changes nothing."""
    others = edges.filter(~F.coalesce(F.get_json_object("extra", "$.extractor") == extractor, F.lit(False)))
    return others.unionByName(derived.select(*edges.columns))


def bind_exports(imports: DataFrame, exports: DataFrame, bridge_kind: str, extractor: str) -> DataFrame:
    """Bridges between two languages by a shared name: ``imports`` (symbol, file_path, line, name) and ``exports`` (symbol, name).

    A name exported once binds HIGH, one exported several times binds nothing.
    """
    one = exports.groupBy(F.col("name").alias("_name")).agg(F.count_distinct("symbol").alias("_n"), F.min("symbol").alias("target")).filter("_n = 1")
    hit = imports.join(one, F.col("name") == F.col("_name"))
    note = F.to_json(F.struct(F.lit(extractor).alias("extractor"), F.lit(bridge_kind).alias("bridge_kind"), F.lit("calls_binding").alias("relationship_role")))
    return hit.select(F.lit("CROSS_ARTIFACT").alias("kind"), F.col("symbol").alias("source_qualified"), F.col("target").alias("target_qualified"), F.col("name").alias("target_name"), "file_path", "line", note.alias("extra"), F.lit(DIRECT).alias("confidence"), F.lit("HIGH").alias("confidence_tier"))


def native_bindings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls of functions another language exports through a foreign-function interface, as bridges."""
    exported = nodes.filter(F.get_json_object("extra", "$.ffi_export") == "true").select(F.col("qualified_name").alias("symbol"), "name", paths.family_of(F.col("file_path")).alias("export_family"))
    calls = edges.filter((F.col("kind") == "CALLS") & is_bare(F.col("target_qualified"))).select(F.col("source_qualified").alias("symbol"), "file_path", "line", F.col("target_qualified").alias("name"), paths.family_of(F.col("file_path")).alias("call_family"))
    families = exported.groupBy(F.col("name").alias("_n")).agg(F.min("export_family").alias("_f"))
    across = calls.join(families, (F.col("name") == F.col("_n")) & ~F.col("call_family").eqNullSafe(F.col("_f"))).select("symbol", "file_path", "line", "name")
    return bind_exports(across, exported.select("symbol", "name"), "ffi", "native")


def overlay_positions(edges: DataFrame, references: DataFrame, window: int = 8) -> DataFrame:
    """A compiler index settles calls by position: ``references`` (file_path, line, name, symbol); the nearest within ``window`` lines after the call's line wins."""
    refs = references.select(F.col("file_path").alias("_f"), F.col("line").alias("_l"), F.col("name").alias("_n"), "symbol")
    calls = edges.filter("kind = 'CALLS' AND line IS NOT NULL").select(F.col("id").alias("_id"), "file_path", "line", text.endpoint_leaf(F.col("target_qualified")).alias("_leaf"))
    near = calls.join(refs, (F.col("file_path") == F.col("_f")) & (F.col("_leaf") == F.col("_n")) & F.col("_l").between(F.col("line"), F.col("line") + window))
    best = near.groupBy("_id").agg(F.min(F.struct((F.col("_l") - F.col("line")).alias("far"), F.col("symbol"))).alias("b")).select("_id", F.col("b.symbol").alias("settled"))
    joined = edges.join(best, F.col("id") == F.col("_id"), "left")
    hit = F.col("settled").isNotNull()
    return joined.select(*[
        F.coalesce("settled", "target_qualified").alias(c) if c == "target_qualified" else F.when(hit, "EXACT").otherwise(F.col(c)).alias(c) if c == "confidence_tier"
        else F.when(hit, 1.0).otherwise(F.col(c)).alias(c) if c == "confidence" else F.col(c) for c in edges.columns
    ])


Pass = Callable[[DataFrame, DataFrame], DataFrame]


def pass_list() -> list[tuple[str, Pass]]:
    """The passes in their order: what is certain first, what is external next, demotion last."""
    from . import receivers as r

    return [
        ("bare_calls", bare_calls), ("bare_inheritance", bare_inheritance), ("foreign_members", link_foreign_members), ("own_receivers", r.own_receivers), ("typed_receivers", r.typed_receivers), ("returned_receivers", r.returned_receivers),
        ("package_members", r.package_members), ("variant_calls", r.variant_calls), ("terraform_references", terraform_references), ("documentation_references", documentation_references), ("reexports", follow_reexports),
        ("deref_calls", r.deref_calls), ("glob_calls", r.glob_calls), ("stdlib_calls", mark_stdlib_calls), ("observed_calls", r.observed_calls), ("orphan_tests", drop_orphan_tests), ("sync_tests", sync_tests_with_calls), ("demote", demote_unresolved),
    ]


def run_passes(nodes: DataFrame, edges: DataFrame, passes: list[tuple[str, Pass]] | None = None) -> tuple[DataFrame, dict[str, int], list[str]]:
    """Apply the passes in order: edges, changed rows per pass, and warnings of passes that failed.

    Of the tables that are written on the way, only the last edges stay.
    """
    changed, warnings = {}, []
    shown = ["id", "source_qualified", "target_qualified", "confidence", "confidence_tier", "extra"]
    spark = edges.sparkSession
    with passing_tables(spark) as held:
        nodes, current = cut_table(nodes), cut_table(edges, "zstd")
        rows = current.count()
        for name, step in passes or pass_list():
            try:
                with passing_tables(spark) as made:
                    after = cut_table(step(nodes, current), "zstd")
                    was = current.select(F.col("id").alias("_id"), F.xxhash64(*shown).alias("_h"))
                    same = after.select("id", F.xxhash64(*shown).alias("h")).join(was, (F.col("id") == F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi").count()
                    counted = after.count()
                    held.append(made.pop())  # the table of ``after`` takes the place of ``current``
                changed[name] = rows - same
                drop_table(spark, held.pop(1))
                current, rows = after, counted
            except Exception as e:  # noqa: BLE001
                warnings.append(f"{name}: {type(e).__name__}")
        del held[1:]
    return current, changed, warnings


def newest_per_file(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``files`` (a column ``key``) come from ``new`` only, all others from ``old``."""
    kept = old.join(files.select("key").distinct(), F.col("file_path") == F.col("key"), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def collapse_duplicates(nodes: DataFrame) -> DataFrame:
    """One node per qualified name of a file, the first by line; among equals, by a hash of the row."""
    order = W.partitionBy("file_path", "qualified_name").orderBy(F.asc_nulls_last("line_start"), F.asc_nulls_last("line_end"), F.xxhash64(*nodes.columns))
    return nodes.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def drop_malformed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols with a blank or multi-line name go, with all edges that touch them."""
    bad = (F.col("kind") != "File") & ((F.trim(F.coalesce("name", F.lit(""))) == "") | F.col("name").contains("\n"))
    gone = nodes.filter(bad).select(F.col("qualified_name").alias("_gone")).distinct()
    kept = edges.filter(~F.col("target_qualified").contains("\n")).join(gone, F.col("source_qualified") == F.col("_gone"), "left_anti").join(gone, F.col("target_qualified") == F.col("_gone"), "left_anti")
    return nodes.filter(~bad), kept


def merge_batch(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edge upsert on its identity."""
    return latest(edges.unionByName(new, allowMissingColumns=True), ["kind", "source_qualified", "target_qualified", "file_path", "line"], ["updated_at", "id"])
