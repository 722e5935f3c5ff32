"""Calls on a receiver: what type it has, which member is meant, and what is external.

All passes give edges back and change only bare call targets. Who answers is
settled per (question, file) with unique results before the edges are met, so
a common method name never multiplies edges by candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..session import cut, cut_table
from .passes import DIRECT, INFERRED, among, is_bare, is_external, observed_packages, visible_files

# fixed values: standard types a type may dereference to, and methods of a fallible result
DEREF_TARGETS = [
    "str", "String", "slice", "Vec", "Path", "PathBuf", "OsStr", "OsString", "HashMap", "HashSet", "BTreeMap", "BTreeSet", "VecDeque", "Box", "Rc", "Arc", "RefCell", "Cell", "Mutex", "RwLock", "Option", "Result", "CStr", "CString",
]
RESULT_METHODS = [
    "and_then", "as_deref", "as_mut", "as_ref", "expect", "expect_err", "is_err", "is_none", "is_ok", "is_some", "map_err", "map_or", "map_or_else", "ok", "ok_or", "ok_or_else", "or_else", "unwrap", "unwrap_err", "unwrap_or",
    "unwrap_or_default", "unwrap_or_else",
]
RETURN_ROUNDS = 6
OWN_RECEIVERS = ["self", "this", "cls", "super"]


def note(key: str) -> Column:
    return F.get_json_object("extra", f"$.{key}")


def wanted_member() -> Column:
    """The bare name a call asks for, with or without the mark of an unresolved target."""
    return F.regexp_replace("target_qualified", "^<unresolved:(.*)>$", "$1")


def open_calls(edges: DataFrame) -> Column:
    unresolved = F.col("target_qualified").startswith("<unresolved:")
    return (F.col("kind") == "CALLS") & (is_bare(F.col("target_qualified")) | unresolved) & ~is_external()


def rebind(edges: DataFrame, bound: DataFrame, external: bool = False) -> DataFrame:
    """``bound`` (eid, to, near[, package, symbol]) settles edges: HIGH where near, else MEDIUM.

    Only calls without a path in their target are ever asked about.
    """
    target = F.col("target_qualified")
    askable = (F.col("kind") == "CALLS") & (~target.contains("/") | target.startswith("<unresolved:"))
    hit = F.col("eid").isNotNull()
    changed = {
        "target_qualified": F.col("to"), "confidence": F.when(F.col("near"), DIRECT).otherwise(INFERRED), "confidence_tier": F.when(F.col("near"), "HIGH").otherwise("MEDIUM"),
    }
    if external:
        changed["target_name"] = F.col("to")
        changed["extra"] = F.to_json(F.struct(F.lit(True).alias("external"), F.col("package").alias("external_package"), F.col("symbol").alias("external_symbol")))
    settled = [F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in edges.columns]
    return among(edges, askable, lambda part: part.join(bound, F.col("id") == F.col("eid"), "left").select(*settled))


def type_members(nodes: DataFrame) -> DataFrame:
    """``owner, member, family, home, symbol`` of every member of a class or type."""
    named = nodes.filter("kind IN ('Function', 'Test') AND coalesce(parent_name, '') <> ''")
    return named.select(F.col("parent_name").alias("owner"), F.col("name").alias("member"), paths.family_of(F.col("file_path")).alias("family"), F.col("file_path").alias("home"), F.col("qualified_name").alias("symbol"))


def answer_by_type(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``eid, to, near``: members of the receiver's type (``asked``: eid, efile, owner, member).

    The one member in the call's own file or a file it imports; else the only
    member of that type in the language family.
    """
    question = asked.select("efile", "owner", "member").distinct().withColumn("fam", paths.family_of(F.col("efile")))
    members = type_members(nodes).withColumnsRenamed({"owner": "_o", "member": "_m"})
    all_answers = question.join(members, (F.col("owner") == F.col("_o")) & (F.col("member") == F.col("_m")) & F.col("fam").eqNullSafe(F.col("family")))
    own = asked.select(F.col("efile").alias("file"), F.col("efile").alias("visible")).distinct()
    sight = visible_files(edges, nodes).unionByName(own).distinct().select(F.col("file").alias("_f"), F.col("visible").alias("_v"))
    seen = all_answers.join(sight, (F.col("efile") == F.col("_f")) & (F.col("home") == F.col("_v")), "left").withColumn("near", F.col("_v").isNotNull())
    settled = seen.groupBy("efile", "owner", "member").agg(
        F.count_if("near").alias("n_near"), F.min(F.when(F.col("near"), F.col("symbol"))).alias("first_near"), F.count(F.lit(1)).alias("n"), F.min("symbol").alias("first")
    )
    settled = settled.select(F.col("efile").alias("_ef"), F.col("owner").alias("_ow"), F.col("member").alias("_me"), F.when(F.col("n_near") == 1, F.col("first_near")).when((F.col("n_near") == 0) & (F.col("n") == 1), F.col("first")).alias("to"), (F.col("n_near") == 1).alias("near")).filter("to IS NOT NULL")
    return asked.join(settled, (F.col("efile") == F.col("_ef")) & (F.col("owner") == F.col("_ow")) & (F.col("member") == F.col("_me"))).select("eid", "to", "near")


def typed_receivers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls whose extractor names the receiver's type."""
    asked = edges.filter(open_calls(edges) & note("receiver_type").isNotNull()).select(F.col("id").alias("eid"), F.col("file_path").alias("efile"), note("receiver_type").alias("owner"), wanted_member().alias("member"))
    return rebind(edges, answer_by_type(nodes, edges, asked))


def own_receivers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls on ``self`` and its kin: the member of the caller's own class, else of the nearest class it inherits from that has one.

    Classes are walked level by level until no base is left; a level with
    several members of that name settles nothing further up either.
    """
    home = nodes.select(F.col("qualified_name").alias("_q"), F.col("parent_name").alias("_p"), F.col("file_path").alias("_h")).filter("coalesce(_p, '') <> ''")
    calls = edges.filter(open_calls(edges) & note("receiver").isin(OWN_RECEIVERS))
    asked = calls.join(home, F.col("source_qualified") == F.col("_q")).select(F.col("id").alias("eid"), F.concat("_h", F.lit("::"), "_p").alias("klass"), wanted_member().alias("member"), (note("receiver") == "super").alias("above_only"))
    bases = edges.filter("kind = 'INHERITS' AND contains(target_qualified, '::')").select(F.col("source_qualified").alias("_c"), F.col("target_qualified").alias("_b")).distinct()
    held = type_members(nodes).select(F.concat("home", F.lit("::"), "owner").alias("_k"), F.col("member").alias("_m"), "symbol").distinct()
    questions = cut(asked.select("klass", "member", "above_only").distinct().withColumn("at", F.col("klass")))
    settled, frontier, first = None, questions, True
    seen = questions.select("klass", "member", "above_only", "at")
    while True:
        here = frontier.filter("NOT above_only") if first else frontier
        hits = cut(here.join(held, (F.col("at") == F.col("_k")) & (F.col("member") == F.col("_m"))).groupBy("klass", "member", "above_only").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("to")))
        settled = hits if settled is None else settled.unionByName(hits)
        done = hits.select(F.col("klass").alias("_x"), F.col("member").alias("_y"), F.col("above_only").alias("_z"))
        left = frontier.join(done, (F.col("klass") == F.col("_x")) & (F.col("member") == F.col("_y")) & (F.col("above_only") == F.col("_z")), "left_anti")
        up = left.join(bases, F.col("at") == F.col("_c")).select("klass", "member", "above_only", F.col("_b").alias("at")).distinct()
        known = seen.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(seen.columns)])
        frontier = cut(up.join(known, (F.col("klass") == F.col("_s0")) & (F.col("member") == F.col("_s1")) & (F.col("above_only") == F.col("_s2")) & (F.col("at") == F.col("_s3")), "left_anti"))
        if frontier.isEmpty():
            break
        seen, first = seen.unionByName(frontier), False
    one = settled.filter("n = 1").select(F.col("klass").alias("_x"), F.col("member").alias("_y"), F.col("above_only").alias("_z"), "to")
    bound = asked.join(one, (F.col("klass") == F.col("_x")) & (F.col("member") == F.col("_y")) & (F.col("above_only") == F.col("_z"))).select("eid", "to", F.lit(True).alias("near"))
    return rebind(edges, bound)


def returned_receivers(nodes: DataFrame, edges: DataFrame, rounds: int = RETURN_ROUNDS) -> DataFrame:
    """Calls on the result of a call (``receiver_call``: the name called): typed by the return type of the function that call was bound to.

    A round settles calls one link further down a chain; it ends when none is settled, or after ``rounds``.
    """
    returns = nodes.filter("coalesce(return_type, '') <> ''").select(F.col("qualified_name").alias("_f"), text.endpoint_leaf(F.regexp_replace("return_type", r"^[&*\s]*(?:Optional|Result|Option)?[\[<(]?\s*([A-Za-z_][A-Za-z0-9_.:]*).*$", "$1")).alias("owner"))
    for _ in range(rounds):
        waiting = edges.filter(open_calls(edges) & note("receiver_call").isNotNull()).select(F.col("id").alias("eid"), F.col("source_qualified").alias("_s"), F.col("file_path").alias("efile"), note("receiver_call").alias("_call"), wanted_member().alias("member"))
        made = edges.filter("kind = 'CALLS' AND contains(target_qualified, '::')").select(F.col("source_qualified").alias("_by"), text.endpoint_leaf(F.col("target_qualified")).alias("_leaf"), F.col("target_qualified").alias("_made")).distinct()
        one = made.groupBy("_by", "_leaf").agg(F.count(F.lit(1)).alias("_n"), F.min("_made").alias("_made")).filter("_n = 1").drop("_n")
        asked = waiting.join(one, (F.col("_s") == F.col("_by")) & (F.col("_call") == F.col("_leaf"))).join(returns, F.col("_made") == F.col("_f")).select("eid", "efile", "owner", "member")
        bound = cut(answer_by_type(nodes, edges, asked))
        if bound.isEmpty():
            break
        edges = cut_table(rebind(edges, bound))
    return edges


def package_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Go calls ``pkg.Symbol``: the one top-level symbol of that name in an imported directory called ``pkg``, tests left out."""
    target = F.col("target_qualified")
    asked = edges.filter((F.col("kind") == "CALLS") & F.col("file_path").endswith(".go") & target.rlike(r"^[A-Za-z_]\w*\.[A-Z]\w*$") & ~is_external()).select(
        F.col("id").alias("eid"), F.col("file_path").alias("efile"), F.substring_index(target, ".", 1).alias("package"), F.substring_index(target, ".", -1).alias("member")
    )
    imports = edges.filter("kind = 'IMPORTS_FROM'").select(F.col("file_path").alias("_f"), F.regexp_replace("target_qualified", "/+$", "").alias("_dir")).distinct()
    top = nodes.filter("coalesce(parent_name, '') = '' AND kind IN ('Function', 'Class', 'Type')").filter(F.col("file_path").endswith(".go") & ~F.col("file_path").endswith("_test.go"))
    top = top.select(paths.package_of(F.col("file_path")).alias("_home"), F.col("name").alias("_m"), F.col("qualified_name").alias("symbol"))
    met = asked.join(imports, F.col("efile") == F.col("_f")).filter(F.substring_index("_dir", "/", -1) == F.col("package")).join(top, (F.col("_dir") == F.col("_home")) & (F.col("member") == F.col("_m")))
    one = met.groupBy("eid").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("to")).filter("n = 1").select("eid", "to", F.lit(True).alias("near"))
    return rebind(edges, one)


def variant_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls ``Kind::Variant`` or ``Kind.Variant``: the one enumeration of that name in the language family that lists the variant."""
    variants = nodes.filter(note("variants").isNotNull()).select(F.col("name").alias("_kind"), paths.family_of(F.col("file_path")).alias("_fam"), F.col("qualified_name").alias("symbol"), F.explode(F.from_json(note("variants"), "array<string>")).alias("_variant"))
    parts = F.split(F.regexp_replace("target_qualified", "::", "."), r"\.")
    asked = edges.filter((F.col("kind") == "CALLS") & F.col("target_qualified").rlike(r"^[A-Z]\w*(::|\.)[A-Z]\w*$") & ~is_external()).select(F.col("id").alias("eid"), paths.family_of(F.col("file_path")).alias("fam"), F.get(parts, 0).alias("owner"), F.get(parts, 1).alias("variant"))
    met = asked.join(variants, (F.col("owner") == F.col("_kind")) & (F.col("variant") == F.col("_variant")) & F.col("fam").eqNullSafe(F.col("_fam")))
    return rebind(edges, met.groupBy("eid").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("to")).filter("n = 1").select("eid", "to", F.lit(True).alias("near")))


def deref_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rust calls a repository type answers by the standard type it dereferences to, or by the result a constructor returns: ``std``."""
    derefs = nodes.filter((F.col("kind") == "Class") & F.col("file_path").endswith(".rs")).select(F.col("name").alias("_type"), note("deref_target").alias("_to")).filter(F.col("_to").isin(DEREF_TARGETS))
    derefs = derefs.groupBy("_type").agg(F.min("_to").alias("_to"))
    asked = edges.filter(open_calls(edges) & F.col("file_path").endswith(".rs") & note("receiver_type").isNotNull()).select(F.col("id").alias("eid"), note("receiver_type").alias("owner"), wanted_member().alias("member"))
    through = F.coalesce("_to", F.when(F.col("member").isin(RESULT_METHODS), F.col("owner")))
    told = asked.join(derefs, F.col("owner") == F.col("_type"), "left").filter(through.isNotNull())
    return rebind(edges, told.select("eid", F.lit("std").alias("to"), F.lit(False).alias("near"), F.lit("std").alias("package"), F.concat(through, F.lit("::"), "member").alias("symbol")), external=True)


def glob_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bare calls of a name that a glob import of the file brings in from outside, known from explicit uses of that package, and that no node bears."""
    globs = edges.filter((F.col("kind") == "IMPORTS_FROM") & (note("import_glob") == "true") & is_external()).select(F.col("file_path").alias("_f"), note("external_package").alias("_p")).filter("_p IS NOT NULL").distinct()
    names = edges.filter(is_external() & note("external_symbol").isNotNull()).select(note("external_package").alias("_pk"), text.endpoint_leaf(note("external_symbol")).alias("_name")).distinct()
    own = nodes.select(F.col("name").alias("_own")).distinct()
    asked = edges.filter(open_calls(edges)).select(F.col("id").alias("eid"), "file_path", wanted_member().alias("member")).join(own, F.col("member") == F.col("_own"), "left_anti")
    met = asked.join(globs, F.col("file_path") == F.col("_f")).join(names, (F.col("_p") == F.col("_pk")) & (F.col("member") == F.col("_name")))
    one = met.groupBy("eid", "member").agg(F.count_distinct("_p").alias("n"), F.min("_p").alias("package")).filter("n = 1")
    return rebind(edges, one.select("eid", F.col("package").alias("to"), F.lit(True).alias("near"), "package", F.concat("package", F.lit("::"), "member").alias("symbol")), external=True)


def observed_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bare method calls whose name almost always belongs to one package where the package is known: external, MEDIUM."""
    own = nodes.filter("kind IN ('Function', 'Class')").select(F.col("name").alias("_own")).distinct()
    seen = observed_packages(edges).select(F.col("method").alias("_m"), "package")
    asked = edges.filter(open_calls(edges)).select(F.col("id").alias("eid"), wanted_member().alias("member")).join(own, F.col("member") == F.col("_own"), "left_anti")
    told = asked.join(seen, F.col("member") == F.col("_m"))
    return rebind(edges, told.select("eid", F.col("package").alias("to"), F.lit(False).alias("near"), "package", F.concat("package", F.lit("::"), "member").alias("symbol")), external=True)
