"""Symbols nobody uses, symbols to split, and suggestions in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators.lookup import is_reportable_bridge
from ..operators.traversal import ENTRY_NAMES, has_entry_decorator

FUNCTION_LINES, FUNCTION_BRANCHES, FUNCTION_CALLS = 60, 12, 22
CLASS_LINES, CLASS_BRANCHES, CLASS_ALONE = 120, 20, 250
CONCERN_LIMIT_PPM = 650_000

# fixed values: how measures of a function add up to its concern score, what is said about it, and its role.
# A measure counts from `above` on and is full `span` later; groups and the score end at 1.
CONCERN_MEASURES = [  # group, measure, above, span, weight
    ("responsibility", "n_communities", 1, 3.0, 0.35), ("responsibility", "n_scopes", 2, 5.0, 0.25), ("responsibility", "n_branches", 0, 12.0, 0.2), ("responsibility", "n_calls", 0, 22.0, 0.2),
    ("effects", "n_side_effects", 0, 4.0, 1.0),
    ("context", "n_params", 4, 4.0, 0.45), ("context", "n_flags", 0, 2.0, 0.25), ("context", "n_open", 0, 1.0, 0.2), ("context", "n_vague", 0, 1.0, 0.1),
    ("mixture", "n_mixed", 0, 1.0, 1.0),
]
CONCERN_GROUPS = {"responsibility": 0.45, "effects": 0.25, "context": 0.3, "mixture": 0.1}
CONCERN_REASONS = {  # any of the measures that reaches its bound gives the reason
    "many_callee_communities": {"n_communities": 3}, "many_callee_scopes": {"n_scopes": 5}, "branch_heavy": {"n_branches": FUNCTION_BRANCHES}, "many_collaborators": {"n_calls": FUNCTION_CALLS},
    "side_effect_pressure": {"n_side_effects": 2}, "side_effect_mixed_with_decision_logic": {"n_mixed": 1}, "implicit_context": {"n_params": 6, "n_flags": 2}, "low_context_clarity": {"context": 0.5},
}
CONCERN_ROLES = [  # the first role whose measures all lie within their bounds
    ("test_helper", {"in_tests": (1, None)}), ("boundary", {"at_boundary": (1, None)}), ("coordinator", {"coordinates": (1, None)}), ("boundary", {"n_side_effects": (2, None), "n_calls": (3, None)}),
    ("transformer", {"n_side_effects": (None, 0), "n_branches": (None, 4), "n_calls": (None, 6)}), ("pure_candidate", {"n_side_effects": (None, 0), "context": (None, 0.3499999)}), ("unknown", {}),
]

# fixed values: what shows a side effect, an unclear name, a flag, a boundary and a coordinator
SIDE_EFFECTS = {
    "filesystem_io": [".read_text(", ".write_text(", " open(", "path(", "std::fs", "fs::", "read_to_string", "write_all"],
    "database_io": [".execute(", ".executemany(", ".commit(", ".rollback(", ".transaction(", " insert ", " update ", " delete ", " select "],
    "network_io": ["fetch(", "requests.", "urlopen(", "http://", "https://", "client::"],
    "process_or_environment": ["os.environ", "process.env", "std::env", "subprocess", "command::new", "exec(", "spawn("],
    "time_or_random": ["datetime(", "datetime.", "instant::", "random", "time.", "uuid"],
    "logging_or_console": ["console.", "eprintln!", "logger.", "logging.", "println!", "tracing::"],
}
AMBIGUOUS_NAMES = ["activate", "build", "create", "execute", "handle", "main", "process", "register", "run", "sync", "update"]
FLAG_PREFIXES = ["allow_", "dry_", "enable_", "has_", "include_", "is_", "should_", "skip_", "use_", "with_"]
BOUNDARY_PARTS = ["/api/", "/cli/", "/commands/", "/handlers/", "/routes/", "/server/", "/tools/"]
COORDINATOR_PREFIXES = ["activate", "build", "configure", "dispatch", "handle", "install", "register", "run", "serve", "sync", "update"]


def exemption() -> Column:
    """Why a symbol without users stays, or null."""
    true = lambda key: F.get_json_object("extra", f"$.{key}") == "true"
    return (
        F.when(F.coalesce("is_test", F.lit(False)) | (F.col("kind") == "Test") | paths.is_test_path(F.col("file_path")), "test")
        .when(F.col("name").rlike("^__.*__$"), "runtime_hook").when(F.col("name").rlike(ENTRY_NAMES), "entry_name").when(has_entry_decorator(), "framework")
        .when(true("ffi_export"), "ffi_export").when(true("is_contract") | true("is_abstract"), "contract").when(F.get_json_object("extra", "$.decorators").isNotNull(), "decorated")
        .when(F.get_json_object("extra", "$.type_role").isin("record", "enum", "config"), "data_type").when(paths.is_documentation(F.col("language"), F.col("file_path")), "document")
    )


def unused_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions, classes and types with no caller, test, importer, reference, subtype or reportable bridge.

    Uses by full name and by bare name in the same language family are one
    folded key set each, so the anti joins meet distinct keys only.
    """
    code = nodes.filter(F.col("kind").isin("Function", "Class", "Type")).withColumn("reason", exemption()).filter("reason IS NULL")
    use = F.col("kind").isin("CALLS", "IMPORTS_FROM", "REFERENCES", "INHERITS", "IMPLEMENTS", "DEPENDS_ON") | is_reportable_bridge()
    used = edges.filter(use & (F.col("source_qualified") != F.col("target_qualified"))).select(F.col("target_qualified").alias("_u")).distinct()
    tested = edges.filter("kind = 'TESTED_BY'").select(F.col("source_qualified").alias("_u")).distinct()
    bare = edges.filter(F.col("kind").isin("CALLS", "REFERENCES", "INHERITS", "IMPLEMENTS") & ~F.col("target_qualified").contains("::")).select(
        F.regexp_replace("target_qualified", "^<unresolved:(.*)>$", "$1").alias("_name"), paths.family_of(F.col("file_path")).alias("_family")
    ).distinct()
    left = code.join(used, F.col("qualified_name") == F.col("_u"), "left_anti").join(tested, F.col("qualified_name") == F.col("_u"), "left_anti")
    left = left.withColumn("family", paths.family_of(F.col("file_path")))
    return left.join(bare, (F.col("name") == F.col("_name")) & F.col("family").eqNullSafe(F.col("_family")), "left_anti").select("qualified_name", "kind", "name", "file_path")


def mentioned_elsewhere(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates with the number of times their name stands in the text of the sources; 1 is the definition alone.

    Words are counted once over all text; only the names asked for are kept before the exchange.
    """
    asked = candidates.select("name").distinct().withColumnRenamed("name", "_name")
    words = sources.select(F.explode(F.regexp_extract_all("content", F.lit(r"([\p{L}_][\p{L}\p{N}_]*)"), 1)).alias("word"))
    counts = words.join(asked, F.col("word") == F.col("_name"), "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("mentions"))
    return candidates.join(counts, F.col("name") == F.col("word"), "left").withColumn("mentions", F.coalesce("mentions", F.lit(0))).drop("word")


def span_metrics(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Lines, branches and comments of every symbol with a span, from the text of its file."""
    text_of = sources.select(F.col("file_path").alias("_file"), F.split(F.translate("content", "\r", ""), "\n").alias("_lines"))
    spans = nodes.filter("kind IN ('Function', 'Class', 'Test') AND line_start IS NOT NULL AND line_end >= line_start AND line_start > 0").select("qualified_name", "kind", "file_path", "line_start", "line_end")
    joined = spans.join(text_of, F.col("file_path") == F.col("_file"))
    span = F.slice("_lines", F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int"))
    return joined.select("qualified_name", "kind", (F.col("line_end") - F.col("line_start") + 1).alias("n_lines"), text.branch_lines(span).cast("long").alias("n_branches"), text.comment_lines(span).cast("long").alias("n_comments"))


def _any_of(column: Column, patterns: list[str]) -> Column:
    test = F.lit(False)
    for p in patterns:
        test = test | column.contains(p)
    return test


def callee_scope(target: Column) -> Column:
    """Directory of a call's target, ``.`` for none, null for placeholders."""
    parts = F.filter(F.split(F.substring_index(target, "::", 1), "/"), lambda p: (p != "") & (p != "."))
    parent = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    shown = F.when(target.startswith("/"), F.concat(F.lit("/"), parent)).when(parent == "", F.lit(".")).otherwise(parent)
    return F.when((target != "") & ~target.startswith("<"), shown)


def call_measures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``caller, n_calls, n_communities, n_scopes`` and a flag per side effect that a callee's name shows."""
    home = nodes.filter("community_id IS NOT NULL").select(F.col("qualified_name").alias("_t"), "community_id")
    calls = edges.filter("kind = 'CALLS'").select(F.col("source_qualified").alias("caller"), "target_qualified").join(home, F.col("target_qualified") == F.col("_t"), "left")
    shown = {f"called_{k}": F.max(_any_of(F.lower("target_qualified"), p)) for k, p in SIDE_EFFECTS.items()}
    counted = {"n_calls": F.count(F.lit(1)), "n_communities": F.count_distinct("community_id"), "n_scopes": F.count_distinct(callee_scope(F.col("target_qualified")))}
    return calls.groupBy("caller").agg(*[c.alias(name) for name, c in {**counted, **shown}.items()])


def text_measures(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """``function, n_branches`` and a flag per side effect that the function's lines show.

    The spans of a file are gathered before they meet its text, so the text is
    joined once per file and each function carries its own lines only.
    """
    first, last = F.greatest(F.col("line_start"), F.lit(1)).cast("int"), F.col("line_end").cast("int")
    spans = nodes.filter("kind = 'Function' AND line_start IS NOT NULL AND line_end IS NOT NULL").select("file_path", F.struct(F.col("qualified_name").alias("function"), first.alias("first"), last.alias("last")).alias("span"))
    per_file = spans.groupBy("file_path").agg(F.collect_list("span").alias("spans"))  # the functions of one file
    text_of = sources.select(F.col("file_path").alias("_file"), F.split(F.translate("content", "\r", ""), "\n").alias("_lines"))
    laid = per_file.join(text_of, F.col("file_path") == F.col("_file")).select(
        F.explode(F.transform("spans", lambda x: F.struct(x["function"].alias("function"), F.slice("_lines", x["first"], F.greatest(x["last"] - x["first"] + 1, F.lit(0))).alias("lines")))).alias("f")
    )
    body = F.lower(F.array_join("f.lines", "\n"))
    return laid.select("f.function", text.branch_lines(F.col("f.lines")).alias("n_branches"), *[_any_of(body, p).alias(f"shows_{k}") for k, p in SIDE_EFFECTS.items()])


def weighted_groups(measures: list[tuple]) -> dict[str, Column]:
    """Per group, the weighted sum of its measures, each taken from ``above`` over ``span`` and held within 0 and 1."""
    sums: dict[str, Column] = {}
    for group, measure, above, span, weight in measures:
        share = F.least(F.greatest(F.col(measure) - above, F.lit(0)) / span, F.lit(1.0)) * weight
        sums[group] = sums[group] + share if group in sums else share
    return {group: F.least(total, F.lit(1.0)) for group, total in sums.items()}


def within(bounds: dict[str, tuple]) -> Column:
    test = F.lit(True)
    for measure, (low, high) in bounds.items():
        test = test & (F.col(measure) >= low if low is not None else F.lit(True)) & (F.col(measure) <= high if high is not None else F.lit(True))
    return test


def concern_profiles(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """How many concerns every function mixes: ``score_ppm`` by the table of measures, its reasons and role."""
    functions = nodes.filter("kind = 'Function'")
    told = functions.join(call_measures(nodes, edges), F.col("qualified_name") == F.col("caller"), "left").join(text_measures(nodes, sources), F.col("qualified_name") == F.col("function"), "left")
    told = told.na.fill(0, ["n_calls", "n_communities", "n_scopes", "n_branches"])
    either = [F.coalesce(F.col(f"called_{k}"), F.lit(False)) | F.coalesce(F.col(f"shows_{k}"), F.lit(False)) for k in SIDE_EFFECTS]
    names, number = text.parameter_list(F.col("params")), lambda test: F.coalesce(test, F.lit(False)).cast("int")
    flags = F.filter(names, lambda n: F.lower(n).rlike("^(flags?$|" + "|".join(FLAG_PREFIXES) + ")"))
    path = F.concat(F.lit("/"), F.translate("file_path", "\\", "/"))
    told = told.select(
        "qualified_name", "n_calls", "n_communities", "n_scopes", "n_branches", F.size(names).alias("n_params"), F.size(flags).alias("n_flags"), F.size(F.filter(F.array(*either), lambda x: x)).alias("n_side_effects"),
        number((F.coalesce("return_type", F.lit("")) == "") & (F.col("line_end") - F.col("line_start") + 1 >= FUNCTION_LINES)).alias("n_open"), number(F.lower("name").isin(AMBIGUOUS_NAMES)).alias("n_vague"),
        number(_any_of(path, ["/tests/", "/__tests__/"])).alias("in_tests"), number(_any_of(path, BOUNDARY_PARTS)).alias("at_boundary"), number(F.lower("name").rlike("^(" + "|".join(COORDINATOR_PREFIXES) + ")")).alias("coordinates"),
    )
    told = told.withColumn("n_mixed", number((F.col("n_side_effects") > 0) & ((F.col("n_branches") >= FUNCTION_BRANCHES) | (F.col("n_calls") >= FUNCTION_CALLS))))
    told = told.withColumns(weighted_groups(CONCERN_MEASURES))
    score = F.least(sum((F.col(group) * weight for group, weight in CONCERN_GROUPS.items()), F.lit(0.0)), F.lit(1.0))
    reasons = [F.when(F.greatest(*[number(F.col(m) >= least) for m, least in bounds.items()], F.lit(0)) > 0, reason) for reason, bounds in CONCERN_REASONS.items()]
    role = F.coalesce(*[F.when(within(bounds), name) for name, bounds in CONCERN_ROLES])
    return told.select(
        "qualified_name", "n_calls", "n_communities", "n_scopes", "n_side_effects", "n_branches", "n_params", "n_flags", F.floor(score * 1_000_000 + 0.5).cast("long").alias("score_ppm"), F.concat_ws(",", *reasons).alias("reasons"), role.alias("role")
    )


def split_candidates(metrics: DataFrame, edges: DataFrame, concerns: DataFrame | None = None) -> DataFrame:
    """Symbols that are too long and too branched, too busy or too mixed, with the pressure beyond length in percent."""
    calls = edges.filter("kind = 'CALLS'").groupBy(F.col("source_qualified").alias("_s")).agg(F.count(F.lit(1)).alias("n_calls"))
    m = metrics.join(calls, F.col("qualified_name") == F.col("_s"), "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0))).drop("_s")
    if concerns is not None:
        m = m.join(concerns.select(F.col("qualified_name").alias("_c"), F.col("score_ppm").alias("_ppm")), F.col("qualified_name") == F.col("_c"), "left")
    else:
        m = m.withColumn("_ppm", F.lit(0))
    pressure = F.greatest(F.floor(F.col("n_branches") * 100 / FUNCTION_BRANCHES), F.floor(F.col("n_calls") * 100 / FUNCTION_CALLS), F.floor(F.coalesce("_ppm", F.lit(0)) * 100 / CONCERN_LIMIT_PPM))
    function = (F.col("kind") == "Function") & (F.col("n_lines") >= FUNCTION_LINES) & (pressure >= 100)
    klass = (F.col("kind") == "Class") & (((F.col("n_lines") >= CLASS_LINES) & (F.col("n_branches") >= CLASS_BRANCHES)) | (F.col("n_lines") >= CLASS_ALONE))
    return m.filter(function | klass).select("qualified_name", "kind", "n_lines", "n_branches", "n_calls", pressure.alias("pressure_percent"))


def undocumented(metrics: DataFrame, edges: DataFrame, least_callers: int = 5) -> DataFrame:
    """Functions with several callers and no comment line."""
    callers = edges.filter("kind = 'CALLS'").groupBy(F.col("target_qualified").alias("_t")).agg(F.count(F.lit(1)).alias("n_callers"))
    return metrics.filter("kind = 'Function' AND n_comments = 0").join(callers, F.col("qualified_name") == F.col("_t")).filter(F.col("n_callers") >= least_callers).select("qualified_name", "n_callers")


def suggestions(unused: DataFrame, splits: DataFrame, documents: DataFrame) -> DataFrame:
    """Remove, split and document suggestions with an order: kind, weight, name."""
    rows = unused.select(F.lit("remove").alias("action"), "qualified_name", F.lit(1).cast("long").alias("weight")).unionByName(
        splits.select(F.lit("split").alias("action"), "qualified_name", F.col("pressure_percent").cast("long").alias("weight"))
    ).unionByName(documents.select(F.lit("document").alias("action"), "qualified_name", F.col("n_callers").cast("long").alias("weight")))
    rank = F.when(F.col("action") == "split", 0).when(F.col("action") == "remove", 1).otherwise(2)
    return rows.withColumn("rank", rank)


def temper_by_stability(suggested: DataFrame, nodes: DataFrame, profiles: DataFrame, depth: int = 2) -> DataFrame:
    """Confidence of suggestions, lowered in components that are or should be stable."""
    from .architecture import scope_of

    home = nodes.select(F.col("qualified_name").alias("_q"), scope_of(F.col("file_path"), depth).alias("_scope"))
    p = profiles.select(F.col("scope").alias("_p"), (F.col("stable") | F.col("should_be_stable")).alias("_guarded"))
    told = suggested.join(home, F.col("qualified_name") == F.col("_q"), "left").join(p, F.col("_scope") == F.col("_p"), "left")
    return told.withColumn("confidence", F.when(F.coalesce("_guarded", F.lit(False)), "low").when(F.col("action") == "split", "high").otherwise("medium")).drop("_q", "_scope", "_p", "_guarded")


def hotspots(splits: DataFrame, commits: DataFrame, nodes: DataFrame, least: int = 5, days: int = 90) -> DataFrame:
    """Split candidates whose file changed in at least ``least`` commits (file_path, commit_id, committed_at) of the last ``days`` days."""
    newest = commits.agg(F.max("committed_at").alias("_now")).scalar()
    recent = commits.filter(F.col("committed_at") >= newest - F.make_interval(days=F.lit(days)))
    busy = recent.groupBy(F.col("file_path").alias("_file")).agg(F.count_distinct("commit_id").alias("n_commits")).filter(F.col("n_commits") >= least)
    home = nodes.select(F.col("qualified_name").alias("_q"), F.col("file_path").alias("_home"))
    return splits.join(home, F.col("qualified_name") == F.col("_q")).join(busy, F.col("_home") == F.col("_file")).select(*splits.columns, "n_commits")


def infer_tests(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, least: int = 35, limit: int = 25) -> DataFrame:
    """Likely tests of the symbols (``key``): declared 100, name and module link 80, file stem 35, name only 25; the best score of a candidate counts.

    Words of test names are exploded and joined on equality; no test is compared with all symbols.
    """
    from ..operators import ranking

    tests = nodes.filter("kind = 'Test'").select(F.col("qualified_name").alias("test"), F.col("file_path").alias("test_file"), text.identifier_words(F.col("name")).alias("words"))
    asked = nodes.join(symbols, F.col("qualified_name") == F.col("key"), "left_semi").select("qualified_name", F.col("file_path").alias("own_file"), F.array_join(text.identifier_words(F.col("name")), "").alias("joined"), F.lower(F.regexp_extract("file_path", r"([^/]+?)\.[^/.]*$", 1)).alias("stem"))
    declared = edges.filter("kind = 'TESTED_BY'").join(symbols, F.col("source_qualified") == F.col("key"), "left_semi").select(F.col("source_qualified").alias("qualified_name"), F.col("target_qualified").alias("test"), F.lit(100).alias("score"))
    runs = tests.select("test", "test_file", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))), lambda i: F.array_join(F.slice("words", i, n), "")))))).alias("run"))
    named = runs.join(asked, F.col("run") == F.col("joined"))
    links = edges.filter("kind = 'IMPORTS_FROM'").select(F.col("file_path").alias("_from"), F.col("target_qualified").alias("_to")).distinct()
    linked = named.join(links, (F.col("test_file") == F.col("_from")) & (F.col("own_file") == F.col("_to")), "left").select("qualified_name", "test", F.when(F.col("_to").isNotNull(), 80).otherwise(25).alias("score"))
    stems = tests.select("test", F.lower(F.regexp_extract("test_file", r"test_?([^/]+?)\.[^/.]*$", 1)).alias("_stem")).filter("_stem <> ''")
    by_stem = stems.join(asked, F.col("_stem") == F.col("stem")).select("qualified_name", "test", F.lit(35).alias("score"))
    best = declared.unionByName(linked).unionByName(by_stem).groupBy("qualified_name", "test").agg(F.max("score").alias("score")).filter(F.col("score") >= least)
    return ranking.top_per_group(best, ["qualified_name"], [F.desc("score"), F.col("test")], limit)
