"""Walks over the graph: one frontier loop and what is asked of it.

A round joins the frontier with the links, folds to one row per new node and
drops what was seen before; it is cut with a checkpoint, so lineage does not
grow with depth. Hot nodes are folded before the exchange.
"""

from __future__ import annotations

from itertools import count

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import cut, cut_union
from .lookup import is_low_confidence_bridge, is_reportable_bridge

ROUNDS_PER_CUT = 16  # rounds after which what was seen is put together

# fixed values: names by which entry points go
ENTRY_NAME_PATTERNS = [
    r"^main$", r"^__main__$", r"^test_", r"^Test[A-Z]", r"^on_", r"^handle_", r"^handler$", r"^handle$", r"^lambda_handler$", r"^upgrade$", r"^downgrade$", r"^lifespan$", r"^get_db$",
    r"^on(Create|Start|Resume|Pause|Stop|Destroy|Bind|Receive)", r"^do(Get|Post|Put|Delete)$", r"^do_(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$", r"^log_message$", r"^(middleware|errorHandler)$",
    r"^ng(OnInit|OnChanges|OnDestroy|DoCheck|AfterContentInit|AfterContentChecked|AfterViewInit|AfterViewChecked)$", r"^(transform|writeValue|registerOnChange|registerOnTouched|setDisabledState)$",
    r"^(canActivate|canDeactivate|canActivateChild|canLoad|canMatch|resolve)$", r"^(componentDidMount|componentDidUpdate|componentWillUnmount|shouldComponentUpdate|render)$",
]
DECORATOR_PATTERNS = [
    r"(?i)app\.(get|post|put|delete|patch|route|websocket|on_event)", r"(?i)router\.(get|post|put|delete|patch|route)", r"(?i)blueprint\.(route|before_request|after_request)",
    r"(?i)(before|after)_(request|response)", r"(?i)click\.(command|group)", r"(?i)\w+\.(command|group)\b", r"(?i)(field|model)_(serializer|validator)",
    r"(?i)(celery\.)?(task|shared_task|periodic_task)", r"(?i)receiver", r"(?i)api_view", r"(?i)\baction\b", r"pytest\.(fixture|mark)", r"(?i)(override_settings|modify_settings)",
    r"(?i)(event\.)?listens_for", r"(?i)(Get|Post|Put|Delete|Patch|RequestMapping)Mapping", r"(?i)(Scheduled|EventListener|Bean|Configuration)",
    r"(?i)(Component|Injectable|Controller|Module|Guard|Pipe)", r"(?i)(Subscribe|Mutation|Query|Resolver)", r"^(Get|Post|Put|Delete|Patch|Options|Head|All)$",
    r"^(MessagePattern|EventPattern|Cron|Interval|Timeout|OnEvent|Process|Processor|SubscribeMessage|WebSocketGateway|HostListener)$", r"(app|router)\.(get|post|put|delete|patch|use|all)\b",
    r"(?i)@(Override|OnLifecycleEvent|Composable)", r"(?i)(HiltViewModel|AndroidEntryPoint|Inject)", r"(?i)\w+\.(tool|tool_plain|prompt|resource|system_prompt|result_validator)\b", r"^tool\b",
    r"(?i)\w+\.(middleware|exception_handler|on_exception)\b", r"(?i)\w+\.route\b",
]
NO_TOP_LEVEL_CODE = ["rust", "go", "java", "kotlin", "c", "cpp", "csharp", "swift", "scala", "dart", "zig", "objc"]
ENTRY_NAMES = "|".join(f"(?:{p})" for p in ENTRY_NAME_PATTERNS)
ENTRY_DECORATORS = "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in DECORATOR_PATTERNS)
CALLER_TEST_DEPTH = {"rust": None, "javascript": 8, "typescript": 8}
DEFAULT_TEST_DEPTH = 4
NEW_ROW_CAP = 500


def walk(seeds: DataFrame, links: DataFrame, max_depth: int | None, stop: DataFrame | None = None) -> DataFrame:
    """``key, depth, via`` of everything within ``max_depth`` of the seeds (a column ``key``), seeds at depth 0; without ``max_depth``, of everything they reach.

    ``links`` has ``src`` and ``dst``; ``via`` is the smallest predecessor on a
    shortest way. Nodes of ``stop`` (a column ``key``) are reached but not left.
    """
    step = links.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    seen = cut(seeds.select("key").distinct().select("key", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("via")))
    frontier = seen
    stop = cut(stop.select("key").distinct()) if stop is not None else None  # asked for in every round
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        start = frontier.join(stop.select(F.col("key").alias("_stop")), F.col("key") == F.col("_stop"), "left_anti") if stop is not None else frontier
        reached = start.select(F.col("key").alias("_from")).join(step, F.col("_from") == F.col("src")).groupBy(F.col("dst").alias("key")).agg(F.min("_from").alias("via"))
        known = seen.select(F.col("key").alias("_seen"))
        frontier = cut(reached.join(known, F.col("key") == F.col("_seen"), "left_anti").select("key", F.lit(depth).cast("long").alias("depth"), "via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % ROUNDS_PER_CUT == 0:
            seen = cut_union(seen)
    step.unpersist()  # what is given back rests on checkpoints alone
    return seen


def impact_links(edges: DataFrame) -> DataFrame:
    """Undirected links of all kinds; bridges only where they are reportable."""
    usable = edges.filter((F.col("kind") != "CROSS_ARTIFACT") | is_reportable_bridge())
    ends = F.explode(F.array(F.struct(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst")), F.struct(F.col("target_qualified").alias("src"), F.col("source_qualified").alias("dst"))))
    return usable.select(ends.alias("p")).select("p.src", "p.dst").filter("src <> '' AND dst <> ''")


def impact_radius(nodes: DataFrame, edges: DataFrame, files: list[str], max_depth: int = 2) -> DataFrame:
    """Everything within ``max_depth`` of the nodes of the changed files: ``qualified_name, depth, is_node``."""
    seeds = nodes.filter(F.col("file_path").isin(files)).select(F.col("qualified_name").alias("key"))
    reached = walk(seeds, impact_links(edges), max_depth).filter("depth > 0")
    known = nodes.select(F.col("qualified_name").alias("_known"))
    return reached.join(known, F.col("key") == F.col("_known"), "left").select(F.col("key").alias("qualified_name"), "depth", F.col("_known").isNotNull().alias("is_node"))


def impact_page(impacted: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` nodes by (depth, name) and one row of totals."""
    page = impacted.filter("is_node").orderBy("depth", "qualified_name").limit(limit)
    totals = impacted.agg(F.count(F.lit(1)).alias("total_impacted")).withColumn("truncated", F.col("total_impacted") > limit)
    return page, totals


def callers(edges: DataFrame) -> DataFrame:
    """Reverse call links."""
    return edges.filter("kind = 'CALLS'").select(F.col("target_qualified").alias("src"), F.col("source_qualified").alias("dst"))


def importers(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'IMPORTS_FROM'").select(F.col("target_qualified").alias("src"), F.col("file_path").alias("dst"))


def imports(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'IMPORTS_FROM' AND NOT startswith(target_qualified, '<unresolved:')").select(F.col("file_path").alias("src"), F.col("target_qualified").alias("dst"))


def transitive_tests(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, max_depth: int = 2) -> DataFrame:
    """Tests of the symbols (``key``; a class brings its members) and of what they call within ``max_depth``: ``test, depth, indirect``."""
    members = edges.filter("kind = 'CONTAINS'").join(symbols, F.col("source_qualified") == F.col("key"), "left_semi").select(F.col("target_qualified").alias("key"))
    forward = edges.filter("kind = 'CALLS'").select(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst"))
    reached = walk(symbols.select("key").unionByName(members), forward, max_depth)
    declared = (F.col("kind") == "CROSS_ARTIFACT") & (F.get_json_object("extra", "$.relationship_role") == "tests")
    tests = edges.filter(F.col("kind") == "TESTED_BY").select(F.col("source_qualified").alias("_s"), F.col("target_qualified").alias("test")).unionByName(
        edges.filter(declared).select(F.col("target_qualified").alias("_s"), F.col("source_qualified").alias("test"))
    )
    found = reached.join(tests, F.col("key") == F.col("_s")).groupBy("test").agg(F.min("depth").alias("depth"))
    return found.withColumn("indirect", F.col("depth") > 0)


def tests_reaching(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, max_depth: int = DEFAULT_TEST_DEPTH) -> DataFrame:
    """Tests that reach a symbol through callers: ``test, hops``, at most ``max_depth`` away."""
    tests = nodes.filter("kind = 'Test' OR is_test").select(F.col("qualified_name").alias("key"))
    covered = edges.filter("kind = 'TESTED_BY'").select(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst"))
    reached = walk(symbols, callers(edges).unionByName(covered), max_depth, stop=tests)
    return reached.filter("depth > 0").join(tests.select(F.col("key").alias("_t")), F.col("key") == F.col("_t"), "left_semi").select(F.col("key").alias("test"), F.col("depth").alias("hops"))


def caller_test_depth(language: str | None) -> int | None:
    return CALLER_TEST_DEPTH.get((language or "").lower(), DEFAULT_TEST_DEPTH)


def has_entry_decorator() -> Column:
    """Decorators are a string or an array in ``extra``; each is tried on its own."""
    told = F.get_json_object("extra", "$.decorators")
    each = F.when(told.startswith("["), F.from_json(told, "array<string>")).otherwise(F.array(told))
    return F.coalesce(F.exists(each, lambda x: F.coalesce(x.rlike(ENTRY_DECORATORS), F.lit(False))), F.lit(False))


def entry_points(nodes: DataFrame, edges: DataFrame, include_tests: bool = False) -> DataFrame:
    """Functions by which the program is entered, and files whose own code runs, with the kind of entry."""
    kinds = ["Function", "Test", "File"] if include_tests else ["Function", "File"]
    called = edges.filter("kind = 'CALLS'").select(F.col("target_qualified").alias("_called")).distinct()
    test = F.coalesce("is_test", F.lit(False)) | paths.is_test_path(F.col("file_path"))
    asked = nodes.filter(F.col("kind").isin(kinds) & (F.lit(include_tests) | ~test)).join(called, F.col("qualified_name") == F.col("_called"), "left")
    used = F.col("_called").isNotNull()
    runs = ~F.lower(F.coalesce("language", F.lit(""))).isin(NO_TOP_LEVEL_CODE)
    kind = (
        F.when(F.col("kind") == "File", F.when(runs & ~used, "module_level")).when(F.col("name").isin("main", "__main__"), "main").when(has_entry_decorator(), "framework_handler")
        .when(F.get_json_object("extra", "$.ffi_export").isNotNull(), "ffi_export").when(used, F.lit(None)).when(F.col("name").rlike(ENTRY_NAMES), "named_entry")
        .when(F.col("parent_name").isNotNull(), "dispatched_method").otherwise("uncalled")
    )
    return asked.withColumn("entry_kind", kind).filter("entry_kind IS NOT NULL").drop("_called")


def entries_reaching(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nearest entry points above the symbols, however far, with hops and the next step towards the symbol; tests are not walked through."""
    tests = nodes.filter("kind = 'Test' OR is_test").select(F.col("qualified_name").alias("key"))
    entries = cut(entry_points(nodes, edges).select(F.col("qualified_name").alias("_entry"), "entry_kind"))
    reached = walk(symbols, callers(edges), None, stop=entries.select(F.col("_entry").alias("key")).unionByName(tests))
    return reached.join(entries, F.col("key") == F.col("_entry")).select(F.col("key").alias("entry"), "entry_kind", F.col("depth").alias("hops"), F.col("via").alias("next"))


def flow_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls and reportable bridges between known nodes."""
    known = nodes.select(F.col("qualified_name").alias("key"))
    usable = edges.filter((F.col("kind") == "CALLS") | is_reportable_bridge()).select(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst"))
    return usable.join(known, F.col("src") == F.col("key"), "left_semi").join(known, F.col("dst") == F.col("key"), "left_semi").distinct()


def dependents(edges: DataFrame, nodes: DataFrame, files: DataFrame, hops: int = 2) -> DataFrame:
    """Files that depend on the files (``key``) within ``hops``, without them: ``key, depth``."""
    home = nodes.select(F.col("qualified_name").alias("_q"), F.col("file_path").alias("_file"))
    used = edges.filter(F.col("kind").isin("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS")).join(home, F.col("target_qualified") == F.col("_q"))
    links = used.select(F.col("_file").alias("src"), F.col("file_path").alias("dst")).filter("src <> dst")
    return walk(files, links, hops).filter("depth > 0").select("key", "depth")


def relationship(pattern: str, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """The named relationship patterns: edges around one node (a symbol or a file), the far end as ``endpoint``."""
    s, t = F.col("source_qualified"), F.col("target_qualified")
    role = F.get_json_object("extra", "$.relationship_role")
    rules = {
        "callers_of": ((F.col("kind") == "CALLS") & (t == key), s),
        "callees_of": ((F.col("kind") == "CALLS") & (s == key), t),
        "imports_of": ((F.col("kind") == "IMPORTS_FROM") & (F.col("file_path") == key), t),
        "importers_of": ((F.col("kind") == "IMPORTS_FROM") & (t == key), F.col("file_path")),
        "docs_for": ((F.col("kind") == "CROSS_ARTIFACT") & (t == key), s),
        "implementations_of": ((F.col("kind") == "IMPLEMENTS") & (t == key), s),
        "bridges_from": ((F.col("kind") == "CROSS_ARTIFACT") & (s == key), t),
        "tests_for": (((F.col("kind") == "TESTED_BY") & (s == key)) | ((F.col("kind") == "CROSS_ARTIFACT") & (role == "tests") & (t == key)), F.when(F.col("kind") == "TESTED_BY", t).otherwise(s)),
        "children_of": ((F.col("kind") == "CONTAINS") & (s == key), t),
        "inheritors_of": (F.col("kind").isin("INHERITS", "IMPLEMENTS") & (t == key), s),
    }
    if pattern == "file_summary":
        return nodes.filter(F.col("file_path") == key).select(F.col("qualified_name").alias("endpoint"), "kind", F.col("line_start").alias("line"), F.lit("EXTRACTED").alias("tier"))
    where, far = rules[pattern]
    bare = ~t.contains("::") & ~t.contains("/")
    shown = F.when(bare & (F.col("kind") == "CALLS"), F.lit("MEDIUM")).otherwise(F.upper(F.coalesce(F.nullif(F.trim("confidence_tier"), F.lit("")), F.lit("EXTRACTED"))))
    return edges.filter(where).select(far.alias("endpoint"), "kind", "line", shown.alias("tier"))


PATTERNS = ["callers_of", "callees_of", "imports_of", "importers_of", "docs_for", "implementations_of", "bridges_from", "tests_for", "children_of", "inheritors_of", "file_summary"]


def bridge_partition(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bridges that are claims and bridges that are caveats."""
    return edges.filter(is_reportable_bridge()), edges.filter(is_low_confidence_bridge())
