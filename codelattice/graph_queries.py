"""Queries of the graph operators over the tables, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text
from .operators import adjacency, aggregates, communities, components, lookup, ranking, search, textindex, traversal
from .schema import EDGES_CTE, NODES_CTE, TIER_SQL, current_edges, current_nodes
from .session import cut_table, ensure_checkpoint_dir, load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FENCED = r"(?ms)^ {0,3}(`{3,}|~{3,}).*?(^ {0,3}\1[`~]*[ \t]*$|\z)"
SEED_FILE = "corelib/base/types.py"
SEED_SYMBOL = "corelib/runtime/trace.py::emit"
SEED_CALLEE = "corelib/runtime/retry.py::with_retry"
WITH = f"WITH {NODES_CTE}, {EDGES_CTE}"
WITH_REC = f"WITH RECURSIVE {NODES_CTE}, {EDGES_CTE}"
EFF_TIER_SQL = "upper(coalesce(nullif(trim(confidence_tier), ''), json_extract_string(extra, '$.confidence_tier'), 'EXTRACTED'))"
REPORTABLE_SQL = f"(kind = 'CROSS_ARTIFACT' AND NOT starts_with(source_qualified, '<unresolved:') AND NOT starts_with(target_qualified, '<unresolved:') AND {EFF_TIER_SQL} IN ('EXACT','HIGH','EXTRACTED'))"
PACKAGE_SQL = "CASE WHEN contains({0}, '/') THEN regexp_extract({0}, '^(.*)/[^/]*$', 1) ELSE '<root>' END"
TEST_PATH_SQL = (
    "(regexp_matches({0}, '(^|/)(" + "|".join(paths.TEST_PARTS) + ")(/|$)') OR CASE WHEN ends_with({0}, '.go') THEN ends_with({0}, '_test.go') ELSE regexp_matches({0}, '" + paths.TEST_NAME + "') END)"
)
DECORATED_SQL = (
    "len(list_filter(CASE WHEN json_type(extra, '$.decorators') = 'ARRAY' THEN json_extract_string(extra, '$.decorators[*]') ELSE [json_extract_string(extra, '$.decorators')] END, "
    f"lambda x: regexp_matches(coalesce(x, ''), '{traversal.ENTRY_DECORATORS}'))) > 0"
)


def words_sql(column: str) -> str:
    out = f"regexp_replace({column}, '[^A-Za-z0-9]+', ' ', 'g')"
    for pattern in [r"([A-Z]+)([A-Z][a-z])", r"([a-z])([A-Z])", r"([A-Za-z])([0-9])", r"([0-9])([A-Za-z])"]:
        out = f"regexp_replace({out}, '{pattern}', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower(trim({out})), ' +'), lambda x: x <> '')"


def query(sql: str | None = None, name: str | None = None):
    """Register a query and its SQL twin."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return current_nodes(spark, d), current_edges(spark, d)


def keys(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "key string")


# --- store: current state ----------------------------------------------------------------------


@query(f"WITH {NODES_CTE} SELECT qualified_name, kind, file_path, file_hash, mtime_ns::VARCHAR AS mtime_ns, updated_at FROM n", "upserted_nodes")
def upserted_nodes(spark, d):
    return current_nodes(spark, d).select("qualified_name", "kind", "file_path", "file_hash", F.col("mtime_ns").cast("string").alias("mtime_ns"), "updated_at")


@query(f"WITH {EDGES_CTE} SELECT kind, source_qualified, target_qualified, file_path, line, confidence, {TIER_SQL} AS tier FROM e")
def upserted_edges(spark, d):
    from .schema import tier

    return current_edges(spark, d).select("kind", "source_qualified", "target_qualified", "file_path", "line", "confidence", tier().alias("tier"))


@query(f"WITH {NODES_CTE} SELECT file_path, max(file_hash) AS file_hash, max(mtime_ns)::VARCHAR AS mtime_ns FROM n WHERE kind = 'File' GROUP BY file_path")
def file_meta_map(spark, d):
    return current_nodes(spark, d).filter("kind = 'File'").groupBy("file_path").agg(F.max("file_hash").alias("file_hash"), F.max("mtime_ns").cast("string").alias("mtime_ns"))


# --- lookups -----------------------------------------------------------------------------------


@query(f"WITH {NODES_CTE} SELECT qualified_name, name, file_path FROM n WHERE kind IN ('Class', 'Type') AND contains(file_path, 'src/')")
def nodes_by_kind(spark, d):
    return lookup.nodes_by_kind(current_nodes(spark, d), ["Class", "Type"], "src/").select("qualified_name", "name", "file_path")


@query(f"WITH {NODES_CTE} SELECT q AS original, qualified_name, kind FROM n JOIN (VALUES ('./{SEED_FILE}', '{SEED_FILE}'), ('corelib\\runtime\\trace.py::emit', '{SEED_SYMBOL}'), ('{SEED_CALLEE}', '{SEED_CALLEE}')) v(q, c) ON n.qualified_name = v.c")
def nodes_by_spelling(spark, d):
    names = [f"./{SEED_FILE}", SEED_SYMBOL.replace("/", "\\"), SEED_CALLEE]
    return lookup.nodes_by_names(current_nodes(spark, d), names).select("original", "qualified_name", "kind")


@query(f"WITH {NODES_CTE} SELECT DISTINCT file_path FROM n WHERE kind = 'File' AND starts_with(file_path, 'corelib/base/') AND NOT contains(substr(file_path, 14), '/')")
def files_in_directory(spark, d):
    return lookup.files_in_directory(current_nodes(spark, d), "corelib/base")


@query(f"WITH {NODES_CTE} SELECT qualified_name, kind, name FROM n WHERE file_path = '{SEED_FILE}'")
def nodes_by_file(spark, d):
    return current_nodes(spark, d).filter(F.col("file_path") == SEED_FILE).select("qualified_name", "kind", "name")


@query(f"WITH {NODES_CTE} SELECT qualified_name, parent_name, name FROM n WHERE parent_name IS NOT NULL AND kind = 'Function' AND signature IS NULL")
def members_without_signature(spark, d):
    return current_nodes(spark, d).filter("parent_name IS NOT NULL AND kind = 'Function' AND signature IS NULL").select("qualified_name", "parent_name", "name")


@query(f"WITH {EDGES_CTE} SELECT kind, source_qualified, target_qualified, line FROM e WHERE kind = 'CALLS' AND starts_with(target_qualified, '<unresolved:')")
def unresolved_calls(spark, d):
    return lookup.unresolved_edges(current_edges(spark, d), "CALLS").select("kind", "source_qualified", "target_qualified", "line")


@query(f"WITH {EDGES_CTE} SELECT source_qualified, target_qualified, json_extract_string(extra, '$.relationship_role') AS relationship_role, json_extract_string(extra, '$.bridge_kind') AS bridge_kind, {EFF_TIER_SQL} AS tier, CASE WHEN {REPORTABLE_SQL} THEN 'hard' ELSE 'caveat' END AS claim_strength FROM e WHERE kind = 'CROSS_ARTIFACT'")
def bridge_records(spark, d):
    r = current_edges(spark, d).filter("kind = 'CROSS_ARTIFACT'").select(lookup.bridge_record().alias("r"))
    return r.select(*[f"r.{c}" for c in ("source_qualified", "target_qualified", "relationship_role", "bridge_kind", "tier", "claim_strength")])


@query(rf"WITH {NODES_CTE} SELECT file_path, {TEST_PATH_SQL.format('file_path')} AS is_test, {PACKAGE_SQL.format('file_path')} AS package, lower(regexp_extract(file_path, '[^/.][^/]*\.([^./]+)$', 1)) AS suffix FROM n WHERE kind = 'File'")
def file_shapes(spark, d):
    f = current_nodes(spark, d).filter("kind = 'File'")
    p = F.col("file_path")
    return f.select("file_path", paths.is_test_path(p).alias("is_test"), paths.package_of(p).alias("package"), paths.suffix(p).alias("suffix"))


@query(f"WITH {EDGES_CTE} SELECT source_qualified, target_qualified, line, json_extract_string(extra, '$.external_package') AS package FROM e WHERE json_extract_string(extra, '$.external') = 'true'")
def external_edges(spark, d):
    e = current_edges(spark, d).filter(F.get_json_object("extra", "$.external") == "true")
    return e.select("source_qualified", "target_qualified", "line", F.get_json_object("extra", "$.external_package").alias("package"))


# --- scalar functions --------------------------------------------------------------------------


@query(f"WITH {NODES_CTE} SELECT qualified_name, array_to_string({words_sql('name')}, ' ') AS words FROM n WHERE kind <> 'DocBody'")
def identifier_words(spark, d):
    return current_nodes(spark, d).filter("kind <> 'DocBody'").select("qualified_name", F.array_join(text.identifier_words(F.col("name")), " ").alias("words"))


@query(rf"""WITH {NODES_CTE} SELECT qualified_name, substr(CASE WHEN kind IN ('Function', 'Test') THEN 'def ' || name || '(' || regexp_replace(coalesce(params, ''), '^\((.*)\)$', '\1') || ')' || CASE WHEN coalesce(return_type, '') <> '' THEN ' -> ' || return_type ELSE '' END WHEN kind = 'Class' THEN 'class ' || name ELSE name END, 1, 512) AS signature FROM n WHERE signature IS NULL""")
def missing_signatures(spark, d):
    n = current_nodes(spark, d).filter("signature IS NULL")
    return n.select("qualified_name", text.signature(F.col("kind"), F.col("name"), F.col("params"), F.col("return_type")).alias("signature"))


@query(f"""WITH {EDGES_CTE} SELECT id, string_split(target_qualified, '::')[-1] AS leaf, string_split(string_split(target_qualified, '::')[-1], '.')[-1] AS endpoint_leaf,
 CASE WHEN starts_with(target_qualified, '<unresolved:') AND {TIER_SQL} IN ('EXTRACTED', 'UNKNOWN') THEN least(coalesce(confidence, 1.0), 0.2) ELSE coalesce(confidence, 1.0) END AS confidence,
 CASE WHEN starts_with(target_qualified, '<unresolved:') AND {TIER_SQL} IN ('EXTRACTED', 'UNKNOWN') THEN 'LOW' ELSE {TIER_SQL} END AS tier FROM e""")
def normalized_confidence(spark, d):
    from .schema import tier

    weak = F.col("target_qualified").startswith("<unresolved:") & tier().isin("EXTRACTED", "UNKNOWN")
    c = F.coalesce("confidence", F.lit(1.0))
    t = F.col("target_qualified")
    return current_edges(spark, d).select("id", text.target_leaf(t).alias("leaf"), text.endpoint_leaf(t).alias("endpoint_leaf"), F.when(weak, F.least(c, F.lit(0.2))).otherwise(c).alias("confidence"), F.when(weak, "LOW").otherwise(tier()).alias("tier"))


@query(r"""SELECT doc_id, length(regexp_extract(h, '^(#{1,6})(\s|$)', 1)) AS level, regexp_replace(regexp_replace(lower(trim(substr(h, length(regexp_extract(h, '^(#{1,6})(\s|$)', 1)) + 1))), '[^\p{L}\p{N}\s_-]', '', 'g'), '\s', '-', 'g') AS slug
FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10))[1] h FROM documents) WHERE regexp_matches(h, '^(#{1,6})(\s|$)')""")
def heading_slugs(spark, d):
    # lines of fenced code are no headings
    prose = F.regexp_replace(F.translate("text", "\r", ""), FENCED, "")
    lines = load(spark, d, "documents").select("doc_id", F.explode(F.split(prose, "\n")).alias("h"))
    h = lines.withColumn("level", text.heading_level(F.col("h"))).filter("level IS NOT NULL")
    return h.select("doc_id", "level", text.slugify(F.expr("substr(h, level + 1)")).alias("slug"))


@query(f"WITH {NODES_CTE} SELECT qualified_name, list_sum(list_transform(string_split(regexp_replace(coalesce(params, ''), '^\\s*\\(|\\)\\s*$', '', 'g'), ','), lambda p: CASE WHEN trim(p) <> '' AND trim(p) NOT IN ('self', 'cls', 'this', '*', '/') THEN 1 ELSE 0 END))::BIGINT AS n_params FROM n WHERE kind = 'Function'")
def parameter_counts(spark, d):
    n = current_nodes(spark, d).filter("kind = 'Function'")
    return n.select("qualified_name", text.parameter_shape(F.col("params"))["total"].cast("long").alias("n_params"))


# --- joins -------------------------------------------------------------------------------------


@query(f"{WITH} SELECT kind, source_qualified, target_qualified, line, 'out' AS direction FROM e WHERE source_qualified = '{SEED_CALLEE}' UNION ALL SELECT kind, source_qualified, target_qualified, line, 'in' FROM e WHERE target_qualified = '{SEED_CALLEE}'")
def edges_by_endpoints(spark, d):
    return adjacency.edges_by_endpoints(current_edges(spark, d), keys(spark, SEED_CALLEE)).select("kind", "source_qualified", "target_qualified", "line", "direction")


@query(f"{WITH}, k AS (SELECT qualified_name FROM n WHERE kind = 'Class') SELECT kind, source_qualified, target_qualified, line FROM e WHERE source_qualified IN (SELECT * FROM k) AND target_qualified IN (SELECT * FROM k)")
def edges_among_classes(spark, d):
    n, e = both(spark, d)
    k = n.filter("kind = 'Class'").select(F.col("qualified_name").alias("key"))
    return adjacency.edges_among(e, k).select("kind", "source_qualified", "target_qualified", "line")


@query(f"{WITH} SELECT DISTINCT e.target_qualified FROM e LEFT JOIN n ON e.source_qualified = n.qualified_name WHERE e.kind = 'CALLS' AND (n.kind IS NULL OR n.kind <> 'File')")
def call_targets(spark, d):
    return adjacency.call_targets(*both(spark, d))


@query(f"{WITH}, p AS (SELECT s.community_id a, t.community_id b FROM e JOIN n s ON e.source_qualified = s.qualified_name JOIN n t ON e.target_qualified = t.qualified_name WHERE s.community_id <> t.community_id) SELECT a AS community_id, b AS neighbour_id FROM p UNION SELECT b, a FROM p")
def community_neighbours(spark, d):
    return adjacency.community_neighbours(*both(spark, d))


@query(f"{WITH}, s AS (SELECT qualified_name FROM n WHERE file_path = '{SEED_FILE}') SELECT DISTINCT file_path FROM e WHERE ((kind = 'IMPORTS_FROM' AND target_qualified = '{SEED_FILE}') OR (kind IN ('CALLS','IMPORTS_FROM','INHERITS','IMPLEMENTS') AND target_qualified IN (SELECT * FROM s))) AND file_path <> '{SEED_FILE}'")
def direct_dependents(spark, d):
    n, e = both(spark, d)
    return adjacency.direct_dependents(n, e, keys(spark, SEED_FILE))


@query(f"{WITH}, low AS (SELECT source_qualified, target_qualified FROM e WHERE kind = 'CROSS_ARTIFACT' AND NOT {REPORTABLE_SQL}), k AS (SELECT qualified_name FROM n WHERE kind = 'Function') SELECT DISTINCT source_qualified, target_qualified FROM low WHERE source_qualified IN (SELECT * FROM k) OR target_qualified IN (SELECT * FROM k)")
def low_confidence_bridges(spark, d):
    n, e = both(spark, d)
    return adjacency.low_confidence_bridges(e, n.filter("kind = 'Function'").select(F.col("qualified_name").alias("key")))


@query(f"{WITH}, r AS (SELECT file_path, min(line) lo, min(line) + 5 hi FROM e WHERE kind = 'CALLS' AND line IS NOT NULL GROUP BY file_path) SELECT n.qualified_name FROM n JOIN r ON n.file_path = r.file_path AND n.line_start <= r.hi AND n.line_end >= r.lo WHERE n.kind <> 'File'")
def nodes_in_changed_ranges(spark, d):
    n, e = both(spark, d)
    ranges = e.filter("kind = 'CALLS' AND line IS NOT NULL").groupBy("file_path").agg(F.min("line").alias("range_start"), (F.min("line") + 5).alias("range_end"))
    return adjacency.nodes_in_ranges(n, ranges).select("qualified_name")


UNIT_SQL = f"""{WITH}, f AS (SELECT DISTINCT file_path FROM n WHERE kind = 'File'),
u AS (SELECT DISTINCT array_to_string(string_split(file_path, '/')[1:k], '/') unit FROM f, (VALUES (1), (3)) v(k) WHERE len(string_split(file_path, '/')) > k),
h AS (SELECT f.file_path, max_by(u.unit, length(u.unit)) unit FROM f JOIN u ON starts_with(f.file_path, u.unit || '/') GROUP BY f.file_path)"""


def _units(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    files = nodes.filter("kind = 'File'").select("file_path").distinct()
    parts = F.split("file_path", "/")
    units = None
    for k in (1, 3):
        part = files.filter(F.size(parts) > k).select(F.array_join(F.slice(parts, 1, k), "/").alias("unit"))
        units = part if units is None else units.unionByName(part)
    return files, units


@query(UNIT_SQL + " SELECT file_path, unit FROM h")
def file_units(spark, d):
    return adjacency.deepest_unit(*_units(current_nodes(spark, d)))


@query(UNIT_SQL + " SELECT a.unit AS from_unit, b.unit AS to_unit, e.kind, count(*) AS n_edges FROM e JOIN n s ON e.source_qualified = s.qualified_name JOIN h a ON s.file_path = a.file_path JOIN n t ON e.target_qualified = t.qualified_name JOIN h b ON t.file_path = b.file_path WHERE a.unit <> b.unit GROUP BY ALL")
def unit_map(spark, d):
    n, e = both(spark, d)
    return adjacency.rolled_up(e, adjacency.deepest_unit(*_units(n)), n)


# --- aggregates --------------------------------------------------------------------------------


@query(f"{WITH} SELECT 'node_kind' AS section, kind AS key, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'edge_kind', kind, count(*) FROM e GROUP BY kind UNION ALL SELECT 'total', 'nodes', count(*) FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM e UNION ALL SELECT 'total', 'files', count(DISTINCT file_path) FROM n WHERE kind = 'File' UNION ALL SELECT 'total', 'languages', count(DISTINCT lower(language)) FROM n")
def graph_stats(spark, d):
    return aggregates.graph_stats(*both(spark, d))


@query(f"WITH {NODES_CTE} SELECT name, count(*) AS n FROM n WHERE kind IN ('Function', 'Class') AND NOT coalesce(is_test, false) GROUP BY name")
def name_counts(spark, d):
    return aggregates.name_counts(current_nodes(spark, d), ["Function", "Class"], False)


def _starts(prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with(w[i], '{p}')" for p in prefixes) + ")"


_EXCLUDED = ", ".join(f"'{x}'" for x in text.SECURITY_EXCLUDED)
SECURE_SQL = f"len(list_filter(range(1, len(w) + 1), lambda i: {_starts(text.SECURITY_PREFIXES)} AND w[i] NOT IN ({_EXCLUDED}) AND (w[i] || coalesce(w[i + 1], '')) NOT IN ({_EXCLUDED}))) > 0"


@query(f"""{WITH}, c AS (SELECT target_qualified q, count(*) k FROM e WHERE kind = 'CALLS' GROUP BY 1), t AS (SELECT source_qualified q, count(*) k FROM e WHERE kind = 'TESTED_BY' GROUP BY 1),
x AS (SELECT qualified_name, coalesce(c.k, 0) callers, coalesce(t.k, 0) tests, {words_sql('name')} w FROM n LEFT JOIN c ON qualified_name = c.q LEFT JOIN t ON qualified_name = t.q WHERE kind IN ('Function', 'Class', 'Test'))
SELECT qualified_name, callers AS caller_count, tests > 0 AS tested, {SECURE_SQL} AS security_relevant,
 least(CASE WHEN callers > 10 THEN 30 WHEN callers > 3 THEN 15 ELSE 0 END + CASE WHEN tests = 0 THEN 30 ELSE 0 END + CASE WHEN {SECURE_SQL} THEN 40 ELSE 0 END, 100) AS risk_percent FROM x""")
def risk_index(spark, d):
    return aggregates.risk_index(*both(spark, d))


@query(f"""{WITH}, t AS (SELECT s.community_id a, g.community_id b FROM e LEFT JOIN (SELECT * FROM n WHERE community_id IS NOT NULL) s ON e.source_qualified = s.qualified_name LEFT JOIN (SELECT * FROM n WHERE community_id IS NOT NULL) g ON e.target_qualified = g.qualified_name
 WHERE NOT (e.kind = 'CALLS' AND NOT contains(e.target_qualified, '::')))
SELECT c AS community_id, count(*) FILTER (a = b) AS internal, count(*) FILTER (a IS DISTINCT FROM b) AS external FROM (SELECT a, b, unnest(list_distinct([a, b])) c FROM t) GROUP BY c""")
def community_cohesion(spark, d):
    return aggregates.community_cohesion(*both(spark, d))


@query(f"""WITH {NODES_CTE}, m AS (SELECT community_id, name, lower(language) lang, {PACKAGE_SQL.format('file_path')} dir FROM n WHERE community_id IS NOT NULL AND kind <> 'File'),
s AS (SELECT community_id, count(*) size FROM m GROUP BY 1),
l AS (SELECT community_id, lang FROM (SELECT community_id, lang, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, lang) rk FROM m WHERE lang IS NOT NULL GROUP BY community_id, lang) WHERE rk = 1),
p AS (SELECT community_id, dir FROM (SELECT community_id, dir, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, dir) rk FROM m WHERE dir IS NOT NULL GROUP BY community_id, dir) WHERE rk = 1),
w AS (SELECT community_id, unnest({words_sql('name')}) word FROM m),
k AS (SELECT community_id, word FROM (SELECT community_id, word, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, word) rk FROM w WHERE length(word) > 2 AND word NOT IN ({", ".join(f"'{x}'" for x in aggregates.NAME_STOPWORDS)}) GROUP BY community_id, word) WHERE rk = 1)
SELECT s.community_id, s.size, l.lang AS dominant_language, p.dir AS directory, k.word AS top_word FROM s LEFT JOIN l USING (community_id) LEFT JOIN p USING (community_id) LEFT JOIN k USING (community_id)""")
def community_profiles(spark, d):
    return aggregates.community_profiles(current_nodes(spark, d))


@query(f"""WITH {NODES_CTE}, live AS (SELECT qualified_name q FROM n WHERE kind <> 'File'), v AS (SELECT DISTINCT provider, qualified_name FROM node_vectors WHERE vector IS NOT NULL)
SELECT provider, count(*) AS n_vectors, count(live.q) AS n_embedded, (SELECT count(*) FROM live) AS n_nodes, count(*) - count(live.q) AS n_orphans FROM v LEFT JOIN live ON v.qualified_name = live.q GROUP BY provider""")
def embedding_coverage(spark, d):
    return aggregates.embedding_coverage(current_nodes(spark, d), load(spark, d, "node_vectors"))


@query(f"""{WITH}, a AS (SELECT count(*) FILTER (kind = 'CROSS_ARTIFACT' AND starts_with(target_qualified, '<unresolved:')) unresolved_bridges, count(*) FILTER (starts_with(target_qualified, '<unresolved:')) unresolved_edges, count(*) edges FROM e),
b AS (SELECT count(DISTINCT community_id) communities, count(*) FILTER (community_id IS NULL AND kind <> 'File') unassigned_nodes FROM n)
SELECT *, CASE WHEN unresolved_edges * 10 > edges THEN 'partial' WHEN communities = 0 THEN 'limited' ELSE 'full' END AS grade FROM a, b""")
def answerability(spark, d):
    return aggregates.answerability(*both(spark, d))


@query(f"{WITH} SELECT e.kind, count(*) FILTER (s.community_id = t.community_id) AS inside, count(*) FILTER (s.community_id <> t.community_id) AS between FROM e JOIN n s ON e.source_qualified = s.qualified_name JOIN n t ON e.target_qualified = t.qualified_name WHERE s.community_id IS NOT NULL AND t.community_id IS NOT NULL GROUP BY e.kind".replace("AS between", 'AS "between"'))
def cross_community_edges(spark, d):
    return aggregates.cross_community_edges(*both(spark, d))


# --- ranking -----------------------------------------------------------------------------------


_FUSE_A = f"SELECT id, row_number() OVER (ORDER BY length(name), id) - 1 p FROM n WHERE kind = 'Function' AND contains(lower(name), 'graph')"
_FUSE_B = f"SELECT id, row_number() OVER (ORDER BY length(qualified_name) DESC, id) - 1 p FROM n WHERE contains(lower(qualified_name), 'graph') AND kind IN ('Function', 'Class')"


@query(f"WITH {NODES_CTE}, a AS ({_FUSE_A}), b AS ({_FUSE_B}), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, sum(round(1000000000 / (11 + p))::BIGINT)::BIGINT AS fusion_score FROM u GROUP BY id")
def rank_fusion(spark, d):
    n = current_nodes(spark, d)
    a = ranking.ranked(n.filter((F.col("kind") == "Function") & F.lower("name").contains("graph")), [F.length("name"), F.col("id")]).select("id", "position")
    b = ranking.ranked(n.filter(F.lower("qualified_name").contains("graph") & F.col("kind").isin("Function", "Class")), [F.desc(F.length("qualified_name")), F.col("id")]).select("id", "position")
    return ranking.rank_fusion([a, b]).select("id", "fusion_score")


@query(f"""WITH {EDGES_CTE}, x AS (SELECT target_qualified endpoint, line, upper(coalesce(nullif(trim(confidence_tier), ''), 'EXTRACTED')) t FROM e WHERE kind = 'CALLS'),
y AS (SELECT *, CASE WHEN list_position(['EXACT','EXTRACTED','HIGH','MEDIUM','LOW','UNKNOWN'], t) > 0 THEN list_position(['EXACT','EXTRACTED','HIGH','MEDIUM','LOW','UNKNOWN'], t) ELSE 6 END r FROM x)
SELECT endpoint, coalesce(array_to_string(list_sort(list(DISTINCT line) FILTER (line IS NOT NULL)), ','), '') AS lines, count(*) AS n_edges, (['EXACT','EXTRACTED','HIGH','MEDIUM','LOW','UNKNOWN'])[min(r)] AS best_tier FROM y GROUP BY endpoint""")
def merged_callees(spark, d):
    return ranking.merge_endpoint_rows(current_edges(spark, d).filter("kind = 'CALLS'"), "target_qualified")


@query(f"WITH {EDGES_CTE}, c AS (SELECT target_qualified, count(*) k FROM e WHERE kind = 'CALLS' GROUP BY 1), s AS (SELECT list_sort(list(k)) l FROM c) SELECT l[least(len(l) * 95 // 100, len(l) - 1) + 1] AS p95 FROM s")
def caller_count_p95(spark, d):
    c = current_edges(spark, d).filter("kind = 'CALLS'").groupBy("target_qualified").agg(F.count(F.lit(1)).alias("k"))
    return ranking.indexed_percentile(c.withColumn("all", F.lit(1)), ["all"], "k", 95, "p95").select("p95")


@query("SELECT id, dense, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, created_at, id) AS dense FROM tasks WHERE state = 'pending') WHERE dense <= 3")
def claimable_tasks(spark, d):
    t = load(spark, d, "tasks").filter("state = 'pending'")
    return ranking.top_per_group(t, ["kind"], [F.desc("priority"), F.col("created_at"), F.col("id")], 3).select("id", F.col("place").alias("dense"), "kind")


# --- walks -------------------------------------------------------------------------------------


_LINKS = f"l AS (SELECT source_qualified src, target_qualified dst FROM e WHERE kind <> 'CROSS_ARTIFACT' OR {REPORTABLE_SQL}), u AS (SELECT src, dst FROM l WHERE src <> '' AND dst <> '' UNION SELECT dst, src FROM l WHERE src <> '' AND dst <> '')"


@query(f"{WITH_REC}, {_LINKS}, w AS (SELECT qualified_name k, 0 dep FROM n WHERE file_path = '{SEED_FILE}' UNION SELECT u.dst, w.dep + 1 FROM w JOIN u ON u.src = w.k WHERE w.dep < 2), m AS (SELECT k, min(dep) dep FROM w GROUP BY k) SELECT k AS qualified_name, dep::BIGINT AS depth, k IN (SELECT qualified_name FROM n) AS is_node FROM m WHERE dep > 0")
def impact_radius(spark, d):
    n, e = both(spark, d)
    return traversal.impact_radius(n, e, [SEED_FILE], 2)


@query(f"{WITH_REC}, c AS (SELECT DISTINCT target_qualified src, source_qualified dst FROM e WHERE kind = 'CALLS'), w AS (SELECT '{SEED_CALLEE}' k, 0 dep UNION SELECT c.dst, dep + 1 FROM w JOIN c ON c.src = w.k WHERE dep < 3) SELECT k AS caller, min(dep)::BIGINT AS depth FROM w GROUP BY k HAVING min(dep) > 0")
def transitive_callers(spark, d):
    found = traversal.walk(keys(spark, SEED_CALLEE), traversal.callers(current_edges(spark, d)), 3)
    return found.filter("depth > 0").select(F.col("key").alias("caller"), "depth")


@query(f"{WITH_REC}, c AS (SELECT DISTINCT target_qualified src, file_path dst FROM e WHERE kind = 'IMPORTS_FROM'), w AS (SELECT '{SEED_FILE}' k, 0 dep UNION SELECT c.dst, dep + 1 FROM w JOIN c ON c.src = w.k WHERE dep < 3) SELECT k AS importer, min(dep)::BIGINT AS depth FROM w GROUP BY k HAVING min(dep) > 0")
def transitive_importers(spark, d):
    found = traversal.walk(keys(spark, SEED_FILE), traversal.importers(current_edges(spark, d)), 3)
    return found.filter("depth > 0").select(F.col("key").alias("importer"), "depth")


@query(f"""{WITH_REC}, f AS (SELECT DISTINCT source_qualified src, target_qualified dst FROM e WHERE kind = 'CALLS'), s AS (SELECT qualified_name k FROM n WHERE kind = 'Class' AND file_path LIKE 'corelib/%'),
w AS (SELECT k, 0 dep FROM s UNION SELECT target_qualified, 0 FROM e WHERE kind = 'CONTAINS' AND source_qualified IN (SELECT k FROM s) UNION SELECT f.dst, dep + 1 FROM w JOIN f ON f.src = w.k WHERE dep < 2),
m AS (SELECT k, min(dep) dep FROM w GROUP BY k), t AS (SELECT source_qualified q, target_qualified test FROM e WHERE kind = 'TESTED_BY' UNION ALL SELECT target_qualified, source_qualified FROM e WHERE kind = 'CROSS_ARTIFACT' AND json_extract_string(extra, '$.relationship_role') = 'tests')
SELECT test, min(dep)::BIGINT AS depth, min(dep) > 0 AS indirect FROM m JOIN t ON m.k = t.q GROUP BY test""")
def transitive_tests(spark, d):
    n, e = both(spark, d)
    seeds = n.filter("kind = 'Class' AND file_path LIKE 'corelib/%'").select(F.col("qualified_name").alias("key"))
    return traversal.transitive_tests(n, e, seeds, 2)


@query(f"""{WITH_REC}, t AS (SELECT qualified_name k FROM n WHERE kind = 'Test' OR is_test), c AS (SELECT target_qualified src, source_qualified dst FROM e WHERE kind = 'CALLS' UNION SELECT source_qualified, target_qualified FROM e WHERE kind = 'TESTED_BY'),
w AS (SELECT '{SEED_CALLEE}' k, 0 dep UNION SELECT c.dst, dep + 1 FROM w JOIN c ON c.src = w.k WHERE dep < 4 AND w.k NOT IN (SELECT k FROM t)) SELECT w.k AS test, min(dep)::BIGINT AS hops FROM w JOIN t ON w.k = t.k GROUP BY w.k HAVING min(dep) > 0""")
def tests_reaching(spark, d):
    n, e = both(spark, d)
    return traversal.tests_reaching(n, e, keys(spark, SEED_CALLEE))


_ENTRY = f"""c AS (SELECT DISTINCT target_qualified q FROM e WHERE kind = 'CALLS'),
x AS (SELECT n.*, c.q FROM n LEFT JOIN c ON n.qualified_name = c.q WHERE n.kind IN ('Function', 'File') AND NOT coalesce(n.is_test, false) AND NOT {TEST_PATH_SQL.format('n.file_path')}),
en AS (SELECT qualified_name, CASE WHEN kind = 'File' THEN CASE WHEN q IS NULL AND lower(coalesce(language, '')) NOT IN ({", ".join(f"'{x}'" for x in traversal.NO_TOP_LEVEL_CODE)}) THEN 'module_level' END WHEN name IN ('main', '__main__') THEN 'main' WHEN {DECORATED_SQL} THEN 'framework_handler'
 WHEN json_extract_string(extra, '$.ffi_export') IS NOT NULL THEN 'ffi_export' WHEN q IS NOT NULL THEN NULL WHEN regexp_matches(name, '{traversal.ENTRY_NAMES}') THEN 'named_entry' WHEN parent_name IS NOT NULL THEN 'dispatched_method' ELSE 'uncalled' END entry_kind FROM x)"""


@query(f"{WITH}, {_ENTRY} SELECT qualified_name, entry_kind FROM en WHERE entry_kind IS NOT NULL")
def entry_points(spark, d):
    return traversal.entry_points(*both(spark, d)).select("qualified_name", "entry_kind")


@query(f"""{WITH_REC}, {_ENTRY}, stop AS (SELECT qualified_name k FROM en WHERE entry_kind IS NOT NULL UNION SELECT qualified_name FROM n WHERE kind = 'Test' OR is_test), r AS (SELECT DISTINCT target_qualified src, source_qualified dst FROM e WHERE kind = 'CALLS'),
w AS (SELECT '{SEED_CALLEE}' k, 0 dep UNION SELECT r.dst, dep + 1 FROM w JOIN r ON r.src = w.k WHERE dep < 64 AND w.k NOT IN (SELECT k FROM stop))
SELECT w.k AS entry, en.entry_kind, min(dep)::BIGINT AS hops FROM w JOIN en ON w.k = en.qualified_name WHERE en.entry_kind IS NOT NULL GROUP BY ALL""")
def entries_reaching(spark, d):
    n, e = both(spark, d)
    return traversal.entries_reaching(n, e, keys(spark, SEED_CALLEE)).select("entry", "entry_kind", "hops")


@query(f"""{WITH_REC}, l AS (SELECT DISTINCT n.file_path src, e.file_path dst FROM e JOIN n ON e.target_qualified = n.qualified_name WHERE e.kind IN ('CALLS','IMPORTS_FROM','INHERITS','IMPLEMENTS') AND n.file_path <> e.file_path),
w AS (SELECT 'corelib/base/clock.py' k, 0 dep UNION SELECT l.dst, dep + 1 FROM w JOIN l ON l.src = w.k WHERE dep < 2) SELECT k AS key, min(dep)::BIGINT AS depth FROM w GROUP BY k HAVING min(dep) > 0""")
def dependents_two_hops(spark, d):
    n, e = both(spark, d)
    return traversal.dependents(e, n, keys(spark, "corelib/base/clock.py"), 2)


@query(f"{WITH}, k AS (SELECT qualified_name FROM n) SELECT DISTINCT source_qualified AS src, target_qualified AS dst FROM e WHERE (kind = 'CALLS' OR {REPORTABLE_SQL}) AND source_qualified IN (SELECT * FROM k) AND target_qualified IN (SELECT * FROM k)")
def flow_links(spark, d):
    return traversal.flow_links(*both(spark, d))


_BARE = "CASE WHEN kind = 'CALLS' AND NOT contains(target_qualified, '::') AND NOT contains(target_qualified, '/') THEN 'MEDIUM' ELSE upper(coalesce(nullif(trim(confidence_tier), ''), 'EXTRACTED')) END"
_PATTERN_SQL = {
    "callers_of": (f"kind = 'CALLS' AND target_qualified = '{SEED_SYMBOL}'", "source_qualified", SEED_SYMBOL),
    "callees_of": (f"kind = 'CALLS' AND source_qualified = '{SEED_CALLEE}'", "target_qualified", SEED_CALLEE),
    "imports_of": (f"kind = 'IMPORTS_FROM' AND file_path = '{SEED_FILE}'", "target_qualified", SEED_FILE),
    "importers_of": (f"kind = 'IMPORTS_FROM' AND target_qualified = '{SEED_FILE}'", "file_path", SEED_FILE),
    "docs_for": (f"kind = 'CROSS_ARTIFACT' AND target_qualified = '{SEED_SYMBOL}'", "source_qualified", SEED_SYMBOL),
    "implementations_of": ("kind = 'IMPLEMENTS' AND target_qualified = 'corelib/base/errors.py::FaultBase'", "source_qualified", "corelib/base/errors.py::FaultBase"),
    "bridges_from": (f"kind = 'CROSS_ARTIFACT' AND source_qualified = '{SEED_FILE}'", "target_qualified", SEED_FILE),
    "tests_for": (f"(kind = 'TESTED_BY' AND source_qualified = '{SEED_SYMBOL}') OR (kind = 'CROSS_ARTIFACT' AND json_extract_string(extra, '$.relationship_role') = 'tests' AND target_qualified = '{SEED_SYMBOL}')", "CASE WHEN kind = 'TESTED_BY' THEN target_qualified ELSE source_qualified END", SEED_SYMBOL),
    "children_of": (f"kind = 'CONTAINS' AND source_qualified = '{SEED_FILE}'", "target_qualified", SEED_FILE),
    "inheritors_of": ("kind IN ('INHERITS', 'IMPLEMENTS') AND target_qualified = 'corelib/base/errors.py::FaultBase'", "source_qualified", "corelib/base/errors.py::FaultBase"),
}
for _pattern, (_where, _far, _key) in _PATTERN_SQL.items():
    query(f"WITH {EDGES_CTE} SELECT {_far} AS endpoint, kind, line, {_BARE} AS tier FROM e WHERE {_where}", _pattern)(lambda spark, d, p=_pattern, k=_key: traversal.relationship(p, *both(spark, d), k))


@query(f"WITH {NODES_CTE} SELECT qualified_name AS endpoint, kind, line_start AS line, 'EXTRACTED' AS tier FROM n WHERE file_path = '{SEED_FILE}'")
def file_summary(spark, d):
    return traversal.relationship("file_summary", *both(spark, d), SEED_FILE)


# --- cycles and communities --------------------------------------------------------------------


_FILE_LINKS = "fl AS (SELECT DISTINCT e.file_path src, n.file_path dst FROM e JOIN n ON e.target_qualified = n.qualified_name WHERE e.kind = 'IMPORTS_FROM' AND e.file_path <> n.file_path)"


def file_links(spark, d) -> DataFrame:
    n, e = both(spark, d)
    home = n.select(F.col("qualified_name").alias("_q"), F.col("file_path").alias("dst"))
    return e.filter("kind = 'IMPORTS_FROM'").join(home, F.col("target_qualified") == F.col("_q")).select(F.col("file_path").alias("src"), "dst").filter("src <> dst").distinct()


@query(f"{WITH_REC}, {_FILE_LINKS}, r AS (SELECT src a, dst b FROM fl UNION SELECT r.a, fl.dst FROM r JOIN fl ON r.b = fl.src), m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) SELECT a AS node, least(a, min(b)) AS component FROM m WHERE a <> b GROUP BY a")
def import_components(spark, d):
    return components.strongly_connected(file_links(spark, d))


@query(f"{WITH}, {_FILE_LINKS}, p AS (SELECT src, dst, count(*) weight FROM fl GROUP BY ALL) SELECT p.src AS a, p.dst AS b, p.weight, q.weight AS weight_back FROM p JOIN p q ON p.src = q.dst AND p.dst = q.src WHERE p.src < p.dst")
def two_cycles(spark, d):
    return components.two_cycles(file_links(spark, d))


@query(f"""{WITH}, {_FILE_LINKS} SELECT 2::BIGINT AS length, a.src || ' > ' || a.dst AS path FROM fl a JOIN fl b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT 3, a.src || ' > ' || a.dst || ' > ' || b.dst FROM fl a JOIN fl b ON a.dst = b.src JOIN fl c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""")
def short_import_cycles(spark, d):
    return components.short_cycles(file_links(spark, d), 3)


@query()
def import_cycles(spark, d):
    """Simple import cycles of any length: all of a component, or the first 200 within 500,000 steps, marked as truncated."""
    links = file_links(spark, d)
    return components.simple_cycles(links, components.strongly_connected(links))


@query()
def import_cycle_cuts(spark, d):
    """Feedback arcs of every import component."""
    links = cut_table(file_links(spark, d))
    return components.component_cuts(links, components.strongly_connected(links))


_TIE_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in components.TIE_WEIGHTS.items()) + f" ELSE {components.DEFAULT_TIE} END"


@query(f"WITH {EDGES_CTE} SELECT least(source_qualified, target_qualified) AS a, greatest(source_qualified, target_qualified) AS b, max({_TIE_CASE}) AS w FROM e WHERE source_qualified <> target_qualified GROUP BY 1, 2")
def tie_weights(spark, d):
    return components.tie_weights(current_edges(spark, d))


@query()
def modularity_communities(spark, d):
    """Communities of high modularity over the ties between known nodes."""
    n, e = both(spark, d)
    known = n.select(F.col("qualified_name").alias("key"))
    return communities.modularity_communities(components.tie_weights(adjacency.edges_among(e, known)))


@query(f"""WITH {NODES_CTE}, m AS (SELECT qualified_name, string_split(file_path, '/') p FROM n WHERE kind <> 'File'),
g AS (SELECT k, qualified_name, array_to_string(p[1:least(k, len(p) - 1)], '/') c FROM m, range(1, 13) t(k)),
s AS (SELECT k, count(*) FILTER (c2 >= 2) ok FROM (SELECT k, c, count(*) c2 FROM g GROUP BY ALL) GROUP BY k), best AS (SELECT coalesce(min(k) FILTER (ok >= 10), 12) k FROM s)
SELECT qualified_name, c AS community FROM g WHERE k = (SELECT k FROM best)""")
def directory_communities(spark, d):
    return components.directory_communities(current_nodes(spark, d))


# --- search ------------------------------------------------------------------------------------


_TERMS = f"""list_concat(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1), flatten(list_transform(regexp_extract_all(coalesce(text, ''), '([{textindex.WIDE}]+)', 1),
  lambda r: CASE WHEN length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"""
_BM25 = f"""t AS (SELECT doc_id doc, unnest({_TERMS}) term FROM documents), p AS (SELECT term, doc, count(*) tf FROM t GROUP BY ALL),
l AS (SELECT doc, sum(tf) dl FROM p GROUP BY doc), tot AS (SELECT count(*) n_docs, sum(dl) sum_dl FROM l)"""


def document_index(spark, d) -> textindex.TextIndex:
    """The stored index of the texts of ``documents``; built if there is none of the present files."""
    root = f"{ensure_checkpoint_dir(spark)}/search/documents-{textindex.files_fingerprint(spark, f'{d}/documents.parquet')}"
    index = textindex.TextIndex(spark, root, "doc_id", {"text": 1}, "repo")
    if not index.segments():
        index.build(load(spark, d, "documents"))
    return index


def node_index(spark, d) -> textindex.TextIndex:
    """The stored index of the current nodes; built if there is none of the present files."""
    root = f"{ensure_checkpoint_dir(spark)}/search/nodes-{textindex.files_fingerprint(spark, f'{d}/nodes.parquet')}"
    index = textindex.TextIndex(spark, root, "id", search.FIELD_WEIGHTS, "file_path")
    if not index.segments():
        index.build(search.node_fields(current_nodes(spark, d)))
    return index


@query(f"""WITH {_BM25}, h AS (SELECT p.*, count(*) OVER (PARTITION BY term) df FROM p WHERE term IN ('planner', 'stale', 'queue')),
s AS (SELECT h.doc, sum(floor(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl * n_docs / sum_dl)) * 1000000 + 0.5)::BIGINT)::BIGINT score FROM h JOIN l ON h.doc = l.doc, tot GROUP BY h.doc)
SELECT doc AS doc_id, score FROM s ORDER BY score DESC, doc LIMIT 20""")
def bm25_topk(spark, d):
    return search.bm25(document_index(spark, d), search.plan_query("planner stale queue")[0], 20).withColumnRenamed("doc", "doc_id")


@query(f"""WITH {_BM25}, h AS (SELECT p.*, count(*) OVER (PARTITION BY term) df FROM p WHERE term IN ('索引', '引は')),
s AS (SELECT h.doc, count(*) n, sum(floor(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl * n_docs / sum_dl)) * 1000000 + 0.5)::BIGINT)::BIGINT score FROM h JOIN l ON h.doc = l.doc, tot GROUP BY h.doc)
SELECT doc AS doc_id, score FROM s WHERE n = 2 ORDER BY score DESC, doc LIMIT 20""")
def japanese_search(spark, d):
    """Texts with all pairs of characters of a Japanese phrase."""
    return search.bm25(document_index(spark, d), textindex.query_terms("索引は"), 20, require_all=True).withColumnRenamed("doc", "doc_id")


@query(f"WITH {_BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def term_statistics(spark, d):
    return document_index(spark, d).postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {NODES_CTE} SELECT id, qualified_name, CASE WHEN lower(name) = 'read' THEN 3 WHEN starts_with(lower(name), 'read') THEN 2 ELSE 1 END + CASE WHEN lower(name) = 'graph' THEN 3 WHEN starts_with(lower(name), 'graph') THEN 2 ELSE 1 END AS score FROM n WHERE contains(lower(name), 'read') AND contains(lower(name), 'graph') ORDER BY score DESC, id LIMIT 25")
def keyword_search(spark, d):
    return search.keyword_search(current_nodes(spark, d), "read graph", 25)


@query("""WITH q AS (SELECT embedding v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, q.v), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.v, lambda x: x::DOUBLE * x::DOUBLE))) c FROM embeddings, q)
SELECT vec_id, round(c * 100000)::BIGINT AS similarity FROM s ORDER BY c DESC, vec_id LIMIT 10""")
def cosine_topk(spark, d):
    rows = load(spark, d, "embeddings")
    first = rows.filter("vec_id = 0").select("embedding").first()
    top = search.cosine_top_k(rows, "vec_id", list(first[0]), 10, "embedding")
    return top.select("vec_id", F.round(F.col("similarity") * 100000).cast("long").alias("similarity"))


@query()
def hybrid_search(spark, d):
    """Text and vector arms over the nodes, fused and boosted."""
    n = current_nodes(spark, d)
    asked = "read graph"
    hits, _ = search.fts_search(node_index(spark, d), asked, 60)
    text_hits = search.ranked_hits(hits.withColumnRenamed("doc", "id"), "score", "id").select("id", "position")
    vectors = load(spark, d, "node_vectors").filter("provider = 'alder-mini#signature' AND vector IS NOT NULL AND size(vector) = 96").groupBy("qualified_name").agg(F.max("vector").alias("vector"))
    best = vectors.join(n.select(F.col("qualified_name").alias("_q"), "id"), F.col("qualified_name") == F.col("_q"))
    query_vector = best.agg(F.min_by("vector", "id")).first()[0]
    vector_hits = search.ranked_hits(search.cosine_top_k(best, "id", list(query_vector), 60), "similarity", "id").select("id", "position")
    return search.hybrid_search(n, text_hits, vector_hits, asked, 20)


@query(f"WITH {NODES_CTE} SELECT (SELECT count(DISTINCT id) FROM n) AS n_nodes, (SELECT count(DISTINCT id) FROM n) AS n_indexed, 0 AS n_missing, 0 AS n_orphaned, 'fresh' AS status")
def index_health(spark, d):
    """Whether the stored index holds exactly the current nodes."""
    return node_index(spark, d).health(current_nodes(spark, d))


_SYNCED = "file_path IN (SELECT file_path FROM n WHERE kind = 'File' AND language = 'python')"


@query(f"""WITH {NODES_CTE}, s AS (SELECT DISTINCT id, {_SYNCED} AS dropped FROM n)
SELECT count(*)::BIGINT AS n_nodes, count(*) FILTER (NOT coalesce(dropped, false))::BIGINT AS n_indexed, count(*) FILTER (coalesce(dropped, false))::BIGINT AS n_missing, 0 AS n_orphaned,
CASE WHEN count(*) FILTER (coalesce(dropped, false)) > 0 THEN 'stale' ELSE 'fresh' END AS status FROM s""")
def index_sync(spark, d):
    """Health of an index after the files of one language were synced away: their nodes are missing until they are synced again."""
    n = current_nodes(spark, d)
    root = f"{ensure_checkpoint_dir(spark)}/search/synced-{textindex.files_fingerprint(spark, f'{d}/nodes.parquet')}-{uuid.uuid4().hex}"
    index = textindex.TextIndex(spark, root, "id", search.FIELD_WEIGHTS, "file_path")
    docs = search.node_fields(n)
    index.build(docs)
    index.sync(docs.limit(0), n.filter("kind = 'File' AND language = 'python'").select(F.col("file_path").alias("key")))
    return index.health(n)
