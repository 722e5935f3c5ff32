"""Queries of single functions, lookups and receiver passes over the whole tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import paths, text
from .graph_queries import SEED_CALLEE, SEED_FILE, WITH, WITH_REC, both, keys
from .operators import adjacency, aggregates, lookup, presentation, search
from .plan_queries import EXTERNAL_SQL, family_sql
from .plans import passes, receivers
from .schema import NODES_CTE, current_edges, current_nodes
from .session import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
N = f"WITH {NODES_CTE}"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# --- lookups -----------------------------------------------------------------------------------


@query(f"{N} SELECT DISTINCT file_path FROM n WHERE ends_with(file_path, '/run.py')")
def files_by_ending(spark, d):
    return lookup.files_matching(current_nodes(spark, d), "/run.py")


@query(f"{N} SELECT qualified_name, kind, community_id FROM n WHERE community_id IN (1, 2, 3, 5, 8, 13)")
def members_of_communities(spark, d):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13)], "cid long")
    return current_nodes(spark, d).join(ids, F.col("community_id") == F.col("cid"), "left_semi").select("qualified_name", "kind", "community_id")


@query(f"{N}, w AS (SELECT parent_name p, name m FROM n WHERE kind = 'Function' AND coalesce(parent_name, '') <> '' GROUP BY 1, 2 HAVING count(*) > 0 ORDER BY 1, 2 LIMIT 1) SELECT qualified_name FROM n, w WHERE parent_name = p AND name = m AND kind = 'Function'")
def members_by_parent(spark, d):
    n = current_nodes(spark, d)
    first = n.filter("kind = 'Function' AND coalesce(parent_name, '') <> ''").orderBy("parent_name", "name").select("parent_name", "name").first()
    return (lookup.members(n, first[0], first[1], ["Function"]) if first else n.limit(0)).select("qualified_name")


@query(f"{WITH}, k AS (SELECT DISTINCT name FROM n WHERE kind = 'Class') SELECT id, target_qualified, target_qualified <> target_name AS qualified FROM e WHERE kind = 'INHERITS' AND target_name IN (SELECT name FROM k)")
def inherited_names(spark, d):
    n, e = both(spark, d)
    named = n.filter("kind = 'Class'").select(F.col("name").alias("key")).distinct()
    return adjacency.edges_by_target_name(e, named, "INHERITS").select("id", "target_qualified", (F.col("target_qualified") != F.col("target_name")).alias("qualified"))


@query(f"{WITH} SELECT coalesce(json_extract_string(extra, '$.import_kind'), json_extract_string(extra, '$.import_scope'), 'module') AS import_kind, count(*) AS n FROM e WHERE kind = 'IMPORTS_FROM' GROUP BY 1")
def import_kinds(spark, d):
    e = current_edges(spark, d).filter("kind = 'IMPORTS_FROM'")
    return e.groupBy(lookup.import_kind().alias("import_kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}, s AS (SELECT qualified_name q FROM n WHERE file_path = '{SEED_FILE}') SELECT 'node' AS part, q AS a, NULL AS b FROM s UNION ALL SELECT 'edge', source_qualified, target_qualified FROM e WHERE source_qualified IN (SELECT q FROM s) AND target_qualified IN (SELECT q FROM s)")
def file_subgraph(spark, d):
    n, e = both(spark, d)
    inner, links = adjacency.subgraph(n, e, n.filter(F.col("file_path") == SEED_FILE).select(F.col("qualified_name").alias("key")))
    return inner.select(F.lit("node").alias("part"), F.col("qualified_name").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(links.select(F.lit("edge").alias("part"), F.col("source_qualified").alias("a"), F.col("target_qualified").alias("b")))


@query(f"{N} SELECT qualified_name FROM n WHERE qualified_name = '{SEED_CALLEE}'")
def resolved_target(spark, d):
    return lookup.resolve_target(current_nodes(spark, d), SEED_CALLEE).select("qualified_name")


@query(f"{WITH}, c AS (SELECT s.community_id sc, t.community_id tc FROM e JOIN n s ON e.source_qualified = s.qualified_name JOIN n t ON e.target_qualified = t.qualified_name) SELECT count(*)::BIGINT AS n_edges, count(*) FILTER (sc = tc)::BIGINT AS inside, count(*) FILTER (sc IS NULL OR tc IS NULL)::BIGINT AS open FROM c")
def community_edge_totals(spark, d):
    told = adjacency.edges_with_communities(*both(spark, d))
    same = F.col("source_community") == F.col("target_community")
    return told.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(same).alias("inside"), F.count_if(F.col("source_community").isNull() | F.col("target_community").isNull()).alias("open"))


@query(f"{N} SELECT count(*) AS n_members, count(DISTINCT community_id) AS n_communities FROM n WHERE community_id IN (SELECT community_id FROM n WHERE file_path = '{SEED_FILE}')")
def affected_communities(spark, d):
    n = current_nodes(spark, d)
    touched = n.filter(F.col("file_path") == SEED_FILE).select(F.col("community_id").alias("cid")).distinct()
    return n.join(touched, F.col("community_id") == F.col("cid"), "left_semi").agg(F.count(F.lit(1)).alias("n_members"), F.count_distinct("community_id").alias("n_communities"))


# --- names and paths ---------------------------------------------------------------------------


@query(rf"""{N} SELECT qualified_name, substr(regexp_replace(name, '[\x00-\x08\x0b-\x1f]', '', 'g'), 1, 256) AS clean,
 CASE WHEN kind = 'File' THEN file_path WHEN coalesce(parent_name, '') <> '' THEN file_path || '::' || parent_name || '.' || name ELSE file_path || '::' || name END AS built,
 array_to_string(list_filter(string_split(regexp_replace(qualified_name, '\\|::|/', '.', 'g'), '.'), lambda p: p <> ''), '.') AS namespace FROM n""")
def built_names(spark, d):
    n = current_nodes(spark, d)
    c = F.col
    return n.select("qualified_name", text.sanitize_name(c("name")).alias("clean"), text.qualified_name(c("kind"), c("name"), c("file_path"), c("parent_name")).alias("built"), text.normal_namespace(c("qualified_name")).alias("namespace"))


@query(f"""{WITH} SELECT id, NOT contains(target_qualified, '::') AND NOT starts_with(target_qualified, '<') AND (contains(target_qualified, '/') OR lower(regexp_extract(target_qualified, '[^/.][^/]*\\.([^./]+)$', 1)) IN ({", ".join(f"'{x}'" for x in sorted(paths.LANGUAGE_OF_SUFFIX))})) AS path_like,
 len(list_filter(string_split(file_path, '/'), lambda p: p <> '' AND p <> '.'))::BIGINT AS n_parts FROM e""")
def path_like_targets(spark, d):
    e = current_edges(spark, d)
    return e.select("id", paths.looks_like_file(F.col("target_qualified")).alias("path_like"), F.size(paths.parts_of(F.col("file_path"))).cast("long").alias("n_parts"))


@query(f"{WITH}, x AS (SELECT e.id, {family_sql('e.file_path')} a, {family_sql('t.file_path')} b FROM e JOIN n t ON e.target_qualified = t.qualified_name) SELECT id, a IS NULL OR b IS NULL OR a = b AS same_family FROM x")
def edge_families(spark, d):
    n, e = both(spark, d)
    home = n.select(F.col("qualified_name").alias("_q"), F.col("file_path").alias("_f"))
    joined = e.join(home, F.col("target_qualified") == F.col("_q"))
    return joined.select("id", paths.same_family(paths.family_of(F.col("file_path")), paths.family_of(F.col("_f"))).alias("same_family"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '([A-Za-z0-9_]+)', 1))::BIGINT AS n_words, regexp_matches(lower(text), '(^|[^a-z0-9])graph([^a-z0-9]|$)') AS says_graph,
 len(list_distinct(list_filter(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]+)', 1), lambda w: (contains(w, '_') OR regexp_matches(w, '^.+[A-Z]')) AND lower(w) NOT IN (""" + ", ".join(f"'{w}'" for w in text.SEARCH_STOPWORDS) + r"""))))::BIGINT AS n_identifiers FROM documents WHERE text IS NOT NULL""")
def document_words(spark, d):
    docs = load(spark, d, "documents").filter("text IS NOT NULL")
    t = F.col("text")
    return docs.select("doc_id", F.size(text.query_words(t)).cast("long").alias("n_words"), text.contains_word(F.lower(t), F.lit("graph")).alias("says_graph"), F.size(text.identifiers_of(t)).cast("long").alias("n_identifiers"))


@query(rf"""{N}, p AS (SELECT qualified_name, regexp_replace(trim(coalesce(params, '')), '^\((.*)\)$', '\1') inner_ FROM n WHERE kind = 'Function'),
b AS (SELECT qualified_name, list_transform(string_split(inner_, ','), lambda x: trim(regexp_replace(string_split(string_split(trim(x), '=')[1], ':')[1], '&|mut ', '', 'g'))) l FROM p)
SELECT qualified_name, array_to_string(list_filter(list_transform(list_filter(l, lambda x: x NOT IN ('self', 'cls')), lambda x: string_split(x, ' ')[-1]), lambda x: x <> ''), ',') AS names FROM b""")
def parameter_names(spark, d):
    n = current_nodes(spark, d).filter("kind = 'Function'")
    return n.select("qualified_name", F.array_join(text.parameter_list(F.col("params")), ",").alias("names"))


@query(r"""SELECT file_path, length(trim(regexp_replace(regexp_replace(regexp_replace(content, '(?s)/\*.*?\*/', ' ', 'g'), '(?m)//.*$', ' ', 'g'), '\s+', ' ', 'g')))::BIGINT AS n_code FROM source_files WHERE content IS NOT NULL AND NOT contains(content, '#')""")
def bare_code(spark, d):
    """Length of code without comments and layout, of files without hash comments."""
    s = load(spark, d, "source_files").filter("content IS NOT NULL AND NOT contains(content, '#')")
    return s.select("file_path", F.length(text.normal_code(F.col("content"))).cast("long").alias("n_code"))


@query(f"""{N}, w AS (SELECT id, list_filter(string_split_regex(lower(qualified_name), '[./:]'), lambda p: p <> '') parts, lower(qualified_name) low FROM n)
SELECT id FROM w WHERE contains(low, 'base.clock') OR (list_position(parts, 'base') > 0 AND list_position(parts[list_position(parts, 'base') + 1:], 'clock') > 0)""")
def names_with_parts(spark, d):
    """Names in which ``base`` and later ``clock`` stand as parts."""
    return current_nodes(spark, d).filter(search.qualified_name_matches("base.clock")).select("id")


# --- rows as a reader sees them ----------------------------------------------------------------


_SPAN = "list_slice(string_split(replace(content, chr(13), ''), chr(10)), greatest(line_start, 1), line_end)"


@query(f"""{N}, x AS (SELECT qualified_name, {_SPAN} l FROM n JOIN source_files s ON n.file_path = s.file_path WHERE content IS NOT NULL AND line_start IS NOT NULL AND line_end IS NOT NULL)
SELECT qualified_name, md5(substr(array_to_string(l, chr(10)), 1, 4000)) AS excerpt_hash, len(l)::BIGINT AS n_lines, length(array_to_string(l, chr(10))) > 4000 AS truncated FROM x""")
def node_excerpts(spark, d):
    found = presentation.excerpts(current_nodes(spark, d), load(spark, d, "source_files"))
    return found.select("qualified_name", F.md5("excerpt").alias("excerpt_hash"), "n_lines", "truncated")


@query("""SELECT file_path, (len(string_split(replace(content, chr(13), ''), chr(10))) - CASE WHEN ends_with(replace(content, chr(13), ''), chr(10)) THEN 1 ELSE 0 END)::BIGINT AS line_end FROM source_files WHERE content IS NOT NULL""")
def real_line_ends(spark, d):
    return presentation.line_counts(load(spark, d, "source_files"))


@query(f"""{N} SELECT qualified_name, array_to_string(list_filter([CASE WHEN coalesce(kind, '') <> '' THEN 'kind: ' || kind END, CASE WHEN coalesce(name, '') <> '' THEN 'name: ' || name END, CASE WHEN coalesce(file_path, '') <> '' THEN 'file: ' || file_path END,
 CASE WHEN coalesce(parent_name, '') <> '' THEN 'parent: ' || parent_name END, CASE WHEN coalesce(language, '') <> '' THEN 'language: ' || language END, CASE WHEN coalesce(return_type, '') <> '' THEN 'returns: ' || return_type END], lambda x: x IS NOT NULL), chr(10)) AS text FROM n WHERE kind <> 'File'""")
def structured_texts(spark, d):
    return presentation.structured_text(current_nodes(spark, d))


@query(f"""{WITH}, c AS (SELECT source_qualified s, count(DISTINCT target_qualified) k, min(string_split(string_split(target_qualified, '::')[-1], '.')[-1]) f FROM e WHERE kind = 'CALLS' GROUP BY 1)
SELECT qualified_name, CASE WHEN k IS NULL THEN NULL ELSE 'It calls ' || k || ' symbols, first ' || f || '.' END AS calls FROM n LEFT JOIN c ON qualified_name = s WHERE kind = 'Function'""")
def narrative_texts(spark, d):
    """The last sentence of every function's description."""
    told = presentation.narrative_text(*both(spark, d))
    calls = F.regexp_extract("text", r"(It calls \d+ symbols, first .*\.)$", 1)
    return told.select("qualified_name", F.nullif(calls, F.lit("")).alias("calls"))


@query("""WITH v AS (SELECT *, sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE))) norm FROM node_vectors WHERE vector IS NOT NULL)
SELECT provider, count(*) AS n, count(*) FILTER (norm > 0 AND NOT isnan(norm) AND NOT isinf(norm)) AS n_unit FROM v GROUP BY provider""")
def unit_vectors(spark, d):
    v = load(spark, d, "node_vectors").filter("vector IS NOT NULL").select("provider", presentation.unit_vector().alias("u"))
    length = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return v.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(length - 1) < 1e-9).alias("n_unit"))


@query("SELECT provider, count(*) AS n FROM node_vectors GROUP BY provider ORDER BY n DESC, provider")
def provider_sizes(spark, d):
    return presentation.provider_partitions(load(spark, d, "node_vectors"))


@query(f"""{N}, live AS (SELECT qualified_name q FROM n WHERE kind <> 'File'), v AS (SELECT DISTINCT provider, qualified_name FROM node_vectors WHERE vector IS NOT NULL),
c AS (SELECT provider, count(live.q) k FROM v LEFT JOIN live ON v.qualified_name = live.q GROUP BY provider), t AS (SELECT count(*) n FROM live)
SELECT provider, CASE WHEN n - k <= 0 THEN 'skip' WHEN n - k >= 0.5 * n THEN 'inline' ELSE 'queue' END AS action FROM c, t""")
def vector_refresh(spark, d):
    return presentation.refresh_action(aggregates.embedding_coverage(current_nodes(spark, d), load(spark, d, "node_vectors")))


@query(f"{N} SELECT community_id, qualified_name, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(is_test, false), qualified_name) - 1 AS position FROM n WHERE community_id IS NOT NULL")
def production_first(spark, d):
    n = current_nodes(spark, d).filter("community_id IS NOT NULL")
    return presentation.tests_last(n, [F.col("qualified_name")], ["community_id"]).select("community_id", "qualified_name", "position")


@query(r"""WITH l AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) l FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, len(l) n, i AS at, length(regexp_extract(l[i], '^(#{1,6})(\s|$)', 1)) AS level, l[i] AS line FROM l, unnest(range(1, len(l) + 1)) r(i) WHERE regexp_matches(l[i], '^(#{1,6})(\s|$)'))
SELECT h.doc_id, h.at, h.level, regexp_replace(regexp_replace(lower(trim(substr(h.line, h.level + 1))), '[^\p{L}\p{N}\s_-]', '', 'g'), '\s', '-', 'g') AS slug,
 coalesce((SELECT min(o.at) FROM h o WHERE o.doc_id = h.doc_id AND o.at > h.at AND o.level <= h.level), h.n + 1) - h.at AS n_lines FROM h""")
def document_outline(spark, d):
    return presentation.sections(load(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text").select("doc_id", F.col("at").cast("long").alias("at"), "level", "slug", "n_lines")


@query(f"""{N}, c AS (SELECT qualified_name FROM n WHERE kind = 'Class'),
m AS (SELECT qualified_name AS member, file_path || '::' || parent_name AS caller FROM n WHERE coalesce(parent_name, '') <> '' AND (regexp_matches(name, '^__.+__$') OR name = 'model_post_init'))
SELECT * FROM m WHERE caller IN (SELECT * FROM c) UNION ALL SELECT qualified_name, file_path FROM n WHERE coalesce(parent_name, '') = '' AND name IN ('__getattr__', '__dir__') AND ends_with(file_path, '.py')""")
def implicit_callers(spark, d):
    return presentation.implicit_callers(current_nodes(spark, d))


@query(f"{WITH} SELECT json_extract_string(extra, '$.receiver') AS receiver, count(*) AS n FROM e WHERE kind = 'CALLS' AND json_extract_string(extra, '$.receiver') IS NOT NULL GROUP BY 1")
def receivers_named(spark, d):
    e = current_edges(spark, d).filter("kind = 'CALLS'").select(receivers.note("receiver").alias("receiver")).filter("receiver IS NOT NULL")
    return e.groupBy("receiver").agg(F.count(F.lit(1)).alias("n"))


# --- receivers: calls of members, opened again and settled by their receiver -------------------

MEMBERS_SQL = f"m AS (SELECT parent_name owner, name member, {family_sql('file_path')} family, file_path home, qualified_name symbol FROM n WHERE kind IN ('Function', 'Test') AND coalesce(parent_name, '') <> '')"
SIGHT_SQL = "sight AS (SELECT DISTINCT e.file_path f, t.file_path v FROM e JOIN n t ON e.target_qualified = t.qualified_name WHERE e.kind = 'IMPORTS_FROM' AND e.file_path <> t.file_path)"


def opened(nodes, edges, receiver):
    """Calls of members as an extractor that does not know their targets gives them."""
    home = nodes.filter("kind IN ('Function', 'Test') AND coalesce(parent_name, '') <> ''").select(F.col("qualified_name").alias("_q"), F.col("name").alias("_n"), F.col("parent_name").alias("_p"))
    known = edges.filter("kind = 'CALLS'").join(home, F.col("target_qualified") == F.col("_q"))
    calls = known.select(*[F.col("_n").alias(c) if c == "target_qualified" else receiver.alias(c) if c == "extra" else F.col(c) for c in edges.columns])
    return calls.unionByName(edges.filter("kind IN ('IMPORTS_FROM', 'INHERITS')"))


@query(f"""{WITH}, {MEMBERS_SQL}, {SIGHT_SQL},
q AS (SELECT e.id, e.file_path efile, t.parent_name owner, t.name member, {family_sql('e.file_path')} fam FROM e JOIN n t ON e.target_qualified = t.qualified_name WHERE e.kind = 'CALLS' AND t.kind IN ('Function', 'Test') AND coalesce(t.parent_name, '') <> ''),
a AS (SELECT q.id, m.symbol, (m.home = q.efile OR EXISTS (SELECT 1 FROM sight WHERE f = q.efile AND v = m.home)) near FROM q JOIN m ON q.owner = m.owner AND q.member = m.member AND q.fam IS NOT DISTINCT FROM m.family),
s AS (SELECT id, count(*) FILTER (near) nn, min(symbol) FILTER (near) fn, count(*) k, min(symbol) fa FROM a GROUP BY id)
SELECT id, CASE WHEN nn = 1 THEN fn ELSE fa END AS target_qualified, CASE WHEN nn = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence_tier FROM s WHERE nn = 1 OR (nn = 0 AND k = 1)""")
def typed_receiver_calls(spark, d):
    """Calls of members settled by the type of their receiver."""
    n, e = both(spark, d)
    again = opened(n, e, F.to_json(F.struct(F.col("_p").alias("receiver_type"))))
    return receivers.typed_receivers(n, again).filter("kind = 'CALLS' AND contains(target_qualified, '::')").select("id", "target_qualified", "confidence_tier")


@query(f"""{WITH_REC}, {MEMBERS_SQL}, held AS (SELECT DISTINCT home || '::' || owner k, member, symbol FROM m),
q AS (SELECT e.id, s.file_path || '::' || s.parent_name klass, t.name member FROM e JOIN n t ON e.target_qualified = t.qualified_name JOIN n s ON e.source_qualified = s.qualified_name
  WHERE e.kind = 'CALLS' AND t.kind IN ('Function', 'Test') AND coalesce(t.parent_name, '') <> '' AND coalesce(s.parent_name, '') <> ''),
b AS (SELECT DISTINCT source_qualified c, target_qualified up FROM e WHERE kind = 'INHERITS' AND contains(target_qualified, '::')),
r AS (SELECT DISTINCT klass, klass AS spot, 0 AS depth FROM q UNION SELECT r.klass, b.up, r.depth + 1 FROM r JOIN b ON r.spot = b.c WHERE r.depth < 25),
near AS (SELECT klass, spot, min(depth) depth FROM r GROUP BY ALL),
h AS (SELECT DISTINCT q.klass, q.member, near.depth, held.symbol FROM q JOIN near ON q.klass = near.klass JOIN held ON near.spot = held.k AND q.member = held.member),
s AS (SELECT klass, member, count(*) k, min(symbol) symbol FROM h JOIN (SELECT klass, member, min(depth) depth FROM h GROUP BY ALL) USING (klass, member, depth) GROUP BY klass, member)
SELECT q.id, s.symbol AS target_qualified FROM q JOIN s ON q.klass = s.klass AND q.member = s.member WHERE k = 1""")
def own_receiver_calls(spark, d):
    """Calls of members on ``self`` settled by the caller's class and the classes above it."""
    n, e = both(spark, d)
    again = opened(n, e, F.to_json(F.struct(F.lit("self").alias("receiver"))))
    return receivers.own_receivers(n, again).filter("kind = 'CALLS' AND contains(target_qualified, '::')").select("id", "target_qualified")


_LEAF = "string_split(string_split(target_qualified, '::')[-1], '.')[-1]"


@query(f"""{WITH}, x AS (SELECT {_LEAF} m, json_extract_string(extra, '$.external_package') p FROM e WHERE kind = 'CALLS' AND {EXTERNAL_SQL}), c AS (SELECT m, p, count(*) k FROM x WHERE p IS NOT NULL GROUP BY ALL),
o AS (SELECT m, p FROM (SELECT *, sum(k) OVER (PARTITION BY m) t FROM c) WHERE t >= 2 AND k * 100 >= t * 90),
a AS (SELECT id, regexp_replace(target_qualified, '^<unresolved:(.*)>$', '\\1') w FROM e WHERE kind = 'CALLS' AND NOT coalesce({EXTERNAL_SQL}, false) AND (starts_with(target_qualified, '<unresolved:') OR (NOT contains(target_qualified, '::') AND NOT contains(target_qualified, '/') AND NOT starts_with(target_qualified, '<') AND target_qualified <> '')))
SELECT a.id, o.p AS target_qualified, 'MEDIUM' AS confidence_tier FROM a JOIN o ON a.w = o.m WHERE a.w NOT IN (SELECT name FROM n WHERE kind IN ('Function', 'Class') AND name IS NOT NULL)""")
def observed_external_calls(spark, d):
    """Bare calls that become external because their name belongs to one package where it is known."""
    n, e = both(spark, d)
    after = receivers.observed_calls(n, e)
    was = e.filter(passes.is_external()).select(F.col("id").alias("_id"))
    return after.filter((F.col("kind") == "CALLS") & passes.is_external()).join(was, F.col("id") == F.col("_id"), "left_anti").select("id", "target_qualified", "confidence_tier")
