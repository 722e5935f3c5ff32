"""Queries of resolution passes, architecture, review and refactoring, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import paths, text
from .graph_queries import REPORTABLE_SQL, SEED_CALLEE, TEST_PATH_SQL, WITH, WITH_REC, both, file_links, keys
from .operators import components, traversal
from .plans import architecture, changes, passes, refactoring
from .schema import TIER_SQL, latest
from .session import cut_table, load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BARE_SQL = "(NOT contains({0}, '::') AND NOT contains({0}, '/') AND NOT starts_with({0}, '<') AND {0} <> '')"
EXTERNAL_SQL = "coalesce(json_extract_string(extra, '$.external') = 'true', false)"
def family_sql(column: str) -> str:
    suffix = rf"lower(regexp_extract({column}, '[^/.][^/]*\.([^./]+)$', 1))"
    return f"CASE {suffix} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.FAMILY_OF_SUFFIX.items()) + " END"


def scope_sql(column: str) -> str:
    return f"CASE WHEN contains({column}, '/') THEN array_to_string(string_split({column}, '/')[1:least(2, len(string_split({column}, '/')) - 1)], '/') ELSE '<root>' END"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# --- passes ------------------------------------------------------------------------------------


MASKED_SQL = "(SELECT * REPLACE (CASE WHEN contains(target_qualified, '::') THEN string_split(target_qualified, '::')[-1] ELSE target_qualified END AS target_qualified) FROM e)"


def masked(edges):
    """Edges as an extractor leaves them: only the last segment of a scoped target is known."""
    return edges.withColumn("target_qualified", F.element_at(F.split("target_qualified", "::"), -1))


def bind_sql(edge_kinds: str, kinds: str) -> str:
    return f"""{WITH}, em AS {MASKED_SQL}, ix AS (SELECT name, qualified_name q, file_path f, {family_sql('file_path')} fam FROM n WHERE kind IN ({kinds})),
fl AS (SELECT name, f, count(*) c, min(q) q FROM ix GROUP BY ALL),
a AS (SELECT DISTINCT file_path ef, target_qualified w, {family_sql('file_path')} fam FROM em WHERE kind IN ({edge_kinds}) AND {BARE_SQL.format('target_qualified')} AND NOT {EXTERNAL_SQL}),
vis AS (SELECT DISTINCT e.file_path f, n.file_path v FROM e JOIN n ON e.target_qualified = n.qualified_name WHERE e.kind = 'IMPORTS_FROM' AND e.file_path <> n.file_path),
o AS (SELECT a.ef, a.w, fl.q FROM a JOIN fl ON a.w = fl.name AND a.ef = fl.f AND fl.c = 1),
i AS (SELECT a.ef, a.w, min(fl.q) q FROM a JOIN vis ON a.ef = vis.f JOIN fl ON fl.name = a.w AND fl.f = vis.v GROUP BY a.ef, a.w HAVING sum(fl.c) = 1),
u AS (SELECT name, fam, min(q) q FROM ix GROUP BY name, fam HAVING count(*) = 1),
b AS (SELECT a.ef, a.w, coalesce(o.q, i.q, u.q) q, coalesce(o.q, i.q) IS NOT NULL near FROM a LEFT JOIN o ON o.ef = a.ef AND o.w = a.w LEFT JOIN i ON i.ef = a.ef AND i.w = a.w LEFT JOIN u ON u.name = a.w AND u.fam = a.fam)
SELECT e.id, b.q AS target_qualified, CASE WHEN near THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, CASE WHEN near THEN 'HIGH' ELSE 'MEDIUM' END AS confidence_tier
FROM em e JOIN b ON e.file_path = b.ef AND e.target_qualified = b.w WHERE e.kind IN ({edge_kinds}) AND NOT {EXTERNAL_SQL} AND b.q IS NOT NULL"""


def _bound(spark, d, step, kinds):
    n, e = both(spark, d)
    e = masked(e)
    was = e.select(F.col("id").alias("_id"), F.col("target_qualified").alias("_was"))
    after = step(n, e).filter(F.col("kind").isin(kinds)).join(was, F.col("id") == F.col("_id")).filter("target_qualified <> _was")
    return after.select("id", "target_qualified", "confidence", "confidence_tier")


@query(bind_sql("'CALLS'", "'Function', 'Class', 'Test'"))
def bound_calls(spark, d):
    return _bound(spark, d, passes.bare_calls, ["CALLS"])


@query(bind_sql("'INHERITS', 'IMPLEMENTS'", "'Class', 'Type'"))
def bound_inheritance(spark, d):
    return _bound(spark, d, passes.bare_inheritance, ["INHERITS", "IMPLEMENTS"])


@query(f"""{WITH}, k AS (SELECT qualified_name FROM n), x AS (SELECT id, confidence, confidence_tier, source_qualified NOT IN (SELECT * FROM k) OR target_qualified NOT IN (SELECT * FROM k) lost FROM e)
SELECT id, CASE WHEN lost THEN least(coalesce(confidence, 1.0), 0.2) ELSE confidence END AS confidence, CASE WHEN lost THEN 'LOW' ELSE {TIER_SQL} END AS confidence_tier FROM x""")
def demoted_edges(spark, d):
    return passes.demote_unresolved(*both(spark, d)).select("id", "confidence", "confidence_tier")


@query(f"""{WITH}, c AS (SELECT e.target_qualified s, e.source_qualified t, e.file_path, min(e.line) line FROM e JOIN n a ON e.source_qualified = a.qualified_name AND a.kind = 'Test' JOIN n b ON e.target_qualified = b.qualified_name AND b.kind IN ('Function', 'Class') AND NOT coalesce(b.is_test, false) WHERE e.kind = 'CALLS' GROUP BY ALL)
SELECT s AS source_qualified, t AS target_qualified, file_path, line FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.kind = 'TESTED_BY' AND e.source_qualified = c.s AND e.target_qualified = c.t)""")
def tested_by_from_calls(spark, d):
    return passes.tested_by_from_calls(*both(spark, d))


@query(f"{WITH} SELECT id FROM e WHERE kind <> 'TESTED_BY' OR source_qualified IN (SELECT qualified_name FROM n)")
def edges_without_orphan_tests(spark, d):
    return passes.drop_orphan_tests(*both(spark, d)).select("id")


@query(f"""{WITH}, x AS (SELECT string_split(string_split(target_qualified, '::')[-1], '.')[-1] m, json_extract_string(extra, '$.external_package') p FROM e WHERE kind = 'CALLS' AND {EXTERNAL_SQL}),
c AS (SELECT m, p, count(*) n FROM x WHERE p IS NOT NULL GROUP BY ALL) SELECT m AS method, p AS package, n, t AS total FROM (SELECT *, (sum(n) OVER (PARTITION BY m))::BIGINT t FROM c) WHERE t >= 2 AND n * 100 >= t * 90""")
def observed_packages(spark, d):
    return passes.observed_packages(both(spark, d)[1])


@query(f"""{WITH}, o AS (SELECT DISTINCT name FROM n WHERE kind IN ('Function', 'Class')) SELECT id, target_qualified FROM e WHERE kind = 'CALLS' AND target_qualified IN ({", ".join(f"'{k}'" for k in passes.stdlib_methods())}) AND NOT {EXTERNAL_SQL} AND target_qualified NOT IN (SELECT name FROM o WHERE name IS NOT NULL)""")
def stdlib_calls(spark, d):
    marked = passes.mark_stdlib_calls(*both(spark, d))
    return marked.filter(F.get_json_object("extra", "$.stdlib") == "true").select("id", "target_qualified")


def _hops_sql(hops: int) -> str:
    """The steps of a name through imports, one pair of tables a hop: where it is looked for, and where it is found."""
    parts = ["h1 AS (SELECT DISTINCT t, v a, string_split(t, '::')[-1] leaf FROM o JOIN vis ON string_split(t, '::')[1] = vis.f)"]
    for i in range(1, hops + 1):
        if i > 1:
            parts.append(f"h{i} AS (SELECT DISTINCT t, v a, leaf FROM h{i - 1} JOIN vis ON h{i - 1}.a = vis.f WHERE t NOT IN (SELECT t FROM r{i - 1}))")
        parts.append(f"r{i} AS (SELECT t, count(DISTINCT q) c, min(q) q FROM (SELECT t, a || '::' || leaf q FROM h{i}) WHERE q IN (SELECT * FROM k) GROUP BY t)")
    return ", ".join(parts)


@query(f"""{WITH}, k AS (SELECT qualified_name FROM n), vis AS (SELECT DISTINCT e.file_path f, n.file_path v FROM e JOIN n ON e.target_qualified = n.qualified_name WHERE e.kind = 'IMPORTS_FROM' AND e.file_path <> n.file_path),
o AS (SELECT DISTINCT target_qualified t FROM e WHERE contains(target_qualified, '::') AND target_qualified NOT IN (SELECT * FROM k)), {_hops_sql(8)}
SELECT e.id, r.q AS target_qualified FROM e JOIN ({" UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(1, 9))}) r ON e.target_qualified = r.t WHERE r.c = 1""")
def reexported_targets(spark, d):
    n, e = both(spark, d)
    n, e = cut_table(n.select("qualified_name", "file_path")), cut_table(e.select("id", "kind", "target_qualified", "file_path"))
    found = passes.reexport_targets(n, e)
    return e.join(found, F.col("target_qualified") == F.col("original")).select("id", F.col("found").alias("target_qualified"))


@query(f"""{WITH_REC}, v AS (SELECT DISTINCT e.file_path f, n.file_path v FROM e JOIN n ON e.target_qualified = n.qualified_name WHERE e.kind = 'IMPORTS_FROM' AND e.file_path <> n.file_path),
w AS (SELECT f, v, 0 dep FROM v UNION SELECT w.f, v.v, dep + 1 FROM w JOIN v ON w.v = v.f WHERE dep < 2 AND w.f <> v.v) SELECT DISTINCT f AS file, v AS visible FROM w""")
def import_visibility(spark, d):
    n, e = both(spark, d)
    return passes.visible_files(e, n, 2)


@query()
def pass_counters(spark, d):
    """Changed edges of every pass, in order."""
    n, e = both(spark, d)
    n, e = n.select("kind", "name", "qualified_name", "file_path", "parent_name", "return_type", "is_test", "extra"), e.drop("line", "target_name", "updated_at")
    _, changed, warnings = passes.run_passes(n, e)
    rows = [(i, k, v) for i, (k, v) in enumerate(changed.items())] + [(99, f"warning {w}", 1) for w in warnings]
    return spark.createDataFrame(rows, "position long, step string, changed long")


@query(f"""{WITH}, x AS (SELECT name, min({family_sql('file_path')}) fam, count(DISTINCT qualified_name) c, min(qualified_name) q FROM n WHERE json_extract_string(extra, '$.ffi_export') = 'true' GROUP BY name)
SELECT e.source_qualified, x.q AS target_qualified, e.file_path, e.line FROM {MASKED_SQL} e JOIN x ON e.target_qualified = x.name WHERE e.kind = 'CALLS' AND {BARE_SQL.format('e.target_qualified')} AND x.c = 1 AND {family_sql('e.file_path')} IS DISTINCT FROM x.fam""")
def native_bindings(spark, d):
    n, e = both(spark, d)
    return passes.native_bindings(n, masked(e)).select("source_qualified", "target_qualified", "file_path", "line")


# --- architecture ------------------------------------------------------------------------------


_DEPS = f"""dep AS (SELECT {scope_sql('e.file_path')} source, {scope_sql('n.file_path')} target, count(*) n_sites FROM e JOIN n ON e.target_qualified = n.qualified_name WHERE e.kind IN ('IMPORTS_FROM','DEPENDS_ON','INHERITS','IMPLEMENTS') AND {scope_sql('e.file_path')} <> {scope_sql('n.file_path')} GROUP BY 1, 2),
st AS (SELECT scope, sum(ca)::BIGINT ca, sum(ce)::BIGINT ce, sum(ce) / (sum(ca) + sum(ce)) instability FROM (SELECT source scope, 0 ca, 1 ce FROM dep UNION ALL SELECT target, 1, 0 FROM dep) GROUP BY scope)"""


@query(f"{WITH}, {_DEPS} SELECT source, target, n_sites FROM dep")
def scope_dependencies(spark, d):
    return architecture.scope_dependencies(*both(spark, d))


@query(f"{WITH}, {_DEPS} SELECT scope, ca, ce, instability FROM st")
def stability_metrics(spark, d):
    return architecture.stability(architecture.scope_dependencies(*both(spark, d)))


@query(f"{WITH}, {_DEPS} SELECT dep.source, dep.target, dep.n_sites, a.instability AS source_instability, b.instability AS target_instability FROM dep JOIN st a ON dep.source = a.scope JOIN st b ON dep.target = b.scope WHERE b.instability - a.instability > 0.1::DOUBLE")
def stability_violations(spark, d):
    return architecture.stability_violations(architecture.scope_dependencies(*both(spark, d)))


_DIST = f"""ab AS (SELECT {scope_sql('file_path')} scope, count(*) FILTER (json_extract_string(extra, '$.is_abstract') = 'true' OR json_extract_string(extra, '$.is_contract') = 'true') na, count(*) nt FROM n WHERE kind IN ('Class', 'Type') AND coalesce(parent_name, '') = '' GROUP BY 1),
dst AS (SELECT ab.scope, na, nt, ca, ce, instability, floor(abs(na / nt + instability - 1) * 1000000 + 0.5)::BIGINT distance_ppm FROM ab JOIN st ON ab.scope = st.scope)"""


@query(f"{WITH}, {_DEPS}, {_DIST} SELECT * FROM dst")
def main_sequence_distance(spark, d):
    n, e = both(spark, d)
    return architecture.distances(n, architecture.scope_dependencies(n, e))


@query(f"""{WITH}, {_DEPS}, {_DIST} SELECT st.scope, st.instability <= 0.35::DOUBLE AS stable, st.ca >= 3 OR (st.ca >= 2 AND st.ca > st.ce) OR (coalesce(distance_ppm >= 500000, false) AND st.instability <= 0.35::DOUBLE) AS should_be_stable,
st.instability <= 0.35::DOUBLE AND coalesce(distance_ppm >= 500000, false) AS stable_concrete FROM st LEFT JOIN dst ON st.scope = dst.scope""")
def stability_profiles(spark, d):
    n, e = both(spark, d)
    return architecture.profiles(n, architecture.scope_dependencies(n, e))


_PROD = (
    "(NOT " + TEST_PATH_SQL.replace("{0}", "{0}.file_path") + " AND NOT regexp_matches({0}.file_path, '(^|/)(" + "|".join(paths.NON_PRODUCTION_PARTS) + ")(/|$)') AND string_split({0}.file_path, '/')[-1] NOT IN ('build.rs', 'setup.py', 'conftest.py')"
    " AND NOT contains(string_split({0}.file_path, '/')[-1], '_pb2') AND NOT contains(string_split({0}.file_path, '/')[-1], '.generated.') AND coalesce(lower({0}.language) IN (" + ", ".join(f"'{x}'" for x in paths.CODE_LANGUAGES) + "), false))"
)


@query(f"""{WITH}, u AS (SELECT n.qualified_name, count(DISTINCT e.file_path) k FROM e JOIN n ON e.target_qualified = n.qualified_name WHERE e.kind = 'CALLS' AND n.kind IN ('Function', 'Class') AND {_PROD.format('n')} AND e.file_path <> n.file_path GROUP BY 1),
s AS (SELECT list_sort(list(k)) l FROM u), t AS (SELECT greatest(l[least(len(l) * 95 // 100, len(l) - 1) + 1], 5) p FROM s)
SELECT qualified_name, k AS using_files FROM u, t WHERE k >= p AND qualified_name NOT IN (SELECT source_qualified FROM e WHERE kind = 'TESTED_BY')""")
def untested_core(spark, d):
    return architecture.untested_core(*both(spark, d))


@query(rf"""{WITH}, docs AS (SELECT DISTINCT file_path FROM n WHERE lower(coalesce(language, '')) = 'markdown' OR lower(regexp_extract(file_path, '[^/.][^/]*\.([^./]+)$', 1)) IN ('md','markdown','rst','adoc'))
SELECT source_qualified, target_qualified, line FROM e WHERE kind IN ('CROSS_ARTIFACT', 'REFERENCES') AND file_path IN (SELECT * FROM docs) AND target_qualified NOT IN (SELECT qualified_name FROM n)""")
def broken_doc_links(spark, d):
    return architecture.broken_doc_links(*both(spark, d)).select("source_qualified", "target_qualified", "line")


@query()
def architecture_findings(spark, d):
    """The heaviest findings of every kind."""
    n, e = both(spark, d)
    return architecture.architecture_findings(n, e, components.strongly_connected(file_links(spark, d)))


# --- change review -----------------------------------------------------------------------------


_CHANGED = "ch AS (SELECT unnest(['corelib/runtime/trace.py', 'corelib/runtime/retry.py', 'corelib/base/types.py']) f)"
BASE_TIME = 1745000000  # as in change_tally
CHANGED = ["corelib/runtime/trace.py", "corelib/runtime/retry.py", "corelib/base/types.py"]


def versions(spark, d):
    """Symbols as of ``BASE_TIME`` and of the current rows."""
    shape = lambda df: df.filter("kind <> 'File'").select("qualified_name", "kind", "name", "params", F.col("file_hash").alias("body_hash"))
    before = load(spark, d, "nodes").filter(F.col("updated_at") < BASE_TIME)
    return shape(latest(before, ["qualified_name"], ["updated_at", "file_hash", "mtime_ns"])), shape(both(spark, d)[0])


_VERSIONS = f"""b0 AS (SELECT qualified_name, kind, name, params, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY updated_at DESC NULLS LAST, file_hash DESC NULLS LAST, mtime_ns DESC NULLS LAST) rk FROM nodes WHERE updated_at < {BASE_TIME}) WHERE rk = 1 AND kind <> 'File'),
w0 AS (SELECT qualified_name, kind, name, params, file_hash FROM n WHERE kind <> 'File'),
dl AS (SELECT coalesce(w0.qualified_name, b0.qualified_name) qualified_name, CASE WHEN b0.qualified_name IS NULL THEN 'added' WHEN w0.qualified_name IS NULL THEN 'removed' WHEN w0.params IS DISTINCT FROM b0.params THEN 'reshaped' WHEN w0.file_hash IS DISTINCT FROM b0.file_hash THEN 'edited' ELSE 'same' END status, coalesce(w0.name, b0.name) "name" FROM w0 FULL JOIN b0 ON w0.qualified_name = b0.qualified_name)"""


@query(f"{WITH}, {_VERSIONS} SELECT qualified_name, status FROM dl")
def symbol_delta(spark, d):
    return changes.symbol_delta(*versions(spark, d)).select("qualified_name", "status")


@query(f"{WITH}, {_VERSIONS}, {_CHANGED} SELECT DISTINCT dl.qualified_name AS target, e.source_qualified, e.kind, e.line FROM e JOIN dl ON e.target_qualified = dl.qualified_name WHERE dl.status = 'removed' AND e.kind <> 'CONTAINS' AND e.file_path NOT IN (SELECT f FROM ch)")
def dangling_references(spark, d):
    delta = changes.symbol_delta(*versions(spark, d))
    return changes.dangling_references(delta, both(spark, d)[1], keys(spark, *CHANGED)).distinct()


@query(f"""{WITH}, {_CHANGED} SELECT n.file_path, count(*) AS n_tests FROM n WHERE qualified_name IN (SELECT e.target_qualified FROM e JOIN n c ON e.source_qualified = c.qualified_name WHERE e.kind = 'TESTED_BY' AND c.file_path IN (SELECT f FROM ch)) GROUP BY n.file_path""")
def tests_to_run(spark, d):
    return changes.tests_to_run(*both(spark, d), keys(spark, *CHANGED)).select("file_path", "n_tests")


@query(f"""{WITH}, ch AS (SELECT file_path f FROM n WHERE kind = 'File' AND file_path LIKE '%/src/%') SELECT DISTINCT e.source_qualified, e.target_qualified, CASE WHEN s.file_path IN (SELECT f FROM ch) THEN 'source' ELSE 'target' END AS changed_side
FROM (SELECT * FROM e WHERE {REPORTABLE_SQL}) e JOIN n s ON e.source_qualified = s.qualified_name JOIN n t ON e.target_qualified = t.qualified_name WHERE (s.file_path IN (SELECT f FROM ch)) <> (t.file_path IN (SELECT f FROM ch))""")
def one_sided_bridges(spark, d):
    n, e = both(spark, d)
    return changes.one_sided_bridges(n, e, n.filter("kind = 'File' AND file_path LIKE '%/src/%'").select(F.col("file_path").alias("key")).distinct())


@query(f"""{WITH_REC}, f AS (SELECT source_qualified src, target_qualified dst FROM e WHERE kind = 'CALLS' UNION SELECT target_qualified, source_qualified FROM e WHERE kind = 'TESTED_BY'),
w AS (SELECT qualified_name k, 0 dep FROM n WHERE kind = 'Test' OR is_test UNION SELECT f.dst, dep + 1 FROM w JOIN f ON f.src = w.k WHERE dep < 4)
SELECT qualified_name FROM n WHERE kind = 'Function' AND NOT coalesce(is_test, false) AND {_PROD.format('n')} AND file_path LIKE '%/core/%' AND qualified_name NOT IN (SELECT k FROM w WHERE k IS NOT NULL)""")
def untested_changes(spark, d):
    n, e = both(spark, d)
    changed = n.filter("file_path LIKE '%/core/%'").select(F.col("file_path").alias("key")).distinct()
    return changes.untested_changes(n, e, changed)


@query(f"""{WITH}, s AS (SELECT file_path, line_start line, 0 r, 'EXACT' tier FROM n WHERE qualified_name = '{SEED_CALLEE}' UNION ALL SELECT file_path, line, CASE WHEN kind = 'CALLS' THEN 1 WHEN kind IN ('REFERENCES','INHERITS','IMPLEMENTS') THEN 2 ELSE 3 END, upper(coalesce(nullif(trim(confidence_tier), ''), 'EXTRACTED')) FROM e WHERE target_qualified = '{SEED_CALLEE}' AND kind IN ('CALLS','REFERENCES','INHERITS','IMPLEMENTS','IMPORTS_FROM'))
SELECT file_path, line, (['definition','call','reference','import'])[r + 1] AS site, tier FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line ORDER BY r, tier) rk FROM s) WHERE rk = 1""")
def rename_sites(spark, d):
    return changes.rename_sites(*both(spark, d), SEED_CALLEE)


@query(f"""{WITH}, old AS (SELECT DISTINCT kind, source_qualified, target_qualified FROM edges WHERE updated_at < 1745000000) SELECT e.kind, CASE WHEN old.kind IS NULL THEN 'added' ELSE 'existing' END AS change, count(*) AS n FROM e LEFT JOIN old ON e.kind = old.kind AND e.source_qualified = old.source_qualified AND e.target_qualified = old.target_qualified GROUP BY ALL""")
def change_tally(spark, d):
    base = load(spark, d, "edges").filter("updated_at < 1745000000")
    marked = changes.marked_changes(both(spark, d)[1], base, ["kind", "source_qualified", "target_qualified"])
    return marked.groupBy("kind", "change").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""{WITH}, {_CHANGED}, docs AS (SELECT qualified_name, file_path FROM n WHERE lower(coalesce(language, '')) = 'markdown' OR lower(regexp_extract(file_path, '[^/.][^/]*\.([^./]+)$', 1)) IN ('md','markdown','rst','adoc')),
b AS (SELECT source_qualified a, target_qualified z FROM e WHERE {REPORTABLE_SQL}), t AS (SELECT a, z FROM b UNION ALL SELECT z, a FROM b)
SELECT DISTINCT docs.file_path AS doc, t.a AS symbol FROM t JOIN n ON t.a = n.qualified_name JOIN docs ON t.z = docs.qualified_name WHERE n.file_path LIKE '%/src/%' AND docs.file_path NOT LIKE '%/src/%'""")
def contract_docs(spark, d):
    n, e = both(spark, d)
    return changes.contract_docs(n, e, n.filter("file_path LIKE '%/src/%'").select(F.col("file_path").alias("key")).distinct())


# --- refactoring -------------------------------------------------------------------------------


@query(rf"""{WITH}, used AS (SELECT DISTINCT target_qualified u FROM e WHERE source_qualified <> target_qualified AND (kind IN ('CALLS','IMPORTS_FROM','REFERENCES','INHERITS','IMPLEMENTS','DEPENDS_ON') OR {REPORTABLE_SQL}) UNION SELECT source_qualified FROM e WHERE kind = 'TESTED_BY'),
bare AS (SELECT DISTINCT regexp_replace(target_qualified, '^<unresolved:(.*)>$', '\1') nm, {family_sql('file_path')} fam FROM e WHERE kind IN ('CALLS','REFERENCES','INHERITS','IMPLEMENTS') AND NOT contains(target_qualified, '::')),
c AS (SELECT *, {family_sql('file_path')} fam, CASE WHEN coalesce(is_test, false) OR {TEST_PATH_SQL.format('file_path')} THEN 1 WHEN regexp_matches(name, '^__.*__$') THEN 1 WHEN regexp_matches(name, '{traversal.ENTRY_NAMES}') THEN 1
 WHEN json_extract_string(extra, '$.decorators') IS NOT NULL THEN 1 WHEN json_extract_string(extra, '$.ffi_export') = 'true' THEN 1 WHEN json_extract_string(extra, '$.is_contract') = 'true' OR json_extract_string(extra, '$.is_abstract') = 'true' THEN 1
 WHEN json_extract_string(extra, '$.type_role') IN ('record','enum','config') THEN 1 WHEN lower(coalesce(language, '')) = 'markdown' OR lower(regexp_extract(file_path, '[^/.][^/]*\.([^./]+)$', 1)) IN ('md','markdown','rst','adoc') THEN 1 ELSE 0 END ex FROM n WHERE kind IN ('Function', 'Class', 'Type'))
SELECT qualified_name, kind, name, file_path FROM c WHERE ex = 0 AND qualified_name NOT IN (SELECT u FROM used WHERE u IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM bare WHERE nm = c.name AND bare.fam IS NOT DISTINCT FROM c.fam)""")
def unused_symbols(spark, d):
    return refactoring.unused_symbols(*both(spark, d))


_METRICS = r"""sp AS (SELECT n.qualified_name, n.kind, n.line_end - n.line_start + 1 n_lines, string_split(replace(s.content, chr(13), ''), chr(10))[n.line_start:n.line_end] l FROM n JOIN source_files s ON n.file_path = s.file_path WHERE s.content IS NOT NULL AND n.kind IN ('Function', 'Class', 'Test') AND n.line_start > 0 AND n.line_end >= n.line_start),
mt AS (SELECT qualified_name, kind, n_lines, coalesce(list_sum(list_transform(l, lambda x: {BRANCHES})), 0)::BIGINT n_branches FROM sp)"""
_BRANCH_SQL = " + ".join(f"contains(' ' || trim(x) || ' ', '{t}')::INT" for t in text.BRANCH_TOKENS)
_METRICS = _METRICS.replace("{BRANCHES}", _BRANCH_SQL)


@query(f"{WITH}, {_METRICS} SELECT qualified_name, kind, n_lines, n_branches FROM mt")
def span_metrics(spark, d):
    stored = load(spark, d, "source_files").filter("content IS NOT NULL")
    return refactoring.span_metrics(both(spark, d)[0], stored).select("qualified_name", "kind", "n_lines", "n_branches")


def _side(column: str) -> str:
    return ", ".join("(" + " OR ".join(f"contains({column}, '{p}')" for p in patterns) + f") {key}" for key, patterns in refactoring.SIDE_EFFECTS.items())


_SIDES = list(refactoring.SIDE_EFFECTS)


@query(f"""{WITH}, cl AS (SELECT e.source_qualified s, e.target_qualified t, c.community_id, list_filter(string_split(string_split(e.target_qualified, '::')[1], '/'), lambda p: p <> '' AND p <> '.') parts FROM e LEFT JOIN (SELECT * FROM n WHERE community_id IS NOT NULL) c ON e.target_qualified = c.qualified_name WHERE e.kind = 'CALLS'),
sc AS (SELECT s, community_id, lower(t) lt, CASE WHEN t <> '' AND NOT starts_with(t, '<') THEN CASE WHEN starts_with(t, '/') THEN '/' ELSE '' END || CASE WHEN len(parts) <= 1 AND NOT starts_with(t, '/') THEN '.' ELSE array_to_string(parts[1:greatest(len(parts) - 1, 0)], '/') END END scope FROM cl),
fd AS (SELECT s, count(*) n_calls, count(DISTINCT community_id) n_communities, count(DISTINCT scope) n_scopes, {", ".join(f"bool_or({k}) {k}" for k in _SIDES)} FROM (SELECT *, {_side('lt')} FROM sc) GROUP BY s),
fn AS (SELECT n.qualified_name, lower(array_to_string(string_split(replace(f.content, chr(13), ''), chr(10))[greatest(n.line_start, 1):n.line_end], chr(10))) txt FROM n LEFT JOIN source_files f ON n.file_path = f.file_path WHERE n.kind = 'Function'),
fl AS (SELECT qualified_name, {_side("coalesce(txt, '')")} FROM fn)
SELECT fl.qualified_name, coalesce(fd.n_calls, 0) AS n_calls, coalesce(fd.n_communities, 0) AS n_communities, coalesce(fd.n_scopes, 0) AS n_scopes, {" + ".join(f"(fl.{k} OR coalesce(fd.{k}, false))::INT" for k in _SIDES)} AS n_side_effects FROM fl LEFT JOIN fd ON fl.qualified_name = fd.s""")
def function_concerns(spark, d):
    n, e = both(spark, d)
    found = refactoring.concern_profiles(n, e, load(spark, d, "source_files"))
    return found.select("qualified_name", "n_calls", "n_communities", "n_scopes", "n_side_effects")


@query()
def concern_scores(spark, d):
    """Score, reasons and role of every function that mixes concerns."""
    n, e = both(spark, d)
    return refactoring.concern_profiles(n, e, load(spark, d, "source_files")).filter("score_ppm > 0").select("qualified_name", "score_ppm", "reasons", "role")


@query()
def suggestions(spark, d):
    """Remove, split and document suggestions with their order and confidence."""
    n, e = both(spark, d)
    metrics = refactoring.span_metrics(n, load(spark, d, "source_files").filter("content IS NOT NULL"))
    suggested = refactoring.suggestions(refactoring.unused_symbols(n, e), refactoring.split_candidates(metrics, e, refactoring.concern_profiles(n, e, load(spark, d, "source_files"))), refactoring.undocumented(metrics, e))
    profiles = architecture.profiles(n, architecture.scope_dependencies(n, e))
    return refactoring.temper_by_stability(suggested, n, profiles)


@query(f"""{WITH}, w AS (SELECT unnest(regexp_extract_all(content, '([\\p{{L}}_][\\p{{L}}\\p{{N}}_]*)', 1)) word FROM source_files), c AS (SELECT word, count(*) k FROM w GROUP BY word)
SELECT qualified_name, coalesce(k, 0) AS mentions FROM n LEFT JOIN c ON n.name = c.word WHERE n.kind = 'Function'""")
def name_mentions(spark, d):
    n = both(spark, d)[0].filter("kind = 'Function'").select("qualified_name", "name")
    return refactoring.mentioned_elsewhere(n, load(spark, d, "source_files")).select("qualified_name", "mentions")


@query()
def inferred_tests(spark, d):
    """Likely tests of the functions of one file."""
    n, e = both(spark, d)
    symbols = n.filter("kind = 'Function' AND file_path LIKE 'corelib/%'").select(F.col("qualified_name").alias("key"))
    return refactoring.infer_tests(n, e, symbols).select("qualified_name", "test", "score", F.col("place").cast("long").alias("place"))
