"""Queries of the general data-processing problems (p3 to p6) with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import hierarchy, increments, references, skew
from .session import cut, ensure_checkpoint_dir, load

EDGE_IDENTITY = ["source_qualified", "file_path", "line"]
HEAVY_PERCENT = 1


# --- 3: processing only new or changed records -------------------------------------------------


def committed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Disjoint intervals of the run numbers that ended well."""
    return increments.islands(load(spark, d, "tasks").filter(F.col("state") == "done").select("id"), "id")


def current_files(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "nodes").filter(F.col("kind") == "File").select("file_path", "file_hash", "updated_at")
    return hierarchy.latest_rows(files, "file_path", "updated_at", ["file_hash"])


def numbered_files(spark: SparkSession, d: str, done: DataFrame) -> DataFrame:
    """Every current file with the number of the run it belongs to, and whether it is new or changed.

    A file in the state that finished runs recorded last belongs to the run
    that recorded it. Any other belongs to the unfinished run that stored its
    present state last, if one did, else to the run that is to come.
    """
    ledger = load(spark, d, "file_meta").select("task_id", "file_path", "file_hash", "recorded_at").filter(F.col("file_path").isNotNull() & F.col("task_id").isNotNull())
    marked = increments.mark_within(ledger, "task_id", done, "finished")
    row = F.struct("recorded_at", "file_hash", "task_id")
    last = marked.groupBy(F.col("file_path").alias("_path")).agg(F.max(F.when(F.col("finished"), row)).alias("was"), F.max(F.when(~F.col("finished"), row)).alias("open"))
    runs = load(spark, d, "tasks").select("id").unionByName(ledger.select(F.col("task_id").alias("id")))
    coming = (runs.agg(F.max("id")).first()[0] or 0) + 1
    both = current_files(spark, d).join(last, F.col("file_path") == F.col("_path"), "left")
    settled = F.col("was").isNotNull() & F.col("was.file_hash").eqNullSafe(F.col("file_hash"))
    stored = F.col("open").isNotNull() & F.col("open.file_hash").eqNullSafe(F.col("file_hash"))
    run = F.when(settled, F.col("was.task_id")).when(stored, F.col("open.task_id")).otherwise(F.lit(coming))
    return both.select("file_path", run.cast("long").alias("run"), F.when(F.col("was").isNull(), "new").otherwise("changed").alias("change"))


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files to process next, new or changed: those whose run is a gap between the runs that finished.

    The ledger takes over the finished runs, processes the gaps and commits
    them with its output, which is the answer.
    """
    done = cut(committed_runs(spark, d))
    files = cut(numbered_files(spark, d, done))
    ledger = increments.IntervalLedger(spark, f"{ensure_checkpoint_dir(spark)}/increments/{uuid.uuid4().hex}")
    ledger.adopt(done)
    ledger.run(files, "run", lambda rows: rows.select("file_path", "change"))
    processed = ledger.output()
    return files.select("file_path", "change").limit(0) if processed is None else processed


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_changes(spark, d).select("file_path")


def p3_run_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Runs the ledger names, as intervals that are processed or still a gap."""
    done = cut(committed_runs(spark, d))
    named = increments.islands(load(spark, d, "file_meta").select("task_id"), "task_id")
    gaps = increments.gaps_between(named, done)
    return done.withColumn("status", F.lit("processed")).unionByName(gaps.withColumn("status", F.lit("gap")))


_P3_CTE = """
WITH current AS (
  SELECT file_path, file_hash FROM (SELECT file_path, file_hash, row_number() OVER (PARTITION BY file_path ORDER BY updated_at DESC NULLS LAST, file_hash DESC NULLS LAST) rn
    FROM nodes WHERE kind = 'File' AND file_path IS NOT NULL) WHERE rn = 1),
recorded AS (
  SELECT file_path, file_hash FROM (SELECT m.file_path, m.file_hash, row_number() OVER (PARTITION BY m.file_path ORDER BY m.recorded_at DESC NULLS LAST, m.file_hash DESC NULLS LAST) rn
    FROM file_meta m WHERE m.task_id IN (SELECT id FROM tasks WHERE state = 'done') AND m.file_path IS NOT NULL) WHERE rn = 1)
"""

P3_CHANGES_SQL = _P3_CTE + """
SELECT c.file_path, CASE WHEN r.file_path IS NULL THEN 'new' ELSE 'changed' END AS change
FROM current c LEFT JOIN recorded r ON c.file_path = r.file_path
WHERE r.file_path IS NULL OR c.file_hash IS DISTINCT FROM r.file_hash"""

P3_FOUND_SQL = f"SELECT file_path FROM ({P3_CHANGES_SQL})"

P3_RUN_INTERVALS_SQL = """
WITH done AS (SELECT DISTINCT id n FROM tasks WHERE state = 'done' AND id IS NOT NULL),
d AS (SELECT min(n) lo, max(n) hi FROM (SELECT n, n - row_number() OVER (ORDER BY n) g FROM done) GROUP BY g),
open AS (SELECT DISTINCT task_id n FROM file_meta WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT n FROM done)),
o AS (SELECT min(n) lo, max(n) hi FROM (SELECT n, n - row_number() OVER (ORDER BY n) g FROM open) GROUP BY g)
SELECT lo, hi, 'processed' AS status FROM d UNION ALL SELECT lo, hi, 'gap' AS status FROM o"""


# --- 4: a few keys holding most records --------------------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    edges = load(spark, d, "edges").select("target_qualified", "kind", *EDGE_IDENTITY)
    return skew.heavy_keys(edges, ["target_qualified", "kind"], EDGE_IDENTITY, HEAVY_PERCENT).select("target_qualified", "kind")


def p4_key_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct edges, distinct sources, commonest file and median line of every (target, kind)."""
    edges = load(spark, d, "edges").select("target_qualified", "kind", *EDGE_IDENTITY)
    return skew.key_profile(edges, ["target_qualified", "kind"], EDGE_IDENTITY, "source_qualified", "file_path", "line").select(
        "target_qualified", "kind", "n_rows", F.col("n_distinct").alias("n_edges"), F.col("n_values").alias("n_sources"), F.col("mode").alias("top_file"), F.col("median").alias("median_line")
    )


P4_FOUND_SQL = f"""
WITH e AS (SELECT DISTINCT kind, source_qualified, target_qualified, file_path, line FROM edges)
SELECT target_qualified, kind FROM e GROUP BY ALL HAVING count(*) * 100 >= {HEAVY_PERCENT} * (SELECT count(*) FROM e)"""

P4_KEY_PROFILE_SQL = """
WITH counts AS (SELECT target_qualified, kind, sum(n) n_rows, count(*) n_edges
    FROM (SELECT target_qualified, kind, source_qualified, file_path, line, count(*) n FROM edges GROUP BY ALL) GROUP BY ALL),
sources AS (SELECT target_qualified, kind, count(*) n_sources FROM (SELECT DISTINCT target_qualified, kind, source_qualified FROM edges) GROUP BY ALL),
files AS (SELECT target_qualified, kind, file_path top_file FROM (
    SELECT target_qualified, kind, file_path, row_number() OVER (PARTITION BY target_qualified, kind ORDER BY count(*) DESC, file_path) rn
    FROM edges WHERE file_path IS NOT NULL GROUP BY target_qualified, kind, file_path) WHERE rn = 1),
lines AS (SELECT target_qualified, kind, min(line) FILTER (run >= ceil(total * 0.5)) median_line FROM (
    SELECT target_qualified, kind, line, count(*) OVER (PARTITION BY target_qualified, kind) total,
      row_number() OVER (PARTITION BY target_qualified, kind ORDER BY line) run FROM edges WHERE line IS NOT NULL) GROUP BY ALL)
SELECT c.target_qualified, c.kind, c.n_rows::BIGINT n_rows, c.n_edges, s.n_sources, f.top_file, l.median_line
FROM counts c
LEFT JOIN sources s ON c.target_qualified IS NOT DISTINCT FROM s.target_qualified AND c.kind IS NOT DISTINCT FROM s.kind
LEFT JOIN files f ON c.target_qualified IS NOT DISTINCT FROM f.target_qualified AND c.kind IS NOT DISTINCT FROM f.kind
LEFT JOIN lines l ON c.target_qualified IS NOT DISTINCT FROM l.target_qualified AND c.kind IS NOT DISTINCT FROM l.kind"""


# --- 5: parent-child links to full hierarchies -------------------------------------------------


def community_links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.latest_rows(load(spark, d, "communities").select("id", "parent_id", "level", "created_at"), "id", "created_at", ["parent_id", "level"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links = community_links(spark, d)
    tree = hierarchy.resolve_hierarchy(links)
    levels = links.select("id", "level")
    joined = tree.join(levels, F.col("node") == F.col("id"))
    return joined.filter(F.col("depth").isNull() | ~F.col("level").eqNullSafe(F.col("depth"))).select("id", "root_id")


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth and root of every community; those on or below a loop are marked."""
    tree = hierarchy.resolve_hierarchy(community_links(spark, d))
    return tree.select(F.col("node").alias("id"), "depth", "root_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "in_loop")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every community of a tree with each of its descendants."""
    return hierarchy.ancestor_pairs(hierarchy.resolve_hierarchy(community_links(spark, d)))


_P5_CTE = """
WITH RECURSIVE c AS (
  SELECT id, parent_id, level FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, parent_id DESC NULLS LAST, level DESC NULLS LAST) rn
    FROM communities WHERE id IS NOT NULL) WHERE rn = 1),
t AS (
  SELECT id, 0::BIGINT depth, id root_id, id::VARCHAR path FROM c WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM c)
  UNION ALL
  SELECT c.id, t.depth + 1, t.root_id, t.path || '/' || c.id::VARCHAR FROM c JOIN t ON c.parent_id = t.id),
s AS (SELECT id, parent_id FROM c WHERE id NOT IN (SELECT id FROM t)),
up AS (SELECT id start, parent_id above FROM s UNION SELECT up.start, s.parent_id FROM up JOIN s ON up.above = s.id),
ring AS (SELECT start id FROM up WHERE start = above),
loops AS (SELECT s.id, min(up.above) root_id FROM s JOIN up ON up.start = s.id WHERE up.above IN (SELECT id FROM ring) GROUP BY s.id)
"""

P5_FOUND_SQL = _P5_CTE + """
SELECT c.id, t.root_id FROM c JOIN t ON c.id = t.id WHERE c.level IS DISTINCT FROM t.depth
UNION ALL SELECT id, root_id FROM loops"""

P5_HIERARCHY_SQL = _P5_CTE + """
SELECT id, depth, root_id, path, false AS in_loop FROM t UNION ALL SELECT id, NULL, root_id, NULL, true FROM loops"""

P5_DESCENDANTS_SQL = _P5_CTE + """,
pairs AS (
  SELECT c.parent_id ancestor, c.id descendant, 1::BIGINT distance FROM c JOIN t ON c.id = t.id WHERE t.depth > 0
  UNION ALL
  SELECT c.parent_id, p.descendant, p.distance + 1 FROM pairs p JOIN c ON c.id = p.ancestor JOIN t ON t.id = c.id WHERE t.depth > 0)
SELECT ancestor, descendant, distance FROM pairs"""


# --- 6: references to records that do not exist ------------------------------------------------


def month_of_seconds(seconds: Column) -> Column:
    """UTC month ``YYYY-MM``, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM")


def clean_name(name: Column) -> Column:
    slashed = F.translate(F.regexp_replace(name, r"^\s+|\s+$", ""), "\\", "/")
    return F.when(slashed.startswith("./"), F.substr(slashed, F.lit(3))).otherwise(slashed)


def graph_references(spark: SparkSession, d: str) -> DataFrame:
    """All references of edges and flow memberships with table, column, period and cleaned key."""
    edges = load(spark, d, "edges").select("source_qualified", "target_qualified", "extra", "updated_at")
    external = F.when(F.col("extra").contains('"external"'), F.get_json_object("extra", "$.external"))
    inner = edges.filter(~F.coalesce(external, F.lit("")).eqNullSafe(F.lit("true")))
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), clean_name(F.col(c)).alias("ref_key")) for c in ("source_qualified", "target_qualified")]))
    named = inner.select(month_of_seconds(F.col("updated_at")).alias("period"), ends.alias("end")).select(F.lit("edges").alias("table_name"), "end.column_name", "period", "end.ref_key")
    key = F.col("ref_key")
    named = named.filter((key.contains("/") | key.contains("::")) & ~key.startswith("<unresolved:"))
    flows = load(spark, d, "flows").groupBy(F.col("id").alias("_flow")).agg(F.max("updated_at").alias("_at"))
    members = load(spark, d, "flow_memberships").filter(F.col("node_id").isNotNull()).select("flow_id", "node_id")
    held = members.join(flows, F.col("flow_id") == F.col("_flow"), "left").select(
        F.lit("flow_memberships").alias("table_name"), F.lit("node_id").alias("column_name"), month_of_seconds(F.unix_micros("_at") / 1e6).alias("period"), F.col("node_id").cast("string").alias("ref_key")
    )
    return named.unionByName(held)


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Names hold ``/`` or ``::`` and ids hold digits only, so one key space serves both."""
    nodes = load(spark, d, "nodes").select("qualified_name", "id").distinct()
    parents = nodes.select(F.explode(F.array("qualified_name", F.col("id").cast("string"))).alias("ref_key"))
    return references.orphan_references(graph_references(spark, d), parents)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(spark, d).select("table_name", "column_name", "period", F.col("ref_key").alias("missing_key"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """References, orphan references and orphan keys per table, column and month."""
    return references.orphan_report(graph_references(spark, d), cut(orphans(spark, d)))


_P6_CTE = r"""
WITH ends AS (
  SELECT 'source_qualified' column_name, source_qualified raw, extra, updated_at FROM edges
  UNION ALL SELECT 'target_qualified', target_qualified, extra, updated_at FROM edges),
slashed AS (SELECT column_name, replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\', '/') s, updated_at FROM ends
  WHERE coalesce(json_extract_string(extra, '$.external'), '') <> 'true'),
cleaned AS (SELECT 'edges' table_name, column_name, strftime(make_timestamp((floor(updated_at) * 1000000)::BIGINT), '%Y-%m') period,
  CASE WHEN starts_with(s, './') THEN substr(s, 3) ELSE s END ref_key FROM slashed),
f AS (SELECT id, max(updated_at) last_seen FROM flows GROUP BY id),
refs AS (
  SELECT * FROM cleaned WHERE (contains(ref_key, '/') OR contains(ref_key, '::')) AND NOT starts_with(ref_key, '<unresolved:')
  UNION ALL
  SELECT 'flow_memberships', 'node_id', strftime(make_timestamp(epoch_us(f.last_seen)), '%Y-%m'), node_id::VARCHAR
  FROM flow_memberships m LEFT JOIN f ON m.flow_id = f.id WHERE node_id IS NOT NULL),
keys AS (SELECT qualified_name k FROM nodes UNION SELECT id::VARCHAR FROM nodes),
lost AS (SELECT refs.* FROM refs WHERE ref_key NOT IN (SELECT k FROM keys WHERE k IS NOT NULL))
"""

P6_FOUND_SQL = _P6_CTE + "SELECT DISTINCT table_name, column_name, period, ref_key AS missing_key FROM lost"

P6_REPORT_SQL = _P6_CTE + """
SELECT r.table_name, r.column_name, r.period, r.n AS n_refs, coalesce(l.n, 0) AS n_orphan_refs, coalesce(l.k, 0) AS n_orphan_keys
FROM (SELECT table_name, column_name, period, count(*) n FROM refs GROUP BY ALL) r
LEFT JOIN (SELECT table_name, column_name, period, count(*) n, count(DISTINCT ref_key) k FROM lost GROUP BY ALL) l
ON r.table_name = l.table_name AND r.column_name = l.column_name AND r.period IS NOT DISTINCT FROM l.period"""


QUERIES = {
    "p3_found": p3_found, "p3_changes": p3_changes, "p3_run_intervals": p3_run_intervals,
    "p4_found": p4_found, "p4_key_profile": p4_key_profile,
    "p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants,
    "p6_found": p6_found, "p6_report": p6_report,
}

ORACLES = {
    "p3_found": P3_FOUND_SQL, "p3_changes": P3_CHANGES_SQL, "p3_run_intervals": P3_RUN_INTERVALS_SQL,
    "p4_found": P4_FOUND_SQL, "p4_key_profile": P4_KEY_PROFILE_SQL,
    "p5_found": P5_FOUND_SQL, "p5_hierarchy": P5_HIERARCHY_SQL, "p5_descendants": P5_DESCENDANTS_SQL,
    "p6_found": P6_FOUND_SQL, "p6_report": P6_REPORT_SQL,
}
