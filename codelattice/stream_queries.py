"""Queries of streams, the work queue, the store and the sources, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph_queries import WITH, both
from .operators import store
from .schema import NODES_CTE, current_nodes
from .session import load
from .sources import extractors, manifests, repository
from .streaming import queue, watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

GAP, CAP = 1800.0, 7200.0


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def event_times(spark: SparkSession, d: str) -> DataFrame:
    """Events with their time in seconds of UTC, whatever the session's time zone."""
    ts = F.col("ts").cast("timestamp_ntz")
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    seconds = day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    return load(spark, d, "events").select(F.col("event_type").alias("key"), "event_id", F.col("user_id").cast("string").alias("path"), seconds.cast("double").alias("at"))


@query(f"""WITH RECURSIVE x AS (SELECT event_type k, epoch(date_trunc('second', ts))::DOUBLE tm FROM events),
i AS (SELECT k, tm, sum(nw) OVER (PARTITION BY k ORDER BY tm ROWS UNBOUNDED PRECEDING) isl, row_number() OVER (PARTITION BY k ORDER BY tm) r FROM (SELECT k, tm, CASE WHEN tm - lag(tm) OVER (PARTITION BY k ORDER BY tm) > {GAP} OR lag(tm) OVER (PARTITION BY k ORDER BY tm) IS NULL THEN 1 ELSE 0 END nw FROM x)),
b AS (SELECT k, isl, min(tm) s FROM i GROUP BY k, isl UNION ALL SELECT b.k, b.isl, (SELECT min(tm) FROM i WHERE i.k = b.k AND i.isl = b.isl AND i.tm - b.s > {CAP}) FROM b WHERE b.s IS NOT NULL),
c AS (SELECT k, isl, s, lead(s) OVER (PARTITION BY k, isl ORDER BY s) nx FROM b WHERE s IS NOT NULL)
SELECT c.k AS key, c.s AS batch_start, max(i.tm) AS batch_end, count(*) AS n_events FROM c JOIN i ON i.k = c.k AND i.isl = c.isl AND i.tm >= c.s AND (c.nx IS NULL OR i.tm < c.nx) GROUP BY c.k, c.isl, c.s""")
def debounce_batches(spark, d):
    return watch.debounced(event_times(spark, d), "key", "at", GAP, CAP)


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, d):
    """Counts by hour, computed by a stream that reads what is there and stops."""
    schema = load(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(d)
    counted = stream.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    name = f"hourly_{uuid.uuid4().hex}"
    # each batch writes the whole state as a table; the last one holds the answer
    place, written = f"{watch.checkpoint_for(spark, name)}-counts", []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{place}/{number}")
        written.append(number)

    run = counted.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", watch.checkpoint_for(spark, name)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{place}/{written[-1]}") if written else spark.createDataFrame([], counted.schema)


@query("SELECT kind, min(id) AS id, max(priority) AS priority, count(*) AS n_merged FROM tasks WHERE state = 'pending' GROUP BY kind")
def coalesced_tasks(spark, d):
    return queue.coalesced(load(spark, d, "tasks")).select("kind", "id", "priority", "n_merged")


@query("SELECT id, CASE WHEN state = 'running' THEN CASE WHEN attempts >= 3 THEN 'dead' ELSE 'pending' END ELSE state END AS state FROM tasks")
def recovered_tasks(spark, d):
    return queue.recovered(load(spark, d, "tasks")).select("id", "state")


@query("SELECT id, priority FROM tasks WHERE state = 'pending' AND coalesce(not_before, 0) <= 1800000000 ORDER BY priority DESC, created_at, id")
def next_tasks(spark, d):
    return queue.claimable(load(spark, d, "tasks"), 1.8e9).select("id", "priority")


@query(f"WITH {NODES_CTE}, v AS (SELECT DISTINCT provider, qualified_name FROM node_vectors) SELECT provider, count(*) AS n_orphans FROM v WHERE qualified_name NOT IN (SELECT qualified_name FROM n WHERE kind <> 'File') GROUP BY provider")
def orphaned_vectors(spark, d):
    vectors = load(spark, d, "node_vectors").select("provider", "qualified_name").distinct()
    return store.prune_vectors(vectors, current_nodes(spark, d))[1].groupBy("provider").agg(F.count(F.lit(1)).alias("n_orphans"))


@query(f"WITH {NODES_CTE} SELECT DISTINCT id FROM communities WHERE id NOT IN (SELECT community_id FROM n WHERE community_id IS NOT NULL)")
def orphaned_communities(spark, d):
    members = current_nodes(spark, d).filter("community_id IS NOT NULL")
    return store.prune(load(spark, d, "communities").select("id").distinct(), "id", members, "community_id")[1]


@query(f"WITH {NODES_CTE}, w AS (SELECT qualified_name, md5(concat_ws(chr(10), kind, name, file_path, parent_name, lower(language), signature)) h FROM n WHERE kind <> 'File') SELECT qualified_name, h AS text_hash FROM w WHERE NOT EXISTS (SELECT 1 FROM node_vectors v WHERE v.provider = 'alder-mini#body' AND v.qualified_name = w.qualified_name AND v.text_hash = w.h)")
def embed_work(spark, d):
    return store.embed_work(current_nodes(spark, d), load(spark, d, "node_vectors"), "alder-mini#body")


@query(f"{WITH}, r AS (SELECT n.* FROM n) SELECT qualified_name FROM r WHERE file_path NOT LIKE 'corelib/%'")
def nodes_without_removed_files(spark, d):
    n, _ = both(spark, d)
    gone = n.filter("file_path LIKE 'corelib/%'").select(F.col("file_path").alias("key"))
    return store.replace_files(n, n.limit(0), gone).select("qualified_name")


@query(f"""WITH {NODES_CTE}, f AS (SELECT file_path, max(file_hash) h, max(mtime_ns) m FROM n WHERE kind = 'File' GROUP BY 1),
o AS (SELECT file_path, file_hash h, mtime_ns m FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY recorded_at DESC NULLS LAST, file_hash DESC NULLS LAST, mtime_ns DESC NULLS LAST) rk FROM file_meta) WHERE rk = 1)
SELECT coalesce(f.file_path, o.file_path) AS file_path, CASE WHEN f.file_path IS NULL THEN 'removed' WHEN o.file_path IS NULL THEN 'new' WHEN f.m = o.m AND f.m > 0 THEN 'unchanged' WHEN f.h IS NOT DISTINCT FROM o.h THEN CASE WHEN f.m IS NOT DISTINCT FROM o.m THEN 'unchanged' ELSE 'touched' END ELSE 'changed' END AS state FROM f FULL JOIN o ON f.file_path = o.file_path""")
def content_states(spark, d):
    from .schema import latest

    files = current_nodes(spark, d).filter("kind = 'File'").groupBy("file_path").agg(F.max("file_hash").alias("file_hash"), F.max("mtime_ns").alias("mtime_ns"))
    meta = latest(load(spark, d, "file_meta").filter("file_path IS NOT NULL"), ["file_path"], ["recorded_at", "file_hash", "mtime_ns"])
    return repository.content_states(files, meta)


@query()
def extracted_symbols(spark, d):
    """Nodes by kind and language that the extractors find in the stored sources."""
    rows = extractors.extract_files(load(spark, d, "source_files"))
    nodes, _ = extractors.nodes_and_edges(rows)
    return nodes.groupBy(F.lower("language").alias("language"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def extracted_edges(spark, d):
    """Edges by kind that the extractors find in the stored sources."""
    _, edges = extractors.nodes_and_edges(extractors.extract_files(load(spark, d, "source_files")))
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def document_sections(spark, d):
    """Sections, paragraphs and links of all documents, read as Markdown."""
    docs = load(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.lit("markdown").alias("language"), F.col("text").alias("content"))
    nodes, _ = extractors.nodes_and_edges(extractors.extract_files(docs))
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def manifest_bridges(spark, d):
    """Bridges of the build manifests among the stored sources."""
    return manifests.manifest_bridges(load(spark, d, "source_files"))


@query(f"""{WITH}, fc AS (SELECT source_qualified, kind, list_distinct(list(string_split(string_split(target_qualified, '::')[-1], '.')[-1])) l FROM e WHERE kind IN ('CALLS', 'IMPORTS_FROM', 'INHERITS') GROUP BY ALL),
p AS (SELECT source_qualified q, array_to_string(list_sort(list(kind || ': ' || array_to_string(list_sort(l)[1:20], ', '))), chr(10)) facts FROM fc GROUP BY 1)
SELECT qualified_name, md5(concat_ws(chr(10), CASE WHEN kind <> '' THEN 'kind: ' || kind END, CASE WHEN name <> '' THEN 'name: ' || name END, CASE WHEN file_path <> '' THEN 'path: ' || file_path END, CASE WHEN parent_name <> '' THEN 'parent: ' || parent_name END, CASE WHEN signature <> '' THEN 'signature: ' || signature END, facts)) AS text_md5 FROM n LEFT JOIN p ON n.qualified_name = p.q WHERE kind <> 'File'""")
def node_texts(spark, d):
    n, e = both(spark, d)
    return store.node_texts(n, e).select("qualified_name", F.md5("text").alias("text_md5"))
