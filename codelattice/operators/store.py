"""Table maintenance: replacement by file, upserts, pruning, metadata.

A table is a folder of numbered versions. A version is written whole and then
named by a marker file that must not exist yet, so readers see a version
completely or not at all and of two writers one fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGE_IDENTITY, SCHEMA_VERSION, latest


class Table:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def read(self) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(self.root)
        name = self.spark.read.text(f"{self.root}/_versions/{found[-1]}").first()[0]
        return self.spark.read.parquet(f"{self.root}/{name}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        version, name = (self.versions() or [0])[-1] + 1, f"data-{uuid.uuid4().hex}"
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}")
        self._fs.mkdirs(self._path(f"{self.root}/_versions"))
        stream = self._fs.create(self._path(f"{self.root}/_versions/{version}"), False)
        stream.write(bytearray(name.encode()))
        stream.close()
        return version


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """All rows of ``files`` (``key``) are replaced by ``new``; works for nodes and edges."""
    kept = old.join(files.select(F.col("key").alias("_f")).distinct(), F.col("file_path") == F.col("_f"), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Later rows win on the qualified name."""
    return latest(old.unionByName(new, allowMissingColumns=True), ["qualified_name"], ["updated_at"])


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return latest(old.unionByName(new, allowMissingColumns=True), EDGE_IDENTITY, ["updated_at"])


def update_mtimes(nodes: DataFrame, times: DataFrame) -> DataFrame:
    """New times for the files of ``times`` (file_path, mtime_ns), all else as it was."""
    t = times.groupBy(F.col("file_path").alias("_f")).agg(F.max("mtime_ns").alias("_m"))
    joined = nodes.join(t, F.col("file_path") == F.col("_f"), "left")
    return joined.select(*[F.coalesce("_m", "mtime_ns").alias(c) if c == "mtime_ns" else F.col(c) for c in nodes.columns])


def prune(derived: DataFrame, key: str, live: DataFrame, live_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows whose key is no longer alive)."""
    alive = live.select(F.col(live_key).alias("_live")).distinct()
    return derived.join(alive, F.col(key) == F.col("_live"), "left_semi"), derived.join(alive, F.col(key) == F.col("_live"), "left_anti")


def prune_vectors(vectors: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return prune(vectors, "qualified_name", nodes.filter("kind <> 'File'"), "qualified_name")


def prune_structures(nodes: DataFrame, edges: DataFrame, communities: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """What is left of every derived table."""
    alive = nodes.filter("community_id IS NOT NULL").select("community_id").distinct()
    return {"communities": prune(communities, "id", alive, "community_id")[0], "vectors": prune_vectors(vectors, nodes)[0], "edges": prune(edges, "source_qualified", nodes, "qualified_name")[0]}


def embed_work(nodes: DataFrame, vectors: DataFrame, provider: str) -> DataFrame:
    """Nodes whose text has no vector yet or another text hash: ``qualified_name, text_hash``."""
    text = F.concat_ws("\n", F.col("kind"), F.col("name"), F.col("file_path"), F.col("parent_name"), F.lower("language"), F.col("signature"))
    wanted = nodes.filter("kind <> 'File'").select("qualified_name", F.md5(text).alias("text_hash"))
    have = vectors.filter(F.col("provider") == provider).select(F.col("qualified_name").alias("_q"), F.col("text_hash").alias("_h")).distinct()
    return wanted.join(have, (F.col("qualified_name") == F.col("_q")) & (F.col("text_hash") == F.col("_h")), "left_anti")


def node_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Descriptions of nodes for embedding: labelled fields and the names of their neighbours by edge kind."""
    leaf = F.substring_index(F.substring_index("target_qualified", "::", -1), ".", -1)
    facts = edges.filter("kind IN ('CALLS', 'IMPORTS_FROM', 'INHERITS')").select("source_qualified", "kind", leaf.alias("leaf")).distinct().groupBy("source_qualified", "kind").agg(F.concat(F.col("kind"), F.lit(": "), F.array_join(F.slice(F.sort_array(F.collect_set("leaf")), 1, 20), ", ")).alias("fact"))
    per_node = facts.groupBy(F.col("source_qualified").alias("_q")).agg(F.array_join(F.sort_array(F.collect_list("fact")), "\n").alias("facts"))
    joined = nodes.filter("kind <> 'File'").join(per_node, F.col("qualified_name") == F.col("_q"), "left")
    label = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.col(c)))
    return joined.select("qualified_name", F.concat_ws("\n", label("kind", "kind"), label("name", "name"), label("path", "file_path"), label("parent", "parent_name"), label("signature", "signature"), F.col("facts")).alias("text"))


def check_version(metadata: DataFrame) -> None:
    """Read-only opening: the stored schema version must be this one."""
    row = metadata.filter("key = 'schema_version'").select("value").first()
    if row is None or row[0] != str(SCHEMA_VERSION):
        raise ValueError(f"schema version {row[0] if row else 'unknown'}, expected {SCHEMA_VERSION}")


def put_metadata(metadata: DataFrame, key: str, value: str) -> DataFrame:
    return metadata.filter(F.col("key") != key).unionByName(metadata.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def graph_freshness(stored_commit: str | None, current_commit: str | None, dirty_files: int, n_nodes: int) -> str:
    """unbuilt, fresh, dirty, commit_drift or unknown."""
    if not n_nodes:
        return "unbuilt"
    if stored_commit is None or current_commit is None:
        return "unknown"
    return "commit_drift" if stored_commit != current_commit else "dirty" if dirty_files else "fresh"
