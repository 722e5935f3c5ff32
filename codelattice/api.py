"""The tool surface: named questions over one graph.

``Graph`` holds the node and edge frames; ``call`` answers a tool by name with
plain arguments and gives back a dictionary of frames and values. Frames are
lazy; only the lists an answer is made of (at most ``limit`` rows) are ever
collected, by :func:`reply`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, components, lookup, ranking, search, textindex, traversal
from .plans import architecture, changes, refactoring
from .schema import current_edges, current_nodes

ROW_LIMIT = 200


@dataclass
class Graph:
    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    sources: DataFrame | None = None
    index: textindex.TextIndex | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Graph:
        return cls(spark, current_nodes(spark, folder), current_edges(spark, folder))

    def keys(self, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in names], "key string")


def query_graph(g: Graph, pattern: str, target: str, depth: int = 1, import_kind: str | None = None, path_prefix: str | None = None, limit: int = ROW_LIMIT) -> dict:
    """A relationship pattern around a target; several candidates are answered each, none is told as such."""
    if pattern not in traversal.PATTERNS or not 1 <= depth <= 6:
        return {"error": f"pattern must be one of {traversal.PATTERNS} and depth within 1..6"}
    found = [r.qualified_name for r in lookup.resolve_target(g.nodes, target).select("qualified_name").collect()] or ([target] if pattern in ("callers_of", "importers_of") else [])
    if not found:
        return {"status": "not_found", "target": target}
    if depth > 1 and pattern in ("callers_of", "importers_of", "imports_of"):
        links = {"callers_of": traversal.callers, "importers_of": traversal.importers, "imports_of": traversal.imports}[pattern](g.edges)
        reached = traversal.walk(g.keys(found), links, depth).filter("depth > 0")
        return {"status": "ok", "targets": found, "rows": reached.orderBy("depth", "key").limit(traversal.NEW_ROW_CAP)}
    rows = None
    for name in found:
        edges = g.edges.filter(lookup.import_kind() == import_kind) if import_kind else g.edges
        part = traversal.relationship(pattern, g.nodes, edges, name).withColumn("target", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    if path_prefix:
        rows = rows.filter(F.col("endpoint").startswith(path_prefix))
    return {"status": "ok" if len(found) == 1 else "ambiguous", "targets": found, "rows": rows.orderBy("target", "endpoint", "line").limit(limit)}


def search_nodes(g: Graph, query: str, kind: str | None = None, limit: int = 20) -> dict:
    limit = min(limit, ROW_LIMIT)
    nodes = g.nodes.filter(F.col("kind") == kind) if kind else g.nodes
    hits, mode = search.fts_search(g.index if g.index is not None and not kind else search.FrameIndex(search.node_fields(nodes), "id", search.FIELD_WEIGHTS), query, limit)
    if hits.isEmpty():
        return {"mode": "keyword", "rows": search.keyword_search(nodes, query, limit)}
    named = hits.join(nodes.select(F.col("id").alias("_id"), "qualified_name", "kind"), F.col("doc") == F.col("_id"))
    return {"mode": mode, "rows": named.select("qualified_name", "kind", "score").orderBy(F.desc("score"), "qualified_name"), "exactness": search.exactness(named, query)}


def list_graph_stats(g: Graph) -> dict:
    return {"rows": aggregates.graph_stats(g.nodes, g.edges), "answerability": aggregates.answerability(g.nodes, g.edges)}


def architecture_analysis(g: Graph, mode: str = "overview", depth: int = 2, max_length: int = 3) -> dict:
    dependencies = architecture.scope_dependencies(g.nodes, g.edges, depth)
    if mode == "overview":
        return {"stability": architecture.stability(dependencies), "distances": architecture.distances(g.nodes, dependencies, depth), "violations": architecture.stability_violations(dependencies)}
    if mode == "import_cycles":
        links = dependencies.select(F.col("source").alias("src"), F.col("target").alias("dst"))
        found = components.strongly_connected(links)
        return {"components": found, "cycles": components.short_cycles(links, max_length), "simple_cycles": components.simple_cycles(links, found)}
    return {"error": "mode must be overview or import_cycles"}


def review(g: Graph, changed_files: list[str], mode: str = "changes", depth: int = 2) -> dict:
    files = g.keys(changed_files)
    if mode == "affected_flows":
        symbols = g.nodes.filter(F.col("file_path").isin(changed_files)).select(F.col("qualified_name").alias("key"))
        return {"entries": traversal.entries_reaching(g.nodes, g.edges, symbols)}
    if mode != "changes":
        return {"error": "mode must be changes or affected_flows"}
    return {
        "impact": traversal.impact_radius(g.nodes, g.edges, changed_files, depth), "tests_to_run": changes.tests_to_run(g.nodes, g.edges, files),
        "untested": changes.untested_changes(g.nodes, g.edges, files), "contract_docs": changes.contract_docs(g.nodes, g.edges, files), "bridges": changes.one_sided_bridges(g.nodes, g.edges, files),
    }


def flow(g: Graph, target: str | None = None, limit: int = 50) -> dict:
    if target is None:
        return {"entries": traversal.entry_points(g.nodes, g.edges).select("qualified_name", "entry_kind").orderBy("entry_kind", "qualified_name").limit(limit)}
    return {"entries": traversal.entries_reaching(g.nodes, g.edges, g.keys([target])).orderBy("hops", "entry").limit(limit)}


def refactor(g: Graph, mode: str = "suggest", old_name: str | None = None, limit: int = ROW_LIMIT) -> dict:
    if mode == "rename" and old_name:
        return {"sites": changes.rename_sites(g.nodes, g.edges, old_name)}
    unused = refactoring.unused_symbols(g.nodes, g.edges)
    if mode == "dead_code":
        return {"candidates": refactoring.mentioned_elsewhere(unused, g.sources) if g.sources is not None else unused}
    if mode == "suggest" and g.sources is not None:
        metrics = refactoring.span_metrics(g.nodes, g.sources.filter("content IS NOT NULL"))
        found = refactoring.suggestions(unused, refactoring.split_candidates(metrics, g.edges, refactoring.concern_profiles(g.nodes, g.edges, g.sources)), refactoring.undocumented(metrics, g.edges))
        return {"suggestions": found.orderBy("rank", F.desc("weight"), "qualified_name").limit(limit)}
    return {"error": "mode must be rename (with old_name), dead_code or suggest (with sources)"}


def minimal_context(g: Graph, changed_files: list[str] | None = None) -> dict:
    out = list_graph_stats(g) | {"communities": aggregates.community_profiles(g.nodes).orderBy(F.desc("size"), "community_id").limit(5)}
    return out | ({"review": review(g, changed_files)} if changed_files else {})


def cross_repo_search(graphs: dict[str, Graph], query: str, limit: int = 20) -> dict:
    hits = {repo: search_nodes(g, query, limit=limit) for repo, g in graphs.items()}
    modes = {repo: h["mode"] for repo, h in hits.items()}
    return {"modes": modes, "rows": search.federated({r: h["rows"].select("qualified_name", F.col("score").cast("long").alias("score")) for r, h in hits.items()}, limit)}


TOOLS: dict[str, Callable[..., dict]] = {
    "query_graph_tool": query_graph, "semantic_search_nodes_tool": search_nodes, "list_graph_stats_tool": list_graph_stats, "architecture_analysis_tool": architecture_analysis,
    "review_tool": review, "flow_tool": flow, "refactor_tool": refactor, "get_minimal_context_tool": minimal_context,
}


def call(g: Graph, name: str, **arguments) -> dict:
    """One tool by name; unknown names and wrong arguments are told, not raised."""
    if name not in TOOLS:
        return {"error": f"unknown tool {name}", "tools": sorted(TOOLS)}
    try:
        return TOOLS[name](g, **arguments)
    except TypeError as e:
        return {"error": str(e)}


def reply(answer: dict, budget_tokens: int = 8000, limit: int = ROW_LIMIT) -> dict:
    """Plain lists of an answer, cut to a budget; frames give at most ``limit`` rows each."""
    frames = {k: [r.asDict() for r in v.limit(limit).collect()] for k, v in answer.items() if isinstance(v, DataFrame)}
    plain = {k: v for k, v in answer.items() if not isinstance(v, (DataFrame, dict))}
    return plain | ranking.trim_to_budget(frames, budget_tokens, list(frames))
