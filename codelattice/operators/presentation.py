"""Rows as a reader or an embedding sees them: excerpts, described nodes, sections, orders and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

EXCERPT_CHARS = 4000
INLINE_MISSING_RATIO = 0.5  # share of missing vectors from which they are made at once, not queued
# fixed values: decorators and names of members that run with their class
IMPLICIT_NAMES = ["model_post_init"]
MODULE_HOOKS = ["__getattr__", "__dir__"]


def spans_of(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """``qualified_name, lines`` of every node with a span; a text meets the spans of its file once."""
    span = F.struct("qualified_name", F.greatest(F.col("line_start"), F.lit(1)).cast("int").alias("first"), F.col("line_end").cast("int").alias("last"))
    per_file = nodes.filter("line_start IS NOT NULL AND line_end IS NOT NULL").groupBy("file_path").agg(F.collect_list(span).alias("spans"))  # the nodes of one file
    lines = sources.filter("content IS NOT NULL").select(F.col("file_path").alias("_f"), F.split(F.translate("content", "\r", ""), "\n").alias("_lines"))
    own = F.transform("spans", lambda s: F.struct(s["qualified_name"].alias("qualified_name"), F.slice("_lines", s["first"], F.greatest(s["last"] - s["first"] + 1, F.lit(0))).alias("lines")))
    return per_file.join(lines, F.col("file_path") == F.col("_f")).select(F.explode(own).alias("s")).select("s.qualified_name", "s.lines")


def excerpts(nodes: DataFrame, sources: DataFrame, limit: int = EXCERPT_CHARS) -> DataFrame:
    """``qualified_name, excerpt, n_lines, truncated``: the lines of a node, at most ``limit`` characters."""
    whole = F.array_join("lines", "\n")
    return spans_of(nodes, sources).select("qualified_name", F.substring(whole, 1, limit).alias("excerpt"), F.size("lines").cast("long").alias("n_lines"), (F.length(whole) > limit).alias("truncated"))


def line_counts(sources: DataFrame) -> DataFrame:
    """``file_path, line_end``: real number of lines of a text; a last line without an end counts."""
    plain = F.translate("content", "\r", "")
    return sources.filter("content IS NOT NULL").select("file_path", (F.size(F.split(plain, "\n")) - F.when(plain.endswith("\n"), 1).otherwise(0)).cast("long").alias("line_end"))


def structured_text(nodes: DataFrame) -> DataFrame:
    """``qualified_name, text``: labelled fields, one a line; empty ones are left out."""
    fields = {"kind": "kind", "name": "name", "file": "file_path", "parent": "parent_name", "language": "language", "returns": "return_type"}
    parts = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in fields.items()]
    return nodes.filter("kind <> 'File'").select("qualified_name", F.concat_ws("\n", *parts).alias("text"))


def narrative_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``qualified_name, text``: what is known of a function in sentences."""
    calls = edges.filter("kind = 'CALLS'").groupBy(F.col("source_qualified").alias("_s")).agg(F.count_distinct("target_qualified").alias("_n"), F.min(text.endpoint_leaf(F.col("target_qualified"))).alias("_first"))
    count = F.size(text.parameter_list(F.col("params")))
    told = nodes.filter("kind = 'Function'").join(calls, F.col("qualified_name") == F.col("_s"), "left")
    sentences = [
        F.concat(F.col("name"), F.lit(" is a function of "), F.col("file_path"), F.lit(".")),
        F.when(F.coalesce("parent_name", F.lit("")) != "", F.concat(F.lit("It belongs to "), F.col("parent_name"), F.lit("."))),
        F.when(count > 0, F.concat(F.lit("It takes "), count.cast("string"), F.lit(" parameters."))),
        F.when(F.coalesce("return_type", F.lit("")) != "", F.concat(F.lit("It returns "), F.col("return_type"), F.lit("."))),
        F.when(F.col("_n") > 0, F.concat(F.lit("It calls "), F.col("_n").cast("string"), F.lit(" symbols, first "), F.col("_first"), F.lit("."))),
    ]
    return told.select("qualified_name", F.concat_ws(" ", *sentences).alias("text"))


def unit_vector(vector: str = "vector") -> Column:
    """The vector at length 1; one without a norm, or with a value that is no number, stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def tests_last(df: DataFrame, order: list, group: list[str]) -> DataFrame:
    """``df`` with ``position``: production first, else in the order given."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(*group).orderBy(F.coalesce("is_test", F.lit(False)), *order)) - 1)


def provider_partitions(vectors: DataFrame) -> DataFrame:
    """``provider, n`` in the order of size, largest first."""
    return vectors.groupBy("provider").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "provider")


def refresh_action(coverage: DataFrame) -> DataFrame:
    """``provider, action``: ``inline`` where nothing is there or much is missing, ``queue`` where little is, else ``skip``."""
    missing = F.col("n_nodes") - F.col("n_embedded")
    action = F.when(F.col("n_vectors") == 0, "inline").when((missing <= 0) | (F.col("n_nodes") <= 0), "skip").when(missing >= INLINE_MISSING_RATIO * F.col("n_nodes"), "inline").otherwise("queue")
    return coverage.select("provider", action.alias("action"))


def sections(documents: DataFrame, key: str, body: str) -> DataFrame:
    """``key, at, level, slug, n_lines``: the section of every heading, up to the next heading of its level or above."""
    lines = F.split(F.translate(body, "\r", ""), "\n")
    heads = F.filter(F.transform(lines, lambda line, i: F.struct((i + 1).alias("at"), text.heading_level(line).alias("level"), line.alias("line"))), lambda h: h["level"].isNotNull())
    held = documents.select(key, heads.alias("heads"), F.size(lines).alias("n"))
    until = F.transform("heads", lambda h: F.struct(h["at"].alias("at"), h["level"].alias("level"), h["line"].alias("line"), F.array_min(F.transform(F.filter("heads", lambda o: (o["at"] > h["at"]) & (o["level"] <= h["level"])), lambda o: o["at"])).alias("next")))
    told = held.select(key, "n", F.explode(until).alias("h"))
    return told.select(key, F.col("h.at").alias("at"), F.col("h.level").alias("level"), text.slugify(F.expr("substr(h.line, h.level + 1)")).alias("slug"), (F.coalesce("h.next", F.col("n") + 1) - F.col("h.at")).cast("long").alias("n_lines"))


def docs_section(documents: DataFrame, key: str, body: str, slug: str, max_chars: int = EXCERPT_CHARS) -> DataFrame:
    """``key, section``: the text of the sections with that slug, at most ``max_chars`` characters each."""
    found = sections(documents, key, body).filter(F.col("slug") == slug).select(F.col(key).alias("_k"), "at", "n_lines")
    lines = F.split(F.translate(body, "\r", ""), "\n")
    return documents.join(found, F.col(key) == F.col("_k")).select(key, "at", F.substring(F.array_join(F.slice(lines, F.col("at").cast("int"), F.col("n_lines").cast("int")), "\n"), 1, max_chars).alias("section"))


def implicit_callers(nodes: DataFrame) -> DataFrame:
    """``member, caller``: members the runtime calls (dunders, hooks) with the class or module they run with."""
    classes = nodes.filter("kind = 'Class'").select(F.col("qualified_name").alias("_c"))
    runs = F.col("name").rlike("^__.+__$") | F.col("name").isin(IMPLICIT_NAMES)
    held = nodes.filter((F.coalesce("parent_name", F.lit("")) != "") & runs).select(F.col("qualified_name").alias("member"), F.concat("file_path", F.lit("::"), "parent_name").alias("caller")).join(classes, F.col("caller") == F.col("_c"), "left_semi")
    hooks = nodes.filter((F.coalesce("parent_name", F.lit("")) == "") & F.col("name").isin(MODULE_HOOKS) & F.col("file_path").endswith(".py")).select(F.col("qualified_name").alias("member"), F.col("file_path").alias("caller"))
    return held.unionByName(hooks)


def reparse_scope(files: DataFrame, stored: DataFrame, current: dict[str, str]) -> DataFrame:
    """``file_path, language``: files whose extractor's version differs from the stored one (``language, version``)."""
    now = files.sparkSession.createDataFrame(sorted(current.items()) or [], "_lang string, _now string")
    was = stored.select(F.col("language").alias("_was_lang"), F.col("version").alias("_was"))
    told = files.join(now, F.col("language") == F.col("_lang")).join(was, F.col("language") == F.col("_was_lang"), "left")
    return told.filter(~F.col("_now").eqNullSafe(F.col("_was"))).select("file_path", "language")


def truthy(column: Column) -> Column:
    """Whether a JSON value counts as true: neither absent, null, false, zero nor empty."""
    return column.isNotNull() & ~F.trim(column).isin("", "null", "false", "0", "0.0", "[]", "{}", '""')
