"""Change review: what changed, what refers to it and what should be looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators.lookup import is_reportable_bridge


def symbol_delta(base: DataFrame, now: DataFrame) -> DataFrame:
    """``qualified_name, status, name, kind``: added, removed, reshaped (other parameters), edited (other body) or same.

    Both frames have qualified_name, kind, name, params, body_hash with one row per name.
    """
    b = base.select(F.col("qualified_name").alias("_b"), F.col("kind").alias("b_kind"), F.col("name").alias("b_name"), F.col("params").alias("b_params"), F.col("body_hash").alias("b_body"))
    joined = now.join(b, F.col("qualified_name") == F.col("_b"), "full_outer")
    status = (
        F.when(F.col("_b").isNull(), "added").when(F.col("qualified_name").isNull(), "removed").when(~F.col("params").eqNullSafe(F.col("b_params")), "reshaped")
        .when(~F.col("body_hash").eqNullSafe(F.col("b_body")), "edited").otherwise("same")
    )
    return joined.select(F.coalesce("qualified_name", "_b").alias("qualified_name"), status.alias("status"), F.coalesce("name", "b_name").alias("name"), F.coalesce("kind", "b_kind").alias("kind"), "b_params", "params")


def rename_candidates(delta: DataFrame, base: DataFrame, now: DataFrame) -> DataFrame:
    """Removed and added symbols with one and the same body, where the body is unique on both sides."""
    def side(df: DataFrame, status: str, name: str, body: str) -> DataFrame:
        wanted = delta.filter(F.col("status") == status).select(F.col("qualified_name").alias("_q"))
        hashed = df.join(wanted, F.col("qualified_name") == F.col("_q"), "left_semi").filter("body_hash IS NOT NULL")
        return hashed.groupBy(F.col("body_hash").alias(body)).agg(F.count(F.lit(1)).alias("_n"), F.min("qualified_name").alias(name)).filter("_n = 1").drop("_n")

    return side(base, "removed", "old_name", "_x").join(side(now, "added", "new_name", "_y"), F.col("_x") == F.col("_y")).select("old_name", "new_name")


def references_to(edges: DataFrame, targets: DataFrame, changed_files: DataFrame) -> DataFrame:
    """References from outside the change to the targets ``(qualified_name, name)``, by full name or bare name; the stronger way counts per site."""
    outside = edges.filter("kind <> 'CONTAINS'").join(changed_files.select(F.col("key").alias("_f")), F.col("file_path") == F.col("_f"), "left_anti")
    t = targets.select(F.col("qualified_name").alias("target"), F.col("name").alias("_name"))
    exact = outside.join(t, F.col("target_qualified") == F.col("target")).withColumn("way", F.lit(0))
    bare = outside.filter(~F.col("target_qualified").contains("::")).join(t, F.col("target_qualified") == F.col("_name")).withColumn("way", F.lit(1))
    leaf = outside.filter("startswith(target_qualified, '<unresolved:')").join(t, F.regexp_extract("target_qualified", "^<unresolved:(.*)>$", 1) == F.col("_name")).withColumn("way", F.lit(2))
    return exact.unionByName(bare).unionByName(leaf).groupBy("target", "source_qualified", "kind", "file_path", "line").agg(F.min("way").alias("way"))


def dangling_references(delta: DataFrame, edges: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Removed symbols that something outside the change still names in full."""
    removed = delta.filter("status = 'removed'").select("qualified_name", "name")
    return references_to(edges, removed, changed_files).filter("way = 0").select("target", "source_qualified", "kind", "line")


def unchanged_callers(delta: DataFrame, edges: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Calls, outside the change, of symbols that now require more parameters or take fewer."""
    old, new = text.parameter_shape(F.col("b_params")), text.parameter_shape(F.col("params"))
    shaped = delta.filter("status = 'reshaped'").filter((new["required"] > old["required"]) | (new["total"] < old["total"]))
    return references_to(edges.filter("kind = 'CALLS'"), shaped.select("qualified_name", "name"), changed_files).filter("way = 0").select("target", "source_qualified", "line")


def contract_docs(nodes: DataFrame, edges: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Documents tied to changed code by a reportable bridge that were not changed themselves."""
    changed = changed_files.select(F.col("key").alias("_f"))
    code = nodes.join(changed, F.col("file_path") == F.col("_f"), "left_semi").select(F.col("qualified_name").alias("_c"))
    home = nodes.select(F.col("qualified_name").alias("_q"), F.col("file_path").alias("doc"), F.col("language").alias("_lang"))
    ends = edges.filter(is_reportable_bridge()).select(F.explode(F.array(F.struct(F.col("source_qualified").alias("a"), F.col("target_qualified").alias("b")), F.struct(F.col("target_qualified").alias("a"), F.col("source_qualified").alias("b")))).alias("p")).select("p.a", "p.b")
    tied = ends.join(code, F.col("a") == F.col("_c"), "left_semi").join(home, F.col("b") == F.col("_q")).filter(paths.is_documentation(F.col("_lang"), F.col("doc")))
    return tied.select("doc", F.col("a").alias("symbol")).distinct().join(changed, F.col("doc") == F.col("_f"), "left_anti")


def one_sided_bridges(nodes: DataFrame, edges: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Reportable bridges of which one side lies in a changed file and the other does not."""
    home = nodes.select("qualified_name", F.col("file_path").alias("_home"))
    s, t = home.select(F.col("qualified_name").alias("_s"), F.col("_home").alias("source_file")), home.select(F.col("qualified_name").alias("_t"), F.col("_home").alias("target_file"))
    tied = edges.filter(is_reportable_bridge()).join(s, F.col("source_qualified") == F.col("_s")).join(t, F.col("target_qualified") == F.col("_t"))
    c1, c2 = changed_files.select(F.col("key").alias("_c1")), changed_files.select(F.col("key").alias("_c2"))
    told = tied.join(c1, F.col("source_file") == F.col("_c1"), "left").join(c2, F.col("target_file") == F.col("_c2"), "left")
    one = F.col("_c1").isNotNull() != F.col("_c2").isNotNull()
    return told.filter(one).select("source_qualified", "target_qualified", F.when(F.col("_c1").isNotNull(), "source").otherwise("target").alias("changed_side")).distinct()


def tests_to_run(nodes: DataFrame, edges: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Direct tests of changed code by test file, with a command."""
    changed = nodes.join(changed_files.select(F.col("key").alias("_f")), F.col("file_path") == F.col("_f"), "left_semi").select(F.col("qualified_name").alias("_c"))
    tests = edges.filter("kind = 'TESTED_BY'").join(changed, F.col("source_qualified") == F.col("_c"), "left_semi").select(F.col("target_qualified").alias("_t")).distinct()
    found = nodes.join(tests, F.col("qualified_name") == F.col("_t"), "left_semi")
    runner = F.when(paths.language_of(F.col("file_path")) == "python", F.lit("pytest ")).when(paths.language_of(F.col("file_path")) == "rust", F.lit("cargo test ")).when(paths.language_of(F.col("file_path")) == "go", F.lit("go test ")).otherwise(F.lit("run "))
    return found.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_tests")).select("file_path", "n_tests", F.concat(runner, "file_path").alias("command"))


def untested_changes(nodes: DataFrame, edges: DataFrame, changed_files: DataFrame, hops: int = 4) -> DataFrame:
    """Changed production functions that no test reaches within ``hops``: the tests' forward walk is taken once for all."""
    from ..operators import traversal

    tests = nodes.filter("kind = 'Test' OR is_test").select(F.col("qualified_name").alias("key"))
    forward = edges.filter("kind = 'CALLS'").select(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst")).unionByName(
        edges.filter("kind = 'TESTED_BY'").select(F.col("target_qualified").alias("src"), F.col("source_qualified").alias("dst"))
    )
    reached = traversal.walk(tests, forward, hops).select(F.col("key").alias("_r"))
    code = nodes.filter((F.col("kind") == "Function") & ~F.coalesce("is_test", F.lit(False)) & paths.is_production_path(F.col("file_path"), F.col("language")))
    changed = code.join(changed_files.select(F.col("key").alias("_f")), F.col("file_path") == F.col("_f"), "left_semi")
    return changed.join(reached, F.col("qualified_name") == F.col("_r"), "left_anti").select("qualified_name")


def marked_changes(now: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``now`` with ``change``: existing if ``base`` has the key, else added."""
    known = base.select(*[F.col(k).alias(f"_b_{k}") for k in keys]).distinct().withColumn("_has", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return now.join(known, same, "left").withColumn("change", F.when(F.col("_has"), "existing").otherwise("added")).drop("_has", *[f"_b_{k}" for k in keys])


def rename_sites(nodes: DataFrame, edges: DataFrame, old: str) -> DataFrame:
    """Sites a rename of ``old`` touches, one per (file, line): definition, call, reference, import, in this order."""
    definition = nodes.filter(F.col("qualified_name") == old).select("file_path", F.col("line_start").alias("line"), F.lit(0).alias("rank"), F.lit("EXACT").alias("tier"))
    tier = F.upper(F.coalesce(F.nullif(F.trim("confidence_tier"), F.lit("")), F.lit("EXTRACTED")))
    rank = F.when(F.col("kind") == "CALLS", 1).when(F.col("kind").isin("REFERENCES", "INHERITS", "IMPLEMENTS"), 2).when(F.col("kind") == "IMPORTS_FROM", 3)
    sites = edges.filter((F.col("target_qualified") == old) & rank.isNotNull()).select("file_path", "line", rank.alias("rank"), tier.alias("tier"))
    order = W.partitionBy("file_path", "line").orderBy("rank", "tier")
    kinds = F.array(*[F.lit(x) for x in ("definition", "call", "reference", "import")])
    return definition.unionByName(sites).withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("file_path", "line", F.element_at(kinds, F.col("rank") + 1).alias("site"), "tier")


def apply_rename(content: str, line: int, old: str, new: str) -> tuple[str, bool]:
    """One whole identifier on one line replaced; (text, whether anything changed). Files are not written here."""
    import re

    lines = content.split("\n")
    if not 0 < line <= len(lines):
        return content, False
    lines[line - 1], n = re.subn(rf"(?<![\w]){re.escape(old)}(?![\w])", new, lines[line - 1])
    return "\n".join(lines), n > 0


def preview_diff(path: str, before: str, after: str) -> str:
    import difflib

    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}"))
