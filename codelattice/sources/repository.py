"""Source trees as frames: listing, ignoring, languages, hashes, changes and diffs.

Listing and version control are asked on the driver (they are one command
each); reading, hashing and parsing are distributed.
"""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths

# fixed values
IGNORED = ["**/.git/**", "**/node_modules/**", "**/__pycache__/**", "**/.venv/**", "**/dist/**", "**/build/**", "**/target/**", "**/*.min.js", "**/*.lock"]
MAX_DEPENDENT_FILES = 500


def find_root(start: str) -> str:
    """Nearest directory upwards that is under version control, else the start itself."""
    at = Path(start).resolve()
    for p in [at, *at.parents]:
        if any((p / mark).exists() for mark in (".git", ".jj", ".svn")):
            return str(p)
    return str(at)


def version_controlled(root: str) -> list[str] | None:
    """Tracked and untracked files that are not ignored; None without version control."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, timeout=120)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return sorted({p for p in out.stdout.decode(errors="replace").split("\0") if p}) if out.returncode == 0 else None


def walked(root: str) -> list[str]:
    base = Path(root)
    return sorted(str(p.relative_to(base)) for p in base.rglob("*") if p.is_file() and ".git" not in p.parts)


def glob_regex(pattern: str) -> str:
    """A glob (``**``, ``*``, ``?``) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def not_ignored(path: Column, patterns: list[str]) -> Column:
    return ~path.rlike("|".join(glob_regex(p) for p in patterns)) if patterns else F.lit(True)


def scope(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """``path, language`` of the files to index."""
    files = version_controlled(root)
    listed = spark.createDataFrame([(p,) for p in (walked(root) if files is None else files)], "path string")
    language = paths.language_of(F.col("path"))
    return listed.filter(not_ignored(F.col("path"), IGNORED if patterns is None else patterns)).select("path", language.alias("language")).filter("language IS NOT NULL")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``file_path, content, file_hash, mtime_ns, size_bytes`` of a tree; paths are relative to the root."""
    base = Path(root).resolve().as_uri().rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select(
        F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:///"), f"^{re.escape(base)}", "").alias("file_path"), F.col("content").cast("string").alias("content"),
        F.sha2("content", 256).alias("file_hash"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"),
    )


def content_states(files: DataFrame, meta: DataFrame, trust_mtime: bool = True) -> DataFrame:
    """``file_path, state``: new, unchanged, touched (other time, same content), changed or removed.

    ``files`` and ``meta`` have file_path, file_hash and mtime_ns, one row per path.
    """
    old = meta.select(F.col("file_path").alias("_old"), F.col("file_hash").alias("_hash"), F.col("mtime_ns").alias("_mtime"))
    joined = files.select("file_path", "file_hash", "mtime_ns").join(old, F.col("file_path") == F.col("_old"), "full_outer")
    same_time = F.lit(trust_mtime) & F.col("mtime_ns").eqNullSafe(F.col("_mtime")) & F.col("mtime_ns").isNotNull() & (F.col("mtime_ns") > 0)
    state = (
        F.when(F.col("file_path").isNull(), "removed").when(F.col("_old").isNull(), "new").when(same_time, "unchanged")
        .when(F.col("file_hash").eqNullSafe(F.col("_hash")), F.when(F.col("mtime_ns").eqNullSafe(F.col("_mtime")), "unchanged").otherwise("touched")).otherwise("changed")
    )
    return joined.select(F.coalesce("file_path", "_old").alias("file_path"), state.alias("state"))


def changed_files(root: str, base: str) -> list[tuple[str, str]]:
    """(path, where it was seen: diff, staged, unstaged or untracked), first seen first."""
    asked = [("diff", ["diff", "--name-only", f"{base}...HEAD"]), ("staged", ["diff", "--name-only", "--cached"]), ("unstaged", ["diff", "--name-only"]), ("untracked", ["ls-files", "--others", "--exclude-standard"])]
    seen: dict[str, str] = {}
    for label, args in asked:
        out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=120)
        for p in out.stdout.splitlines() if out.returncode == 0 else []:
            seen.setdefault(p, label)
    return list(seen.items())


def renames(lines: DataFrame) -> DataFrame:
    """(old_path, new_path) from ``--name-status -M`` lines (a column ``line``)."""
    parts = F.split("line", "\t")
    return lines.filter(F.col("line").rlike(r"^R\d*\t")).select(parts[1].alias("old_path"), parts[2].alias("new_path"))


def diff_ranges(lines: DataFrame) -> DataFrame:
    """(diff, file_path, range_start, range_end) of the new side of unified diffs.

    ``lines`` has diff (which text), position and line. The file of a hunk is
    the last ``+++`` line above it; a hunk without a count has one line, one
    with count 0 (only deletions) the two lines around it.
    """
    name = F.regexp_extract("line", r'^\+\+\+ "?(?:b/)?(.*?)"?(?:\t.*)?$', 1)
    path = F.when(F.col("line").startswith("+++ "), F.when(F.col("line").startswith("+++ /dev/null"), F.lit("")).otherwise(name))
    order = W.partitionBy("diff").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    carried = lines.withColumn("file_path", F.last(path, ignorenulls=True).over(order))
    hunk = carried.filter(F.col("line").rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@") & (F.col("file_path") != ""))
    start = F.regexp_extract("line", r"\+(\d+)", 1).cast("long")
    count = F.nullif(F.regexp_extract("line", r"\+\d+,(\d+) @@", 1), F.lit("")).cast("long")
    n = F.coalesce(count, F.lit(1))
    return hunk.select("diff", "file_path", F.greatest(start, F.lit(1)).alias("range_start"), F.greatest(start, start + F.when(n == 0, 1).otherwise(n - 1)).alias("range_end"))
