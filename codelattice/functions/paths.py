"""Path columns: packages, suffixes, languages and kinds of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: language of a suffix and family of a language
LANGUAGE_OF_SUFFIX = {
    "py": "python", "pyi": "python", "ipynb": "notebook", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "cs": "csharp",
    "c": "c", "h": "c", "xs": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "m": "objc", "mm": "objc", "swift": "swift", "dart": "dart",
    "php": "php", "rb": "ruby", "lua": "lua", "pl": "perl", "pm": "perl", "r": "r", "jl": "julia", "ex": "elixir", "exs": "elixir", "gd": "gdscript", "zig": "zig",
    "sh": "bash", "bash": "bash", "ps1": "powershell", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript",
    "tsx": "typescript", "vue": "vue", "svelte": "svelte", "astro": "astro", "tf": "terraform", "md": "markdown", "markdown": "markdown", "css": "css",
}
FAMILY_OF_SUFFIX = {
    "py": "python", "pyi": "python", "ipynb": "python", "rs": "rust", "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hh": "c", "hpp": "c", "hxx": "c", "m": "c", "mm": "c",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "javascript", "tsx": "javascript", "mts": "javascript", "cts": "javascript", "vue": "javascript",
    "svelte": "javascript", "java": "jvm", "kt": "jvm", "kts": "jvm", "scala": "jvm", "sc": "jvm", "cs": "csharp", "go": "go", "rb": "ruby", "php": "php", "swift": "swift", "dart": "dart",
    "lua": "lua", "pl": "perl", "pm": "perl", "r": "r", "jl": "julia", "ex": "elixir", "exs": "elixir", "zig": "zig", "gd": "gdscript", "sh": "bash", "bash": "bash", "zsh": "bash",
}
TEST_PARTS = ["tests", "test", "__tests__", "spec", "testdata"]
NON_PRODUCTION_PARTS = ["examples", "example", "benches", "bench", "fixtures", "generated", "vendor"]
NON_PRODUCTION_NAMES = ["build.rs", "setup.py", "conftest.py"]
CODE_LANGUAGES = [
    "python", "rust", "typescript", "tsx", "javascript", "go", "java", "kotlin", "scala", "c", "cpp", "csharp", "objc", "swift", "ruby", "php", "perl", "lua", "dart", "elixir", "julia",
    "r", "zig", "gdscript", "bash", "vue",
]
TEST_NAME = r"(^|/)test_[^/]*$|_test\.[^/]*$|\.test\.[^/]*$|\.spec\.[^/]*$|(^|/)conftest\.py$"


def suffix(path: Column) -> Column:
    """Last suffix of the file name in lower case, empty for none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF_SUFFIX.items() for x in pair])
    return F.try_element_at(table, suffix(path))


def shebang_language(first_line: Column) -> Column:
    program = F.regexp_extract(first_line, r"^#!.*?(?:/env\s+(?:-S\s+)?|/)([A-Za-z]+)[0-9.]*(?:\s|$)", 1)
    return F.when(program == "python", "python").when(program.isin("sh", "bash", "zsh", "dash"), "bash").when(program == "node", "javascript").when(program.isin("ruby", "perl", "php", "lua"), program)


def family_of(path: Column) -> Column:
    """Languages that call each other by name share a family; null for unknown suffixes."""
    table = F.create_map(*[F.lit(x) for pair in FAMILY_OF_SUFFIX.items() for x in pair])
    return F.try_element_at(table, suffix(path))


def same_family(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def package_of(path: Column) -> Column:
    """Parent directory, ``<root>`` for none."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("<root>"))


def parts_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def has_part(path: Column, parts: list[str]) -> Column:
    return path.rlike(f"(^|/)({'|'.join(parts)})(/|$)")


def is_test_path(path: Column) -> Column:
    """A test by its folder or name; in Go only ``_test.go`` names one."""
    named = F.when(path.endswith(".go"), path.endswith("_test.go")).otherwise(path.rlike(TEST_NAME))
    return has_part(path, TEST_PARTS) | named


def is_production_path(path: Column, language: Column | None = None) -> Column:
    """Neither test nor build script, example, bench, fixture or generated file; with a language, one of code."""
    name = F.substring_index(path, "/", -1)
    other = has_part(path, NON_PRODUCTION_PARTS) | name.isin(NON_PRODUCTION_NAMES) | name.contains("_pb2") | name.contains(".generated.")
    code = F.lit(True) if language is None else F.coalesce(F.lower(language).isin(CODE_LANGUAGES), F.lit(False))
    return ~is_test_path(path) & ~other & code


def is_documentation(language: Column, path: Column) -> Column:
    return (F.lower(F.coalesce(language, F.lit(""))) == "markdown") | suffix(path).isin("md", "markdown", "rst", "adoc")


def looks_like_file(target: Column) -> Column:
    """Path-shaped target: no scope mark, and a slash or a known suffix."""
    known = suffix(target).isin(sorted(LANGUAGE_OF_SUFFIX))
    return ~target.contains("::") & ~target.startswith("<") & (target.contains("/") | known)


def direct_children(path: Column, directory: str) -> Column:
    prefix = directory.rstrip("/") + "/" if directory else ""
    return path.startswith(prefix) & ~F.substr(path, F.lit(len(prefix) + 1)).contains("/")


def ancestors(path: Column) -> Column:
    """All directories above a path, deepest last."""
    p = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
