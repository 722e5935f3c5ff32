"""Files to nodes and edges.

Python is read with the standard library's parser, Markdown, notebooks and
Terraform JSON by their structure, other languages by declarations, imports and
calls a line shows. Extraction is one pass in Arrow batches; a file that cannot
be read still yields its File node.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import LANGUAGE_OF_SUFFIX

ROW = "row_type string, kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string, parent_name string, params string, return_type string, is_test boolean, source_qualified string, target_qualified string, line long, extra string"
FIELDS = [f.strip().split()[0] for f in ROW.split(",")]

# fixed values: what declares a function, a type and an import in a line of a language
DECLARATIONS = {
    "python": (r"^\s*(?:async\s+)?def\s+(\w+)\s*(\([^)]*\))?", r"^\s*class\s+(\w+)", r"^\s*(?:from|import)\s+([\w.]+)"),
    "rust": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)\s*(?:<[^>]*>)?\s*(\([^)]*\))?", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(\w+)", r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    "go": (r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*(\([^)]*\))?", r"^type\s+(\w+)\s+(?:struct|interface)", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"),
    "java": (r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*(\([^)]*\))", r"^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum|record)\s+(\w+)", r"^import\s+(?:static\s+)?([\w.]+)"),
    "kotlin": (r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*(\([^)]*\))?", r"^\s*(?:\w+\s+)*(?:class|interface|object)\s+(\w+)", r"^import\s+([\w.]+)"),
    "scala": (r"^\s*(?:\w+\s+)*def\s+(\w+)\s*(\([^)]*\))?", r"^\s*(?:\w+\s+)*(?:class|trait|object)\s+(\w+)", r"^import\s+([\w.]+)"),
    "csharp": (r"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async|abstract)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*(\([^)]*\))", r"^\s*(?:(?:public|private|internal|abstract|sealed|static|partial)\s+)*(?:class|interface|struct|enum|record)\s+(\w+)", r"^using\s+([\w.]+);"),
    "c": (r"^(?:static\s+|inline\s+|extern\s+)*[\w*]+[\s*]+(\w+)\s*(\([^;{]*\))\s*\{", r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)", r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]"),
    "cpp": (r"^(?:static\s+|inline\s+|virtual\s+)*[\w:<>*&]+[\s*&]+(?:\w+::)?(\w+)\s*(\([^;{]*\))\s*(?:const\s*)?\{", r"^\s*(?:class|struct|enum)\s+(\w+)", r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]"),
    "objc": (r"^[-+]\s*\([^)]*\)\s*(\w+)()", r"^@(?:interface|implementation|protocol)\s+(\w+)", r"^\s*#\s*import\s+[<\"]([^>\"]+)[>\"]"),
    "swift": (r"^\s*(?:\w+\s+)*func\s+(\w+)\s*(?:<[^>]*>)?\s*(\([^)]*\))?", r"^\s*(?:\w+\s+)*(?:class|struct|enum|protocol|actor)\s+(\w+)", r"^import\s+(\w+)"),
    "dart": (r"^\s*(?:[\w<>?]+\s+)(\w+)\s*(\([^)]*\))\s*(?:async\s*)?\{", r"^\s*(?:abstract\s+)?(?:class|mixin|enum)\s+(\w+)", r"^import\s+'([^']+)'"),
    "php": (r"^\s*(?:\w+\s+)*function\s+(\w+)\s*(\([^)]*\))?", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait|enum)\s+(\w+)", r"^use\s+([\w\\]+)"),
    "ruby": (r"^\s*def\s+(?:self\.)?(\w+[?!]?)\s*(\([^)]*\))?", r"^\s*(?:class|module)\s+([\w:]+)", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"),
    "lua": (r"^\s*(?:local\s+)?function\s+([\w.:]+)\s*(\([^)]*\))?", r"^(?!)", r"require\s*\(?['\"]([^'\"]+)['\"]"),
    "perl": (r"^\s*sub\s+(\w+)()", r"^\s*package\s+([\w:]+)", r"^\s*use\s+([A-Z][\w:]+)"),
    "r": (r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*(\([^)]*\))", r"^(?!)", r"^\s*(?:library|require)\(([\w.]+)\)"),
    "julia": (r"^\s*function\s+(\w+!?)\s*(\([^)]*\))?", r"^\s*(?:mutable\s+)?struct\s+(\w+)", r"^\s*(?:using|import)\s+([\w.]+)"),
    "elixir": (r"^\s*defp?\s+(\w+[?!]?)\s*(\([^)]*\))?", r"^\s*defmodule\s+([\w.]+)", r"^\s*(?:alias|import|use|require)\s+([\w.]+)"),
    "gdscript": (r"^\s*(?:static\s+)?func\s+(\w+)\s*(\([^)]*\))?", r"^class(?:_name)?\s+(\w+)", r"preload\(\"([^\"]+)\"\)"),
    "zig": (r"^\s*(?:pub\s+|export\s+)*fn\s+(\w+)\s*(\([^)]*\))?", r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:struct|enum|union)", r"@import\(\"([^\"]+)\"\)"),
    "bash": (r"^\s*(?:function\s+)?(\w+)\s*(\(\))\s*\{?", r"^(?!)", r"^\s*(?:source|\.)\s+(\S+)"),
    "powershell": (r"(?i)^\s*function\s+([\w-]+)\s*(\([^)]*\))?", r"(?i)^\s*class\s+(\w+)", r"(?i)^\s*import-module\s+(\S+)"),
    "javascript": (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*(\([^)]*\))?", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)", r"(?:from|import|require\()\s*['\"]([^'\"]+)['\"]"),
    "terraform": (r"^(?!)", r"^\s*(?:resource|data)\s+\"[^\"]+\"\s+\"([^\"]+)\"", r"^\s*source\s*=\s*\"([^\"]+)\""),
    "css": (r"^(?!)", r"^\.([\w-]+)\s*\{", r"@import\s+['\"]([^'\"]+)['\"]"),
}
SAME_AS = {"typescript": "javascript", "astro": "javascript"}
CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)*)\s*\(")
NOT_CALLS = frozenset("if for while switch return catch function fn func def class new sizeof match elif and or not in assert print when until unless require import include use pub static void int".split())
DIRECTIVE = re.compile(r"@(implements|tests|documents|covers|see)\s+([\w./:#-]+)")


def detect_language(path: str, first_line: str = "") -> str | None:
    suffix = path.rsplit("/", 1)[-1].rpartition(".")
    if suffix[0]:
        return LANGUAGE_OF_SUFFIX.get(suffix[2].lower())
    m = re.match(r"^#!.*?(?:/env\s+(?:-S\s+)?|/)([a-z]+)[0-9.]*(?:\s|$)", first_line)
    return {"python": "python", "bash": "bash", "sh": "bash", "node": "javascript", "ruby": "ruby", "perl": "perl"}.get(m.group(1)) if m else None


class Rows:
    """Collects the rows of one file."""

    def __init__(self, path: str, language: str | None, lines: int):
        self.path, self.language, self.rows = path, language, []
        self.test_file = bool(re.search(r"(^|/)(tests?|spec)/|(^|/)test_[^/]*$|_test\.\w+$|\.(test|spec)\.\w+$", path.lower()))
        self.node("File", path.rsplit("/", 1)[-1], path, 1, lines)

    def node(self, kind, name, qualified, start, end, parent=None, params=None, returns=None, extra=None):
        row = dict.fromkeys(FIELDS)
        row |= {"row_type": "node", "kind": kind, "name": name, "qualified_name": qualified, "file_path": self.path, "line_start": start, "line_end": end, "language": self.language}
        row |= {"parent_name": parent, "params": params, "return_type": returns, "is_test": kind == "Test" or self.test_file, "extra": json.dumps(extra or {})}
        self.rows.append(row)

    def symbol(self, kind, name, start, end, parent=None, **more):
        if not name.strip() or "\n" in name:
            return self.path
        qualified = f"{self.path}::{parent}.{name}" if parent else f"{self.path}::{name}"
        if kind == "Function" and self.test_file and name.lower().startswith("test"):
            kind = "Test"
        self.node(kind, name, qualified, start, end, parent, **more)
        self.edge("CONTAINS", f"{self.path}::{parent}" if parent else self.path, qualified, start)
        return qualified

    def edge(self, kind, source, target, line, extra=None):
        row = dict.fromkeys(FIELDS)
        row |= {"row_type": "edge", "kind": kind, "source_qualified": source, "target_qualified": target, "file_path": self.path, "line": line, "extra": json.dumps(extra or {})}
        self.rows.append(row)


def python_rows(path: str, text: str) -> list[dict]:
    out = Rows(path, "python", text.count("\n") + 1)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return line_rows(path, text, "python", out)

    def name_of(node) -> str:
        return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""

    def visit(node, owner: str, parent: str | None):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                extra = {"decorators": [ast.unparse(x) for x in child.decorator_list]} if child.decorator_list else None
                q = out.symbol("Function", child.name, child.lineno, child.end_lineno, parent, params=f"({ast.unparse(child.args)})", returns=ast.unparse(child.returns) if child.returns else None, extra=extra)
                visit(child, q, f"{parent}.{child.name}" if parent else child.name)
            elif isinstance(child, ast.ClassDef):
                q = out.symbol("Class", child.name, child.lineno, child.end_lineno, parent)
                for b in child.bases:
                    if name_of(b):
                        out.edge("INHERITS", q, name_of(b), child.lineno)
                visit(child, q, f"{parent}.{child.name}" if parent else child.name)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    out.edge("IMPORTS_FROM", path, a.name, child.lineno, {"import_scope": "module" if owner == path else "local"})
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                for a in child.names:
                    out.edge("IMPORTS_FROM", path, module, child.lineno, {"imported": a.name, "import_scope": "module" if owner == path else "local"})
            else:
                if isinstance(child, ast.Call) and name_of(child.func):
                    full = name_of(child.func)
                    out.edge("CALLS", owner, full.rpartition(".")[2], child.lineno, {"receiver": full.rpartition(".")[0]} if "." in full else None)
                visit(child, owner, parent)

    visit(tree, path, None)
    return directives(out, text, path)


def line_rows(path: str, text: str, language: str, out: Rows | None = None) -> list[dict]:
    """Declarations, imports and calls line by line; a call belongs to the last function above it."""
    out = out or Rows(path, language, text.count("\n") + 1)
    rules = DECLARATIONS.get(SAME_AS.get(language, language))
    if rules is None:
        return out.rows
    function, kind, imported = (re.compile(r) for r in rules)
    owner = path
    lines = text.split("\n")
    for number, line in enumerate(lines, 1):
        if m := kind.match(line):
            out.symbol("Class", m.group(1), number, number)
        elif m := function.match(line):
            if m.group(1) in NOT_CALLS:
                continue
            owner = out.symbol("Function", m.group(1), number, number, params=m.group(2) or None)
        elif m := imported.search(line):
            out.edge("IMPORTS_FROM", path, m.group(1), number)
        elif not re.match(r"\s*(//|#|\*|/\*|--)", line):
            for full in CALL.findall(line):
                leaf = re.split(r"\.|::", full)[-1]
                if leaf not in NOT_CALLS:
                    out.edge("CALLS", owner, leaf, number, {"receiver": full[: -len(leaf)].rstrip(".:")} if leaf != full else None)
    return directives(out, text, path)


def directives(out: Rows, text: str, source: str) -> list[dict]:
    for number, line in enumerate(text.split("\n"), 1):
        if _is_comment(line):
            for role, target in DIRECTIVE.findall(line):
                out.edge("CROSS_ARTIFACT", source, target, number, {"relationship_role": role, "evidence_kind": "directive"})
    return out.rows


def _is_comment(line: str) -> bool:
    return bool(re.match(r"\s*(#|//|/?\*|--|<!--|\"\"\")", line))


def slug(heading: str) -> str:
    return re.sub(r"\s", "-", re.sub(r"[^\w\s-]", "", heading.strip().lower()))


def markdown_target(raw: str, source: str) -> str | None:
    """A relative link as ``path`` or ``path::slug``; links that leave the tree are none."""
    import posixpath

    if re.match(r"^[a-z][a-z0-9+.-]*:|^//", raw, re.I):
        return None
    path, _, anchor = raw.partition("#")
    full = posixpath.normpath(posixpath.join(posixpath.dirname(source), path)) if path else source
    if full.startswith(".."):
        return None
    return f"{full}::{anchor}" if anchor else full


def masked(text: str) -> str:
    """Code blocks and spans blanked out, line by line, so that links in them are not links."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group(0))
    return re.sub(r"`[^`\n]+`", blank, re.sub(r"(?s)```.*?(```|$)", blank, text))


def markdown_rows(path: str, text: str) -> list[dict]:
    out = Rows(path, "markdown", text.count("\n") + 1)
    seen: dict[str, int] = {}
    section, hidden, block = path, masked(text).split("\n"), None
    lines = text.split("\n")
    for number, (line, clear) in enumerate(zip(lines, hidden), 1):
        if m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", clear):
            base = slug(m.group(2)) or "section"
            n = seen.get(base, 0)
            seen[base] = n + 1
            name = f"{base}-{n}" if n else base
            section, block = f"{path}::{name}", None
            out.node("DocSection", name, section, number, number, extra={"level": len(m.group(1)), "title": m.group(2)})
            out.edge("CONTAINS", path, section, number)
        elif line.strip():
            if block is None:
                block = f"{section}-body-{number}" if section != path else f"{path}::body-{number}"
                out.node("DocBody", block.rpartition("::")[2], block, number, number)
                out.edge("CONTAINS", section, block, number)
            out.rows[next(i for i in range(len(out.rows) - 1, -1, -1) if out.rows[i]["qualified_name"] == block)]["line_end"] = number
        else:
            block = None
        for raw in re.findall(r"(?<!!)\[[^\]]*\]\(([^)\s]+)\)", clear):
            if target := markdown_target(raw, path):
                out.edge("REFERENCES", section, target, number)
        for span in re.findall(r"`([A-Za-z_][\w.:]*)`", line):
            out.edge("CROSS_ARTIFACT", section, f"<unresolved:{span}>", number, {"evidence_kind": "code_span"})
    return out.rows


def notebook_rows(path: str, text: str) -> list[dict]:
    """Code cells as one Python text; magics are dropped."""
    try:
        cells = json.loads(text).get("cells", [])
        code = "\n".join("".join(c.get("source", [])) for c in cells if c.get("cell_type") == "code")
    except (ValueError, AttributeError, TypeError):
        return Rows(path, "notebook", text.count("\n") + 1).rows
    return python_rows(path, "\n".join("" if re.match(r"\s*[%!]", x) else x for x in code.split("\n")))


def databricks_rows(path: str, text: str) -> list[dict]:
    return python_rows(path, "\n".join("" if x.startswith("# MAGIC") else x for x in text.replace("# COMMAND ----------", "").split("\n")))


def fenced_rows(path: str, text: str, tag: str) -> list[dict]:
    """Script blocks of single-file components or fenced cells of notebooks, at their own lines."""
    pattern = r"(?s)<script[^>]*>(.*?)</script>" if tag == "script" else r"(?s)```\s*\{?\.?python[^\n]*\n(.*?)```"
    kept = ["" for _ in text.split("\n")]
    for m in re.finditer(pattern, text):
        first = text.count("\n", 0, m.start(1))
        for i, line in enumerate(m.group(1).split("\n")):
            kept[first + i] = line
    code = "\n".join(kept)
    return line_rows(path, code, "javascript") if tag == "script" else python_rows(path, code)


def terraform_json_rows(path: str, text: str) -> list[dict]:
    out = Rows(path, "terraform", text.count("\n") + 1)
    try:
        doc = json.loads(text)
    except ValueError:
        return out.rows
    for block in ("resource", "data", "module", "variable", "output"):
        for kind, entries in (doc.get(block) or {}).items() if isinstance(doc.get(block), dict) else []:
            named = entries.items() if block in ("resource", "data") and isinstance(entries, dict) else [("", entries)]
            for name, body in named:
                label = f"{kind}.{name}" if name else f"{block}.{kind}"
                q = out.symbol("Class", label, 1, 1, extra={"block": block})
                for ref in sorted(set(re.findall(r"\$\{([\w.]+)", json.dumps(body)))):
                    out.edge("REFERENCES", q, ref, 1)
    return out.rows


def extract(path: str, text: str, language: str | None = None) -> list[dict]:
    """Rows of one file."""
    language = (language or detect_language(path, text.partition("\n")[0]) or "").lower() or None
    if path.endswith(".tf.json"):
        return terraform_json_rows(path, text)
    if language == "python":
        return databricks_rows(path, text) if text.startswith("# Databricks notebook source") else python_rows(path, text)
    if language == "notebook":
        return notebook_rows(path, text)
    if language == "markdown":
        return markdown_rows(path, text) + (fenced_rows(path, text, "python")[1:] if "marimo" in text[:400] else [])
    if language in ("vue", "svelte"):
        return fenced_rows(path, text, "script")
    if language:
        return line_rows(path, text, language)
    return Rows(path, None, text.count("\n") + 1).rows


def _extract_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[f.strip().split()[1]] for f in ROW.split(",")]
    for batch in batches:
        rows = []
        for path, language, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            rows += extract(path, text or "", language)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(FIELDS, types)], names=FIELDS)


def extract_files(files: DataFrame, path: str = "file_path", language: str = "language", content: str = "content") -> DataFrame:
    """Nodes and edges of all files in one frame, told apart by ``row_type``."""
    return files.filter(F.col(path).isNotNull()).select(path, language, content).mapInArrow(_extract_batches, ROW)


def nodes_and_edges(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = extracted.filter("row_type = 'node'").select("kind", "name", "qualified_name", "file_path", "line_start", "line_end", "language", "parent_name", "params", "return_type", "is_test", "extra")
    edges = extracted.filter("row_type = 'edge'").select("kind", "source_qualified", "target_qualified", F.element_at(F.split("target_qualified", "::"), -1).alias("target_name"), "file_path", "line", "extra")
    return first_of(nodes, ["qualified_name"]), first_of(edges, ["kind", "source_qualified", "target_qualified", "file_path", "line"])


def first_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of every key, the same on every run: by a hash of the row."""
    order = W.partitionBy(*keys).orderBy(F.xxhash64(*df.columns))
    return df.withColumn("_first", F.row_number().over(order)).filter("_first = 1").drop("_first")
