import json
import subprocess

from codelattice.sources import extractors, manifests, repository
from conftest import rows

PY = '''import os
from .b import helper as h

class Base(Root):
    @cached
    def run(self, n: int = 1) -> str:
        return helper(n) + os.path.join("a")

async def main():
    # @implements docs/spec.md#start
    Base().run()
'''


def edges(found):
    return {(r["kind"], r["source_qualified"], r["target_qualified"]) for r in found if r["row_type"] == "edge"}


def names(found):
    return {(r["kind"], r["qualified_name"]) for r in found if r["row_type"] == "node"}


def test_python():
    found = extractors.extract("p/a.py", PY)
    assert names(found) == {("File", "p/a.py"), ("Class", "p/a.py::Base"), ("Function", "p/a.py::Base.run"), ("Function", "p/a.py::main")}
    assert {("CONTAINS", "p/a.py::Base", "p/a.py::Base.run"), ("INHERITS", "p/a.py::Base", "Root"), ("IMPORTS_FROM", "p/a.py", ".b"), ("CALLS", "p/a.py::Base.run", "helper"), ("CALLS", "p/a.py::main", "run"), ("CROSS_ARTIFACT", "p/a.py", "docs/spec.md#start")} <= edges(found)
    run = next(r for r in found if r["name"] == "run")
    assert run["params"] == "(self, n: int=1)" and run["return_type"] == "str" and json.loads(run["extra"]) == {"decorators": ["cached"]} and run["line_start"] == 6
    assert {k for k, _ in names(extractors.extract("tests/test_a.py", "def test_x():\n    pass\n"))} == {"File", "Test"}
    assert names(extractors.extract("p/bad.py", "def f(:\n  x")) == {("File", "p/bad.py"), ("Function", "p/bad.py::f")}


def test_markdown():
    text = "# A b!\n\nSee [x](../src/c.py) and [w](http://x.y) `run_it`.\n\n```\n# no\n[n](z.md)\n```\n\n# A b!\n- [s](#a-b)\n"
    found = extractors.extract("docs/r.md", text)
    assert {("DocSection", "docs/r.md::a-b"), ("DocSection", "docs/r.md::a-b-1")} <= names(found)
    got = edges(found)
    assert ("REFERENCES", "docs/r.md::a-b", "src/c.py") in got and ("REFERENCES", "docs/r.md::a-b-1", "docs/r.md::a-b") in got and ("CROSS_ARTIFACT", "docs/r.md::a-b", "<unresolved:run_it>") in got
    assert not any("z.md" in t or "http" in t for _, _, t in got)


def test_other_languages_and_containers():
    samples = {
        "a.rs": ("use crate::b;\npub fn run(x: i32) {\n    go(x);\n}\npub struct S { a: i32 }\n", {"run", "S"}, "go"),
        "a.go": ("import \"fmt\"\nfunc (s *T) Run(a int) error {\n\treturn call(a)\n}\ntype T struct {\n}\n", {"Run", "T"}, "call"),
        "A.java": ("import a.b;\npublic class A {\n    public int run(int x) {\n        return go(x);\n    }\n}\n", {"A", "run"}, "go"),
        "a.ts": ("import { x } from './y'\nexport function run(a) {\n  go(a)\n}\nexport class K {}\n", {"run", "K"}, "go"),
        "a.c": ("#include \"b.h\"\nstatic int run(int a) {\n  return go(a);\n}\n", {"run"}, "go"),
        "a.rb": ("require 'b'\nclass K\n  def run(a)\n    go(a)\n  end\nend\n", {"K", "run"}, "go"),
        "a.sh": ("run() {\n  x\n}\n", {"run"}, None), "a.zig": ("pub fn run(a: i32) void {\n  go(a);\n}\n", {"run"}, "go"), "a.ex": ("defmodule M.N do\n  def run(a) do\n    go(a)\n  end\nend\n", {"M.N", "run"}, "go"),
    }
    for path, (code, want, call) in samples.items():
        found = extractors.extract(path, code)
        assert want <= {r["name"] for r in found if r["row_type"] == "node"}, path
        assert call is None or any(k == "CALLS" and t == call for k, _, t in edges(found)), path
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["%magic\n", "def f():\n", "    g()\n"]}, {"cell_type": "markdown", "source": ["x"]}]})
    assert ("CALLS", "n.ipynb::f", "g") in edges(extractors.extract("n.ipynb", book))
    vue = "<template/>\n<script>\nfunction f() {\n  g()\n}\n</script>\n"
    found = extractors.extract("a.vue", vue)
    assert next(r for r in found if r["name"] == "f")["line_start"] == 3
    tf = json.dumps({"resource": {"bucket": {"b": {"name": "${var.x}"}}}, "module": {"m": {"source": "./m"}}})
    assert ("REFERENCES", "x.tf.json::bucket.b", "var.x") in edges(extractors.extract("x.tf.json", tf))
    assert names(extractors.extract("x.unknown", "abc")) == {("File", "x.unknown")} and extractors.extract("n.ipynb", "not json")[0]["kind"] == "File"


def test_extraction_as_frames(spark):
    df = spark.createDataFrame([("p/a.py", "Python", PY), ("p/n.py", "python", None), (None, "python", "x = 1"), ("p/e.go", None, "")], "file_path string, language string, content string")
    nodes, found = extractors.nodes_and_edges(extractors.extract_files(df))
    assert nodes.filter("kind = 'File'").count() == 3 and found.filter("kind = 'CALLS'").count() >= 3
    assert extractors.extract_files(df.limit(0)).count() == 0


def test_manifests(spark):
    files = [
        ("c/Cargo.toml", '[package]\nname = "core"\n[lib]\ncrate-type = ["cdylib"]\n'), ("pyproject.toml", '[project]\nname = "p"\n[project.scripts]\nrun = "p.cli:main"\n[tool.maturin]\nmanifest-path = "c/Cargo.toml"\n'),
        ("w/package.json", '{"name": "w", "main": "lib/i.js", "scripts": {"gen": "openapi-generator generate -o src/client"}, "dependencies": {"x": "file:../x"}}'), ("n/CMakeLists.txt", "add_library(fast SHARED src/a.c src/b.cpp)"),
        ("wrangler.toml", 'name = "edge"\nmain = "src/w.ts"\n'), ("Makefile", "CC = cc\nlib.so: a.c\n\t$(CC) -shared -o libfast.so \\\n\t  a.c\n"), ("bad/package.json", "{"), ("x/readme.md", "no"),
    ]
    got = {(r.extractor, r.target_path, r.role) for r in manifests.manifest_bridges(spark.createDataFrame(files, "file_path string, content string")).collect()}
    assert got == {("cargo", "c/src/lib.rs", "crate_root"), ("maturin", "c/Cargo.toml", "builds"), ("scripts", "p/cli.py", "entry"), ("package_scripts", "w/src/client", "generates"), ("package_json", "w/lib/i.js", "entry"), ("package_json", "x", "consumes"), ("native_build", "n/src/a.c", "builds"), ("native_build", "n/src/b.cpp", "builds"), ("wrangler", "src/w.ts", "entry"), ("native_build", "a.c", "builds")}


def test_tree_listing_reading_and_states(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "a.min.js").write_text("x")
    (tmp_path / "notes.xyz").write_text("x")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert rows(repository.scope(spark, str(tmp_path))) == [("src/a.py", "python")]
    assert repository.find_root(str(tmp_path / "src")) == str(tmp_path.resolve())
    files = repository.read_files(spark, str(tmp_path / "src"))
    assert {r.file_path: r.content for r in files.collect()} == {"a.py": "x = 1\n", "a.min.js": "x"}
    now = spark.createDataFrame([("a", "1", 5), ("b", "2", 6), ("c", "3", 0), ("d", "4", 9), ("n", "1", 1)], "file_path string, file_hash string, mtime_ns long")
    was = spark.createDataFrame([("a", "0", 5), ("b", "2", 7), ("c", "x", 0), ("d", "9", 8), ("gone", "1", 1)], now.schema)
    assert rows(repository.content_states(now, was)) == [("a", "unchanged"), ("b", "touched"), ("c", "changed"), ("d", "changed"), ("gone", "removed"), ("n", "new")]


def test_diff_ranges(spark):
    text = 'diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@ def f\n+a\n@@ -9 +12 @@\n-b\n@@ -20,3 +21,0 @@\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n--- "a/z q"\n+++ "b/z q"\n@@ -1 +1,2 @@\n'
    df = spark.createDataFrame([("d", i, line) for i, line in enumerate(text.split("\n"))], "diff string, position int, line string")
    assert rows(repository.diff_ranges(df).drop("diff")) == [("x", 12, 12), ("x", 21, 22), ("x", 3, 6), ("z q", 1, 2)]
    moves = spark.createDataFrame([("R090\told.py\tnew.py",), ("M\tx.py",)], "line string")
    assert rows(repository.renames(moves)) == [("old.py", "new.py")]
