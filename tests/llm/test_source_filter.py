import pytest

from codelattice.llm import queries, source_filter
from conftest import rows


@pytest.fixture(scope="module")
def machine():
    return source_filter.automaton(sorted({*source_filter.NOTICES, *source_filter.NOT_NOTICES, *source_filter.BANNERS}))


HAND = "import os\n\ndef load(path):\n    with open(path) as f:\n        return f.read()\n\n\ndef save(path, text):\n    with open(path, 'w') as f:\n        f.write(text)\n"
MEMBERS = "class Row:\n" + "".join(f"    def get_name_{i}(self):\n        return self._fields[{i}]\n" for i in range(12))
MINIFIED = "!function(e,t){" + "".join(f"var a{i}=t[{i}]||{{}};function f{i}(q,x){{return k.plugin(r)?q:{i}}}" for i in range(30)) + "}"
NUMBERS = "const W = [" + ", ".join(f"{(i * 37 % 101) / 17:.6f}" for i in range(120)) + "];\n"
BLOB = "DATA = '" + "qZ8kTb3xLw0Pr5Yv" * 40 + "'\n"


@pytest.mark.parametrize(
    ("path", "language", "text", "reason"),
    [
        ("r/src/a.py", "python", HAND, None),
        ("r/src/a.py", "python", "# Code generated by tool 1.2. DO NOT EDIT.\n" + HAND, "generated"),
        ("r/src/a.py", "python", "# Copyright us.\n# All warranties disclaimed.\n\n# @generated by x\n" + HAND, "generated"),
        ("r/src/a.c", "c", "/*\n * Automatisch erzeugt, nicht bearbeiten\n */\nint f(void) {\n  return 1;\n}\n", "generated"),
        ("r/src/a.py", "python", "# Unlike the generated client this one is kept by hand.\n" + HAND, None),
        ("r/src/a.py", "python", "# Ids are generated by the store; do not edit them in place.\n" + HAND, None),
        ("r/src/a.py", "python", HAND + "\n\ndef banner():\n    return 'Code generated by x. DO NOT EDIT.'\n", None),
        ("r/src/a.py", "python", MEMBERS, "generated"),
        ("r/vendor/lib/a.py", "python", HAND, "vendored"),
        ("r/src/vendor_portal/a.py", "python", HAND, None),
        ("r/lib/tool-1.2.3/a.py", "python", HAND, "vendored"),
        ("r/src/a.js", "javascript", "/*lib v2.0.8 | (c) the lib contributors | MIT */\nfunction f(a) {\n  return a;\n}\n", "vendored"),
        ("r/src/a.min.js", None, None, "minified"),
        ("r/src/a.js", "javascript", MINIFIED, "minified"),
        ("r/src/a.js", "javascript", NUMBERS, "data"),
        ("r/src/a.py", "python", BLOB, "data"),
        ("r/package-lock.json", None, "{}", "lockfile"),
        ("r/src/x_pb2.py", "python", None, "generated"),
        ("r/src/a.css", "css", "".join(f".item-{c} {{\n  margin: {i * 5 % 9}px;\n  color: #24d{i * 4 % 7};\n}}\n\n" for i, c in enumerate("abcdefgh")), None),
        ("r/vendor/README.md", "Markdown", "# Copied\n\nDo not edit.", None),
        ("r/src/empty.py", "python", "", None),
        ("r/src/null.py", None, None, None),
    ],
)
def test_reasons(machine, path, language, text, reason):
    assert source_filter.judge(path, language, text, machine)[2] == reason


def test_long_text_is_read_whole(machine):
    assert source_filter.judge("r/a.py", "python", HAND * 20_000, machine)[2] is None
    assert source_filter.judge("r/a.py", "python", HAND + NUMBERS * 2_000, machine)[2] == "data"


def test_copies_of_foreign_files_and_listing_by_nodes(spark, tables):
    files = spark.createDataFrame(
        [("r/vendor/x/a.py", "python", HAND, "z"), ("r/src/copy.py", "python", "# with another head\n\n" + HAND.replace("    ", "\t"), "z"), ("r/src/own.py", "python", HAND + "\nX = 1\n", "z"), ("r/src/marker.py", "python", "V = 1\n", "z"), ("r/deps/y/marker.py", "python", "V = 1\n", "z"), ("r/dist/unlisted.js", None, None, "z")],
        "file_path string, language string, content string, digest string",
    )
    nodes = spark.createDataFrame([("File", p, None, 1) for p in ("r/vendor/x/a.py", "r/src/copy.py", "r/src/own.py", "r/src/marker.py", "r/deps/y/marker.py", "r/node_modules/q/no_text.js")] + [("File", "r/src/copy.py", "Python", 2), ("Function", "r/dist/unlisted.js", None, 1), ("File", None, None, 1)], "kind string, file_path string, language string, reason int")
    d = tables(source_files=files, nodes=nodes)
    assert rows(queries.p1_reasons(spark, d)) == [("r/deps/y/marker.py", "vendored"), ("r/node_modules/q/no_text.js", "vendored"), ("r/src/copy.py", "copied"), ("r/vendor/x/a.py", "vendored")]
    d = tables(source_files=files.limit(0), nodes=nodes.limit(0))
    assert rows(queries.p1_found(spark, d)) == []
