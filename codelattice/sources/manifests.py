"""Build manifests to bridges between artifacts: who builds what from which sources."""

from __future__ import annotations

import json
import posixpath
import re
import shlex
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRIDGE = "extractor string, source_path string, target_path string, bridge_kind string, role string, name string"
MANIFESTS = ["Cargo.toml", "pyproject.toml", "setup.py", "setup.cfg", "package.json", "openapitools.json", "wrangler.toml", "wrangler.json", "CMakeLists.txt", "meson.build", "binding.gyp", "build.zig", "Makefile"]


def split_command(text: str) -> list[str]:
    try:
        return shlex.split(text)
    except ValueError:
        return text.split()


def _toml(text: str) -> dict:
    import tomllib

    try:
        return tomllib.loads(text)
    except (tomllib.TOMLDecodeError, ValueError):
        return {}


def _json(text: str) -> dict:
    try:
        value = json.loads(text)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def _join(base: str, rel: str) -> str:
    return posixpath.normpath(posixpath.join(base, rel))


def cargo(path: str, text: str) -> list[tuple]:
    doc, base = _toml(text), posixpath.dirname(path)
    lib = doc.get("lib") or {}
    name = lib.get("name") or (doc.get("package") or {}).get("name")
    if not name:
        return []
    kinds = lib.get("crate-type") or ["lib"]
    bridge = "wasm" if "wasm-bindgen" in (doc.get("dependencies") or {}) else "native" if "cdylib" in kinds else "crate"
    rows = [("cargo", path, _join(base, lib.get("path", "src/lib.rs")), bridge, "crate_root", name)]
    return rows + [("cargo", path, _join(base, b.get("path", f"src/bin/{b.get('name')}.rs")), "binary", "entry", b.get("name")) for b in doc.get("bin") or []]


def pyproject(path: str, text: str) -> list[tuple]:
    doc, base = _toml(text), posixpath.dirname(path)
    tool, rows = doc.get("tool") or {}, []
    if "maturin" in tool:
        m = tool["maturin"]
        rows.append(("maturin", path, _join(base, m.get("manifest-path", "Cargo.toml")), "native", "builds", m.get("module-name") or (doc.get("project") or {}).get("name")))
    for ext in (tool.get("setuptools-rust") or {}).get("ext-modules") or []:
        rows.append(("setuptools_rust", path, _join(base, ext.get("path", "Cargo.toml")), "native", "builds", ext.get("target")))
    for name, target in ((doc.get("project") or {}).get("scripts") or {}).items():
        rows.append(("scripts", path, target.partition(":")[0].replace(".", "/") + ".py", "script", "entry", name))
    return rows


def setup_py(path: str, text: str) -> list[tuple]:
    return [("setuptools_rust", path, _join(posixpath.dirname(path), p or "Cargo.toml"), "native", "builds", n) for n, p in re.findall(r"RustExtension\(\s*['\"]([\w.]+)['\"](?:[^)]*?path\s*=\s*['\"]([^'\"]+)['\"])?", text)]


def package_json(path: str, text: str) -> list[tuple]:
    doc, base, rows = _json(text), posixpath.dirname(path), []
    for key, command in (doc.get("scripts") or {}).items():
        if not isinstance(command, str):
            continue
        words = split_command(command)
        for flag in ("-o", "--output", "--out-dir", "--out"):
            if flag in words[:-1]:
                kind = "openapi" if any("openapi" in w for w in words) else "wasm" if any("wasm" in w or w == "asc" for w in words) else "generated"
                rows.append(("package_scripts", path, _join(base, words[words.index(flag) + 1]), kind, "generates", key))
    if isinstance(doc.get("main"), str):
        rows.append(("package_json", path, _join(base, doc["main"]), "module", "entry", doc.get("name")))
    for name, spec in {**(doc.get("dependencies") or {}), **(doc.get("devDependencies") or {})}.items():
        if isinstance(spec, str) and spec.startswith(("file:", "link:")):
            rows.append(("package_json", path, _join(base, spec.partition(":")[2]), "module", "consumes", name))
    return rows


def openapitools(path: str, text: str) -> list[tuple]:
    generators = ((_json(text).get("generator-cli") or {}).get("generators")) or {}
    base = posixpath.dirname(path)
    return [("openapitools", _join(base, str(g.get("inputSpec", ""))), _join(base, str(g.get("output", ""))), "openapi", "generates", name) for name, g in generators.items() if isinstance(g, dict) and g.get("output")]


def wrangler(path: str, text: str) -> list[tuple]:
    doc = _toml(text) if path.endswith(".toml") else _json(text)
    return [("wrangler", path, _join(posixpath.dirname(path), doc["main"]), "worker", "entry", doc.get("name"))] if isinstance(doc.get("main"), str) else []


def native_sources(path: str, text: str) -> list[tuple]:
    base, name = posixpath.dirname(path), path.rsplit("/", 1)[-1]
    found: list[tuple[str, str]] = []
    if name == "CMakeLists.txt":
        for lib, body in re.findall(r"add_library\(\s*(\w+)([^)]*)\)", text):
            found += [(lib, s) for s in re.findall(r"[\w./-]+\.(?:c|cc|cpp|cxx)\b", body)]
    elif name == "meson.build":
        for lib, body in re.findall(r"(?:shared_|static_)?library\(\s*'(\w+)'([^)]*)\)", text):
            found += [(lib, s) for s in re.findall(r"'([\w./-]+\.(?:c|cc|cpp))'", body)]
    elif name == "binding.gyp":
        for lib, body in re.findall(r"['\"]target_name['\"]\s*:\s*['\"](\w+)['\"](.*?)(?=['\"]target_name|\Z)", text, re.S):
            found += [(lib, s) for s in re.findall(r"['\"]([\w./-]+\.(?:c|cc|cpp))['\"]", body)]
    elif name == "build.zig":
        libs = re.findall(r"\.name\s*=\s*\"(\w+)\"", text)
        found += [(libs[0] if libs else "zig", s) for s in re.findall(r"\"([\w./-]+\.(?:zig|c))\"", text)]
    elif name == "Makefile":
        for line in recipe_commands(text):
            words = split_command(line)
            if "-shared" in words and "-o" in words[:-1]:
                out = words[words.index("-o") + 1]
                found += [(out.rsplit("/", 1)[-1].removeprefix("lib").partition(".")[0], s) for s in words if re.search(r"\.(c|cc|cpp|o)$", s)]
    return [("native_build", path, _join(base, s), "native", "builds", lib) for lib, s in found]


def recipe_commands(text: str) -> list[str]:
    """Commands of make recipes with continued lines joined and variables of the same file filled in."""
    joined = re.sub(r"\\\n\s*", " ", text)
    values = dict(re.findall(r"(?m)^(\w+)\s*[:?]?=\s*(.*)$", joined))
    fill = lambda line: re.sub(r"\$[({](\w+)[)}]", lambda m: values.get(m.group(1), ""), line)
    return [fill(line.strip().lstrip("@-")) for line in joined.split("\n") if line.startswith("\t")]


READERS = {"Cargo.toml": cargo, "pyproject.toml": pyproject, "setup.py": setup_py, "package.json": package_json, "openapitools.json": openapitools, "wrangler.toml": wrangler, "wrangler.json": wrangler}


def bridges_of(path: str, text: str) -> list[tuple]:
    return READERS.get(path.rsplit("/", 1)[-1], native_sources)(path, text)


def _bridge_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = [f.split()[0] for f in BRIDGE.split(", ")]
    for batch in batches:
        rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in bridges_of(p, t or "")]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=names)


def manifest_bridges(files: DataFrame) -> DataFrame:
    """Bridges of all manifests among ``files`` (file_path, content)."""
    name = F.element_at(F.split("file_path", "/"), -1)
    return files.filter(name.isin(MANIFESTS)).select("file_path", "content").mapInArrow(_bridge_batches, BRIDGE)
