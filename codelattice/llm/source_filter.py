"""Files that nobody wrote by hand: generated, minified, vendored, or data saved as code.

Generation notices and third-party banners are found in the file's comments by
one multi-pattern automaton; path rules name vendored directories, lockfiles
and minified or generated suffixes; the text itself shows minified code,
literal data and machine-numbered members. A file whose code equals that of a
file under a vendored directory or with a third-party banner is a copy of it,
wherever it lies; the comparison leaves comments and layout out.

Texts are read where they lie: only a path, the reasons and a 128-bit digest
leave the scan. A digest group never gathers its rows; it is folded to one flag
before it meets the files again.

Defined results: a null or empty text is judged by its path alone; a null path
is no file and is left out; prose (Markdown, reStructuredText, plain text) is
never a case; rows repeated with one path count once. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# --- fixed values: path rules ---

VENDORED_DIRECTORIES = [
    "node_modules", "bower_components", "jspm_packages", "vendor", "vendors", "_vendor", "vendored", "third_party", "third-party", "thirdparty",
    "3rdparty", "external", "externals", "extern", "deps", "site-packages", "dist-packages", "pods", "carthage", "godeps", "__pypackages__", "subprojects",
]
GENERATED_DIRECTORIES = ["generated", "__generated__", "_generated", "gen-src", "autogen", "codegen-out"]
GENERATED_DIRECTORY_PAIRS = [("build", "gen"), ("target", "generated-sources"), ("build", "generated")]
BUNDLE_DIRECTORIES = ["dist"]
BUNDLE_DIRECTORY_PAIRS = [("public", "build"), ("static", "build"), ("build", "static")]
VERSIONED_DIRECTORY = r"^[a-z][a-z0-9_.+-]*-v?\d+\.\d+(\.\d+)*([.-](alpha|beta|rc)\.?\d*)?$"
LOCKFILES = [
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "cargo.lock", "poetry.lock", "pdm.lock", "uv.lock",
    "pipfile.lock", "gemfile.lock", "composer.lock", "go.sum", "mix.lock", "flake.lock", "podfile.lock", "packages.lock.json", "gradle.lockfile", "pubspec.lock",
]
MINIFIED_NAME = r"([.-]min\.(js|mjs|cjs|css)|\.bundle\.(js|css)|\.chunk\.(js|css)|\.[0-9a-f]{8,20}\.(js|mjs|css)|\.(js|css)\.map)$"
GENERATED_NAME = (
    r"(\.generated\.[a-z]+|_generated\.[a-z]+|\.gen\.[a-z]+|_gen\.go|\.pb\.(go|cc|h|rs|swift)|_pb2(_grpc)?\.pyi?|\.pb\.dart|\.g\.(dart|cs|ts)"
    r"|\.freezed\.dart|\.designer\.(cs|vb)|outerproto(\.generated)?\.java|outerclass\.java|grpc\.java|_pb\.(js|ts|rb)|\.g\.i?\.cs|_mock\.gen\.go"
    r"|_string\.go|_easyjson\.go|bindata\.go|\.tab\.[ch]|\.yy\.[ch]|lex\.yy\.c|y\.tab\.[ch])$"
)
PROSE_SUFFIX = r"\.(md|mdx|markdown|rst|txt|adoc|asciidoc|org|tex)$"
PROSE_LANGUAGES = ["markdown", "restructuredtext", "rst", "text", "plaintext", "asciidoc", "org", "latex"]

# --- fixed values: notices, in lower case ---

NOTICES = [
    "@generated", "<auto-generated", "auto-generated file", "auto-generated by", "auto-generated from", "autogenerated from", "autogenerated by", "autogenerated file", "code generated by", "code generated with",
    "automatically generated", "machine generated", "machine-generated", "generated code", "generated file", "generated with", "generated from", "file is generated", "file was generated",
    "changes will be lost", "manual edits are overwritten", "edits will be lost", "do not modify by hand", "edit the template instead", "produced automatically",
    "produit automatiquement", "généré automatiquement", "automatisch erzeugt", "automatisch generiert", "generado automáticamente", "generato automaticamente", "自動生成",
    "generated by", "do not edit", "do not modify", "ne pas modifier", "nicht bearbeiten", "no modificar", "編集しないでください",
]
# said about something else than the file itself
NOT_NOTICES = ["unlike the generated", "kept by hand", "are generated by", "generated client", "generated files", "not generated"]
WEAK_NOTICES = ["generated by", "do not edit", "do not modify"]
BANNERS = [
    "upstream copy", "imported from", "vendored from", "copied from upstream", "bundled from", "contributors | mit", "contributors | bsd", "contributors | apache",
    "| mit */", "| mit", "| bsd", "| apache-2.0", "bsd-3-clause", "bsd-2-clause", "(c) the", "released under the mit", "mit license", "apache license", "mozilla public license", "/*!", "# !",
]
STRONG_BANNERS = ["upstream copy", "vendored from", "copied from upstream", "bundled from", "contributors | mit", "contributors | bsd", "contributors | apache"]
VERSION_IN_BANNER = r"\bv?\d+\.\d+(\.\d+)+\b"

# --- parameters ---

MINIFIED_MEAN_LINE = 200  # characters of code a line
MINIFIED_SPACES = 0.08  # share of blanks in such code
DATA_SHARE = 0.5  # share of literal data in the non-blank text
NUMBERED_SHARE = 0.6  # share of lines that repeat one shape with ascending numbers
COPY_LEAST = 60  # characters of code from which equal code counts as a copy

REASONS = "path string, prose boolean, reason string, third_party boolean, code_length long, digest string"

_COMMENT = re.compile(r"^\s*(//|#(?!include|define|if|ifdef|ifndef|endif|pragma|else|undef|error)|/\*|\*|--|<!--|;;|%|\"\"\"|''')")
_WORD = re.compile(r"[A-Za-z_$][A-Za-z_$]*")
_NUMBER = re.compile(r"\d+")
_BLOB = re.compile(r"[A-Za-z0-9+/=]{60,}")
_LITERAL = re.compile(r"0x[0-9a-fA-F]+|\\x[0-9a-fA-F]{2}|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|(?<![A-Za-z0-9_])(?=[0-9a-f]*\d)[0-9a-f]{6,}(?![A-Za-z0-9_])")
_NAMED_BLANK = re.compile(r"\s+")


def automaton(patterns: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for p in patterns:
        machine.add_word(p, p)
    machine.make_automaton()
    return machine


def path_reason(path: str) -> str | None:
    """Why a path alone shows that nobody wrote the file by hand."""
    parts = path.lower().replace("\\", "/").split("/")
    name, folders = parts[-1], parts[:-1]
    if name in LOCKFILES:
        return "lockfile"
    for folder in folders:
        if folder in VENDORED_DIRECTORIES:
            return "vendored"
        if re.match(VERSIONED_DIRECTORY, folder):
            return "vendored"
    if re.search(MINIFIED_NAME, name):
        return "minified"
    pairs = list(zip(folders, folders[1:]))
    if any(f in BUNDLE_DIRECTORIES for f in folders) or any(p in BUNDLE_DIRECTORY_PAIRS for p in pairs):
        return "minified"
    if any(f in GENERATED_DIRECTORIES for f in folders) or any(p in GENERATED_DIRECTORY_PAIRS for p in pairs) or re.search(GENERATED_NAME, name):
        return "generated"
    return None


def split_comments(text: str) -> tuple[list[str], list[str]]:
    """Comment lines of the header (those before the first code and any that follow directly) and the code lines of the whole text."""
    header, code, in_block, started = [], [], False, False
    for line in text.split("\n"):
        bare = line.strip()
        if in_block:
            in_block = "*/" not in bare
            if not started:
                header.append(bare)
            continue
        if not bare:
            continue
        if _COMMENT.match(line):
            if bare.startswith("/*") and "*/" not in bare:
                in_block = True
            tail = bare.partition("*/")[2].strip() if bare.startswith("/*") and "*/" in bare else ""
            if not started:
                header.append(bare[: len(bare) - len(tail)] if tail else bare)
            if tail:
                code.append(tail)
                started = True
            continue
        started = True
        code.append(line.rstrip())
    return header, code


def notice_reason(header: list[str], machine) -> tuple[str | None, bool]:
    """(reason, third party?) told by the header comments."""
    third = False
    for line in header:
        low = line.lower()
        hits = {p for _, p in machine.iter(low)}
        if not hits:
            continue
        notices = hits.intersection(NOTICES)
        if notices and not hits.intersection(NOT_NOTICES):
            if notices - set(WEAK_NOTICES) or len(notices) > 1 or low.lstrip("/#*- ").startswith(("generated by", "do not")):
                return "generated", False
        banners = hits.intersection(BANNERS)
        if banners and (banners.intersection(STRONG_BANNERS) or re.search(VERSION_IN_BANNER, low)):
            third = True
    return ("vendored", True) if third else (None, False)


def numbered_share(code: list[str]) -> float:
    """Share of code lines whose shape was seen before with a number one lower: the members a program numbers."""
    last: dict[str, int] = {}
    run: dict[str, int] = {}
    lines: dict[str, int] = {}
    for line in code:
        numbers = _NUMBER.findall(line)
        shape = _WORD.sub("w", _NUMBER.sub("0", line))
        lines[shape] = lines.get(shape, 0) + 1
        if not numbers:
            continue
        first = int(numbers[0][:9])
        if shape in last and first == last[shape] + 1:
            run[shape] = run.get(shape, 1) + 1
        last[shape] = first
    # shapes that follow a count, and shapes that come with every member of one
    counted = sum(n for n in run.values() if n >= 4)
    if not counted:
        return 0.0
    longest = max(run.values())
    with_each = sum(n for s, n in lines.items() if s not in run and longest * 0.8 <= n <= longest * 1.2 + 1)
    return min(1.0, (counted + with_each) / max(1, len(code)))


def content_reason(code: list[str]) -> str | None:
    """Why the code itself shows that it is data, minified or machine-made."""
    text = "\n".join(code)
    solid = len(_NAMED_BLANK.sub("", text))
    if solid < 80:
        return None
    blobs = sum(len(m) for m in _BLOB.findall(text))
    literals = sum(len(m) for m in _LITERAL.findall(text))
    punctuation = sum(text.count(c) for c in ",;[]{}\"':-`") * 0.5
    css = text.count("{") > 2 and text.count(":") >= text.count("{") and ";" in text and "=" not in text
    if (blobs + literals) / solid >= DATA_SHARE or (not css and literals / solid >= 0.3 and (literals + blobs + punctuation) / solid >= 0.5):
        return "data"
    mean = len(text) / len(code)
    blanks = 1 - solid / len(text)
    if mean >= MINIFIED_MEAN_LINE and blanks <= MINIFIED_SPACES:
        return "minified"
    if numbered_share(code) >= NUMBERED_SHARE:
        return "generated"
    return None


def judge(path: str, language: str | None, text: str | None, machine) -> tuple:
    """One row of ``REASONS`` for a file."""
    import hashlib

    prose = bool(re.search(PROSE_SUFFIX, path.lower())) or (language or "").strip().lower() in PROSE_LANGUAGES
    if prose:
        return path, True, None, False, 0, None
    by_path = path_reason(path)
    header, code = split_comments(text or "")
    by_notice, banner = notice_reason(header, machine)
    solid = _NAMED_BLANK.sub("", "".join(code))
    reason = by_path or by_notice or content_reason(code)
    digest = hashlib.blake2b(solid.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if len(solid) >= COPY_LEAST else None
    return path, False, reason, banner or by_path == "vendored", len(solid), digest


def _judge_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    machine = automaton(sorted({*NOTICES, *NOT_NOTICES, *BANNERS}))
    names = ["path", "prose", "reason", "third_party", "code_length", "digest"]
    types = [pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        rows = [judge(p, lang, text, machine) for p, lang, text in zip(*columns)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def classify_sources(files: DataFrame, path: str = "file_path", language: str = "language", content: str = "content") -> DataFrame:
    """``path, reason`` of every file that is not hand-written; reasons are lockfile, vendored, copied, minified, generated and data."""
    texts = files.filter(F.col(path).isNotNull()).select(F.col(path).alias("p"), F.col(language).alias("l"), F.col(content).alias("c"))
    judged = cut(texts.mapInArrow(_judge_batches, REASONS).filter(~F.col("prose")))  # texts are read once; what goes on is narrow
    # a digest is foreign if any of its files is; one flag per digest, folded before the exchange
    foreign = judged.filter(F.col("third_party") & F.col("digest").isNotNull()).select(F.col("digest").alias("_digest")).distinct()
    told = judged.join(foreign, F.col("digest") == F.col("_digest"), "left")
    reason = F.coalesce(F.col("reason"), F.when(F.col("_digest").isNotNull(), F.lit("copied")))
    return told.select("path", reason.alias("reason")).filter(F.col("reason").isNotNull()).distinct()
