"""String columns: identifiers, names, headings, signatures. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that make a symbol security-relevant, and words that only look so
SECURITY_PREFIXES = ["auth", "login", "password", "token", "session", "crypt", "secret", "credential", "permission", "sql", "execute", "encrypt", "decrypt"]
SECURITY_EXCLUDED = [
    "hashmap", "hashmaps", "hashset", "hashsets", "hashtable", "hashtables", "signal", "signals", "signaled", "signaling", "signalled", "signalling",
    "significant", "significance", "significantly", "signify", "author", "authors", "authored", "authoring", "authorship",
]
SEARCH_STOPWORDS = [
    "the", "a", "an", "is", "are", "for", "of", "to", "in", "on", "by", "with", "from", "and", "or", "not", "where", "how", "what", "which", "find", "show", "list", "all", "any",
    "this", "that", "these", "those", "it", "we", "do", "does", "did",
]


def identifier_words(text: Column) -> Column:
    """Lower-case words of an identifier (ASCII letters and digits), cut at marks, case changes, acronyms and digits."""
    spaced = F.regexp_replace(text, r"[^A-Za-z0-9]+", " ")
    spaced = F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Za-z])([0-9])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda w: w != "")


def words_match(words: Column, prefixes: list[str], excluded: list[str]) -> Column:
    """Whether a word starts with a prefix and neither it nor it joined with the next word is excluded."""
    following = F.concat(F.slice(words, 2, 10_000), F.array(F.lit("")))
    pairs = F.zip_with(words, following, lambda a, b: F.struct(a.alias("w"), F.concat(a, F.coalesce(b, F.lit(""))).alias("j")))
    starts = lambda w: F.expr("false") if not prefixes else _any([w.startswith(p) for p in prefixes])
    return F.exists(pairs, lambda p: starts(p["w"]) & ~p["w"].isin(excluded) & ~p["j"].isin(excluded))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def search_text(*columns: Column) -> Column:
    """Distinct identifier words of several columns as one string."""
    words = F.flatten(F.array(*[F.coalesce(identifier_words(c), F.array().cast("array<string>")) for c in columns]))
    return F.concat_ws(" ", F.array_distinct(words))


def sanitize_name(value: Column) -> Column:
    """Without control characters other than tab and newline, at most 256 characters."""
    return F.substring(F.regexp_replace(value, r"[\x00-\x08\x0b-\x1f]", ""), 1, 256)


def heading_level(line: Column) -> Column:
    """Number of leading marks of a heading, or null."""
    marks = F.regexp_extract(line, r"^(#{1,6})(\s|$)", 1)
    return F.when(marks != "", F.length(marks))


def slugify(heading: Column) -> Column:
    kept = F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N}\s_-]", "")
    return F.regexp_replace(kept, r"\s", "-")


def qualified_name(kind: Column, name: Column, file_path: Column, parent: Column) -> Column:
    """``file``, ``file::name`` or ``file::parent.name``."""
    inner = F.when(F.coalesce(parent, F.lit("")) != "", F.concat(parent, F.lit("."), name)).otherwise(name)
    return F.when(kind == "File", file_path).otherwise(F.concat(file_path, F.lit("::"), inner))


def target_leaf(target: Column) -> Column:
    """Last ``::`` segment."""
    return F.element_at(F.split(target, "::"), -1)


def endpoint_leaf(endpoint: Column) -> Column:
    """Last ``.`` part of the last ``::`` segment."""
    return F.substring_index(F.substring_index(endpoint, "::", -1), ".", -1)


def normal_namespace(value: Column) -> Column:
    dotted = F.regexp_replace(value, r"\\|::|/", ".")
    return F.array_join(F.filter(F.split(dotted, r"\."), lambda p: p != ""), ".")


def signature(kind: Column, name: Column, params: Column, returns: Column) -> Column:
    """``def name(params) -> returns``, ``class name`` or the name, at most 512 characters."""
    inner = F.regexp_replace(F.coalesce(params, F.lit("")), r"^\((.*)\)$", "$1")
    function = F.concat(F.lit("def "), name, F.lit("("), inner, F.lit(")"), F.when(F.coalesce(returns, F.lit("")) != "", F.concat(F.lit(" -> "), returns)).otherwise(F.lit("")))
    return F.substring(F.when(kind.isin("Function", "Test"), function).when(kind == "Class", F.concat(F.lit("class "), name)).otherwise(name), 1, 512)


def parameter_list(params: Column) -> Column:
    """Parameter names: defaults, annotations, reference marks and the receiver are dropped, of several words the last stays."""
    inner = F.regexp_replace(F.trim(F.coalesce(params, F.lit(""))), r"^\((.*)\)$", "$1")
    bare = F.transform(F.split(inner, ","), lambda p: F.trim(F.regexp_replace(F.substring_index(F.substring_index(F.trim(p), "=", 1), ":", 1), r"&|mut ", "")))
    return F.filter(F.transform(F.filter(bare, lambda p: ~p.isin("self", "cls")), lambda p: F.substring_index(p, " ", -1)), lambda p: p != "")


def parameter_shape(params: Column) -> Column:
    """Struct of the number of parameters and of those without a default."""
    inner = F.regexp_replace(F.coalesce(params, F.lit("")), r"^\s*\(|\)\s*$", "")
    real = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.isin("self", "cls", "this", "*", "/"))
    required = F.filter(real, lambda p: ~p.contains("=") & ~p.startswith("*") & ~p.startswith("..."))
    return F.struct(F.size(real).alias("total"), F.size(required).alias("required"))


def contains_word(haystack: Column, needle: Column) -> Column:
    """Whether ``needle`` stands in ``haystack`` with no ASCII letter or digit on either side; both in lower case."""
    quoted = F.regexp_replace(needle, r"([^A-Za-z0-9_])", r"\\$1")
    return F.rlike(haystack, F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))


def query_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)"), 1)


def identifiers_of(text: Column) -> Column:
    """Distinct snake_case or mixed-case words that are no stop words."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (w.contains("_") | w.rlike("^.+[A-Z]")) & ~F.lower(w).isin(SEARCH_STOPWORDS)))


def mixed_bigrams(text: Column) -> Column:
    """ASCII words and overlapping pairs of CJK characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1)
    runs = F.regexp_extract_all(text, F.lit("([\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+)"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))))
    return F.concat(words, pairs)


def normal_code(text: Column) -> Column:
    """Code without comments and layout."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
    bare = F.regexp_replace(bare, r"(?m)(//|#(?!include|define)).*$", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


# fixed values: what branches, what starts a comment line
BRANCH_TOKENS = [" if ", " elif ", " else ", " for ", " while ", " match ", " case ", " switch ", " catch ", " except ", "&&", "||", "?"]
COMMENT_MARKS = ["#", "//", '"""', "'''"]


def branch_lines(lines: Column) -> Column:
    """How many branching tokens the lines of an array hold, each token once a line."""
    def of(line: Column) -> Column:
        padded, total = F.concat(F.lit(" "), F.trim(line), F.lit(" ")), F.lit(0)
        for t in BRANCH_TOKENS:
            total = total + padded.contains(t).cast("int")
        return total

    return F.aggregate(lines, F.lit(0), lambda n, line: n + of(line))


def comment_lines(lines: Column) -> Column:
    """Comment lines of an array, those inside block comments included, blank ones not."""
    def step(acc: Column, line: Column) -> Column:
        bare = F.trim(line)
        marked = bare.startswith("/*")
        for m in COMMENT_MARKS:
            marked = marked | bare.startswith(m)
        opens = bare.startswith("/*") & ~bare.contains("*/")
        counts = (bare != "") & (acc["inside"] | marked)
        return F.struct((acc["n"] + counts.cast("int")).alias("n"), F.when(acc["inside"], ~bare.contains("*/")).otherwise(opens).alias("inside"))

    return F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside")), step, lambda acc: acc["n"])
