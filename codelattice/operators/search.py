"""Full-text, keyword, vector and hybrid search.

Full-text search asks a stored index (``textindex``) or, for a frame that has
none, postings made on the spot. Scores are sums of integers (millionths), so
they do not depend on the order of the sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from . import ranking, textindex

# fixed values: weight of each field
FIELD_WEIGHTS = {"name": 8, "qualified_name": 6, "file_path": 3, "signature": 4, "identifier_tokens": 5, "doc_text": 1}
K1, B = 1.2, 0.75
UNIT = 1_000_000
# fixed values: words that show what a query asks for
ASKING_WORDS = {
    "doc": ["documentation", "readme", "usage", "guide", "section", "instructions"],
    "purpose": ["behavior", "feature", "goal", "handles", "logic", "purpose", "responsible", "supports", "workflow"],
    "code": ["code", "function", "implementation", "implements", "logic", "helper", "wrapper", "path", "handler", "method", "class", "rust", "python", "typescript", "test", "tests"],
    "test": ["test", "tests", "coverage", "proves"],
    "process": [
        "assigns", "branches", "builds", "calls", "computes", "converts", "creates", "deletes", "detects", "embedding", "embeddings", "embeds", "fetches", "filters", "inserts", "iterates", "loads", "loops",
        "merges", "opens", "parses", "queries", "ranks", "reads", "rebuilds", "renders", "returns", "searches", "stores", "tested", "updates", "uses", "validates", "writes",
    ],
}
# fixed values: the intent of a query, the first whose signs are all there
INTENTS = [("empty", {"blank"}), ("exact", {"names"}), ("documentation", {"doc"}), ("process_pattern", {"process"}), ("purpose", {"phrase"}), ("purpose", {"purpose"}), ("exact", set())]
# fixed values: factors of a hit, where the query shows all signs (and none after "not") and the hit the property
BOOSTS = [
    ("", "text_top3", 1.25), ("", "text_top1", 1.15), ("", "vector_top1", 1.3), ("", "in_both", 1.15),
    ("is:process_pattern", "in_vector", 1.55), ("is:process_pattern", "vector_top5", 1.35), ("is:process_pattern", "vector_6_to_20", 1.15), ("is:process_pattern", "code", 1.6),
    ("is:process_pattern", "function", 1.25), ("is:process_pattern", "document", 0.18), ("is:process_pattern not test", "test", 0.55),
    ("is:purpose", "in_both", 1.4), ("is:purpose", "one_arm_vector_top5", 1.15), ("is:purpose", "code", 1.1), ("is:purpose not doc", "document", 0.75), ("is:purpose code not doc", "document", 0.55),
    ("code not doc", "document", 0.45), ("code not doc", "code_no_document", 1.18), ("doc", "section", 1.35), ("doc", "document_no_section", 1.15), ("test", "test_or_in_tests", 1.55),
    ("", "named_code", 1.7), ("", "named_other", 1.3),
]
SHAPES = [("^[A-Z][a-z]", "Class", 1.5), ("^[A-Z][a-z]", "Type", 1.5), ("(?=.*_)(?=.*[A-Za-z])", "Function", 1.5), ("[.]", "_qualified", 2.0)]  # shape of a query, kind it suggests, factor
TEST_FACTOR, CONTEXT_FACTOR = 0.6, 1.5
COMMON_QUERY_WORDS = ["get", "set", "the", "function", "class", "method", "file", "code", "test", "data", "value", "name", "type", "list", "add", "run"]


def node_fields(nodes: DataFrame) -> DataFrame:
    """The six indexed texts of every node."""
    signature = F.coalesce("signature", text.signature(F.col("kind"), F.col("name"), F.col("params"), F.col("return_type")))
    described = F.concat_ws(" ", F.col("kind"), F.col("name"), F.col("parent_name"), F.col("language"))
    return nodes.select("id", "kind", "name", "qualified_name", "file_path", signature.alias("signature"), text.search_text(F.col("name"), F.col("parent_name")).alias("identifier_tokens"), described.alias("doc_text"))


def postings(docs: DataFrame, doc: str, fields: dict[str, int]) -> DataFrame:
    """``term, doc, tf, dl``: weighted occurrences of every term and the length of its document."""
    return textindex.term_rows(docs, doc, fields)[0].select("term", "doc", "tf", "dl")


class FrameIndex:
    """The postings of a frame, not stored: for tables that are asked once."""

    def __init__(self, docs: DataFrame, doc: str, fields: dict[str, int]):
        posted, self._documents = textindex.term_rows(docs, doc, fields)
        self._posted = posted.select("term", "doc", "tf", "dl")

    def postings(self, words: list[str]) -> DataFrame:
        return self._posted.filter(F.col("term").isin(words))

    def totals(self) -> DataFrame:
        return self._documents.filter("dl > 0").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("sum_dl"))


def plan_query(query: str) -> tuple[list[str], str]:
    """Terms of a query and the most selective of them: uncommon first, then longest, then last in the alphabet."""
    words = textindex.query_terms(query)
    best = max(words, key=lambda w: (w not in COMMON_QUERY_WORDS, len(w), w)) if words else ""
    return words, best


def bm25(index, words: list[str], k: int, require_all: bool = False) -> DataFrame:
    """``doc, score`` (millionths) of the k best documents of a stored or frame index; ties by document."""
    hits = index.postings(words)
    df = hits.groupBy(F.col("term").alias("_t")).agg(F.count(F.lit(1)).alias("df"))  # a row per asked word
    told = hits.join(F.broadcast(df), F.col("term") == F.col("_t"))
    told = told.withColumn("_all", index.totals().select(F.struct("n_docs", "sum_dl")).scalar())
    idf = F.log(1 + (F.col("_all.n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - B + B * F.col("dl") * F.col("_all.n_docs") / F.col("_all.sum_dl")
    score = F.floor(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length) * UNIT + 0.5).cast("long")
    folded = told.groupBy("doc").agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("n_terms"))
    if require_all:
        folded = folded.filter(F.col("n_terms") == len(words))
    return folded.select("doc", "score").orderBy(F.desc("score"), "doc").limit(k)


def keyword_search(nodes: DataFrame, query: str, k: int) -> DataFrame:
    """Nodes whose name holds every word; 3 for the whole name, 2 for its start, 1 else; stable order."""
    words = [w for w in query.lower().split() if w]
    name = F.lower(F.col("name"))
    test, score = F.lit(bool(words)), F.lit(0)
    for w in words:
        test = test & name.contains(w)
        score = score + F.when(name == w, 3).when(name.startswith(w), 2).otherwise(1)
    return nodes.filter(test).select("id", "qualified_name", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fts_search(index, query: str, k: int) -> tuple[DataFrame, str]:
    """All words first; if nothing has them all, any word; the mode tells which."""
    words, _ = plan_query(query)
    if not words:
        return bm25(index, words, k), "none"
    every = bm25(index, words, k, require_all=True)
    if len(words) == 1 or not every.isEmpty():
        return every, "phrase" if len(words) == 1 else "and"
    return bm25(index, words, k), "or"


def cosine_scores(vectors: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    """Cosine of every row with one query in Arrow batches; rows of another length or without a norm have none."""
    def score(batches):
        import numpy as np
        import pyarrow as pa

        q = np.asarray(query, "f8")
        q = q / max(np.sqrt((q * q).sum()), 1e-300)
        for batch in batches:
            at = batch.schema.get_field_index(vector)
            lists = batch.column(at)
            flat = lists.flatten()
            ends = np.cumsum(np.where(np.asarray(lists.is_null()), 0, np.asarray(lists.value_lengths().fill_null(0))))
            sizes = np.diff(np.concatenate([[0], ends]))
            take = np.flatnonzero(sizes == len(q))
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            x = values[(ends[take] - len(q))[:, None] + np.arange(len(q))] if len(take) else np.empty((0, len(q)))
            norm = np.sqrt((x * x).sum(1))
            good = (norm > 0) & np.isfinite(norm)
            out, known = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
            out[take[good]], known[take[good]] = x[good] @ q / norm[good], True
            keep = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.float64(), mask=~known)], names=[*names, "similarity"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != vector)
    return vectors.mapInArrow(score, f"{fields}, similarity double").filter("similarity IS NOT NULL")


def cosine_top_k(vectors: DataFrame, key: str, query: list[float], k: int, vector: str = "vector") -> DataFrame:
    return cosine_scores(vectors.select(key, vector), query, vector).orderBy(F.desc("similarity"), key).limit(k)


def query_words(query: str) -> set[str]:
    import re

    return {w.lower() for w in re.findall("[A-Za-z0-9_]+", query)}


def query_signs(query: str) -> set[str]:
    """What a query shows: kinds of words it holds, whether it names something, is blank or has several words."""
    import re

    words, spelled = query_words(query), re.findall("[A-Za-z0-9_]+", query)
    signs = {name for name, known in ASKING_WORDS.items() if words & set(known)}
    telling = (w for w in re.findall("[A-Za-z_][A-Za-z0-9_]+", query) if w.lower() not in text.SEARCH_STOPWORDS)
    if "." in query or "::" in query or any("_" in w or w[1:] != w[1:].lower() for w in telling):
        signs.add("names")
    if not query.strip():
        signs.add("blank")
    if len(spelled) > 1:
        signs.add("phrase")
    return signs


def query_intent(query: str) -> str:
    """empty, exact, documentation, process_pattern or purpose."""
    signs = query_signs(query)
    return next(intent for intent, wanted in INTENTS if wanted <= signs)


def kind_boosts(query: str) -> dict[str, float]:
    """Multipliers the shape of a query suggests."""
    import re

    return {kind: factor for shape, kind, factor in SHAPES if re.search(shape, query.strip())}


def hit_properties(query: str, fts_rank: str, vec_rank: str) -> dict[str, Column]:
    """Properties of a hit by name: its ranks (from 1, null where a list lacks it), its kind and whether the query spells its name."""
    f, v = F.col(fts_rank), F.col(vec_rank)
    section, code = F.col("kind") == "DocSection", F.col("kind").isin("Function", "Class", "Type", "Test")
    document, test, both = section | F.lower("file_path").endswith(".md"), F.coalesce("is_test", F.lit(False)), f.isNotNull() & v.isNotNull()
    own = text.identifier_words(F.col("name"))
    named = (F.size(own) > 0) & (F.size(F.array_except(own, F.array(*[F.lit(w) for w in sorted(query_words(query))]).cast("array<string>"))) == 0)
    return {
        "text_top1": f == 1, "text_top3": f <= 3, "in_vector": v.isNotNull(), "vector_top1": v == 1, "vector_top5": v <= 5, "vector_6_to_20": v.between(6, 20), "in_both": both, "one_arm_vector_top5": ~both & (v <= 5),
        "code": code, "function": F.col("kind") == "Function", "document": document, "section": section, "document_no_section": document & ~section, "code_no_document": code & ~document,
        "test": test, "test_or_in_tests": test | F.col("file_path").startswith("tests/"), "named_code": named & code, "named_other": named & ~code,
    }


def intent_boost(query: str, fts_rank: str, vec_rank: str) -> Column:
    """Product of the factors of ``BOOSTS`` that apply to a hit."""
    signs = query_signs(query) | {f"is:{query_intent(query)}"}
    properties, boost = hit_properties(query, fts_rank, vec_rank), F.lit(1.0)
    for asked, name, factor in BOOSTS:
        wanted, _, unwanted = (part.split() for part in asked.partition("not"))
        if set(wanted) <= signs and not set(unwanted) & signs:
            boost = boost * F.when(F.coalesce(properties[name], F.lit(False)), factor).otherwise(1.0)
    return boost


def qualified_name_matches(query: str, column: str = "qualified_name") -> Column:
    """The query is part of the name, or its parts stand in the name in their order."""
    import re

    low, parts = F.lower(F.col(column)), [p for p in re.split(r"[./:]", query.lower()) if p]
    if not parts:
        return low.contains(query.lower())
    wanted = F.array(*[F.lit(p) for p in parts])
    walked = F.aggregate(F.filter(F.split(low, r"[./:]"), lambda p: p != ""), F.lit(0), lambda at, p: F.when(F.get(wanted, at) == p, at + 1).otherwise(at))
    return low.contains(query.lower()) | (walked == len(parts))


def hybrid_search(nodes: DataFrame, text_hits: DataFrame, vector_hits: DataFrame, query: str, k: int = 20, kind: str | None = None, context_files: list[str] | None = None) -> DataFrame:
    """Fused and boosted hits of both arms; ``text_hits`` (id, position) and ``vector_hits`` (id, position)."""
    fused = ranking.rank_fusion([text_hits, vector_hits])
    f, v = text_hits.select(F.col("id").alias("_f"), F.col("position").alias("fts_rank")), vector_hits.select(F.col("id").alias("_v"), F.col("position").alias("vec_rank"))
    told = fused.join(f, F.col("id") == F.col("_f"), "left").join(v, F.col("id") == F.col("_v"), "left").join(nodes.select(F.col("id").alias("_n"), "kind", "name", "qualified_name", "file_path", "is_test"), F.col("id") == F.col("_n"))
    told = told.withColumn("fts_rank", F.col("fts_rank") + 1).withColumn("vec_rank", F.col("vec_rank") + 1)
    boost = intent_boost(query, "fts_rank", "vec_rank")
    for b, factor in kind_boosts(query).items():
        test = qualified_name_matches(query) if b == "_qualified" else F.col("kind") == b
        boost = boost * F.when(test, factor).otherwise(1.0)
    if "test" not in query_signs(query):
        boost = boost * F.when(F.coalesce("is_test", F.lit(False)), TEST_FACTOR).otherwise(1.0)
    if context_files:
        boost = boost * F.when(F.col("file_path").isin(context_files), CONTEXT_FACTOR).otherwise(1.0)
    score = F.floor(F.col("fusion_score") * boost).cast("long")
    source = F.when(F.col("fts_rank").isNull(), "vector").when(F.col("vec_rank").isNull(), "text").otherwise("both")
    hits = told.select("id", "qualified_name", "kind", score.alias("score"), source.alias("source"))
    if kind:
        hits = hits.filter(F.col("kind") == kind)
    return hits.orderBy(F.desc("score"), "qualified_name").limit(k)


def federated(results: dict[str, DataFrame], k: int) -> DataFrame:
    """Hits of several repositories in one list with a ``repo`` column."""
    out = None
    for repo, hits in sorted(results.items()):
        tagged = hits.withColumn("repo", F.lit(repo))
        out = tagged if out is None else out.unionByName(tagged)
    return out.orderBy(F.desc("score"), "repo", "qualified_name").limit(k)


def exactness(hits: DataFrame, query: str) -> DataFrame:
    """How many hits bear exactly the name asked for; more than one is ambiguous."""
    same = (F.col("qualified_name") == query) | F.col("qualified_name").endswith(f"::{query}")
    return hits.agg(F.count_if(same).alias("exact_hits")).withColumn("ambiguous", F.col("exact_hits") > 1)


def search_in_ranks(hits: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank and success of judged queries: ``hits`` (query_id, target, position) against ``judgments`` (query_id, target, grade)."""
    first = hits.filter(F.col("position") < k).join(judgments.select(F.col("query_id").alias("_q"), F.col("target").alias("_t")), (F.col("query_id") == F.col("_q")) & (F.col("target") == F.col("_t"))).groupBy("query_id").agg(F.min("position").alias("best"))
    asked = judgments.select(F.col("query_id").alias("_q")).distinct()
    return asked.join(first, F.col("_q") == F.col("query_id"), "left").select(F.col("_q").alias("query_id"), F.coalesce(1 / (F.col("best") + 1), F.lit(0.0)).alias("reciprocal_rank"))


def ranked_hits(hits: DataFrame, score: str, key: str) -> DataFrame:
    return hits.withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(score), key)) - 1)
