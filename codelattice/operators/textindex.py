"""A stored inverted index: built once, kept in step by owner, read by term.

A segment is a folder of postings ``(term, doc, owner, tf, dl)``, cut into
buckets by term and sorted within, and of documents ``(doc, owner, dl)``. Every
posting carries the length of its document, which is summed from the row before
its terms are spread, so neither building nor asking joins lengths. A common
term is cut at documents, not gathered. A query reads the buckets of its terms.

An owner (a file, for nodes) is what a sync replaces: the sync writes a segment
with the new rows and the list of owners whose rows in earlier segments no
longer count. A segment counts once its marker exists, which is written last;
a sync that dies leaves a folder nobody reads.

Terms are runs of ASCII letters and digits in lower case, and pairs of
neighbouring characters of Japanese and Chinese (a lone one stands for itself).
Defined results: null texts have no terms; a document without terms has length
0 and is counted; an index without a segment is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
WIDE = "぀-ヿ㐀-䶿一-鿿"
POSTINGS = "term string, doc {doc}, owner string, tf long, dl long, bucket int"


def terms(column: Column) -> Column:
    """Terms of a text, repeated as often as they occur."""
    words = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    runs = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(f"([{WIDE}]+)"), 1)
    pairs = F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))))
    return F.concat(words, F.flatten(pairs))


def query_terms(query: str) -> list[str]:
    """Different terms of a query in their order, words first."""
    import re

    runs = re.findall(f"[{WIDE}]+", query)
    pairs = [r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]
    return list(dict.fromkeys([*re.findall("[a-z0-9]+", query.lower()), *pairs]))


def term_rows(docs: DataFrame, doc: str, fields: dict[str, int], owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (term, doc, owner, tf, dl) and documents (doc, owner, dl) of a frame."""

    def weighted(field: str, weight: int) -> Column:
        return F.transform(terms(F.col(field)), lambda t: F.struct(t.alias("term"), F.lit(weight).cast("long").alias("w")))

    bag = F.flatten(F.array(*[weighted(f, w) for f, w in fields.items()]))
    length = F.aggregate("bag", F.lit(0).cast("long"), lambda s, x: s + x["w"])
    held = docs.select(F.col(doc).alias("doc"), (F.col(owner).cast("string") if owner else F.lit("")).alias("owner"), bag.alias("bag")).withColumn("dl", length)
    if len(fields) > 1:  # names and signatures: few terms, counted within the row
        total = lambda t: F.aggregate(F.filter("bag", lambda x: x["term"] == t), F.lit(0).cast("long"), lambda s, x: s + x["w"])
        counted = F.transform(F.array_distinct("bag.term"), lambda t: F.struct(t.alias("term"), total(t).alias("tf")))
        spread = held.select("doc", "owner", "dl", F.explode(counted).alias("p")).select("p.term", "doc", "owner", "p.tf", "dl")
    else:  # whole texts: folded by a partial aggregate before they are exchanged
        spread = held.select("doc", "owner", "dl", F.explode("bag").alias("p")).groupBy(F.col("p.term").alias("term"), "doc", "owner", "dl").agg(F.sum("p.w").alias("tf"))
    return spread.select("term", "doc", "owner", "tf", "dl"), held.select("doc", "owner", "dl")


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, doc: str, fields: dict[str, int], owner: str | None = None):
        self.spark, self.root, self.doc, self.fields, self.owner = spark, root.rstrip("/"), doc, fields, owner
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[tuple[int, str]]:
        folder = self._path(f"{self.root}/_ready")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((int(n.partition("-")[0]), n.partition("-")[2]) for n in names if n[:1].isdigit())

    def _write(self, docs: DataFrame, replaced: DataFrame | None) -> int:
        number, name = (self.segments() or [(0, "")])[-1][0] + 1, uuid.uuid4().hex
        folder = f"{self.root}/segment-{name}"
        posted, documents = term_rows(docs, self.doc, self.fields, self.owner)
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        posted.withColumn("bucket", bucket).repartitionByRange("bucket", "term", "doc").sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{folder}/postings")
        documents.write.parquet(f"{folder}/documents")
        if replaced is not None:
            replaced.select(F.col("key").cast("string").alias("owner")).distinct().write.parquet(f"{folder}/replaced")
        self._fs.mkdirs(self._path(f"{self.root}/_ready"))
        if any(n == number for n, _ in self.segments()):
            raise FileExistsError(f"segment {number} was written by another run")
        self._fs.create(self._path(f"{self.root}/_ready/{number:08d}-{name}"), False).close()
        return number

    def build(self, docs: DataFrame) -> int:
        """The first segment, of everything."""
        return self._write(docs, None)

    def sync(self, docs: DataFrame, owners: DataFrame) -> int:
        """Rows of ``owners`` (a column ``key``) are replaced by those of ``docs``; owners without rows there vanish."""
        if self.owner is None:
            raise ValueError("an index without owners can only be built")
        return self._write(docs, owners)

    def _read(self, part: str, schema: str, test: Column | None = None) -> DataFrame:
        kind = self.doc_type
        found, later = None, None
        for number, name in reversed(self.segments()):
            rows = self.spark.read.schema(schema.format(doc=kind)).parquet(f"{self.root}/segment-{name}/{part}")
            rows = rows if test is None else rows.filter(test)
            if later is not None:
                rows = rows.join(later, F.col("owner").eqNullSafe(F.col("_gone")), "left_anti")
            found = rows if found is None else found.unionByName(rows)
            gone = self._path(f"{self.root}/segment-{name}/replaced")
            if self._fs.exists(gone):
                more = self.spark.read.parquet(str(gone)).select(F.col("owner").alias("_gone"))
                later = more if later is None else later.unionByName(more).distinct()
        return self.spark.createDataFrame([], schema.format(doc=kind)) if found is None else found

    @property
    def doc_type(self) -> str:
        for _, name in self.segments():
            return self.spark.read.parquet(f"{self.root}/segment-{name}/documents").schema["doc"].dataType.simpleString()
        return "long"

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """``term, doc, tf, dl`` of the asked terms; only their buckets are read."""
        if words is None:
            return self._read("postings", POSTINGS).select("term", "doc", "tf", "dl")
        at = self.spark.createDataFrame([(w,) for w in words], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b"))
        buckets = sorted({r.b for r in at.collect()}) if words else []  # one number per asked word
        test = F.col("bucket").isin(buckets) & F.col("term").isin(words) if words else F.lit(False)
        return self._read("postings", POSTINGS, test).select("term", "doc", "tf", "dl")

    def documents(self) -> DataFrame:
        return self._read("documents", "doc {doc}, owner string, dl long")

    def totals(self) -> DataFrame:
        """One row: documents with terms and the sum of their lengths."""
        return self.documents().filter("dl > 0").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("sum_dl"))

    def health(self, docs: DataFrame) -> DataFrame:
        """Documents of the source and of the index, those missing in either, and ``fresh`` or ``stale``."""
        here = docs.select(F.col(self.doc).alias("doc"), F.lit(1).alias("s"), F.lit(0).alias("i"))
        both = here.unionByName(self.documents().select("doc", F.lit(0).alias("s"), F.lit(1).alias("i"))).groupBy("doc").agg(F.max("s").alias("s"), F.max("i").alias("i"))
        told = both.agg(
            F.coalesce(F.sum("s"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("i"), F.lit(0)).alias("n_indexed"), F.count_if(F.col("i") == 0).alias("n_missing"), F.count_if(F.col("s") == 0).alias("n_orphaned")
        )
        return told.withColumn("status", F.when((F.col("n_missing") == 0) & (F.col("n_orphaned") == 0), "fresh").otherwise("stale"))


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """A name for the present files of a table: their paths, lengths and times."""
    import hashlib

    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(where)]
    return hashlib.blake2b("\n".join(sorted(files)).encode(), digest_size=12).hexdigest()
