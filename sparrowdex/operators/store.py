"""Persisted text index: postings by term, term dictionary, totals; main and delta versions with merge and swap."""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowdex.functions import text as T
from sparrowdex.session import shared_dir

POSTING = "term string, doc_id long, tf long, length long, positions array<int>, bucket int"
#: Terms are laid out over so many buckets by hash; a query reads the buckets of its terms alone.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Move a folder; false if the target was made meanwhile."""
    fs, place = _fs(spark, old)
    target = _fs(spark, new)[1]
    return False if fs.exists(target) else fs.rename(place, target)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Stands for the content of a file or folder: names, sizes and times of its files."""
    fs, place = _fs(spark, path)
    files, found = fs.listFiles(place, True), []
    while files.hasNext():
        s = files.next()
        found.append(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.md5("\n".join([path, *sorted(found)]).encode()).hexdigest()


def bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """The index of texts (doc_id, text) in a folder: `postings` (term, doc_id, tf, length, positions) by bucket, sorted by term,
    `dictionary` (term, df, total_tf) and `totals` (one row: documents, tokens).

    A posting has its document's length beside it, so a ranked query joins nothing: it reads the row groups of its terms. Null and
    empty texts have no postings and don't count as documents.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> TextIndex:
        """Write the index of a corpus: one shuffle by document, one by bucket."""
        each = T.terms(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).repartition("doc_id")
        per = each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
        return TextIndex.of_postings(per.withColumn("length", F.sum("tf").over(Window.partitionBy("doc_id"))), path)

    @staticmethod
    def of_postings(post: DataFrame, path: str) -> TextIndex:
        """Write an index of rows (term, doc_id, tf, length, positions)."""
        spark, path = post.sparkSession, path.rstrip("/")
        # a bucket's terms are spread by document, so that a very frequent term is no single task
        laid = post.select("term", "doc_id", "tf", "length", "positions", bucket("term").alias("bucket")).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("bucket", "term", "doc_id")
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        held = spark.read.schema(POSTING).parquet(f"{path}/postings")
        held.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf")).sort("term").write.mode("overwrite").parquet(f"{path}/dictionary")
        docs = held.groupBy("doc_id").agg(F.first("length").alias("length"))
        docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).write.mode("overwrite").parquet(f"{path}/totals")
        return TextIndex(spark, path)

    @staticmethod
    def of(spark: SparkSession, source: str, docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> TextIndex:
        """The index of a source's texts in the shared folder; built if there is none of the source as it is now."""
        path = f"{shared_dir(spark).rstrip('/')}/{name}-{fingerprint(spark, source)}"
        if not exists(spark, path):
            begun = f"{path}.{uuid.uuid4().hex}"
            TextIndex.build(docs, begun, key, text)
            if not rename(spark, begun, path):  # another built it meanwhile
                delete(spark, begun)
        return TextIndex(spark, path)

    def postings(self) -> DataFrame:
        """(term, doc_id, tf, length, positions) of all terms."""
        return self.spark.read.schema(POSTING).parquet(f"{self.path}/postings").drop("bucket")

    def of_terms(self, terms: list[str]) -> DataFrame:
        """Postings of a few terms; their buckets and terms are predicates of the scan."""
        some = self.spark.range(1).select(F.array(*[bucket(F.lit(t)) for t in dict.fromkeys(terms)]) if terms else F.array().cast("array<int>")).first()[0]
        rows = self.spark.read.schema(POSTING).parquet(f"{self.path}/postings").where(F.col("bucket").isin(some) & F.col("term").isin(list(dict.fromkeys(terms))))
        return rows.drop("bucket")

    def dictionary(self) -> DataFrame:
        """(term, df, total_tf)."""
        return self.spark.read.schema("term string, df long, total_tf long").parquet(f"{self.path}/dictionary")

    def totals(self) -> tuple[int, int]:
        """(documents, tokens)."""
        r = self.spark.read.schema("documents long, tokens long").parquet(f"{self.path}/totals").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        return r[0], r[1]

    def document_frequency(self, term: str) -> int:
        """In how many documents a term is."""
        r = self.dictionary().where(F.col("term") == term).first()
        return r.df if r else 0

    def has_term(self, term: str) -> bool:
        return self.document_frequency(term) > 0

    def term_count(self) -> int:
        return self.dictionary().count()

    def average_length(self) -> float:
        """Terms a document; 0 without any."""
        n, t = self.totals()
        return t / n if n else 0.0

    def stats(self) -> DataFrame:
        """One row (documents, terms, postings, tokens, avg_length, size_bytes); an empty index gives zeros."""
        n, t = self.totals()
        sums = self.dictionary().agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.coalesce(F.sum(2 * F.length("term") + 8 + 12 * F.col("df")), F.lit(0)).alias("size_bytes"))
        return sums.select(F.lit(n).cast("long").alias("documents"), "terms", "postings", F.lit(t).cast("long").alias("tokens"), F.lit(t / n if n else 0.0).alias("avg_length"), "size_bytes")

    def ranked(self, stems: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(doc_id, bm25, tf_idf, length) of documents with a query term.

        idf = ln((N - df + 0.5) / (df + 0.5) + 1); a term that the query has twice counts twice. Counts of the corpus are read
        from dictionary and totals, a few rows.
        """
        wanted = list(dict.fromkeys(stems))
        n, tokens = self.totals()
        df = {r.term: r.df for r in self.dictionary().where(F.col("term").isin(wanted)).collect()}
        of = lambda f: F.create_map(*[x for t in wanted for x in (F.lit(t), F.lit(float(f(t))))])[F.col("term")] if wanted else F.lit(0.0)
        idf = of(lambda t: stems.count(t) * math.log((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5) + 1))
        plain = of(lambda t: stems.count(t) * math.log(n / max(1, df.get(t, 0))) if n else 0)
        tf = F.col("tf")
        score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(tokens / n if n else 1.0)))
        rows = self.of_terms(wanted).select("doc_id", "length", score.alias("s"), (plain * tf / F.col("length")).alias("t"))
        return rows.groupBy("doc_id").agg(F.sum("s").alias("bm25"), F.sum("t").alias("tf_idf"), F.max("length").alias("length"))

    def phrase(self, stems: list[str]) -> DataFrame:
        """(doc_id, starts): documents that hold the terms at successive places, and at how many."""
        if not stems:
            return self.of_terms([]).select("doc_id", F.lit(0).cast("long").alias("starts"))
        places = self.spark.createDataFrame([(t, i) for i, t in enumerate(stems)], "term string, i int")
        rows = self.of_terms(stems).join(F.broadcast(places), "term").select("doc_id", F.transform("positions", lambda p: p - F.col("i")).alias("starts"))
        votes = rows.select("doc_id", F.explode("starts").alias("start")).groupBy("doc_id", "start").agg(F.count("*").alias("n"))
        return votes.where(F.col("n") == len(stems)).groupBy("doc_id").agg(F.count("*").alias("starts"))

    def fuzzy(self, word: str, distance: int) -> DataFrame:
        """(doc_id, tf): documents with a term at most `distance` edits (5 at most) from the given one.

        The dictionary is searched, then the postings of the terms found are read; their number is that of words so near.
        """
        d = min(int(distance), 5)
        near = self.dictionary().where(F.abs(F.length("term") - len(word)) <= d).where(F.levenshtein("term", F.lit(word), d) >= 0)
        return self.of_terms([r.term for r in near.select("term").collect()]).groupBy("doc_id").agg(F.sum("tf").alias("tf"))


class LiveIndex:
    """Main and delta index under one folder: changes go to the delta, `merge` makes a new main of both and swaps to it.

    Documents (doc_id, text) that are added again replace their old ones, removed ones are gone at once; a version is complete
    once the pointer names it, so a lost executor or driver leaves the last one. The delta is merged when it has `most` changes.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 1000) -> None:
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    def _pointer(self) -> dict:
        fs, place = _fs(self.spark, f"{self.path}/current")
        if not fs.exists(place):
            return {"main": None, "deltas": [], "changes": 0}
        r = self.spark.read.schema("main string, deltas array<string>, changes long").json(f"{self.path}/current/{max(s.getPath().getName() for s in fs.listStatus(place))}").first()
        return {"main": r.main, "deltas": list(r.deltas or []), "changes": r.changes}

    def _point(self, main: str | None, deltas: list[str], changes: int) -> None:
        fs, place = _fs(self.spark, f"{self.path}/current")
        fs.mkdirs(place)
        n = len(fs.listStatus(place))
        row = self.spark.createDataFrame([(main, deltas, changes)], "main string, deltas array<string>, changes long")
        begun = f"{self.path}/begun-{uuid.uuid4().hex}"
        row.coalesce(1).write.json(begun)
        rename(self.spark, begun, f"{self.path}/current/v{n:08d}")

    def change(self, docs: DataFrame, removed: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> bool:
        """Add or replace documents and remove ids; says whether the delta was merged."""
        now = self._pointer()
        name = f"delta-{uuid.uuid4().hex}"
        TextIndex.build(docs, f"{self.path}/{name}", key, text)
        gone = docs.select(F.col(key).alias("doc_id"))
        gone = gone if removed is None else gone.unionByName(removed.select(F.col(key).alias("doc_id")))
        gone.distinct().write.parquet(f"{self.path}/{name}/gone")
        changes = now["changes"] + self.spark.read.parquet(f"{self.path}/{name}/gone").count()
        self._point(now["main"], [*now["deltas"], name], changes)
        if changes >= self.most:
            self.merge()
            return True
        return False

    def postings(self) -> DataFrame:
        """The postings that hold: of each document those of its last change."""
        now = self._pointer()
        out = None
        for name in ([now["main"]] if now["main"] else []) + now["deltas"]:
            own = TextIndex(self.spark, f"{self.path}/{name}").postings()
            if out is not None:
                out = out.join(self.spark.read.parquet(f"{self.path}/{name}/gone"), "doc_id", "left_anti").select(*own.columns).unionByName(own)
            else:
                out = own
        return self.spark.createDataFrame([], POSTING).drop("bucket") if out is None else out

    def merge(self) -> None:
        """Main and deltas become a new main; old folders are deleted after the swap."""
        now = self._pointer()
        name = f"main-{uuid.uuid4().hex}"
        TextIndex.of_postings(self.postings(), f"{self.path}/{name}")
        self._point(name, [], 0)
        for old in [*now["deltas"], *([now["main"]] if now["main"] else [])]:
            delete(self.spark, f"{self.path}/{old}")

    def index(self) -> TextIndex:
        """The main index, after a merge if there are changes."""
        if self._pointer()["deltas"] or not self._pointer()["main"]:
            self.merge()
        return TextIndex(self.spark, f"{self.path}/{self._pointer()['main']}")

    def clear(self) -> None:
        """Delete all."""
        delete(self.spark, self.path)
