"""Facade: index a corpus, search it by the whole pipeline, complete queries, take changes, report statistics."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.functions import text as T
from sparrowdex.operators import drift as DR
from sparrowdex.operators import index as I
from sparrowdex.operators import quality as QL
from sparrowdex.operators import queries as Q
from sparrowdex.operators import rank as R
from sparrowdex.operators import snippets as S
from sparrowdex.operators import store as ST
from sparrowdex.operators import vectors as V

COLUMNS = "doc_id long, url string, title string, content string, domain string, at timestamp, page_rank double, links array<string>, headers map<string,string>, removed boolean"


class SearchEngine:
    """Search over documents (doc_id, title, content, domain, at, page_rank and, if there, url, links, headers, removed).

    All that a query needs is kept in `path` as parquet and read by later sessions: the live text index (titles taken twice, and
    contents), narrow features of the documents, vectors, drift and the dictionary. Null titles and contents count as empty;
    removed documents and those without terms are never found. `labels` (doc_id, verdict) fit the spam filter.
    """

    def __init__(self, documents: DataFrame, path: str, now: str, key: str = "doc_id", labels: DataFrame | None = None, cached: int = 10_000, seconds: float = 60.0) -> None:
        self.spark, self.path, self.now, self.labels = documents.sparkSession, path.rstrip("/"), now, labels
        named = documents.withColumnRenamed(key, "doc_id")
        kinds = dict(x.split(" ") for x in COLUMNS.split(", "))
        self.given = named.select(*[(F.col(c) if c in named.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        self.live = ST.LiveIndex(self.spark, f"{self.path}/index")
        self.cache: OrderedDict = OrderedDict()
        self.cached, self.seconds, self.times, self.hits = cached, seconds, [], 0

    def rebuild(self) -> None:
        """Write everything anew from the documents given."""
        self.live.clear()
        self._keep(self.given.where("NOT coalesce(removed, false)"))
        self.live.change(self._texts(self.documents()))
        self.compact()

    def _keep(self, documents: DataFrame) -> None:
        version = f"{self.path}/documents/v{time.time_ns()}"
        documents.write.parquet(version)

    def documents(self) -> DataFrame:
        """The live documents."""
        fs, place = ST._fs(self.spark, f"{self.path}/documents")
        done = [s.getPath() for s in fs.listStatus(place) if fs.exists(ST._fs(self.spark, f"{s.getPath()}/_SUCCESS")[1])]
        return self.spark.read.schema(COLUMNS).parquet(max(p.toString() for p in done))

    def _texts(self, documents: DataFrame) -> DataFrame:
        return documents.select("doc_id", F.concat_ws(" ", "title", "title", "content").alias("text"))

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> bool:
        """Add or replace documents and remove ids; found at once, features of new documents after `compact`. Says if it merged."""
        kinds = dict(x.split(" ") for x in COLUMNS.split(", "))
        new = self.spark.createDataFrame([], COLUMNS) if added is None else added.select(*[(F.col(c) if c in added.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        old = self.documents()
        gone = new.select("doc_id") if removed is None else new.select("doc_id").unionByName(removed.select("doc_id"))
        self._keep(old.join(gone, "doc_id", "left_anti").select(*old.columns).unionByName(new))
        self.cache.clear()
        merged = self.live.change(self._texts(new), removed)
        if merged:
            self.compact()
        return merged

    def compact(self) -> None:
        """Merge the delta into the main index and write features, vectors, drift and dictionary for all documents."""
        self.index = self.live.index()
        docs, write = self.documents(), lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        pages = docs.select(F.col("doc_id").alias("id"), "content", "domain", F.col("links").alias("outgoing_links"), "headers")
        quality = QL.quality_features(pages)
        if self.labels is not None:
            fitted = QL.fit_quality_model(quality, self.labels.select(F.col("doc_id").alias("id"), "verdict")).transform(quality)
            from pyspark.ml.functions import vector_to_array

            spam = fitted.select(F.col("id").alias("doc_id"), vector_to_array("probability")[1].alias("spam"))
        else:
            spam = QL.spam_score(quality).select(F.col("id").alias("doc_id"), "spam")
        narrow = docs.select("doc_id", F.lower("title").alias("title"), F.least(F.lit(1.0), F.coalesce(F.nanvl("page_rank", F.lit(0.0)), F.lit(0.0)) / 10).alias("page_rank"), "at", R.authority("domain").alias("authority"))
        write(narrow.join(spam, "doc_id"), "features")
        per = self.index.postings().groupBy("doc_id").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))).alias("terms"))
        write(V.encode_text(per), "vectors")
        tokens = DR.drift_tokens(docs.withColumn("text", F.concat_ws(" ", "title", "content")), "doc_id", "text", "at")
        write(DR.term_drift(DR.ppmi(tokens, "doc_id")), "drift")
        write(DR.document_drift(tokens, self.drift(), "doc_id"), "document-drift")
        words = T.raw_tokens(docs.select("doc_id", F.concat_ws(" ", "title", "content").alias("text")))
        write(words.where(T.kept()).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("freq")), "dictionary")
        self.cache.clear()

    def drift(self) -> DataFrame:
        """(w, windows, magnitude, drifted) of all words."""
        return self.spark.read.parquet(f"{self.path}/drift")

    def drift_report(self, most: int = 20) -> DataFrame:
        return DR.drift_report(self.drift(), most)

    def _index(self) -> ST.TextIndex:
        if not hasattr(self, "index") or self.live._pointer()["deltas"]:
            self.index = self.live.index()
        return self.index

    def corrected(self, query: str) -> str:
        """The query with its unknown words corrected in context; one with operators, quotes or word~n stays as it is."""
        if any(w in ("AND", "OR", "NOT") for w in query.split()) or '"' in query or Q.parse_fuzzy(query):
            return query
        row = self.spark.createDataFrame([(0, query)], "doc_id int, text string")
        common = self.spark.createDataFrame([(w, 1) for w in T.STOP_WORDS], "word string, freq long")
        return Q.correct_texts(row, self.dictionary().unionByName(common), "doc_id", "text").first().corrected

    def candidates(self, query: str) -> tuple[DataFrame, list[str]]:
        """(scores by BM25 of documents that the query lets pass, stems): quoted phrases, AND / OR / NOT, word~n, or any term."""
        index, stems = self._index(), T.query_stems(query.replace("~", " "))
        kind = "boolean" if any(w in ("AND", "OR", "NOT") for w in query.split()) else "phrase" if query.count('"') > 1 else "fuzzy" if Q.parse_fuzzy(query) else "natural"
        allowed = None
        if kind == "boolean":
            steps = [(op, s) for op, w in Q.parse_boolean(query) for s in T.query_stems(w)]
            stems = [s for op, s in steps if op != "NOT"]
            allowed = I.boolean_query(index.of_terms([s for _, s in steps]), self.documents(), steps).select("doc_id")
        elif kind == "phrase":
            allowed = index.phrase(T.query_stems(" ".join(Q.parse_phrase(query)[0]))).select("doc_id")
        elif kind == "fuzzy":
            near = [index.fuzzy(w, d).select("doc_id") for w, d in Q.parse_fuzzy(query)]
            allowed = near[0]
            for n in near[1:]:
                allowed = allowed.union(n).distinct()
        scores = index.ranked(stems)
        if allowed is not None:
            scores = allowed.join(scores, "doc_id", "left").select("doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("tf_idf", F.lit(0.0)).alias("tf_idf"), F.coalesce("length", F.lit(1)).alias("length"))
        return scores, stems

    def scored(self, query: str) -> tuple[DataFrame, list[str]]:
        """(all results (doc_id, score), stems): composite score, blended with dense retrieval, penalised by drift, without spam.

        Only narrow columns are read: the exact match is that of the stems at successive places, the density their share of the terms.
        """
        scores, stems = self.candidates(query)
        index = self._index()
        exact = index.phrase(stems).select("doc_id", F.lit(1).alias("exact"))
        tf = index.of_terms(stems).groupBy("doc_id").agg((F.sum(F.col("tf") / F.col("length")) / max(1, len(set(stems)))).alias("density"))
        hit = F.lit(False)
        for s in stems:
            hit |= F.contains(F.coalesce("title", F.lit("")), F.lit(s))
        f = scores.join(self.spark.read.parquet(f"{self.path}/features"), "doc_id").join(exact, "doc_id", "left").join(tf, "doc_id", "left")
        f = f.select("doc_id", "bm25", "page_rank", R.freshness("at", self.now).alias("freshness"), "authority", F.coalesce("exact", F.lit(0)).alias("exact"), hit.cast("int").alias("title"), "spam", F.coalesce("density", F.lit(0.0)).alias("density"))
        results = R.composite(f).select("doc_id", "score", "spam")
        if stems:
            asked = V.encode_text(self.spark.createDataFrame([(0, stems)], "doc_id long, terms array<string>")).select(F.col("vector").alias("q"))
            dense = self.spark.read.parquet(f"{self.path}/vectors").crossJoin(F.broadcast(asked)).select("doc_id", V.cosine("vector", "q").alias("score"))
            mixed = R.top(R.hybrid(results.select("doc_id", "score"), dense).withColumnRenamed("hybrid", "score"), 50)
            results = R.blended(results, mixed.select("doc_id", "score"), 0.7)
            words = T.normalize_text(query).split()
            if self.drift().where(F.col("drifted") & F.col("w").isin(words)).limit(1).count():
                results = R.drift_penalised(results, self.spark.read.parquet(f"{self.path}/document-drift"))
        return results.where("spam < 0.8").select("doc_id", "score"), stems

    def search(self, query: str, page: int = 1, size: int = 10, correct: bool = True) -> DataFrame:
        """(doc_id, rank, score, title, url, domain, at, snippet, matched) of a page of results, `size` 50 at most; texts are read for it alone."""
        if not query or page < 1 or not 1 <= size <= 50:
            raise ValueError("a query, a page from 1 and a size from 1 to 50 are needed")
        query = self.corrected(query) if correct else query
        results, stems = self.scored(query)
        best = R.top(results, size, (page - 1) * size)
        texts = F.broadcast(best).join(self.documents().select("doc_id", "title", "url", "content", "domain", "at"), "doc_id")
        found = S.with_snippet(texts, query, "content").withColumn("matched", R.matched_terms(F.concat_ws(" ", "title", "content"), stems))
        return found.select("doc_id", "rank", "score", "title", "url", "domain", "at", "snippet", "matched").orderBy("rank")

    def respond(self, query: str, page: int = 1, size: int = 10) -> dict:
        """A page of results with the number of all, the corrected query, suggestions and intent; kept for `seconds`, oldest dropped first."""
        began, at = time.time(), (query, page, size)
        if at in self.cache and began - self.cache[at][0] < self.seconds:
            self.hits += 1
            self.times.append(time.time() - began)
            return self.cache[at][1]
        used = self.corrected(query)
        rows = [r.asDict() for r in self.search(used, page, size, False).collect()]
        intent = self.spark.createDataFrame([(query,)], "q string").select(Q.intent("q").alias("i")).first().i
        out = {
            "query": query, "results": rows, "total": self.scored(used)[0].count(), "corrected": used if used != query else None,
            "suggestions": [r.suggestion for r in self.suggest(query).collect()], "intent": intent, "ms": round(1000 * (time.time() - began)),
        }
        self.cache[at] = (began, out)
        while len(self.cache) > self.cached:
            self.cache.popitem(last=False)
        self.times.append(time.time() - began)
        return out

    def counters(self) -> dict:
        """Requests, hit rate of the cache, mean and 99th percentile of seconds."""
        t = sorted(self.times)
        return {"requests": len(t), "hit_rate": self.hits / len(t) if t else 0.0, "mean": sum(t) / len(t) if t else 0.0, "p99": t[max(0, -(-99 * len(t) // 100) - 1)] if t else 0.0}

    def dictionary(self) -> DataFrame:
        """(word, freq) of all kept words."""
        return self.spark.read.parquet(f"{self.path}/dictionary")

    def autocomplete(self, prefix: str, k: int = 8) -> DataFrame:
        """(word, freq) by prefix; none for a prefix of less than two letters."""
        return Q.completions(self.dictionary(), prefix, k if len(prefix) >= 2 else 0)

    def suggest(self, query: str, k: int = 5) -> DataFrame:
        return Q.suggestions(self.dictionary(), query, k)

    def get(self, doc_id: int) -> DataFrame:
        """The document of an id, if it is live."""
        return self.documents().where(F.col("doc_id") == doc_id)

    def stats(self) -> DataFrame:
        return self._index().stats()

    def clear(self) -> None:
        """Delete all that is kept."""
        ST.delete(self.spark, self.path)
        self.cache.clear()
