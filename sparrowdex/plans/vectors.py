"""Queries over `embeddings` and encoded texts, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdex.functions.text import query_stems, terms
from sparrowdex.operators import rank as R
from sparrowdex.operators import vectors as V
from sparrowdex.plans.text import BM25, _index
from sparrowdex.sources.tables import table


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _queries(spark, d):
    return _vectors(spark, d).where("vec_id % 100 = 0")


def cosine_topk(spark, d):
    return V.top_similar(_vectors(spark, d), _queries(spark, d), 10).select("query", "vec_id", "rank")


def cosine_pairs(spark, d):
    """Cosines of all vectors with every query vector."""
    return V.similarities(_vectors(spark, d), _queries(spark, d)).select("query", "vec_id", F.round("score", 6).alias("cosine"))


def ivf_topk(spark, d):
    return V.ivf_search(_vectors(spark, d), _queries(spark, d), 10)


def label_centroids(spark, d):
    e = _vectors(spark, d).select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def hybrid_blend(spark, d):
    """Blended scores for every query vector, the sparse side being one text query."""
    dense = V.similarities(_vectors(spark, d), _queries(spark, d)).withColumnRenamed("vec_id", "doc_id")
    sparse = _index(spark, d).ranked(query_stems("slow search index")).select("doc_id", F.col("bm25").alias("score"))
    return R.hybrid_each(sparse, dense).select("query", "doc_id", F.round("hybrid", 6).alias("hybrid"))


def text_encode(spark, d):
    """The vector of every document, the zero vector for those without a term."""
    docs = table(spark, d, "documents")
    per = terms(docs).groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
    return V.encode_text(docs.select("doc_id").distinct().join(per, "doc_id", "left").select("doc_id", "terms"), 256).select("doc_id", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
ORACLES = {
    "cosine_topk": f"""SELECT query, vec_id, rank FROM (SELECT a.vec_id AS query, b.vec_id AS vec_id,
CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS INTEGER) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 10""",
    "cosine_pairs": f"SELECT a.vec_id AS query, b.vec_id, round({COS}, 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0",
    "label_centroids": "SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY label, i",
    "hybrid_blend": f"""{BM25}, d AS (SELECT a.vec_id AS query, b.vec_id AS doc_id, {COS} AS d FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
m AS (SELECT query, max(d) AS md FROM d GROUP BY query), s AS (SELECT query, doc_id, bm FROM raw, m)
SELECT query, doc_id, round(0.3 * CASE WHEN md > 0 THEN coalesce(d, 0) / md ELSE 0 END + 0.7 * coalesce(bm, 0) / greatest(1, coalesce((SELECT max(bm) FROM raw), 1)), 6) AS hybrid
FROM d FULL JOIN s USING (query, doc_id) JOIN m USING (query)""",
}
QUERIES = {k: globals()[k] for k in (*ORACLES, "ivf_topk", "text_encode")}
