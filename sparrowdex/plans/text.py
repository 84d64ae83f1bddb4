"""Queries over the text kernel, the index and rankings of `documents`, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.functions import text as T
from sparrowdex.functions.dialect import DUCK, SPARK, apply_steps, sql_steps
from sparrowdex.operators import index as I
from sparrowdex.operators import rank as R
from sparrowdex.operators.store import LiveIndex, TextIndex
from sparrowdex.session import shared_dir
from sparrowdex.sources.tables import table

#: The queries' words: some that are frequent in the test tables.
QUERY = "the slow search index"
STEMS = T.query_stems(QUERY)
NOW = "2026-06-01 00:00:00"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return T.terms(_docs(spark, d))


TERMS = T.terms_sql()


def normalized_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalized("text").alias("norm"))


def tokenize_tf(spark, d):
    return T.raw_tokens(_docs(spark, d)).where(T.kept()).groupBy("doc_id", F.col("w").alias("token")).agg(F.count("*").alias("tf"))


def stem_vocab(spark, d):
    return T.with_stem(T.raw_tokens(_docs(spark, d)).select("w").distinct())


def _index(spark: SparkSession, d: str) -> TextIndex:
    return TextIndex.of(spark, f"{d}/documents.parquet", _docs(spark, d), "documents-index")


def term_positions(spark, d):
    return _index(spark, d).postings().select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


def _tokens(spark, d):
    n = _docs(spark, d).select("doc_id", T.normalized("text").alias("n")).where("n <> ''")
    return n.select("doc_id", F.filter(F.split("n", " "), lambda w: (F.length(w) >= 2) & ~w.isin(list(T.STOP_WORDS))).alias("ws"))


def ngrams_2(spark, d):
    g = _tokens(spark, d).select("doc_id", F.explode(T.ngrams(F.col("ws"), 2, "_")).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"))


def shingles_3(spark, d):
    words = _docs(spark, d).select("doc_id", T.simple_words("text").alias("ws")).where("ws IS NOT NULL")
    g = T.shingle_rows(words, 3).select("doc_id", "shingle")
    return g.groupBy("doc_id").agg(F.count("*").alias("shingles"), F.countDistinct("shingle").alias("distinct_shingles"))


def index_df(spark, d):
    return _index(spark, d).dictionary()


def corpus_stats(spark, d):
    return _index(spark, d).stats()


def posting_gaps(spark, d):
    return I.posting_gaps(_index(spark, d).postings())


def posting_codec(spark, d):
    """Positions after coding and decoding, and the code's length."""
    coded = I.encoded_positions(_index(spark, d).postings())
    back = I.decoded_positions(coded).join(coded.select("term", "doc_id", F.length("code").alias("code_bytes")), ["term", "doc_id"])
    return back.select("term", "doc_id", F.array_join("positions", ",").alias("positions"), "code_bytes")


def _ranked(spark, d, score="bm25"):
    return _index(spark, d).ranked(STEMS).select("doc_id", F.round(score, 6).alias("score"))


def bm25_topk(spark, d):
    return R.top(_ranked(spark, d), 10)


def tfidf_topk(spark, d):
    return R.top(_ranked(spark, d, "tf_idf"), 10)


def page_slice(spark, d):
    return R.top(_ranked(spark, d), 10, 20)


def rank_numbers(spark, d):
    return _ranked(spark, d).where("score > 0").agg(F.count("*").alias("matches"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 3).alias("total"))


A, B, C = (T.query_stems(w)[0] for w in ("index", "search", "slow"))


def _boolean(spark, d, steps):
    return I.boolean_query(_index(spark, d).of_terms([t for _, t in steps]), _docs(spark, d), steps).select("doc_id", "tf")


def bool_and(spark, d):
    return _boolean(spark, d, [("AND", A), ("AND", B)])


def bool_or(spark, d):
    return _boolean(spark, d, [("AND", A), ("OR", B)])


def bool_not(spark, d):
    return _boolean(spark, d, [("NOT", A), ("AND", C), ("NOT", B)])


def posting_seek(spark, d):
    """The first posting of a term from a document id on."""
    return I.seek(_index(spark, d).of_terms([A]), A, 500)


def live_index(spark, d):
    """Statistics of an index whose documents without a source were added again with other text, and those without a language removed."""
    docs = _docs(spark, d).select("doc_id", "text", "lang", "source")
    live = LiveIndex(spark, f"{shared_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}", 1 << 62)
    live.change(docs)
    live.change(docs.where("source IS NULL").withColumn("text", F.concat("text", F.lit(" changed"))), docs.where("lang IS NULL AND source IS NOT NULL").select("doc_id"))
    return live.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def phrase_match(spark, d):
    return _index(spark, d).phrase(T.query_stems("search box"))


def fuzzy_match(spark, d):
    return _index(spark, d).fuzzy("indez", 2)


def readability(spark, d):
    return apply_steps(_docs(spark, d).select("doc_id", "text"), T.readability_steps(SPARK, "text", 0.0)).select("doc_id", F.round("readability", 6).alias("readability"))


def _among(listed):
    return lambda w: w.isin(listed)


def language_id(spark, d):
    words = F.slice(F.split(F.lower("text"), "\\s+"), 1, 100)
    hits = {k: F.size(F.filter(words, _among(v))) for k, v in T.LANGUAGE_WORDS.items()}
    best = F.greatest(*hits.values())
    lang = F.when(F.coalesce(best, F.lit(0)) <= 0, F.lit("en"))
    for k, h in hits.items():
        lang = lang.when(h == best, F.lit(k))
    return _docs(spark, d).select("doc_id", lang.alias("detected"))


def spell_distance(spark, d):
    w = T.raw_tokens(_docs(spark, d)).select("w").distinct().where("abs(length(w) - 6) <= 2")
    return w.select("w", F.levenshtein("w", F.lit("search"), 2).alias("distance")).where("distance >= 0")


ORDERED = "SELECT *, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored"
COUNTS = ", ".join(f"count(*) FILTER (WHERE term = '{t}') AS t{i}" for i, t in enumerate(STEMS))
BM25 = f"""WITH terms AS ({TERMS}), docs_ AS (SELECT doc_id, count(*) AS length, {COUNTS} FROM terms GROUP BY doc_id),
tot AS (SELECT count(*) AS n, avg(length) AS av, {', '.join(f'count(*) FILTER (WHERE t{i} > 0) AS d{i}' for i in range(len(STEMS)))} FROM docs_),
raw AS (SELECT doc_id, {' + '.join(f'ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * length / av))' for i in range(len(STEMS)))} AS bm,
  {' + '.join(f'CAST(t{i} AS DOUBLE) / length * ln(n / greatest(1, d{i}))' for i in range(len(STEMS)))} AS ti
  FROM docs_, tot WHERE {' OR '.join(f't{i} > 0' for i in range(len(STEMS)))})"""
POST = f"WITH post AS (SELECT term, doc_id, count(*) AS tf FROM ({TERMS}) GROUP BY ALL)"
KEPT_ARRAY = f"list_filter(string_split(n, ' '), lambda w: length(w) >= 2 AND w NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}))"

ORACLES = {
    "normalized_text": f"SELECT doc_id, {T.normalized_sql('text')} AS norm FROM documents",
    "tokenize_tf": f"SELECT doc_id, w AS token, count(*) AS tf FROM ({T.raw_tokens_sql()}) WHERE {T.kept()} GROUP BY ALL",
    "stem_vocab": f"SELECT w, stem FROM ({sql_steps(f'SELECT DISTINCT w FROM ({T.raw_tokens_sql()})', T.stem_steps(DUCK))})",
    "term_positions": f"SELECT term, doc_id, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM ({TERMS}) GROUP BY ALL",
    "ngrams_2": f"""SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1])) AS gram
FROM (SELECT {KEPT_ARRAY} AS ws FROM (SELECT {T.normalized_sql('text')} AS n FROM documents) WHERE n <> '')) GROUP BY gram""",
    "shingles_3": f"""SELECT doc_id, count(*) AS shingles, count(DISTINCT s) AS distinct_shingles FROM (
SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS s
FROM (SELECT doc_id, {T.simple_words_sql('text')} AS ws FROM documents)) GROUP BY doc_id""",
    "index_df": f"{POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM post GROUP BY term",
    "corpus_stats": f"""{POST}, t AS (SELECT term, count(*) AS n, sum(tf) AS t FROM post GROUP BY term), dd AS (SELECT count(DISTINCT doc_id) AS documents FROM post)
SELECT count(*) AS terms, CAST(sum(n) AS BIGINT) AS postings, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(2 * length(term) + 8 + 12 * n) AS BIGINT) AS size_bytes,
any_value(documents) AS documents, sum(t) / any_value(documents) AS avg_length FROM t, dd""",
    "posting_gaps": f"{POST} SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post",
    "posting_codec": f"""SELECT term, doc_id, string_agg(pos, ',' ORDER BY pos) AS positions, CAST(sum(1 + (gap >= 128)::INT + (gap >= 16384)::INT + (gap >= 2097152)::INT) AS INTEGER) AS code_bytes
FROM (SELECT *, pos - lag(pos, 1, 0) OVER (PARTITION BY term, doc_id ORDER BY pos) AS gap FROM ({TERMS})) GROUP BY term, doc_id""",
    "bm25_topk": f"{BM25}, scored AS (SELECT doc_id, round(bm, 6) AS score FROM raw) SELECT * FROM ({ORDERED}) WHERE rank <= 10",
    "tfidf_topk": f"{BM25}, scored AS (SELECT doc_id, round(ti, 6) AS score FROM raw) SELECT * FROM ({ORDERED}) WHERE rank <= 10",
    "page_slice": f"{BM25}, scored AS (SELECT doc_id, round(bm, 6) AS score FROM raw) SELECT * FROM ({ORDERED}) WHERE rank BETWEEN 21 AND 30",
    "rank_numbers": f"{BM25} SELECT count(*) AS matches, round(max(round(bm, 6)), 6) AS best, round(sum(round(bm, 6)), 3) AS total FROM raw WHERE bm > 0",
    "bool_and": f"{POST} SELECT doc_id, a.tf + b.tf AS tf FROM (SELECT * FROM post WHERE term = '{A}') a JOIN (SELECT * FROM post WHERE term = '{B}') b USING (doc_id)",
    "bool_or": f"{POST} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM post WHERE term IN ('{A}', '{B}') GROUP BY doc_id",
    "bool_not": f"{POST} SELECT doc_id, tf FROM post WHERE term = '{C}' AND doc_id NOT IN (SELECT doc_id FROM post WHERE term IN ('{A}', '{B}'))",
    "posting_seek": f"{POST} SELECT doc_id, tf FROM post WHERE term = '{A}' AND doc_id >= 500 ORDER BY doc_id LIMIT 1",
    "live_index": f"""WITH held AS (SELECT doc_id, CASE WHEN source IS NULL THEN text || ' changed' ELSE text END AS text FROM documents WHERE source IS NULL OR lang IS NOT NULL),
post AS (SELECT term, doc_id, count(*) AS tf FROM ({T.terms_sql('held')}) GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM post GROUP BY term""",
    "phrase_match": f"""WITH t AS ({TERMS}) SELECT a.doc_id, count(*) AS starts FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
WHERE a.term = '{B}' AND b.term = '{T.query_stems('box')[0]}' GROUP BY a.doc_id""",
    "fuzzy_match": f"{POST} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM post WHERE levenshtein(term, 'indez') <= 2 GROUP BY doc_id",
    "readability": f"SELECT doc_id, round(readability, 6) AS readability FROM ({sql_steps('SELECT doc_id, text FROM documents', T.readability_steps(DUCK, 'text', 0.0))})",
    "language_id": f"""SELECT doc_id, CASE WHEN coalesce(greatest(en, de, fr, es), 0) = 0 THEN 'en' WHEN en >= greatest(de, fr, es) THEN 'en' WHEN de >= greatest(fr, es) THEN 'de' WHEN fr >= es THEN 'fr' ELSE 'es' END AS detected
FROM (SELECT doc_id, {', '.join(f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in v)}))) AS {k}" for k, v in T.LANGUAGE_WORDS.items())}
FROM (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+')[1:100] AS ws FROM documents))""",
    "spell_distance": f"SELECT w, CAST(levenshtein(w, 'search') AS INTEGER) AS distance FROM (SELECT DISTINCT w FROM ({T.raw_tokens_sql()})) WHERE levenshtein(w, 'search') <= 2",
}
QUERIES = {k: globals()[k] for k in ORACLES}
