"""Queries on spelling, intents, completion and snippets, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdex.functions import text as T
from sparrowdex.operators import queries as Q
from sparrowdex.functions.register import register
from sparrowdex.operators import snippets as S
from sparrowdex.sources.tables import table

WORDS = f"SELECT w, count(*) AS n FROM ({T.raw_tokens_sql()}) GROUP BY w"


def _words(spark, d):
    return T.raw_tokens(table(spark, d, "documents")).groupBy("w").agg(F.count("*").alias("n"))


def _dictionary(spark, d):
    return _words(spark, d).where("n >= 5 AND length(w) >= 3").select(F.col("w").alias("word"), F.col("n").alias("freq"))


def spell_candidates(spark, d):
    """Candidates for every word outside the dictionary."""
    return Q.spelling_candidates(_words(spark, d).select("w"), _dictionary(spark, d))


def spell_best(spark, d):
    return Q.best_corrections(spell_candidates(spark, d))


def correct_titles(spark, d):
    """The title of every fetched page, corrected by the words of the documents."""
    titles = table(spark, d, "docs").select(F.xxhash64("title").alias("key"), "title").where("title IS NOT NULL").distinct()
    return Q.correct_texts(titles, _dictionary(spark, d), "key", "title").join(titles, "key").select("title", "corrected")


def soundex_codes(spark, d):
    return _words(spark, d).select("w", Q.soundex("w").alias("code"))


def chargram_jaccard(spark, d):
    return _words(spark, d).select("w", F.round(Q.jaccard(Q.char_bigrams("w"), Q.char_bigrams(F.lit("search"))), 6).alias("similarity"))


def query_type(spark, d):
    return table(spark, d, "docs").select("title").distinct().select("title", Q.query_type("title").alias("kind"))


def intent_rules(spark, d):
    return table(spark, d, "docs").select("title").distinct().select("title", Q.intent("title").alias("intent"))


def intent_broad(spark, d):
    """Intents by the broader set of patterns."""
    return table(spark, d, "docs").select("title").distinct().select("title", Q.intent("title", Q.NAVIGATIONAL_BROAD, Q.TRANSACTIONAL_BROAD).alias("intent"))


def intent_scores(spark, d):
    t = table(spark, d, "docs").select("title").distinct()
    return t.select("title", F.explode(Q.intent_scores("title")).alias("intent", "score"))


def next_letters(spark, d):
    return Q.next_letters(_dictionary(spark, d))


def dictionary_deleted(spark, d):
    """The dictionary after the words of page titles were deleted from it."""
    words = table(spark, d, "docs").select(F.explode(F.split(F.lower("title"), " ")).alias("word"))
    return Q.without_words(_dictionary(spark, d), words)


def dictionary_json(spark, d):
    """The dictionary as a line of JSON a word."""
    return _dictionary(spark, d).select(F.to_json(F.struct("word", "freq")).alias("line"))


def sql_functions(spark, d):
    """Stems and phonetic codes by the registered SQL functions, tokens by the table function."""
    register(spark)
    _words(spark, d).select("w").createOrReplaceTempView("sparrowdex_words")
    return spark.sql("SELECT w, stem(w) AS stem, phonetic(w) AS code FROM sparrowdex_words")


def text_tokens(spark, d):
    register(spark)
    table(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("sparrowdex_texts")
    return spark.sql("SELECT doc_id, t.pos, t.term FROM sparrowdex_texts, LATERAL text_tokens(text) t")


def entities(spark, d):
    e = table(spark, d, "documents").select("doc_id", F.explode(Q.entities("text")).alias("e"))
    return e.select("doc_id", "e.kind", F.size("e.names").alias("n"))


def autocomplete_topk(spark, d):
    return Q.completions(_words(spark, d).select(F.col("w").alias("word"), F.col("n").alias("freq")), "s", 10)


def suggest_last_word(spark, d):
    return Q.suggestions(_words(spark, d).select(F.col("w").alias("word"), F.col("n").alias("freq")), "slow se", 5)


PATTERNS = ("search", "index", "crawler", "stop words", "suchindex", "le petit")


def multi_pattern(spark, d):
    return Q.pattern_hits(table(spark, d, "documents"), list(PATTERNS))


def sentence_pieces(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(S.sentences("text")).alias("i", "sentence"))


TERMS = S.query_terms("slow search index")


def sentence_relevance(spark, d):
    s = sentence_pieces(spark, d)
    return s.select("doc_id", "i", F.round(S.relevance(F.col("sentence"), TERMS), 6).alias("relevance"))


def snippet_dated(spark, d):
    """Snippets with the date before them."""
    t = table(spark, d, "documents").select("doc_id", "text", F.col("fetched_at").cast("timestamp").alias("at"))
    return S.with_dated_snippet(t, "slow search index").select("doc_id", "snippet")


def snippet_mmr(spark, d):
    return S.with_snippet(table(spark, d, "documents"), "slow search index").select("doc_id", "snippet")


MISSES = ", ".join(f"('{a}', '{b}')" for a, b in Q.MISSPELLINGS.items())
CODES = "translate(regexp_replace(upper(w), '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
SQUEEZED = "replace(substr(c, 2), '0', '')"
for _n in "123456":
    SQUEEZED = f"regexp_replace({SQUEEZED}, '{_n}+', '{_n}', 'g')"
SOUNDEX = lambda src: f"SELECT *, rpad(upper(w)[1] || CASE WHEN r[1] = c[1] THEN r[2:] ELSE r END, CAST(greatest(4, length(r)) AS INTEGER), '0')[1:4] AS code FROM (SELECT *, {SQUEEZED} AS r FROM (SELECT *, {CODES} AS c FROM ({src})))"
GRAMS = lambda x: f"list_distinct(list_transform(range(1, length({x}) + 2), lambda i: ('^' || {x} || '$')[i:i + 1]))"
JACC = lambda a, b: f"CAST(len(list_intersect({GRAMS(a)}, {GRAMS(b)})) AS DOUBLE) / len(list_distinct(list_concat({GRAMS(a)}, {GRAMS(b)})))"
SPELL = f"""WITH words AS ({WORDS}), dict AS (SELECT w, n AS freq FROM words WHERE n >= 5 AND length(w) >= 3),
bad AS (SELECT w FROM words WHERE length(w) > 0 AND w NOT IN (SELECT w FROM dict)),
bs AS (SELECT w, code FROM ({SOUNDEX('SELECT w FROM bad')})), ds AS (SELECT w, freq, code FROM ({SOUNDEX('SELECT w, freq FROM dict')})),
near AS (SELECT * FROM (SELECT bad.w, dict.w AS candidate, freq, levenshtein(bad.w, dict.w) AS distance, min(levenshtein(bad.w, dict.w)) OVER (PARTITION BY bad.w) AS least
  FROM bad, dict WHERE abs(length(bad.w) - length(dict.w)) <= 2 AND levenshtein(bad.w, dict.w) <= 2) WHERE distance = least),
each AS (SELECT w, candidate, max(freq) AS freq, CAST(min(distance) AS INTEGER) AS distance, min(tier) AS tier FROM (
  SELECT w, candidate, freq, distance, 0 AS tier FROM near
  UNION ALL SELECT bs.w, ds.w, freq, levenshtein(bs.w, ds.w), 2 FROM bs JOIN ds USING (code)
  UNION ALL SELECT bad.w, b, coalesce(freq, 0), levenshtein(bad.w, b), 1 FROM bad JOIN (VALUES {MISSES}) m(a, b) ON a = bad.w LEFT JOIN dict ON dict.w = b) GROUP BY w, candidate),
cands AS (SELECT w, candidate, freq, distance, tier = 2 AS phonetic FROM each QUALIFY row_number() OVER (PARTITION BY w ORDER BY tier, freq DESC, candidate) <= 20)"""


def _match(patterns, column):
    return " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns)


SENT = r"""SELECT doc_id, unnest(ss) AS sentence, CAST(unnest(range(len(ss))) AS INTEGER) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.?!])\s*([A-Z])', E'\\1\n\\2', 'g'), E'\n'), lambda s: trim(s, ' ')), lambda s: length(s) > 20) AS ss FROM documents)"""
AT = [f"instr(lower(sentence), '{t}')" for t in TERMS]
HIT = " + ".join(f"({a} > 0)::INT" for a in AT)

ORACLES = {
    "spell_candidates": f"{SPELL} SELECT * FROM cands",
    "spell_best": f"""{SPELL}, s AS (SELECT w, candidate, round(10 * ln(freq + 1) - 5 * distance + 3 * {JACC('w', 'candidate')}
  + CASE WHEN abs(length(w) - length(candidate)) <= 1 THEN 2 ELSE 0 END + CASE WHEN w[1] = candidate[1] THEN 3 ELSE 0 END, 6) AS score FROM cands)
SELECT w, candidate AS best, score FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, candidate) AS k FROM s) WHERE k = 1""",
    "soundex_codes": f"SELECT w, code FROM ({SOUNDEX(f'SELECT w FROM ({WORDS})')})",
    "chargram_jaccard": f"SELECT w, round({JACC('w', chr(39) + 'search' + chr(39))}, 6) AS similarity FROM ({WORDS})",
    "query_type": r'''SELECT DISTINCT title, CASE WHEN regexp_matches(title, '\b(AND|OR|NOT)\b') THEN 'boolean' WHEN regexp_matches(title, '"[^"]*"') THEN 'phrase'
WHEN regexp_matches(title, '~[0-9]+') THEN 'fuzzy' ELSE 'natural' END AS kind FROM docs''',
    "intent_rules": f"SELECT DISTINCT title, CASE WHEN {_match(Q.NAVIGATIONAL, 'lower(title)')} THEN 'navigational' WHEN {_match(Q.TRANSACTIONAL, 'lower(title)')} THEN 'transactional' ELSE 'informational' END AS intent FROM docs",
    "intent_broad": f"SELECT DISTINCT title, CASE WHEN {_match(Q.NAVIGATIONAL_BROAD, 'lower(title)')} THEN 'navigational' WHEN {_match(Q.TRANSACTIONAL_BROAD, 'lower(title)')} THEN 'transactional' ELSE 'informational' END AS intent FROM docs",
    "intent_scores": f"""SELECT title, i AS intent, CASE WHEN i = found THEN 0.85 ELSE 0.075 END::DOUBLE AS score FROM (SELECT DISTINCT title, CASE WHEN {_match(Q.NAVIGATIONAL, 'lower(title)')} THEN 'navigational'
WHEN {_match(Q.TRANSACTIONAL, 'lower(title)')} THEN 'transactional' ELSE 'informational' END AS found FROM docs), (VALUES ('navigational'), ('informational'), ('transactional')) v(i)""",
    "next_letters": f"SELECT substr(word, i, 2) AS pair, substr(word, i + 2, 1) AS letter, CAST(sum(freq) AS BIGINT) AS n FROM (SELECT w AS word, n AS freq, unnest(range(1, length(w) - 1)) AS i FROM ({WORDS}) WHERE n >= 5 AND length(w) >= 3) GROUP BY ALL",
    "dictionary_deleted": f"SELECT w AS word, n AS freq FROM ({WORDS}) WHERE n >= 5 AND length(w) >= 3 AND w NOT IN (SELECT unnest(string_split(lower(title), ' ')) FROM docs WHERE title IS NOT NULL)",
    "dictionary_json": f"""SELECT '{{"word":"' || w || '","freq":' || n || '}}' AS line FROM ({WORDS}) WHERE n >= 5 AND length(w) >= 3""",
    "sql_functions": f"SELECT w, stem, code FROM ({T.sql_steps(f'SELECT DISTINCT w FROM ({T.raw_tokens_sql()})', T.stem_steps(T.DUCK))}) JOIN (SELECT w, code FROM ({SOUNDEX(f'SELECT w FROM ({WORDS})')})) USING (w)",
    "text_tokens": f"SELECT doc_id, pos, term FROM ({T.terms_sql()})",
    "entities": " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, CAST(len(regexp_extract_all(lower(text), '\\b({p})\\b')) AS INTEGER) AS n FROM documents WHERE regexp_matches(lower(text), '\\b({p})\\b')" for k, p in Q.ENTITIES.items()),
    "autocomplete_topk": f"SELECT w AS word, n AS freq FROM ({WORDS}) WHERE starts_with(w, 's') ORDER BY n DESC, w LIMIT 10",
    "suggest_last_word": f"SELECT 'slow ' || w AS suggestion, n AS freq FROM ({WORDS}) WHERE starts_with(w, 'se') ORDER BY n DESC, w LIMIT 5",
    "multi_pattern": " UNION ALL ".join(f"SELECT doc_id, '{p}' AS pattern, CAST(instr(lower(text), '{p}') - 1 AS INTEGER) AS first FROM documents WHERE contains(lower(text), '{p}')" for p in PATTERNS),
    "sentence_pieces": SENT,
    "sentence_relevance": f"""SELECT doc_id, i, round(({HIT}) / {len(TERMS)}.0::DOUBLE * 0.7 + 0.3 * CASE WHEN {HIT} >= 2 THEN greatest(0, 1 - (greatest({', '.join(AT)}) - least({', '.join(f'nullif({a}, 0)' for a in AT)}))::DOUBLE / length(sentence)) ELSE 0 END, 6) AS relevance FROM ({SENT})""",
}
QUERIES = {k: globals()[k] for k in (*ORACLES, "snippet_mmr", "snippet_dated", "correct_titles")}
