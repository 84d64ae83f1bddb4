"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.llm import boiler, encode, leaks, neardup, postings, seen, sentences, sitelines, spam
from sparrowdex.llm.common import current_records, site
from sparrowdex.session import through_table
from sparrowdex.sources.tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Current records with what the page operators need, kept in the shared folder."""
    now = current_records(table(spark, d, "docs"), ["title", "content", "outgoing_links", "content_type", "domain", "url", "language"])
    links = F.when(F.col("outgoing_links").isNotNull(), F.size("outgoing_links")).otherwise(0)
    named = site(F.col("domain"), F.col("url"))
    return through_table(now.select("id", "title", "content", "language", links.alias("links"), boiler.is_web_page(F.col("content_type")).alias("web"), named.alias("site")), "pages")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Current records that serve keywords, link lists or product tags in place of sentences."""
    return spam.list_pages(_pages(spark, d), table(spark, d, "page_labels")).where("spam").select("id")


def p1_features(spark: SparkSession, d: str) -> DataFrame:
    """The features of every current record and the decision."""
    f = spam.list_pages(_pages(spark, d), table(spark, d, "page_labels"))
    return f.select("id", *[F.round(F.col("f")[i], 6).alias(n) for i, n in enumerate(spam.FEATURES)], "spam")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms in too few or too many records."""
    return p2_term_frequencies(spark, d).where("mark IS NOT NULL").select("term", "mark")


def p2_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of every term."""
    return postings.term_frequencies(postings.vertical_index(postings.resolved_postings(table(spark, d, "postings"))))


def _arrivals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = seen.with_url_key(table(spark, d, "docs")).select("key")
    return known, seen.with_url_key(table(spark, d, "frontier")).select("entry_id", "key")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Frontier rows whose key was there before, as the saved tables answer; `p3_audit` says how often they are wrong."""
    return seen.seen_before(*_arrivals(spark, d)).where("seen").select("entry_id")


def p3_audit(spark: SparkSession, d: str) -> DataFrame:
    """Share of wrong answers of the tables, by an exact check of all."""
    known, arriving = _arrivals(spark, d)
    return seen.audited(seen.checked(seen.seen_before(known, arriving), known))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines in at least 5 current records of their site."""
    return sitelines.repeated_lines(table(spark, d, "docs"), 5, "records").select("id", "line_no")


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Texts without lines that are in at least 5 different texts of their site, on at least 5 dates."""
    return sitelines.without_repeated_lines(table(spark, d, "docs"), 5, "clusters", 5)


def _page_texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return through_table(current_records(table(spark, d, "docs"), ["title", "content"]).select("id", text.alias("text")), "page-texts")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of current records with 60 % of their three-word sequences in common."""
    return neardup.all_pairs(*neardup.similar_pairs(_page_texts(spark, d), 3, 0.6))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every current record with its class of equal shingle sets and that class's number of links; records of fewer than
    five words, which have no set, are their own class."""
    texts = _page_texts(spark, d)
    found = neardup.linked_records(*neardup.similar_pairs(texts, 5, 0.8))
    return texts.select("id").join(found, "id", "left").select("id", F.coalesce("class", "id").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between the classes of `p5_groups`: least ids of two sets and their similarity."""
    links, _ = neardup.similar_pairs(_page_texts(spark, d), 5, 0.8)
    return links.select("a", "b", F.round("similarity", 6).alias("similarity"))


def _web_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    cases = spam.list_pages(pages, table(spark, d, "page_labels")).where("spam").select("id")
    return pages.where("web").join(cases, "id", "left_anti").select("id", "site", "title", "content")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of web pages that aren't the page's own."""
    return boiler.furniture_lines(_web_pages(spark, d))


def p6_main_text(spark: SparkSession, d: str) -> DataFrame:
    """Every web page's text without its furniture."""
    return boiler.main_text(_web_pages(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms heavy in a record and shared by only a few others."""
    return postings.heavy_terms(postings.resolved_postings(table(spark, d, "postings")), 5, 2, 25).select("doc_id", "term")


def p7_weights(spark: SparkSession, d: str) -> DataFrame:
    """Log-entropy weight of every resolved posting."""
    w = postings.log_entropy(postings.resolved_postings(table(spark, d, "postings")))
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return encode.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 12 successive words of an item."""
    found = leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), 12, 1)
    return found.where("distance = 0").select("doc_id", "item_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked into how many documents, changed or not."""
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"), 12, 1)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every document."""
    return sentences.sentence_units(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_features, p2_found, p2_term_frequencies, p3_found, p3_audit, p4_found, p4_cleaned, p5_found, p5_groups, p5_links, p6_found, p6_main_text, p7_found, p7_weights, p8_ids, p9_found, p9_report, p10_found)}

RESOLVED = r"""
resolved AS (
  SELECT term, doc_id, tf FROM (
    SELECT lower(trim(term, E' \t\r\n')) AS term, doc_id, tf,
      row_number() OVER (PARTITION BY lower(trim(term, E' \t\r\n')), doc_id ORDER BY indexed_at DESC NULLS LAST, tf DESC NULLS LAST) AS k
    FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL)
  WHERE k = 1 AND tf > 0)"""

FREQUENCIES = f"""WITH {RESOLVED},
freq AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records,
    CASE WHEN count(*) <= 2 THEN 'rare' WHEN count(*) > 0.2 * (SELECT count(DISTINCT doc_id) FROM resolved) THEN 'common' END AS mark
  FROM resolved GROUP BY term)
"""

URL_KEY = r"""
CASE WHEN strpos(u, '://') > 1 THEN
  lower(regexp_extract(u, '^(.*?)://', 1)) || '://' || regexp_extract(u, '^.*?://([^/?]*@)?', 1)
  || CASE lower(regexp_extract(u, '^(.*?)://', 1))
       WHEN 'http' THEN regexp_replace(lower(regexp_extract(u, '^.*?://(?:[^/?]*@)?([^/?]*)', 1)), ':80$', '')
       WHEN 'https' THEN regexp_replace(lower(regexp_extract(u, '^.*?://(?:[^/?]*@)?([^/?]*)', 1)), ':443$', '')
       ELSE regexp_replace(lower(regexp_extract(u, '^.*?://(?:[^/?]*@)?([^/?]*)', 1)), ':$', '') END
  || rtrim(regexp_extract(u, '^.*?://[^/?]*([^?]*)', 1), '/') || regexp_extract(u, '^[^?]*(\?.*)$', 1)
ELSE u END"""

ARRIVALS = f"""
arrivals AS (
  SELECT entry_id, {URL_KEY} AS key FROM (
    SELECT entry_id, split_part(trim(url, E' \\t\\r\\n'), '#', 1) AS u FROM frontier WHERE url IS NOT NULL
    UNION ALL SELECT -1, split_part(trim(url, E' \\t\\r\\n'), '#', 1) FROM docs WHERE url IS NOT NULL))"""

NOW = """
now AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST) AS k FROM docs)
  WHERE k = 1 AND NOT coalesce(is_removed, false))"""


def _alike(k: int, share: float) -> str:
    """Records with their sets of sequences of k words, and how many of them two records have in common."""
    run = " || ' ' || ".join(f"ws[i + {j}]" for j in range(k))
    return f"""WITH {NOW},
words AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM now),
runs AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: {run})) AS x FROM words WHERE len(ws) >= {k}),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
alike AS (
  SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(p.n) AS na, any_value(q.n) AS nb FROM runs a JOIN runs b ON a.x = b.x AND a.id < b.id
  JOIN sizes p ON p.id = a.id JOIN sizes q ON q.id = b.id GROUP BY a.id, b.id HAVING count(*) >= {share} * (any_value(p.n) + any_value(q.n) - count(*)) - 1e-9)"""


CLASSES = """
classes AS (SELECT id, coalesce((SELECT min(a) FROM alike WHERE alike.b = now.id AND c = na AND c = nb), id) AS class FROM now),
links AS (
  SELECT DISTINCT least(x.class, y.class) AS a, greatest(x.class, y.class) AS b, round(c / (na + nb - c), 6) AS similarity
  FROM alike JOIN classes x ON x.id = a JOIN classes y ON y.id = b WHERE x.class <> y.class)"""

PASSAGE = " || ' ' || ".join(f"ws[i + {j}]" for j in range(12))


def _passages(key: str, source: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(list_transform(range(1, len(ws) - 10), lambda i: {PASSAGE})) AS x FROM (
    SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {source}) WHERE len(ws) >= 12"""


ORACLES = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_passages('doc_id', 'documents')}) JOIN ({_passages('item_id', 'eval_items')}) USING (x)",
    "p5_found": _alike(3, 0.6) + " SELECT a AS id_a, b AS id_b FROM alike",
    "p5_groups": f"{_alike(5, 0.8)}, {CLASSES} SELECT id, class, (SELECT count(*) FROM links WHERE a = class OR b = class) AS links FROM classes",
    "p5_links": f"{_alike(5, 0.8)}, {CLASSES} SELECT * FROM links",
    "p2_found": FREQUENCIES + "SELECT term, mark FROM freq WHERE mark IS NOT NULL",
    "p2_term_frequencies": FREQUENCIES + "SELECT * FROM freq",
    "p3_found": f"WITH {ARRIVALS} SELECT entry_id FROM (SELECT entry_id, min(entry_id) OVER (PARTITION BY key) AS began FROM arrivals) WHERE entry_id > began",
    "p4_cleaned": r"""
WITH now AS (
  SELECT id, content, CAST(crawled_at AS DATE) AS day, regexp_replace(lower(coalesce(domain, regexp_extract(url, '^[^:]*://([^/?#:]*)', 1))), '^www\.', '') AS site FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST) AS k FROM docs)
  WHERE k = 1 AND NOT coalesce(is_removed, false)),
lines AS (
  SELECT id, site, day, unnest(string_split(content, E'\n')) AS text, unnest(range(len(string_split(content, E'\n')))) AS line_no FROM now WHERE content <> ''),
same AS (SELECT *, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS line FROM lines),
clusters AS (SELECT site, min(id) AS id FROM now WHERE content <> '' GROUP BY site, content),
bad AS (
  SELECT site, line FROM same JOIN clusters USING (site, id) WHERE line <> ''
  GROUP BY site, line HAVING count(DISTINCT id) >= 5 AND count(DISTINCT coalesce(day, DATE '0001-01-01')) >= 5),
kept AS (
  SELECT id, string_agg(text, E'\n' ORDER BY line_no) FILTER (WHERE bad.line IS NULL) AS content, count(bad.line) AS removed
  FROM same LEFT JOIN bad USING (site, line) GROUP BY id)
SELECT now.id, CASE WHEN kept.id IS NULL THEN now.content ELSE coalesce(kept.content, '') END AS content, CAST(coalesce(removed, 0) AS INTEGER) AS removed FROM now LEFT JOIN kept USING (id)""",
    "p4_found": r"""
WITH now AS (
  SELECT id, content, regexp_replace(lower(coalesce(domain, regexp_extract(url, '^[^:]*://([^/?#:]*)', 1))), '^www\.', '') AS site FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST) AS k FROM docs)
  WHERE k = 1 AND NOT coalesce(is_removed, false)),
lines AS (
  SELECT id, site, unnest(string_split(content, E'\n')) AS line, unnest(range(len(string_split(content, E'\n')))) AS line_no FROM now WHERE content IS NOT NULL),
same AS (
  SELECT id, site, line_no, regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS line FROM lines)
SELECT id, CAST(line_no AS INTEGER) AS line_no FROM same
JOIN (SELECT site, line FROM same WHERE line <> '' GROUP BY site, line HAVING count(DISTINCT id) >= 5) USING (site, line)""",
    "p7_found": f"""WITH {RESOLVED},
df AS (SELECT term, count(*) AS n FROM resolved GROUP BY term)
SELECT doc_id, term FROM resolved JOIN df USING (term) WHERE tf >= 5 AND n BETWEEN 2 AND 25""",
    "p7_weights": f"""WITH {RESOLVED},
term_stats AS (
  SELECT term, ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf) AS h FROM resolved GROUP BY term)
SELECT doc_id, term, round(ln(1 + tf) * (1 - h / ln((SELECT count(DISTINCT doc_id) FROM resolved))), 6) AS weight FROM resolved JOIN term_stats USING (term)""",
}
