"""Queries on pages, domains, crawl relations, quality and composite ranking, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdex.functions.dialect import DUCK, SPARK, apply_steps, sql_steps
from sparrowdex.functions.text import query_stems, readability_steps, terms_sql
from sparrowdex.operators import crawl as C
from sparrowdex.operators import quality as QL
from sparrowdex.operators import rank as R
from sparrowdex.engine import SearchEngine
from sparrowdex.operators.index import latest_changes
from sparrowdex.operators.store import TextIndex, exists, fingerprint
from sparrowdex.session import shared_dir, through_table
from sparrowdex.sources.tables import table

NOW = "2026-06-01 00:00:00"
STEMS = query_stems("slow search index")


def _pages(spark, d):
    """The latest fetch of each page, removed ones left out."""
    cols = ["id", "crawled_at", "is_removed", "title", "content", "url", "domain", "page_rank", "outgoing_links"]
    return latest_changes(table(spark, d, "docs").where("crawled_at IS NOT NULL").select(*cols), "id", "crawled_at").where("NOT is_removed")


PAGES = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC) AS k FROM docs WHERE crawled_at IS NOT NULL) WHERE k = 1 AND NOT is_removed"


def _domains(spark, d):
    return table(spark, d, "docs").where("domain IS NOT NULL").select("domain").distinct()


def domain_authority(spark, d):
    return _domains(spark, d).select("domain", F.round(R.authority("domain"), 6).alias("authority"))


def domain_reputation(spark, d):
    return _domains(spark, d).select("domain", F.round(R.reputation("domain"), 6).alias("reputation"))


def tld_credibility(spark, d):
    return _domains(spark, d).select("domain", R.credibility("domain").alias("credibility"))


def freshness_decay(spark, d):
    return _pages(spark, d).select("id", F.round(R.freshness("crawled_at", NOW, 365.0), 6).alias("freshness"))


def _with_headers(spark, d):
    """The latest fetch of each page with its headers, which as maps have no order and are carried as text."""
    docs = table(spark, d, "docs").where("crawled_at IS NOT NULL").select("id", "crawled_at", "is_removed", "title", "content", "url", "domain", "outgoing_links", F.to_json("headers").alias("headers"))
    return latest_changes(docs, "id", "crawled_at").where("NOT is_removed").withColumn("headers", F.from_json("headers", "map<string,string>"))


def _index(spark, d):
    p = _pages(spark, d).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "title", "title", "content").alias("text"))
    return TextIndex.of(spark, f"{d}/docs.parquet", p, "pages-index")


def _features(spark, d):
    p = _pages(spark, d)
    b = _index(spark, d).ranked(STEMS)
    low, title = F.lower(F.concat_ws(" ", "title", "content")), F.lower(F.coalesce("title", F.lit("")))
    f = b.join(p, b.doc_id == p.id)
    hit = F.lit(False)
    for s in STEMS:
        hit |= F.contains(title, F.lit(s))
    return f.select(
        "doc_id", "bm25", F.least(F.lit(1.0), F.coalesce(F.nanvl("page_rank", F.lit(0.0)), F.lit(0.0)) / 10).alias("page_rank"), R.freshness("crawled_at", NOW, 365.0).alias("freshness"),
        R.authority("domain").alias("authority"), F.contains(low, F.lit(" ".join(STEMS))).cast("int").alias("exact"), hit.cast("int").alias("title"),
        F.lit(0.0).alias("spam"), R.keyword_density(low, STEMS, F.col("length")).alias("density"),
    )


def rank_features(spark, d):
    f = _features(spark, d)
    return f.select("doc_id", "exact", "title", *[F.round(c, 6).alias(c) for c in ("bm25", "page_rank", "freshness", "authority", "density")])


def composite_rank(spark, d):
    s = R.composite(_features(spark, d)).select("doc_id", F.round("score", 6).alias("score"))
    return R.top(s, 20)


def spam_features(spark, d):
    f = QL.quality_features(table(spark, d, "docs").select("id", "content", "domain", "outgoing_links", "headers"))
    return f.select("id", *[F.round(c, 6).alias(c) for c in ("stuffing", "word_length", "words", "uppercase", "punctuation", "digits", "repeated", "common", "link_density", "links", "external_links", "reputation", "credibility", "subdomains")])


def link_farm(spark, d):
    p = table(spark, d, "docs").where("domain IS NOT NULL AND outgoing_links IS NOT NULL")
    return p.select("id", F.round(QL.link_farm(F.col("outgoing_links"), F.col("domain")), 6).alias("score"))


def spam_flags(spark, d):
    p = _with_headers(spark, d)
    f = QL.quality_features(p).join(apply_steps(p.select("id", "content"), readability_steps(SPARK, "content", 0.5)).select("id", "readability"), "id")
    return QL.flagged(f).select("id", F.array_join("flags", "; ").alias("flags"))


def spam_model(spark, d):
    f = through_table(QL.quality_features(_with_headers(spark, d)), "quality")
    return QL.fit_quality_model(f, table(spark, d, "page_labels")).transform(f).select("id", F.col("prediction").cast("int").alias("spam"))


def html_parse(spark, d):
    """Pages rebuilt as HTML and parsed again."""
    p = _pages(spark, d)
    html = F.concat(F.lit("<html><head><TITLE class='t'> "), F.coalesce("title", F.lit("")), F.lit(" </TITLE><style>p {}</style></head><body><script>x()</script><p>"), F.coalesce("content", F.lit("")), F.lit("&nbsp;</p></body></html>"))
    return p.select("id", C.html_title(html).alias("title"), C.html_text(html).alias("text"))


def link_extract(spark, d):
    html = F.array_join(F.transform("outgoing_links", lambda u: F.concat(F.lit('<a class="x" href="'), F.regexp_replace(u, "^https?://[^/]*", ""), F.lit('">x</a>'))), " ")
    p = _pages(spark, d).where("outgoing_links IS NOT NULL").select("id", "url", F.posexplode(C.html_links(html, F.trim("url"))).alias("i", "link"))
    return p.select("id", "i", "link")


def frontier_priority(spark, d):
    p = _pages(spark, d)
    links = p.where("outgoing_links IS NOT NULL").select(F.explode("outgoing_links").alias("url"), F.lit(1).alias("depth"), F.lit(0.0).alias("rank"))
    return C.frontier_rows(links, table(spark, d, "docs").where("url IS NOT NULL"))


def robots_filter(spark, d):
    f = table(spark, d, "frontier").where("url IS NOT NULL AND domain IS NOT NULL").select("url", "domain").distinct()
    rules = f.select("domain").distinct().select("domain", F.explode(F.array(F.struct(F.lit("/a/").alias("prefix"), F.lit(False).alias("allow")), F.struct(F.lit("/a/b/").alias("prefix"), F.lit(True).alias("allow")))).alias("r")).select("domain", "r.*")
    return C.robots_allowed(f, rules)


def politeness_slots(spark, d):
    return C.politeness_slots(table(spark, d, "frontier"))


def _links(spark, d):
    return _pages(spark, d).where("outgoing_links IS NOT NULL AND url IS NOT NULL").select(F.col("url").alias("src"), F.explode("outgoing_links").alias("dst"))


def pagerank(spark, d):
    return C.page_rank(_links(spark, d)).select("node", F.round("rank", 9).alias("rank"))


def matched_terms(spark, d):
    """Which of a query's terms each page holds."""
    p = _pages(spark, d).select("id", R.matched_terms(F.concat_ws(" ", "title", "content"), STEMS).alias("m"))
    return p.where("size(m) > 0").select("id", F.array_join("m", " ").alias("matched"))


def crawl_documents(spark, d):
    """A crawl through the pages from the front pages of each site, two links deep."""
    p = _pages(spark, d).where("url IS NOT NULL").select(F.trim("url").alias("url"), F.concat(F.lit("<title>"), F.coalesce("title", F.lit("")), F.lit("</title><p>"), F.coalesce("content", F.lit(""))).alias("body"), F.col("outgoing_links").alias("links"))
    seeds = p.groupBy(F.expr("try_parse_url(url, 'HOST')").alias("h")).agg(F.min("url").alias("url")).select("url")
    documents, _ = C.crawl(p, seeds, 1 << 40, 2, 1 << 16)
    return documents.select("url", "title", "crawl_depth", F.length("content").alias("length"))


def search_page(spark, d):
    """A page of results of the whole pipeline: correction, rank, blend, drift, spam, snippets."""
    docs = _with_headers(spark, d).join(_pages(spark, d).select("id", "page_rank"), "id").withColumnRenamed("crawled_at", "at").withColumnRenamed("outgoing_links", "links")
    path = f"{shared_dir(spark).rstrip('/')}/engine-{fingerprint(spark, f'{d}/docs.parquet')}"
    labels = table(spark, d, "page_labels").withColumnRenamed("id", "doc_id")
    engine = SearchEngine(docs, path, NOW, "id", labels)
    if not exists(spark, f"{path}/dictionary/_SUCCESS"):
        engine.rebuild()
    return engine.search("slow serch index").select("doc_id", "rank", F.round("score", 6).alias("score"), "title", "snippet", F.array_join("matched", " ").alias("matched"))


def ring_replicas(spark, d):
    return C.ring_replicas(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", C.ring(spark, NODES), 3).select("o_orderkey", F.array_join("nodes", ",").alias("nodes"))


def ring_moved(spark, d):
    """How many keys another node owns after one has left."""
    places = C.ring(spark, NODES)
    k = table(spark, d, "orders").select("o_orderkey")
    a, b = C.ring_lookup(k, "o_orderkey", places), C.ring_lookup(k, "o_orderkey", C.ring_without(places, NODES[3])).withColumnRenamed("node", "later")
    return a.join(b, "o_orderkey").groupBy("node", "later").agg(F.count("*").alias("n"))


NODES = ["node-a", "node-b", "node-c", "node-d"]


def ring_lookup(spark, d):
    return C.ring_lookup(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", C.ring(spark, NODES))


def ring_balance(spark, d):
    n = ring_lookup(spark, d).groupBy("node").agg(F.count("*").alias("n"))
    load = spark.createDataFrame([(x,) for x in NODES], "node string").join(n, "node", "left").na.fill(0, ["n"])
    return load.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.round(1 - F.stddev_pop("n") / F.avg("n"), 6).alias("balance"))


AUTH = f"least(1.0, 0.3 + CASE WHEN ends_with(dm, '.edu') OR ends_with(dm, '.gov') THEN 0.4 WHEN ends_with(dm, '.org') THEN 0.2 ELSE 0 END + CASE WHEN length(split_part(dm, '.', 1)) BETWEEN 3 AND 12 THEN 0.1 ELSE 0 END + CASE WHEN {' OR '.join(f'''contains(dm, '{a}')''' for a in R.AUTHORITIES)} THEN 0.3 ELSE 0 END)::DOUBLE"
REPU = "greatest(0.0, least(1.0, 0.5" + "".join(f" + CASE WHEN contains(dm, '{p}') THEN 0.3 ELSE 0 END" for p in R.REPUTABLE) + "".join(f" - CASE WHEN contains(dm, '{p}') THEN 0.3 ELSE 0 END" for p in R.SUSPICIOUS) + "))::DOUBLE"
CRED = f"(CASE split_part(dm, '.', -1) {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in R.CREDIBILITY.items())} ELSE 0.3 END)::DOUBLE"
DOMS = "SELECT DISTINCT domain, domain AS dm FROM docs WHERE domain IS NOT NULL"
FRESH = f"exp(-(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(crawled_at)) / (365 * 86400000.0))"
CNT = ", ".join(f"count(*) FILTER (WHERE term = '{t}') AS t{i}" for i, t in enumerate(STEMS))
RANKED = f"""WITH pages AS ({PAGES}), txt AS (SELECT id AS doc_id, concat_ws(' ', title, title, content) AS text FROM pages),
terms AS ({terms_sql('txt')}), docs_ AS (SELECT doc_id, count(*) AS length, {CNT} FROM terms GROUP BY doc_id),
tot AS (SELECT count(*) AS n, avg(length) AS av, {', '.join(f'count(*) FILTER (WHERE t{i} > 0) AS d{i}' for i in range(len(STEMS)))} FROM docs_),
raw AS (SELECT doc_id, length, {' + '.join(f'ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * length / av))' for i in range(len(STEMS)))} AS bm25
  FROM docs_, tot WHERE {' OR '.join(f't{i} > 0' for i in range(len(STEMS)))}),
f AS (SELECT *, coalesce(domain, '') AS dm, lower(concat_ws(' ', title, content)) AS low, lower(coalesce(title, '')) AS tl FROM raw JOIN pages ON id = doc_id),
feats AS (SELECT doc_id, bm25, least(1.0, coalesce(CASE WHEN isnan(page_rank) THEN 0 ELSE page_rank END, 0) / 10) AS page_rank, {FRESH} AS freshness, {AUTH} AS authority,
  CAST(contains(low, '{' '.join(STEMS)}') AS INTEGER) AS exact, CAST({' OR '.join(f"contains(tl, '{s}')" for s in STEMS)} AS INTEGER) AS title,
  ({' + '.join(f"(length(low) - length(replace(low, '{s}', '')))::DOUBLE / {len(s)} / greatest(1, length)" for s in STEMS)}) / {len(STEMS)} AS density FROM f)"""
WORDS = "list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')"
QF = f"""SELECT id, greatest(1, coalesce(list_max(map_values(hist)), 0)) / greatest(1.0, CASE WHEN cardinality(hist) > 0 THEN n::DOUBLE / cardinality(hist) ELSE 0 END) AS stuffing,
  coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::DOUBLE / greatest(1, n) AS word_length, n::DOUBLE AS words,
  len(regexp_extract_all(t, '[A-Z]'))::DOUBLE / ch AS uppercase, len(regexp_extract_all(t, '[!?,;:.]'))::DOUBLE / ch AS punctuation, len(regexp_extract_all(t, '[0-9]'))::DOUBLE / ch AS digits,
  1 - cardinality(hist)::DOUBLE / greatest(1, n) AS repeated, len(list_filter(ws, lambda w: lower(w) IN ({', '.join(repr(c) for c in QL.COMMON)})))::DOUBLE / greatest(1, n) AS common,
  len(l)::DOUBLE / greatest(1, n) AS link_density, len(l)::DOUBLE AS links, len(list_filter(l, lambda x: NOT contains(x, dm)))::DOUBLE / greatest(1, len(l)) AS external_links,
  {REPU} AS reputation, {CRED} AS credibility, (length(dm) - length(replace(dm, '.', '')))::DOUBLE AS subdomains
FROM (SELECT *, len(ws) AS n, greatest(1, length(t)) AS ch, CASE WHEN len(ws) = 0 THEN map([]::VARCHAR[], []::BIGINT[]) ELSE list_histogram(list_transform(ws, lambda w: lower(w)))::MAP(VARCHAR, BIGINT) END AS hist FROM (
  SELECT id, t, dm, l, {WORDS} AS ws FROM (SELECT id, coalesce(content, '') AS t, coalesce(domain, '') AS dm, coalesce(outgoing_links, []::VARCHAR[]) AS l FROM SRC)))"""
QF = QF.replace("list_histogram(", "list_aggregate(").replace("lower(w)))::MAP(VARCHAR, BIGINT)", "lower(w)), 'histogram')::MAP(VARCHAR, BIGINT)")
ROUNDED = ("stuffing", "word_length", "words", "uppercase", "punctuation", "digits", "repeated", "common", "link_density", "links", "external_links", "reputation", "credibility", "subdomains")
FARM = """SELECT id, CASE WHEN len(ext) = 0 THEN 0.0 ELSE round((len(list_filter(ext, lambda x: len(list_filter(l, lambda y: contains(y, split_part(x, '/', 3)))) > 3)) + len(list_filter(ext, lambda x: split_part(x, '.', -1) IN ('xyz', 'top', 'loan', 'click', 'work', 'date'))))::DOUBLE / len(ext), 6) END AS score
FROM (SELECT id, outgoing_links AS l, list_filter(outgoing_links, lambda x: NOT contains(x, domain)) AS ext FROM SRC)"""
RING = " UNION ALL ".join(f"SELECT '{n}' AS node, '{n}:vnode:' || k AS v FROM range(150) r(k)" for n in NODES)
LOOKUP = f"""WITH places AS (SELECT h, min(node) AS node FROM (SELECT ('0x' || substr(md5(v), 1, 8))::BIGINT AS h, node FROM ({RING})) GROUP BY h),
keys AS (SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT AS kh FROM orders),
owned AS (SELECT o_orderkey, coalesce(p.node, (SELECT arg_min(node, h) FROM places)) AS node FROM keys ASOF LEFT JOIN places p ON kh <= p.h)"""
PR = f"""WITH e AS (SELECT DISTINCT src, dst FROM (SELECT url AS src, unnest(outgoing_links) AS dst FROM ({PAGES}) WHERE url IS NOT NULL) WHERE src <> dst),
w AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM e), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM n)"""
for _i in range(10):
    PR += f", r{_i + 1} AS (SELECT n.node, 0.15 + 0.85 * coalesce(g, 0) AS rank FROM n LEFT JOIN (SELECT dst, sum(rank / deg) AS g FROM w JOIN r{_i} ON src = node GROUP BY dst) ON node = dst)"

FLAG = {"keyword stuffing": "stuffing > 0.3", "high link density": "link_density > 0.1", "link farm patterns": "link_farm > 0.5", "low readability": "readability < 0.2",
    "excessive word repetition": "repeated > 0.5", "low domain reputation": "reputation < 0.2", "suspicious TLD": "credibility < 0.2", "excessive external links": "external_links > 0.8",
    "excessive scripts": "scripts > 0.5", "low content-to-HTML ratio": "content_ratio < 0.3", "excessive capitalization": "uppercase > 0.3", "excessive numbers": "digits > 0.2"}
FLAGS = f"""WITH pages AS ({PAGES}), qf AS ({QF.replace('SRC', 'pages')}), fa AS ({FARM.replace('SRC', "(SELECT id, coalesce(domain, '') AS domain, coalesce(outgoing_links, []::VARCHAR[]) AS outgoing_links FROM pages)")}),
re AS (SELECT id, readability FROM ({sql_steps('SELECT id, content FROM pages', readability_steps(DUCK, 'content', 0.5))})),
ot AS (SELECT id, len(regexp_extract_all(t, '(?i)<script')) * 100.0 / greatest(1, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> ''))) AS scripts, length(t) / greatest(1, coalesce(TRY_CAST(hl AS INTEGER), length(t)))::DOUBLE AS content_ratio
  FROM (SELECT id, coalesce(content, '') AS t, headers['content-length'] AS hl FROM pages)),
allf AS (SELECT qf.*, fa.score AS link_farm, readability, scripts, content_ratio FROM qf JOIN fa USING (id) JOIN re USING (id) JOIN ot USING (id))
SELECT id, concat_ws('; ', {', '.join(f"CASE WHEN {r} THEN '{n}' END" for n, r in FLAG.items())}) AS flags FROM allf"""
REPL = "SELECT o_orderkey, string_agg(node, ',' ORDER BY d) AS nodes FROM (SELECT o_orderkey, node, d FROM (SELECT o_orderkey, node, min((h - kh + 4294967296) % 4294967296) AS d FROM keys, places GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d) <= 3) GROUP BY o_orderkey"

ORACLES = {
    "spam_flags": FLAGS,
    "matched_terms": f"SELECT id, concat_ws(' ', {', '.join(f"CASE WHEN contains(low, '{s}') THEN '{s}' END" for s in STEMS)}) AS matched FROM (SELECT id, lower(concat_ws(' ', title, content)) AS low FROM ({PAGES})) WHERE {' OR '.join(f"contains(low, '{s}')" for s in STEMS)}",
    "ring_replicas": f"{LOOKUP} {REPL}",
    "ring_moved": f"{LOOKUP}, later AS (SELECT o_orderkey, coalesce(p.node, (SELECT arg_min(node, h) FROM places WHERE node <> '{NODES[3]}')) AS later FROM keys ASOF LEFT JOIN (SELECT * FROM places WHERE node <> '{NODES[3]}') p ON kh <= p.h) SELECT node, later, count(*) AS n FROM owned JOIN later USING (o_orderkey) GROUP BY ALL",
    "domain_authority": f"SELECT domain, round({AUTH}, 6) AS authority FROM ({DOMS})",
    "domain_reputation": f"SELECT domain, round({REPU}, 6) AS reputation FROM ({DOMS})",
    "tld_credibility": f"SELECT domain, {CRED} AS credibility FROM ({DOMS})",
    "freshness_decay": f"SELECT id, round({FRESH}, 6) AS freshness FROM ({PAGES})",
    "rank_features": f"{RANKED} SELECT doc_id, exact, title, {', '.join(f'round({c}, 6) AS {c}' for c in ('bm25', 'page_rank', 'freshness', 'authority', 'density'))} FROM feats",
    "composite_rank": f"""{RANKED}, s AS (SELECT doc_id, round((0.35 / (1 + exp(-bm25)) + 0.2 * page_rank + 0.15 * freshness + 0.1 * authority + 0.1 * exact + 0.1 * title) * CASE WHEN density > 0.3 THEN 0.5 ELSE 1 END, 6) AS score FROM feats)
SELECT * FROM (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20""",
    "spam_features": f"SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in ROUNDED)} FROM ({QF.replace('SRC', 'docs')})",
    "link_farm": FARM.replace("SRC", "docs WHERE domain IS NOT NULL AND outgoing_links IS NOT NULL"),
    "html_parse": f"SELECT id, trim(coalesce(title, '')) AS title, trim(regexp_replace(' ' || coalesce(title, '') || '  ' || regexp_replace(coalesce(content, ''), '&[^;]+;', ' ', 'g') || ' ', '\\s+', ' ', 'g')) AS text FROM ({PAGES})",
    "link_extract": f"SELECT id, CAST(i - 1 AS INTEGER) AS i, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || regexp_replace(outgoing_links[i], '^https?://[^/]*', '') AS link FROM (SELECT *, unnest(range(1, len(outgoing_links) + 1)) AS i FROM ({PAGES}) WHERE outgoing_links IS NOT NULL)",
    "frontier_priority": f"SELECT DISTINCT url, 1 AS depth, 10.0::DOUBLE AS priority FROM (SELECT unnest(outgoing_links) AS url FROM ({PAGES})) WHERE regexp_matches(url, '^https?://') AND url NOT IN (SELECT url FROM docs WHERE url IS NOT NULL)",
    "robots_filter": "SELECT url, domain FROM (SELECT DISTINCT url, domain, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM frontier WHERE url IS NOT NULL AND domain IS NOT NULL) WHERE NOT starts_with(p, '/a/') OR starts_with(p, '/a/b/')",
    "politeness_slots": "SELECT entry_id, domain, slot, CAST(floor(slot / 3) * 1000 AS BIGINT) AS start_ms FROM (SELECT entry_id, coalesce(domain, '') AS domain, row_number() OVER (PARTITION BY coalesce(domain, '') ORDER BY coalesce(priority, 1e308), entry_id) - 1 AS slot FROM frontier)",
    "pagerank": f"{PR} SELECT node, round(rank, 9) AS rank FROM r10",
    "ring_lookup": f"{LOOKUP} SELECT * FROM owned",
    "ring_balance": f"{LOOKUP}, n AS (SELECT node, count(o_orderkey) AS n FROM (VALUES {', '.join(f'''('{n}')''' for n in NODES)}) v(node) LEFT JOIN owned USING (node) GROUP BY node) SELECT max(n) AS most, min(n) AS least, round(1 - stddev_pop(n) / avg(n), 6) AS balance FROM n",
}
QUERIES = {k: globals()[k] for k in (*ORACLES, "spam_model", "crawl_documents", "search_page")}
