"""Queries on time windows, drift, changes, rate limits, sets and preferences, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdex.operators import drift as DR
from sparrowdex.operators import index as I
from sparrowdex.operators import learn as L
from sparrowdex.operators import rank as R
from sparrowdex.operators.vectors import merged_vectors
from sparrowdex.plans.pages import RANKED, STEMS, _features, _index, _pages
from sparrowdex.session import through_table
from sparrowdex.sources.tables import table
from sparrowdex.streaming import changes as S


def _events(spark, d):
    return table(spark, d, "events")


def _tokens(spark, d):
    return DR.drift_tokens(table(spark, d, "documents"), "doc_id", "text", "fetched_at")


def drift_windows(spark, d):
    return _tokens(spark, d).groupBy("win").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("w").alias("terms"), F.count("*").alias("tokens"))


def cooccurrence(spark, d):
    return DR.cooccurrence(_tokens(spark, d), "doc_id")


def _drift(spark, d):
    return DR.term_drift(DR.ppmi(_tokens(spark, d), "doc_id"))


def term_drift(spark, d):
    return _drift(spark, d)


def drift_motion(spark, d):
    m = DR.drift_motion(through_table(DR.ppmi(_tokens(spark, d), "doc_id"), "ppmi"))
    return m.select("w", "windows", F.round("velocity", 6).alias("velocity"), F.round("acceleration", 6).alias("acceleration"))


def drift_report(spark, d):
    """The twenty terms of largest drift."""
    return DR.drift_report(_drift(spark, d))


def window_centroids(spark, d):
    return DR.window_centroids(DR.ppmi(_tokens(spark, d), "doc_id")).select("win", "ctx", F.round("mean", 9).alias("mean"))


def doc_drift(spark, d):
    return DR.document_drift(_tokens(spark, d), _drift(spark, d), "doc_id").select("doc_id", F.round("drift", 9).alias("drift"))


def drift_summary(spark, d):
    return _drift(spark, d).agg(F.count("*").alias("terms"), F.count_if("drifted").alias("drifted"), F.round(F.avg("magnitude"), 4).alias("mean"))


def time_range_agg(spark, d):
    e = _events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "value")
    return DR.range_aggregate(e, "ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("n", F.round("total", 4).alias("total"))


MARKS = ["2024-01-03 00:00:00", "2024-01-15 12:00:00", "2030-01-01 00:00:00"]


def time_lower_bound(spark, d):
    """The place of a few times among the events."""
    return DR.lower_bound(_events(spark, d).select(F.col("ts").cast("timestamp").alias("ts")), "ts", MARKS).select(F.unix_micros("t").alias("t_us"), "idx")


def range_vector(spark, d):
    """Mean vector over a range of times, the ids of vectors being their days."""
    v = table(spark, d, "embeddings").select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(vec_id % 365 as int))").alias("at"), F.col("embedding").alias("vector"), (F.col("vec_id") % 7 + 1).alias("n"))
    return DR.range_vector(v, "at", "2024-02-01 00:00:00", "2024-03-01 00:00:00").select("i", F.round("mean", 6).alias("mean"))


def merged_means(spark, d):
    """Two vectors of each label merged by their counts."""
    v = table(spark, d, "embeddings")
    g = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("a"), F.max_by("embedding", "vec_id").alias("b"), F.min("vec_id").alias("n"), F.max("vec_id").alias("m"))
    return g.select("label", F.posexplode(merged_vectors("a", "b", "n", "m")).alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def time_windows(spark, d):
    r = _events(spark, d).agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    w = r.select("b", F.explode(F.expr("sequence(date_trunc('day', a), b, interval 7 days)")).alias("start"))
    return w.select(F.unix_micros("start").alias("start_us"), F.unix_micros(F.least(F.expr("start + interval 7 days"), "b")).alias("end_us"))


def tumbling_counts(spark, d):
    c = S.tumbling_counts(_events(spark, d), "ts", "event_type", "1 day")
    return c.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def late_events(spark, d):
    """Frontier entries discovered more than an hour before the newest one that arrived earlier."""
    e = table(spark, d, "frontier").select("entry_id", F.unix_micros(F.col("discovered_at").cast("timestamp")).alias("us"))
    return S.late_rows(e, "entry_id", "us", 3_600_000_000).select("entry_id")


def rate_limit_hits(spark, d):
    e = _events(spark, d).select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    r = S.rate_limited(e, "user_id", "at", 3, 86_400_000)
    return r.groupBy("key").agg(F.count("*").alias("hits"), F.count_if("refused").alias("refused"))


def _changes(spark, d):
    op = F.when(F.col("event_type") == "purchase", "remove").when(F.col("event_type") == "click", "update").otherwise("add")
    return _events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"), op.alias("op"), "event_id", "value")


def upsert_latest(spark, d):
    return I.latest_changes(_changes(spark, d), "user_id", "ts").select("user_id", "op", "event_id")


def tombstone_delete(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(None).cast("timestamp").alias("ts"), F.lit("add").alias("op"), F.lit(0).cast("long").alias("event_id"), F.lit(0.0).alias("value"))
    return I.apply_changes(base, _changes(spark, d), "user_id", "ts", "op").select("user_id", "event_id")


def main_delta_merge(spark, d):
    p = table(spark, d, "postings").where("term IS NOT NULL AND tf IS NOT NULL").select(F.lower(F.trim("term")).alias("term"), "doc_id", "tf", "segment_id")
    one = lambda q: p.where(q).groupBy("term", "doc_id").agg(F.max("tf").alias("tf"))
    return I.merge_delta(one("segment_id < 2"), one("segment_id >= 2"), ["term", "doc_id"])


def set_union(spark, d):
    return table(spark, d, "docs").select("id").union(table(spark, d, "postings").select("doc_id")).distinct()


def set_intersect(spark, d):
    return table(spark, d, "docs").select("id").intersect(table(spark, d, "postings").select(F.col("doc_id").alias("id")))


def set_except(spark, d):
    return table(spark, d, "docs").select("id").subtract(table(spark, d, "page_labels").select("id"))


def _clicks(spark, d):
    """Results shown to users, and whether they were bought: the part is the user's choice among those looked at."""
    return _events(spark, d).where("event_id IS NOT NULL").select("user_id", (F.col("event_id") % 97).alias("item"), (F.col("event_type") == "purchase").alias("good"))


def ltr_pairs(spark, d):
    p = L.preference_pairs(_clicks(spark, d), "user_id", "item", "good")
    return p.groupBy("winner", "loser").agg(F.count("*").alias("n"))


def _ltr_features(spark, d):
    """All features of the linear score for a query's pages; clicks and dwell aren't in the data."""
    f = _features(spark, d).join(_index(spark, d).ranked(STEMS).select("doc_id", "tf_idf", "length"), "doc_id")
    return f.select("doc_id", "tf_idf", "bm25", "page_rank", "freshness", "authority", (F.least(F.lit(1.0), F.col("length") / 1000)).alias("length"), "density", F.lit(0.0).alias("dwell"), F.lit(0.0).alias("clicks"), "exact", "title")


def ltr_linear_score(spark, d):
    return L.linear_score(_ltr_features(spark, d)).select("doc_id", F.round("score", 6).alias("score"))


def ltr_model(spark, d):
    """Boosted trees fitted to the pages' composite score, and what they say of each."""
    f = _ltr_features(spark, d).join(R.composite(_features(spark, d)).select("doc_id", F.col("score").alias("target")), "doc_id")
    f = through_table(f, "ranker-features")
    return L.fit_ranker(f, "target", list(L.WEIGHTS)).transform(f).select("doc_id", F.round("prediction", 6).alias("score"))


def ltr_blend(spark, d):
    """Composite scores blended with linear ones where there are such."""
    results, other = R.composite(_features(spark, d)).select("doc_id", "score"), L.linear_score(_ltr_features(spark, d).where("exact = 0")).select("doc_id", "score")
    return R.blended(results, other).select("doc_id", F.round("score", 6).alias("score"))


def ltr_updated(spark, d):
    """The linear score's weights after a step along all pairs of a purchased and another item of a user."""
    items = _events(spark, d).groupBy((F.col("event_id") % 97).alias("item")).agg(F.avg("value").alias("dwell"), F.count("*").alias("clicks"))
    p = L.preference_pairs(_clicks(spark, d), "user_id", "item", "good")
    side = lambda x, on: items.select(F.col("item").alias(on), *[F.col(c).alias(f"{x}_{c}") for c in ("dwell", "clicks")])
    w = L.updated_weights(p.join(F.broadcast(side("w", "winner")), "winner").join(F.broadcast(side("l", "loser")), "loser"), ["dwell", "clicks"], rate=1e-4)
    return spark.createDataFrame([(k, round(w[k], 6)) for k in ("dwell", "clicks")], "feature string, weight double")


def feature_importance(spark, d):
    return L.feature_importance(spark)


def drift_reranked(spark, d):
    """Composite scores of pages, penalised by the drift of their words."""
    p = _pages(spark, d).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "title", "content").alias("text"), F.col("crawled_at").alias("at"))
    tokens = through_table(DR.drift_tokens(p, "doc_id", "text", "at", 365), "tokens")
    drift = DR.document_drift(tokens, DR.term_drift(DR.ppmi(tokens, "doc_id")), "doc_id")
    return R.drift_penalised(R.composite(_features(spark, d)).select("doc_id", "score"), drift).select("doc_id", F.round("score", 6).alias("score"))


TOKENS = rf"""SELECT doc_id, win, w, pos FROM (SELECT doc_id, win, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (
SELECT doc_id, CAST(floor(epoch_ms(fetched_at) / (30 * 86400000.0)) AS BIGINT) AS win,
list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(c) for c in DR.COMMON)})) AS ws
FROM documents WHERE fetched_at IS NOT NULL AND text IS NOT NULL))"""
CO = f"""WITH tok AS MATERIALIZED ({TOKENS}), co AS MATERIALIZED (SELECT a.win, a.w, b.w AS ctx, count(*) AS n FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) BETWEEN 1 AND 5 AND a.w <> b.w GROUP BY ALL)"""
DRIFT = f"""{CO}, wt AS (SELECT win, w, sum(n) AS nw FROM co GROUP BY ALL), tt AS (SELECT win, sum(nw) AS t FROM wt GROUP BY win),
pp AS MATERIALIZED (SELECT co.win, co.w, co.ctx, ln(n * t::DOUBLE / (a.nw * b.nw)) AS v FROM co JOIN wt a USING (win, w) JOIN wt b ON b.win = co.win AND b.w = ctx JOIN tt ON tt.win = co.win WHERE ln(n * t::DOUBLE / (a.nw * b.nw)) > 1e-12),
nm AS (SELECT win, w, sqrt(sum(v * v)) AS norm FROM pp GROUP BY ALL),
la AS (SELECT *, lag(win) OVER o AS before, lag(norm) OVER o AS nb, lead(win) OVER o AS nx, row_number() OVER o AS windows FROM nm WINDOW o AS (PARTITION BY w ORDER BY win)),
dr AS (SELECT la.w, CAST(any_value(windows) AS INTEGER) AS windows, round(CASE WHEN any_value(before) IS NULL THEN 0 ELSE 1 - coalesce(sum(a.v * b.v), 0) / (any_value(norm) * any_value(nb)) END, 6) AS magnitude
  FROM la LEFT JOIN pp a ON a.win = la.win AND a.w = la.w LEFT JOIN pp b ON b.win = la.before AND b.w = la.w AND b.ctx = a.ctx WHERE nx IS NULL GROUP BY la.w)"""
CH = "SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'remove' WHEN 'click' THEN 'update' ELSE 'add' END AS op, event_id, value FROM events"
LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, op DESC, event_id DESC) AS k FROM ({CH})) WHERE k = 1"
POSTED = "SELECT lower(trim(term)) AS term, doc_id, max(tf) AS tf FROM postings WHERE term IS NOT NULL AND tf IS NOT NULL AND"

TFIDF = " + ".join(f"CAST(t{i} AS DOUBLE) / length * ln(n / greatest(1, d{i}))" for i in range(len(STEMS)))
LINEAR = f"""{RANKED}, ti AS (SELECT doc_id, length, {TFIDF} AS tf_idf FROM docs_, tot),
lin AS (SELECT doc_id, exact, 0.15 * tf_idf + 0.2 * bm25 + 0.15 * page_rank + 0.1 * freshness + 0.1 * authority + 0.02 * least(1.0, length / 1000) + 0.03 * density + 0.05 * exact + 0.05 * title AS linear,
  (0.35 / (1 + exp(-bm25)) + 0.2 * page_rank + 0.15 * freshness + 0.1 * authority + 0.1 * exact + 0.1 * title) * CASE WHEN density > 0.3 THEN 0.5 ELSE 1 END AS composite FROM feats JOIN ti USING (doc_id))"""

ORACLES = {
    "drift_windows": f"SELECT win, count(DISTINCT doc_id) AS docs, count(DISTINCT w) AS terms, count(*) AS tokens FROM ({TOKENS}) GROUP BY win",
    "cooccurrence": f"{CO} SELECT * FROM co",
    "term_drift": f"{DRIFT} SELECT *, magnitude > 0.35 AS drifted FROM dr",
    "doc_drift": f"{DRIFT} SELECT doc_id, round(coalesce(avg(magnitude), 0), 9) AS drift FROM tok LEFT JOIN (SELECT * FROM dr WHERE magnitude > 0.35) USING (w) GROUP BY doc_id",
    "drift_summary": f"{DRIFT} SELECT count(*) AS terms, count(*) FILTER (WHERE magnitude > 0.35) AS drifted, round(avg(magnitude), 4) AS mean FROM dr",
    "drift_report": f"{DRIFT} SELECT CAST(row_number() OVER (ORDER BY magnitude DESC, w) AS INTEGER) AS rank, w, windows, magnitude FROM dr WHERE magnitude > 0.35 QUALIFY rank <= 20",
    "drift_motion": f"""{DRIFT}, k3 AS (SELECT win, w, CAST(count(*) OVER (PARTITION BY w) AS INTEGER) AS windows, row_number() OVER (PARTITION BY w ORDER BY win DESC) AS k FROM nm),
ab AS (SELECT w, windows, ctx, coalesce(max(v) FILTER (WHERE k = 1), 0) AS a, coalesce(max(v) FILTER (WHERE k = 2), 0) AS b, coalesce(max(v) FILTER (WHERE k = 3), 0) AS c FROM pp JOIN k3 USING (win, w) WHERE k <= 3 GROUP BY ALL)
SELECT w, windows, CASE WHEN windows > 1 THEN round(sqrt(sum((a - b) * (a - b))), 6) ELSE 0 END AS velocity, CASE WHEN windows > 2 THEN round(sqrt(sum((a - 2 * b + c) * (a - 2 * b + c))), 6) ELSE 0 END AS acceleration FROM ab GROUP BY w, windows""",
    "window_centroids": f"{DRIFT} SELECT win, ctx, round(sum(v) / any_value(n), 9) AS mean FROM pp JOIN (SELECT win, count(DISTINCT w) AS n FROM pp GROUP BY win) USING (win) GROUP BY win, ctx",
    "time_range_agg": "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
    "time_windows": "SELECT epoch_us(s) AS start_us, epoch_us(least(s + INTERVAL 7 DAY, b)) AS end_us FROM (SELECT unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP, max(ts)::TIMESTAMP, INTERVAL 7 DAY)) AS s, max(ts) AS b FROM events)",
    "tumbling_counts": "SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "late_events": "SELECT entry_id FROM (SELECT entry_id, discovered_at AS ts, max(discovered_at) OVER (ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM frontier) WHERE ts < m - INTERVAL 1 HOUR",
    "rate_limit_hits": """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT key, k, t, t AS opened, 1 AS n FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.k, e.t, CASE WHEN e.t > r.opened + 86400000 THEN e.t ELSE r.opened END, CASE WHEN e.t > r.opened + 86400000 THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
SELECT key, count(*) AS hits, count(*) FILTER (WHERE n > 3) AS refused FROM r GROUP BY key""",
    "upsert_latest": f"SELECT user_id, op, event_id FROM ({LATEST})",
    "tombstone_delete": f"SELECT user_id, event_id FROM ({LATEST}) WHERE op <> 'remove' UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "main_delta_merge": f"WITH m AS ({POSTED} segment_id < 2 GROUP BY ALL), x AS ({POSTED} segment_id >= 2 GROUP BY ALL) SELECT * FROM x UNION ALL SELECT m.* FROM m ANTI JOIN x USING (term, doc_id)",
    "set_union": "SELECT id FROM docs UNION SELECT doc_id FROM postings",
    "set_intersect": "SELECT id FROM docs INTERSECT SELECT doc_id FROM postings",
    "set_except": "SELECT id FROM docs EXCEPT SELECT id FROM page_labels",
    "time_lower_bound": " UNION ALL ".join(f"SELECT epoch_us(TIMESTAMP '{t}') AS t_us, greatest(0, least(count(*) FILTER (WHERE ts < TIMESTAMP '{t}'), count(ts) - 1)) AS idx FROM events" for t in MARKS),
    "range_vector": """SELECT CAST(i - 1 AS INTEGER) AS i, round(sum(embedding[i]::DOUBLE * n) / sum(n), 6) AS mean FROM (SELECT embedding, vec_id % 7 + 1 AS n FROM embeddings
WHERE TIMESTAMP '2024-01-01' + to_days((vec_id % 365)::INTEGER) BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-03-01'), range(1, 65) r(i) GROUP BY i""",
    "merged_means": """SELECT label, CAST(i - 1 AS INTEGER) AS i, round(CASE WHEN n + m > 0 THEN (a[i]::DOUBLE * n + b[i]::DOUBLE * m) / (n + m) ELSE a[i]::DOUBLE END, 6) AS x
FROM (SELECT label, arg_min(embedding, vec_id) AS a, arg_max(embedding, vec_id) AS b, min(vec_id) AS n, max(vec_id) AS m FROM embeddings GROUP BY label), range(1, 65) r(i)""",
    "ltr_pairs": "WITH o AS (SELECT user_id, event_id % 97 AS item, bool_or(event_type = 'purchase') AS g FROM events WHERE event_id IS NOT NULL GROUP BY ALL) SELECT a.item AS winner, b.item AS loser, count(*) AS n FROM o a JOIN o b USING (user_id) WHERE a.g AND NOT b.g GROUP BY ALL",
    "ltr_linear_score": f"{LINEAR} SELECT doc_id, round(linear, 6) AS score FROM lin",
    "ltr_blend": f"{LINEAR} SELECT doc_id, round(CASE WHEN exact = 0 THEN 0.7 * composite + 0.3 * linear ELSE composite END, 6) AS score FROM lin",
    "ltr_updated": """WITH o AS (SELECT user_id, event_id % 97 AS item, bool_or(event_type = 'purchase') AS g FROM events WHERE event_id IS NOT NULL GROUP BY ALL),
it AS (SELECT event_id % 97 AS item, avg(value) AS dwell, count(*)::DOUBLE AS clicks FROM events GROUP BY 1),
p AS (SELECT w.dwell - l.dwell AS dd, w.clicks - l.clicks AS dc FROM o a JOIN o b USING (user_id) JOIN it w ON w.item = a.item JOIN it l ON l.item = b.item WHERE a.g AND NOT b.g),
s AS (SELECT avg(dd / (1 + exp(0.08 * dd + 0.07 * dc))) AS gd, avg(dc / (1 + exp(0.08 * dd + 0.07 * dc))) AS gc FROM p)
SELECT 'dwell' AS feature, round(0.08 + 0.0001 * gd, 6) AS weight FROM s UNION ALL SELECT 'clicks', round(0.07 + 0.0001 * gc, 6) FROM s""",
    "feature_importance": f"SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, importance FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in L.WEIGHTS.items())}) v(feature, importance)",
}
QUERIES = {k: globals()[k] for k in (*ORACLES, "ltr_model", "drift_reranked")}
