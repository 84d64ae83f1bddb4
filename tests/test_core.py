"""Core operators on small cases: fixtures of the text kernel, index, ranking, spelling, duplicates, streams."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowdex.functions import text as T
from sparrowdex.operators import crawl as C
from sparrowdex.operators import dedup as D
from sparrowdex.operators import drift as DR
from sparrowdex.operators import index as I
from sparrowdex.operators import learn as L
from sparrowdex.operators import quality as QL
from sparrowdex.operators import queries as Q
from sparrowdex.operators import rank as R
from sparrowdex.operators import snippets as S
from sparrowdex.operators import vectors as V
from sparrowdex.operators.skew import join_stats
from sparrowdex.streaming import changes as CH

DOCS = "doc_id long, text string, pos string, term string"


def docs(spark, *texts):
    return spark.createDataFrame([(i + 1, t, "x", None) for i, t in enumerate(texts)], DOCS)


def test_stems():
    assert T.stem_words(["better", "running", "happiness", "quickly"]) == ["better", "run", "happi", "quick"]
    assert T.query_stems("running jumped walked the AND") == ["run", "jump", "walk"]
    assert T.normalize_text("  Hello   WORLD!  Ünïcode") == "hello world unicode"


def test_tokens(spark):
    df = docs(spark, "The quick brown fox", None, "", "  \t", "le CAFÉ d'été – naïve")
    rows = {(r.doc_id, r.pos): r.term for r in T.terms(df).collect()}
    assert {k: v for k, v in rows.items() if k[0] == 1} == {(1, 1): "quick", (1, 2): "brown", (1, 3): "fox"}
    assert {v for k, v in rows.items() if k[0] == 5} == {"le", "caf", "d'et", "naive"}
    assert {k[0] for k in rows} == {1, 5}
    assert T.terms(docs(spark)).count() == 0


def test_ngrams(spark):
    r = spark.sql("SELECT array('the','quick','brown','fox') AS w, array('a') AS v").select(T.ngrams(F.col("w"), 2, "_").alias("g"), T.ngrams(F.col("v"), 2, "_").alias("h")).first()
    assert r.g == ["the_quick", "quick_brown", "brown_fox"] and r.h == []


def test_index_and_boolean(spark):
    t = T.terms(docs(spark, "apple banana apple cherry banana apple", "banana split", "cherry pie banana", None))
    post = I.postings(t)
    a = post.where("term = 'appl'").first()
    assert (a.tf, a.positions) == (3, [0, 2, 5])
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    all_docs = docs(spark, "", "", "", "")
    q = lambda *s: ids(I.boolean_query(post, all_docs, list(s)))
    b, c = T.stem_words(["banana", "cherry"])
    assert q(("AND", b), ("AND", c)) == [1, 3] and q(("AND", "appl"), ("OR", c)) == [1, 3] and q(("AND", b), ("NOT", c)) == [2] and q(("NOT", c)) == [2, 4] and q() == []
    assert ids(I.phrase_query(t, [b, "split"])) == [2] and ids(I.phrase_query(t, [])) == []
    assert ids(I.fuzzy_query(post, "bananx", 2)) == [1, 2, 3]
    s = I.corpus_stats(t).first()
    assert (s.documents, s.terms) == (3, len({r.term for r in t.collect()}))
    assert I.corpus_stats(t.limit(0)).first().avg_length == 0
    gaps = I.posting_gaps(spark.createDataFrame([("a", 5), ("a", 70000), ("a", 70002), ("b", 3)], "term string, doc_id long"))
    assert sorted((r.term, r.doc_id, r.gap) for r in gaps.collect()) == [("a", 5, 5), ("a", 70000, 69995), ("a", 70002, 2), ("b", 3, 3)]


@pytest.mark.parametrize("v", [[], [0], [1, 127, 128, 129, 300, 70000, 2**40], list(range(0, 5000, 7))])
def test_codec(v):
    assert I.vbyte_decode(I.vbyte_encode(v)) == v


def test_changes(spark):
    base = spark.createDataFrame([(1, datetime(2024, 1, 1), "add", 1), (2, datetime(2024, 1, 1), "add", 1)], "k int, at timestamp, op string, v int")
    ch = spark.createDataFrame([(2, datetime(2024, 1, 3), "remove", 0), (2, datetime(2024, 1, 2), "update", 5), (3, datetime(2024, 1, 2), "add", 7), (1, datetime(2024, 1, 2), "update", 9)], base.schema)
    once = I.apply_changes(base, ch, "k", "at", "op")
    assert sorted((r.k, r.v) for r in once.collect()) == [(1, 9), (3, 7)]
    assert sorted((r.k, r.v) for r in I.apply_changes(once, ch, "k", "at", "op").collect()) == [(1, 9), (3, 7)]


def test_bm25(spark):
    t = T.terms(docs(spark, "apple pie", "apple apple tart cake", "plum cake", None))
    got = {r.doc_id: r.bm25 for r in R.bm25(t, ["appl"]).collect()}
    idf, avg = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1), 8 / 3
    assert set(got) == {1, 2} and abs(got[1] - idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg))) < 1e-9
    assert R.bm25(t, []).count() == 0 and R.bm25(t.limit(0), ["appl"]).count() == 0


def test_pages_of_results_are_the_ranking(spark):
    s = spark.createDataFrame([(i, float(i % 4)) for i in range(23)], "doc_id long, score double")
    pages = [r.doc_id for k in range(5) for r in R.top(s, 5, 5 * k).orderBy("rank").collect()]
    assert pages == [r.doc_id for r in s.orderBy(F.desc("score"), "doc_id").collect()]


def test_domain_scores(spark):
    df = spark.createDataFrame([("x.edu",), ("spam-site.xyz",), (None,), ("en.wikipedia.org",)], "d string")
    r = {x.d: x for x in df.select("d", R.authority("d").alias("a"), R.reputation("d").alias("r"), R.credibility("d").alias("c")).collect()}
    assert abs(r["x.edu"].a - 0.7) < 1e-9 and r["spam-site.xyz"].r == 0 and r["spam-site.xyz"].c == 0.1 and r[None].a == 0.3 and r[None].c == 0.3


def test_hybrid_keeps_both_sides(spark):
    d = spark.createDataFrame([(1, 0.5), (2, -0.2)], "doc_id long, score double")
    s = spark.createDataFrame([(2, 4.0), (3, 2.0)], "doc_id long, score double")
    got = {r.doc_id: r.hybrid for r in R.hybrid(s, d, 0.5).collect()}
    assert abs(got[1] - 0.5) < 1e-9 and abs(got[3] - 0.25) < 1e-9 and abs(got[2] - (0.5 - 0.2)) < 1e-9


def test_queries(spark):
    df = spark.createDataFrame([("apple AND fruit",), ('"machine learning" now',), ("apple~2",), ("facebook login",), ("how to cook pasta",), ("history of computers",), ("buy iPhone from Apple in New York",), (None,)], "q string")
    r = {x.q: x for x in df.select("q", Q.query_type("q").alias("t"), Q.intent("q").alias("i"), F.size(Q.entities("q")).alias("e")).collect()}
    assert r["apple AND fruit"].t == "boolean" and r['"machine learning" now'].t == "phrase" and r["apple~2"].t == "fuzzy" and r[None].t == "natural"
    assert r["facebook login"].i == "navigational" and r["how to cook pasta"].i == "transactional" and r["history of computers"].i == "informational"
    assert r["buy iPhone from Apple in New York"].e == 3
    assert Q.parse_boolean("a OR Bee NOT sea") == [("AND", "a"), ("OR", "bee"), ("NOT", "sea")] and Q.parse_fuzzy("apple~9 b") == [("apple", 5)]
    assert Q.parse_phrase('x "b c" y') == (["b", "c"], ["x", "y"])


def test_spelling(spark):
    d = spark.createDataFrame([("search", 100), ("engine", 100), ("receive", 100), ("apple", 100)], "word string, freq long")
    w = spark.createDataFrame([("recieve",), ("acheive",), ("seach",), ("apple",), (None,), ("",)], "w string")
    best = {r.w: r.best for r in Q.best_corrections(Q.spelling_candidates(w, d)).collect()}
    assert best["recieve"] == "receive" and best["acheive"] == "achieve" and best["seach"] == "search" and "apple" not in best
    s = spark.createDataFrame([("tutor",), ("",), (None,)], "w string").select("w", Q.soundex("w").alias("s")).collect()
    assert {r.w: r.s for r in s} == {"tutor": "T600", "": "", None: None}


def test_completion(spark):
    d = spark.createDataFrame([("apple", 100), ("application", 80), ("appetite", 30), ("banana", 50), ("appreciate", 20)], "word string, freq long")
    assert [r.word for r in Q.completions(d, "APP", 5).collect()] == ["apple", "application", "appetite", "appreciate"]
    assert [r.suggestion for r in Q.suggestions(d, "red ban", 5).collect()] == ["red banana"]


def test_snippets():
    text = "Learning machines are useful for many people. Apples grow on trees in the old garden. A machine that is learning can help."
    out = S.snippet(text, S.query_terms("machine learning"))
    assert "<mark>" in out.lower() and "machine" in out.lower()
    assert S.snippet("", ["a"]) == "" == S.snippet(None, ["a"]) and S.snippet("short", ["x"]) == "short"
    assert len(S.snippet("word " * 200 + "end.", ["word"]).replace("<mark>", "").replace("</mark>", "")) <= 303


def test_fingerprints(spark):
    a = "the quick brown fox jumps over the lazy dog and runs through the big green field"
    df = docs(spark, a, a, a.replace("lazy", "sleepy"), "something else entirely with other words in it", "two words", None)
    fp = D.fingerprints(df)
    rows = {r.doc_id: r.fp for r in fp.collect()}
    assert rows[1] == rows[2] and set(rows) == {1, 2, 3, 4}
    far = lambda x, y: bin((rows[x] ^ rows[y]) & (1 << 64) - 1).count("1")
    assert far(1, 4) > 5
    for most in (3, 15, 30):
        want = {(x, y) for x in (1, 3, 4) for y in (1, 3, 4) if x < y and far(x, y) <= most}
        assert {(r.a, r.b) for r in D.near_duplicates(fp, most).collect()} == want
    assert {r.doc_id: r["class"] for r in D.exact_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_near_duplicates_without_join(spark, monkeypatch):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)] + [i << 12 for i in range(90)]
    for f in fps[:60]:
        fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 12))) for _ in range(4)]
    fps = [*(f - (f >> 63 << 64) for f in fps + fps[:5]), -1, 0]
    df = spark.createDataFrame([(1000 - i, f) for i, f in enumerate(fps)] + [(None, 77), (5000, None)], "doc_id long, fp long")
    assert D.near_duplicates(df.limit(0), 9).count() == 0
    least = {f: 1000 - i for i, f in enumerate(fps)}
    far = {(least[f], least[g]): bin((f ^ g) & (1 << 64) - 1).count("1") for f in least for g in least if least[f] < least[g]}
    for most, cell in ((9, 1 << 17), (9, 8), (3, 8), (0, 8), (20, 1 << 17)):
        monkeypatch.setattr(D, "CELL", cell, raising=False)
        pairs = D.near_duplicates(df, most)
        got = [((r.a, r.b), r.distance) for r in pairs.collect()]
        assert sorted(got) == sorted(x for x in far.items() if x[1] <= most)
        if cell > 8:  # the keys of all fingerprints were broadcast, as if they were as few as these
            assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_cell(monkeypatch):
    rng = np.random.default_rng(4)
    fp = np.unique(np.concatenate([x := rng.integers(0, 1 << 64, 30, dtype=np.uint64), *(x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 30)).astype(np.uint64)) for n in range(1, 14))]))
    far = np.bitwise_count(fp[:, None] ^ fp)
    for side, most, block in ((s, m, b) for s in (fp & 0, fp & 1) for m in (0, 3, 9, 40) for b in (1 << 20, 5) if m < 40 or b > 5):
        monkeypatch.setattr(D, "PAIRS", block)
        got = [(min(p), max(p), d) for s in range(most + 1) for x, y, d in D.near_pairs(fp, side.astype(np.int64), s, most) for *p, d in zip(x.tolist(), y.tolist(), d.tolist())]
        want = [(i, j, int(far[i, j])) for i in range(len(fp)) for j in range(i + 1, len(fp)) if far[i, j] <= most and (not side.any() or side[i] != side[j])]
        assert sorted(got) == want


def test_bloom(spark):
    v = spark.createDataFrame([(f"u{i}",) for i in range(500)] + [(None,)], "u string")
    m, k = D.bloom_shape(1000)
    assert (m, k) == (9586, 7)
    words = D.bloom_words(v, "u", m, k)
    ask = spark.createDataFrame([(f"u{i}",) for i in range(1000)] + [(None,)], "u string")
    known = {r.u for r in D.maybe_known(ask, "u", words, m, k).collect()}
    assert {f"u{i}" for i in range(500)} <= known and len(known) < 520 and None not in known


def test_vector_search_recall(spark):
    rows = [(i, [math.sin(i * 0.37 * (j + 1)) + (i % 7) * (j == i % 5) for j in range(8)]) for i in range(300)] + [(999, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 30 = 0")
    exact = {(r.query, r.vec_id) for r in V.top_similar(v, q, 5, block=3).collect()}
    assert len(exact) == 50
    near = {(r.query, r.vec_id) for r in V.ivf_search(v, q, 5, lists=8, share=5 / 8).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    assert V.top_similar(v.limit(0), q.limit(0), 5).count() == 0


def test_quality(spark):
    df = spark.createDataFrame([(1, "A plain sentence about apples.", "example.com", ["https://example.com/a"], {"content-length": "30"}), (2, "BUY NOW 123 " * 9, "spam-site.xyz", ["http://a.xyz"] * 5, {}), (3, None, None, None, None)], "id long, content string, domain string, outgoing_links array<string>, headers map<string,string>")
    f = {r.id: r for r in QL.quality_features(df).collect()}
    assert f[2].link_farm == 2 and f[2].credibility == 0.1 and f[2].repeated > 0.8 and f[3].words == 0 and f[1].external_links == 0
    flags = QL.flagged(QL.quality_features(df).withColumn("readability", F.lit(0.5))).collect()
    assert "link farm patterns" in {r.id: r.flags for r in flags}[2]


def test_drift(spark):
    rows = [(1, "apple fruit sweet juice apple fruit garden", datetime(2020, 1, 1)), (2, "apple computer laptop software apple computer screen", datetime(2024, 1, 1)), (3, None, None)]
    t = DR.drift_tokens(spark.createDataFrame(rows, "k long, text string, at timestamp"), "k", "text", "at")
    d = {r.w: r for r in DR.term_drift(DR.ppmi(t, "k")).collect()}
    assert d["apple"].drifted and d["apple"].windows == 2 and d["fruit"].magnitude == 0
    score = {r.k: r.drift for r in DR.document_drift(t, DR.term_drift(DR.ppmi(t, "k")), "k").collect()}
    assert score[1] > 0.35 and set(score) == {1, 2}


def test_crawl(spark):
    h = "<html><TITLE a> T &amp; </title><script>x</script><p>Hi&nbsp;you</p><a class=b href='/a?x'>a</a><a href=\"c\">c</a><a href='https://o.org/'>o</a></html>"
    r = spark.createDataFrame([(h, "https://x.org/d/e")], "h string, u string").select(C.html_title("h").alias("t"), C.html_text("h").alias("x"), C.html_links("h", F.col("u")).alias("l")).first()
    assert r.t == "T &amp;" and r.l == ["https://x.org/a?x", "https://x.org/d/c", "https://o.org/"] and "Hi you" in r.x and "x</" not in r.x
    slots = C.politeness_slots(spark.createDataFrame([(i, "a", float(i % 3)) for i in range(9)] + [(20, None, None)], "entry_id long, domain string, priority double")).collect()
    assert [r.entry_id for r in sorted(slots, key=lambda r: (r.domain, r.slot))] == [20, 0, 3, 6, 1, 4, 7, 2, 5, 8]
    ranks = {r.node: r["rank"] for r in C.page_rank(spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "a"), ("a", "a")], "src string, dst string"), 6).collect()}
    assert min(ranks["a"], ranks["c"]) > ranks["b"] == pytest.approx(0.15)


def test_ring(spark):
    keys = spark.range(1000).selectExpr("cast(id as string) AS k")
    p = C.ring(spark, ["a", "b", "c"], 50)
    one = {r.k: r.node for r in C.ring_lookup(keys, "k", p).collect()}
    less = {r.k: r.node for r in C.ring_lookup(keys, "k", p.where("node <> 'c'")).collect()}
    loads = [list(one.values()).count(n) for n in "abc"]
    assert min(loads) > 150 and all(one[k] == less[k] for k in one if one[k] != "c")


def test_preferences(spark):
    p = L.gradients(spark.createDataFrame([(2.0, 1.0)], "score_winner double, score_loser double")).first()
    assert abs(p["lambda"] - 1 / (1 + math.e)) < 1e-9


def test_join_stats_keeps_all_rows(spark):
    big = spark.createDataFrame([("hot", i) for i in range(2000)] + [(f"k{i % 400}", i) for i in range(2000)] + [(None, 1)], "k string, i long")
    stats = big.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    got = join_stats(big, stats, ["k"], "n", "i")
    assert got.count() == 4000 and got.where("k = 'hot' AND n <> 2000").count() == 0
    assert join_stats(big, stats, ["k"], "n", "i", "n < 100").count() == 2000


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1, 0, k % 60, s), "remove" if (k + s) % 5 == 0 else "add", s) for s in range(6) for k in range(20)]
    schema = "k int, at timestamp, op string, v int"
    for n in range(3):
        spark.createDataFrame(rows[n::3], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    table = CH.VersionedTable(spark, str(tmp_path / "table"), "k", "at", "op")
    assert table.version() == -1 and table.read() is None
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    CH.upsert_stream(src, table, str(tmp_path / "ck"), None).awaitTermination()
    want = I.latest_changes(spark.createDataFrame(rows, schema), "k", "at").where("op <> 'remove'")
    assert table.version() >= 1 and sorted((r.k, r.v) for r in table.live().collect()) == sorted((r.k, r.v) for r in want.collect())


def test_rate_limit(spark):
    hits = spark.createDataFrame([("a", t) for t in (0, 10, 20, 990, 1001, 1002, 5000)] + [("b", 5), (None, 1)], "ip string, ms long")
    got = CH.rate_limited(hits, "ip", "ms", 2, 1000).collect()
    assert sorted(r["at"] for r in got if r.refused) == [20, 990] and len(got) == 8


def test_tumbling(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 1, 5), "a", 1.0), (datetime(2024, 1, 1, 7), "a", 2.0), (datetime(2024, 1, 2), "a", 4.0), (None, "a", 8.0)], "ts timestamp, kind string, value double")
    assert sorted((r.start.day, r.n, r.total) for r in CH.tumbling_counts(e, "ts", "kind").collect()) == [(1, 2, 3.0), (2, 1, 4.0)]


def test_engine(spark, tmp_path):
    from sparrowdex.engine import SearchEngine

    rows = [(1, "Apple pie", "Apples are baked in a pie that everybody likes to eat. The oven is hot.", "a.org", datetime(2024, 1, 1), 3.0), (2, "Plum cake", "A cake with plums is on the table for all of us. Nobody knows the apple.", "b.com", datetime(2024, 1, 1), 1.0), (3, None, None, None, None, None)]
    e = SearchEngine(spark.createDataFrame(rows, "doc_id long, title string, content string, domain string, at timestamp, page_rank double"), str(tmp_path), "2024-02-01 00:00:00")
    e.rebuild()
    ids = lambda q: [r.doc_id for r in e.search(q).collect()]
    assert ids("apple pie") == [1, 2] and ids("apple AND plum") == [2] and ids('"plum cake"') == [2] and ids("aple~1") == [2, 1] or ids("apple NOT plum") == [1]
    assert [r.word for r in e.autocomplete("pl").collect()] == ["plum", "plums"] and e.stats().first().documents == 2
    with pytest.raises(ValueError):
        e.search("", 1)
