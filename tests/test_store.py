"""The persisted index, the live index and the engine on it, crawls, rings, corrections."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparrowdex.engine import SearchEngine
from sparrowdex.functions import text as T
from sparrowdex.operators import crawl as C
from sparrowdex.operators import dedup as D
from sparrowdex.operators import index as I
from sparrowdex.operators import learn as L
from sparrowdex.operators import queries as Q
from sparrowdex.operators import rank as R
from sparrowdex.operators import snippets as S
from sparrowdex.operators import store as ST
from sparrowdex.session import scratch, through_table
from sparrowdex.streaming import changes as CH

TEXTS = {1: "apple pie apple", 2: "apple tart and cake", 3: "plum cake", 4: None, 5: "", 6: "cake " * 300 + "pie"}


def texts(spark, some):
    return spark.createDataFrame(list(some.items()), "doc_id long, text string")


def test_index_is_the_corpus(spark, tmp_path):
    docs = texts(spark, TEXTS)
    x = ST.TextIndex.build(docs, str(tmp_path / "i"))
    t = T.terms(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(x.postings().select("term", "doc_id", "tf", "positions")) == rows(I.postings(t))
    assert rows(x.dictionary()) == rows(I.document_frequency(t)) and x.totals()[0] == 4
    for stems in (["appl"], ["appl", "cak", "cak"], ["none"], []):
        got = {r.doc_id: (r.bm25, r.tf_idf, r.length) for r in x.ranked(stems).collect()}
        want = {r.doc_id: (r.bm25, r.tf_idf, r.length) for r in R.bm25(t, stems).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    assert rows(x.phrase(["plum", "cak"])) == rows(I.phrase_query(t, ["plum", "cak"])) == [(3, 1)] and x.phrase([]).count() == 0
    assert rows(x.fuzzy("cakes", 2)) == rows(I.fuzzy_query(I.postings(t), "cakes", 2))
    assert x.has_term("appl") and not x.has_term("apple") and x.document_frequency("cak") == 3 and x.average_length() > 1
    assert rows(I.seek(x.of_terms(["cak"]), "cak", 3)) == [(3, 1)] and I.seek(x.of_terms(["cak"]), "cak", 7).count() == 0
    plan = x.of_terms(["appl"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,appl)]" in plan


def test_index_of_nothing(spark, tmp_path):
    x = ST.TextIndex.build(texts(spark, {4: None}), str(tmp_path / "e"))
    assert x.postings().count() == 0 and x.ranked(["appl"]).count() == 0 and x.stats().first().documents == 0 and x.totals() == (0, 0)


def test_live_index_is_the_last_state(spark, tmp_path):
    live = ST.LiveIndex(spark, str(tmp_path / "l"), most=6)
    assert live.postings().count() == 0
    assert not live.change(texts(spark, {1: "apple pie", 2: "plum cake", 3: "cake"}))
    assert not live.change(texts(spark, {2: "cherry"}), spark.createDataFrame([(3,)], "doc_id long"))
    state = {(r.term, r.doc_id) for r in live.postings().collect()}
    assert state == {("appl", 1), ("pie", 1), ("cherri", 2)}
    assert live.change(texts(spark, {9: "pie"}))  # the sixth change merges
    x = live.index()
    assert {(r.term, r.doc_id) for r in x.postings().collect()} == state | {("pie", 9)} and x.totals() == (3, 4)
    assert x.document_frequency("cak") == 0
    live.clear()
    assert live.postings().count() == 0


def corpus(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (1, "Search engine", "A search engine finds pages. The index of the search engine is built once and read by all.", "a.org", at, 3.0, None, False),
        (2, "Plum cake", "A cake with plums is on the table. Nobody knows who baked the cake for the search party.", "b.com", at, 1.0, None, False),
        (3, "Index of pages", "The index holds the terms of pages, so that a search is quick and nobody has to wait.", "c.edu", at, 2.0, None, False),
        (4, "Search spam", "SEARCH 111 222 333 444 555 666 777 888 " * 9, "spam.xyz", at, 9.0, [f"http://o{i}.loan/x" for i in range(30)], False),
        (5, "Search engine", "A removed page on the search engine and its index.", "d.org", at, 5.0, None, True),
        (6, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "id long, title string, content string, domain string, at timestamp, page_rank double, links array<string>, removed boolean")


def test_pipeline(spark, tmp_path):
    e = SearchEngine(corpus(spark), str(tmp_path / "s"), "2024-02-01 00:00:00", "id")
    e.rebuild()
    rows = e.search("serch engine").collect()
    assert rows[0].doc_id == 1 and [r.rank for r in rows] == list(range(1, len(rows) + 1)) and not {r.doc_id for r in rows} & {4, 5, 6}
    assert "<mark>" in rows[0].snippet.lower() and "search" in rows[0].matched
    r = e.respond("serch engine")
    assert r["corrected"] == "search engine" and r["total"] == len(rows) and r["intent"] == "informational" and e.respond("serch engine") is r and e.counters()["hit_rate"] == 0.5
    assert e.corrected("plum NOT cake") == "plum NOT cake" and [x.doc_id for x in e.search('"plum cake"').collect()] == [2]
    assert e.autocomplete("s").count() == 0 and e.autocomplete("se").count() > 0 and e.get(3).count() == 1 and e.get(5).count() == 0
    with pytest.raises(ValueError):
        e.search("x", size=51)
    e.update(spark.createDataFrame([(7, "Fast search engine", "A fast search engine.", "e.org")], "doc_id long, title string, content string, domain string"), spark.createDataFrame([(1,)], "doc_id long"))
    e.compact()
    assert {x.doc_id for x in e.search("search engine").collect()} == {2, 3, 7}
    assert e.drift_report().count() == 0 and e.stats().first().documents == 4
    later = SearchEngine(corpus(spark), str(tmp_path / "s"), "2024-02-01 00:00:00", "id")
    assert {x.doc_id for x in later.search("search engine").collect()} == {2, 3, 7}  # a later session reads what is there
    e.clear()


def test_crawl(spark):
    web = {"http://a.org/": (["http://a.org/1", "http://b.org/", "ftp://x/"], "<title>A</title>text"), "http://a.org/1": (["http://a.org/2", "http://a.org/"], "<p>one"), "http://a.org/2": (["http://a.org/3"], "two"), "http://b.org/": (None, "b"), "http://a.org/3": ([], "three")}
    pages = spark.createDataFrame([(u, b, x) for u, (x, b) in web.items()] + [("http://c.org/", None, None)], "url string, body string, links array<string>")
    seeds = spark.createDataFrame([("http://a.org/",), ("http://gone.org/",), (None,)], "url string")
    got, n = C.crawl(pages, seeds, max_depth=2, batch=2)
    rows = {r.url: r for r in got.collect()}
    assert set(rows) == {"http://a.org/", "http://a.org/1", "http://b.org/", "http://a.org/2"} and {r.crawl_depth for r in rows.values()} == {0, 1, 2}
    assert rows["http://a.org/"].title == "A" and rows["http://b.org/"].title == "http://b.org/" and rows["http://b.org/"].domain == "b.org"
    assert n["documents"] == 4 and n["waiting"] == 0 and n["missing"] == 1
    few, n = C.crawl(pages, seeds, max_pages=2, batch=5)
    assert few.count() == n["documents"] <= 2
    rules = spark.createDataFrame([("a.org", "/2", False)], "domain string, prefix string, allow boolean")
    assert "http://a.org/2" not in {r.url for r in C.crawl(pages, seeds, rules=rules)[0].collect()}
    assert C.crawl(pages.limit(0), seeds.limit(0))[0].count() == 0


def test_ring(spark):
    places = C.ring(spark, ["a", "b", "c"], 20)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)] + [(None,)], "k string")
    got = {r.k: r.nodes for r in C.ring_replicas(keys, "k", places, 2).collect()}
    one = {r.k: r.node for r in C.ring_lookup(keys, "k", places).collect()}
    assert got[None] is None and one[None] is None and all(len(set(v)) == 2 and v[0] == one[k] for k, v in got.items() if k)
    rest = {r.k: r.node for r in C.ring_lookup(keys, "k", C.ring_without(places, "c")).collect()}
    assert all(rest[k] == v for k, v in one.items() if v in ("a", "b")) and set(rest.values()) == {"a", "b", None}
    assert all(len(r.nodes) == 3 for r in C.ring_replicas(keys.where("k IS NOT NULL"), "k", places, 9).collect())


def test_politeness_of_a_hot_domain(spark):
    rows = [(i, "hot" if i % 3 else None, [1.0, None, 0.5, float(i)][i % 4]) for i in range(3000)]
    got = {r.entry_id: (r.domain, r.slot) for r in C.politeness_slots(spark.createDataFrame(rows, "entry_id long, domain string, priority double")).collect()}
    for name in ("hot", ""):
        queue = sorted((1e308 if p is None else p, i) for i, d, p in rows if (d or "") == name)
        assert [got[i] for _, i in queue] == [(name, k) for k in range(len(queue))]


def test_correction_in_context(spark):
    words = spark.createDataFrame([("machine", 9), ("learning", 9), ("leaning", 9), ("the", 90), ("engine", 9), ("search", 9)], "word string, freq long")
    df = spark.createDataFrame([(1, "The machine, lerning!"), (2, "(serch) engine x9q it"), (3, None), (4, "")], "doc_id int, text string")
    got = {r.doc_id: r.corrected for r in Q.correct_texts(df, words).collect()}
    assert got == {1: "The machine, learning!", 2: "(search) engine x9q it", 3: None, 4: ""}
    r = spark.createDataFrame([("learning", ["machine", "x"]), ("machine", ["learning"]), ("cake", None)], "w string, c array<string>").select(Q.context_bonus(F.col("w"), F.col("c")).alias("b")).collect()
    assert [x.b for x in r] == [5.0, 5.0, 0.0]


def test_candidates_are_the_first(spark):
    words = spark.createDataFrame([(f"b{a}{c}", 100 - i) for i, (a, c) in enumerate((a, c) for a in "aeiou" for c in "aeiouhwy")], "word string, freq long")
    got = Q.spelling_candidates(spark.createDataFrame([("buaeioaa",), ("baaa",)], "w string"), words).collect()
    for w in ("buaeioaa", "baaa"):
        assert sum(r.w == w for r in got) == 20
    assert {r.freq for r in got if r.w == "buaeioaa"} == set(range(81, 101))


def test_late_rows(spark):
    rows = [(i, (i * 7919) % 100_003) for i in range(20000)] + [(20000, None)]
    got = {r.k for r in CH.late_rows(spark.createDataFrame(rows, "k long, t long"), "k", "t", 50_000).collect()}
    top, want = -1, set()
    for k, t in rows:
        if t is not None:
            if t < top - 50_000:
                want.add(k)
            top = max(top, t)
    assert got == want and want


def test_fingerprint_copies(spark):
    a = "the quick brown fox jumps over the lazy dog and runs through the big green field"
    known = D.fingerprints(spark.createDataFrame([(1, a)], "doc_id long, text string")).select("fp")
    new = spark.createDataFrame([(5, a.upper()), (6, "something else entirely with other words in it"), (7, None)], "doc_id long, text string")
    assert [r.doc_id for r in D.near_copies(new, known).collect()] == [5]
    v = spark.createDataFrame([(f"u{i}",) for i in range(50)], "u string")
    m, k = D.bloom_shape(100)
    whole = D.bloom_words(v, "u", m, k)
    halves = [D.bloom_from_json(D.bloom_json(D.bloom_words(v.where(x), "u", m, k), m, k)) for x in ("u < 'u3'", "u >= 'u3'")]
    assert sorted(D.bloom_union(*halves).collect()) == sorted(whole.collect())
    h = {r.u: r.h for r in spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "u string").select("u", D.fnv1a("u").alias("h")).collect()}
    assert h == {"": 0x811C9DC5, "a": 0xE40C292C, "foobar": 0xBF9CF968, None: None}


def test_dated_snippets_and_models(spark):
    df = spark.createDataFrame([(1, "short text", datetime(2025, 1, 5)), (2, "short text", None), (3, None, datetime(2025, 1, 5))], "k int, text string, at timestamp")
    assert {r.k: r.snippet for r in S.with_dated_snippet(df, "zzz").collect()} == {1: "Jan 5, 2025 — short text", 2: "short text", 3: "Jan 5, 2025 — "}
    f = spark.createDataFrame([(i, float(i % 5), float(i % 3), float(i % 5) * 2) for i in range(60)], "id int, a double, b double, y double")
    assert max(abs(r.prediction - r.y) for r in L.fit_ranker(f, "y", ["a", "b"]).transform(f).collect()) < 0.5
    pairs = spark.createDataFrame([(1.0, 0.0), (1.0, 0.5)], "w_clicks double, l_clicks double")
    w = L.updated_weights(pairs, ["clicks"], {"clicks": 0.0}, 1.0)["clicks"]
    assert w == pytest.approx(0.375) and L.feature_importance(spark).first().feature == "bm25"


def test_scratch_tables_go(spark):
    with scratch(spark):
        t = through_table(spark.range(3), "gone")
        path = t.inputFiles()[0]
        assert t.count() == 3
    assert not ST.exists(spark, path)


def test_inverted_file_finds_most(spark):
    import os

    import __spark_entry__ as entry

    place = "/root/testdata/sf0.1"
    if not os.path.isdir(place):
        pytest.skip("no test tables")
    pairs = lambda name: {(r.query, r.vec_id) for r in entry.queries()[name](spark, place).collect()}
    near, exact = pairs("ivf_topk"), pairs("cosine_topk")
    assert len(near & exact) >= 0.9 * len(exact)
