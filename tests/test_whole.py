"""Registered queries that do the whole job, against brute force on small tables."""

from datetime import datetime

import pytest

from sparrowdex.operators import queries as Q

import __spark_entry__ as entry

DOCUMENTS = "doc_id long, text string, fetched_at timestamp"


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_spelling_of_all_words(spark, tmp_path):
    known = ["search", "engine", "information", "cat", "retrieval"]
    odd = ["serch"] * 3 + ["cta", "informatoin", "retreival", "retreival", "enginee", "x", "qqqqqqqq", "retrieval" * 40]
    d = folder(spark, tmp_path, documents=spark.createDataFrame([(i, " ".join(known), None) for i in range(5)] + [(9, " ".join(odd), None)], DOCUMENTS))
    got = entry.queries()["spell_candidates"](spark, d).collect()
    words = spark.createDataFrame([(w,) for w in {*known, *odd}], "w string").select("w", Q.soundex("w").alias("s")).collect()
    code = {r.w: r.s for r in words}
    want = {}
    for w in {*odd}:
        far = {k: distance(w, k) for k in known}
        for k in known:
            if far[k] <= 2 and far[k] == min(far.values()):
                want[w, k] = (far[k], False)
            elif code[k] == code[w]:
                want[w, k] = (far[k], True)
    assert {(r.w, r.candidate): (r.distance, r.phonetic) for r in got} == want
    best = {r.w: r.best for r in entry.queries()["spell_best"](spark, d).collect()}
    assert best["serch"] == "search" and best["cta"] == "cat" and best["informatoin"] == "information" and best["retreival"] == "retrieval"


def test_drift_by_30_days(spark, tmp_path):
    texts = ["apple fruit sweet juice apple fruit garden", "apple computer laptop software apple computer screen", "apple phone", None]
    times = [datetime(2023, 12, 25), datetime(2024, 2, 12), datetime(2024, 2, 12), datetime(2024, 2, 12)]
    d = folder(spark, tmp_path, documents=spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(zip(texts, times))], DOCUMENTS))
    q = {k: f(spark, d) for k, f in entry.queries().items() if k in ("drift_windows", "cooccurrence", "term_drift", "doc_drift", "drift_summary")}
    want = {}
    for x, t in zip(texts[:3], times):
        win, ws = int((t - datetime(1970, 1, 1)).total_seconds() // (30 * 86400)), x.split()
        for i, w in enumerate(ws):
            for j, c in enumerate(ws):
                if 1 <= abs(i - j) <= 5 and w != c:
                    want[win, w, c] = want.get((win, w, c), 0) + 1
    assert {(r.win, r.w, r.ctx): r.n for r in q["cooccurrence"].collect()} == want and min(want.values()) == 1
    assert q["drift_windows"].count() == len({k[0] for k in want}) == 2
    terms = {r.w: r for r in q["term_drift"].collect()}
    assert terms["apple"].windows == 2 and terms["apple"].drifted and not terms["fruit"].drifted
    assert {r.doc_id for r in q["doc_drift"].collect() if r.drift > 0.35} == {0, 1, 2}
    s = q["drift_summary"].first()
    assert (s.terms, s.drifted) == (len(terms), 1)


def test_all_query_vectors(spark, tmp_path):
    vectors = [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (100, [0.0, 2.0]), (101, None), (200, None), (300, [0.0, 0.0])]
    docs = [(1, "slow search", None), (2, "an index of apples", None), (7, "slow index", None), (8, None, None), (9, "", None), (10, "漢字", None)]
    d = folder(spark, tmp_path, embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), documents=spark.createDataFrame(docs, DOCUMENTS))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {}
    for q, a in vectors:
        for v, b in vectors:
            if q % 100 == 0:
                n = (dot(a, a) * dot(b, b)) ** 0.5 if a and b else 0
                want[q, v] = round(dot(a, b) / n, 6) if n else 0
    rows = entry.queries()["cosine_pairs"](spark, d).collect()
    assert len(rows) == len(want) and {(r.query, r.vec_id): r.cosine for r in rows} == pytest.approx(want)
    got = {(r.query, r.doc_id): r.hybrid for r in entry.queries()["hybrid_blend"](spark, d).collect()}
    assert {k[0] for k in got} == {0, 100, 200, 300}
    assert got[100, 100] == pytest.approx(0.3) and (100, 7) in got and (200, 7) in got
    from sparrowdex.operators.vectors import similarities

    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    blocks = similarities(v, v.where("vec_id % 100 = 0"), block=1).collect()
    assert {(r.query, r.vec_id): round(r.score, 6) for r in blocks} == pytest.approx(want)
    encoded = {r.doc_id: r.vector for r in entry.queries()["text_encode"](spark, d).collect()}
    assert set(encoded) == {1, 2, 7, 8, 9, 10} and set(encoded[8]) == set(encoded[9]) == {0.0} and any(encoded[1])


def test_classes_of_near_duplicates(spark, tmp_path):
    a = "the quick brown fox jumps over the lazy dog and runs through the big green field"
    far = "something else entirely with other words in it"
    docs = [(4, a, None), (5, a.upper() + "!", None), (6, a, None), (7, far, None), (8, "two words", None), (9, None, None)]
    d = folder(spark, tmp_path, documents=spark.createDataFrame(docs, DOCUMENTS))
    got = {r.doc_id: (r["class"], r.links) for r in entry.queries()["near_dup_classes"](spark, d).collect()}
    assert got == {4: (4, 0), 5: (4, 0), 6: (4, 0), 7: (7, 0), 8: (8, 0), 9: (9, 0)}
    from sparrowdex.operators.dedup import fingerprint_classes

    fps = {1: 0, 2: 0, 3: 1, 4: -1, 5: 7, 6: 15}
    df = spark.createDataFrame(list(fps.items()), "doc_id long, fp long")
    first = {f: min(i for i in fps if fps[i] == f) for f in fps.values()}
    want = {i: (first[f], sum(0 < bin((f ^ g) & (1 << 64) - 1).count("1") <= 3 for g in first)) for i, f in fps.items()}
    rows = fingerprint_classes(df, df).collect()
    assert len(rows) == 6 and {r.doc_id: (r["class"], r.links) for r in rows} == want


def test_rank_of_ten_rounds(spark, tmp_path):
    schema = "id long, url string, title string, content string, domain string, crawled_at timestamp, is_removed boolean, page_rank double, outgoing_links array<string>"
    links = {"a": ["b"], "b": ["c"], "c": ["d", "d"], "d": ["e"], "e": ["f", "e"], "f": ["a", "g"]}
    d = folder(spark, tmp_path, docs=spark.createDataFrame([(i, u, None, None, None, datetime(2025, 1, 1), False, None, x) for i, (u, x) in enumerate(links.items())], schema))
    edges = {(u, v) for u, x in links.items() for v in x if u != v}
    ranks = {u: 1.0 for e in edges for u in e}
    for _ in range(10):
        ranks = {n: 0.15 + 0.85 * sum(ranks[u] / sum(x == u for x, _ in edges) for u, v in edges if v == n) for n in ranks}
    got = {r.node: r["rank"] for r in entry.queries()["pagerank"](spark, d).collect()}
    assert got == pytest.approx(ranks, abs=1e-8)
