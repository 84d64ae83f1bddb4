"""Cuckoo tables and seen keys against exact sets."""

import random

import numpy as np

from sparrowdex.llm import seen as S


def test_table_has_no_false_negatives_and_grows():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 60000).astype(np.uint64) * np.uint64(2)
    t = S.CuckooTable(64)
    for part in np.array_split(h, 13):
        t.add(part[~t.contains(part)])
        assert t.contains(part).all()
    assert len(t.segments) > 1
    other = rng.integers(0, 2**63, 60000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert t.contains(other).mean() < 0.001


def test_removal():
    h = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    t = S.CuckooTable(128)
    t.add(h)
    assert t.remove(h[:1000]).all()
    assert t.contains(h[1000:]).all()
    assert not t.contains(h[:1000]).any()
    t.add(h[:1000])
    assert t.contains(h).all()


def test_keys(spark):
    cases = {
        " HTTP://Ex.COM:80/a//?q=1#x ": "http://ex.com/a?q=1", "https://ex.com:443/": "https://ex.com", "https://ex.com:80/A/": "https://ex.com:80/A",
        "http://ex.com#top": "http://ex.com", "http://www.ex.com/a?b=/c/": "http://www.ex.com/a?b=/c/", "http://U@Ex.com/x": "http://U@ex.com/x", "plain Text#f": "plain Text", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.key for r in S.with_url_key(df).collect()} == cases


def test_seen_matches_exact(spark):
    rng = random.Random(3)
    known = [f"k{rng.randrange(300)}" for _ in range(200)] + [None]
    rows = [(i + 1, "hot" if rng.random() < 0.4 else f"k{rng.randrange(3000)}") for i in range(6000)] + [(6001, None)]
    rng.shuffle(rows)
    k = spark.createDataFrame([(x,) for x in known], "key string")
    a = spark.createDataFrame(rows, "entry_id long, key string").repartition(5)
    before, want = set(known), set()
    for i, key in sorted(rows):
        if key is not None:
            if key in before:
                want.add(i)
            before.add(key)
    answers = S.seen_before(k, a).cache()
    checked = S.checked(answers, k)
    assert {r.entry_id for r in answers.where("seen").collect()} == want
    assert {r.entry_id for r in checked.where("true_seen").collect()} == want
    assert checked.count() == 6000
    audit = S.audited(checked).first()
    assert audit.wrong_share < 0.001 and audit.answers == 6000


def test_empty(spark):
    k, a = spark.createDataFrame([], "key string"), spark.createDataFrame([], "entry_id long, key string")
    assert S.checked(S.seen_before(k, a), k).count() == 0


def test_saved_tables_grow_and_forget(spark):
    rows = lambda a, b: spark.createDataFrame([(i, f"k{i}") for i in range(a, b)], "entry_id long, key string")
    tables, answers = S.SeenTables(spark, 3).extended(rows(1, 9001))
    assert answers.where("seen").count() == 0 and tables.size() == 9000
    more, answers = tables.extended(rows(8001, 20001))
    assert {r.entry_id for r in answers.where("seen").collect()} == set(range(8001, 9001)) and more.size() == 20000
    assert more.rows().groupBy("part").count().agg({"count": "max"}).first()[0] > 1  # saturated: more than one segment
    less, _ = more.extended(None, forget=rows(1, 5001))
    last, answers = less.extended(rows(4001, 6001), forget=rows(5999, 6000))
    assert less.size() == 15000 and {r.entry_id for r in answers.where("seen").collect()} == set(range(5001, 6001)) - {5999}
    assert last.size() == 16000 and tables.size() == 9000  # older versions stay as they were


def test_a_full_bucket_pair_is_widened():
    t = S.CuckooTable(2, load=1.0, kicks=2)
    h = (np.arange(1, 41, dtype=np.uint64) << np.uint64(32)) + np.uint64(7)
    t.add(h)
    again = S.CuckooTable()
    for row in t.save():
        again.restore(*row)
    assert t.contains(h).all() and again.contains(h).all() and again.count == t.count and max(s.shape[1] for s in again.segments) > S.SLOTS
