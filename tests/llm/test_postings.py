"""Term frequencies and log-entropy against brute force."""

import math
from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from sparrowdex.llm import postings as P

SCHEMA = "term string, doc_id long, tf int, indexed_at timestamp, records string"
T = [datetime(2025, 1, d) for d in range(1, 5)]
ROWS = [
    (" Fox ", 1, 3, T[0], "x"), ("fox", 1, 5, T[1], "x"), ("FOX", 1, 5, T[1], "x"), ("fox", 2, 1, T[0], None), ("fox", 130, 2, None, "x"),
    ("den", 1, 6, T[0], "x"), ("den", 2, 0, T[2], "x"), ("den", 2, 4, T[0], "x"), ("hen", 3, None, T[3], "x"), (None, 3, 2, T[0], "x"), ("pen", None, 2, T[0], "x"), ("pen", 64, 2, T[0], "x"),
]


def resolved(spark, rows=ROWS):
    return P.resolved_postings(spark.createDataFrame(rows, SCHEMA))


def test_resolved(spark):
    got = {(r.term, r.doc_id): r.tf for r in resolved(spark).collect()}
    assert got == {("fox", 1): 5, ("fox", 2): 1, ("fox", 130): 2, ("den", 1): 6, ("pen", 64): 2}


def test_frequencies(spark):
    r = P.term_frequencies(P.vertical_index(resolved(spark)), rare=2, common=0.5)
    assert {x.term: (x.occurrences, x.records, x.mark) for x in r.collect()} == {"fox": (8, 3, "common"), "den": (6, 1, "rare"), "pen": (2, 1, "rare")}


def test_union_of_segments_is_index_of_all(spark):
    all_rows = resolved(spark).cache()
    a, b = all_rows.where("doc_id < 64"), all_rows.where("doc_id >= 64")
    one = P.vertical_index(all_rows).orderBy("term", "word").collect()
    assert P.union_indexes(P.vertical_index(a), P.vertical_index(b)).orderBy("term", "word").collect() == one


def test_log_entropy(spark):
    got = {(r.term, r.doc_id): r.weight for r in P.log_entropy(resolved(spark)).collect()}
    tf = defaultdict(dict)
    for (t, d), n in {("fox", 1): 5, ("fox", 2): 1, ("fox", 130): 2, ("den", 1): 6, ("pen", 64): 2}.items():
        tf[t][d] = n
    for t, ds in tf.items():
        total = sum(ds.values())
        h = -sum(n / total * math.log(n / total) for n in ds.values())
        for d, n in ds.items():
            assert abs(got[t, d] - math.log(1 + n) * (1 - h / math.log(4))) < 1e-9
    assert len(got) == 5


def test_hot_term_and_bounds(spark):
    rows = [("hot", d, 5, T[0], "x") for d in range(3000)] + [("cold", d, 5, T[0], "x") for d in range(3)]
    rows += [("uneven", d, 900 if d == 7 else 1, T[0], "x") for d in range(60)] + [("light", d, 4, T[0], "x") for d in range(3)]
    r = P.heavy_terms(resolved(spark, rows), 5, 2, 25)
    assert sorted((x.term, x.doc_id) for x in r.collect()) == [("cold", 0), ("cold", 1), ("cold", 2)]
    assert P.log_entropy(resolved(spark, rows)).where(F.col("term") == "hot").count() == 3000


def test_empty(spark):
    e = resolved(spark, [])
    assert P.term_frequencies(P.vertical_index(e)).count() == 0
    assert P.log_entropy(e).count() == 0
