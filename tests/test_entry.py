"""The driver's contract on the smallest tables, as far as they are there."""

import os

import pytest

import __spark_entry__ as entry

PLACE = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(PLACE), reason="no test tables")
def test_flagship(spark):
    rows = entry.queries()["bm25_topk"](spark, PLACE).collect()
    assert [r.rank for r in sorted(rows, key=lambda r: r.rank)] == list(range(1, len(rows) + 1)) and rows
