"""Registered queries of the subpackage that do the whole job, on small tables."""

from datetime import datetime

import __spark_entry__ as entry


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_lines_are_removed_by_dates_too(spark, tmp_path):
    schema = "id long, url string, title string, content string, domain string, crawled_at timestamp, is_removed boolean"
    rows = [(i, None, "t", f"the article of the day\nby author {'abcde'[i]}", "a.org", datetime(2025, 1, 2, i), False) for i in range(5)]
    rows += [(10 + i, None, "t", f"follow us\ntext {'abcde'[i]}", "a.org", datetime(2025, 1, 1 + i), False) for i in range(5)]
    d = folder(spark, tmp_path, docs=spark.createDataFrame(rows, schema))
    got = {r.id: (r.content, r.removed) for r in entry.queries()["p4_cleaned"](spark, d).collect()}
    assert all(got[r[0]] == ((r[3], 0) if r[0] < 10 else (r[3].split("\n")[1], 1)) for r in rows)
    assert {(r.id, r.line_no) for r in entry.queries()["p4_found"](spark, d).collect()} == {(r[0], 0) for r in rows}


def test_groups_have_every_current_record(spark, tmp_path):
    schema = "id long, url string, title string, content string, domain string, crawled_at timestamp, is_removed boolean"
    text = "the quick brown fox jumps over the lazy dog and runs through the big green field"
    texts = [text, text, text + " again", "three words", "", None]
    rows = [(i, None, None, x, "a.org", datetime(2025, 1, 1), False) for i, x in enumerate(texts)] + [(9, None, "t", text, "a.org", datetime(2025, 1, 1), True)]
    d = folder(spark, tmp_path, docs=spark.createDataFrame(rows, schema))
    got = entry.queries()["p5_groups"](spark, d).collect()
    assert len(got) == 6 and {r.id: (r["class"], r.links) for r in got} == {0: (0, 1), 1: (0, 1), 2: (2, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}


def test_trails_behind_a_long_menu():
    from sparrowdex.llm.boiler import TITLE, page_nodes

    menu = [f"entry {chr(97 + i % 26)}{chr(97 + i // 26)} of the menu:" for i in range(45)]
    page = "\n".join([*menu, "Home > Trees > Old Alder", "Old Alder", "It grows by the river."])
    assert (46, TITLE) in {(n, form) for n, _, form in page_nodes(None, page)}
