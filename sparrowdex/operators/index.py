"""Inverted index as relations: postings, statistics, gaps, codec, boolean, phrase and fuzzy retrieval, change merge."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def postings(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, key, tf, positions) of (key, pos, term) rows; positions ascend. Partial sums before the one shuffle."""
    return terms.groupBy("term", key).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def document_frequency(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df, total_tf) of every term."""
    once = terms.groupBy("term", key).agg(F.count("*").alias("tf"))
    return once.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def corpus_stats(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row (documents, terms, postings, tokens, avg_length, size_bytes); an empty index gives zeros.

    size_bytes is the sum over terms of 2 * length and 8, and 12 for each posting.
    """
    per_doc = terms.groupBy("term", key).agg(F.count("*").alias("tf"))
    by_term = per_doc.groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("t"))
    docs = per_doc.select(key).distinct().agg(F.count("*").alias("documents"))
    sums = by_term.agg(F.count("*").alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(2 * F.length("term") + 8 + 12 * F.col("n")), F.lit(0)).alias("size_bytes"))
    return sums.withColumn("documents", docs.scalar()).withColumn("avg_length", F.when(F.col("documents") > 0, F.col("tokens") / F.col("documents")).otherwise(0.0))


def posting_gaps(post: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, key, gap): distance of each posting's id to the one before in its list, the first from 0.

    Lists are cut into blocks of 65,536 ids that are sorted apart, so a very long list is no single task; the first gap
    of a block is taken from the last id of the block before.
    """
    block = F.shiftright(key, 16)
    rows = post.select("term", key, block.alias("block"))
    last = rows.groupBy("term", "block").agg(F.max(key).alias("last"))
    before = last.select("term", "block", F.coalesce(F.lag("last").over(Window.partitionBy("term").orderBy("block")), F.lit(0)).alias("before"))
    inside = rows.withColumn("lag", F.lag(key).over(Window.partitionBy("term", "block").orderBy(key)))
    return inside.join(before, ["term", "block"]).select("term", key, (F.col(key) - F.coalesce("lag", "before")).alias("gap"))


def vbyte_encode(values: list[int]) -> bytes:
    """Variable-byte code of ascending whole numbers from 0, as gaps; seven bits a byte, the last byte of a number flagged."""
    out, prev = bytearray(), 0
    for v in values:
        g, prev = v - prev, v
        while g > 127:
            out.append(g & 127)
            g >>= 7
        out.append(g | 128)
    return bytes(out)


def vbyte_decode(code: bytes) -> list[int]:
    """The numbers of a variable-byte code."""
    out, g, shift, prev = [], 0, 0, 0
    for b in code:
        g |= (b & 127) << shift
        shift += 7
        if b & 128:
            prev += g
            out.append(prev)
            g = shift = 0
    return out


def encoded_positions(post: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, key, code binary): positions of each posting in variable-byte code; null positions give an empty code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([vbyte_encode(sorted(p or [])) for p in b.column(2).to_pylist()], pa.binary())], ["term", key, "code"])

    return post.select("term", key, "positions").mapInArrow(run, f"term string, {key} long, code binary")


def decoded_positions(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, key, positions) of variable-byte codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([vbyte_decode(c) for c in b.column(2).to_pylist()], pa.list_(pa.int32()))], ["term", key, "positions"])

    return coded.select("term", key, "code").mapInArrow(run, f"term string, {key} long, positions array<int>")


def matching(post: DataFrame, term: str, key: str = "doc_id") -> DataFrame:
    """(key, tf, positions) of one term; the filter reaches the scan."""
    return post.where(F.col("term") == term).select(key, "tf", "positions")


def seek(post: DataFrame, term: str, target: int, key: str = "doc_id") -> DataFrame:
    """(key, tf): a term's first posting at or after a document id; none if there isn't one."""
    first = post.where((F.col("term") == term) & (F.col(key) >= target)).agg(F.min(F.struct(key, "tf")).alias("p"))
    return first.where("p IS NOT NULL").select(f"p.{key}", "p.tf")


def all_of(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of both lists: tf added, positions joined."""
    return a.alias("a").join(b.alias("b"), key).select(key, (F.col("a.tf") + F.col("b.tf")).alias("tf"), F.concat("a.positions", "b.positions").alias("positions"))


def any_of(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of either list: tf added, positions joined."""
    return a.unionByName(b).groupBy(key).agg(F.sum("tf").alias("tf"), F.flatten(F.collect_list("positions")).alias("positions"))


def without(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of the first list that aren't in the second."""
    return a.join(b.select(key), key, "left_anti")


def boolean_query(post: DataFrame, documents: DataFrame, steps: list[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """Fold of (operator, term) from left to right; AND, OR, NOT as joins. A leading NOT starts from all documents.

    No steps give no documents.
    """
    found = None
    for op, term in steps:
        now = matching(post, term, key)
        if found is None:
            found = without(documents.select(key, F.lit(0).cast("long").alias("tf"), F.array().cast("array<int>").alias("positions")), now, key) if op == "NOT" else now
        else:
            found = {"AND": all_of, "OR": any_of, "NOT": without}[op](found, now, key)
    return matching(post, "", key).where("false") if found is None else found


def phrase_query(terms: DataFrame, phrase: list[str], key: str = "doc_id") -> DataFrame:
    """(key, starts): documents that hold the phrase's terms at successive places.

    One pass: each row of a phrase term votes for the start it would have; starts with a vote of every place of the
    phrase are hits. Repeated terms vote once for each of their places in the phrase.
    """
    if not phrase:
        return terms.select(key, F.lit(0).cast("long").alias("starts")).where("false")
    places = terms.sparkSession.createDataFrame([(t, i) for i, t in enumerate(phrase)], "term string, i int")
    votes = terms.join(F.broadcast(places), "term").groupBy(key, (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("n"))
    return votes.where(F.col("n") == len(phrase)).groupBy(key).agg(F.count("*").alias("starts"))


def fuzzy_query(post: DataFrame, term: str, distance: int, key: str = "doc_id") -> DataFrame:
    """(key, tf): documents with a term at most `distance` edits (5 at most) from the given one."""
    d = min(int(distance), 5)
    near = post.where(F.abs(F.length("term") - len(term)) <= d).where(F.levenshtein("term", F.lit(term), d) >= 0)
    return near.groupBy(key).agg(F.sum("tf").alias("tf"))


def merge_delta(main: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two versions of a relation in which rows of `delta` replace rows of `main` with equal keys."""
    return main.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def latest_changes(changes: DataFrame, key: str, at: str) -> DataFrame:
    """The last change of each key; among equal times the greatest row. One shuffle with partial aggregates."""
    rest = [c for c in changes.columns if c not in (key, at)]
    return changes.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r")).select(key, "r.*")


def apply_changes(base: DataFrame, changes: DataFrame, key: str, at: str, op: str) -> DataFrame:
    """`base` after its changes: the last change of a key replaces its row, or deletes it if `op` is 'remove'."""
    last = latest_changes(changes, key, at)
    return merge_delta(base, last.where(F.col(op) != "remove").select(*base.columns), [key]).join(last.where(F.col(op) == "remove").select(key), key, "left_anti")
