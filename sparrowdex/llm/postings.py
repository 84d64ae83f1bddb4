"""Frequency of every term (vertical bitmaps) and log-entropy weights, over index rows with several versions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.common import trimmed
from sparrowdex.operators.skew import join_stats


def resolved_postings(postings: DataFrame) -> DataFrame:
    """(term, word, doc_id, tf): the posting that holds for each term and record.

    Null terms and null record ids are dropped, terms trimmed and lower-cased; of the rows of one term and record the
    latest indexed_at wins (null is oldest; among ties the largest tf), and it is dropped if its tf is null or not above 0.
    Rows are laid out by (term, word), where word = doc_id >> 6: both this step and the bitmaps built from it need only
    that one shuffle, and a term with a third of all rows is spread over all its words.
    """
    at = F.unix_micros(F.coalesce(F.col("indexed_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))).cast("decimal(20,0)")
    order = at * F.lit(1 << 32).cast("decimal(10,0)") + F.coalesce("tf", F.lit(-1))
    rows = postings.select(F.lower(trimmed("term")).alias("term"), F.shiftright("doc_id", 6).alias("word"), "doc_id", "tf", order.alias("at")).where("term IS NOT NULL AND doc_id IS NOT NULL")
    return rows.repartition("term", "word").groupBy("term", "word", "doc_id").agg(F.max_by("tf", "at").alias("tf")).where("tf > 0")


def vertical_index(resolved: DataFrame) -> DataFrame:
    """(term, word, bits, occurrences): a sparse bitmap of record ids per term, with occurrence counters beside it.

    Bit doc_id & 63 of the row for word doc_id >> 6 says that the record holds the term; words without a bit aren't
    stored, which is what compresses the bitmap. Empty input gives no rows.
    """
    bit = F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    return resolved.groupBy("term", "word").agg(F.bit_or(bit).alias("bits"), F.sum(F.col("tf").cast("long")).alias("occurrences"))


def union_indexes(*parts: DataFrame) -> DataFrame:
    """Merge vertical indexes of disjoint record sets (index segments): bits by union, counters by sum."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("term", "word").agg(F.bit_or("bits").alias("bits"), F.sum("occurrences").alias("occurrences"))


def term_frequencies(index: DataFrame, rare: int = 2, common: float = 0.2) -> DataFrame:
    """(term, occurrences, records, mark) of every distinct term of a vertical index.

    Record counts are bitmap cardinalities. mark: 'rare' with at most `rare` records, else 'common' with more than the
    share `common` of all records that hold any term, else null. A term that is both (tiny collections) is rare.
    """
    every = index.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.sum(F.bit_count("bits").cast("long")).alias("n")).scalar()
    terms = index.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum(F.bit_count("bits").cast("long")).alias("records"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * every, "common")
    return terms.withColumn("mark", mark)


def log_entropy(resolved: DataFrame, min_local: float = 0.0, entropies: tuple[float, float] | None = None) -> DataFrame:
    """(term, doc_id, tf, records, entropy, weight): how much each term tells its record from the others.

    weight = ln(1 + tf) * (1 - H / ln N): H is the entropy of the term's occurrences over records, N the number of
    records. Two aggregates (per term, over all) and one join give it. With N = 1 the second factor is 1. Bounds on the two
    factors are applied before the join: local weights ln(1 + tf) of at least min_local, and entropies within
    `entropies`, both ends included (to 1e-9).
    """
    n = resolved.groupBy("doc_id").agg(F.lit(1).alias("one")).agg(F.greatest(F.count("one"), F.lit(1)).alias("n")).scalar()
    x = F.col("tf").cast("double")
    spread = resolved.groupBy("term").agg(F.count("*").alias("records"), F.sum(x).alias("t"), F.sum(x * F.ln(x)).alias("s"))
    h = F.ln("t") - F.col("s") / F.col("t")
    stats = spread.select("term", "records", h.alias("entropy"), F.when(n > 1, 1 - h / F.ln(n)).otherwise(F.lit(1.0)).alias("distinct"))
    keep = f"entropy BETWEEN {entropies[0] - 1e-9!r}D AND {entropies[1] + 1e-9!r}D" if entropies else None
    local = resolved.where(F.ln(1 + x) >= min_local - 1e-12) if min_local else resolved
    joined = join_stats(local.select("term", "doc_id", "tf"), stats, ["term"], "records", "doc_id", keep)
    return joined.select("term", "doc_id", "tf", "records", "entropy", (F.ln(1 + F.col("tf")) * F.col("distinct")).alias("weight"))


def heavy_terms(resolved: DataFrame, min_tf: int = 5, min_records: int = 2, max_records: int = 25) -> DataFrame:
    """(term, doc_id, tf, records, weight): terms heavy in a record and shared by few others.

    The factors of the log-entropy weight decide: a local weight of at least that of min_tf, and an entropy of at most that of
    a term spread evenly over max_records, above which it must be in more records. An uneven term can be in more records all
    the same, and one in min_records or more has some entropy; so the number of records is checked exactly afterwards.
    """
    found = log_entropy(resolved, math.log(1 + min_tf), (0.0, math.log(max_records)))
    return found.where(F.col("records").between(min_records, max_records)).drop("entropy")
