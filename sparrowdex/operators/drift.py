"""Shift of term usage over time windows: co-occurrence, PPMI vectors, drift of terms and documents, range aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.operators.quality import COMMON
from sparrowdex.operators.skew import join_stats
from sparrowdex.session import through_table


def drift_tokens(docs: DataFrame, key: str, text: str, at: str, days: int = 30) -> DataFrame:
    """(key, win, pos, w): words of more than two ASCII letters, digits or _, no common ones, with the epoch-aligned window.

    Documents without a time or text have no tokens.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_\\s]", " "), "\\s+"), lambda w: (F.length(w) > 2) & ~w.isin(COMMON))
    win = F.floor(F.unix_millis(F.col(at).cast("timestamp")) / F.lit(days * 86_400_000)).alias("win")
    return docs.where(F.col(at).isNotNull()).select(key, win, F.posexplode(words).alias("pos", "w"))


def _half(tokens: DataFrame, key: str, reach: int) -> DataFrame:
    """(win, a, b, n): pairs of different words within `reach` places, each once with a < b.

    Places ahead come from the document's own array of words, so a document's pairs are counted before any shuffle.
    """
    docs = tokens.groupBy(key, "win").agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("ws"))
    ahead = F.flatten(F.transform("ws", lambda x, i: F.transform(F.slice("ws", i + 2, reach), lambda y: F.struct(F.least(x["w"], y["w"]).alias("a"), F.greatest(x["w"], y["w"]).alias("b")))))
    near = docs.select("win", F.explode(ahead).alias("p")).select("win", "p.a", "p.b").where("a <> b")
    return near.groupBy("win", "a", "b").agg(F.count("*").alias("n"))


def _both(half: DataFrame, *values: str) -> DataFrame:
    """Rows of pairs in both directions, without a shuffle."""
    two = F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("ctx")), F.struct(F.col("b").alias("w"), F.col("a").alias("ctx")))
    return half.select("win", F.explode(two).alias("p"), *values).select("win", "p.w", "p.ctx", *values)


def cooccurrence(tokens: DataFrame, key: str, reach: int = 5) -> DataFrame:
    """(win, w, ctx, n): how often ctx stands within `reach` places of another w of the same document, in both directions.

    tokens: (key, win, pos, w), places counted over the kept words of a document, which is bounded.
    """
    return _both(_half(tokens, key, reach), "n")


def ppmi(tokens: DataFrame, key: str, reach: int = 5) -> DataFrame:
    """(win, w, ctx, v) with v = max(0, ln(p(w, ctx) / p(w) p(ctx))) in each window; zeros are left out.

    Pairs are counted once for both directions and kept in the shared folder; marginal counts, one for each word and window, are
    joined by a way that is safe for hot words.
    """
    half = through_table(_half(tokens, key, reach), "pairs")
    each = half.select("win", F.explode(F.array("a", "b")).alias("w"), "n").groupBy("win", "w").agg(F.sum("n").alias("nw"), F.count("*").alias("rows"))
    each = through_table(each, "marginals")
    t = each.groupBy("win").agg(F.sum("nw").alias("t"))
    one = join_stats(half, each.select("win", F.col("w").alias("a"), F.col("nw").alias("na"), "rows"), ["win", "a"], "rows", "b")
    two = join_stats(one.select("win", "a", "b", "n", "na"), each.select("win", F.col("w").alias("b"), F.col("nw").alias("nb"), "rows"), ["win", "b"], "rows", "a")
    v = F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))
    return _both(two.join(F.broadcast(t), "win").select("win", "a", "b", v.alias("v")).where("v > 1e-12"), "v")


def _last_windows(vectors: DataFrame, count: int) -> DataFrame:
    """(w, win, k, windows, norm): a word's last `count` windows, k = 1 the last, with the norm of its vector and its number of windows."""
    norms = vectors.groupBy("win", "w").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    by_time = Window.partitionBy("w").orderBy(F.desc("win"))
    every = Window.partitionBy("w")
    return norms.withColumn("k", F.row_number().over(by_time)).withColumn("windows", F.count("*").over(every).cast("int")).where(F.col("k") <= count)


def term_drift(vectors: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(w, windows, magnitude, drifted): 1 - cosine of a term's vectors in its last two windows.

    A term of a single window has magnitude 0 and isn't drifted. Only vectors of the last two windows are joined with themselves,
    by one aggregate over word and context.
    """
    vectors = through_table(vectors, "ppmi")
    last = through_table(_last_windows(vectors, 2), "last-windows")
    of = lambda k, name: F.max(F.when(F.col("k") == k, F.col(name)))
    met = vectors.join(last.select("w", "win", "k"), ["w", "win"]).groupBy("w", "ctx").agg(of(1, "v").alias("v"), of(2, "v").alias("u"))
    dots = met.where("v IS NOT NULL AND u IS NOT NULL").groupBy("w").agg(F.sum(F.col("v") * F.col("u")).alias("dot"))
    two = last.groupBy("w").agg(F.max("windows").alias("windows"), of(1, "norm").alias("norm"), of(2, "norm").alias("norm_before"))
    m = F.when(F.col("norm_before").isNull(), 0.0).otherwise(1 - F.coalesce("dot", F.lit(0.0)) / (F.col("norm") * F.col("norm_before")))
    return two.join(dots, "w", "left").select("w", "windows", F.round(m, 6).alias("magnitude")).withColumn("drifted", F.col("magnitude") > threshold)


def drift_motion(vectors: DataFrame) -> DataFrame:
    """(w, windows, velocity, acceleration): lengths of the change of a term's vector between its last two windows, and of the change of
    that change over its last three; 0 where there are fewer."""
    last = _last_windows(vectors, 3)
    of = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0))
    met = vectors.join(last.select("w", "win", "k", "windows"), ["w", "win"]).groupBy("w", "windows", "ctx").agg(of(1).alias("a"), of(2).alias("b"), of(3).alias("c"))
    square = lambda x: F.sqrt(F.sum(x * x))
    one, two = square(F.col("a") - F.col("b")), square(F.col("a") - 2 * F.col("b") + F.col("c"))
    return met.groupBy("w", "windows").agg(F.when(F.col("windows") > 1, one).otherwise(0.0).alias("velocity"), F.when(F.col("windows") > 2, two).otherwise(0.0).alias("acceleration"))


def drift_report(drift: DataFrame, most: int = 20) -> DataFrame:
    """(rank, w, windows, magnitude): the drifted terms of largest magnitude, ties in alphabetical order."""
    best = drift.where("drifted").orderBy(F.desc("magnitude"), "w").limit(most)
    return best.select(F.row_number().over(Window.orderBy(F.desc("magnitude"), "w")).alias("rank"), "w", "windows", "magnitude")


def window_centroids(vectors: DataFrame) -> DataFrame:
    """(win, ctx, mean): the mean vector of all terms of a window."""
    n = vectors.groupBy("win").agg(F.countDistinct("w").alias("terms"))
    return vectors.groupBy("win", "ctx").agg(F.sum("v").alias("v")).join(F.broadcast(n), "win").select("win", "ctx", (F.col("v") / F.col("terms")).alias("mean"))


def document_drift(tokens: DataFrame, drift: DataFrame, key: str) -> DataFrame:
    """(key, drift): mean magnitude over a document's drifted words, with repetition; 0 without any."""
    hit = tokens.join(drift.where("drifted").select("w", "magnitude"), "w").groupBy(key).agg(F.avg("magnitude").alias("drift"))
    return tokens.select(key).distinct().join(hit, key, "left").select(key, F.coalesce("drift", F.lit(0.0)).alias("drift"))


def range_aggregate(rows: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """One row over times start..end, both included: (last, n, total); an empty range gives null, 0, 0."""
    r = rows.where(F.col(at).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return r.agg(F.max(at).alias("last"), F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def lower_bound(rows: DataFrame, at: str, times: list[str]) -> DataFrame:
    """(t, idx): how many rows lie before each of a few times, so the place of the first at or after it, the last row's at most."""
    marks = rows.sparkSession.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("t"))
    n = rows.where(F.col(at).isNotNull()).agg(*[F.count_if(F.col(at) < F.lit(t).cast("timestamp")).alias(f"c{i}") for i, t in enumerate(times)], F.count("*").alias("n"))
    each = n.select("n", F.explode(F.array(*[F.struct(F.lit(t).cast("timestamp").alias("t"), F.col(f"c{i}").alias("c")) for i, t in enumerate(times)])).alias("x"))
    return marks.join(each.select("x.t", F.greatest(F.lit(0), F.least(F.col("x.c"), F.col("n") - 1)).alias("idx")), "t")


def range_vector(rows: DataFrame, at: str, start: str, end: str, vector: str = "vector", count: str = "n") -> DataFrame:
    """(i, mean): the mean of vectors over a range of times, weighted by their counts; null vectors don't count."""
    r = rows.where(F.col(at).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).where(F.col(vector).isNotNull())
    each = r.select(F.col(count).cast("double").alias("c"), F.posexplode(vector).alias("i", "x"))
    return each.groupBy("i").agg((F.sum(F.col("x").cast("double") * F.col("c")) / F.sum("c")).alias("mean"))
