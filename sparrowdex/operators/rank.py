"""Ranking: BM25, TF-IDF, feature columns, composite score, blends and pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the composite score.
WEIGHTS = {"bm25": 0.35, "page_rank": 0.20, "freshness": 0.15, "authority": 0.10, "exact": 0.10, "title": 0.10}
#: Domains held to be authoritative.
AUTHORITIES = "wikipedia.org github.com stackoverflow.com medium.com nytimes.com bbc.com nature.com sciencedirect.com acm.org ieee.org arxiv.org springer.com".split()
#: Parts of domains that raise and lower their reputation, and credibility of top-level domains.
REPUTABLE = ".edu .gov .mil .org wikipedia github stackoverflow nytimes bbc nature .ac.".split()
SUSPICIOUS = "spam hack crack free-money win-prize click-here buy-now .xyz .top .loan".split()
CREDIBILITY = {
    "edu": 1.0, "gov": 1.0, "mil": 0.9, "org": 0.8, "com": 0.7, "net": 0.7, "io": 0.6, "co": 0.6, "info": 0.4, "biz": 0.3, "me": 0.4, "tv": 0.3,
    "xyz": 0.1, "top": 0.1, "loan": 0.1, "click": 0.05, "work": 0.15, "date": 0.1, "win": 0.1, "review": 0.2,
}


def query_hits(terms: DataFrame, stems: list[str], key: str = "doc_id") -> DataFrame:
    """(key, term, tf, weight) of the query's terms; weight is how often the query has the term.

    The terms are a literal predicate, so other rows are dropped before the shuffle.
    """
    counts = {t: stems.count(t) for t in stems}
    weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(n)) for t, n in counts.items()]) if counts else F.lit(None).cast("int")
    return terms.where(F.col("term").isin(list(counts))).groupBy(key, "term").agg(F.count("*").alias("tf")).withColumn("weight", weight)


def bm25(terms: DataFrame, stems: list[str], k1: float = 1.2, b: float = 0.75, key: str = "doc_id") -> DataFrame:
    """(key, bm25, tf_idf, length) of documents with a query term, from (key, pos, term) rows.

    idf = ln((N - df + 0.5) / (df + 0.5) + 1); documents without terms don't count. One aggregate over all rows gives
    lengths and term counts at once; df, N and the average length are scalars of it.
    """
    wanted = list(dict.fromkeys(stems))
    cols = [F.count_if(F.col("term") == t).alias(f"t{i}") for i, t in enumerate(wanted)]
    docs = terms.groupBy(key).agg(F.count("*").alias("length"), *cols)
    totals = docs.agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("avg"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(wanted))]).alias("s")).scalar()
    scored = docs.where(" OR ".join(f"t{i} > 0" for i in range(len(wanted))) or "false").withColumn("s", totals)
    score, tf_idf = F.lit(0.0), F.lit(0.0)
    for i, t in enumerate(wanted):
        tf, df, n = F.col(f"t{i}"), F.col(f"s.d{i}"), F.col("s.n")
        idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
        score += F.lit(float(stems.count(t))) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("s.avg")))
        tf_idf += F.lit(float(stems.count(t))) * tf / F.col("length") * F.ln(n / F.greatest(F.lit(1), df))
    return scored.select(key, score.alias("bm25"), tf_idf.alias("tf_idf"), "length")


def authority(domain: Column | str) -> Column:
    """Authority of a domain from 0.3 to 1: its top-level domain, a short name, a known name. Null has the least, 0.3."""
    d = F.coalesce(F.col(domain) if isinstance(domain, str) else domain, F.lit(""))
    name = F.length(F.substring_index(d, ".", 1))
    known = F.lit(False)
    for a in AUTHORITIES:
        known |= F.contains(d, F.lit(a))
    top = F.when(F.endswith(d, F.lit(".edu")) | F.endswith(d, F.lit(".gov")), 0.4).when(F.endswith(d, F.lit(".org")), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), 0.3 + top + F.when(name.between(3, 12), 0.1).otherwise(0.0) + F.when(known, 0.3).otherwise(0.0))


def reputation(domain: Column | str) -> Column:
    """Reputation from 0 to 1: 0.5, 0.3 more or less for each part of the lists. Null has 0.5."""
    d = F.coalesce(F.col(domain) if isinstance(domain, str) else domain, F.lit(""))
    s = F.lit(0.5)
    for p, by in [*((p, 0.3) for p in REPUTABLE), *((p, -0.3) for p in SUSPICIOUS)]:
        s += F.when(F.contains(d, F.lit(p)), by).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def credibility(domain: Column | str) -> Column:
    """Credibility of the top-level domain; 0.3 if it isn't listed or null."""
    table = F.create_map(*[F.lit(x) for kv in CREDIBILITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.substring_index(F.col(domain) if isinstance(domain, str) else domain, ".", -1)), F.lit(0.3))


def freshness(at: Column | str, now: str, days: float = 30.0) -> Column:
    """exp(-age / days) at the time `now`; a null time counts as infinitely old, a later one as more than 1."""
    ms = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col(at) if isinstance(at, str) else at)
    return F.coalesce(F.exp(-ms / F.lit(days * 86_400_000.0)), F.lit(0.0))


def keyword_density(text: Column, stems: list[str], length: Column) -> Column:
    """Mean over query terms of their occurrences as substrings over the document's length in terms."""
    s = F.lit(0.0)
    for t in stems:
        s += (F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / F.lit(len(t)) / F.greatest(F.lit(1), length)
    return s / F.lit(max(1, len(stems)))


def matched_terms(text: Column, terms: list[str]) -> Column:
    """Those of the terms that stand in the lower-cased text, in their order, each once; null texts have none."""
    known = F.array(*[F.lit(t) for t in dict.fromkeys(terms)]) if terms else F.array().cast("array<string>")
    return F.filter(known, lambda t: F.coalesce(F.contains(F.lower(text), t), F.lit(False)))


def composite(f: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds `score` to rows with bm25, page_rank (0 to 1), freshness, authority, exact, title, spam and density.

    BM25 goes through a sigmoid; a spam value above 0.5 scales by 1 - spam, a density above 0.3 by a half.
    """
    w = WEIGHTS | (weights or {})
    s = w["bm25"] / (1 + F.exp(-F.col("bm25")))
    for c in ("page_rank", "freshness", "authority", "exact", "title"):
        s += F.lit(w[c]) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    s *= F.when(F.col("spam") > 0.5, 1 - F.col("spam")).otherwise(1.0) * F.when(F.col("density") > 0.3, 0.5).otherwise(1.0)
    return f.withColumn("score", s)


def top(scored: DataFrame, k: int, offset: int = 0, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The rows of rank offset + 1 to offset + k by falling score, ties by key, with `rank`; only these are ranked."""
    first = scored.orderBy(F.desc(score), key).limit(offset + k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key))).where(F.col("rank") > offset)


def hybrid(sparse: DataFrame, dense: DataFrame, alpha: float = 0.3, key: str = "doc_id") -> DataFrame:
    """(key, hybrid): alpha * dense / largest dense + (1 - alpha) * sparse / max(1, largest sparse) over all ids of either.

    A side that lacks an id counts 0; if no dense score is above 0, that side counts 0.
    """
    d, s = dense.select(key, F.col("score").alias("d")), sparse.select(key, F.col("score").alias("s"))
    top_d, top_s = d.agg(F.max("d").alias("m")).scalar(), s.agg(F.max("s").alias("m")).scalar()
    both = d.join(s, key, "full")
    x = F.when(top_d > 0, F.coalesce("d", F.lit(0.0)) / top_d).otherwise(0.0)
    y = F.coalesce("s", F.lit(0.0)) / F.greatest(F.lit(1.0), F.coalesce(top_s, F.lit(1.0)))
    return both.select(key, (alpha * x + (1 - alpha) * y).alias("hybrid"))


def hybrid_each(sparse: DataFrame, dense: DataFrame, alpha: float = 0.3, key: str = "doc_id") -> DataFrame:
    """(query, key, hybrid): as `hybrid` for each query of the dense side (query, key, score), the sparse side being the same for all."""
    tops = dense.groupBy("query").agg(F.max("score").alias("top"))
    top_s = sparse.agg(F.max("score").alias("m")).scalar()
    d, s = dense.select("query", key, F.col("score").alias("d")), sparse.select(key, F.col("score").alias("s")).crossJoin(tops.select("query"))
    both = d.join(s, ["query", key], "full").join(tops, "query")
    x = F.when(F.col("top") > 0, F.coalesce("d", F.lit(0.0)) / F.col("top")).otherwise(0.0)
    y = F.coalesce("s", F.lit(0.0)) / F.greatest(F.lit(1.0), F.coalesce(top_s, F.lit(1.0)))
    return both.select("query", key, (alpha * x + (1 - alpha) * y).alias("hybrid"))


def blended(results: DataFrame, other: DataFrame, share: float = 0.7, score: str = "score", key: str = "doc_id") -> DataFrame:
    """Scores mixed with those of (key, other) where there is one: share * score + (1 - share) * other."""
    return results.join(other.select(key, F.col(other.columns[-1]).alias("__o")), key, "left").withColumn(
        score, F.when(F.col("__o").isNotNull(), share * F.col(score) + (1 - share) * F.col("__o")).otherwise(F.col(score))
    ).drop("__o")


def drift_penalised(results: DataFrame, drift: DataFrame, penalty: float = 0.3, key: str = "doc_id") -> DataFrame:
    """Scores times 1 - penalty * drift, no drift being 0."""
    d = drift.select(key, F.col("drift").alias("__d"))
    return results.join(d, key, "left").withColumn("score", F.col("score") * (1 - penalty * F.coalesce("__d", F.lit(0.0)))).drop("__d")
