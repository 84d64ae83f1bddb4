"""Page quality: counted features, link farms, flags, and a fitted classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowdex.operators.rank import credibility, reputation

#: Top-level domains of link farms; words held to be common; flags with the feature, sign and threshold.
FARM_DOMAINS = ["xyz", "top", "loan", "click", "work", "date"]
COMMON = """
the and for are but not you all any can had her was one our out has have been some them than what when where which while who will with would about after before
between into over just like make many more most much only other such that their then there these they this those through under very were
""".split()
FLAGS = (
    ("keyword stuffing", "stuffing > 0.3"), ("high link density", "link_density > 0.1"), ("link farm patterns", "link_farm > 0.5"), ("low readability", "readability < 0.2"),
    ("excessive word repetition", "repeated > 0.5"), ("low domain reputation", "reputation < 0.2"), ("suspicious TLD", "credibility < 0.2"), ("excessive external links", "external_links > 0.8"),
    ("excessive scripts", "scripts > 0.5"), ("low content-to-HTML ratio", "content_ratio < 0.3"), ("excessive capitalization", "uppercase > 0.3"), ("excessive numbers", "digits > 0.2"),
)


def link_farm(links: Column, domain: Column) -> Column:
    """Marks over external links, up to two a link: its host is in more than three links, its domain is one of the farms'."""
    l = F.coalesce(links, F.array().cast("array<string>"))
    ext = F.filter(l, lambda x: ~F.contains(x, domain))
    host = lambda x: F.try_element_at(F.split(x, "/"), F.lit(3))
    many = F.size(F.filter(ext, lambda x: F.size(F.filter(l, lambda y: F.contains(y, host(x)))) > 3))
    bad = F.size(F.filter(ext, lambda x: F.substring_index(x, ".", -1).isin(FARM_DOMAINS)))
    return F.when(F.size(ext) > 0, (many + bad) / F.size(ext)).otherwise(0.0)


def quality_features(pages: DataFrame, key: str = "id") -> DataFrame:
    """(key, features...) of pages (key, content, domain, outgoing_links, headers): ratios and counts, all doubles.

    Null content counts as empty, null domain as an empty one, null links and headers as none. A page's words are counted
    within its row, so no shuffle is needed.
    """
    text, domain = F.coalesce("content", F.lit("")), F.coalesce("domain", F.lit(""))
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    base = pages.select(key, text.alias("t"), domain.alias("d"), F.coalesce("outgoing_links", F.array().cast("array<string>")).alias("l"), F.try_element_at("headers", F.lit("content-length")).alias("hl"), words.alias("ws"))
    base = base.withColumn("n", F.size("ws")).withColumn("low", F.array_sort(F.transform("ws", lambda w: F.lower(w))))
    runs = F.aggregate("low", F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(0).alias("distinct")), _count_run)
    base = base.withColumn("r", runs)
    one, chars = F.greatest(F.lit(1), F.col("n")), F.greatest(F.lit(1), F.length("t"))
    ext = F.size(F.filter("l", lambda x: ~F.contains(x, F.col("d"))))
    size = F.greatest(F.lit(1), F.coalesce(F.expr("try_cast(hl as int)"), F.length("t")))
    return base.select(
        key,
        (F.greatest(F.lit(1), F.col("r.most")) / F.greatest(F.lit(1.0), F.when(F.col("r.distinct") > 0, F.col("n") / F.col("r.distinct")).otherwise(0.0))).alias("stuffing"),
        (F.aggregate("ws", F.lit(0), lambda s, w: s + F.length(w)) / one).alias("word_length"),
        F.col("n").cast("double").alias("words"),
        (F.regexp_count("t", F.lit("[A-Z]")) / chars).alias("uppercase"),
        (F.regexp_count("t", F.lit("[!?,;:.]")) / chars).alias("punctuation"),
        (F.regexp_count("t", F.lit("[0-9]")) / chars).alias("digits"),
        (1 - F.col("r.distinct") / one).alias("repeated"),
        (F.size(F.filter("ws", lambda w: F.lower(w).isin(COMMON))) / one).alias("common"),
        (F.length("t") / size).alias("content_ratio"),
        (F.size("l") / one).alias("link_density"),
        F.regexp_count("t", F.lit("(?i)<h[1-6]")).cast("double").alias("headings"),
        (F.regexp_count("t", F.lit("(?i)<script")) * 100 / one).alias("scripts"),
        F.size("l").cast("double").alias("links"),
        (ext / F.greatest(F.lit(1), F.size("l"))).alias("external_links"),
        link_farm(F.col("l"), F.col("d")).alias("link_farm"),
        reputation("d").alias("reputation"),
        credibility("d").alias("credibility"),
        (F.length("d") - F.length(F.replace("d", F.lit("."), F.lit("")))).cast("double").alias("subdomains"),
    )


def _count_run(s: Column, w: Column) -> Column:
    """Over sorted words: the word, its run so far, the longest run, and how many different words."""
    run = F.when(s["w"] == w, s["run"] + 1).otherwise(1)
    new = s["distinct"] + F.when((s["w"] == w) & (s["run"] > 0), 0).otherwise(1)
    return F.struct(w.alias("w"), run.alias("run"), F.greatest(s["most"], run).alias("most"), new.alias("distinct"))


def flagged(features: DataFrame, key: str = "id") -> DataFrame:
    """(key, flags): names of the thresholds that a page's features exceed, in order; `readability` must be among them."""
    return features.select(key, F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in FLAGS])).alias("flags"))


def spam_score(features: DataFrame) -> DataFrame:
    """Adds `spam`, from 0 to 1: the share of FLAGS that the features exceed, in full from a third of them. Features that aren't there count as
    not exceeded."""
    rules = [rule for _, rule in FLAGS if rule.split()[0] in features.columns]
    hits = sum((F.coalesce(F.expr(rule), F.lit(False)).cast("int") for rule in rules), F.lit(0))
    return features.withColumn("spam", F.least(F.lit(1.0), hits / F.lit(len(FLAGS) / 3)))


def fit_quality_model(features: DataFrame, labels: DataFrame, sample: int = 5000, key: str = "id"):
    """Boosted trees over the features, fitted to at most `sample` labelled pages (verdict spam or ok), those of least hash."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    y = F.when(F.col("verdict") == "spam", 1.0).when(F.col("verdict") == "ok", 0.0)
    rows = labels.select(key, y.alias("label")).where("label IS NOT NULL").join(features, key).orderBy(F.xxhash64(key), key).limit(sample)
    columns = [c for c in features.columns if c != key]
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="label", maxIter=20, maxDepth=4, seed=7)]).fit(rows)
