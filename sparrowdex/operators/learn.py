"""Learning to rank: preference pairs, their gradients, linear scores, boosted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the linear score, by feature.
WEIGHTS = {"tf_idf": 0.15, "bm25": 0.20, "page_rank": 0.15, "freshness": 0.10, "authority": 0.10, "length": 0.02, "density": 0.03, "dwell": 0.08, "clicks": 0.07, "exact": 0.05, "title": 0.05}


def preference_pairs(judged: DataFrame, group: str, item: str, good: str) -> DataFrame:
    """(group, winner, loser) of each good item with each other one of its group, both seen once.

    The good side is joined with the other; a group with very many of both gives as many pairs as its definition says.
    """
    one = judged.groupBy(group, item).agg(F.max(F.col(good).cast("int")).alias("g"))
    w, l = one.where("g = 1").select(group, F.col(item).alias("winner")), one.where("g = 0").select(group, F.col(item).alias("loser"))
    return w.join(l, group)


def gradients(pairs: DataFrame) -> DataFrame:
    """Adds `lambda` = 1 / (1 + exp(score_winner - score_loser)), what a winner gains and a loser loses."""
    return pairs.withColumn("lambda", 1 / (1 + F.exp(F.col("score_winner") - F.col("score_loser"))))


def linear_score(features: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds `score`, the weighted sum of the features that are there; null features count 0."""
    w = {k: v for k, v in (weights or WEIGHTS).items() if k in features.columns}
    return features.withColumn("score", sum((F.lit(v) * F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k, v in w.items()), F.lit(0.0)))


def fit_ranker(features: DataFrame, target: str, columns: list[str], trees: int = 20):
    """Boosted regression trees for a relevance target."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="skip"), GBTRegressor(featuresCol="x", labelCol=target, maxIter=trees, maxDepth=4, seed=7)]).fit(features)


def feature_importance(spark, weights: dict[str, float] | None = None) -> DataFrame:
    """(rank, feature, importance) of the linear score's weights, largest first, ties by name."""
    rows = sorted((weights or WEIGHTS).items(), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(i + 1, k, float(v)) for i, (k, v) in enumerate(rows)], "rank int, feature string, importance double")


def updated_weights(pairs: DataFrame, columns: list[str], weights: dict[str, float] | None = None, rate: float = 0.01) -> dict[str, float]:
    """Weights after one step along the pairs (w_<column>, l_<column> of winner and loser): each pair moves them by its gradient times the
    difference of its features. One aggregate over all pairs; null features count 0."""
    w = dict(weights or WEIGHTS)
    of = lambda side: sum((F.lit(w.get(c, 0.0)) * F.coalesce(F.col(f"{side}_{c}").cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    graded = gradients(pairs.withColumn("score_winner", of("w")).withColumn("score_loser", of("l")))
    step = [F.avg(F.col("lambda") * (F.coalesce(F.col(f"w_{c}").cast("double"), F.lit(0.0)) - F.coalesce(F.col(f"l_{c}").cast("double"), F.lit(0.0)))).alias(c) for c in columns]
    r = graded.agg(*step).first()
    return w | {c: w.get(c, 0.0) + rate * (r[c] or 0.0) for c in columns}
