"""Quality of scored labels (score double, label 0/1), each as one aggregation per distinct score and one ordered pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EPSILON, GRID
from .ordering import running_totals


def by_score(scored: DataFrame) -> DataFrame:
    """(score, pos, neg)."""
    return scored.groupBy("score").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row `auc`: the chance that a positive outscores a negative, ties half; null if a class is empty."""
    rows = running_totals(by_score(scored), ["neg"], "score")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return rows.agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row `ap`: precision at every distinct score, weighted by the recall it adds; null without positives."""
    rows = running_totals(by_score(scored), ["pos", "neg"], -F.col("score"))
    tp = F.col("pos_before") + F.col("pos")
    precision = tp / (tp + F.col("neg_before") + F.col("neg")).cast("double")
    return rows.agg((F.sum(F.col("pos") * precision) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap"))


def sweep(scored: DataFrame) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) for the 91 thresholds.

    Scores are first counted by the greatest threshold they reach, compared with
    the thresholds themselves; suffix sums over 91 buckets do the rest.
    """
    spark = scored.sparkSession
    reached = F.size(F.filter(F.array(*(F.lit(t) for t in GRID)), lambda t: t <= F.col("score"))) - 1
    buckets = scored.groupBy(reached.alias("k")).agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"))
    grid = spark.createDataFrame([(-1, None), *enumerate(GRID)], "k int, threshold double")
    zero = F.lit(0).cast("long")
    full = grid.join(buckets, "k", "left").select("k", "threshold", F.coalesce("pos", zero).alias("pos"), F.coalesce("neg", zero).alias("neg"))
    up = Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing)  # 92 rows
    every = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = full.select("threshold", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), (F.sum("pos").over(every) - F.sum("pos").over(up)).alias("fn")).filter("threshold IS NOT NULL")
    eps = F.lit(EPSILON)
    rated = counts.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp") + eps)).withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fn") + eps))
    return rated.withColumn("f1", F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))


def best_threshold(swept: DataFrame) -> DataFrame:
    """One row (f1, threshold): the lowest threshold of the highest F1; (0, 0.5) if none is positive."""
    best = swept.filter("f1 > 0").agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("m"))
    return best.select(F.coalesce("m.f1", F.lit(0.0)).alias("f1"), F.coalesce(-F.col("m.t"), F.lit(0.5)).alias("threshold"))


def score_means(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("pos_mean"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("neg_mean"))


def evaluate(scored: DataFrame) -> DataFrame:
    """One row: auc, ap, f1, threshold, pos_mean, neg_mean."""
    return roc_auc(scored).crossJoin(average_precision(scored)).crossJoin(best_threshold(sweep(scored))).crossJoin(score_means(scored))  # one row each


def keep(history: DataFrame, policy: str = "best") -> DataFrame:
    """The evaluation to keep of (step, f1, ...): 'best' is the latest of those with the highest f1, 'last' the latest."""
    order = F.struct("f1", "step") if policy == "best" else F.struct("step")
    row = F.struct(*history.columns)
    return history.agg(F.max_by(row, order).alias("m")).filter("m IS NOT NULL").select("m.*")
