"""Edge scores from node vectors, and predictions for test pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import decide, dot, sigmoid


def logits(pairs: DataFrame, source: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """`pairs` (src, dst, ...) with `logit`: the product of the source's and the target's vector (idx, vec).

    With one table the score is symmetric; a second one makes it directional.
    """
    target = source if target is None else target
    return (
        pairs.join(source.select(F.col("idx").alias("src"), F.col("vec").alias("src_vec")), "src")
        .join(target.select(F.col("idx").alias("dst"), F.col("vec").alias("dst_vec")), "dst")
        .withColumn("logit", dot(F.col("src_vec"), F.col("dst_vec")))
        .drop("src_vec", "dst_vec")
    )


def predict(test: DataFrame, bundle: DataFrame) -> DataFrame:
    """(id, prob, missing) of test rows (id, u, v), all strings, by a bundle (node, src_vec, dst_vec).

    A pair with an unknown node has probability 0.
    """
    left = bundle.select(F.col("node").alias("u"), F.col("src_vec").alias("a"))
    right = bundle.select(F.col("node").alias("v"), F.col("dst_vec").alias("b"))
    joined = test.select("id", "u", "v").join(left, "u", "left").join(right, "v", "left")
    missing = F.col("a").isNull() | F.col("b").isNull()
    return joined.select("id", F.when(missing, 0.0).otherwise(sigmoid(dot(F.col("a"), F.col("b")))).alias("prob"), missing.cast("int").alias("missing"))


def decisions(predicted: DataFrame, threshold: float) -> DataFrame:
    """(Id, Predictions)."""
    return predicted.select(F.col("id").alias("Id"), decide(F.col("prob"), threshold).alias("Predictions"))


def summary(predicted: DataFrame, threshold: float) -> DataFrame:
    """One row: total, positive, negative, missing."""
    one = decide(F.col("prob"), threshold).cast("long")
    zero = F.lit(0).cast("long")
    return predicted.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(one), zero).alias("positive"),
        F.coalesce(F.sum(1 - one), zero).alias("negative"),
        F.coalesce(F.sum(F.col("missing").cast("long")), zero).alias("missing"),
    )
