"""Training logs: append, parse, smooth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import positions

# The line formats.
TRAIN = r"Step (\d+) \| Loss: ([\d.]+) \| Pairs: \d+"
TRAIN_SINGLE = r"Step (\d+)/\d+ \| Loss: ([\d.]+) \| LR: [\d.e-]+"
VALIDATION = r"\[VAL\] Step (\d+) \| AUC: ([\d.]+) \| AP: ([\d.]+) \| F1: ([\d.]+)"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) in file order."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    return positions(rows, "line", "file_path", "file_block_start", "at").select("line", "value")


def append_log(spark: SparkSession, path: str, lines: list[str]) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def training_rows(lines: DataFrame, pattern: str = TRAIN) -> DataFrame:
    """(line, Step, Loss) of the lines that match; order them by line, as steps may come again after a resume."""
    return lines.filter(F.col("value").rlike(pattern)).select(
        "line", F.regexp_extract("value", pattern, 1).cast("long").alias("Step"), F.regexp_extract("value", pattern, 2).try_cast("double").alias("Loss")
    )


def validation_rows(lines: DataFrame) -> DataFrame:
    """(line, Step, AUC, AP, F1)."""
    part = lambda k: F.regexp_extract("value", VALIDATION, k)
    return lines.filter(F.col("value").rlike(VALIDATION)).select(
        "line", part(1).cast("long").alias("Step"), *(part(k).try_cast("double").alias(n) for k, n in ((2, "AUC"), (3, "AP"), (4, "F1")))
    )


def rolling_loss(rows: DataFrame, window: int = 5) -> DataFrame:
    """Rows with `trend`: the mean of the last `window` losses in line order, null until there are as many.

    A row's window is its `window` predecessors by position, found by an
    equi-join of positions rather than one window over the whole log.
    """
    at = positions(rows, "at_", "line")
    reach = at.select(F.explode(F.sequence(F.col("at_"), F.col("at_") + (window - 1))).alias("at_"), F.col("Loss").alias("past"))
    mean = reach.groupBy("at_").agg(F.count("*").alias("n_"), F.avg("past").alias("mean_"))
    return at.join(mean, "at_").withColumn("trend", F.when(F.col("n_") == window, F.col("mean_"))).drop("at_", "n_", "mean_")


def plot_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What a training plot shows: losses with their trend, and evaluations; drawing is left to the caller."""
    lines = read_log(spark, path)
    return rolling_loss(training_rows(lines)), validation_rows(lines)


def epoch_means(losses: DataFrame) -> DataFrame:
    """(epoch, mean_loss) of (epoch, loss)."""
    return losses.groupBy("epoch").agg(F.avg("loss").alias("mean_loss"))


