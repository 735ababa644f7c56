"""Graphs and scored labels derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import positions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> part, one edge per line item."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    joined = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))


def shoppers_and_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node): every customer and part, with purchases or without."""
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))
    return customers.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node")))


def handovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, src, dst): user of the event before -> user of this event, in the order of time.

    The predecessor is found by position, so no task sees all events.
    """
    at = positions(table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), "at", "ts", "event_id")
    before = at.select((F.col("at") + 1).alias("at"), F.col("user_id").alias("src"))
    return at.join(before, "at").select("event_id", "src", F.col("user_id").alias("dst"))


def handover_occurrences(edges: DataFrame) -> DataFrame:
    """(node, key): where users first appear as source or target."""
    return edges.select(F.col("src").alias("node"), (2 * F.col("event_id")).alias("key")).unionByName(edges.select(F.col("dst").alias("node"), (2 * F.col("event_id") + 1).alias("key")))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(score, label)."""
    labels = table(spark, sf_dir, "labels").filter("quality IS NOT NULL AND doc_id IS NOT NULL")
    return labels.select(((F.col("doc_id") * 7919 % 101) / F.lit(100.0)).alias("score"), F.col("quality").cast("int").alias("label"))


def vectors(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """(idx, vec) of the embeddings; `shift` gives each id the vector of an id that much larger."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") - shift).alias("idx"), F.col("embedding").cast("array<double>").alias("vec"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, label): each id with two other ones."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    near = ids.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"), F.lit(1).alias("label"))
    return near.unionByName(ids.select(F.col("vec_id").alias("src"), (F.col("vec_id") * 7 % 251).alias("dst"), F.lit(0).alias("label")))
