"""Splits, negatives and initial vectors by hashed keys: the same seed gives the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import below, hash32, uniform
from ..sources import shared
from .ordering import positions


def numbered_copies(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with dup_no, which tells copies of a pair apart.  Only counts of pairs are shuffled."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("copies"))
    return pairs.select("src", "dst", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("dup_no"))


def validation_size(n: int, ratio: float, at_least_one: bool = True) -> int:
    return max(1, int(n * ratio)) if at_least_one else int(n * ratio)


def shuffled(frame: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """`frame` with `rank`: its place in the hashed order of the key, from 0."""
    return positions(frame.withColumn("h_", hash32(seed, *(F.col(k) for k in key))), "rank", "h_", *key).drop("h_")


def split_edges(edges: DataFrame, ratio: float = 0.05, seed: int = 42, at_least_one: bool = True) -> DataFrame:
    """Edges with dup_no and part: the first `ratio` of a hashed order is 'val', the rest 'train'.

    The split is by row, so copies of an edge can fall on both sides.
    """
    ranked = shared.store(shuffled(numbered_copies(edges), seed, ["src", "dst", "dup_no"]), "split")
    size = validation_size(ranked.count(), ratio, at_least_one)
    return ranked.withColumn("part", F.when(F.col("rank") < size, "val").otherwise("train")).drop("rank")


def leakage(split: DataFrame) -> DataFrame:
    """One row: pairs that stand on both sides, and pairs with copies at all."""
    pairs = split.groupBy("src", "dst").agg(F.countDistinct("part").alias("sides"), F.count("*").alias("copies"))
    return pairs.agg(F.sum((F.col("sides") > 1).cast("long")).alias("straddling_pairs"), F.sum((F.col("copies") > 1).cast("long")).alias("repeated_pairs"))


def candidates(spark, first: int, last: int, nodes: int, seed: int) -> DataFrame:
    """(cand_id, src, dst) of ids from `first` up to `last`, endpoints uniform, without self-loops."""
    ids = spark.range(first, last).withColumnRenamed("id", "cand_id")
    return ids.select("cand_id", below(nodes, seed, F.lit("u"), F.col("cand_id")).alias("src"), below(nodes, seed, F.lit("v"), F.col("cand_id")).alias("dst")).filter("src <> dst")


def negatives(spark, excluded: DataFrame, nodes: int, n: int, seed: int = 43, rounds: int = 8) -> DataFrame:
    """The first n candidates that are no edge of `excluded` (src, dst as numbers), by cand_id; repeats are allowed.

    Each round draws a tenth more than is missing (and 1024); after `rounds`
    rounds without enough non-edges the call fails instead of going on for ever.
    """
    return _negatives(spark, excluded.select("src", "dst").distinct(), nodes, n, seed, rounds)


def _negatives(spark, edges: DataFrame, nodes: int, n: int, seed: int, rounds: int = 8) -> DataFrame:
    """The same for edges that are distinct."""
    found, have, first = None, 0, 0
    for _ in range(rounds):
        last = first + int((n - have) * 1.1) + 1024
        good = shared.store(candidates(spark, first, last, nodes, seed).join(edges, ["src", "dst"], "left_anti"), "negatives")
        found = good if found is None else found.unionByName(good)
        have += good.count()
        first = last
        if have >= n:
            return positions(found, "at_", "cand_id").filter(F.col("at_") < n).drop("at_")
    raise ValueError(f"{have} of {n} negative edges found in {rounds} rounds: the graph is too dense")


def degree_weighted_negatives(spark, edges: DataFrame, n: int, seed: int = 44) -> DataFrame:
    """(cand_id, src, dst): endpoints drawn in proportion to degree, i.e. as ends of two hashed edges; non-edges only."""
    ranked = ranked_edges(edges, seed)
    size = ranked.count()
    draw = spark.range(n).select(F.col("id").alias("cand_id"), below(size, seed, F.lit("a"), F.col("id")).alias("a"), below(size, seed, F.lit("b"), F.col("id")).alias("b"))
    left = ranked.select(F.col("rank").alias("a"), F.col("src"))
    right = ranked.select(F.col("rank").alias("b"), F.col("dst"))
    both = draw.join(left, "a").join(right, "b").select("cand_id", "src", "dst").filter("src <> dst")
    return both.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("cand_id", "src", "dst")


def ranked_edges(edges: DataFrame, seed: int = 42) -> DataFrame:
    """Edges (src, dst, dup_no) with `rank`, their place in a hashed order, stored."""
    return shared.store(shuffled(numbered_copies(edges), seed, ["src", "dst", "dup_no"]), "ranked")


def minibatch(ranked: DataFrame, n: int, size: int, step: int, seed: int = 42) -> DataFrame:
    """(draw, src, dst): `size` of the n edges of `ranked_edges` drawn with replacement."""
    draws = ranked.sparkSession.range(size).select(F.col("id").alias("draw"), below(n, seed, step, F.col("id")).alias("rank"))
    return draws.join(ranked, "rank").select("draw", "src", "dst")


def context_negatives(centers: DataFrame, nodes: int, k: int = 5, seed: int = 42) -> DataFrame:
    """(pair_id, center, j, neg): k uniform nodes for each center, the true context not excluded."""
    j = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j")
    return centers.select("pair_id", "center", j).withColumn("neg", below(nodes, seed, F.col("pair_id"), F.col("j")))


def node_batches(nodes: DataFrame, batch: int, epoch: int, seed: int = 42) -> DataFrame:
    """(idx, batch): the epoch's hashed order of nodes, cut into batches of one optimizer step each."""
    return shuffled(nodes.withColumn("epoch_", F.lit(epoch)), seed, ["epoch_", "idx"]).select("idx", F.floor(F.col("rank") / batch).alias("batch"))


def uniform_vectors(nodes: DataFrame, dim: int, seed: int = 42, bound: float = 0.5) -> DataFrame:
    """(idx, vec): components uniform in [-bound, bound)."""
    return nodes.select("idx", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (uniform(seed, F.col("idx"), d) - 0.5) * (2 * bound)).alias("vec"))


def xavier_vectors(nodes: DataFrame, n: int, dim: int, seed: int = 42) -> DataFrame:
    return uniform_vectors(nodes, dim, seed, (6.0 / (n + dim)) ** 0.5)


