"""Random walks and skip-gram context pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hash32
from ..sources import shared


def hop_tables(neighbours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hops, degrees) of a neighbour table (node, k, nbr, degree), stored: every row of `hops` brings the degree of the node it leads to."""
    degree = shared.store(neighbours.groupBy("node").agg(F.first("degree").alias("degree")), "degrees")
    after = degree.select(F.col("node").alias("nbr"), F.col("degree").alias("next_degree"))
    return shared.store(neighbours.select("node", "k", "nbr").join(after, "nbr", "left"), "hops"), degree


def walk_paths(hops: DataFrame, degree: DataFrame, starts: DataFrame, length: int, walks: int = 1, seed: int = 42, every: int = 5) -> DataFrame:
    """(walk_id, nodes) of `walks` walkers from each start, over the tables of `hop_tables`.

    A hop is one equi-join on (node, k), with k hashed from the walk and the hop,
    so it needs no second lookup and a hub is no hot key.  A walker carries its
    path; at a node without neighbours it stays and its path ends.  Every few hops
    the walkers are stored to cut the plan.
    """
    walkers = (
        starts.select("node")
        .select("node", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("w"))
        .select(F.concat_ws(":", F.col("node").cast("string"), F.col("w").cast("string")).alias("walk_id"), "node")
        .join(degree, "node", "left")
        .select("walk_id", F.array("node").alias("nodes"), "node", "degree")
    )
    for hop in range(1, length):
        draw = hash32(seed, F.col("walk_id"), hop)
        # a walker that stays looks for a row that isn't there, each at another place
        walkers = (
            walkers.withColumn("k", F.when(F.col("degree") > 0, draw % F.col("degree")).otherwise(-1 - draw % 1024))
            .join(hops, ["node", "k"], "left")
            .select(
                "walk_id",
                F.when(F.col("nbr").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("nbr"))).alias("nodes"),
                F.coalesce("nbr", "node").alias("node"),
                F.when(F.col("nbr").isNotNull(), F.col("next_degree")).alias("degree"),
            )
        )
        if hop % every == 0 and hop < length - 1:
            walkers = shared.store(walkers, "walkers")
            if walkers.filter("degree > 0").isEmpty():
                break
    return walkers.select("walk_id", "nodes")


def random_walks(neighbours: DataFrame, starts: DataFrame, length: int, walks: int = 1, seed: int = 42, every: int = 5) -> DataFrame:
    """(walk_id, pos, node) of `walks` walkers from each start over a neighbour table (node, k, nbr, degree)."""
    return walk_paths(*hop_tables(neighbours), starts, length, walks, seed, every).select("walk_id", F.posexplode("nodes").alias("pos", "node"))


def moved(paths: DataFrame) -> DataFrame:
    """The walks of more than one node."""
    return paths.filter(F.size("nodes") > 1)


def walk_arrays(walks: DataFrame) -> DataFrame:
    """(walk_id, nodes): ragged walks of more than one node."""
    steps = walks.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("steps"))
    return moved(steps.select("walk_id", F.transform("steps", lambda s: s["node"]).alias("nodes")))


def context_pairs(arrays: DataFrame, window: int = 5) -> DataFrame:
    """(walk_id, pos, w, center, context): each node with the up to `window` nodes after it."""
    after = F.slice("nodes", F.col("pos") + 2, F.lit(window))
    return (
        arrays.select("walk_id", "nodes", F.posexplode("nodes").alias("pos", "center"))
        .select("walk_id", "pos", "center", F.posexplode(after).alias("o", "context"))
        .select("walk_id", "pos", (F.col("o") + 1).alias("w"), "center", "context")
    )
