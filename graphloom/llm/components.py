"""Connected components of an edge table by alternating large and small stars.

Before every round each task makes stars of its own edges, `EDGES` at a time, and
sends one edge for each node but the least of a star.  A round then is two
aggregations and two equi-joins on long columns, split where a node has very many
edges; rounds grow with the logarithm of the longest path.  They end when every
component is a star around its least node, which one more aggregation tells, or
when the edges that are left are few enough for one task to have seen them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

#: Edges of which a task makes stars at a time.
EDGES = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable from it) for all nodes of these edges but the least ones themselves."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        # every root that has a smaller neighbour moves below the least one
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _own_stars(edges: int):
    """mapInArrow: (u, v) -> stars that connect what a task's edges connect, made of about so many edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            u, v = stars(*(np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("u", "v")))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        # one task that has all edges makes all stars at once: it is given no more than `edges`
        for batch in batches:
            if held and sum(x.num_rows for x in held) + batch.num_rows > edges:
                yield made()
            held.append(batch)
        if held:
            yield made()

    return run


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least neighbour, stored, so that a join with it has a shuffle on either side, which can be split at a hub."""
    return tables.keep(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large(edges: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """Each larger neighbour of u moves to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    scratch.append(_least(both))
    return both.join(scratch[-1], "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small(edges: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """Each smaller neighbour of u, and u itself, move to the least of them (u > v in every edge)."""
    scratch.append(_least(edges))
    star = edges.join(scratch[-1], "u")
    return star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(scratch[-1].select("u", F.col("m").alias("v")))


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes that have two parents, or a parent and a child; none are left once every component is a star."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 OR (below > 0 AND above > 0)")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable from every node of `edges` (u long, v long) but the roots themselves."""
    edges = tables.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    for _ in range(rounds):
        tasks = max(1, -(-edges.count() // EDGES))
        scratch = [edges]
        edges = tables.keep(edges.coalesce(tasks).transform(tables.mapped, _own_stars(EDGES), "u long, v long"), "stars")
        if tasks == 1 or _unsettled(edges).isEmpty():
            tables.drop(*scratch)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        scratch.append(edges)
        scratch.append(tables.keep(_large(edges, scratch).distinct(), "stars"))
        edges = tables.keep(_small(scratch[-1], scratch).distinct(), "stars")
        for table in scratch:
            tables.drop(table)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
