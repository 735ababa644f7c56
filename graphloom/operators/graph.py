"""Directed multigraphs as edge tables (src, dst).  Duplicates and self-loops are kept throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import positions


def edges_of(adjacency: DataFrame) -> DataFrame:
    """(line, pos, src, dst) of ragged rows (line, src, nbrs); a source without neighbours has no edge."""
    return adjacency.select("line", "src", F.posexplode("nbrs").alias("pos", "dst")).select("line", "pos", "src", "dst")


def first_seen_index(adjacency: DataFrame) -> DataFrame:
    """(node, idx): dense numbers by first appearance.

    Rows of one source form a group that stands where its first row stands; a
    source comes before its neighbours, and isolated sources are numbered too.
    """
    group = adjacency.groupBy("src").agg(F.min("line").alias("first"))
    rows = adjacency.join(group, "src")
    sources = rows.select(F.col("src").alias("node"), F.struct("first", F.lit(-1).cast("long").alias("line"), F.lit(-1).alias("pos")).alias("key"))
    targets = rows.select("first", "line", F.posexplode("nbrs").alias("pos", "node")).select("node", F.struct("first", F.col("line").cast("long").alias("line"), "pos").alias("key"))
    return index_by_key(sources.unionByName(targets))


def index_by_key(seen: DataFrame) -> DataFrame:
    """(node, idx) of occurrences (node, key), numbered by each node's least key."""
    return positions(seen.groupBy("node").agg(F.min("key").alias("key")), "idx", "key", "node").select("node", "idx")


def index_by_name(edges: DataFrame) -> DataFrame:
    """(node, idx) of all endpoints in the order of their names."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return positions(nodes, "idx", "node").select("node", "idx")


def encode(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges with both endpoints' numbers: src_idx, dst_idx."""
    return (
        edges.join(index.select(F.col("node").alias("src"), F.col("idx").alias("src_idx")), "src")
        .join(index.select(F.col("node").alias("dst"), F.col("idx").alias("dst_idx")), "dst")
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse: a reciprocal pair counts twice each way, a self-loop twice."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree) over both directions, 0 for nodes without an edge."""
    count = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.select("node").join(count, "node", "left").select("node", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def reachability(degree: DataFrame) -> DataFrame:
    """One row: nodes, reachable (degree > 0), percent, average degree of the reachable."""
    reachable = F.sum((F.col("degree") > 0).cast("long"))
    return degree.agg(
        F.count("*").alias("nodes"),
        F.coalesce(reachable, F.lit(0).cast("long")).alias("reachable"),
        F.round(100.0 * reachable / F.greatest(F.count("*"), F.lit(1)), 6).alias("percent"),
        F.round(F.sum("degree") / F.greatest(reachable, F.lit(1)), 6).alias("average_degree"),
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    """One row: edges, distinct edges, self-loops.  Counted per pair first, so a repeated edge is no hot key."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("copies"))
    return pairs.agg(
        F.coalesce(F.sum("copies"), F.lit(0).cast("long")).alias("edges"),
        F.count("*").alias("distinct_edges"),
        F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("copies"))), F.lit(0).cast("long")).alias("self_loops"),
    )


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """(src, nbrs): sorted out-neighbours with their copies."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def neighbour_table(edges: DataFrame) -> DataFrame:
    """(node, k, nbr): neighbours numbered from 0 in ascending order, as rows.

    Rows instead of an array per node: the step of a random walk joins on
    (node, k), so even a hub's neighbours are spread over all partitions.
    """
    rows = positions(edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr")), "at", "node", "nbr")
    first = rows.groupBy("node").agg(F.min("at").alias("first"), F.count("*").alias("degree"))
    return rows.join(first, "node").select("node", (F.col("at") - F.col("first")).alias("k"), "nbr", "degree")


def csr(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree, offset) of the bidirectional adjacency in the order of `nodes`' idx."""
    from .ordering import running_totals

    with_idx = degrees(edges, nodes).join(nodes, "node")
    return running_totals(with_idx, ["degree"], "idx").select("node", "idx", "degree", F.col("degree_before").alias("offset"))
