"""Similar nodes by shared out-neighbours, and edges by the vote of a node's peers."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from .ordering import positions


#: In-neighbours of a node that are paired in one task, about.
GROUP = 1000
#: Neighbours in one list of `top_similar`, and of `peer_vote`, about.
LIST = 256
#: Candidates that a round of `top_similar` deals out: so many an edge, at least LEAST.
PER_EDGE, LEAST = 3, 1 << 24
#: Votes that a round of `peer_vote` deals out for every edge, if more than LEAST.
VOTES = 2
#: Parts in which `top_similar` prepares the edges, if there are more than LEAST.
TURNS = 4
#: Lists that a worker counts at once, and bytes of lists that it sends in a batch, about.
ROWS, BYTES = 2000, 4 << 20


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, common) for a < b that share at least one distinct out-neighbour.

    Pairs are made once from distinct edges and counted map-side first.  The
    in-neighbours of a node are dealt out to groups of about GROUP by a hash, and
    each pair of groups is a key of its own, so a hub is spread over many tasks.
    """
    e = edges.select("src", "dst").distinct()
    groups = e.groupBy("dst").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("n"))
    dealt = shared.store(e.join(groups, "dst").withColumn("g", F.pmod(F.xxhash64("src"), F.col("n")).cast("int")), "dealt")
    left = dealt.select(F.col("src").alias("a"), "dst", F.col("g").alias("x"), F.explode(F.sequence("g", F.col("n") - 1)).alias("y"))
    right = dealt.select(F.col("src").alias("b"), "dst", F.explode(F.sequence(F.lit(0), F.col("g"))).alias("x"), F.col("g").alias("y"))
    pairs = left.join(right, ["dst", "x", "y"]).filter("x < y OR a < b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("common"))


def similarities(edges: DataFrame, kind: str = "jaccard") -> DataFrame:
    """(u, v, common, sim) both ways: common / union size, or common / root of the degrees' product."""
    degree = edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("d"))
    pairs = (
        common_neighbours(edges)
        .join(degree.select(F.col("src").alias("a"), F.col("d").alias("da")), "a")
        .join(degree.select(F.col("src").alias("b"), F.col("d").alias("db")), "b")
    )
    common = F.col("common").cast("double")
    sim = {"jaccard": common / (F.col("da") + F.col("db") - F.col("common")), "cosine": common / F.sqrt((F.col("da") * F.col("db")).cast("double"))}[kind]
    scored = pairs.select("a", "b", "common", sim.alias("sim"))
    return scored.select(F.col("a").alias("u"), F.col("b").alias("v"), "common", "sim").unionByName(scored.select(F.col("b").alias("u"), F.col("a").alias("v"), "common", "sim"))


def top_similar(edges: DataFrame, k: int = 5, kind: str = "jaccard") -> DataFrame:
    """(u, v, common, sim, rank): each node's k most similar nodes, ties to the smaller name.

    No pair is shuffled.  Nodes get numbers in the order of their names, and every edge
    u -> dst sends the list of dst's in-neighbours with their degrees to u's task, which
    counts and ranks them.  What the lists hold grows faster than the edges, so the nodes u
    take turns: a round deals out PER_EDGE candidates an edge and stores its ranks, and its
    shuffle files go.  Lists are about LIST long and travel as bytes, as few a number as the
    largest takes; a hub has several, met by its own members list by list.  Before that, edges
    are made distinct, numbered and listed in TURNS parts.  Null nodes are similar to none.
    """
    spark = edges.sparkSession
    shared.prepare(spark)
    raw = shared.store(edges.select("src", "dst").filter("src IS NOT NULL"), "edges", "zstd")
    turns = TURNS if raw.count() > LEAST else 1
    parts = [shared.store(_part(raw, "src", turns, t).distinct(), "distinct", "zstd") for t in range(turns)]
    shared.drop(raw)
    nodes = shared.store(positions(_all(parts).groupBy("src").agg(F.count("*").alias("d")), "idx", "src"), "nodes")
    size, most = nodes.agg(F.count("*"), F.coalesce(F.max("d"), F.lit(0).cast("long"))).first()
    whole = "int" if max(size, most) < 1 << 31 else "long"
    wide = tuple(max(1, (x.bit_length() + 7) // 8) for x in (size, most))

    numbers = nodes.select("src", F.col("idx").cast(whole).alias("v"), F.col("d").cast(whole).alias("d"))
    coded = []
    for t, part in enumerate(parts):
        coded.append(shared.store(part.filter("dst IS NOT NULL").join(_part(numbers, "src", turns, t), "src").select("dst", "v", "d"), "coded", "zstd"))
        shared.drop(part)
    listed = [shared.store(_lists(_part(_all(coded), "dst", turns, t), wide), "lists") for t in range(turns)]
    shared.drop(*coded)
    lists, length = _all(listed), F.octet_length("list") / sum(wide)
    pairs, ends, several = lists.agg(F.sum(length * F.col("m")), F.sum(length), F.max("n")).first()

    rounds = max(1, math.ceil((pairs or 0) / max(LEAST, PER_EDGE * (ends or 0))))
    ranked = [shared.store(_round(lists, (several or 0) > 1, wide, rounds, r, k, kind, size), "ranked") for r in range(rounds)]
    shared.drop(*listed)
    names = nodes.select("idx", "src")
    named = _all(ranked).join(names.select(F.col("idx").alias("u_idx"), F.col("src").alias("u")), "u_idx").join(names.select(F.col("idx").alias("v_idx"), F.col("src").alias("v")), "v_idx")
    return named.select("u", "v", "common", "sim", "rank")


def _part(frame: DataFrame, key: str, parts: int, part: int) -> DataFrame:
    return frame if parts == 1 else frame.filter(F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(parts)) == part)


def _all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _lists(coded: DataFrame, wide: tuple[int, int]) -> DataFrame:
    """(dst, m, n, g, list): dst's m in-neighbours, dealt out to n lists."""
    groups = coded.groupBy("dst").agg(F.count("*").alias("m")).withColumn("n", F.ceil(F.col("m") / LIST).cast("int"))
    dealt = coded.join(groups, "dst").withColumn("g", F.pmod(F.xxhash64("v"), F.col("n")).cast("int"))
    members = dealt.groupBy("dst", "m", "n", "g").agg(F.sort_array(F.collect_list(F.struct("v", "d"))).alias("l"))
    kind = coded.schema["dst"].dataType.simpleString()
    return shared.mapped(members.select("dst", "m", "n", "g", F.col("l.v").alias("vs"), F.col("l.d").alias("ds")), lambda batches: _packed(batches, wide), f"dst {kind}, m long, n int, g int, list binary")


def _packed(batches: Iterator[pa.RecordBatch], wide: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Numbers and degrees one after the other in a list's bytes, each in its fixed width."""
    for batch in batches:
        vs, ds = batch.column("vs"), batch.column("ds")
        ends = np.append(0, np.cumsum(vs.value_lengths().to_numpy())) * sum(wide)
        data = np.hstack([x.flatten().to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)[:, :w] for x, w in zip((vs, ds), wide, strict=True)])
        packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("dst", "m", "n", "g")), packed], names=["dst", "m", "n", "g", "list"])


def _unpacked(lists: pa.Array, wide: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, degrees, and how many each list has."""
    lists = lists.cast(pa.binary())
    if not len(lists):
        return (np.zeros(0, np.int64),) * 3
    ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    data = np.frombuffer(lists.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, sum(wide))
    out = []
    for x in (data[:, : wide[0]], data[:, wide[0] :]):
        full = np.zeros((len(x), 8), np.uint8)
        full[:, : x.shape[1]] = x
        out.append(full.view("<i8").ravel())
    return *out, np.diff(ends) // sum(wide)


def _round(lists: DataFrame, several: bool, wide: tuple[int, int], rounds: int, r: int, k: int, kind: str, size: int) -> DataFrame:
    """(u_idx, v_idx, common, sim, rank) of the nodes whose number leaves the remainder r."""
    met = lists.select(F.col("list").alias("own"), F.col("list").alias("sent"))
    if several:
        hubs = lists.filter("n > 1")
        left = hubs.select("dst", F.col("g").alias("x"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("y"), F.col("list").alias("own")).filter("x <> y")
        right = hubs.select("dst", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("x"), F.col("g").alias("y"), F.col("list").alias("sent")).filter("x <> y")
        met = met.unionByName(left.join(right, ["dst", "x", "y"]).select("own", "sent"))
    rows = shared.mapped(met, lambda batches: _sent(batches, wide, rounds, r), "u long, du long, list binary")
    rows = rows.repartition(F.col("u")).sortWithinPartitions("u")
    return shared.mapped(rows, lambda batches: _ranked(batches, wide, k, kind, size), "u_idx long, v_idx long, common long, sim double, rank int")


def _sent(batches: Iterator[pa.RecordBatch], wide: tuple[int, int], rounds: int, r: int) -> Iterator[pa.RecordBatch]:
    """A row (u, du, list) for every member u of `own` whose turn it is, in batches of about BYTES."""
    for batch in batches:
        sent = batch.column("sent")
        u, du, times = _unpacked(batch.column("own"), wide)
        mine = np.flatnonzero(u % rounds == r)
        row = np.repeat(np.arange(len(times)), times)[mine]
        total = np.cumsum(pc.binary_length(sent).to_numpy().astype(np.int64)[row])
        for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(total // BYTES)) + 1):
            yield pa.RecordBatch.from_arrays([pa.array(u[mine[part]]), pa.array(du[mine[part]]), sent.take(pa.array(row[part]))], names=["u", "du", "list"])


def _ranked(batches: Iterator[pa.RecordBatch], wide: tuple[int, int], k: int, kind: str, size: int) -> Iterator[pa.RecordBatch]:
    """Ranks of rows (u, du, list) that come in the order of u; only counts of the last u are kept between batches."""
    rest = [np.zeros(0, np.int64) for _ in range(5)]
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        v, d, times = _unpacked(batch.column("list"), wide)
        u, du = (np.repeat(batch.column(c).to_numpy(), times) for c in ("u", "du"))
        u, du, v, d, c = (np.concatenate(x) for x in zip(rest, (u, du, v, d, np.ones(len(u), np.int64)), strict=True))
        turn = np.cumsum(np.diff(u, prepend=u[:1]) != 0)
        key = turn * size + v
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        pick = order[first]
        counted = [u[pick], du[pick], v[pick], d[pick], np.add.reduceat(c[order], first)]
        end = np.searchsorted(turn[pick], turn[-1])
        rest = [x[end:] for x in counted]
        yield _first_k([x[:end] for x in counted], k, kind)
    yield _first_k(rest, k, kind)


def _first_k(counted: list[np.ndarray], k: int, kind: str) -> pa.RecordBatch:
    """The k best of every u, from rows (u, du, v, d, common) in the order of u and v."""
    other = counted[0] != counted[2]
    u, du, v, d, common = (x[other] for x in counted)
    sim = {"jaccard": lambda: common / (du + d - common), "cosine": lambda: common / np.sqrt((du * d).astype(np.float64))}[kind]()
    start = np.flatnonzero(np.diff(u, prepend=-1))
    stop = np.append(start, len(u))[1:]
    least = [np.partition(sim[a:b], b - a - k)[b - a - k] if b - a > k else 0.0 for a, b in zip(start, stop, strict=True)]
    near = np.flatnonzero(sim >= np.repeat(np.array(least), stop - start))
    near = near[np.lexsort((v[near], -sim[near], u[near]))]
    start = np.flatnonzero(np.diff(u[near], prepend=-1))
    rank = np.arange(len(near)) - np.repeat(start, np.diff(np.append(start, len(near)))) + 1
    near, rank = near[rank <= k], rank[rank <= k]
    return pa.RecordBatch.from_arrays([pa.array(u[near]), pa.array(v[near]), pa.array(common[near]), pa.array(sim[near]), pa.array(rank.astype(np.int32))], names=["u_idx", "v_idx", "common", "sim", "rank"])


def peer_vote(peers: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, dst, votes, peers, predicted): dst is predicted if more than half of u's peers point to it.

    A peer's out-neighbours travel to u as lists of about LIST, once; votes are counted
    there.  As in `top_similar`, the nodes u take turns where there are many votes.
    """
    shared.prepare(edges.sparkSession)
    e = edges.select("src", "dst").distinct()
    groups = e.groupBy("src").agg(F.ceil(F.count("*") / LIST).cast("int").alias("n"))
    dealt = e.join(groups, "src").withColumn("g", F.pmod(F.xxhash64("dst"), F.col("n")).cast("int"))
    null = F.when(F.max(F.col("dst").isNull()), F.array(F.lit(None).cast(e.schema["dst"].dataType))).otherwise(F.array())
    lists = shared.store(dealt.groupBy("src", "g").agg(F.concat(F.collect_list("dst"), null).alias("dsts")).select("src", "dsts"), "lists")
    count = peers.groupBy("u").agg(F.count("*").alias("peers"))
    asked = shared.store(peers.join(count, "u").select("u", F.col("v").alias("src"), "peers"), "asked")

    sizes = lists.groupBy("src").agg(F.sum(F.size("dsts")).alias("m"))
    ends = sizes.agg(F.sum("m")).first()[0] or 0
    cast = asked.groupBy("src").agg(F.count("*").alias("times")).join(sizes, "src").agg(F.sum(F.col("times").cast("double") * F.col("m"))).first()[0] or 0
    rounds = max(1, math.ceil(cast / max(LEAST, VOTES * ends)))
    if rounds == 1:
        return _votes(asked, lists)
    found = [shared.store(_votes(asked.filter(F.pmod(F.xxhash64("u"), F.lit(rounds)) == r), lists), "votes") for r in range(rounds)]
    shared.drop(asked, lists)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _votes(asked: DataFrame, lists: DataFrame) -> DataFrame:
    sent = asked.join(lists, "src").select("u", "peers", "dsts").repartition(F.col("u"))
    votes = sent.select("u", "peers", F.explode("dsts").alias("dst")).groupBy("u", "peers", "dst").agg(F.count("*").alias("votes"))
    return votes.select("u", "dst", "votes", "peers", (2 * F.col("votes") > F.col("peers")).cast("int").alias("predicted"))
