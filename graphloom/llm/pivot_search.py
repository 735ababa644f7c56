"""Exact top-k search by a pivot table.

Every vector's distances to a few dozen pivots are computed once and stored.  By
the triangle inequality, |d(q, p) - d(x, p)| is at most d(q, x) for each pivot
p, and the largest of these bounds the distance from below and so the inner
product from above.  A query evaluates the vectors of a slice in the order of
their bounds and stops as soon as the next bound is below its k-th best score;
the result is exact whatever the pivots are.

Queries are a stated part of the rows.  Both sides are dealt out by a hash, queries
to blocks of about `BLOCK` rows and vectors to slices of about `SLICE`, and every
block meets every slice in a task of its own, which answers with at most k rows a
query; the answers are merged by query.  Nothing but counts and the pivots'
sample passes through the driver.

Components are whole numbers of any size.  Rows in which all are below 2**53 are
`tame`: they have bounds, and inner products in floating point wherever that is
exact.  The others are always evaluated, in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables

BLOCK, SLICE = 4096, 16384
#: Vectors that pivots are chosen from, and pivots.
SAMPLE, PIVOTS = 2048, 32
EXACT = 1 << 53

STORED = "vec_id long, dim int, code binary, norm double, pivots binary"


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, x: array<double>); rows with a null id, vector or component, an empty vector or a non-finite component are left out."""
    x = table["embedding"].cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return table.select(table["vec_id"].cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * component); not right where that is 2**53 or more."""
    with np.errstate(over="ignore"):
        return np.floor(256 * x)


def whole(x: np.ndarray) -> list[int]:
    """floor(256 * component) of any size."""
    return [int(v) * 256 if abs(v) >= EXACT else math.floor(256 * v) for v in x.tolist()]


def choose(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other: each next one is the vector farthest from those chosen."""
    if not len(sample):
        return sample
    at = [int(np.argmax((sample**2).sum(axis=1)))]
    far = ((sample - sample[at[0]]) ** 2).sum(axis=1)
    while len(at) < min(n, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    return sample[at]


def distances(x: np.ndarray, norm: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = norm[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def _store(pivots: dict[int, np.ndarray]):
    """mapInArrow: (vec_id, x) -> STORED rows; the norm of a row that isn't tame is infinite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                x = _matrix(part.column("x"), dim)
                f = scaled(x)
                tame = (np.abs(f) < EXACT).all(axis=1)
                f[~tame] = 0
                d = distances(f, (f**2).sum(axis=1), pivots[dim]).astype(np.float32) if dim in pivots else np.zeros((len(x), 0), dtype=np.float32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        pa.array(np.full(len(x), dim, dtype=np.int32)),
                        pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary()),
                        pa.array(np.where(tame, (f**2).sum(axis=1), np.inf)),
                        pa.array([r.tobytes() for r in d], pa.binary()),
                    ],
                    names=["vec_id", "dim", "code", "norm", "pivots"],
                )

    return run


class Block:
    """Vectors of one dimension with their distances to the pivots, by id."""

    def __init__(self, rows: pa.Table, dim: int):
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.raw = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype="<f8").reshape(-1, dim)[order]
        self.norm = rows.column("norm").to_numpy()[order]
        self.tame = np.isfinite(self.norm)
        self.code = np.where(self.tame[:, None], scaled(self.raw), 0)
        self.most = np.abs(self.code).max(axis=1, initial=0)
        self.pivot = np.frombuffer(b"".join(rows.column("pivots").to_pylist()), dtype=np.float32).reshape(len(ids), -1)[order]


def inner(block: Block, rows: np.ndarray, queries: Block, n: int) -> list[int]:
    """Integer inner products of rows with a query: in floating point where every partial sum is exact there, else in whole numbers."""
    dim = block.code.shape[1]
    fits = block.tame[rows] & queries.tame[n] & (block.most[rows] * queries.most[n] * dim < EXACT)
    if fits.all():
        return (block.code[rows] @ queries.code[n]).astype(np.int64).tolist()
    q = whole(queries.raw[n])
    out = (block.code[rows] @ queries.code[n]).tolist()
    return [int(s) if ok else sum(a * b for a, b in zip(whole(block.raw[r]), q, strict=True)) for s, ok, r in zip(out, fits.tolist(), rows.tolist(), strict=True)]


def search(queries: Block, block: Block, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score): each query's k best of the block, ties to the smaller id; never the query's own id."""
    ids, norm, pivot = block.ids, block.norm, block.pivot.T.copy()
    # room for rounding, also of the stored single-precision distances
    root = np.sqrt(np.where(block.tame, norm, 0)) + 1
    out: list[tuple[int, int, int]] = []
    for n in range(len(queries.ids)):
        own = queries.ids[n]
        if queries.tame[n]:
            low = np.zeros(len(ids), dtype=np.float32)
            for p in range(pivot.shape[0]):
                np.maximum(low, np.abs(pivot[p] - queries.pivot[n, p]), out=low)
            least = np.maximum(low.astype(np.float64) - 1e-6 * (math.sqrt(queries.norm[n]) + root), 0)
            bound = (queries.norm[n] + norm - least**2) / 2 + 1e-12 * (queries.norm[n] + norm) + 0.5
        else:
            bound = np.full(len(ids), np.inf)
        bound[ids == own] = -np.inf
        best: list[tuple] = []
        left, width = np.arange(len(ids)), 256
        while len(left):
            if len(left) > width:
                top = np.argpartition(-bound[left], width - 1)
                now, left = left[top[:width]], left[top[width:]]
            else:
                now, left = left, left[:0]
            now = now[bound[now] > -np.inf]
            if len(now):
                best += [(-s, i) for s, i in zip(inner(block, now, queries, n), ids[now].tolist(), strict=True)]
                best = sorted(best)[:k]
            if len(best) == k and abs(best[-1][0]) < 1 << 1000:
                left = left[bound[left] >= float(-best[-1][0])]
            width *= 2
        out += [(int(own), i, -s) for s, i in best]
    return out


FOUND = "query_id long, vec_id long, place binary, score long"


def place(score: int) -> bytes:
    """Bytes that stand in the order of the scores, whatever their size."""
    size = (abs(score).bit_length() + 7) // 8
    body = abs(score).to_bytes(size, "big")
    return ((1 << 15) + size).to_bytes(2, "big") + body if score >= 0 else ((1 << 15) - size).to_bytes(2, "big") + bytes(255 - b for b in body)


def _answer(k: int):
    """cogroup: the queries of a block and the vectors of a slice -> each query's k best there."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        for dim in np.unique(asked.column("dim").to_numpy()).tolist():
            mine, other = (t.filter(pc.equal(t.column("dim"), dim)) for t in (asked, rows))
            if len(other):
                found += search(Block(mine, dim), Block(other, dim), k)
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        scores = [x if -(1 << 63) <= x < 1 << 63 else None for x in s]
        return pa.table([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array([place(x) for x in s], pa.binary()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "place", "score"])

    return run


def top_k(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Each query's k highest integer inner products of floor(256 * component) vectors, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all
    rows but the query's own.  Returns query_id, rank (from 1), vec_id, score.

    Rows with a null id or vector, an empty vector, or null or non-finite
    components take no part.  Vectors are compared with those of their own length
    only.  A repeated row is a candidate as often as it stands there, but for its
    own id's query, and an id asks once.  Scores are compared in full, however
    large; one that a long cannot hold is returned as null.  A query without
    candidates has no rows; an empty table gives none.  Other columns are not read.
    """
    tables.prepare(table.sparkSession)
    x = vectors(table)
    sample = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    pivots = {}
    for dim in {len(r.x) for r in sample}:
        f = scaled(np.array([r.x for r in sample if len(r.x) == dim], dtype=np.float64))
        pivots[dim] = choose(f[(np.abs(f) < EXACT).all(axis=1)], PIVOTS).reshape(-1, dim)
    stored = tables.keep(x.transform(tables.mapped, _store(pivots), STORED).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "pivots")
    asked = tables.keep(stored.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "queries")
    slices, blocks = (max(1, -(-n // size)) for n, size in ((stored.count(), SLICE), (asked.count(), BLOCK)))
    # each side has its own number from its hash, and a copy for each number of the other side
    number = lambda n: F.pmod("deal", F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", number(blocks).alias("block"), copies(slices).alias("slice")).groupBy("block", "slice")
    right = stored.select("*", number(slices).alias("slice"), copies(blocks).alias("block")).groupBy("block", "slice")
    found = left.cogroup(right).applyInArrow(_answer(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    return top_k(tables.load(spark, sf_dir, "embeddings"))
