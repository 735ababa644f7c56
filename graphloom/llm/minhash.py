"""MinHash near-dedup by tensored banding.

A document's band key is a pair (a, b) of two keys from two small collections of
`SIDE` keys each; a key stands for `ROWS` minhashes.  `SIDE * SIDE` tables of
`2 * ROWS` minhashes come from `2 * SIDE * ROWS` minhash computations, about the
square root of what independent tables take.  Two documents share a table key
exactly if they share a key of each collection, so a table key is only looked at
where both halves occur again.

At a similarity of 0.8 a pair is missed with a probability of about
2 * (1 - 0.8**3)**20 = 1.2e-6 (less above 0.8).  Every candidate is confirmed on
the full shingle sets.

Skew: documents with equal sets are one representative from the start.  In a
bucket, members are first compared with one hub (the member whose keys are the
most frequent, the likely centre of a family of copies), which joins a family of
n copies by n comparisons.  Only members that share a table key with another
component go on, and of them only those with enough shingles in common with
other components to be linked at all; these are compared block by block, so that
only links leave a task, not pairs.  No candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from . import components, tables
from .textscan import SPACE_WORDS, Words, chunks, flat, grams, keys, mix, run_bounds, signed

_U = np.uint64
SIDE, ROWS = 20, 3
#: Shingles in a block of the exact comparison (a member counts as LEAST at least), shingles and members of a part of it
#: that is compared at a time, and shingles that are multiplied at a time.
BLOCK, LEAST, PART, MEMBERS, WIDE = 1 << 19, 256, 1 << 17, 256, 8192
_TURN = keys(31, 2 * SIDE * ROWS) | _U(1)
_ADD = keys(32, 2 * SIDE * ROWS)


def shingle_sets(part: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows' bounds): each row's distinct k-word shingles in ascending order; fewer words are one shingle."""
    w = Words(part, offsets, SPACE_WORDS)
    bound, start = run_bounds(w.first, k)
    hashes = grams(w.hash, k)[start] if len(start) else np.zeros(0, dtype=_U)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bound))
    count = np.diff(w.first)
    brief = np.flatnonzero((count > 0) & (count < k))
    if len(brief):
        short = np.array([xxhash.xxh3_64_intdigest(w.hash[w.first[r] : w.first[r + 1]].tobytes(), seed=k) for r in brief.tolist()], dtype=_U)
        hashes, row = np.concatenate([hashes, short]), np.concatenate([row, brief])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(offsets)))


def band_keys(hashes: np.ndarray, bound: np.ndarray, tag: int = 0) -> np.ndarray:
    """[non-empty row, 2 * SIDE] keys; the first half is collection a, the second b."""
    full = np.flatnonzero(np.diff(bound) > 0)
    out = np.empty((len(full), 2 * SIDE), dtype=_U)
    if not len(full):
        return out
    begin = bound[full]
    step = np.empty_like(hashes)
    for s in range(2 * SIDE):
        key = np.full(len(full), s + 1, dtype=_U)
        for r in range(s * ROWS, s * ROWS + ROWS):
            np.multiply(hashes, _TURN[r], out=step)
            step += _ADD[r]
            step ^= step >> _U(32)
            key = mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(step, begin))
        out[:, s] = key
    return out


SIGNED = "rk long, doc_id long, n_shingles long, sid long, second long, a array<long>, b array<long>"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j, part, off in chunks(data, offsets):
                hashes, bound = shingle_sets(part, off, k)
                size = np.diff(bound)
                full = np.flatnonzero(size > 0)
                band = band_keys(hashes, bound)
                raw = memoryview(np.ascontiguousarray(hashes)).cast("B")
                sid = np.zeros((2, len(size)), dtype=_U)
                whole = [xxhash.xxh3_128_intdigest(raw[8 * bound[r] : 8 * bound[r + 1]]) for r in full.tolist()]
                sid[0, full], sid[1, full] = [x >> 64 for x in whole], [x & 0xFFFFFFFFFFFFFFFF for x in whole]
                at = np.zeros(len(size) + 1, dtype=np.int32)
                np.cumsum(np.where(size > 0, SIDE, 0), out=at[1:])
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(signed(np.ascontiguousarray(band[:, s : s + SIDE]).reshape(-1)))) for s in (0, SIDE)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rk").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(size.astype(np.int64)), *(pa.array(signed(x), mask=size == 0) for x in sid), *lists],
                    names=["rk", "doc_id", "n_shingles", "sid", "second", "a", "b"],
                )

    return run


def _sets(k: int):
    """mapInArrow: (sid, text) -> (sid, shingles as bytes)."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j, part, off in chunks(data, offsets):
                hashes, bound = shingle_sets(part, off, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("sid").slice(i, j - i), pa.array([hashes[bound[r] : bound[r + 1]].tobytes() for r in range(j - i)], pa.binary())], names=["sid", "shingles"]
                )

    return run


def _confirm(percent: int):
    """mapInArrow: (u, v, su, sv) -> the pairs whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            good = []
            for x, y in zip(batch.column("su"), batch.column("sv"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=_U) for s in (x, y))
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int(np.count_nonzero(x[at] == y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], names=["u", "v"])

    return run


def _similar_size(percent: int):
    n, m = F.col("n"), F.col("m")
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose distinct `words`-word shingle sets have 100 * |intersection| >= percent * |union|.

    Words are runs of anything but space and \\t-\\r, after lower-casing A-Z.  One
    row per input row: doc_id, n_shingles, component_id (the least doc_id that
    links reach, itself included) and kept (doc_id = component_id).

    A text with fewer words is one shingle, a null or empty one has none and is
    linked with nothing; a very long one is compared whole.  A null doc_id is above all others: such a row takes its
    component's least id, and stands alone (component null, kept) if all are
    null.  Rows that share a doc_id are kept or not together.  An empty table
    gives no rows.  Columns beside doc_id and text are not read.
    """
    rows = tables.texts(docs)
    sigs, reps = _representatives(tables.keep(rows.transform(tables.mapped, _sign(words), SIGNED), "signatures"))
    active = tables.keep(_active(reps), "active")
    wanted = reps.select("sid", F.col("rk").alias("rk2"), "own").join(active.select("sid"), "sid")
    # a repeated row makes its set twice, and so a link twice, which changes no component
    sets = tables.keep(rows.join(wanted, (F.col("rk") == F.col("rk2")) & F.col("doc_id").eqNullSafe(F.col("own"))).select("sid", "text").transform(tables.mapped, _sets(words), "sid long, shingles binary"), "sets")
    links = _links(active, sets, percent)
    roots = components.components(links)
    named = reps.select("sid", "low").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("low").alias("component"))
    by_set = named.join(least, "root").select("sid", "component")
    out = sigs.select("doc_id", "n_shingles", "sid").join(by_set, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _representatives(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures, one row for each distinct set): sid is a set's number in both.

    sid starts as one half of a set's 128-bit hash; where sets differ in the other
    half, it takes that in, so that none is taken for another one.
    """
    # all firsts are of one row
    one = (F.first(c).alias(to) for c, to in (("rk", "rk"), ("doc_id", "own"), ("n_shingles", "n"), ("a", "a"), ("b", "b")))
    grouped = sigs.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("low"), *one, F.min("second").alias("x"), F.max("second").alias("y"))
    reps = tables.keep(grouped, "representatives")
    clash = reps.filter("x <> y").select("sid", F.lit(True).alias("clash"))
    if clash.isEmpty():
        return sigs, reps.drop("x", "y")
    apart = F.when(F.col("clash"), F.xxhash64("sid", "second")).otherwise(F.col("sid"))
    return _representatives(tables.keep(sigs.join(clash, "sid", "left").withColumn("sid", apart).drop("clash"), "signatures"))


def _again(reps: DataFrame, side: str) -> DataFrame:
    """(sid, keys of this collection that another representative has too, how often they occur in all)."""
    each = reps.select("sid", F.explode(side).alias("key"))
    # stored, so that the join has a shuffle on either side, which can be split at a key of very many documents
    twice = tables.keep(each.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "shared-keys")
    return each.join(twice.hint("shuffle_hash"), "key").groupBy("sid").agg(F.collect_list("key").alias(side), F.sum("c").alias(f"c{side}"))


def _active(reps: DataFrame) -> DataFrame:
    """The representatives that share keys of both collections, with those keys only; weight: how common these are."""
    return _again(reps, "a").join(_again(reps, "b"), "sid").join(reps.select("sid", "n"), "sid").select("sid", "n", "a", "b", (F.col("ca") + F.col("cb")).alias("weight"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("sid").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("sid").alias("v"), F.col("shingles").alias("sv"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv").transform(tables.mapped, _confirm(percent), "u long, v long")


def _links(active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links that connect whatever all links connect."""
    # first the hub of each key of collection a, if it has the member's table key as well
    each = active.select("sid", "n", "b", "weight", F.explode("a").alias("key"))
    # stored for the same reason as in `_again`
    hub = tables.keep(each.groupBy("key").agg(F.max(F.struct("weight", "sid")).alias("hub")).select("key", F.col("hub.sid").alias("hub")), "hubs")
    pairs = each.select("sid", "key").join(hub, "key").filter("sid <> hub").select("sid", "hub").distinct()
    pairs = (
        pairs.join(active.select("sid", "n", "b"), "sid")
        .join(active.select(F.col("sid").alias("hub"), F.col("n").alias("m"), F.col("b").alias("hb")), "hub")
        .filter(_similar_size(percent) & F.arrays_overlap("b", "hb"))
        .select(F.col("sid").alias("u"), F.col("hub").alias("v"))
    )
    links = tables.keep(_verified(pairs, sets, percent), "links")
    # then whatever may still be linked across the components so far
    roots = components.components(links)
    placed = active.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    left = _undecided(placed, sets, percent)
    if left.isEmpty():
        return links
    return links.unionByName(_blockwise(left, sets, percent))


def _blockwise(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of the undecided members, by exact comparison in blocks.

    Members that share keys, directly or through others, are a cluster.  In the
    order of cluster and component, they are cut into blocks of about BLOCK
    shingles; two blocks that hold members of one cluster are compared, unless all
    those members are of one component already.  A pair of blocks gives at most one
    link for each pair of components.  What is sent for a cluster of n blocks is
    n * n blocks: a block is as large as a task can hold twice, so this number is
    small for any cluster that the arithmetic, which is quadratic too, allows.
    """
    each = left.select("sid", F.explode("a").alias("key"))
    least = tables.keep(each.groupBy("key").agg(F.min("sid").alias("v")), "least")
    clusters = components.components(each.join(least, "key").select(F.col("sid").alias("u"), "v"))
    named = left.select("sid", "root", F.greatest("n", F.lit(LEAST)).alias("size")).join(clusters.select(F.col("node").alias("sid"), F.col("root").alias("cluster")), "sid", "left")
    placed = running_totals(named.withColumn("cluster", F.coalesce("cluster", "sid")), ["size"], "cluster", "root", "sid")
    at = tables.keep(placed.select("sid", "root", "cluster", F.floor(F.col("size_before") / BLOCK).alias("block")), "placed")
    packed = tables.keep(at.join(sets, "sid").groupBy("block").agg(F.collect_list(F.struct("cluster", "root", "sid", "shingles")).alias("pack")), "blocks")
    held = tables.keep(at.groupBy("cluster", "block").agg(F.min("root").alias("low"), F.max("root").alias("high")), "held")
    mate = held.select("cluster", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = held.join(mate, "cluster").filter((F.col("block") <= F.col("other")) & (F.least("low", "low2") < F.greatest("high", "high2"))).select("block", "other").distinct()
    second = packed.select(F.col("block").alias("other"), F.col("pack").alias("pack2"))
    both = pairs.join(packed, "block").join(second, "other")
    return both.select("block", "other", "pack", "pack2").transform(tables.mapped, _compare(percent), "u long, v long")


class _Pack:
    """Members of a block, and the parts in which they are compared."""

    def __init__(self, pack: pa.Array):
        self.cluster, self.root, self.sid = (pack.field(f).to_numpy(zero_copy_only=False) for f in ("cluster", "root", "sid"))
        self.sets = [np.frombuffer(x.as_buffer(), dtype=_U) for x in pack.field("shingles")]
        order = np.lexsort((self.sid, self.root, self.cluster))
        size = np.array([len(self.sets[k]) for k in order.tolist()], dtype=np.int64)
        number = (np.cumsum(size) - size) // PART + np.arange(len(order)) // MEMBERS
        self.parts = np.split(order, np.flatnonzero(np.diff(number)) + 1)


def _similar(x: _Pack, mine: np.ndarray, y: _Pack, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of two parts that are of one cluster, not of one component, and similar enough."""
    wanted = (x.cluster[mine][:, None] == y.cluster[others][None, :]) & (x.root[mine][:, None] != y.root[others][None, :])
    if not wanted.any():
        return mine[:0], others[:0]
    parts = [*(x.sets[k] for k in mine.tolist()), *(y.sets[k] for k in others.tolist())]
    n, m = len(parts), len(mine)
    size = np.array([len(p) for p in parts], dtype=np.int64)
    row = np.repeat(np.arange(n), size)
    _, which, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    shared = often[which]
    row, column = row[shared], number[which[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((m, n - m), dtype=np.float32)
    for begin in range(0, int(often.sum()), WIDE):
        a, b = np.searchsorted(column, [begin, begin + WIDE])
        held = np.zeros((n, WIDE), dtype=np.float32)
        held[row[a:b], column[a:b] - begin] = 1
        both += held[:m] @ held[m:].T
    i, j = np.nonzero(wanted & (100 * both >= percent * (size[:m, None] + size[None, m:] - both)))
    return mine[i], others[j]


def _compare(percent: int):
    """mapInArrow: pairs of blocks -> a link for each pair of components that one of their pairs of members links."""

    def run(batches):
        for batch in batches:
            found: list[np.ndarray] = []
            for k in range(batch.num_rows):
                x = _Pack(batch.column("pack")[k].values)
                same = batch.column("block")[k] == batch.column("other")[k]
                y = x if same else _Pack(batch.column("pack2")[k].values)
                links = [_similar(x, a, y, b, percent) for p, a in enumerate(x.parts) for q, b in enumerate(y.parts) if not same or p <= q]
                i, j = (np.concatenate(z) for z in zip(*links, strict=True))
                if len(i):
                    _, one = np.unique(np.stack([x.root[i], y.root[j]], axis=1), axis=0, return_index=True)
                    found.append(np.stack([x.sid[i[one]], y.sid[j[one]]]))
            u, v = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows with keys of both collections that members of another component have, too; a and b: those keys."""
    out = placed.drop("a", "b")
    for side in ("a", "b"):
        each = placed.select("sid", "root", F.explode(side).alias("key"))
        # stored for the same reason as in `_again`
        mixed = tables.keep(each.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key"), "mixed-keys")
        out = out.join(each.join(mixed.hint("shuffle_hash"), "key", "left_semi").groupBy("sid").agg(F.collect_list("key").alias(side)), "sid")
    return out


def _tokens(batches):
    """mapInArrow: (sid, root, shingles) -> one row per shingle."""
    for batch in batches:
        parts = [np.frombuffer(x.as_buffer(), dtype=_U) for x in batch.column("shingles")]
        size = np.array([len(x) for x in parts], dtype=np.int64)
        at = pa.array(np.repeat(np.arange(len(parts)), size))
        token = np.concatenate(parts) if parts else np.zeros(0, dtype=_U)
        yield pa.RecordBatch.from_arrays([batch.column("sid").take(at), batch.column("root").take(at), pa.array(signed(token))], names=["sid", "root", "token"])


def _undecided(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members that a link to another component may still have; p: how many of their shingles occur in other components.

    A link needs at least `percent` in 100 of the set in common with the other
    one, so a member with fewer such shingles is settled, whatever its keys.
    This is exact, and takes out the many copies that miss the threshold.
    """
    near = tables.keep(_mixed(placed), "near")
    token = tables.keep(near.select("sid", "root").join(sets, "sid").select("sid", "root", "shingles").transform(tables.mapped, _tokens, "sid long, root long, token long"), "tokens")
    shared = token.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("token")
    count = token.join(shared, "token", "left_semi").groupBy("sid").agg(F.count("*").alias("p"))
    live = tables.keep(near.join(count, "sid").filter(100 * F.col("p") >= percent * F.col("n")), "live")
    return tables.keep(_mixed(live), "undecided")


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(tables.load(spark, sf_dir, "documents"), words=4)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the least id of their group, by five-word shingles (rows that repeat that document stay with it).

    Null, empty and wordless texts are groups of their own and stay; so does a
    null id, unless its text is linked with that of a row with an id.  All columns
    are kept as they are.  An empty table gives none.
    """
    (name,) = tables.free(docs, "id")
    verdicts = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(verdicts, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")
