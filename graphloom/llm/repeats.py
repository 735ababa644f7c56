"""Finding every repeated window of a corpus without comparing documents.

A *window* is `length` consecutive units (bytes or words) of one document.
Equal windows choose the same anchor: the least hashed `gram`-unit gram in
them.  A document is therefore cut into *segments*, the runs of consecutive
windows that share an anchor place, and equal windows always lie in segments
under one anchor value.  That makes the anchor a grouping key that loses no
pair, at about two rows per `length - gram` units.

1. `segments`: one row per segment occurrence.
2. Occurrences of anchors seen once are dropped; the others are aggregated
   (map side first) to *classes*, one per distinct segment content.
3. An anchor with several distinct contents is resolved by an index over one
   text of each class (`resolve`, given by the caller: a suffix automaton or a
   run-length suffix index).  A task streams through shards of whole anchor
   groups, each shard at most `SHARD` units, so memory is bounded.
4. A group of more than `MOST` classes (a very common line in different
   surroundings) is split: its windows are dealt out by where the anchor lies in
   them, with all the bytes that such windows have in common as the new anchor.
   In the last step a group is one window, which aggregation alone decides.
   Nothing is dropped at any size, and no group ever has to fit in a task whole.
5. The verdicts go back to the occurrences by an equi-join on the class.

All joins are plain equi-joins (split by adaptive execution where skewed) and
all aggregations have a map-side part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .textscan import RAW_WORDS, Words, chunks, flat, grams, keys, mix, run_bounds, signed, sliding_min

_U = np.uint64
_BYTES = keys(21, 256)
_PLACES = _U(0xFFFFFFFF)

#: verdict(bodies, n, low) -> for each body a list of (first window, last window, least document).
Verdict = list[tuple[int, int, int]]
NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Units:
    """What a document is made of, and how long a window (below 2**15 units) and its anchor are."""

    words: bool
    length: int
    gram: int
    cells: tuple[int, ...]  # window places per group, step by step, down to 1
    most: int  # classes of a group that one index takes
    shard: int  # units in an index

    @property
    def width(self) -> int:
        return self.length - self.gram + 1


BYTES = Units(words=False, length=400, gram=32, cells=(24, 1), most=2000, shard=1_200_000)
WORDS = Units(words=True, length=13, gram=3, cells=(1,), most=2000, shard=30_000)


def split(units: Units, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words | None]:
    """(unit hashes, rows' bounds, words)."""
    if not units.words:
        return np.take(_BYTES, data), offsets, None
    w = Words(data, offsets, RAW_WORDS)
    return w.hash, w.first, w


def offsets_of(units: Units, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words | None]:
    """(rows' bounds in units, words without hashes)."""
    if not units.words:
        return offsets, None
    w = Words(data, offsets, RAW_WORDS, hashed=False)
    return w.first, w


def cut(units: Units, unit: np.ndarray, first: np.ndarray):
    """Segments of the rows: (row, first window within the row, windows, anchor place within the segment, anchor)."""
    gram = grams(unit, units.gram)
    bound, start = run_bounds(first, units.length)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, np.zeros(0, dtype=_U)
    # the upper half orders, the lower half finds the place (the first one of equals)
    least = sliding_min((mix(gram) & ~_PLACES) | np.arange(len(gram), dtype=_U), units.width)
    place = (least[start] & _PLACES).astype(np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(bound))
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(place)))
    return row[at], start[at] - first[row[at]], count, place[at] - start[at], gram[place[at]]


def _digest(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = memoryview(np.ascontiguousarray(body)).cast("B")
    size = body.itemsize
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(raw[a:b]) for a, b in zip((begin * size).tolist(), (end * size).tolist(), strict=True)), dtype=_U, count=len(begin))


#: place: first window, windows and anchor place within the segment, in 32, 16 and 16 bits.
OCC = "rk long, low long, anchor long, seg long, place long"


def segments(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow: (rk, doc_id, text) -> one row per segment."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            rk = batch.column("rk").to_numpy(zero_copy_only=False)
            low = batch.column("doc_id").fill_null(NONE).to_numpy(zero_copy_only=False)
            for i, j, part, off in chunks(data, offsets):
                unit, first, _ = split(units, part, off)
                row, ws, nw, at, anchor = cut(units, unit, first)
                if not len(row):
                    continue
                begin = first[row] + ws
                seg = _digest(unit if units.words else part, begin, begin + nw + (units.length - 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (rk[i:j][row], low[i:j][row], signed(anchor), signed(seg), ws << 32 | nw << 16 | at)],
                    names=["rk", "low", "anchor", "seg", "place"],
                )

    return run


CLASS = "anchor long, seg long, n long, low long, nw int, at int, rivals long, body binary"


def bodies(units: Units):
    """mapInArrow: (text, wanted: array of class structs) -> the classes with their bytes."""
    names = ["anchor", "seg", "n", "low", "nw", "at", "rivals"]

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            wanted = batch.column("wanted")
            for i, j, part, off in chunks(data, offsets):
                own = wanted.slice(i, j - i)
                rows, count = own.flatten(), own.value_lengths().to_numpy(zero_copy_only=False)
                if not len(rows):
                    continue
                field = lambda x, rows=rows: rows.field(x).to_numpy(zero_copy_only=False)
                first, w = offsets_of(units, part, off)
                begin = first[np.repeat(np.arange(j - i), count)] + field("ws")
                end = begin + field("nw") + (units.length - 1)
                if w is not None:
                    begin, end = w.start[begin], w.end[end - 1]
                size = end - begin
                after = np.cumsum(size)
                place = np.arange(after[-1], dtype=np.int64) + np.repeat(begin - (after - size), size)
                bound = np.concatenate([[0], after]).astype(np.int32)
                body = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bound), pa.py_buffer(part[place])])
                yield pa.RecordBatch.from_arrays([*(rows.field(x) for x in names), body], names=[*names, "body"])

    return run


PIECE = "panchor long, pseg long, shift int, anchor long, seg long, n long, low long, nw int, at int, body binary"


def pieces(units: Units, cell: int):
    """mapInArrow: classes of a large group -> their windows by the anchor's place in them, `cell` places a piece."""

    def run(batches):
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                body = c["body"].split() if units.words else c["body"]
                text = b" ".join if units.words else bytes
                # place o of the anchor in a window: from at - (nw - 1) to at
                high, least = c["at"], c["at"] - c["nw"] + 1
                for k in range(least // cell, high // cell + 1):
                    lo, hi = max(least, k * cell), min(high, k * cell + cell - 1)
                    begin, end = c["at"] - hi, c["at"] - lo + units.length
                    # all windows of the whole cell have these units, whichever of them this class holds
                    core_at = c["at"] - k * cell
                    core = text(body[core_at : core_at - cell + 1 + units.length])
                    anchor = xxhash.xxh3_64_intdigest(core, seed=(c["anchor"] + k * 0x9E3779B9) & 0xFFFFFFFFFFFFFFFF)
                    piece = text(body[begin:end])
                    seg = xxhash.xxh3_64_intdigest(piece)
                    out.append((c["anchor"], c["seg"], begin, _signed(anchor), _signed(seg), c["n"], c["low"], hi - lo + 1, hi, piece))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                names = ["panchor", "pseg", "shift", "anchor", "seg", "n", "low", "nw", "at", "body"]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MARK = "anchor long, seg long, runs array<struct<lo:int,hi:int,low:long>>"


def shards(units: Units, verdict: Callable[[list[bytes], list[int], list[int], list[int]], list[Verdict]]):
    """mapInArrow over partitions sorted by anchor: index whole groups, up to `shard` units at a time."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("low", pa.int64())]))
    columns = ("anchor", "seg", "body", "n", "low", "nw", "rivals")

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        anchor, seg, body, n, low, nw, _ = zip(*rows, strict=True)
        kept = [(a, s, [{"lo": x, "hi": y, "low": z} for x, y, z in runs]) for a, s, runs in zip(anchor, seg, verdict(body, n, low, nw), strict=True) if runs]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], kind)], names=["anchor", "seg", "runs"]
        )

    def run(batches):
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for c in zip(*(batch.column(x).to_pylist() for x in columns), strict=True):
                if c[0] != last and held and held + c[6] * 2 * units.length > units.shard:
                    yield flush(rows)
                    rows, held = [], 0
                last = c[0]
                rows.append(c)
                held += c[5] + units.length - 1
        if rows:
            yield flush(rows)

    return run


def _ws(place) -> F.Column:
    return F.shiftright(place, 32)


def _nw(place) -> F.Column:
    return F.shiftright(place, 16).bitwiseAND(F.lit(0xFFFF)).cast("int")


def _at(place) -> F.Column:
    return place.bitwiseAND(F.lit(0xFFFF)).cast("int")


class _Scratch:
    """Tables that are deleted once what was made of them is stored."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        self.tables.append(tables.keep(frame, name))
        return self.tables[-1]

    def clear(self) -> None:
        while self.tables:
            tables.drop(self.tables.pop())


def _resolve(units: Units, classes: DataFrame, verdict, step: int, scratch: _Scratch) -> DataFrame:
    """MARK rows of CLASS rows (distinct by anchor and seg, each anchor with all its classes)."""
    spark = classes.sparkSession
    few = classes.filter(F.col("rivals") <= units.most)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = few.repartition(parts, "anchor").sortWithinPartitions("anchor").transform(tables.mapped, shards(units, verdict), MARK)
    many = classes.filter(F.col("rivals") > units.most)
    if step >= len(units.cells) or many.isEmpty():
        return out
    split_up = scratch.keep(many.transform(tables.mapped, pieces(units, units.cells[step]), PIECE), "pieces")
    distinct = scratch.keep(
        split_up.groupBy("anchor", "seg").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.min("nw").alias("nw"), F.min("at").alias("at"), F.min("body").alias("body")
        ),
        "distinct",
    )
    alone, rivals = _rivals(distinct, F.col("nw"), scratch)
    rival_pieces = scratch.keep(distinct.join(rivals.hint("shuffle_hash"), "anchor"), "rival-pieces")
    verdicts = alone.unionByName(_resolve(units, rival_pieces, verdict, step + 1, scratch))
    shifted = F.transform("runs", lambda r: F.struct((r["lo"] + F.col("shift")).alias("lo"), (r["hi"] + F.col("shift")).alias("hi"), r["low"].alias("low")))
    back = (
        split_up.select("panchor", "pseg", "shift", "anchor", "seg")
        .join(verdicts, ["anchor", "seg"])
        .select(F.col("panchor").alias("anchor"), F.col("pseg").alias("seg"), shifted.alias("runs"))
        .groupBy("anchor", "seg")
        .agg(F.flatten(F.collect_list("runs")).alias("runs"))
    )
    return out.unionByName(back)


def _rivals(classes: DataFrame, nw, scratch: _Scratch) -> tuple[DataFrame, DataFrame]:
    """MARK rows of the classes alone under their anchor (their own count decides), and the other anchors' class counts.

    The counts are stored: a join with them then has a shuffle on either side,
    which adaptive execution can split at an anchor of very many classes.
    """
    rivals = scratch.keep(classes.groupBy("anchor").agg(F.count("*").alias("rivals")).filter("rivals > 1"), "rivals")
    whole = F.array(F.struct(F.lit(0).alias("lo"), (nw - 1).cast("int").alias("hi"), F.col("low").alias("low")))
    alone = classes.join(rivals.hint("shuffle_hash"), "anchor", "left_anti").filter("n > 1").select("anchor", "seg", whole.alias("runs"))
    return alone, rivals


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with `own`, the doc_id as `repeated` gives it (a null one is above all others)."""
    return docs.withColumn("own", F.coalesce("doc_id", F.lit(int(NONE))))


def repeated(docs: DataFrame, units: Units, verdict, older: bool) -> DataFrame:
    """(rk, own, spans: array<struct<lo, hi>>): unit spans, half open, covered by repeated windows.

    older=False: a window counts if its content starts anywhere else.
    older=True: a window counts if its content also starts in a document with a
    smaller doc_id (a null id is above all others).
    """
    scratch = _Scratch()
    every = scratch.keep(docs.transform(tables.mapped, segments(units), OCC), "segments")
    seen = every.groupBy("anchor").agg(F.count("*").alias("c"), *([F.min("low").alias("a"), F.max("low").alias("b")] if older else []))
    again = scratch.keep(seen.filter("a < b" if older else "c > 1").select("anchor"), "anchors")
    occ = tables.keep(every.join(again.hint("shuffle_hash"), "anchor", "left_semi"), "repeated-segments")
    scratch.clear()
    # all firsts are of one row
    classes = scratch.keep(
        occ.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.first("rk").alias("rk"), F.first("low").alias("own"), F.first("place").alias("place")), "classes"
    )
    alone, rivals = _rivals(classes, _nw(F.col("place")), scratch)
    place = F.col("place")
    wanted = (
        classes.join(rivals.hint("shuffle_hash"), "anchor")
        .groupBy("rk", "own")
        .agg(F.collect_list(F.struct("anchor", "seg", "n", "low", _ws(place).alias("ws"), _nw(place).alias("nw"), _at(place).alias("at"), "rivals")).alias("wanted"))
    )
    # a repeated row is cut twice here; its classes have n > 1 in any case, so that changes no verdict
    with_body = scratch.keep(keyed(docs).select("rk", "own", "text").join(wanted.hint("shuffle_hash"), ["rk", "own"]).select("text", "wanted").transform(tables.mapped, bodies(units), CLASS), "bodies")
    marks = tables.keep(alone.unionByName(_resolve(units, with_body, verdict, 0, scratch)), "marks")
    scratch.clear()
    hits = occ.select("rk", "low", "anchor", "seg", _ws(place).alias("ws")).join(marks.hint("shuffle_hash"), ["anchor", "seg"])
    if older:
        hits = hits.withColumn("runs", F.filter("runs", lambda r: r["low"] < F.col("low"))).filter(F.size("runs") > 0)
    span = F.transform("runs", lambda r: F.struct((F.col("ws") + r["lo"]).alias("lo"), (F.col("ws") + r["hi"] + units.length).alias("hi")))
    # as a set: however often a row is repeated, its spans are there once
    return hits.select("rk", F.col("low").alias("own"), span.alias("spans")).groupBy("rk", "own").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def covered(spans: list | None, n: int) -> np.ndarray:
    """Boolean per unit: inside any span."""
    step = np.zeros(n + 1, dtype=np.int32)
    if spans:
        np.add.at(step, [s["lo"] for s in spans], 1)
        np.add.at(step, [s["hi"] for s in spans], -1)
    return np.cumsum(step[:n]) > 0
