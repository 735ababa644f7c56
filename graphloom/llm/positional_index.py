"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by documents: a shard is a slice of rows of about 2 MB, and
one stored row holds its postings, i.e. each term's ascending word positions in
the shard, with the documents' bounds among them.  A test phrase is answered in
a shard by intersecting offset-adjusted lists, starting from the term with the
shortest list, so most phrases end at their first, empty list.  A document lies
in one shard, so nothing is shuffled, and neither a frequent word nor a frequent
document makes a task larger than its slice of the input.

The index holds every term and is built once.  The test phrases search it in
blocks of at most `BLOCK` words, one block after the other, so what the driver and
a task hold of the benchmark is bounded; with several blocks, each one's hits are
stored and united by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .textscan import PLAIN_WORDS, Words, chunks, flat, signed

_U = np.uint64
#: Words of test phrases that search at a time.  A word is in at most 13 windows of 13 numbers, so this is 110 MB of tables at most.
BLOCK = 1 << 20

INDEX = "rk array<long>, doc_id array<long>, first array<int>, term binary, bound binary, place binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (rk, doc_id, text) -> one row per shard."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for i, j, part, off in chunks(data, offsets):
            w = Words(part, off, PLAIN_WORDS)
            place = np.argsort(w.hash, kind="stable")
            term = w.hash[place]
            begin = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("rk").slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.column("doc_id").slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    pa.array([w.first.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([term[begin].tobytes()], pa.binary()),
                    pa.array([np.append(begin, len(term)).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([place.astype(np.int32).tobytes()], pa.binary()),
                ],
                names=["rk", "doc_id", "first", "term", "bound", "place"],
            )


class Shard:
    """One row of the index."""

    def __init__(self, first, term: bytes, bound: bytes, place: bytes):
        self.first = np.asarray(first, dtype=np.int64)
        self.term = np.frombuffer(term, dtype=_U)
        self.bound = np.frombuffer(bound, dtype=np.int32)
        self.place = np.frombuffer(place, dtype=np.int32)

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """Each term's number in the shard, -1 if it isn't there."""
        if not len(self.term):
            return np.full(len(terms), -1, dtype=np.int64)
        at = np.searchsorted(self.term, terms)
        at[at == len(self.term)] = 0
        return np.where(self.term[at] == terms, at, -1)

    def list(self, slot: int) -> np.ndarray:
        return self.place[self.bound[slot] : self.bound[slot + 1]]

    def row(self, places: np.ndarray) -> np.ndarray:
        """The row of each word position."""
        return np.searchsorted(self.first, places, "right") - 1

    def phrase(self, slots: np.ndarray) -> np.ndarray:
        """Where the terms stand one after another in one document: the first one's positions."""
        sizes = self.bound[slots + 1] - self.bound[slots]
        start = None
        for k in np.argsort(sizes, kind="stable").tolist():
            here = self.list(slots[k]).astype(np.int64) - k
            if start is None:
                start = here[here >= 0]
                start = start[start + len(slots) <= self.first[self.row(start) + 1]]
            elif len(here) > 8 * len(start):
                at = np.searchsorted(here, start)
                at[at == len(here)] = 0
                start = start[here[at] == start]
            else:
                start = start[np.isin(start, here, assume_unique=True)]
            if not len(start):
                break
        return start

    def near(self, slots: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most `within` words away in the same document."""
        sizes = self.bound[slots + 1] - self.bound[slots]
        order = np.argsort(sizes, kind="stable").tolist()
        start = self.list(slots[order[0]]).astype(np.int64)
        for k in order[1:]:
            here, row = self.list(slots[k]).astype(np.int64), self.row(start)
            least, most = np.maximum(start - within, self.first[row]), np.minimum(start + within + 1, self.first[row + 1])
            start = start[np.searchsorted(here, least) < np.searchsorted(here, most)]
        return start


@dataclass(frozen=True)
class Phrases:
    """Test phrases by length: [phrases, length] numbers of terms in the vocabulary, and for each phrase the items that hold it."""

    groups: list[tuple[np.ndarray, list[list[int]]]]
    vocabulary: np.ndarray


def phrases(items: list[tuple[int, str]], length: int) -> Phrases:
    """The distinct windows of `length` words of each item; fewer words, but not none, are one window."""
    if not items:
        return Phrases([], np.zeros(0, dtype=_U))
    column = pa.array([t for _, t in items], pa.string())
    data, offsets = flat(column)
    w = Words(data, offsets, PLAIN_WORDS)
    vocabulary, number = np.unique(w.hash, return_inverse=True)
    number = number.astype(np.int32)
    found: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
    for r, (item, _) in enumerate(items):
        own = number[w.first[r] : w.first[r + 1]]
        m = min(length, len(own))
        for s in range(len(own) - m + 1 if m else 0):
            window = own[s : s + m]
            found.setdefault(m, {}).setdefault(window.tobytes(), (window, set()))[1].add(item)
    return Phrases([(np.stack([t for t, _ in by.values()]), [sorted(i) for _, i in by.values()]) for by in found.values()], vocabulary)


def _search(tests: Phrases):
    """mapInArrow: index rows -> rk, doc_id, n_words, hit positions (within the document), items."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                first = batch.column("first")[k].values.to_numpy()
                shard = Shard(first, batch.column("term")[k].as_py(), batch.column("bound")[k].as_py(), batch.column("place")[k].as_py())
                n = len(first) - 1
                hits: list[list[np.ndarray]] = [[] for _ in range(n)]
                items: list[set[int]] = [set() for _ in range(n)]
                slot = shard.slots(tests.vocabulary)
                for terms, owners in tests.groups:
                    slots = slot[terms]
                    for p in np.flatnonzero(slots.min(axis=1) >= 0).tolist():
                        start = shard.phrase(slots[p])
                        for s, r in zip(start.tolist(), shard.row(start).tolist(), strict=True):
                            hits[r].append(np.arange(s, s + terms.shape[1]) - shard.first[r])
                            items[r].update(owners[p])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rk")[k].values,
                        batch.column("doc_id")[k].values,
                        pa.array(np.diff(shard.first)),
                        pa.array([np.unique(np.concatenate(h)) if h else np.zeros(0, dtype=np.int64) for h in hits], pa.list_(pa.int64())),
                        pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                    ],
                    names=["rk", "doc_id", "n_words", "hits", "items"],
                )

    return run


FOUND = "rk long, doc_id long, n_words long, hits array<long>, items array<long>"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """(item_id, text) in blocks of at most BLOCK words (an item is never cut), read one partition at a time."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    block: list[tuple[int, str]] = []
    held = 0
    for r in rows.toLocalIterator():
        n = len(r.text) // 2 + 1
        if block and held + n > BLOCK:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += n
    yield block


def build_index(docs: DataFrame) -> DataFrame:
    """Store the positional index of `docs` in the shared folder."""
    return tables.keep(tables.texts(docs).transform(tables.mapped, _build, INDEX), "index")


def term_hashes(words: list[str]) -> np.ndarray:
    """The index's term for each word."""
    data, offsets = flat(pa.array(words, pa.string()))
    w = Words(data, offsets, PLAIN_WORDS)
    if not np.array_equal(np.diff(w.first), np.ones(len(words))):
        raise ValueError("each entry must be one word")
    return w.hash


def proximity(index: DataFrame, words: list[str], within: int) -> DataFrame:
    """(doc_id, places): positions of the rarest of `words` that have all the others within so many words."""
    terms = term_hashes(words)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                first = batch.column("first")[k].values.to_numpy()
                shard = Shard(first, batch.column("term")[k].as_py(), batch.column("bound")[k].as_py(), batch.column("place")[k].as_py())
                slots = shard.slots(terms)
                if not len(slots) or slots.min() < 0:
                    continue
                start = shard.near(slots, within)
                row = shard.row(start)
                ids = batch.column("doc_id")[k].values
                rows = np.unique(row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array([start[row == r] - shard.first[r] for r in rows.tolist()], pa.list_(pa.int64()))], names=["doc_id", "places"]
                )

    return index.transform(tables.mapped, run, "doc_id long, places array<long>")


def find_phrases(docs: DataFrame, benchmark: DataFrame, length: int = 13) -> DataFrame:
    """One row per document row: rk, doc_id, n_words, hits (positions of words in occurrences of a window), items."""
    index = build_index(docs)
    search = lambda block: index.transform(tables.mapped, _search(phrases(block, length)), FOUND)
    blocks = _blocks(benchmark)
    begin = list(islice(blocks, 2))
    if len(begin) == 1:
        return search(begin[0])
    # every block has each row: an empty one gives the rows, all blocks' hits come together by row
    own = F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max)).alias("own")
    parts = [tables.keep(search(block).filter(F.size("items") > 0).select("rk", own, "hits", "items"), "hits") for block in chain(begin, blocks)]
    # as sets: however often a row is repeated, its hits are there once
    hit = reduce(DataFrame.unionByName, parts).groupBy("rk", "own").agg(*(F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("hits", "items")))
    every = search([]).select("rk", own, "doc_id", "n_words")
    none = F.array().cast("array<long>")
    return every.join(hit, ["rk", "own"], "left").select("rk", "doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", none).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 13) -> DataFrame:
    """How much of each document stands in benchmark windows.

    Words are runs of letters a-z (A-Z are lower-cased), digits and anything
    beyond ASCII.  A window is `length` consecutive words of an item; an item of
    fewer, but not none, is one window.  A document word inside any occurrence of
    a window is hit.  One row per input row: doc_id, n_words, n_hit, n_items,
    items_sha256 (of the item_ids with occurring windows, sorted as strings and
    comma-joined) and contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    A null text has no words.  Benchmark rows with a null id or text take no
    part; rows that share an item_id are one item.  A null doc_id is carried as
    null; repeated rows are judged alike.  A very long text is a shard of its own.  An empty benchmark hits nothing, an
    empty table gives no rows.  Other columns are not read.
    """
    found = find_phrases(docs, benchmark, length)
    n_hit = F.size("hits").cast("long")
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return decontaminate(tables.load(spark, sf_dir, "documents"), tables.load(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the benchmark does not contaminate, with all their columns.

    Null, empty and wordless texts and null ids stay unless contaminated; repeated
    rows stay or go together.  An empty table gives none.
    """
    found = find_phrases(docs, tables.load(spark, sf_dir, "benchmark"))
    rk, own = tables.free(docs, "rk", "id")
    bad = found.filter((F.size("hits") > 0) & (20 * F.size("hits") >= F.col("n_words"))).select(F.col("rk").alias(rk), F.col("doc_id").alias(own)).distinct()
    # stored, so that its size is known before the join: below the session's broadcast threshold no text is shuffled
    bad = tables.keep(bad, "contaminated")
    tables.drop(found)  # the index, and hits of several blocks
    return docs.join(bad, (tables.row_key(docs) == F.col(rk)) & docs["doc_id"].cast("long").eqNullSafe(F.col(own)), "left_anti")


__all__ = ["Phrases", "Shard", "build_index", "decontaminate", "find_phrases", "op2", "phrases", "proximity", "signed", "stage", "term_hashes"]
