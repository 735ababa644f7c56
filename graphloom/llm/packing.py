"""Packing by minimum bin slack.

Documents are tokenised once; of a document longer than a sequence, full
sequences are cut off.  Only piece lengths matter for a plan, and there are at
most `capacity` of them, so the plan is made from their histogram: the longest
piece left opens a sequence, a bitset subset-sum finds the multiset of other
lengths that fills it closest to capacity, and the counts are traced back.  That
pattern is then used as often as the counts allow, which at least halves the
count of one length; so there are at most `capacity * (1 + log2(pieces))`
patterns, however many documents there are.  Documents find their places by
their rank among pieces of equal length, ranked in each partition and offset by
the partitions' counts: no task ever sorts or holds a group of pieces.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables
from .textscan import chunks, flat, hash_runs, rows_of

#: Units whose ids a worker keeps (about 40 bytes each), and units encoded in one string.
_CACHED, _JOINED = 300_000, 512
#: Bytes of text that are encoded at a time.
_CHUNK = 1 << 20
_ENCODERS: dict[str, Encoder] = {}

_LETTER, _DIGIT, _MARK, _OTHER = 1, 2, 3, 4


def _classes() -> np.ndarray:
    """Class of each ASCII byte; 0 is white space.

    An apostrophe may begin a contraction, a bar a special token, and a control
    character may be anything, so words with one are left whole.
    """
    c = np.full(256, _OTHER, dtype=np.uint8)
    c[33:127] = _MARK
    c[48:58] = _DIGIT
    c[65:91] = c[97:123] = _LETTER
    c[[39, 124]] = _OTHER
    c[[9, 10, 11, 12, 13, 32]] = 0
    return c


_CLASS = _classes()


class Units:
    """The smallest parts of a text that a white-space dropping, lower-casing word tokenizer encodes on its own.

    Parts are runs of letters, single digits and runs of punctuation, as far as
    words are made of ASCII and accented Latin-1 letters; any other word is one
    part.  Letters are lower-cased, which merges what the tokenizer cannot tell
    apart.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind, fold = _CLASS[data], data.copy()
        fold[(data >= 65) & (data <= 90)] += 32
        lead = np.flatnonzero(data == 0xC3)
        if len(lead):
            after = data[lead + 1]  # a lead byte is never the last
            letter = (after != 0x97) & (after != 0xB7)
            lead, after = lead[letter], after[letter]
            kind[lead] = kind[lead + 1] = _LETTER
            fold[lead + 1] = np.where(after < 0x9F, after + 0x20, after)
        space = kind == 0
        begins = offsets[:-1][offsets[:-1] < len(data)]
        word = ~space
        edge = word.copy()
        edge[1:] &= space[:-1]
        edge[begins] = word[begins]
        start = np.flatnonzero(edge)
        if len(start):
            whole = np.maximum.reduceat(np.where(word, kind, 0), start) == _OTHER
            number = np.cumsum(edge) - 1
            kept = whole[number] & word if whole.any() else None
            inner = edge.copy()
            inner[1:] |= word[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
            if kept is not None:
                inner = np.where(kept, edge, inner)
                np.copyto(fold, data, where=kept)
            start = np.flatnonzero(inner)
            last = word.copy()
            last[:-1] &= space[1:] | inner[1:]
            self.end = np.flatnonzero(last) + 1
            self.letters = (kind[start] == _LETTER) & ~(kept[start] if kept is not None else np.zeros(len(start), dtype=bool))
        else:
            self.end, self.letters = start, np.zeros(0, dtype=bool)
        self.start, self.word, self.fold = start, word, fold
        self.first = rows_of(offsets, start)
        self.hash = hash_runs(fold[word], self.end - self.start)


class Encoder:
    """A tokenizer file whose results are kept by unit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _encode(self, units: list[str], letters: list[bool]) -> list[list[int]]:
        """Ids of each unit.  Runs of letters are encoded many at a time: each ends with its one closing id."""
        out: list = [None] * len(units)
        many = [k for k, x in enumerate(letters) if x]
        rest = [k for k, x in enumerate(letters) if not x]
        groups = [many[a : a + _JOINED] for a in range(0, len(many), _JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([units[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(ends) != len(group) or ends[-1] != len(ids):
                rest += group
                continue
            a = 0
            for k, b in zip(group, ends, strict=True):
                out[k] = ids[a:b]
                a = b
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([units[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _learn(self, hashes: np.ndarray, units: list[str], letters: list[bool]) -> None:
        found = self._encode(units, letters)
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        new = np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(size.sum()))
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(new)] = new
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.used += len(new)

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(hashes), dtype=bool)
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return self.known[at] != hashes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, rows' bounds)."""
        u = Units(data, offsets)
        unique, one, which = np.unique(u.hash, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > _CACHED:
            self._clear()
        missing = self._missing(unique)
        if missing.any():
            raw = u.fold.tobytes()
            at = one[missing]
            units = [raw[a:b].decode() for a, b in zip(u.start[at].tolist(), u.end[at].tolist(), strict=True)]
            self._learn(unique[missing], units, u.letters[at].tolist())
        number = np.searchsorted(self.known, unique)[which]
        size, begin = self.size[number], self.begin[number]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        place = np.arange(total, dtype=np.int64) + np.repeat(begin - (after - size), size)
        bound = np.concatenate([[0], after])[u.first] if len(after) else np.zeros(len(offsets), dtype=np.int64)
        return self.ids[place], bound


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, k long"


def _cut(path: str, capacity: int, end: int):
    """mapInArrow: texts -> pieces, numbered among the pieces of their length in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j, body, off in chunks(data, offsets, _CHUNK):
                ids, bound = tool.encode(body, off)
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                n = np.diff(bound) + 1
                count = -(-n // capacity)
                row = np.repeat(np.arange(j - i), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = nth * capacity
                length = np.minimum(n[row] - start, capacity)
                crc = np.empty(len(row), dtype=np.int64)
                last = (start + length == n[row]).tolist()
                for x, (a, m, whole) in enumerate(zip((bound[row] + start).tolist(), length.tolist(), last, strict=True)):
                    crc[x] = zlib.crc32(tail, zlib.crc32(raw[4 * a : 4 * (a + m - 1)])) if whole else zlib.crc32(raw[4 * a : 4 * (a + m)])
                # k: how many pieces of this length came before in the partition
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                begin = np.searchsorted(ordered, ordered, "left")
                k = np.empty(len(row), dtype=np.int64)
                k[order] = np.arange(len(row)) - begin + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                ids_of = batch.column("doc_id").slice(i, j - i).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [ids_of, *(pa.array(np.asarray(x, dtype=np.int64)) for x in (start, length, crc, n[row])), pa.array(np.full(len(row), part, dtype=np.int32)), pa.array(k)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "k"],
                )

    return run


def fill(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """The multiset of lengths, `seed` included, that minimum bin slack puts into one sequence.

    Largest lengths come first, in bundles of 1, 2, 4, ... copies; the bitset
    before each bundle is what the trace back needs.  The search ends as soon as
    the sequence can be filled exactly.  A sequence that lacks more than a 256th
    takes the largest power of two that can be met exactly instead, as that needs
    no padding.
    """
    room = capacity - seed
    reach, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
    trail: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == seed), room // length)
        bundle = 1
        while left > 0 and not reach & goal:
            take = min(bundle, left)
            trail.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left -= take
            bundle *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    if room - at > capacity // 256:
        power = 1 << capacity.bit_length() - 1
        while power >= seed:
            if power <= capacity and reach >> (power - seed) & 1:
                at = power - seed
                break
            power >>= 1
    used = {seed: 1}
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


PLAN = ("length", "rank", "each", "sequence", "offset")


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """[rows, PLAN]: pieces of `length` from `rank` on go `each` to a sequence, from `sequence` on, at `offset`."""
    left = {k: v for k, v in counts.items() if v > 0}
    given = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        used = fill(left, max(left), capacity)
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, given[length], n, sequence, offset))
            offset += n * length
            given[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, len(PLAN))


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _place(table: np.ndarray):
    """mapInArrow: pieces with their rank -> their sequence and offset."""
    key = table[:, 0] << 48 | table[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(key, length << 48 | rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 3] + nth // row[:, 2]
            offset = row[:, 4] + nth % row[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 2) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    A document is its text's ids by the tokenizer file (one that drops white
    space), then `end`.  One row per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id (from 0), offset (gapless from 0 in a sequence).

    A null or empty text is the one id `end`.  A null doc_id is carried as null.
    Repeated rows are packed each.  Pieces of one length are interchangeable; ties
    go by partition and order of reading.  An empty table gives no rows.  Columns
    beside doc_id and text are not read.
    """
    rows = tables.texts(docs).select("doc_id", "text")
    pieces = tables.keep(rows.transform(tables.mapped, _cut(tokenizer, capacity, end), PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = tables.keep(counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0).cast("long"))), "counts")
    # at most one row per length: `capacity` rows
    histogram = {r.length: r.c for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    table = plan(histogram, capacity)
    ranked = pieces.join(counts.select("length", "part", "before").hint("shuffle_hash"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("k"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").transform(tables.mapped, _place(table), PACKED)


def op8(spark, sf_dir: str) -> DataFrame:
    return stage(spark, tables.load(spark, sf_dir, "documents"), sf_dir)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
