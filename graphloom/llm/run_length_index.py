"""Suffix-array dedup by a run-length index.

`RunLengthIndex` builds the suffix array of one shard of segments, keeps the
Burrows-Wheeler transform by its runs only, and samples the suffix at both ends
of every run with the length of its match to the neighbour across the run's
edge.  Between two samples a suffix's match is one byte shorter than its left
neighbour's (the reducible part of the permuted LCP array), so matching
statistics stream from the samples in one pass and memory follows the number of
runs, which is small where the corpus repeats itself.

`remove_repeats` applies it to a corpus through `repeats`, whose anchors bring
every pair of equal windows into one shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, tables
from .repeats import BYTES
from .textscan import flat

_BITS = 21


class RunLengthIndex:
    """Index of byte strings that never match across their ends.

    All strings with one end mark each must hold fewer than 2**21 symbols.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.begin = np.zeros(len(strings) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=self.begin[1:])
        n = int(self.begin[-1])
        if n >= 1 << _BITS:
            raise ValueError(f"{n} symbols in one shard")
        code = np.empty(n, dtype=np.int64)
        body = np.ones(n, dtype=bool)
        body[self.begin[1:] - 1] = False
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        used, dense = np.unique(data, return_inverse=True)
        code[body] = dense + len(strings)
        code[~body] = np.arange(len(strings))  # an end mark is unlike any other symbol
        self.used = used
        self._sort(code, len(strings) + len(used))
        self._sample(code)

    def _sort(self, code: np.ndarray, symbols: int) -> None:
        n = len(code)
        each = max(1, (symbols - 1).bit_length())
        self.step = max(1, (2 * _BITS) // each)
        key = np.zeros(n, dtype=np.int64)
        for t in range(self.step):
            key <<= each
            key[: max(0, n - t)] += code[t:]
        self.ranks: list[tuple[int, np.ndarray]] = []
        h, place = self.step, np.arange(n, dtype=np.int64)
        while True:
            key <<= _BITS
            key |= place
            key.sort()
            order = key & ((1 << _BITS) - 1)
            key >>= _BITS
            rank = np.zeros(n, dtype=np.int64)
            rank[1:] = np.cumsum(key[1:] != key[:-1])
            by_place = np.empty(n, dtype=np.int64)
            by_place[order] = rank
            self.ranks.append((h, by_place.astype(np.int32)))
            if n == 0 or rank[-1] == n - 1:
                self.suffixes = order
                return
            key = by_place << _BITS
            key[: max(0, n - h)] |= by_place[h:]
            h *= 2

    def _common(self, a: np.ndarray, b: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b (a != b)."""
        n, length = len(code), np.zeros(len(a), dtype=np.int64)
        for h, rank in reversed(self.ranks):
            x, y = a + length, b + length
            inside = np.maximum(x, y) < n
            length += h * (inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
        for _ in range(self.step - 1):
            x, y = a + length, b + length
            inside = np.maximum(x, y) < n
            length += inside & (code[np.minimum(x, n - 1)] == code[np.minimum(y, n - 1)])
        return length

    def _sample(self, code: np.ndarray) -> None:
        sa = self.suffixes
        before = code[sa - 1]
        edge = np.flatnonzero(before[1:] != before[:-1])  # between j and j + 1
        self.runs = len(edge) + 1 if len(sa) else 0
        shared = self._common(sa[edge], sa[edge + 1], code)
        #: run ends with the match across the edge, and run starts likewise
        self.samples = np.concatenate([sa[edge], sa[edge + 1]])
        self.lengths = np.concatenate([shared, shared])
        #: the transform: each run's symbol and first place, the place after the last run, and each symbol's first suffix
        begin = np.append(0, edge + 1)[: self.runs]
        self.heads, self.starts = before[begin], np.append(begin, len(sa))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.begin) - 1 + len(self.used)))])
        del self.ranks, self.suffixes

    def _rank(self, symbol: int, place: int) -> int:
        """How often the symbol stands in the transform before this place."""
        own = np.flatnonzero(self.heads == symbol)
        return int(np.clip(place - self.starts[own], 0, self.starts[own + 1] - self.starts[own]).sum())

    def count(self, pattern: bytes) -> int:
        """Occurrences of a pattern, by backward search over the runs."""
        low, high = 0, int(self.begin[-1])
        for byte in reversed(pattern):
            at = int(np.searchsorted(self.used, byte))
            if at == len(self.used) or self.used[at] != byte:
                return 0
            symbol = at + len(self.begin) - 1
            low, high = (int(self.first[symbol]) + self._rank(symbol, x) for x in (low, high))
            if low >= high:
                return 0
        return high - low

    def text(self) -> bytes:
        """The indexed text, read back from the runs; end marks are spaces."""
        place = self.starts[:-1]
        step = np.empty(int(self.begin[-1]), dtype=np.int64)  # from a suffix to the one that begins a symbol before
        order = np.lexsort((place, self.heads))
        size = np.diff(self.starts)[order]
        step[np.repeat(place[order] - np.cumsum(size) + size, size) + np.arange(len(step))] = np.arange(len(step))
        marks = len(self.begin) - 1
        out, row = bytearray(len(step)), int(self.first[marks - 1]) if marks else 0  # the last end mark's suffix
        for k in range(len(step) - 1, -1, -1):
            symbol = int(np.searchsorted(self.first, row, "right")) - 1
            out[k] = 32 if symbol < marks else int(self.used[symbol - marks])
            row = int(step[row])
        return bytes(out)

    def statistics(self) -> np.ndarray:
        """For each place of the indexed text: length of its longest match with any other place."""
        n = int(self.begin[-1])
        reach = np.zeros(n, dtype=np.int64)
        np.maximum.at(reach, self.samples, self.samples + self.lengths)
        reach = np.maximum.accumulate(reach)
        return np.maximum(reach - np.arange(n), 0)


def verdict(length: int):
    """Which windows of each segment are found elsewhere in the shard, or occur more than once as the segment does."""

    def run(bodies: list[bytes], n: list[int], low: list[int], nw: list[int]) -> list[repeats.Verdict]:
        index = RunLengthIndex(bodies)
        long = index.statistics() >= length
        out: list[repeats.Verdict] = []
        for b, c, w in zip(index.begin, n, nw, strict=False):
            if c > 1:
                out.append([(0, w - 1, 0)])
                continue
            edge = np.flatnonzero(np.diff(long[b : b + w].astype(np.int8), prepend=0, append=0))
            out.append([(int(x), int(y) - 1, 0) for x, y in zip(edge[::2], edge[1::2], strict=True)])
        return out

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _apply(with_kept: bool):
    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            spans = batch.column("spans")
            out: list[tuple] = []
            whole = data.data if len(data) else b""
            for r in range(batch.num_rows):
                lo, hi = offsets[r], offsets[r + 1]
                found = spans[r].as_py()
                if not found:
                    out.append((0, 0, hashlib.sha256(whole[lo:hi]).hexdigest(), bytes(whole[lo:hi]) if with_kept else None))
                    continue
                gone = repeats.covered(found, hi - lo)
                rest = data[lo:hi][~gone].tobytes()
                runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((int(gone.sum()), runs, hashlib.sha256(rest).hexdigest(), rest if with_kept else None))
            removed, runs, digest, rest = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(rest, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def _units(length: int) -> repeats.Units:
    """A group's segments, each below 2 * length bytes, always fit in one index."""
    most = min(BYTES.most, ((1 << _BITS) - 1) // (2 * length + 1))
    return repeats.Units(words=False, length=length, gram=max(1, min(BYTES.gram, length // 2)), cells=BYTES.cells if length > 100 else (1,), most=most, shard=BYTES.shard)


def remove_repeats(docs: DataFrame, length: int = 400, kept: bool = True) -> DataFrame:
    """Remove every byte that a `length`-byte string covers which also starts anywhere else in the corpus.

    Texts are their UTF-8 bytes; a match never crosses documents, repeats in one
    document and overlapping ones count, and windows are judged on the input.
    One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and, with `kept`, the remaining bytes.

    A null text is empty.  Empty and short texts (below `length`) keep all; very
    long ones are cut into segments like others.  A
    null doc_id is carried as null.  Repeated rows are repeats of one another.
    An empty table gives no rows.  Columns beside doc_id and text are not read.
    """
    rows = tables.texts(docs)
    spans = repeats.repeated(rows, _units(length), verdict(length), older=False)
    joined = repeats.keyed(rows).join(spans, ["rk", "own"], "left").select("doc_id", "text", "spans")
    out = joined.transform(tables.mapped, _apply(kept), RESULT)
    return out if kept else out.drop("kept")


def op9(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(tables.load(spark, sf_dir, "documents"), kept=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated bytes; a document of which nothing is left goes.

    A span may begin or end within a character; the broken character goes too.
    Rows without repeated bytes stay as they are, null and empty texts, null ids
    and other columns included; repeated rows of 400 bytes or more are repeats of
    one another and go.  An n_chars column, if there is one, follows the text.  An
    empty table gives none.
    """
    columns = docs.columns
    rk, own, spans = tables.free(docs, "rk", "own", "spans")
    found = repeats.repeated(tables.texts(docs), BYTES, verdict(BYTES.length), older=False)
    wide = docs.withColumns({rk: tables.row_key(docs), own: F.coalesce(docs["doc_id"].cast("long"), F.lit(int(repeats.NONE)))})
    joined = wide.join(found.select(F.col("rk").alias(rk), F.col("own").alias(own), F.col("spans").alias(spans)), [rk, own], "left").select(*columns, spans)
    cut = joined.transform(tables.mapped, _cut(spans), joined.schema)
    kept = cut.filter((F.col("text") != "") | F.col("text").isNull() | F.col(spans).isNull())
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return kept.select(columns)


def _cut(name: str):
    def run(batches):
        for batch in batches:
            at, column = batch.schema.get_field_index("text"), batch.column("text")
            spans = batch.column(name)
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                rows = column.to_pylist()
                for r in hit.tolist():
                    raw = np.frombuffer((rows[r] or "").encode(), dtype=np.uint8)
                    rows[r] = raw[~repeats.covered(spans[r].as_py(), len(raw))].tobytes().decode("utf-8", "ignore")
                column = pa.array(rows, type=column.type)
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return run
