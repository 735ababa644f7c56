"""Substring dedup by suffix automata of reference shards.

The reference of a document is every document with a smaller id, so the shards
cover the whole corpus.  `repeats` deals the corpus to shards by anchors, a
generalised suffix automaton is built over each shard's distinct segments, and
the segments are streamed through it for matching statistics: where the match
ending at a word is long enough, the automaton's state tells the least document
in which that window starts.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats, tables
from .repeats import WORDS
from .textscan import RAW_WORDS, Words, chunks, flat


class SuffixAutomaton:
    """Generalised suffix automaton; every state carries the least label of the strings it occurs in."""

    def __init__(self):
        self.size, self.link, self.to, self.low = [0], [-1], [{}], [repeats.NONE]

    def add(self, string: list, label: int) -> None:
        size, link, to, low = self.size, self.link, self.to, self.low
        last, n = 0, len(size)
        for depth, c in enumerate(string, 1):
            ways = to[last]
            have = ways.get(c)
            if have is None:
                size.append(depth)
                to.append({})
                low.append(repeats.NONE)
                ways[c] = n
                p = link[last]
                while p >= 0 and c not in to[p]:
                    to[p][c] = n
                    p = link[p]
                if p < 0:
                    link.append(0)
                else:
                    q = to[p][c]
                    link.append(q)
                    if size[q] != size[p] + 1:
                        link[n] = self._clone(p, c, q)
                last, n = n, len(size)
            elif size[have] == depth:
                last = have
            else:
                last, n = self._clone(last, c, have), n + 1
            if label < low[last]:
                low[last] = label

    def _clone(self, p: int, c, q: int) -> int:
        size, link, to = self.size, self.link, self.to
        twin = len(size)
        size.append(size[p] + 1)
        link.append(link[q])
        to.append(to[q].copy())
        self.low.append(self.low[q])
        link[q] = twin
        while p >= 0 and to[p].get(c) == q:
            to[p][c] = twin
            p = link[p]
        return twin

    def settle(self) -> None:
        """Carry the labels up the suffix links, longest states first."""
        low, link = self.low, self.link
        for v in np.argsort(-np.array(self.size), kind="stable")[:-1].tolist():
            up = link[v]
            if low[v] < low[up]:
                low[up] = low[v]

    def least(self, string: list, length: int) -> list[int]:
        """For each window of `length` symbols of the string: the least label it occurs under (NONE: nowhere)."""
        size, link, to, low = self.size, self.link, self.to, self.low
        out, v, matched = [], 0, 0
        for i, c in enumerate(string, 1):
            after = to[v].get(c)
            while after is None and v:
                v = link[v]
                matched = size[v]
                after = to[v].get(c)
            if after is not None:
                v = after
                matched += 1
                if matched >= length:
                    # the state that holds the window itself, not the longer match
                    up = link[v]
                    while size[up] >= length:
                        v, matched = up, size[up]
                        up = link[v]
            if i >= length:
                out.append(low[v] if matched >= length else repeats.NONE)
        return out


def verdict(length: int):
    """The least document of each window; of a segment that occurs once, only windows that an earlier document has, too."""

    def run(bodies: list[bytes], n: list[int], low: list[int], nw: list[int]) -> list[repeats.Verdict]:
        size = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
        words = Words(np.frombuffer(b"".join(bodies), dtype=np.uint8), np.concatenate([[0], np.cumsum(size)]), RAW_WORDS)
        symbols = np.unique(words.hash, return_inverse=True)[1].tolist()
        bound = words.first.tolist()
        strings = [symbols[a:b] for a, b in itertools.pairwise(bound)]
        automaton = SuffixAutomaton()
        for s, label in zip(strings, low, strict=True):
            automaton.add(s, label)
        automaton.settle()
        out: list[repeats.Verdict] = []
        for s, count, own in zip(strings, n, low, strict=True):
            runs: repeats.Verdict = []
            for i, least in enumerate(automaton.least(s, length)):
                if count == 1 and least == own:
                    continue
                if runs and runs[-1][2] == least and runs[-1][1] == i - 1:
                    runs[-1] = (runs[-1][0], i, least)
                else:
                    runs.append((i, i, least))
            out.append(runs)
        return out

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _apply(with_kept: bool):
    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            spans = batch.column("spans")
            marked = spans.is_valid().to_numpy(zero_copy_only=False)
            count, removed, digest, kept = [], [], [], []
            for i, j, part, off in chunks(data, offsets):
                raw = part.tobytes()
                for r in range(i, j):
                    words = raw[off[r - i] : off[r - i + 1]].split()
                    count.append(len(words))
                    if marked[r]:
                        gone = repeats.covered(spans[r].as_py(), len(words))
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    removed.append(count[-1] - len(words))
                    rest = b" ".join(words)
                    digest.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest.decode() if with_kept else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def remove_copied_spans(docs: DataFrame, length: int = 13, kept: bool = True) -> DataFrame:
    """Remove every word that a `length`-word window covers which also starts in a document with a smaller doc_id.

    Words are runs of anything but space and \\t-\\r, unchanged; a window lies in
    one document; windows are judged on the input, not on what is left.  One row
    per input row: doc_id, n_words, n_removed, kept_sha256 and, with `kept`, the
    kept words joined by one space.

    A null text has no words; texts below `length` words keep all, very long ones
    are cut into segments like others.  A null doc_id
    counts as larger than every other and is carried as null.  Rows that share a
    doc_id remove nothing from one another.  An empty table gives no rows.
    Columns beside doc_id and text are not read.
    """
    units = repeats.Units(words=True, length=length, gram=max(1, min(WORDS.gram, length)), cells=WORDS.cells, most=WORDS.most, shard=WORDS.shard)
    rows = tables.texts(docs)
    spans = repeats.repeated(rows, units, verdict(length), older=True)
    out = repeats.keyed(rows).join(spans, ["rk", "own"], "left").select("doc_id", "text", "spans").transform(tables.mapped, _apply(kept), RESULT)
    return out if kept else out.drop("kept")


def op5(spark, sf_dir: str) -> DataFrame:
    return remove_copied_spans(tables.load(spark, sf_dir, "documents"), kept=False)


__all__ = ["RAW_WORDS", "SuffixAutomaton", "Words", "remove_copied_spans", "op5"]
