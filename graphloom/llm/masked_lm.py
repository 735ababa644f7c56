"""LM scoring by masked pseudo-likelihood.

A bidirectional window network predicts every word from the words on both its
sides; the sum of a document's conditional log-probabilities is its score.

* The vocabulary is every word of all documents, with its count.  The `KNOWN`
  most frequent words have ids in order of frequency; the others are dealt by
  hash to `OTHER` classes, which have an id each, and a word's probability is
  its class's times its count's share of the class.  The counts of all words are
  a table that grows with the corpus and is joined by hash, never held.
* An id has three base-16 digits, and its probability is the product of three
  softmaxes over 16 digits, each given the digits before it.  The digits'
  biases are the corpus's own log-frequencies, so the network starts as the
  unigram model and learns what the context adds.
* Training covers every word of the corpus: each partition trains on its own
  rows from the same start (AdaGrad, in NumPy), and the weights are averaged in
  a tree of partial sums, each weighted by its words.  What is gathered grows
  with the partitions; what a task or the driver holds is one model of fixed
  size (about 0.4 MB).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .textscan import PLAIN_WORDS, Words, chunks, flat, signed

_U = np.uint64
DIGIT, DIM, WINDOW = 16, 24, 2
SIZE = DIGIT**3
OTHER = 64
KNOWN = SIZE - OTHER
PAD = SIZE
BATCH, RATE, SUMMED = 2048, 0.1, 32

Weights = dict[str, np.ndarray]
SHAPES = {"word": (SIZE + 1, DIM), "side": (2 * WINDOW, DIM), "out1": (DIM, DIGIT), "out2": (DIM, DIGIT), "out3": (DIM, DIGIT), "gate2": (DIGIT, DIM), "gate3": (DIGIT, DIM)}


def start(seed: int = 1) -> Weights:
    r = np.random.default_rng(seed)
    w = {k: r.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    w["side"] += 1
    w["gate2"] += 1
    w["gate3"] += 1
    w["word"][PAD] = 0
    return w


def pack(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in SHAPES])


def unpack(flat_weights: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        out[k] = flat_weights[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


class Vocabulary:
    """The known words by hash, in order of frequency, and the digits' log-frequencies.

    `rest` counts the other words, as one number or by class.  `table` (hash, c)
    has the counts of all words; it stays with the driver.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rest: int | np.ndarray, table: DataFrame | None = None):
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], order.astype(np.int64)
        full = np.full(SIZE, 0.5)
        full[: len(counts)] += counts
        full[KNOWN:] += rest if np.ndim(rest) else rest / OTHER
        self.classes, self.table = full[KNOWN:].copy(), table
        cube = full.reshape(DIGIT, DIGIT, DIGIT)
        norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True)).astype(np.float32)
        self.bias1, self.bias2, self.bias3 = norm(cube.sum(axis=(1, 2))), norm(cube.sum(axis=2)), norm(cube).reshape(-1, DIGIT)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "table": None}

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        other = KNOWN + (hashes % _U(OTHER)).astype(np.int64)
        if not len(self.sorted):
            return other
        at = np.searchsorted(self.sorted, hashes)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == hashes, self.number[at], other)


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[words, 2 * WINDOW] ids of the neighbours in the same row, PAD beyond its ends."""
    n = len(ids)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low, high, place = first[row], first[row + 1], np.arange(n)
    out = np.full((n, 2 * WINDOW), PAD, dtype=np.int64)
    for k, o in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        at = place + o
        inside = (at >= low) & (at < high)
        out[inside, k] = ids[at[inside]]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    top = x
    while (half := top.shape[1] // 2):  # DIGIT is a power of two; max(axis=1) takes three times as long on short rows
        top = np.maximum(top[:, :half], top[:, half:])
    x -= top
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


class Network:
    def __init__(self, vocabulary: Vocabulary, weights: Weights):
        self.v, self.w = vocabulary, weights

    def _forward(self, around: np.ndarray, target: np.ndarray):
        w, v = self.w, self.v
        near = w["word"].take(around, axis=0)  # [n, 2 * WINDOW, DIM]
        h = np.tanh(np.einsum("nkd,kd->nd", near, w["side"]))
        a, b, c = target >> 8, target >> 4 & 15, target & 15
        g2, g3 = w["gate2"][a], w["gate3"][a]
        p1 = _softmax(h @ w["out1"] + v.bias1)
        p2 = _softmax((h * g2) @ w["out2"] + v.bias2[a])
        p3 = _softmax((h * g3) @ w["out3"] + v.bias3[target >> 4])
        return near, h, (a, b, c), (g2, g3), (p1, p2, p3)

    def log_likelihood(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        for s in range(0, len(target), BATCH):
            _, _, digits, _, p = self._forward(around[s : s + BATCH], target[s : s + BATCH])
            row = np.arange(len(digits[0]))
            out[s : s + BATCH] = sum(np.log(np.maximum(q[row, d], 1e-30), dtype=np.float64) for q, d in zip(p, digits, strict=True))
        return out

    def gradient(self, around: np.ndarray, target: np.ndarray) -> Weights:
        """Of the summed negative log-likelihood."""
        w = self.w
        near, h, (a, b, c), (g2, g3), (p1, p2, p3) = self._forward(around, target)
        row = np.arange(len(target))
        for p, d in ((p1, a), (p2, b), (p3, c)):
            p[row, d] -= 1
        h2, h3 = h * g2, h * g3
        back2, back3 = p2 @ w["out2"].T, p3 @ w["out3"].T
        one = np.zeros((len(target), DIGIT), dtype=np.float32)
        one[row, a] = 1
        dh = (p1 @ w["out1"].T + back2 * g2 + back3 * g3) * (1 - h * h)
        grad = {"out1": h.T @ p1, "out2": h2.T @ p2, "out3": h3.T @ p3, "gate2": one.T @ (back2 * h), "gate3": one.T @ (back3 * h), "side": np.einsum("nkd,nd->kd", near, dh)}
        word = np.zeros(SHAPES["word"], dtype=np.float32)
        flat_ids = around.T.reshape(-1).astype(np.uint16)  # PAD fits; sorted by radix
        order = np.argsort(flat_ids, kind="stable")
        sorted_ids = flat_ids[order]
        begin = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
        part = np.concatenate([dh * w["side"][k] for k in range(2 * WINDOW)])
        word[sorted_ids[begin]] = np.add.reduceat(part[order], begin, axis=0)
        word[PAD] = 0
        grad["word"] = word
        return grad


class Trainer:
    """AdaGrad over the words of one partition."""

    def __init__(self, vocabulary: Vocabulary, weights: Weights):
        self.network = Network(vocabulary, {k: x.copy() for k, x in weights.items()})
        self.square = {k: np.full_like(x, 1e-9 if k == "word" else 1e-6) for k, x in weights.items()}
        self.words = 0

    def learn(self, around: np.ndarray, target: np.ndarray) -> None:
        order = np.random.default_rng(len(target)).permutation(len(target))
        batch = min(BATCH, max(128, len(target) // 64))
        for s in range(0, len(target), batch):
            at = order[s : s + batch]
            for k, g in self.network.gradient(around[at], target[at]).items():
                g /= len(at)
                self.square[k] += g * g
                self.network.w[k] -= RATE * g / np.sqrt(self.square[k])
        self.words += len(target)


def _count():
    """mapInArrow: texts -> (hash, c), once per word of the partition as far as memory allows."""
    most = 2_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            unique, which = np.unique(h, return_inverse=True)
            return unique, np.bincount(which, n, len(unique)).astype(np.int64)

        held = 0
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for _, _, part, off in chunks(data, offsets):
                parts.append(np.unique(Words(part, off, PLAIN_WORDS).hash, return_counts=True))
                held += len(parts[-1][0])
                if held > most:
                    parts = [merged()]
                    held = len(parts[0][0])
                    if held > most // 2:
                        yield _row(parts.pop())
                        held = 0
        if parts:
            yield _row(merged())

    def _row(part):
        return pa.RecordBatch.from_arrays([pa.array(signed(part[0])), pa.array(part[1])], names=["hash", "c"])

    return run


def count_words(docs: DataFrame) -> Vocabulary:
    """The vocabulary, from all words of all documents."""
    counts = tables.keep(tables.texts(docs).select("text").transform(tables.mapped, _count(), "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c")), "counts")
    top = counts.orderBy(F.desc("c"), "hash").limit(KNOWN).collect()  # at most KNOWN rows
    sums = counts.groupBy(F.col("hash").bitwiseAND(OTHER - 1).alias("k")).agg(F.sum("c").alias("c")).collect()  # at most OTHER rows
    hashes = np.array([r.hash for r in top], dtype=np.int64).view(_U)
    number = np.array([r.c for r in top], dtype=np.float64)
    rest = np.zeros(OTHER)
    rest[[r.k for r in sums]] = [r.c for r in sums]
    np.subtract.at(rest, (hashes % _U(OTHER)).astype(np.int64), number)
    return Vocabulary(hashes, number, rest, counts)


def _words(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary):
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for i, j, part, off in chunks(data, offsets):
            w = Words(part, off, PLAIN_WORDS)
            ids = vocabulary.ids(w.hash)
            yield batch, i, j, w, ids


def _train(vocabulary: Vocabulary, weights: Weights):
    """mapInArrow: texts -> this partition's weights, times its words."""

    def run(batches):
        trainer = Trainer(vocabulary, weights)
        for _, _, _, w, ids in _words(batches, vocabulary):
            if len(ids):
                trainer.learn(contexts(ids, w.first), ids)
        if trainer.words:
            yield _sum_row(trainer.words, pack(trainer.network.w).astype(np.float64) * trainer.words)

    return run


def _sum_row(words: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([values.tobytes()], pa.binary())], names=["words", "weights"])


def _add(batches):
    words, total = 0, None
    for batch in batches:
        for n, raw in zip(batch.column("words").to_pylist(), batch.column("weights"), strict=True):
            values = np.frombuffer(raw.as_buffer(), dtype=np.float64)
            words, total = words + n, values.copy() if total is None else np.add(total, values, out=total)
    if total is not None:
        yield _sum_row(words, total)


def train(docs: DataFrame, vocabulary: Vocabulary, weights: Weights | None = None) -> Weights:
    """One pass over all words: local training in every partition, then a tree of sums of at most SUMMED models a task."""
    weights = weights or start()
    rows = tables.texts(docs).select("text")
    sums = tables.keep(rows.transform(tables.mapped, _train(vocabulary, weights), "words long, weights binary"), "weights")
    n = sums.count()
    while n > 1:
        parts = -(-n // SUMMED)
        shared = sums.repartition(parts) if n > SUMMED else sums.coalesce(1)
        above = tables.keep(shared.transform(tables.mapped, _add, "words long, weights binary"), "weights")
        tables.drop(sums)
        sums, before, n = above, n, above.count()
        if n >= before:
            raise RuntimeError("sums do not get fewer")
    last = sums.collect()  # one model
    return unpack(np.frombuffer(bytes(last[0].weights), dtype=np.float64) / last[0].words) if last else weights


SCORED = "doc_id long, n_tokens long, own double, rare array<struct<hash: long, n: long>>"
#: The count that words outside the vocabulary have together in a class.
UNSEEN = 0.5


def _rare(w: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows' bounds, hash, occurrences) of each row's distinct words that share an id."""
    at = np.flatnonzero(ids >= KNOWN)
    row, h = np.searchsorted(w.first, at, "right") - 1, w.hash[at]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[: len(h)])
    return np.searchsorted(row[begin], np.arange(len(w.first))), h[begin], np.diff(np.append(begin, len(h)))


def _score(vocabulary: Vocabulary, weights: Weights):
    """mapInArrow: texts -> SCORED; `own` takes each word of a class for one outside the vocabulary."""
    share = np.zeros(SIZE)
    share[KNOWN:] = np.log(UNSEEN / vocabulary.classes)

    def run(batches):
        network = Network(vocabulary, weights)
        for batch, i, j, w, ids in _words(batches, vocabulary):
            first, total = w.first, np.zeros(len(ids) + 1)
            if len(ids):
                np.cumsum(network.log_likelihood(contexts(ids, first), ids) + share[ids], out=total[1:])
            bound, h, n = _rare(w, ids)
            words = pa.StructArray.from_arrays([pa.array(signed(h)), pa.array(n)], ["hash", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]]), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), words)],
                names=["doc_id", "n_tokens", "own", "rare"],
            )

    return run


def score(docs: DataFrame, vocabulary: Vocabulary, weights: Weights) -> DataFrame:
    """One row per input row: doc_id, n_tokens, log_likelihood (summed over all words) and its mean.

    Null, empty and wordless texts have no tokens, a sum of 0 and a null mean.  A
    null doc_id is carried as null; repeated rows score alike, very long texts are
    scored whole, equally frequent words are ranked by hash.  An empty table
    gives no rows.  Columns beside doc_id and text are not read.

    Words outside the vocabulary count as one word, seen `UNSEEN` times in each class.
    """
    scored = tables.texts(docs).select("doc_id", "text").transform(tables.mapped, _score(vocabulary, weights), SCORED)
    log_likelihood = F.col("own")
    if vocabulary.table is not None:
        scored = tables.keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        words = scored.select("row", F.inline("rare")).join(vocabulary.table, "hash")
        shares = words.groupBy("row").agg(F.sum(F.col("n") * F.log(F.col("c") / UNSEEN)).alias("shares"))
        scored = scored.join(shares, "row", "left")
        log_likelihood += F.coalesce("shares", F.lit(0.0))
    scored = scored.select("doc_id", "n_tokens", F.round(log_likelihood, 6).alias("log_likelihood"))
    mean = F.when(F.col("n_tokens") > 0, F.round(F.col("log_likelihood") / F.col("n_tokens"), 6))
    return scored.withColumn("mean_log_likelihood", mean)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on all of `docs`, then score them."""
    vocabulary = count_words(docs)
    return score(docs, vocabulary, train(docs, vocabulary))


def op4(spark, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(tables.load(spark, sf_dir, "documents"))
