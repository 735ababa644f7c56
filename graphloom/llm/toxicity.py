"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a text: lexicon words, lexicon words near a
second-person pronoun, capitals, punctuation, obfuscated spellings.  The lexicon
is a short fixed list and the words and word beginnings that the labelled sample
shows in toxic texts and hardly elsewhere.  To learn it and the trees from the
same rows without one flattering the other, the sample is split in two: each half
gets its features from the lexicon of the other half.  Calibration uses margins
of trees trained on the other half, too.

The sample is bounded (`SAMPLE` rows, those with the least hash of their id), so
the model's cost does not grow with the corpus; every document is scored whole,
in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .textscan import PLAIN_WORDS, Words, chunks, flat, mix, signed

_U = np.uint64
#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 24_000
#: Lexicon entries that are learned, at most, and candidates for them that are counted at a time (all are, part by part).
LEARNED, CANDIDATES = 2_000, 50_000
#: A document is rejected from this score on.
REJECT = 0.3
NEAR = 5

# Abusive words, and second-person words of a few languages.
ABUSE = "idiot idiots moron morons clown clowns scum loser losers pathetic worthless trash disgusting stupid dumb fool jerk bastard imbecile garbage vermin hate".split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros vuestro".split()


def hashes(words: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array(words, pa.string()))
    return np.unique(Words(data, offsets, PLAIN_WORDS).hash)


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


class Text:
    """A chunk of texts as features need it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.words = Words(data, offsets, PLAIN_WORDS)
        w = self.words
        size = w.end - w.start
        folded = np.append(PLAIN_WORDS[1][data], np.zeros(8, dtype=np.uint8))
        packed = np.zeros(len(size), dtype=_U)
        for k in range(8):
            packed = packed << _U(8) | np.where(size > k, folded[w.start + k], 0).astype(_U)
        #: keys by kind: the word, and its first 4, 5 and 6 bytes where there are more
        self.kinds = [w.hash] + [np.where(size > p, mix((packed >> _U(8 * (8 - p))) + _U(p << 56)), _U(0)) for p in (4, 5, 6)]

    def per_row(self, flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[first])


@dataclass
class Lexicon:
    fixed: np.ndarray
    second: np.ndarray
    learned: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, dtype=_U)] * 4)


FEATURES = 22


def features(text: Text, lexicon: Lexicon) -> np.ndarray:
    w, data, off = text.words, text.data, text.offsets
    n_bytes, n_words = np.diff(off), np.diff(w.first)
    per_word, per_byte = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
    fixed = _member(lexicon.fixed, w.hash)
    learned = [_member(k, x) for k, x in zip(lexicon.learned, text.kinds, strict=True)]
    stem = learned[1] | learned[2] | learned[3]
    hit = fixed | learned[0] | stem
    second = _member(lexicon.second, w.hash)
    # second-person words within NEAR words, in the same row
    row = np.repeat(np.arange(len(n_words)), n_words)
    total = np.concatenate([[0], np.cumsum(second)])
    place = np.arange(len(hit))
    around = total[np.minimum(place + NEAR + 1, w.first[row + 1])] - total[np.maximum(place - NEAR, w.first[row])] > 0 if len(hit) else hit
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    punct = (data < 128) & ~upper & ~lower & ~digit & (data > 32)
    masks = np.isin(data, np.frombuffer(b"*@$#%&", dtype=np.uint8))
    count = lambda flags: text.per_row(flags, off)
    capitals, letters = count(upper), count(upper | lower)
    caps = np.concatenate([[0], np.cumsum(upper)])
    digits = np.concatenate([[0], np.cumsum(digit)])
    size = w.end - w.start
    shouted = (caps[w.end] - caps[w.start] == size) & (size > 1)
    own_digits = digits[w.end] - digits[w.start]
    mixed = (own_digits > 0) & (own_digits < size)
    # a masking sign between two letters; the same letter three times
    letter = upper | lower | (data >= 128)
    inside = np.zeros(len(data), dtype=bool)
    inside[1:-1] = masks[1:-1] & letter[:-2] & letter[2:]
    tripled = np.zeros(len(data), dtype=bool)
    tripled[2:] = (upper | lower)[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    words = lambda flags: text.per_row(flags, w.first)
    found = words(hit)
    columns = [
        np.log1p(n_words),
        words(fixed) / per_word,
        np.log1p(words(fixed)),
        words(learned[0]) / per_word,
        np.log1p(words(learned[0])),
        words(stem) / per_word,
        np.log1p(words(stem)),
        found / per_word,
        np.log1p(found),
        words(hit & around) / np.maximum(found, 1),
        np.log1p(words(hit & around)),
        words(second) / per_word,
        capitals / np.maximum(letters, 1),
        words(shouted) / per_word,
        count(punct) / per_byte,
        count(data == 33) / per_word,
        count(data == 63) / per_word,
        words(mixed) / per_word,
        count(inside) / per_word,
        count(masks) / per_byte,
        count(tripled) / per_word,
        count(data >= 128) / per_byte,
    ]
    return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)


@dataclass
class Trees:
    """Boosted trees of equal depth: per tree the nodes' feature and threshold in heap order, and the leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = (self.leaf.shape[1]).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (v.shape[0] - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms."""
    n, m = x.shape
    if not n:
        return Trees(0.0, np.zeros((0, 2**depth - 1), dtype=np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    share = min(max((y.sum() + 0.5) / (n + 1), 1e-4), 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    margin, inner, least = np.full(n, base), 2**depth - 1, min(2.0, n / 200)
    trees: list[tuple] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            cut = np.zeros(width, dtype=np.int64)
            total_g, total_h = np.bincount(at, g, width), np.bincount(at, h, width)
            for j in range(m):
                if not len(edges[j]):
                    continue
                k = len(edges[j]) + 1
                slot = at * k + code[:, j]
                gl = np.cumsum(np.bincount(slot, g, width * k).reshape(width, k), axis=1)[:, :-1]
                hl = np.cumsum(np.bincount(slot, h, width * k).reshape(width, k), axis=1)[:, :-1]
                gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (total_g**2 / (total_h + 1))[:, None]
                gain[(hl < least) | (hr < least)] = -1
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better], cut[better] = value[better], top[better]
                feature[first : first + width][better] = j
                threshold[first : first + width][better] = edges[j][top[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        margin += leaf[at]
        trees.append((feature, threshold, leaf))
    return Trees(base, *(np.stack(c) for c in zip(*trees, strict=True)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (margins, ascending probabilities) to interpolate between."""
    if not len(x):
        return np.array([0.0]), np.array([0.0])
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []  # weight, sum of y, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([1.0, b, a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    w, s, m = np.array(blocks).T
    return m / w, s / w


@dataclass
class Model:
    """Without trees (the sample lacks a class) the score is the fixed lexicon's: 1 - 0.8 ** (its words in the text)."""

    lexicon: Lexicon
    trees: Trees | None
    margins: np.ndarray
    chances: np.ndarray

    def score(self, text: Text) -> np.ndarray:
        if self.trees is None:
            return 1 - 0.8 ** text.per_row(_member(self.lexicon.fixed, text.words.hash), text.words.first).astype(np.float64)
        return np.clip(np.interp(self.trees.margin(features(text, self.lexicon)), self.margins, self.chances), 0, 1)


def _keys():
    """mapInArrow: toxic rows -> each key with the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for _, _, part, off in chunks(data, offsets):
                text = Text(part, off)
                h = text.words.hash
                around = np.zeros(len(h), dtype=_U)
                around[1:] += h[:-1]
                around[:-1] += mix(h[1:])
                kind, key, context = [], [], []
                for k, x in enumerate(text.kinds):
                    one = np.unique(np.stack([x, around], axis=1)[x != 0], axis=0)
                    kind.append(np.full(len(one), k, dtype=np.int32))
                    key.append(one[:, 0])
                    context.append(one[:, 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(kind)), *(pa.array(signed(np.ascontiguousarray(np.concatenate(c)))) for c in (key, context))], names=["kind", "key", "context"]
                )

    return run


def _elsewhere(candidates: list[np.ndarray]):
    """mapInArrow: other rows -> how many of them hold each candidate."""

    def run(batches):
        seen = [np.zeros(len(c), dtype=np.int64) for c in candidates]
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for _, _, part, off in chunks(data, offsets):
                text = Text(part, off)
                row = np.repeat(np.arange(len(off) - 1), np.diff(text.words.first))
                for c, x, s in zip(candidates, text.kinds, seen, strict=True):
                    at = np.flatnonzero(_member(c, x))
                    slot = np.searchsorted(c, x[at])
                    s += np.bincount(np.unique(row[at] * max(1, len(c)) + slot) % max(1, len(c)), minlength=len(c))[: len(c)]
        for k, (c, s) in enumerate(zip(candidates, seen, strict=True)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k, dtype=np.int32)), pa.array(signed(c)), pa.array(s)], names=["kind", "key", "other"])

    return run


def _learn(sample: DataFrame, n_toxic: int) -> list[np.ndarray]:
    """Lexicon entries of a sample (toxic int, text): keys in many different surroundings of toxic texts, and in few others.

    Surroundings count, not texts, so that copies of a text bring none of its words in.
    """
    least = max(3, n_toxic // 400)
    keys = sample.filter("toxic = 1").select("text").transform(tables.mapped, _keys(), "kind int, key long, context long")
    found = tables.keep(keys.distinct().groupBy("kind", "key").agg(F.count("*").alias("c")).filter(F.col("c") >= least), "candidates")
    parts = max(1, -(-found.count() // CANDIDATES))
    good: list[tuple[int, tuple[int, int]]] = []
    for part in range(parts):
        inside = {(r.kind, r.key): r.c for r in found.filter(F.pmod(F.xxhash64("kind", "key"), F.lit(parts)) == part).collect()}  # about CANDIDATES rows
        candidates = [np.sort(np.array([key for kind, key in inside if kind == k], dtype=np.int64).view(_U)) for k in range(4)]
        other = sample.filter("toxic = 0").select("text").transform(tables.mapped, _elsewhere(candidates), "kind int, key long, other long")
        outside = {(r.kind, r.key): r.o for r in other.groupBy("kind", "key").agg(F.sum("other").alias("o")).collect()}  # as many
        good = sorted(good + [(-c, k) for k, c in inside.items() if c >= 6 * outside.get(k, 0)])[:LEARNED]
    return [np.sort(np.array([key for _, (kind, key) in good if kind == k], dtype=np.int64).view(_U)) for k in range(4)]


def _features(lexicons: list[Lexicon]):
    """mapInArrow: (fold, toxic, text) -> features by the lexicon that the other half gave."""

    def run(batches):
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            data, offsets = flat(batch.column("text"))
            for i, j, part, off in chunks(data, offsets):
                text = Text(part, off)
                x = np.where((fold[i:j] == 0)[:, None], features(text, lexicons[1]), features(text, lexicons[0]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("fold").slice(i, j - i), batch.column("toxic").slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["fold", "toxic", "x"]
                )

    return run


def remainder(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows outside the held-out remainder."""
    chosen = (
        labels.select(labels["doc_id"].cast("long").alias("id"), labels["toxic"].cast("int").alias("toxic"))
        .filter("id IS NOT NULL AND toxic IN (0, 1)")
        .filter(remainder(F.col("id")) != 2)
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
        .withColumn("fold", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).cast("int"))
    )
    rows = tables.texts(docs)
    # at most `sample` rows of 16 bytes
    labelled = rows.join(F.broadcast(tables.keep(chosen, "labels")), rows["doc_id"] == F.col("id"))
    held = tables.keep(labelled.groupBy("id", "fold", "toxic").agg(F.min("text").alias("text")).drop("id"), "sample")  # at most `sample` rows
    count = {r.fold: r.t for r in held.groupBy("fold").agg(F.sum("toxic").alias("t")).collect()}
    fixed, second = hashes(ABUSE), hashes(SECOND)
    if not 0 < sum(count.values()) < held.count():
        return Model(Lexicon(fixed, second), None, np.zeros(0), np.zeros(0))
    halves = [Lexicon(fixed, second, _learn(held.filter(F.col("fold") == f), count.get(f, 0))) for f in (0, 1)]
    whole = Lexicon(fixed, second, _learn(held, sum(count.values())))
    got = held.transform(tables.mapped, _features(halves), "fold int, toxic int, x array<double>").collect()  # at most `sample` rows
    x = np.array([r.x for r in got], dtype=np.float64).reshape(-1, FEATURES)
    y = np.array([r.toxic for r in got], dtype=np.float64)
    fold = np.array([r.fold for r in got], dtype=np.int64)
    order = np.lexsort((*x.T, y))
    x, y, fold = x[order], y[order], fold[order]
    margin = np.empty(len(y))
    for f in (0, 1):
        margin[fold == f] = boost(x[fold != f], y[fold != f]).margin(x[fold == f])
    return Model(whole, boost(x, y), *isotonic(margin, y))


SCORED = "doc_id long, score double"


def _score(model: Model):
    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j, part, off in chunks(data, offsets):
                score = pa.array(model.score(Text(part, off)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), score], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document row: doc_id, held_out, score (0 to 1) and predicted (1 from a score of 0.3 on).

    Null and empty texts get a score as texts without words.  A null doc_id is
    carried as null and not held out.  Labels with a null id or any value but 0
    and 1 are not used; of several for one id the larger counts, and of several
    texts under a labelled id the least one is learned from.  Without usable
    labels of both values the score is a fixed lexicon's.  Repeated rows score
    alike, and so do texts with equal features; very long texts are scored whole.
    An empty table gives no rows.  Other columns are not read.
    """
    model = fit(docs, labels, sample)
    out = tables.texts(docs).select("doc_id", "text").transform(tables.mapped, _score(model), SCORED)
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def op1(spark, sf_dir: str) -> DataFrame:
    return score(tables.load(spark, sf_dir, "documents"), tables.load(spark, sf_dir, "labels"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns.

    Scores are computed where the row is, so nothing is shuffled.  Null and empty
    texts and null ids are scored like other rows; repeated rows stay or go
    together.  An empty table gives none.
    """
    model = fit(docs, tables.load(spark, sf_dir, "labels"))

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            kept = [model.score(Text(part, off)) < REJECT for _, _, part, off in chunks(data, offsets)]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, dtype=bool)))

    return docs.transform(tables.mapped, run, docs.schema)
