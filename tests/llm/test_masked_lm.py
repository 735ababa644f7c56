"""op4: gradients against differences, probabilities that sum to one, and held-out gain over the unigram model."""

import random

import numpy as np

from graphloom.llm import masked_lm as m
from graphloom.llm.textscan import PLAIN_WORDS, Words, flat

import pyarrow as pa


def vocabulary(seed=0):
    r = np.random.default_rng(seed)
    return m.Vocabulary(np.unique(r.integers(1, 2**62, 500).astype(np.uint64)), np.sort(r.integers(1, 900, 500))[::-1].astype(float), 77)


def test_gradient():
    r = np.random.default_rng(1)
    w = {k: x.astype(np.float64) for k, x in m.start(3).items()}
    net = m.Network(vocabulary(), w)
    around, target = r.integers(0, 40, (30, 2 * m.WINDOW)), r.integers(0, 600, 30)
    around[0, 0] = m.PAD
    grad = net.gradient(around, target)
    loss = lambda: -net.log_likelihood(around, target).sum()
    for name, g in grad.items():
        for place in np.argsort(-np.abs(g).reshape(-1))[:4]:
            at = np.unravel_index(place, g.shape)
            kept = w[name][at]
            w[name][at] = kept + 1e-4
            up = loss()
            w[name][at] = kept - 1e-4
            down = loss()
            w[name][at] = kept
            assert abs((up - down) / 2e-4 - g[at]) < 1e-2 * max(1, abs(g[at]))


def test_probabilities_sum_to_one():
    net = m.Network(vocabulary(), m.start(5))
    around = np.tile(np.array([[3, 9, m.PAD, 70]]), (m.SIZE, 1))
    assert abs(np.exp(net.log_likelihood(around, np.arange(m.SIZE))).sum() - 1) < 1e-4


def test_contexts_stay_in_the_row():
    ids = np.arange(5)
    got = m.contexts(ids, np.array([0, 3, 3, 5]))
    assert got.tolist() == [[m.PAD, m.PAD, 1, 2], [m.PAD, 0, 2, m.PAD], [0, 1, m.PAD, m.PAD], [m.PAD, m.PAD, 4, m.PAD], [m.PAD, 3, m.PAD, m.PAD]]


def texts(n, seed):
    """Words that follow one another in a ring, with some noise."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        at, words = r.randrange(60), []
        for _ in range(80):
            words.append(f"w{at}")
            at = (at + 1) % 60 if r.random() < 0.9 else r.randrange(60)
        out.append(" ".join(words))
    return out


def test_held_out_gain(spark):
    rows = [(i, t, 0) for i, t in enumerate(texts(600, 1))]
    train = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    vocab = m.count_words(train)
    weights = m.train(train, vocab)
    held = spark.createDataFrame([(i, t) for i, t in enumerate(texts(60, 2))], "doc_id long, text string")
    mean = lambda w: np.mean([r.mean_log_likelihood for r in m.score(held, vocab, w).collect()])
    flat_model = {k: np.zeros_like(x) for k, x in weights.items()}
    unigram, learned = mean(flat_model), mean(weights)
    assert abs(unigram + np.log(60)) < 0.3
    assert learned > unigram + 0.8
    # a shuffled text fits worse than the same words in order
    r = random.Random(3)
    mixed = [(i, " ".join(r.sample(t.split(), 80))) for i, t in enumerate(texts(60, 2))]
    worse = np.mean([x.mean_log_likelihood for x in m.score(spark.createDataFrame(mixed, "doc_id long, text string"), vocab, weights).collect()])
    assert worse < learned - 0.5


def test_counts_are_of_all_words(spark):
    rows = [(1, "a b A"), (2, None), (3, ""), (None, "b c."), (3, "b c."), (4, "d " * 5000)]
    vocab = m.count_words(spark.createDataFrame(rows, "doc_id long, text string"))
    data, offsets = flat(pa.array(["d b a c"]))
    order = vocab.ids(Words(data, offsets, PLAIN_WORDS).hash).tolist()
    assert order[:2] == [0, 1] and set(order[2:]) == {2, 3}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (None, "a b"), (4, "a b"), (4, "a b"), (5, "x " * 20_000)]
    out = m.pseudo_likelihood(spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n_tokens string")).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_tokens, r.log_likelihood, r.mean_log_likelihood))
    assert by[1] == by[2] == by[3] == [(0, 0.0, None)]
    assert by[4][0] == by[4][1] == by[None][0] and by[5][0][0] == 20_000
    assert m.pseudo_likelihood(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_that_share_an_id_are_told_apart(spark):
    data, offsets = flat(pa.array([" ".join(f"r{i}" for i in range(1000))]))
    alike = np.flatnonzero(Words(data, offsets, PLAIN_WORDS).hash % np.uint64(m.OTHER) == 0)
    once, twice, three, never = (f"r{i}" for i in alike[:4])
    top = " ".join(f"k{i} " * 4 for i in range(m.KNOWN))
    rows = [(1, top), (2, f"{twice} {twice} {once}"), (3, f"{three} " * 3)]
    vocab = m.count_words(spark.createDataFrame(rows, "doc_id long, text string"))
    zero = {k: np.zeros_like(x) for k, x in m.start().items()}
    mixed = f"{twice} k7 {twice}"
    ask = [(1, once), (2, twice), (3, three), (4, never), (5, "k7"), (6, mixed), (6, mixed), (None, never)]
    got = {}
    for r in m.score(spark.createDataFrame(ask, "doc_id long, text string"), vocab, zero).collect():
        got.setdefault(r.doc_id, []).append(r.log_likelihood)
    total = 4 * m.KNOWN + 6 + 0.5 * m.SIZE
    for i, c in {1: 1, 2: 2, 3: 3, 4: 0.5, None: 0.5, 5: 4.5}.items():
        assert len(got[i]) == 1 and abs(got[i][0] - np.log(c / total)) < 1e-3
    assert len(got[6]) == 2 and got[6][0] == got[6][1] and abs(got[6][0] - 2 * got[2][0] - got[5][0]) < 1e-3
