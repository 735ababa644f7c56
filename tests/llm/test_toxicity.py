"""op1: held-out accuracy on planted abuse in two invented languages, calibration, and odd rows."""

import random
import zlib

import numpy as np

from graphloom.llm import toxicity

DOCS = "doc_id long, text string, score string, toxic int"


def corpus(n, seed):
    r = random.Random(seed)
    stem = lambda: "".join(r.choice("abdeginorstu") for _ in range(r.randint(2, 5)))
    vocabulary = [stem() for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        toxic = int(r.random() < 0.2)
        for _ in range(r.randint(2, 6) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["idiot", "Moron!"]) if i % 2 else "quazz" + stem()
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(3),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_held_out(spark):
    docs, labels = corpus(1600, 1)
    out = {r.doc_id: r for r in toxicity.score(*frames(spark, docs, labels)).collect()}
    assert len(out) == 1600
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [(out[i].predicted, t, out[i].score) for i, t in labels if out[i].held_out]
    assert np.mean([p == t for p, t, _ in held]) > 0.95
    assert np.mean([(s - t) ** 2 for _, t, s in held]) < 0.05


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = corpus(300, 2)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    first, second = ({r.doc_id: r.score for r in toxicity.score(*frames(spark, docs, x)).collect()} for x in (labels, turned))
    assert first == second


def test_odd_rows(spark):
    docs, labels = corpus(200, 3)
    docs += [(None, "idiot"), (900, None), (901, ""), (902, "!!!"), (5, docs[5][1]), (903, "é" * 50_000), (904, "you idiot " * 20_000)]
    labels += [(None, 1), (900, 1), (901, None), (902, 7), (5, 0)]
    out = toxicity.score(*frames(spark, docs, labels)).collect()
    assert len(out) == len(docs) and all(r.score is not None for r in out)
    assert {r.held_out for r in out if r.doc_id is None} == {False}
    same = [r.score for r in out if r.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1]


def test_empty(spark):
    d, lab = frames(spark, [], [])
    assert toxicity.score(d, lab).count() == 0
    d, _ = frames(spark, [(1, "a")], [])
    assert [r.score for r in toxicity.score(d, lab).collect()] == [0.0]


def test_isotonic_ascends():
    r = np.random.default_rng(1)
    x = r.normal(size=500)
    y = (r.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    at, chance = toxicity.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(chance) > 0).all()
    assert abs(np.interp(x, at, chance).mean() - y.mean()) < 0.02


def test_stage(spark, tmp_path):
    docs, labels = corpus(400, 4)
    d, lab = frames(spark, docs, labels)
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.stage(spark, d, str(tmp_path))
    assert out.columns == d.columns
    kept = {r.doc_id for r in out.collect()}
    toxic = {i for i, t in labels if t}
    assert len(kept & toxic) < 0.25 * len(toxic) and len(kept - toxic) > 0.97 * (400 - len(toxic))
