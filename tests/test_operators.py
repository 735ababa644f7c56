"""Operators on hand fixtures and by their invariants."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import graph, metrics, ordering, sampling, scoring, similarity, training, walks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def community(spark, n=24, seed=1):
    """Two groups that point to their own members."""
    r = random.Random(seed)
    rows = {(a, b) for a in range(n) for b in r.sample(range(n), n // 2) if a != b and (a < n // 2) == (b < n // 2)}
    return frame(spark, [(f"n{a:02}", f"n{b:02}") for a, b in rows], "src string, dst string")


def test_metrics_with_ties(spark):
    scored = frame(spark, list(zip([0.9, 0.8, 0.8, 0.4, 0.4, 0.1], [1, 1, 0, 1, 0, 0])), "score double, label int")
    got = metrics.evaluate(scored).first()
    assert round(got.auc, 6) == 0.777778 and round(got.ap, 6) == 0.755556
    assert round(got.f1, 9) == 0.749999993 and round(got.threshold, 6) == 0.11
    assert round(got.pos_mean, 6) == 0.7 and round(got.neg_mean, 6) == 0.433333


def test_one_class(spark):
    scored = frame(spark, [(0.9, 0), (0.2, 0)], "score double, label int")
    got = metrics.evaluate(scored).first()
    assert got.auc is None and got.ap is None and got.f1 == 0 and got.threshold == 0.5
    none = metrics.evaluate(scored.limit(0)).first()
    assert none.auc is None and none.threshold == 0.5


def test_auc_against_all_pairs(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 20) / 20, r.randint(0, 1)) for _ in range(300)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(frame(spark, rows, "score double, label int").repartition(3)).first().auc - want) < 1e-12


def test_grid():
    assert len(scalar.GRID) == 91 and scalar.GRID[0] == 0.05 and scalar.GRID[-1] == 0.9500000000000002


def test_positions_and_totals(spark):
    rows = [(k * 37 % 101, k) for k in range(101)]
    df = frame(spark, rows, "x long, y long").repartition(5)
    assert all(r.x == r.at for r in ordering.positions(df, "at", "x").collect())
    got = {r.x: r.y_before for r in ordering.running_totals(df, ["y"], "x").collect()}
    total = 0
    for x, y in sorted(rows):
        assert got[x] == total
        total += y
    assert ordering.positions(df.limit(0), "at", "x").count() == 0


def test_split_and_negatives(spark):
    edges = community(spark)
    split = sampling.split_edges(edges.repartition(5), 0.1).collect()
    again = sampling.split_edges(edges.repartition(2), 0.1).collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, again))
    assert sum(r.part == "val" for r in split) == max(1, int(len(split) * 0.1)) and len(split) == edges.count()
    coded = graph.encode(edges, graph.index_by_name(edges)).select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"))
    own = {tuple(r) for r in coded.collect()}
    negative = sampling.negatives(spark, coded, 24, 100).collect()
    assert len(negative) == 100 and not {(r.src, r.dst) for r in negative} & own and all(r.src != r.dst for r in negative)


def test_complete_graph_has_no_negatives(spark):
    full = frame(spark, [(a, b) for a in range(4) for b in range(4)], "src long, dst long")
    with pytest.raises(ValueError):
        sampling.negatives(spark, full, 4, 5, rounds=2)


def test_walks_follow_edges(spark):
    edges = community(spark)
    both = graph.both_ways(edges)
    neighbours = graph.neighbour_table(both)
    allowed = {(r.src, r.dst) for r in both.collect()}
    out = walks.random_walks(neighbours, neighbours.select("node").distinct(), 8, 2)
    by = {}
    for r in out.collect():
        by.setdefault(r.walk_id, {})[r.pos] = r.node
    assert len(by) == 48 and all(len(w) == 8 for w in by.values())
    assert all((w[k], w[k + 1]) in allowed for w in by.values() for k in range(7))
    pairs = walks.context_pairs(walks.walk_arrays(out), 5)
    assert pairs.count() == 48 * sum(8 - w for w in range(1, 6))


def test_context_pairs(spark):
    arrays = frame(spark, [("w", [3, 1, 4, 2])], "walk_id string, nodes array<long>")
    assert sorted((r.center, r.context) for r in walks.context_pairs(arrays, 2).collect()) == sorted([(3, 1), (1, 4), (4, 2), (3, 4), (1, 2)])
    alone = frame(spark, [("w", 0, 5)], "walk_id string, pos int, node long")
    assert walks.walk_arrays(alone).count() == 0


def test_dead_ends(spark):
    edges = frame(spark, [("a", "b")], "src string, dst string")
    out = walks.random_walks(graph.neighbour_table(edges), frame(spark, [("a",), ("b",), ("z",)], "node string"), 9)
    assert sorted((r.walk_id, r.pos) for r in out.collect()) == [("a:0", 0), ("a:0", 1), ("b:0", 0), ("z:0", 0)]


def test_prediction_rules(spark):
    bundle = frame(spark, [("x", [1.0], [2.0]), ("y", [0.0], [0.0])], "node string, src_vec array<double>, dst_vec array<double>")
    test = frame(spark, [("1", "x", "y"), ("2", "x", "?"), ("3", "?", "x"), ("4", "x", "x")], "id string, u string, v string")
    got = {r.id: (round(r.prob, 6), r.missing) for r in scoring.predict(test, bundle).collect()}
    assert got == {"1": (0.5, 0), "2": (0.0, 1), "3": (0.0, 1), "4": (0.880797, 0)}
    decided = {r.Id: r.Predictions for r in scoring.decisions(scoring.predict(test, bundle), 0.5).collect()}
    assert decided == {"1": 1, "2": 0, "3": 0, "4": 1}


def test_similarity(spark):
    edges = frame(spark, [("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "z"), ("c", "z")], "src string, dst string")
    got = {(r.u, r.v): round(r.sim, 6) for r in similarity.top_similar(edges).collect()}
    assert got == {("a", "b"): 0.666667, ("b", "a"): 0.666667, ("b", "c"): 0.333333, ("c", "b"): 0.333333}
    peers = similarity.top_similar(edges, 2)
    votes = {(r.u, r.dst): (r.votes, r.peers, r.predicted) for r in similarity.peer_vote(peers, edges).collect()}
    assert votes[("a", "z")] == (1, 1, 1) and votes[("b", "y")] == (1, 2, 0)


def shuffled(spark):
    """Records that all stages so far have written to shuffles."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def most_similar(edges, k, kind):
    out = {}
    for u, dst in edges:
        if u is not None:
            out.setdefault(u, set()).add(dst)
    top = {}
    for u in out:
        found = []
        for v in out:
            if u != v and (common := len((out[u] & out[v]) - {None})):
                by = {"jaccard": len(out[u]) + len(out[v]) - common, "cosine": math.sqrt(len(out[u]) * len(out[v]))}[kind]
                found.append((-common / by, v, common))
        top |= {(u, rank): (v, common, -s) for rank, (s, v, common) in enumerate(sorted(found)[:k], 1)}
    return top


def test_similarity_shuffles_no_pairs(spark):
    r = random.Random(5)
    rows = [(f"c{u}", f"p{dst}") for u in range(300) for dst in r.sample(range(60), 20)]
    edges, before = frame(spark, rows, "src string, dst string"), shuffled(spark)
    got = {(x.u, x["rank"]): (x.v, x.common, x.sim) for x in similarity.top_similar(edges).collect()}
    assert got == most_similar(rows, 5, "jaccard")
    assert 0 < sum(n for stage, n in shuffled(spark).items() if stage not in before) < 300 * 299 / 2


@pytest.mark.parametrize("kind", ["jaccard", "cosine"])
def test_similarity_in_rounds_with_hubs(spark, monkeypatch, kind):
    monkeypatch.setattr(similarity, "LIST", 4)
    monkeypatch.setattr(similarity, "PER_EDGE", 2)
    monkeypatch.setattr(similarity, "LEAST", 1)
    r = random.Random(6)
    rows = [(f"c{u}", f"p{min(r.randrange(30), r.randrange(30))}") for u in range(40) for _ in range(r.randrange(8))]
    rows += [(f"c{u}", "hub") for u in range(60)] + [(None, "p1"), ("c1", None), ("c2", None), ("only", None), ("alone", "q")]
    edges = frame(spark, rows, "src string, dst string")
    top = similarity.top_similar(edges, 4, kind)
    assert {(x.u, x["rank"]): (x.v, x.common, x.sim) for x in top.collect()} == most_similar(rows, 4, kind)
    assert similarity.top_similar(edges.filter("src = '?'")).collect() == []

    peers = {}
    for (u, _), (v, *_) in most_similar(rows, 4, kind).items():
        peers.setdefault(u, []).append(v)
    votes = Counter((u, dst) for u, vs in peers.items() for v in vs for dst in {d for s, d in rows if s == v})
    found = {(x.u, x.dst): (x.votes, x.peers, x.predicted) for x in similarity.peer_vote(top, edges).collect()}
    assert found == {(u, dst): (n, len(peers[u]), int(2 * n > len(peers[u]))) for (u, dst), n in votes.items()}


@pytest.mark.parametrize("least", [1 << 24, 1])
def test_peer_vote_sends_lists(spark, monkeypatch, least):
    monkeypatch.setattr(similarity, "LEAST", least)
    edges = frame(spark, [(f"c{u}", f"p{100 * u + d}") for u in range(40) for d in range(100)], "src string, dst string")
    peers, before = frame(spark, [(f"c{u}", f"c{(u + k) % 40}") for u in range(40) for k in range(1, 6)], "u string, v string"), shuffled(spark)
    assert similarity.peer_vote(peers, edges).filter("votes = 1 AND peers = 5 AND predicted = 0").count() == 5 * 40 * 100
    assert 0 < sum(n for stage, n in shuffled(spark).items() if stage not in before) < 5 * 40 * 100


def test_similarity_shuffles_few_edges_at_once(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LEAST", 1)
    monkeypatch.setattr(similarity, "PER_EDGE", 40)
    r = random.Random(8)
    rows = [(f"c{u}", f"p{dst}") for u in range(300) for dst in r.sample(range(60), 20)]
    edges, before = frame(spark, rows, "src string, dst string"), shuffled(spark)
    got = {(x.u, x["rank"]): (x.v, x.common, x.sim) for x in similarity.top_similar(edges, 5, "cosine").collect()}
    assert got == most_similar(rows, 5, "cosine")
    assert max(n for stage, n in shuffled(spark).items() if stage not in before) < len(rows) / 2


@pytest.mark.parametrize("largest", [1, 255, 256, 70_000, 1 << 40])
def test_lists_as_bytes(largest):
    r = random.Random(9)
    want = [[(r.randrange(largest + 1), r.randrange(300)) for _ in range(n)] for n in (3, 0, 1, 7)] + [[(largest, 299)]]
    wide = (max(1, -(-largest.bit_length() // 8)), 2)
    columns = [["x"] * 5, [1] * 5, [1] * 5, [0] * 5, *([[x[k] for x in own] for own in want] for k in (0, 1))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["dst", "m", "n", "g", "vs", "ds"])
    for start in (0, 2):
        (packed,) = similarity._packed([batch.slice(start)], wide)
        v, d, times = similarity._unpacked(packed.column("list").slice(1), wide)
        assert list(zip(v, d)) == [x for own in want[start + 1 :] for x in own] and list(times) == [len(own) for own in want[start + 1 :]]


def test_gradient_against_differences(spark):
    r = random.Random(4)
    vec = {k: [r.uniform(-1, 1) for _ in range(3)] for k in range(5)}
    pairs = frame(spark, [(0, 1, 1), (1, 2, 0), (3, 3, 1), (4, 0, 0)], "src long, dst long, label int")
    table = lambda v: frame(spark, list(v.items()), "idx long, vec array<double>")
    got = {x.idx: x.grad for x in training.bce_gradient(pairs, table(vec)).collect()}
    for node, d in ((0, 0), (3, 2), (2, 1)):
        loss = []
        for e in (1e-5, -1e-5):
            moved = {k: list(x) for k, x in vec.items()}
            moved[node][d] += e
            loss.append(training.bce_loss(pairs, table(moved)).first().loss)
        assert abs((loss[0] - loss[1]) / 2e-5 - got[node][d]) < 1e-6


def test_training_learns_communities(spark):
    edges = community(spark, 16)
    _, index, history = training.train_bce(edges, training.BceConfig(steps=10, dim=4, rate=0.2, batch=64, ratio=0.1, validate_every=10))
    assert index.count() == 16 and len(history) == 10
    assert history[-1]["loss"] < history[0]["loss"] and history[-1]["auc"] > 0.5


def test_walk_training_learns(spark):
    edges = community(spark, 16)
    config = training.WalkConfig(dim=4, length=6, window=2, walks=1, negatives=2, batch_nodes=16, rate=0.1, epochs=4, ratio=0.1)
    source, target, _, history = training.train_walks(edges, config)
    losses = [h["loss"] for h in history if "loss" in h]
    assert source.count() == target.count() == 16 and losses[-1] < losses[0]


def test_keep_policies(spark):
    history = frame(spark, [(1, 0.5), (2, 0.7), (3, 0.7), (4, 0.1)], "step long, f1 double")
    assert tuple(metrics.keep(history).first()) == (3, 0.7) and tuple(metrics.keep(history, "last").first()) == (4, 0.1)


def test_formatting(spark):
    df = frame(spark, [(1234.5,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(scalar.number_or_na(F.col("x"))).collect()] == ["1,234.5000", "N/A", "N/A"]


def test_resume_and_export(spark, tmp_path):
    from graphloom.plans import export
    from graphloom.sources import bundles, logs

    edges = community(spark, 12)
    at = training.Run(f"{tmp_path}/c", save_every=1, log=f"{tmp_path}/log")
    config = {"dim": 3, "length": 4, "window": 2, "walks": 1, "negatives": 1, "batch_nodes": 12, "ratio": 0.1}
    training.train_walks(edges, training.WalkConfig(epochs=1, **config), at)
    source, _, _, history = training.train_walks(edges, training.WalkConfig(epochs=2, **config), at)
    assert {h["epoch"] for h in history} == {2}
    again, _, _, none = training.train_walks(edges, training.WalkConfig(epochs=2, **config), at)
    assert not none and sorted(map(tuple, again.collect())) == sorted(map(tuple, source.collect()))
    losses, evaluations = logs.plot_frames(spark, f"{tmp_path}/log")
    assert losses.count() == 2 and evaluations.count() == 2
    export.main(["--checkpoint", f"{tmp_path}/c", "--output", f"{tmp_path}/b"])
    table, threshold, meta = bundles.read_bundle(spark, f"{tmp_path}/b")
    assert table.count() == 12 and meta["dim"] == 3 and threshold == meta["metrics"]["threshold"]


def test_resume_single_table(spark, tmp_path):
    edges = community(spark, 12)
    at = training.Run(f"{tmp_path}/c", save_every=1, log=f"{tmp_path}/log")
    config = {"dim": 3, "batch": 16, "ratio": 0.1, "validate_every": 2}
    training.train_bce(edges, training.BceConfig(steps=1, **config), at)
    _, _, history = training.train_bce(edges, training.BceConfig(steps=2, **config), at)
    assert [h["step"] for h in history] == [2] and "auc" in history[0]
