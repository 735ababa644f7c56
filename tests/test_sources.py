"""Files: ragged adjacency, pairs, bundles, checkpoints, logs."""

import csv

import pytest

from graphloom.operators import graph
from graphloom.sources import adjacency, bundles, logs

HAND = "a,b,c\nd\nb,a\n\na,e,,b\nf,f,\n"


@pytest.fixture
def hand(spark, tmp_path):
    (tmp_path / "train.csv").write_text(HAND)
    return adjacency.read_adjacency(spark, str(tmp_path / "train.csv"))


def test_first_seen_index(hand):
    got = {r.node: r.idx for r in graph.first_seen_index(hand).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "e": 3, "": 4, "d": 5, "f": 6}


def test_edges(hand):
    index = graph.first_seen_index(hand)
    coded = graph.encode(graph.edges_of(hand), index)
    assert sorted((r.src_idx, r.dst_idx) for r in coded.collect()) == sorted([(0, 1), (0, 2), (0, 3), (0, 4), (0, 1), (1, 0), (6, 6), (6, 4)])
    edges = coded.select("src_idx", "dst_idx").toDF("src", "dst")
    counts = graph.edge_counts(edges).first()
    assert (counts.edges, counts.distinct_edges, counts.self_loops) == (8, 7, 1)
    nodes = index.select("idx").withColumnRenamed("idx", "node").selectExpr("node", "node AS idx")
    rows = sorted((r.idx, r.degree, r.offset) for r in graph.csr(edges, nodes).collect())
    assert [r[1] for r in rows] == [6, 3, 1, 1, 2, 0, 3] and [r[2] for r in rows] == [0, 6, 9, 10, 11, 13, 13]
    lists = {r.src: r.nbrs for r in graph.adjacency_lists(graph.both_ways(edges)).collect()}
    assert lists == {0: [1, 1, 1, 2, 3, 4], 1: [0, 0, 0], 2: [0], 3: [0], 4: [0, 6], 6: [4, 6, 6]}
    reach = graph.reachability(graph.degrees(edges, nodes)).first()
    assert (reach.nodes, reach.reachable, reach.average_degree) == (7, 6, 2.666667)


def test_quoted_fields(spark, tmp_path):
    lines = ['"a,b",c', 'd"e,"f""g"h', '"",""","', '"open,x', ",", '"x"y"z",""']
    (tmp_path / "quoted.csv").write_text("\n".join(lines) + "\n")
    got = adjacency.read_adjacency(spark, str(tmp_path / "quoted.csv")).orderBy("line").collect()
    want = [next(csv.reader([x])) for x in lines]
    assert [[r.src, *r.nbrs] for r in got] == want
    adjacency.write_adjacency(spark.createDataFrame([(w[0], w[1:]) for w in want], "src string, nbrs array<string>").coalesce(1), f"{tmp_path}/again")
    again = adjacency.read_adjacency(spark, f"{tmp_path}/again").orderBy("line").collect()
    assert [[r.src, *r.nbrs] for r in again] == want


def test_pairs(spark, tmp_path):
    (tmp_path / "test.csv").write_text("Id,a,b\n1,x,y\n\n02, z,w\n")
    assert [tuple(r) for r in adjacency.read_pairs(spark, str(tmp_path / "test.csv")).collect()] == [("1", "x", "y"), ("02", " z", "w")]
    (tmp_path / "bad.csv").write_text("Id,a,b\n1,x\n")
    with pytest.raises(Exception):
        adjacency.read_pairs(spark, str(tmp_path / "bad.csv")).collect()


def test_prediction_file(spark, tmp_path):
    adjacency.write_predictions(spark.createDataFrame([("1", 0), ("2", 1)], "Id string, Predictions int"), f"{tmp_path}/out", one_file=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes() == b"Id,Predictions\r\n1,0\r\n2,1\r\n"


def table(spark, rows):
    return spark.createDataFrame(rows, "idx long, vec array<double>")


def test_bundle_falls_back_to_merged(spark, tmp_path):
    index = spark.createDataFrame([("x", 0)], "node string, idx long")
    bundles.write_bundle(f"{tmp_path}/one", index, table(spark, [(0, [1.0, 3.0])]))
    rows, threshold, _ = bundles.read_bundle(spark, f"{tmp_path}/one")
    assert threshold == 0.5 and [tuple(r) for r in rows.collect()] == [("x", 0, [1.0, 3.0], [1.0, 3.0])]
    bundles.write_bundle(f"{tmp_path}/two", index, table(spark, [(0, [1.0, 3.0])]), table(spark, [(0, [3.0, 5.0])]), {"threshold": 0.1})
    assert spark.read.parquet(f"{tmp_path}/two/vectors").first().merged_vec == [2.0, 4.0]
    assert bundles.read_bundle(spark, f"{tmp_path}/two")[1] == 0.1
    spark.read.parquet(f"{tmp_path}/two/vectors").select("node", "idx").write.parquet(f"{tmp_path}/none/vectors")
    bundles._write_meta(spark, f"{tmp_path}/none/meta", {})
    with pytest.raises(ValueError):
        bundles.read_bundle(spark, f"{tmp_path}/none")


def test_checkpoints(spark, tmp_path):
    assert bundles.load_checkpoint(spark, f"{tmp_path}/c") is None
    index = spark.createDataFrame([("x", 0)], "node string, idx long")
    for step in (1, 2):
        states = {"source": table(spark, [(0, [float(step)])]), "target": table(spark, [(0, [1.0])])}
        bundles.save_checkpoint(f"{tmp_path}/c", step, index, states, {"config": {"dim": 7}, "metrics": {"threshold": 0.2}})
    found = bundles.load_checkpoint(spark, f"{tmp_path}/c")
    assert sorted(p.name for p in (tmp_path / "c").glob("step=*")) == ["step=2"]  # it rolls
    assert found["step"] == 2 and found["source"].first().vec == [2.0]
    assert bundles.export(spark, f"{tmp_path}/c", f"{tmp_path}/b") == ["the configuration says 7 dimensions, the vectors have 1"]
    assert bundles.read_bundle(spark, f"{tmp_path}/b")[1] == 0.2
    with pytest.raises(FileNotFoundError):
        bundles.export(spark, f"{tmp_path}/nothing", f"{tmp_path}/b2")
    bundles.save_checkpoint(f"{tmp_path}/d", 1, index, {"source": table(spark, [(0, [1.0])])})
    with pytest.raises(KeyError):
        bundles.export(spark, f"{tmp_path}/d", f"{tmp_path}/b3")


def test_logs(spark, tmp_path):
    path = f"{tmp_path}/log"
    logs.append_log(spark, path, ["Epoch 1/20 | Step 10 | Loss: 4.1000 | Pairs: 99", "Step 5/2000 | Loss: 0.6931 | LR: 0.009"])
    lines = logs.read_log(spark, path)
    assert [(r.Step, r.Loss) for r in logs.training_rows(lines).collect()] == [(10, 4.1)]
    assert [(r.Step, r.Loss) for r in logs.training_rows(lines, logs.TRAIN_SINGLE).collect()] == [(5, 0.6931)]
    more = spark.createDataFrame([(0, "  [VAL] Step 100 | AUC: 0.5 | AP: 0.6 | F1: 0.7 | Threshold: 0.5"), (1, "  [VAL] Step 200 | AUC: nan | AP: 0.6 | F1: 0.7")], "line long, value string")
    assert [tuple(r) for r in logs.validation_rows(more).collect()] == [(0, 100, 0.5, 0.6, 0.7)]
    loss = spark.createDataFrame([(k, 1.5 * k) for k in range(8)], "line long, Loss double")
    assert [r.trend for r in logs.rolling_loss(loss).orderBy("line").collect()] == [None] * 4 + [3.0, 4.5, 6.0, 7.5]
