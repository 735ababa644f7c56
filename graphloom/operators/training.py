"""Gradients, optimizer steps and the two training loops.

Vectors are rows (idx, vec array<double>).  A gradient is one aggregation: the
contributions of all pairs to a node are summed by the ML summarizer, map side
first, so a step shuffles one vector per node and partition.  Loops store the
vectors after every step.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bce, dot, log_sigmoid, scaled, sigmoid
from ..sources import bundles, logs, shared
from . import graph, metrics, sampling, scoring, walks


def _gathered(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    return pairs.join(source.select(F.col("idx").alias("src"), F.col("vec").alias("a")), "src").join(target.select(F.col("idx").alias("dst"), F.col("vec").alias("b")), "dst").withColumn("logit", dot(F.col("a"), F.col("b")))


def _sums(parts: DataFrame) -> DataFrame:
    """(idx, grad) of contributions (idx, part)."""
    return parts.withColumn("part", array_to_vector("part")).groupBy("idx").agg(vector_to_array(Summarizer.sum(F.col("part"))).alias("grad"))


def bce_loss(labelled: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row `loss`: mean cross-entropy of (src, dst, label) by symmetric scores."""
    return _gathered(labelled, vectors, vectors).agg(F.avg(bce(F.col("logit"), F.col("label").cast("double"))).alias("loss"))


def bce_gradient(labelled: DataFrame, vectors: DataFrame) -> DataFrame:
    """(idx, grad) of the mean cross-entropy over the pairs whose nodes both have a vector."""
    gathered = _gathered(labelled, vectors, vectors)
    n = gathered.count()
    g = gathered.withColumn("g", (sigmoid(F.col("logit")) - F.col("label")) / F.lit(float(max(n, 1))))
    return _sums(g.select(F.col("src").alias("idx"), scaled(F.col("b"), F.col("g")).alias("part")).unionByName(g.select(F.col("dst").alias("idx"), scaled(F.col("a"), F.col("g")).alias("part"))))


def skipgram_loss(pairs: DataFrame, negative: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """One row `loss`: minus the log-sigmoids of pairs (center, context) and of minus their negatives, per pair."""
    good = _gathered(pairs.select(F.col("center").alias("src"), F.col("context").alias("dst")), source, target)
    bad = _gathered(negative.select(F.col("center").alias("src"), F.col("neg").alias("dst")), source, target)
    terms = good.select(log_sigmoid(F.col("logit")).alias("term"), F.lit(1).alias("one")).unionByName(bad.select(log_sigmoid(-F.col("logit")).alias("term"), F.lit(0).alias("one")))
    return terms.agg((-F.sum("term") / F.nullif(F.sum("one"), F.lit(0))).alias("loss"))


def skipgram_gradient(pairs: DataFrame, negative: DataFrame, source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gradients (idx, grad) of the skip-gram loss for the source and the target vectors."""
    n = float(max(pairs.count(), 1))
    every = pairs.select(F.col("center").alias("src"), F.col("context").alias("dst"), F.lit(1.0).alias("y")).unionByName(negative.select(F.col("center").alias("src"), F.col("neg").alias("dst"), F.lit(0.0).alias("y")))
    g = _gathered(every, source, target).withColumn("g", (sigmoid(F.col("logit")) - F.col("y")) / F.lit(n))
    return _sums(g.select(F.col("src").alias("idx"), scaled(F.col("b"), F.col("g")).alias("part"))), _sums(g.select(F.col("dst").alias("idx"), scaled(F.col("a"), F.col("g")).alias("part")))


def clip_factor(gradient: DataFrame, most: float = 1.0) -> DataFrame:
    """One row (norm, factor): the whole gradient's length, and what brings it to at most `most`."""
    norm = F.sqrt(F.coalesce(F.sum(dot(F.col("grad"), F.col("grad"))), F.lit(0.0)))
    return gradient.agg(norm.alias("norm")).withColumn("factor", F.least(F.lit(1.0), F.lit(most) / (F.col("norm") + F.lit(1e-6))))


def clipped(gradient: DataFrame, most: float = 1.0) -> DataFrame:
    return gradient.crossJoin(F.broadcast(clip_factor(gradient, most))).select("idx", scaled(F.col("grad"), F.col("factor")).alias("grad"))  # one row


def adam(state: DataFrame, gradient: DataFrame, step: int, rate: float, sparse: bool = False, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """State (idx, vec, m, v) after one step.

    Dense: rows without a gradient move by their momentum.  Sparse: they stay as
    they are.
    """
    joined = state.join(gradient, "idx", "left")
    grad = F.coalesce("grad", F.transform("vec", lambda _: F.lit(0.0)))
    m = F.zip_with("m", grad, lambda a, g: a * beta1 + g * (1 - beta1))
    v = F.zip_with("v", grad, lambda a, g: a * beta2 + g * g * (1 - beta2))
    moved = joined.withColumn("hit", F.col("grad").isNotNull()).withColumn("m2", m).withColumn("v2", v)
    c1, c2 = 1 - beta1**step, 1 - beta2**step
    delta = F.zip_with("m2", "v2", lambda a, b: (a / c1) / (F.sqrt(b / c2) + eps) * rate)
    vec = F.zip_with("vec", delta, lambda x, d: x - d)
    if not sparse:
        return moved.select("idx", vec.alias("vec"), F.col("m2").alias("m"), F.col("v2").alias("v"))
    old = lambda new, name: F.when(F.col("hit"), new).otherwise(F.col(name)).alias(name)
    return moved.select("idx", old(vec, "vec"), old(F.col("m2"), "m"), old(F.col("v2"), "v"))


def fresh_state(vectors: DataFrame) -> DataFrame:
    zero = F.transform("vec", lambda _: F.lit(0.0))
    return vectors.select("idx", F.col("vec").cast("array<double>").alias("vec"), zero.alias("m"), zero.alias("v"))


@dataclass(frozen=True)
class BceConfig:
    steps: int = 2000
    dim: int = 128
    rate: float = 0.01
    batch: int = 65_536
    ratio: float = 0.05
    seed: int = 42
    validate_every: int = 100


@dataclass(frozen=True)
class WalkConfig:
    dim: int = 128
    length: int = 20
    window: int = 5
    walks: int = 4
    negatives: int = 5
    batch_nodes: int = 8192
    rate: float = 0.003
    epochs: int = 20
    ratio: float = 0.05
    seed: int = 42

    def record(self) -> dict:
        return asdict(self)


def _prepared(edges: DataFrame, ratio: float, seed: int):
    """Encoded edges split in two, all encoded edges, the node index and its size."""
    index = shared.store(graph.index_by_name(edges), "index")
    encoded = shared.store(graph.encode(edges, index).select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst")), "encoded")
    split = shared.store(sampling.split_edges(encoded, ratio, seed), "parts")
    return split.filter("part = 'train'").select("src", "dst"), split.filter("part = 'val'").select("src", "dst"), encoded, index, index.count()


def validation_pairs(positive: DataFrame, encoded: DataFrame, nodes: int, seed: int) -> DataFrame:
    """Positives and as many negatives: (src, dst, label)."""
    negative = sampling.negatives(positive.sparkSession, encoded, nodes, positive.count(), seed + 1)
    return shared.store(positive.select("src", "dst", F.lit(1).alias("label")).unionByName(negative.select("src", "dst", F.lit(0).alias("label"))), "validation")


def evaluate_vectors(pairs: DataFrame, source: DataFrame, target: DataFrame | None = None) -> DataFrame:
    scored = scoring.logits(pairs, source, target).select(sigmoid(F.col("logit")).alias("score"), "label")
    return metrics.evaluate(shared.store(scored, "scored"))


# The line formats of validation_line, of "Step N/M" and of "Epoch N/M" lines below.
def validation_line(step: int, m: dict, means: bool = False) -> str:
    show = lambda k: "N/A" if m.get(k) is None else f"{m[k]:.4f}"
    line = f"  [VAL] Step {step} | AUC: {show('auc')} | AP: {show('ap')} | F1: {show('f1')} | Threshold: {show('threshold')}"
    return line + f" | Pos/Neg mean: {show('pos_mean')}/{show('neg_mean')}" if means else line


@dataclass(frozen=True)
class Run:
    """Where a training run leaves its checkpoints and its log, and how often it saves.

    A run whose checkpoint exists goes on from there: after the saved step, or
    with the epoch after the saved one.  A finished run trains nothing more.
    """

    checkpoint: str | None = None
    save_every: int = 100
    log: str | None = None
    log_every: int = 1

    def load(self, spark) -> dict | None:
        return bundles.load_checkpoint(spark, self.checkpoint) if self.checkpoint else None

    def save(self, step: int, index: DataFrame, states: dict[str, DataFrame], meta: dict) -> None:
        if self.checkpoint:
            bundles.save_checkpoint(self.checkpoint, step, index, states, meta)

    def write(self, spark, lines: list[str]) -> None:
        if self.log and lines:
            logs.append_log(spark, self.log, lines)


def train_bce(edges: DataFrame, config: BceConfig = BceConfig(), run: Run = Run()) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(vectors, node index, history): one table, symmetric score, dense Adam with clipping and a cosine schedule.

    Training negatives exclude training edges only.  A checkpoint keeps the last
    evaluation.
    """
    spark = edges.sparkSession
    train, val, encoded, index, n = _prepared(edges, config.ratio, config.seed)
    pairs = validation_pairs(val, encoded, n, config.seed)
    ranked, known = sampling.ranked_edges(train, config.seed), shared.store(train.distinct(), "known")
    m = ranked.count()
    size = min(config.batch, m)
    saved = run.load(spark)
    state = saved["state"] if saved else shared.store(fresh_state(sampling.xavier_vectors(index, n, config.dim, config.seed)), "state")
    kept = saved["meta"].get("metrics", {}) if saved else {}
    history, stale = [], [] if saved else [state]
    for step in range(saved["step"] + 1 if saved else 1, config.steps + 1):
        positive = sampling.minibatch(ranked, m, size, step, config.seed).select("src", "dst", F.lit(1).alias("label"))
        negative = sampling._negatives(spark, known, n, size, config.seed * 1000 + step).select("src", "dst", F.lit(0).alias("label"))
        batch = shared.store(positive.unionByName(negative), "batch")
        vectors = state.select("idx", "vec")
        loss = bce_loss(batch, vectors).first().loss
        if loss is None or math.isnan(loss):
            raise RuntimeError(f"the loss is not a number at step {step}")
        rate = 1e-5 + (config.rate - 1e-5) * (1 + math.cos(math.pi * (step - 1) / config.steps)) / 2
        grad = shared.store(bce_gradient(batch, vectors), "gradient")
        state = shared.store(adam(state, clipped(grad), step, rate), "state")
        shared.drop(batch, grad, *stale)
        stale = [state]
        row, lines = {"step": step, "loss": loss}, []
        if step % run.log_every == 0:
            after = 1e-5 + (config.rate - 1e-5) * (1 + math.cos(math.pi * step / config.steps)) / 2
            lines.append(f"Step {step}/{config.steps} | Loss: {loss:.4f} | LR: {after:.6f}")
        if step % config.validate_every == 0 or step == config.steps:
            kept = evaluate_vectors(pairs, state.select("idx", "vec")).first().asDict()
            row |= kept
            lines.append(validation_line(step, kept))
        run.write(spark, lines)
        if step % run.save_every == 0 or step == config.steps:
            run.save(step, index, {"state": state}, {"config": asdict(config), "metrics": kept})
        history.append(row)
    return state.select("idx", "vec"), index, history


def train_walks(edges: DataFrame, config: WalkConfig = WalkConfig(), run: Run = Run()) -> tuple[DataFrame, DataFrame, DataFrame, list[dict]]:
    """(source vectors, target vectors, node index, history): walks on the bidirectional training graph, skip-gram with
    uniform negatives, sparse Adam per batch of start nodes, directional score.

    A checkpoint, written after every epoch, keeps the evaluation of the highest
    F1, the latest of equals, with the step it belongs to.
    """
    spark = edges.sparkSession
    train, val, encoded, index, n = _prepared(edges, config.ratio, config.seed)
    pairs = validation_pairs(val, encoded, n, config.seed)
    hops = walks.hop_tables(shared.store(graph.neighbour_table(graph.both_ways(train)), "neighbours"))
    saved = run.load(spark)
    if saved:
        into, out = saved["source"], saved["target"]
    else:
        into = shared.store(fresh_state(sampling.uniform_vectors(index, config.dim, config.seed)), "state")
        out = shared.store(fresh_state(sampling.uniform_vectors(index, config.dim, config.seed + 1)), "state")
    step, best = (saved["step"], saved["meta"].get("metrics", {})) if saved else (0, {})
    history, stale = [], [] if saved else [into, out]
    for epoch in range(saved["meta"]["epoch"] if saved else 0, config.epochs):
        batches = shared.store(sampling.node_batches(index.select("idx"), config.batch_nodes, epoch, config.seed), "batches")
        for b in range(-(-n // config.batch_nodes)):
            starts = batches.filter(F.col("batch") == b).select(F.col("idx").alias("node"))
            paths = walks.walk_paths(*hops, starts, config.length, config.walks, config.seed * 1000 + epoch)
            found = walks.context_pairs(walks.moved(paths), config.window).withColumn("pair_id", F.concat_ws(":", "walk_id", "pos", "w"))
            positive = shared.store(found.select("pair_id", "center", "context"), "pairs")
            if positive.isEmpty():
                continue
            step += 1
            negative = shared.store(sampling.context_negatives(positive, n, config.negatives, config.seed * 1000 + epoch), "negatives")
            a, c = into.select("idx", "vec"), out.select("idx", "vec")
            loss = skipgram_loss(positive, negative, a, c).first().loss
            grad_in, grad_out = skipgram_gradient(positive, negative, a, c)
            into, out = shared.store(adam(into, grad_in, step, config.rate, sparse=True), "state"), shared.store(adam(out, grad_out, step, config.rate, sparse=True), "state")
            history.append({"epoch": epoch + 1, "step": step, "loss": loss})
            if step % run.log_every == 0:
                run.write(spark, [f"Epoch {epoch + 1}/{config.epochs} | Step {step} | Loss: {loss:.4f} | Pairs: {positive.count()}"])
            shared.drop(positive, negative, *stale)
            stale = [into, out]
        found = evaluate_vectors(pairs, into.select("idx", "vec"), out.select("idx", "vec")).first().asDict() | {"step": step, "epoch": epoch + 1}
        if not best or (found["f1"] or 0) >= (best.get("f1") or 0):
            best = found
        run.write(spark, [validation_line(step, found, means=True)])
        run.save(step, index, {"source": into, "target": out}, {"config": config.record(), "metrics": best, "epoch": epoch + 1})
        history.append(found)
    return into.select("idx", "vec"), out.select("idx", "vec"), index, history
