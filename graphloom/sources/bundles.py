"""Vector bundles and checkpoints as Parquet tables with a metadata row.

A bundle directory holds `vectors` (node, idx, src_vec, dst_vec, merged_vec) and
`meta` (one JSON row).  A checkpoint directory holds a `step=N` directory
and `latest`, a table of save numbers, whose greatest is read.  It rolls: a save is
visible once it is complete, and the saves before it go only then.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import mean_vector
from . import shared


def write_bundle(path: str, index: DataFrame, source: DataFrame, target: DataFrame | None = None, meta: dict | None = None) -> None:
    """`index` (node, idx); one vector table (idx, vec), or a source and a target table."""
    joined = index.join(source.select("idx", F.col("vec").alias("src_vec")), "idx")
    if target is None:
        out = joined.select("node", "idx", F.col("src_vec").alias("merged_vec"))
    else:
        joined = joined.join(target.select("idx", F.col("vec").alias("dst_vec")), "idx")
        out = joined.select("node", "idx", "src_vec", "dst_vec", mean_vector(F.col("src_vec"), F.col("dst_vec")).alias("merged_vec"))
    out.write.mode("overwrite").parquet(f"{path}/vectors")
    _write_meta(index.sparkSession, f"{path}/meta", meta or {})


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, float, dict]:
    """((node, idx, src_vec, dst_vec), threshold, meta).

    Without both a source and a target vector the merged one stands for both; a
    bundle with neither is an error.  The threshold defaults to 0.5.
    """
    table = spark.read.parquet(f"{path}/vectors")
    meta = _read_meta(spark, f"{path}/meta")
    names = set(table.columns)
    if {"src_vec", "dst_vec"} <= names:
        chosen = table.select("node", "idx", "src_vec", "dst_vec")
    elif "merged_vec" in names:
        chosen = table.select("node", "idx", F.col("merged_vec").alias("src_vec"), F.col("merged_vec").alias("dst_vec"))
    else:
        raise ValueError(f"{path}: neither source and target vectors nor merged ones")
    return chosen, float(meta.get("threshold", 0.5)), meta


def save_checkpoint(path: str, step: int, index: DataFrame, states: dict[str, DataFrame], meta: dict | None = None) -> None:
    spark = index.sparkSession
    at = f"{path}/step={step}"
    index.select("node", "idx").write.mode("overwrite").parquet(f"{at}/index")
    for name, state in states.items():
        state.write.mode("overwrite").parquet(f"{at}/{name}")
    _write_meta(spark, f"{at}/meta", (meta or {}) | {"step": step, "states": sorted(states)})
    latest = f"{path}/latest"
    before = [r.step for r in spark.read.parquet(latest).distinct().collect()] if _exists(spark, latest) else []  # a save number each
    spark.createDataFrame([(step,)], "step long").write.mode("append").parquet(latest)
    for old in before:
        if old < step:
            shared.remove(spark, f"{path}/step={old}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_checkpoint(spark: SparkSession, path: str) -> dict | None:
    """{'step', 'index', 'meta', <state>...} of the latest save, or None where nothing was saved."""
    if not _exists(spark, f"{path}/latest"):
        return None
    step = spark.read.parquet(f"{path}/latest").agg(F.max("step")).first()[0]
    at = f"{path}/step={step}"
    meta = _read_meta(spark, f"{at}/meta")
    return {"step": step, "index": spark.read.parquet(f"{at}/index"), "meta": meta} | {name: spark.read.parquet(f"{at}/{name}") for name in meta["states"]}


def export(spark: SparkSession, checkpoint: str, path: str) -> list[str]:
    """Write the bundle of a checkpoint with `source` and `target` states; returns warnings."""
    found = load_checkpoint(spark, checkpoint)
    if found is None:
        raise FileNotFoundError(checkpoint)
    for name in ("source", "target"):
        if name not in found:
            raise KeyError(name)
        if not {"idx", "vec"} <= set(found[name].columns):
            raise KeyError(f"{name}: idx, vec")
    dim = found["source"].select(F.size("vec").alias("n")).first()
    stated = found["meta"].get("config", {}).get("dim")
    warnings = [f"the configuration says {stated} dimensions, the vectors have {dim.n}"] if dim and stated not in (None, dim.n) else []
    meta = {"dim": dim.n if dim else 0, "nodes": found["index"].count(), "threshold": found["meta"].get("metrics", {}).get("threshold", 0.5), "metrics": found["meta"].get("metrics", {})}
    write_bundle(path, found["index"], found["source"], found["target"], meta)
    return warnings


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_meta(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).collect()  # one row
    return json.loads(rows[0].value) if rows else {}
