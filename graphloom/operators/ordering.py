"""Global positions and running totals without a single-task window.

Rows are range-partitioned and sorted, numbered by partition and place, and
stored; what every partition holds is a row of a small table, whose running
totals shift the partitions' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

_PART = 33  # bits below the partition's number in monotonically_increasing_id


def ordered(frame: DataFrame, *order: Column | str) -> DataFrame:
    """`frame` stored in this order, with `part_` and `place_`."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    names = {f"key{k}_": c for k, c in enumerate(keys)}
    columns = [F.col(c) for c in frame.columns]
    with_keys = frame.withColumns(names)
    spread = with_keys.repartitionByRange(*names).sortWithinPartitions(*names).select(*columns)
    stored = shared.store(spread.withColumn("id_", F.monotonically_increasing_id()), "ordered")
    return stored.select(*columns, F.shiftright("id_", _PART).alias("part_"), F.col("id_").bitwiseAND(F.lit((1 << _PART) - 1)).alias("place_"))


def positions(frame: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """`frame` with its row's place in this order, from 0, as `name`.  The order must be total to be reproducible."""
    rows = ordered(frame, *order)
    sizes = rows.groupBy("part_").agg(F.count("*").alias("size_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("part_", F.coalesce(F.sum("size_").over(before), F.lit(0).cast("long")).alias("offset_"))
    return rows.join(offsets, "part_").withColumn(name, F.col("offset_") + F.col("place_")).drop("part_", "place_", "offset_")


def running_totals(frame: DataFrame, columns: list[str], *order: Column | str) -> DataFrame:
    """`frame` with `<column>_before`: the sum of the column over all rows before this one."""
    rows = ordered(frame, *order)
    own = Window.partitionBy("part_").orderBy("place_").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sums = rows.groupBy("part_").agg(*(F.sum(c).alias(f"{c}_sum_") for c in columns))
    offsets = sums.select("part_", *(F.coalesce(F.sum(f"{c}_sum_").over(before), F.lit(0)).alias(f"{c}_offset_") for c in columns))
    out = rows.withColumns({f"{c}_own_": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns}).join(offsets, "part_")
    out = out.withColumns({f"{c}_before": F.col(f"{c}_own_") + F.col(f"{c}_offset_") for c in columns})
    return out.select(*frame.columns, *(f"{c}_before" for c in columns))
