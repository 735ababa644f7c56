"""Shared plumbing: input projection, row keys and recoverable intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared


SETTINGS = shared.SETTINGS
prepare = shared.prepare
mapped = shared.mapped
give_back = shared.give_back


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Write `frame` as a table in the shared folder and return it as read back.

    This cuts lineage: what follows reads the table, so a lost executor costs
    the tasks it was running and nothing before them.
    """
    prepare(frame.sparkSession)
    return shared.store(frame, name)


#: Delete tables made by `keep` that nothing will read again.
drop = shared.drop


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def texts(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, text) of a documents table; whatever else it holds is not read.

    rk stands for the row: equal only for rows with the same id and text, so a
    repeated row gets its result from the same group and no join multiplies it.
    """
    prepare(docs.sparkSession)
    return docs.select(
        row_key(docs).alias("rk"),
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["text"].cast("string").alias("text"),
    )


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
