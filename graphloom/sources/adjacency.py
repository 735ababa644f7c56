"""Adjacency files, test pairs and prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import positions


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(line, src, nbrs) of ragged comma-separated rows without a header.

    Fields are never cast or trimmed, an empty field is a node of its own, and
    blank lines are skipped.  A field that begins with a quote ends with the next
    one; two quotes within it are one, and it may hold commas but no line break.  `line` is the row's place in the file; files of
    more than one block are read in parallel and numbered block by block.
    """
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    lines = positions(rows.filter("value <> ''"), "line", "file_path", "file_block_start", "at")
    part = _fields(F.col("value"))
    return lines.select("line", part[0].alias("src"), F.slice(part, F.lit(2), F.size(part)).alias("nbrs"))


def _fields(line: Column) -> Column:
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]++|"")*+"?[^,]*|[^,"][^,]*|)'), F.lit(1))
    inside = lambda f: F.replace(F.regexp_extract(f, r'^"((?:[^"]++|"")*+)', 1), F.lit('""'), F.lit('"'))
    plain = F.transform(raw, lambda f: F.when(f.startswith('"'), F.concat(inside(f), F.regexp_extract(f, r'^"(?:[^"]++|"")*+"(.*)$', 1))).otherwise(f))
    return F.when(line.contains('"'), plain).otherwise(F.split(line, ",", -1))


def write_adjacency(lists: DataFrame, path: str) -> None:
    """(src, nbrs) as ragged rows; fields with commas, quotes or line breaks are quoted."""
    quoted = lambda f: F.when(f.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f)
    lists.select(F.array_join(F.transform(F.concat(F.array("src"), F.col("nbrs")), quoted), ",").alias("value")).write.text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, u, v) as strings; a row of any other number of fields is an error."""
    return spark.read.schema("id string, u string, v string").option("header", True).option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", True).csv(path)


def write_predictions(decided: DataFrame, path: str, one_file: bool = False) -> None:
    """`Id,Predictions` with line ends as Python's csv module writes them; a file for each partition, or one for all, which one task writes."""
    (decided.coalesce(1) if one_file else decided).write.option("header", True).option("lineSep", "\r\n").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Id string, Predictions int").option("header", True).option("lineSep", "\r\n").csv(path)
