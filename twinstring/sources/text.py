"""Lines of text and local iterables in; ``row,col,dist`` lines out."""

from __future__ import annotations

from collections.abc import Iterable
from typing import IO

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False), T.StructField("str", T.StringType(), False)]
)


def from_iterable(spark: SparkSession, strings: Iterable[str]) -> DataFrame:
    """``(id, str)`` with the position as id. The iterable is consumed once."""
    if isinstance(strings, str):
        raise ValueError("expected iterable of str, got str")
    rows = []
    for i, s in enumerate(strings):
        if not isinstance(s, str):
            raise TypeError(f"element {i} is not a str but {type(s).__name__}")
        rows.append((i, s))
    return spark.createDataFrame(rows, SCHEMA)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(id, str)`` of a text file; id is the 0-based line number, blank lines count. Lines end
    with ``\\n``, and one ``\\r`` before it is taken off. Files of a folder count on, in order of
    their paths. Numbering needs one extra pass, which only counts the lines of each split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),  # consecutive within a split
        "value",
    )
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    splits = splits.select("file", "start", offset.alias("offset"))
    text = F.regexp_replace("value", "\r\\z", "").alias("str")
    return lines.join(splits, ["file", "start"]).select((F.col("offset") + F.col("at")).alias("id"), text)


def pair_lines(pairs: DataFrame, zero_index: bool = False) -> DataFrame:
    """``line``: row and column counted from one unless ``zero_index``."""
    shift = 0 if zero_index else 1
    return pairs.select(
        F.concat_ws(",", F.col("row") + shift, F.col("col") + shift, F.col("dist")).alias("line")
    )


def write_pairs(
    pairs: DataFrame, out: str | IO[str], zero_index: bool = False, sort: bool = True
) -> None:
    """To a folder of text files, or in order to an open stream, one partition at a time."""
    if sort:
        pairs = pairs.orderBy("row", "col")
    lines = pair_lines(pairs, zero_index)
    if isinstance(out, str):
        lines.write.mode("overwrite").text(out)
        return
    for r in lines.toLocalIterator():
        out.write(r["line"] + "\n")
