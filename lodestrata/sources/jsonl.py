"""JSON Lines that grow by appending, read back past cut and damaged lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def valid_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows whose line is JSON; blank, cut and damaged lines go."""
    return lines.where(F.try_parse_json(column).isNotNull())


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of all files at ``path`` that are JSON; a writer that died in a line costs that line only."""
    return valid_lines(spark.read.text(path))


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append rows as JSON Lines, nulls written out."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
