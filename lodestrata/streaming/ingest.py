"""Continuous and resumed grading of a growing corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.structure import grades
from lodestrata.sources.corpus import extension, sniff


def append_grades(files: DataFrame, table: str) -> None:
    """Grade the files that the table lacks, and append them."""
    spark = files.sparkSession
    try:
        done = spark.read.parquet(table).select("path")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    todo = files if done is None else files.join(done, "path", "left_anti")
    grades(sniff(todo)).write.mode("append").parquet(table)


def stream_grades(spark: SparkSession, root: str, table: str, checkpoint: str):
    """A query that grades each new file once, with its progress in ``checkpoint``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    files = files.where("length > 0").select("path", extension(F.col("path")).alias("ext"), "length", "content")
    return grades(sniff(files)).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
