"""Pieces that several corpus operators share: scratch tables, Arrow batching, union-find."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder is made and set, but only for a local master:
    on a cluster a machine-local folder would not be seen by the other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    path = spark.conf.get("spark.lodestrata.scratch.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.lodestrata.scratch.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestrata/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: documents can be long, and a batch is held whole by a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release() -> None:
    """Give memory that a Python worker no longer uses back to the machine: idle workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Remainders of hashes that tell rows which can't be among the removed ones; a broadcast of as many numbers at most.
PLACES = 1 << 19


def suspects(docs: DataFrame, hashed: str, gone: DataFrame, gone_hash: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows whose hash (a column) no row of ``gone`` can have, and the others.

    Only the second part need be joined with ``gone``, so texts that stay aren't exchanged. The
    parts are told by remainders of hashes, of which there are PLACES at most, whatever the size.
    """
    places = materialise(gone.select(F.pmod(gone_hash, F.lit(PLACES)).alias("_place")).distinct(), "places")
    placed = docs.withColumn("_place", F.pmod(hashed, F.lit(PLACES)))
    side = lambda how: placed.join(F.broadcast(places), "_place", how).drop("_place")
    return side("left_anti"), side("left_semi")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


class UnionFind:
    """Union by smallest id over hashable ints, with path halving."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges of a partition, a star for each component."""
    uf = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            uf.link(a, b)
    nodes = list(uf.up)
    yield pa.RecordBatch.from_arrays([pa.array([uf.find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], schema=EDGE)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``, component the smallest node reachable.

    Every node that has an edge gets a row. Null ends are dropped, loops and repeated edges
    count once, no edges give no rows. Partitions are first contracted to stars, then
    large-star and small-star rounds alternate until nothing changes (a logarithmic number of
    rounds in practice); each round's edges are a table in the shared folder.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    stars = materialise(edges.mapInArrow(_forest, "a long, b long").distinct(), "cc")
    mark = _mark(stars)
    while mark[0]:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        joined = large.select(F.col("b").alias("u"), "a").join(low, "u")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        stars = materialise(small.where("a < b").distinct(), "cc")
        last, mark = mark, _mark(stars)
        if mark == last:
            break
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).union(stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)"))).first()
    return row[0] or 0, row[1], row[2]


def grouped(batches: Iterator[pa.RecordBatch], key: str, least: int = 20_000) -> Iterator[pa.Table]:
    """Cut a partition that is sorted by ``key`` into tables that end where a key ends, of ``least`` rows or more."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(keys[1:] != keys[:-1])
        if len(starts):
            cut = int(starts[-1]) + 1
        elif len(held) > 1 and held[-2].column(key)[held[-2].num_rows - 1].as_py() != keys[0]:
            cut = 0
        else:
            continue
        held[-1] = batch.slice(0, cut)
        yield pa.Table.from_batches(held)
        held, rows = [batch.slice(cut)], batch.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)
