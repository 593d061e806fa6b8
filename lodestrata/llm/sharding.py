"""Balanced sharding by sampled splitters; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Expected keys in the sample, and ranges cut from it: both fixed, so what the driver holds is bounded.
SAMPLE = 8192
COARSE, FINE = 16, 16


def _splitters(keys: DataFrame) -> list[tuple[int, int]]:
    """Quantile boundaries of a sample in which a record is drawn with a chance in proportion to its size."""
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return []
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(float(SAMPLE)) / F.lit(float(total)))
    draw = F.pmod(F.xxhash64("h", "doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keys.where(draw < chance).select("h", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), (F.greatest(F.lit(1.0), F.col("size") * F.lit(float(SAMPLE)) / F.lit(float(total)))).alias("w"))
    rows = sorted(tuple(r) for r in drawn.limit(8 * SAMPLE).collect())
    mass, seen, out = sum(r[2] for r in rows), 0.0, []
    ranges = COARSE * FINE
    for h, d, w in rows:
        seen += w
        if len(out) < ranges - 1 and seen >= mass * (len(out) + 1) / ranges:
            out.append((h, d))
            while len(out) < ranges - 1 and seen >= mass * (len(out) + 1) / ranges:
                out.append((h, d))
    return out


def _range_of(bounds: list[tuple[int, int]]):
    """Number of boundaries at or below a record's key, by a two-level search."""
    if not bounds:
        return F.lit(0)
    key = F.struct(F.col("h").alias("h"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"))
    pair = lambda x: F.struct(F.lit(x[0]).cast("long").alias("h"), F.lit(x[1]).cast("long").alias("d"))
    below = lambda part: F.size(F.filter(F.array(*[pair(x) for x in part]), lambda b: b <= key))
    coarse = below(bounds[FINE - 1 :: FINE])
    chunks = [bounds[k * FINE : k * FINE + FINE - 1] for k in range((len(bounds) + FINE - 1) // FINE)]
    pieces = F.array(*[F.array(*[pair(x) for x in c]) if c else F.array().cast("array<struct<h:bigint,d:bigint>>") for c in chunks])
    inner = F.coalesce(F.size(F.filter(F.get(pieces, F.col("coarse")), lambda b: b <= key)), F.lit(0))
    return coarse, inner


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Deal documents into ``shards`` of nearly equal bytes: ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``.

    Keys are (hash of the text, doc_id), so equal texts lie together and are parted only where a
    shard ends. A size-weighted sample of keys gives quantile boundaries of 256 ranges; exact
    bytes and counts of each range place it among the shards, and a range that reaches over a
    shard's end is subdivided by the running bytes within it. Every shard then holds its share of
    the bytes to within one record. slot is gapless from 0 in each shard. Null text has size 1 and
    the checksum of no bytes; repeated rows are placed one by one; rows with a null doc_id come
    first among equal texts; an empty table gives no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.conv(F.substring(F.md5(raw.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"))
    found = _range_of(_splitters(keys))
    if isinstance(found, tuple):
        keys = keys.withColumn("coarse", found[0]).withColumn("range", F.col("coarse") * FINE + found[1]).drop("coarse")
    else:
        keys = keys.withColumn("range", found)
    per = keys.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # at most 256 rows: one per range
    ahead = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("range", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = Window.partitionBy("range").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keys.withColumn("before", F.sum("size").over(inside) - F.col("size")).withColumn("row", F.row_number().over(Window.partitionBy("range").orderBy("h", "doc_id", "size", "text_crc32")) - 1)
    placed = placed.join(F.broadcast(offsets), "range").withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * (b0 + before) + size) * {shards} div (2 * total)")).cast("int"))
    placed = placed.withColumn("rank", F.col("n0") + F.col("row"))
    # every shard's first rank: at most 256 times the shards rows before the last step
    firsts = placed.groupBy("range", "shard").agg(F.min("rank").alias("first")).groupBy("shard").agg(F.min("first").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
