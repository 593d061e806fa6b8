"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common

TABLES = 10
PROBES = 4
#: Times as many tables as of two hashes that buckets of three need, so that as many pairs meet.
MORE = 4
SEED = 20_240_607
#: Rows that a bucket, and members that either class of a pair, may hold before its work is split into blocks.
BUCKET, MEMBERS = 1024, 8192
#: Radians by which single-precision angles in buckets may be off.
SLACK = 2e-3
MEMBER = "uid long, vec_id long, class_id long, angle double, vec binary"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, width, h = x.shape[0], x.shape[1], 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def signs(width: int, table: int, hashes: int) -> np.ndarray:
    return np.random.default_rng((SEED, width, table)).choice((-1.0, 1.0), (hashes, 3, width)).astype(np.float32)


def bucket_keys(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Keys of each unit row: for each table the bucket of its nearest polytope vertices and the ``probes - 1`` next likely ones."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x.astype(np.float32), ((0, 0), (0, width - d)))
    top, out = min(3, width), []
    for table in range(tables):
        cost = np.zeros((n, 1), np.float32)
        code = np.full((n, 1), table * 1009 + d, np.int64)
        for s in signs(width, table, hashes):
            y = x
            for k in range(3):
                y = hadamard(y * s[k])
            size = np.abs(y)
            best = np.argpartition(-size, top - 1, axis=1)[:, :top]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(size, best, 1), axis=1), 1)
            worth = np.take_along_axis(size, best, 1)
            vertex = best * 2 + (np.take_along_axis(y, best, 1) < 0)
            cost = (cost[:, :, None] + (worth[:, :1] - worth)[:, None, :] ** 2).reshape(n, -1)
            code = (code[:, :, None] * (2 * width + 1) + vertex[:, None, :]).reshape(n, -1)
            pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            cost, code = np.take_along_axis(cost, pick, 1), np.take_along_axis(code, pick, 1)
        out.append(code)
    return np.concatenate(out, axis=1)


def unit_rows(values: list, dims: int) -> np.ndarray:
    x = np.array(values, np.float64).reshape(len(values), dims)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(v) -> bool:
    return v is not None and len(v) > 0 and not any(c is None or not math.isfinite(c) for c in v) and any(v)


def _classes(radius: float):
    """Per task, tight classes: every member lies within ``radius`` of its leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_uid = TaskContext.get().partitionId() << 36
        leaders: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()
            n = len(ids)
            uid = list(range(next_uid, next_uid + n))
            next_uid += n
            own, angle, raw = uid[:], [0.0] * n, [None] * n
            by_dims = defaultdict(list)
            for k, v in enumerate(vectors):
                if usable(v):
                    by_dims[len(v)].append(k)
            for dims, rows in by_dims.items():
                x = unit_rows([vectors[k] for k in rows], dims)
                for k, key, v in zip(rows, bucket_keys(x, 1, 2, 1)[:, 0].tolist(), x, strict=True):
                    raw[k] = v.tobytes()
                    for leader, w in leaders[key]:
                        if (c := float(v @ w)) >= math.cos(radius):
                            own[k], angle[k] = leader, math.acos(min(1.0, c))
                            break
                    else:
                        leaders[key].append((uid[k], v))
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(ids, pa.int64()), pa.array(own, pa.int64()), pa.array(angle, pa.float64()), pa.array(raw, pa.binary())], names=[x.split()[0] for x in MEMBER.split(", ")])

    return run


def _spread(hashes: int, tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, raw, reach = batch.column("uid").to_numpy(), batch.column("vec").to_pylist(), batch.column("radius").to_numpy()
            by_dims = defaultdict(list)
            for k, v in enumerate(raw):
                by_dims[len(v)].append(k)
            for size, rows in by_dims.items():
                x = np.frombuffer(b"".join(raw[k] for k in rows)).reshape(len(rows), size // 8)
                keys = bucket_keys(x, tables, hashes, probes)
                each = keys.shape[1]
                small = [v.tobytes() for v in x.astype(np.float32)]
                at = np.array(rows)
                for k in range(0, len(rows), 256):
                    part = slice(k, k + 256)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part].ravel()), pa.array(np.repeat(uid[at[part]], each)), pa.array(np.repeat(reach[at[part]], each)), pa.array([v for v in small[part] for _ in range(each)], pa.binary())], names=["key", "uid", "radius", "vec"])

    return run


def _shared(spread: DataFrame, most: int) -> DataFrame:
    """``spread`` with the keys of buckets of more than ``most`` rows split.

    Rows of such a bucket fall into blocks by their uid, and every two blocks meet under a key of
    their own, so no task holds more than about two blocks and no pair is lost. Spark broadcasts
    the counts of hot buckets only if they are small.
    """
    counts = spread.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most)
    hot = common.materialise(counts.select("key", F.ceil(F.col("rows") / most).cast("int").alias("blocks")), "hot-buckets")
    own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least("own", j), F.greatest("own", j)))
    keys = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(meet)
    return spread.join(hot, "key", "left").withColumn("own", own).select(F.explode(keys).alias("key"), "uid", "radius", "vec")


def _pairs(limit: float):
    """Pairs of one bucket whose classes may hold linked vectors."""

    def near(x, y, rx, ry):
        dot = np.minimum(1.0, np.einsum("ij,ij->i", x, y))
        return np.arccos(dot) <= limit + rx + ry + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.grouped(batches, "key"):
            key, uid, reach = (rows.column(c).to_numpy() for c in ("key", "uid", "radius"))
            raw = rows.column("vec").to_pylist()
            sizes = np.array([len(v) for v in raw])
            a, b = [], []
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(raw[k] for k in at), np.float32).reshape(len(at), -1)
                k, u, r = key[at], uid[at], reach[at]
                starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                lengths = np.diff(np.r_[starts, len(k)])
                little = np.repeat(lengths <= 64, lengths)
                for step in range(1, min(64, int(lengths.max()))):
                    p = np.flatnonzero((k[step:] == k[:-step]) & little[step:])
                    for c in range(0, len(p), 50_000):
                        q = p[c : c + 50_000]
                        q = q[near(x[q], x[q + step], r[q], r[q + step])]
                        a += u[q].tolist()
                        b += u[q + step].tolist()
                for start, length in zip(starts[lengths > 64].tolist(), lengths[lengths > 64].tolist(), strict=True):
                    block, near_by = x[start : start + length], r[start : start + length]
                    least = math.cos(min(math.pi, limit + 2 * near_by.max() + SLACK)) - 1e-6  # no pair below it can be near
                    for c in range(0, length, 512):
                        dot = np.minimum(1.0, block[c : c + 512] @ block.T)
                        i, j = np.nonzero(dot >= least)
                        angle, i = np.arccos(np.maximum(-1.0, dot[i, j])), i + c
                        keep = (j > i) & (angle <= limit + near_by[i] + near_by[j] + SLACK)
                        a += u[start + i[keep]].tolist()
                        b += u[start + j[keep]].tolist()
            ab = np.array(a, np.int64), np.array(b, np.int64)
            keep = ab[0] != ab[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*ab)[keep]), pa.array(np.maximum(*ab)[keep])], schema=common.EDGE)

    return run


def _members(cosine: float):
    """Links between the members of two classes, counted one by one in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.grouped(batches, "pair", 1):
            pair, side, uid = (rows.column(c).to_numpy() for c in ("pair", "side", "uid"))
            raw = rows.column("vec").to_pylist()
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            out_uid, out_n, out_a, out_b = [], [], [], []
            for start, stop in zip(starts, np.r_[starts[1:], len(pair)], strict=True):
                at = np.arange(start, stop)
                left, right = at[side[at] == 0], at[side[at] == 1]
                if not len(left) or not len(right):  # a block may be empty
                    continue
                y = np.frombuffer(b"".join(raw[k] for k in right)).reshape(len(right), -1)
                n_right = np.zeros(len(right), np.int64)
                for c in range(0, len(left), 1024):
                    part = left[c : c + 1024]
                    x = np.frombuffer(b"".join(raw[k] for k in part)).reshape(len(part), -1)
                    hit = x @ y.T >= cosine
                    n_right += hit.sum(axis=0)
                    n = hit.sum(axis=1)
                    out_uid += uid[part[n > 0]].tolist()
                    out_n += n[n > 0].tolist()
                out_uid += uid[right[n_right > 0]].tolist()
                out_n += n_right[n_right > 0].tolist()
                if n_right.any():
                    out_a.append(rows.column("ca")[int(start)].as_py())
                    out_b.append(rows.column("cb")[int(start)].as_py())
            k = len(out_uid)
            yield pa.RecordBatch.from_arrays([pa.array(out_uid + [None] * len(out_a), pa.int64()), pa.array(out_n + [None] * len(out_a), pa.int64()), pa.array([None] * k + out_a, pa.int64()), pa.array([None] * k + out_b, pa.int64())], names=["uid", "n", "a", "b"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, tables: int = TABLES, probes: int = PROBES, crowd: int | None = None, bucket: int = BUCKET, members: int = MEMBERS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every vector, linking those of cosine ``cosine`` or more.

    Each task first gathers vectors within half the link angle of a leader into classes, whose
    members all link with each other; a group of many copies shrinks to a few classes before
    anything is shuffled. Leaders are hashed by cross-polytopes after three sign-flip and
    Hadamard rounds, ``tables`` times two hashes whatever the number of classes, each with ``probes``
    buckets. (A caller who sets ``crowd`` has more classes than that hashed MORE times as often by
    three, for smaller buckets; other pairs meet then, so results may differ.) Pairs of leaders
    in a bucket are compared; by the triangle inequality most pairs of classes then link wholly or not at all, and the rest are counted member by
    member in double precision. Buckets of more than ``bucket`` rows, and pairs with a class of
    more than ``members``, are split into blocks that meet two by two in tasks of their own.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths. Repeated rows count as vectors of their own; a null
    vec_id gets the smallest known vec_id of its component; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    common.small_batches(spark, 4096)
    limit = math.acos(cosine)
    found = common.materialise(vectors.select("vec_id", "embedding").mapInArrow(_classes(limit / 2 - 1e-6), MEMBER), "members")
    sizes = found.where("vec is not null").groupBy("class_id").agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("radius"))
    classes = common.materialise(found.where("uid = class_id and vec is not null").select("uid", "vec").join(sizes, F.col("uid") == F.col("class_id")).drop("class_id"), "classes")
    hashes, tables = (2, tables) if crowd is None or classes.count() <= crowd else (3, MORE * tables)
    spread = classes.select("uid", "radius", "vec").mapInArrow(_spread(hashes, tables, probes), "key long, uid long, radius double, vec binary")
    pairs = _shared(spread, bucket).repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(limit), "a long, b long").distinct()
    side = lambda x: classes.select(F.col("uid").alias(x), F.col("radius").alias(f"r{x}"), F.col("size").alias(f"s{x}"), F.col("vec").alias(f"v{x}"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = (batch.column(c).to_pylist() for c in ("va", "vb"))
            dots = np.array([float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(va, vb, strict=True)])
            angle = np.arccos(np.clip(dots, -1, 1))
            reach = batch.column("ra").to_numpy() + batch.column("rb").to_numpy()
            single = reach == 0
            # leaders alone are decided exactly; angles carry a margin for rounding
            state = np.where(single, np.where(dots >= cosine, 1, 0), np.where(angle + reach <= limit - 1e-6, 1, np.where(angle - reach > limit + 1e-6, 0, 2)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "sa", "sb")), pa.array(state.astype(np.int32))], names=["a", "b", "sa", "sb", "state"])

    judged = common.materialise(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "sa", "sb", "va", "vb").mapInArrow(judge, "a long, b long, sa long, sb long, state int").where("state > 0"), "pairs")
    whole = judged.where("state = 1")
    blocks = lambda size: F.ceil(F.col(size) / members).cast("int")
    end = lambda side, c, own, other: F.struct(F.lit(side).alias("side"), F.col(c).alias("class_id"), blocks(own).alias("own"), blocks(other).alias("other"))
    ends = judged.where("state = 2").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.explode(F.array(end(0, "a", "sa", "sb"), end(1, "b", "sb", "sa"))).alias("e")).select("ca", "cb", "e.*")
    mine = F.pmod(F.xxhash64("uid"), F.col("own")).cast("int")
    meet = ends.join(found.select("class_id", "uid", "vec"), "class_id").withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    left = F.col("side") == 0
    pair = F.xxhash64("ca", "cb", F.when(left, F.col("i")).otherwise(F.col("j")), F.when(left, F.col("j")).otherwise(F.col("i")))
    meeting = meet.select(pair.alias("pair"), "ca", "cb", "side", "uid", "vec").repartition("pair").sortWithinPartitions("pair")
    counted = common.materialise(meeting.mapInArrow(_members(cosine), "uid long, n long, a long, b long"), "counted")
    edges = whole.select("a", "b").union(counted.where("a is not null").select("a", "b"))
    labels = common.components(edges)
    by_class = whole.select(F.col("a").alias("class_id"), F.col("sb").alias("n")).union(whole.select(F.col("b").alias("class_id"), F.col("sa").alias("n"))).groupBy("class_id").agg(F.sum("n").alias("far"))
    info = classes.select(F.col("uid").alias("class_id"), "size").join(by_class, "class_id", "left").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select("class_id", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("near"), F.coalesce("component", "class_id").alias("component"))
    extra = counted.where("uid is not null").groupBy("uid").agg(F.sum("n").alias("extra"))
    rows = common.materialise(found.select("uid", "vec_id", "class_id").join(info, "class_id", "left").join(extra, "uid", "left").select("vec_id", (F.coalesce("near", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component")), "linked")
    least = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return rows.join(least, "component", "left").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
