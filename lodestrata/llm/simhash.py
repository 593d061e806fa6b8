"""SimHash near-duplicates found with hierarchical indexes over Gray-ordered fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm import common

SEED = 42
FANOUT = 8
#: Fingerprints of one block value beyond which they are dealt again by a part of their other bits.
HOT = 20_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, unsigned; a bit is 1 if set in over half of the shingle hashes.

    A-Z are lower-cased, words are runs of bytes other than space and tab to carriage return,
    shingles keep their repeats; a text of fewer words is one shingle, one of none gives 0.
    """
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    joined = map(b" ".join, zip(*(ws[k:] for k in range(words)), strict=False)) if len(ws) >= words else [b" ".join(ws)]
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(s, SEED) for s in joined), dtype=">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of whole texts, fp as a signed long; null texts count as empty."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in common.texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    ranks = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    return ranks


class GrayTree:
    """Index of fingerprints sorted by Gray rank, one tree for each group of consecutive ones.

    A node stands for FANOUT consecutive nodes of the level below and holds the bits that all
    fingerprints beneath it share (mask and pattern). Bits factored into a node aren't looked
    at again further down: a search carries the differences found so far and drops a node,
    with all beneath it, once they exceed the radius.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray | None = None) -> None:
        count = np.array([len(codes)]) if sizes is None else sizes
        self.order = np.lexsort((gray_rank(codes), np.repeat(np.arange(len(count)), count)))
        low = high = codes[self.order]
        first = np.cumsum(count) - count
        self.levels = [(low, np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF)), first, count)]
        while count.max(initial=0) > FANOUT:
            above = -(-count // FANOUT)
            begin = np.cumsum(above) - above
            at = np.repeat(first, above) + FANOUT * (np.arange(above.sum()) - np.repeat(begin, above))
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            mask, first, count = ~(low ^ high), begin, above
            self.levels.append((low & mask, mask, first, count))

    def search(self, queries: np.ndarray, radius: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in queries, place in codes) that differ in at most ``radius`` bits; ``group`` is each query's group."""
        group = np.zeros(len(queries), np.int64) if group is None else group
        pattern, mask, first, count = self.levels[-1]
        n = count[group]
        q = np.repeat(np.arange(len(queries)), n)
        node = first[group[q]] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        found = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
        keep = found <= radius
        q, node, found = q[keep], node[keep], found[keep]
        for (pattern, mask, first, count), (_, above, begin, _) in zip(self.levels[-2::-1], self.levels[:0:-1], strict=True):
            place = ((node - begin[group[q]])[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            q, parent, found = np.repeat(q, FANOUT), np.repeat(node, FANOUT), np.repeat(found, FANOUT)
            there = place < count[group[q]]
            q, parent, found, place = q[there], parent[there], found[there], place[there]
            child = first[group[q]] + place
            found = found + np.bitwise_count((queries[q] ^ pattern[child]) & mask[child] & ~above[parent])
            keep = found <= radius
            q, node, found = q[keep], child[keep], found[keep]
        return q, self.order[node]


def _near(rows: pa.Table, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of nodes of equal key within the radius, every group searched through its Gray tree."""
    key = rows.column("key").to_numpy()
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    several = np.repeat(sizes > 1, sizes)
    fp = rows.column("fp").to_numpy().view(np.uint64)[several]
    node = rows.column("node").to_numpy()[several]
    sizes = sizes[sizes > 1]
    left: list[int] = []
    right: list[int] = []
    if not len(fp):
        return left, right
    tree, uf = GrayTree(fp, sizes), common.UnionFind()
    group = np.repeat(np.arange(len(sizes)), sizes)
    reach = np.cumsum(sizes[group])  # a query meets its group at most
    k = 0
    while k < len(fp):
        stop = max(k + 1, int(np.searchsorted(reach, (reach[k - 1] if k else 0) + (1 << 22), "right")))
        q, found = tree.search(fp[k:stop], radius, group[k:stop])
        q = q + k
        for a, b in zip(node[q[found > q]].tolist(), node[found[found > q]].tolist(), strict=True):
            if uf.link(a, b):
                left.append(a)
                right.append(b)
        k = stop
    return left, right


def links(nodes: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of ``nodes(fp, node)`` within ``radius`` bits.

    Fingerprints within the radius agree in one of ``radius + 1`` bit blocks, so each block's
    value is a key, and each key's fingerprints are searched through their own index. Those of
    a key of more than ``hot`` are dealt once more by the blocks of their other bits, one of
    which agrees again. A ball of radius 3 holds at most 43,745 fingerprints, which bounds what
    a search yields. The counts that are broadcast are of block values, 2^18 at most.
    """
    blocks = radius + 1
    width = 64 // blocks
    fine = (64 - width) // blocks
    keys, subs = [], []
    for k in range(blocks):
        keys.append(F.shiftrightunsigned("fp", k * width).bitwiseAND((1 << width) - 1) * blocks + k)
        low = F.col("fp").bitwiseAND((1 << k * width) - 1)
        high = F.shiftleft(F.shiftrightunsigned("fp", (k + 1) * width), k * width) if (k + 1) * width < 64 else F.lit(0).cast("long")
        others = low.bitwiseOR(high)
        subs.append(F.array(*[F.shiftrightunsigned(others, j * fine).bitwiseAND((1 << fine) - 1) * blocks + j + 1 for j in range(blocks)]))
    spread = nodes.select(F.explode(F.array(*[F.struct(a.alias("block"), b.alias("subs")) for a, b in zip(keys, subs, strict=True)])).alias("k"), "fp", "node").select("k.*", "fp", "node")
    crowded = spread.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("block", F.lit(True).alias("crowded"))
    dealt = spread.join(F.broadcast(crowded), "block", "left").withColumn("sub", F.explode(F.when(F.col("crowded"), F.col("subs")).otherwise(F.array(F.lit(0).cast("long")))))
    keyed = dealt.select((F.shiftleft(F.col("block"), 32) + F.col("sub")).alias("key"), "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.grouped(batches, "key"):
            a, b = _near(rows, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=common.EDGE)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every document; component_id is the smallest doc_id reachable by links.

    Documents link when their fingerprints differ in at most ``radius`` bits. Equal fingerprints
    are one node of the link graph, so copies are never expanded into pairs. Null and empty
    texts have fingerprint 0 and link like any other; rows with a null doc_id keep their
    fingerprint and get the component of their fingerprint's other rows, null if there are
    none; repeated rows stay repeated; an empty table gives no rows.
    """
    fps = common.materialise(fingerprints(docs, words), "fps")
    nodes = common.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    labels = common.components(links(nodes, radius))
    known = nodes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(known, "fp", "left").select("doc_id", "fp", "component_id")


#: Sets of SURE shingles or more whose fingerprints differ in over WIDE bits aren't compared. Sets alike in 0.8 differ in
#: 9.7 bits of 64 on average (deviation 2.9), so one such pair in ten million is missed.
WIDE, SURE = 26, 32
#: Shingles of COMMON documents or more come last in the order of shingles, MOST of them at most, so that few prefixes hold them.
COMMON, MOST = 64, 200_000
#: A prefix shingle of up to SMALL texts gives all their pairs; of a larger group, all are compared with its first text. The
#: texts of groups that this doesn't join are dealt again, their common shingles last, while that halves them; those of the
#: groups that stay large and aren't joined to their largest component are compared with all others, without a row for a pair.
SMALL = 64
#: Prefix shingles that a task holds before it deals them, and that a range of them holds on average.
RUN = 1 << 19
#: Shingle sets that a task of the second round holds, to compare the outsiders of their group with them.
BLOCK = 512
#: Places of the bitmap that tells which documents to read again.
BITS = 1 << 24
PRIME = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words, computed once for each while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


_HASHES = Hashes()


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words is one shingle."""
    ws = (text or "").encode().lower().split()
    h = np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))
    span = min(words, len(ws))
    n = max(1, len(ws) - words + 1)
    x = np.full(n, span, np.uint64)
    for k in range(span):
        x = x * PRIME + h[k : k + n]
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return np.unique(x ^ (x >> np.uint64(31)))


def set_fingerprint(whole: np.ndarray) -> int:
    """64-bit SimHash of a shingle set, unsigned."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(whole), 1 << 16):
        ones += np.unpackbits(whole[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(whole)).tobytes(), "big")


def identity(whole: np.ndarray) -> int:
    """The node of a shingle set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(whole.tobytes())).astype(np.int64))


def prefix(whole: np.ndarray, similarity: float, late: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in an order that is the same for all sets, of which two sets alike share one or more.

    Sets of Jaccard ``similarity`` or more share at least that part of either, so neither's share
    can lie wholly behind its first n - ceil(similarity n) + 1. The order is that of the hashes,
    with the sorted ``late(hash, place)`` behind all others by their places.
    """
    n = len(whole)
    size = n - int(np.ceil(similarity * n - 1e-9)) + 1
    if not len(late):
        return whole[:size]
    at = np.minimum(np.searchsorted(late["hash"], whole), len(late) - 1)
    behind = late["hash"][at] == whole
    order = np.argsort(late["place"][at[behind]])
    return np.r_[whole[~behind], whole[behind][order]][:size]


MARK = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64())])


def _marks(words: int):
    """Rows of kind 0: a document's shingle set (node), its size n and fingerprint; of kind 1: how many (n) of a run of documents hold a shingle (node)."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        h, times = np.unique(np.concatenate(held), return_counts=True)
        some = times > 2
        n = int(some.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(h[some].view(np.int64)), pa.array(times[some].astype(np.int64)), pa.nulls(n, pa.int64())], schema=MARK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            sets = [shingles(t, words) for t in common.texts(batch)]
            fps = np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), batch.column("doc_id"), batch.column("text_hash"), pa.array([identity(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps)], schema=MARK)
            held += sets
            size += sum(map(len, sets))
            if size > 1 << 21:
                yield often(held)
                held, size = [], 0
        if held:
            yield often(held)
        del held
        common.release()

    return run


DEALT = pa.schema([("range", pa.int64()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
ALONE, CROWD, PAIR, LATER = range(4)


def _stars(keys: np.ndarray, nodes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, a, b): each group's first node with its others, blocks of up to 256 of them."""
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    some = place > 0
    with np.errstate(over="ignore"):
        block = (keys.view(np.uint64) * PRIME + (place >> 8).astype(np.uint64)).view(np.int64)
    return block[some], np.repeat(nodes[starts], sizes)[some], nodes[some]


def _sorted_groups(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) in order, with starts and sizes of the keys' groups."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    if len(keys):
        new = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])]
        keys, nodes = keys[new], nodes[new]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys, nodes, starts, np.diff(np.r_[starts, len(keys)])


def _deal(words: int, similarity: float, late, ranges: int, small: int, most: int):
    """Prefix shingles with their nodes, dealt to ranges of shingles as packed arrays.

    A shingle that over ``small`` texts of one run hold leaves the run as its first node alone
    (CROWD): the others are paired with that one (PAIR) and wait for the second round (LATER).
    """

    def packed(held: list[tuple[np.ndarray, int]], run: int) -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in held]).view(np.int64)
        nodes = np.repeat(np.array([n for _, n in held], np.int64), [len(k) for k, _ in held])
        keys, nodes, starts, sizes = _sorted_groups(keys, nodes)
        rows = []
        large = np.repeat(sizes > small, sizes)
        if large.any():
            k, n = keys[large], nodes[large]
            own = sizes[sizes > small]
            first = np.cumsum(own) - own
            rows.append((run % ranges, PAIR, *(v.tobytes() for v in _stars(k, n, first, own))))
            rows.append((run % ranges, LATER, k.tobytes(), n.tobytes(), None))
        for kind, k, n in ((ALONE, keys[~large], nodes[~large]), (CROWD, keys[starts[sizes > small]], nodes[starts[sizes > small]])):
            place = (k.view(np.uint64) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                part = order[cuts[r] : cuts[r + 1]]
                rows.append((r, kind, k[part].tobytes(), n[part].tobytes(), None))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], DEALT.types[j]) for j in range(5)], schema=DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0
        for batch in batches:
            for text in common.texts(batch):
                s = shingles(text, words)
                node = identity(s)
                if node not in seen:
                    seen.add(node)
                    held.append((prefix(s, similarity, late.value), node))
                    size += len(held[-1][0])
                if size >= most:
                    yield packed(held, hash(node))
                    held, seen, size = [], set(), 0
        if held:
            yield packed(held, hash(held[-1][1]))
        del held, seen
        common.release()

    return run


MET = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _meet(small: int):
    """Rows of kind PAIR: (block, a, b) to compare; of kind LATER: a node (a) of a large group (key)."""

    def out(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(a), pa.nulls(len(key), pa.int64()) if b is None else pa.array(b)], schema=MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.grouped(batches, "range", 1):
            kinds = rows.column("kind").to_pylist()
            cells = [rows.column(c).to_pylist() for c in "xyz"]
            array = lambda c, *which: np.frombuffer(b"".join(cells[c][k] for k, x in enumerate(kinds) if x in which), np.int64)  # noqa: E731, B023
            yield out(PAIR, array(0, PAIR), array(1, PAIR), array(2, PAIR))
            yield out(LATER, array(0, LATER), array(1, LATER), None)
            keys, nodes, starts, sizes = _sorted_groups(array(0, ALONE, CROWD), array(1, ALONE, CROWD))
            large = (sizes > small) | np.isin(keys[starts], np.unique(array(0, CROWD)))
            each = np.repeat(large, sizes)
            if each.any():
                k, n, own = keys[each], nodes[each], sizes[large]
                yield out(PAIR, *_stars(k, n, np.cumsum(own) - own, own))
                yield out(LATER, k, n, None)
            few = np.repeat(~large & (sizes > 1), sizes)
            place = np.arange(len(keys)) - np.repeat(starts, sizes)
            for step in range(1, int(sizes[~large].max(initial=1))):
                j = np.flatnonzero(few & (place >= step))
                if len(j):
                    yield out(PAIR, keys[j], nodes[j - step], nodes[j])
            rows, cells, array, keys, nodes, place, few = (None,) * 7
        common.release()

    return run


def _outsiders(similarity: float):
    """Links (a, b) between the outsiders of a group, which come one by one, and the block of its nodes that is held before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sets, columns, joined = None, {}, [], None, common.UnionFind()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for group, stream, node, n, fp, part, outside, whole in zip(*(batch.column(c).to_pylist() for c in ("group", "stream", "node", "n", "fp", "part", "outside", "whole")), strict=True):
                if group != at:
                    at, held, sets, columns, joined = group, {}, [], None, common.UnionFind()
                x = _unpacked(whole)
                if not stream:
                    if node not in held:
                        held[node] = (node, n, fp, part, outside)
                        sets.append(x)
                    continue
                if columns is None:
                    columns = [np.array(c, np.int64) for c in zip(*held.values(), strict=True)] or [np.zeros(0, np.int64)] * 5
                nodes, sizes, fps, parts, outs = columns
                near = (parts != part) & (np.minimum(sizes, n) >= similarity * np.maximum(sizes, n) - 1e-6) & ((outs == 0) | (nodes > node))
                near &= (np.minimum(sizes, n) < SURE) | (np.bitwise_count((fps ^ fp).view(np.uint64)) <= WIDE)
                for k in np.flatnonzero(near).tolist():
                    if joined.find(part) != joined.find(int(parts[k])) and _alike(x, sets[k], similarity):
                        joined.link(part, int(parts[k]))
                        found.append((node, int(nodes[k])))
            yield _edges(found)
        del held, sets, columns, joined
        common.release()

    return run


def _packed(whole: np.ndarray) -> bytes:
    """A shingle set as it is sent: the upper 40 bits of its hashes, in order."""
    return whole.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view(">u8").ravel().astype(np.uint64)


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is as asked for."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=common.EDGE)


def _reread(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, use, ddl: str) -> DataFrame:
    """What ``use`` makes of one document for each node of ``wanted(node)``, and of few others.

    No text is exchanged: places of the documents wanted are marked in a bitmap of BITS bits that every
    task has, and whatever else lies at such a place is read too.
    """
    place = lambda doc_id, text_hash: F.pmod(F.xxhash64(doc_id, text_hash), F.lit(BITS))
    ends = wanted.select("node").distinct().join(nodes, "node").select(place("rep.doc_id", "rep.text_hash").alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    marked = ends.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(BITS >> 6, np.int64)
    bitmap[marked.column("at").to_numpy()] = marked.column("bits").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def picked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("place").to_numpy()
                batch = batch.filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1))
                if batch.num_rows:
                    yield batch

        yield from use(picked())

    return texts.select("text", place("doc_id", "text_hash").alias("place")).mapInArrow(run, ddl)


def _sets(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Whole shingle sets ``(node, whole)``, packed, of the nodes of ``wanted(node)`` and of few others, some of them repeated."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in sets], pa.int64()), pa.array([_packed(s) for s in sets], pa.binary())], names=["node", "whole"])
        common.release()

    return _reread(wanted, texts, nodes, read, "node long, whole binary")


def _compared(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs(key, a, b)`` whose whole shingle sets are alike; a set is sent once to each block (key) of pairs that needs it."""
    pairs = common.materialise(pairs, "pairs")
    need = pairs.select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            found = []
            for key, whole, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "whole", "a", "b")), strict=True):
                if key != at:
                    at, held = key, {}
                if whole is not None:
                    held[a] = _unpacked(whole)
                    continue
                if _alike(held[a], held[b], similarity):
                    found.append((a, b))
            yield _edges(found)
        del held
        common.release()

    sets = need.join(_sets(need, texts, nodes, words), "node").select("key", "whole", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"))
    both = sets.union(pairs.select("key", F.lit(None).cast("binary"), "a", "b"))
    return both.repartition("key").sortWithinPartitions("key", F.col("whole").isNull()).mapInArrow(decide, "a long, b long")


def _worth_it(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Distinct ``pairs(key, a, b)`` of different parts whose sizes and fingerprints allow ``similarity``; ``nodes(node, n, fp, part)``."""
    side = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "fp", "part")))
    one = pairs.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").groupBy("a", "b").agg(F.min("key").alias("key"))
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    near = (least < SURE) | (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= WIDE)
    return one.join(side("a"), "a").join(side("b"), "b").where((F.col("part_a") != F.col("part_b")) & (least >= similarity * most - 1e-6) & near).select("key", "a", "b")


def _order(often: DataFrame) -> np.ndarray:
    """The MOST most frequent shingles of ``often(key, n)`` and their places, by hash; the most frequent comes last."""
    top = often.orderBy(F.desc("n"), "key").limit(MOST).toArrow()
    late = np.zeros(top.num_rows, [("hash", np.uint64), ("place", np.int64)])
    late["hash"] = top.column("key").to_numpy().view(np.uint64)
    late["place"] = np.arange(len(late), 0, -1)
    return np.sort(late, order="hash")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, small: int = SMALL, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """``(doc_id, text_hash, component_id, kept)`` for every document, joining those alike in ``similarity`` or more of their ``words``-word shingles.

    ``component_id`` is the smallest doc_id reachable, ``kept`` tells the one document of each
    component that has it (of several texts under one doc_id, the one of smallest
    ``text_hash``, which is ``xxhash64`` of the text with null as empty).

    Texts of equal shingle sets are one node. SimHashes of the sets that differ in three bits or
    less, found through the Gray-order index, are compared first, and what is alike is joined.
    A similarity of 0.8 may differ in ten bits, which no index of 64 bits reaches, so for the
    rest all nodes are compared that share a shingle of their prefixes, which no pair of
    ``similarity`` or more can avoid, and whose fingerprints differ in at most WIDE bits. Whole
    shingle sets decide every pair. Null and empty texts are copies of each other; rows with a
    null doc_id take part, and are kept only if no row of their component has a doc_id; repeated
    rows stay repeated; an empty table gives no rows. ``small``, ``run`` and ``block`` (SMALL,
    RUN, BLOCK) deal out the work and don't change results.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    made = common.materialise(texts.mapInArrow(_marks(words), "kind int, doc_id long, text_hash long, node long, n long, fp long"), "marks")
    every = made.where("kind = 0")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash"))
    nodes = common.materialise(every.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), head.alias("rep")), "nodes")
    parted = lambda labels: nodes.join(labels, "node", "left").select("node", "n", "fp", F.coalesce("component", "node").alias("part"))
    stars = lambda labels: labels.select(F.col("component").alias("a"), F.col("node").alias("b"))

    joined = lambda edges: common.components(common.materialise(edges, "alike"))

    firsts = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    equal = nodes.select("fp", F.col("node").alias("b")).join(firsts.withColumnRenamed("node", "a"), "fp").select("a", "b")
    close = equal.union(links(firsts)).select(F.xxhash64("a", F.pmod("b", F.lit(1024))).alias("key"), "a", "b")
    labels = joined(_compared(_worth_it(close, nodes.withColumn("part", F.col("node")), similarity), texts, nodes, words, similarity))

    often = made.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).select(F.col("node").alias("key"), "n")
    wanted, left = None, None
    while True:
        held = spark.sparkContext.broadcast(_order(often))
        chosen = nodes if wanted is None else nodes.join(wanted, "node")
        keys = chosen.agg(F.sum(F.col("n") * (1 - similarity) + 1)).first()[0] or 0
        ranges = max(spark.sparkContext.defaultParallelism, int(keys) // run + 1)
        deal, ddl = _deal(words, similarity, held, ranges, small, run), "range long, kind int, x binary, y binary, z binary"
        dealt = texts.select("text").mapInArrow(deal, ddl) if wanted is None else _reread(wanted, texts, nodes, deal, ddl)
        met = common.materialise(dealt.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_meet(small), "kind int, key long, a long, b long"), "met")
        alike = _compared(_worth_it(met.where(F.col("kind") == PAIR), parted(labels), similarity), texts, nodes, words, similarity)
        labels = joined(alike.union(stars(labels)))

        # Two nodes alike, not yet joined, now share a large group. Their prefixes in any other order meet as well, so the
        # nodes of such groups alone are dealt once more, with the shingles now known to be common behind all others.
        waiting = common.materialise(met.where(F.col("kind") == LATER).select("key", F.col("a").alias("node")).distinct().join(parted(labels), "node").select("key", "node", "n", "fp", "part"), "waiting")
        shares = waiting.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
        tops = common.materialise(shares.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("n")).where("parts > 1"), "tops")
        wanted = common.materialise(waiting.join(tops.select("key"), "key").select("node").distinct(), "wanted")
        before, left = left, wanted.count()
        if not left or before is not None and left > before // 2:
            break
        often = common.materialise(often.union(tops.select("key", "n")).groupBy("key").agg(F.max("n").alias("n")), "often")
    if left:
        apart = common.materialise(waiting.join(tops.drop("n"), "key").select("main", "node", "n", "fp", "part").distinct(), "apart")
        blocks = apart.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
        placed = apart.join(blocks, "main").withColumn("outside", (F.col("part") != F.col("main")).cast("long"))
        own = F.array(F.struct(F.lit(False).alias("stream"), F.pmod("node", "blocks").alias("block")))
        each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(F.lit(True).alias("stream"), b.alias("block")))
        dealt = placed.withColumn("place", F.explode(F.when(F.col("outside") == 1, F.concat(own, each)).otherwise(own)))
        grouped = dealt.select(F.xxhash64("main", "place.block").alias("group"), "place.stream", "node", "n", "fp", "part", "outside").join(_sets(apart, texts, nodes, words), "node")
        alike = grouped.repartition("group").sortWithinPartitions("group", "stream").mapInArrow(_outsiders(similarity), "a long, b long")
        labels = joined(alike.union(stars(labels)))
    labels = common.materialise(labels, "labels")
    parts = every.select("doc_id", "text_hash", "node").join(labels, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("part"))
    # only what has several rows, and a table of its own, so that a component of very many documents can be split in the join
    heads = common.materialise(parts.groupBy("part").agg(head.alias("head"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "heads")
    alone = F.col("head").isNull()
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash")))
    return parts.join(heads, "part", "left").select("doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_copies`, whatever other columns there are.

    Of repeated rows (one doc_id and text) that with the smallest hash of all its columns stays.
    Only texts that may be among the removed or repeated ones are exchanged.
    """
    fates = near_copies(docs, words, similarity).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("_near_kept"), F.count(F.lit(1)).alias("_near_n")).where("not _near_kept or _near_n > 1")
    fates = common.materialise(fates.select(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash"), "_near_kept", "_near_n"), "fates")
    hashed = docs.withColumn("_near_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    sure, rest = common.suspects(hashed, "_near_text", fates, "_near_hash")
    judged = rest.join(fates, (F.col("_near_text") == F.col("_near_hash")) & F.col("doc_id").eqNullSafe(F.col("_near_id")), "left")
    order = Window.partitionBy("doc_id", "_near_text").orderBy(F.xxhash64(*docs.columns))
    once = judged.where("_near_kept").withColumn("_near_row", F.row_number().over(order)).where("_near_row = 1")
    return sure.select(*docs.columns).union(judged.where("_near_kept is null").select(*docs.columns)).union(once.select(*docs.columns))
