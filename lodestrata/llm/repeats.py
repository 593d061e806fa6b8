"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

What is repeated is decided among sorted suffixes. To sort few of them, suffixes start at
anchors only: in every window of ``span`` bytes the smallest hash of KMER bytes marks an
anchor, the same one wherever the window's bytes occur. A window belongs to its leftmost
smallest anchor, so two equal windows belong to suffixes that share KMER bytes or more, with
the windows at equal offsets before the anchor.

1. Anchor hashes are exchanged, five bytes each, to find those that occur more than once: no
   other suffix can be part of a repeat, so none of them is sorted or moved.
2. Each task sorts the suffixes of its documents' remaining anchors into runs, settles what is
   repeated within a run, front-codes what is left (the bytes that a suffix shares with the one
   before aren't written) and sends each range of the run to the task of that range.
3. A loser tree merges the runs of a range. Each contender carries the length of its common
   prefix with the last winner, so bytes known to be equal are never compared again.
4. Sorted suffixes with their common prefixes, and the bytes before the anchors sorted likewise,
   give classes of equal windows; all but the first window of a class are repeats.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common

KMER = 32
#: Anchors that a task gathers into one run, and bytes hashed at a time.
RUN = 150_000
BLOCK = 1 << 20
#: Documents expected in the sample that gives the ranges' boundaries.
SAMPLE = 4000
NONE = -(1 << 63)
HEAD = 12


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed, nonzero 64-bit hash of the KMER bytes from each place."""
    with np.errstate(over="ignore"):
        h, width, factor = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
        while width < KMER:
            h = h[:-width] * factor + h[width:]
            factor = factor * factor
            width *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def _slide(x: np.ndarray, size: int, f) -> np.ndarray:
    """f over each ``size`` neighbours."""
    width = 1
    while width * 2 <= size:
        x = f(x[:-width], x[width:])
        width *= 2
    return f(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def anchors(data: np.ndarray, stops: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of documents laid end to end; ``stops`` are their ends.

    Only windows within one document mark anchors.
    """
    reach = span - KMER
    places, hashes = [], []
    last = 0
    for first in range(0, max(0, len(data) - span + 1), BLOCK):
        stop = min(len(data) - span + 1, first + BLOCK)  # window starts of this block
        low = max(0, first - reach)
        h = kmer_hashes(data[low : stop - 1 + span])
        least = _slide(h, reach + 1, np.minimum)  # by window start, from low
        starts = np.arange(low, low + len(least))
        end = stops[np.minimum(np.searchsorted(stops, starts, "right"), len(stops) - 1)]
        least[starts + span > end] = 0
        most = _slide(np.r_[np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)], reach + 1, np.maximum)
        at = np.flatnonzero(most[: len(h)] == h)
        got = h[at]
        at = at + low
        new = at >= last
        places.append(at[new])
        hashes.append(got[new])
        last = int(at[-1]) + 1 if len(at) else last
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def owned(place: np.ndarray, h: np.ndarray, start: np.ndarray, stop: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows that belong to each anchor; start and stop: of its document."""
    reach = span - KMER
    low, high = np.maximum(place - reach, start), np.minimum(place, stop - span)
    for step in range(1, len(place)):
        near = np.flatnonzero((place[step:] - place[:-step] <= reach) & (start[step:] == start[:-step]))
        if not len(near):
            break
        left, right = near, near + step
        beaten = h[left] <= h[right]
        low[right[beaten]] = np.maximum(low[right[beaten]], place[left[beaten]] + 1)
        beaten = ~beaten
        high[left[beaten]] = np.minimum(high[left[beaten]], place[right[beaten]] - reach - 1)
    return low, high


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), stops - sizes, stops


def _short(h: np.ndarray) -> np.ndarray:
    """The five bytes of a hash that are exchanged."""
    return h & np.uint64(0xFFFFFFFFFF)


def _hashes(span: int, buckets: int):
    """Rows (bucket, docs, counts, hashes): anchor hashes of a batch of documents, dealt out by other bits of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            doc, h = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held.clear()
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            doc, h, bucket = doc[order], _short(h[order]), bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(h) else np.zeros(1, np.int64)
            rows = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                d = doc[a:b]
                at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                rows.append((int(bucket[a]), d[at].tobytes(), np.diff(np.r_[at, len(d)]).astype(np.uint32).tobytes(), h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "docs", "counts", "hashes"])

        n = 0
        for batch in batches:
            data, starts, stops = _join([t.encode() for t in common.texts(batch)])
            place, h = anchors(data, stops, span)
            k = batch.column("k").to_numpy()
            held.append((k[np.searchsorted(stops, place, "right")], h))
            n += len(h)
            if n > 1_000_000:
                yield out()
                n = 0
        if held:
            yield out()
        common.release()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's hashes, those that occur more than once, by document."""
    held = defaultdict(list)
    for batch in batches:
        for bucket, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[bucket].append(parts)
    for parts in held.values():
        doc = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)) for d, c, _ in parts])
        raw = np.concatenate([np.frombuffer(h, np.uint8).reshape(-1, 5) for _, _, h in parts])
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        h = wide.view("<u8").ravel()
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order] = np.r_[same, False] | np.r_[False, same]
        doc, raw = doc[twice], raw[twice]
        order = np.argsort(doc, kind="stable")
        doc, raw = doc[order], raw[order]
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(1, np.int64)
        for c in range(0, len(at) - 1, 10_000):
            cut = at[c : c + 10_001].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(doc[cut[:-1]], pa.int64()), pa.array([raw[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["k", "hashes"])


class Suffixes:
    """Suffixes at anchors: bytes from the anchor on and, backwards, before it; zero beyond their lengths."""

    FIELDS = ("right", "left", "n_right", "n_left", "k", "h", "pos")

    def __init__(self, right, left, n_right, n_left, k, h, pos) -> None:
        self.right, self.left, self.n_right, self.n_left, self.k, self.h, self.pos = right, left, n_right, n_left, k, h, pos

    def __len__(self) -> int:
        return len(self.k)

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(*(getattr(self, f)[at] for f in self.FIELDS))

    @staticmethod
    def concat(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, f) for p in parts]) for f in Suffixes.FIELDS))


def gather(data: np.ndarray, place, low, high, k, h, start, span: int) -> Suffixes:
    reach = span - KMER
    n_right, n_left = high + span - place, place - low
    padded = np.concatenate((np.zeros(reach, np.uint8), data, np.zeros(span, np.uint8)))
    views = np.lib.stride_tricks.sliding_window_view(padded, span)
    right = views[place + reach] * (np.arange(span) < n_right[:, None])
    before = np.lib.stride_tricks.sliding_window_view(padded, reach)[place][:, ::-1]
    left = before * (np.arange(reach) < n_left[:, None])
    return Suffixes(right.astype(np.uint8), left.astype(np.uint8), n_right.astype(np.int16), n_left.astype(np.int16), k, h, (place - start).astype(np.int64))


def byte_order(rows: np.ndarray) -> np.ndarray:
    """Order of rows as byte strings."""
    width = -rows.shape[1] % 8
    words = np.pad(rows, ((0, 0), (0, width))).view(">u8").astype(np.uint64)
    return np.lexsort(words.T[::-1])


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before."""
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.r_[0, n].astype(np.int64) if len(rows) else np.zeros(0, np.int64)


def settle(s: Suffixes, lcp: np.ndarray, span: int) -> np.ndarray:
    """For sorted suffixes, which windows (by offset before the anchor) also occur earlier."""
    reach = span - KMER
    repeat = np.zeros((len(s), reach + 1), bool)
    linked = np.r_[lcp[1:] >= KMER, False] | (lcp >= KMER) if len(s) else np.zeros(0, bool)
    some = np.flatnonzero(linked)
    if not len(some):
        return repeat
    t = s.take(some)
    # a suffix left out shares fewer than KMER bytes with its neighbours
    common_right = np.where(lcp[some] >= KMER, lcp[some], 0)
    back = byte_order(t.left)
    common_left = common_prefixes(t.left[back])
    first, last = span - t.n_right, t.n_left
    order = np.lexsort((t.pos, t.h, t.k))
    for offset in range(reach + 1):
        own = order[(first[order] <= offset) & (offset <= last[order])]
        if len(own) < 2:
            continue
        right_class = np.cumsum(common_right < span - offset)
        left_class = np.empty(len(t), np.int64)
        left_class[back] = np.cumsum(common_left < offset)
        key = right_class[own] * (len(t) + 1) + left_class[own]
        _, kept = np.unique(key, return_index=True)
        again = np.ones(len(own), bool)
        again[kept] = False
        repeat[some[own[again]], offset] = True
    return repeat


def intervals(s: Suffixes, repeat: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(k, h, from, to) of the bytes that repeated windows cover."""
    wide = np.pad(repeat.astype(np.int8), ((0, 0), (1, 1)))
    change = np.diff(wide, axis=1)
    row, low = np.nonzero(change == 1)
    _, high = np.nonzero(change == -1)
    return s.k[row], s.h[row], s.pos[row] - (high - 1), s.pos[row] - low + span


def shrink(s: Suffixes, repeat: np.ndarray, span: int) -> Suffixes:
    """What still has windows that aren't known to be repeats, cut down to the bytes these need."""
    reach = span - KMER
    offset = np.arange(reach + 1)
    open_ = (offset >= span - s.n_right[:, None]) & (offset <= s.n_left[:, None]) & ~repeat
    some = np.flatnonzero(open_.any(axis=1))
    t, open_ = s.take(some), open_[some]
    t.n_right = (span - open_.argmax(axis=1)).astype(np.int16)
    t.n_left = (reach - open_[:, ::-1].argmax(axis=1)).astype(np.int16)
    t.right = t.right * (np.arange(span) < t.n_right[:, None]).astype(np.uint8)
    t.left = t.left * (np.arange(reach) < t.n_left[:, None]).astype(np.uint8)
    return t


def front_code(s: Suffixes) -> bytes:
    """A sorted run as bytes; of each suffix only what the one before doesn't share."""
    lcp = np.minimum(common_prefixes(s.right), s.n_right)
    tails = s.right[(np.arange(s.right.shape[1]) >= lcp[:, None]) & (np.arange(s.right.shape[1]) < s.n_right[:, None])]
    lefts = s.left[np.arange(s.left.shape[1]) < s.n_left[:, None]]
    parts = [lcp.astype(np.uint16), s.n_right.astype(np.uint16), s.n_left.astype(np.uint16), s.k, s.h, s.pos.astype(np.uint32), tails, lefts]
    return np.array([len(s)], np.int64).tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


class Run:
    """A front-coded run, read suffix by suffix."""

    def __init__(self, blob: bytes, span: int) -> None:
        n = self.n = int(np.frombuffer(blob, np.int64, 1)[0])
        at, out = 8, []
        for kind in (np.uint16, np.uint16, np.uint16, np.int64, np.int64, np.uint32):
            out.append(np.frombuffer(blob, kind, n, at))
            at += n * out[-1].itemsize
        lcp, n_right, n_left, self.k, self.h, self.pos = out
        self.n_right, self.n_left = n_right.astype(np.int64), n_left.astype(np.int64)
        self.lcp = lcp.tolist()
        sizes = self.n_right - lcp
        cut = at + np.r_[0, np.cumsum(sizes)]
        self.lefts = np.frombuffer(blob, np.uint8, int(self.n_left.sum()), int(cut[-1]))
        self.text, last, cut = [], b"", cut.tolist()
        for k, (m, a, b) in enumerate(zip(self.lcp, cut[:-1], cut[1:], strict=True)):
            text = (last[:m] + blob[a:b]).ljust(span, b"\0")
            if text == last:  # cut suffixes may be alike beyond the bytes that they need
                self.lcp[k] = span
            self.text.append(text)
            last = text

    def left_rows(self, reach: int) -> np.ndarray:
        rows = np.zeros((self.n, reach), np.uint8)
        rows[np.arange(reach) < self.n_left[:, None]] = self.lefts
        return rows


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs (strings, common prefixes within the run) by a loser tree: run, place in run, common prefix of each string in turn.

    A node keeps the loser of its last match and how much of it the winner shared. A contender
    that shares more with the last winner than its rival is the smaller one; only at equal
    lengths are bytes compared, and those from that length on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    texts = [r[0] for r in runs] + [[]] * (width - len(runs))
    shared = [r[1] for r in runs] + [[]] * (width - len(runs))
    ends = [len(t) for t in texts]
    place, known = [0] * width, [0] * width  # of each run's foremost string
    loser = [-1] * width

    def beats(a: int, b: int) -> bool:
        """Whether a's string comes first; the loser's known prefix becomes what it shares with the winner."""
        if place[a] >= ends[a]:
            return False
        if place[b] >= ends[b]:
            return True
        ka, kb = known[a], known[b]
        if ka != kb:
            return ka > kb
        x, y = texts[a][place[a]], texts[b][place[b]]
        if x == y:
            known[b] = len(x)
            return True
        diff = int.from_bytes(x[ka:], "big") ^ int.from_bytes(y[ka:], "big")
        n = len(x) - (diff.bit_length() + 7) // 8
        if x[n] < y[n]:
            known[b] = n
            return True
        known[a] = n
        return False

    winner = [*([-1] * width), *range(width)]
    for node in range(width - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        if beats(a, b):
            winner[node], loser[node] = a, b
        else:
            winner[node], loser[node] = b, a
    top = winner[1] if width > 1 else 0
    out_run, out_place, out_known = [], [], []
    for _ in range(sum(ends)):
        k = place[top]
        out_run.append(top)
        out_place.append(k)
        out_known.append(known[top])
        place[top] = k = k + 1
        if k < ends[top]:
            known[top] = shared[top][k]
        node = (top + width) >> 1
        while node:
            rival = loser[node]
            if not beats(top, rival):
                loser[node], top = top, rival
            node >>= 1
    return out_run, out_place, out_known


def _runs(span: int, bounds: list[bytes], ranges: int):
    """Rows (range, kind, blob): front-coded slices of sorted runs (0), and what was settled in a run (1)."""
    edges = np.array(bounds, "S16")  # in order; zero bytes at the end of a head don't count, nor do they in comparisons

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[Suffixes] = []

        def out() -> pa.RecordBatch:
            s = Suffixes.concat(held)
            held.clear()
            s = s.take(byte_order(s.right))
            repeat = settle(s, common_prefixes(s.right), span)
            found = intervals(s, repeat, span)
            s = shrink(s, repeat, span)
            s = s.take(byte_order(s.right))
            # suffixes alike in their first KMER bytes must meet: boundaries are of fewer
            head = np.zeros((len(s), 16), np.uint8)
            head[:, :HEAD] = s.right[:, :HEAD]
            target = np.searchsorted(edges, head.view("S16").ravel(), side="right")
            cut = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True]) if len(s) else np.zeros(1, np.int64)
            rows = [(int(target[a]), 0, front_code(s.take(np.arange(a, b)))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            if len(found[0]):
                rows.append((task % ranges, 1, b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in found)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["range", "kind", "blob"])

        n = 0
        for batch in batches:
            hashes, copies = batch.column("hashes").to_pylist(), batch.column("copies").to_pylist()
            ks, hs = batch.column("k").to_pylist(), batch.column("h").to_pylist()
            own = [i for i, (x, c) in enumerate(zip(hashes, copies, strict=True)) if x and hs[i] not in (c or ())]
            if not own:
                continue
            texts = common.texts(batch)
            data, starts, stops = _join([texts[i].encode() for i in own])
            place, h = anchors(data, stops, span)
            doc = np.searchsorted(stops, place, "right")
            wanted = np.concatenate([np.frombuffer(b"".join(hashes[i]), np.uint8).reshape(-1, 5) for i in own])
            wide = np.zeros((len(wanted), 8), np.uint8)
            wide[:, :5] = wanted
            want_doc = np.repeat(np.arange(len(own)), [sum(map(len, hashes[i])) // 5 for i in own])
            salt = lambda d, x: (x << np.uint64(24)) ^ d.astype(np.uint64)  # noqa: E731  40 bits and the place in the batch
            keep = np.isin(salt(doc, _short(h)), salt(want_doc, wide.view("<u8").ravel()))
            low, high = owned(place, h, starts[doc], stops[doc], span)
            keep &= low <= high
            at = np.flatnonzero(keep)
            for c in range(0, len(at), RUN):
                p = at[c : c + RUN]
                d = doc[p]
                held.append(gather(data, place[p], low[p], high[p], np.array([ks[i] for i in own], np.int64)[d], np.array([hs[i] for i in own], np.int64)[d], starts[d], span))
                n += len(p)
                if n >= RUN:
                    yield out()
                    n = 0
        if held:
            yield out()
        common.release()

    return run


def _merged(span: int):
    """Rows (k, h, spans): merges the runs of a range and settles what is repeated."""
    reach = span - KMER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = defaultdict(list), []
        for batch in batches:
            for target, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    found.append(np.frombuffer(blob, np.int64).reshape(4, -1))
                else:
                    held[target].append(blob)
        for blobs in held.values():
            runs = [Run(b, span) for b in blobs]
            which, where, lcp = merge([(r.text, r.lcp) for r in runs])
            offset = np.r_[0, np.cumsum([r.n for r in runs])]
            order = offset[np.array(which, np.int64)] + np.array(where, np.int64)
            right = np.frombuffer(b"".join(t for r in runs for t in r.text), np.uint8).reshape(-1, span)
            joined = lambda f: np.concatenate([getattr(r, f) for r in runs])
            every = Suffixes(right, np.concatenate([r.left_rows(reach) for r in runs]), joined("n_right"), joined("n_left"), joined("k"), joined("h"), joined("pos").astype(np.int64))
            lcp = np.array(lcp, np.int64)
            breaks = np.flatnonzero(lcp < KMER)  # groups end here
            at = 0
            while at < len(order):
                stop = breaks[np.searchsorted(breaks, at + RUN)] if np.searchsorted(breaks, at + RUN) < len(breaks) else len(order)
                s = every.take(order[at:stop])
                part = lcp[at:stop].copy()
                part[0] = 0
                found.append(np.stack(intervals(s, settle(s, part, span), span)))
                at = stop
        if not found:
            return
        k, h, a, b = np.concatenate(found, axis=1)
        order = np.lexsort((a, h, k))
        k, h, a, b = k[order], h[order], a[order], b[order]
        cut = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1]), True]) if len(k) else np.zeros(1, np.int64)
        pairs = np.stack((a, b), axis=1).astype(np.uint32)
        for c in range(0, len(cut) - 1, 10_000):
            at = cut[c : c + 10_001].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(k[at[:-1]], pa.int64()), pa.array(h[at[:-1]], pa.int64()), pa.array([pairs[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["k", "h", "spans"])
        del k, h, a, b, order, cut, pairs, found, held
        common.release()

    return run


def cut_out(data: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many were removed, and in how many maximal runs."""
    if not len(spans):
        return data, 0, 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
    top = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > top[:-1]])
    a, b = spans[new, 0], np.minimum(top[np.r_[new[1:] - 1, len(top) - 1]], len(data))
    pieces = [data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)]
    return b"".join(pieces), int((b - a).sum()), len(a)


def _sample(docs: DataFrame, n: int, span: int, ranges: int) -> list[bytes]:
    """Boundaries of the ranges, from the anchors of a bounded sample of documents, which grows with the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, stops = _join([t.encode() for t in common.texts(batch)])
            place, _ = anchors(data, stops, span)
            place = place[:: max(1, len(place) // 4000)]
            yield pa.RecordBatch.from_arrays([pa.array([data[p : p + HEAD].tobytes() for p in place.tolist()], pa.binary())], names=["head"])

    chance = min(1.0, max(SAMPLE, ranges) / max(1, n))
    some = docs.where(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 20)) < int(chance * (1 << 20)) + 1)
    heads = sorted(r[0] for r in some.select("text").mapInArrow(run, "head binary").limit(max(200_000, 20 * ranges)).collect())
    return [bytes(heads[len(heads) * i // ranges]) for i in range(1, ranges)] if heads else []


def remove_repeats(docs: DataFrame, span: int = 100, with_text: bool = False) -> DataFrame:
    """Remove every byte that a ``span``-byte string covers which also starts earlier.

    Earlier is in a document of smaller doc_id, or in the same document before. Texts are UTF-8
    bytes (null: none), strings never cross documents, overlaps count, and strings are judged on
    the input. Rows ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``; with ``with_text``
    all columns of ``docs`` instead, the text cut and n_chars, if there, counted anew (a character
    that is cut in two goes).

    Equal texts are one document to the sort: all but the first lose everything, if they are
    ``span`` bytes long. Repeated rows (same doc_id and text) are one document and get the same
    result each; of rows with one doc_id but different texts that of smaller hash is the earlier;
    a null doc_id comes before all others; short and empty texts stay; an empty table gives no
    rows.

    A group of suffixes that share KMER bytes is settled in one task; runs settle their own
    repeats first, so what reaches that task are the contexts that differ, not the copies.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id"), F.lit(NONE))
    slim = docs.select(key.alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    n, size = slim.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    ranges = max(n_parts, -(-(size or 0) // (32 << 20)))
    bounds = _sample(slim, n, span, ranges)

    repeated = slim.select("k", "text").mapInArrow(_hashes(span, ranges), "bucket int, docs binary, counts binary, hashes binary").repartition(ranges, "bucket").mapInArrow(_repeated, "k long, hashes binary")
    thin = slim.select("k", "h", F.unhex(F.md5(F.col("text").cast("binary"))).alias("md5"), F.octet_length("text").alias("n"))
    # a table of its own, so that a text of very many documents can be split in the join
    first = common.materialise(thin.groupBy("md5").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").drop("last"), "first-copies")
    copies = thin.join(first, "md5").where("k > first").select("k", "h", "n")
    notes = repeated.select("k", "hashes", F.lit(None).cast("long").alias("copy")).union(copies.select("k", F.lit(None).cast("binary"), F.col("h")))
    notes = notes.repartition(ranges, "k").groupBy("k").agg(F.collect_list("hashes").alias("hashes"), F.collect_set("copy").alias("copies"))

    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if with_text else []
    whole = docs.select(key.alias("k"), F.xxhash64(text).alias("h"), text.alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("rest")).repartition(ranges, "k")
    runs = whole.join(notes, "k", "left").select("k", "h", "text", "hashes", "copies").mapInArrow(_runs(span, bounds, ranges), "range int, kind int, blob binary")
    spans = runs.repartition(ranges, "range").mapInArrow(_merged(span), "k long, h long, spans binary")
    gone = spans.union(copies.where(F.col("n") >= span).select("k", "h", F.lit(None).cast("binary")))
    gone = gone.repartition(ranges, "k").groupBy("k").agg(F.collect_list(F.struct("h", F.coalesce("spans", F.lit(b"")).alias("spans"))).alias("gone"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, h, gone in zip(common.texts(batch), batch.column("h").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                data = t.encode()
                own = [g["spans"] for g in gone or () if g["h"] == h]
                blob = np.frombuffer(b"".join(own), np.uint32).reshape(-1, 2) if all(own) else np.array([[0, len(data)]], np.uint32)
                kept, removed, n_spans = cut_out(data, blob)
                rows.append((len(data), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("rest"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=["k", "rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = whole.join(gone, "k", "left").select("k", "h", "text", "gone", "rest")
    done = joined.mapInArrow(finish, f"k long, rest {joined.schema['rest'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    doc_id = F.when(F.col("k") != NONE, F.col("k")).cast(docs.schema["doc_id"].dataType)
    if not with_text:
        return done.select(doc_id.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    columns = {"doc_id": doc_id, "text": F.col("kept")} | {c: F.col("rest").getField(c) for c in rest}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return done.select(*(columns[c].alias(c) for c in docs.columns))
