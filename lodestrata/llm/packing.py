"""Packing documents into fixed windows by the online sum-of-squares rule."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common

#: Characters that every Unicode version in use classes alike; texts with others go to the slower library.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa0-ɏͰ-ϿЀ-џ‐-‧‰-⁞一-龥]*\Z")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Open windows that a task holds; beyond it they are carried to the next round, as all are at a task's end.
OPEN = 4096
#: Carried pieces that one task of a further round takes.
ROUND = 65_536


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its ids as a uint32 array.

    The ids are those of ``tokenizers`` for the .json file. Where the same vocabulary lies
    beside it as ranks, plain texts are encoded by the faster ``tiktoken``, which merges by
    the same ranks (the tests hold both against each other).
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    exact = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return exact
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: k for k, t in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32) if PLAIN.match(text) else exact(text)


class Packer:
    """Windows of ``size`` tokens; a level array holds how many windows are filled to each level."""

    def __init__(self, size: int, first: int) -> None:
        self.size, self.next = size, first
        self.count = np.zeros(size + 1, np.int64)  # windows by fill level; 0 and size stay 0
        self.open: list[list[list[tuple]]] = [[] for _ in range(size + 1)]
        self.n_open = 0
        self.rows: list[tuple] = []

    def _emit(self, piece: tuple, sequence: int, offset: int) -> None:
        doc, start, ids, total = piece
        self.rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, sequence, offset))

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _close(self, pieces: list[tuple]) -> None:
        sequence, at = self._new(), 0
        for piece in pieces:
            self._emit(piece, sequence, at)
            at += len(piece[2])

    def level_for(self, length: int) -> int:
        """The fill level, 0 for a new window, at which the sum of squared counts ends lowest; the fullest of several."""
        n = self.count
        after = np.zeros(self.size - length + 1, np.int64)
        levels = n[: self.size - length + 1]
        after[:] = 2 * n[length:] + 1  # one more window at level + length
        after[-1] = 0  # full windows aren't counted
        after[1:] -= 2 * levels[1:] - 1  # one fewer at level
        allowed = levels > 0
        allowed[0] = True
        best = np.where(allowed, after, np.iinfo(np.int64).max)
        return len(best) - 1 - int(np.argmin(best[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        """Cut whole windows off a document's front and place the rest."""
        total, cut = len(ids), len(ids) // self.size * self.size
        for start in range(0, cut, self.size):
            self._close([(doc, start, ids[start : start + self.size], total)])
        if cut < total:
            self.place((doc, cut, ids[cut:].copy(), total))

    def place(self, piece: tuple) -> None:
        """Add a piece to a window of the level chosen for its length."""
        length = len(piece[2])
        level = self.level_for(length)
        pieces = [piece]
        if level:
            pieces = self.open[level].pop() + pieces
            self.count[level] -= 1
            self.n_open -= 1
        if level + length == self.size:
            self._close(pieces)
            return
        self.open[level + length].append(pieces)
        self.count[level + length] += 1
        self.n_open += 1

    def carry(self) -> list[tuple]:
        """The pieces of all open windows, which are given up."""
        out = [x for level in self.open for pieces in level for x in pieces]
        self.open = [[] for _ in range(self.size + 1)]
        self.count[:] = 0
        self.n_open = 0
        return out

    def flush(self) -> None:
        """Close all open windows, cutting pieces anew so that at most one is left over.

        What is left over becomes sequences whose lengths are powers of two, which take no padding.
        """
        rest = self.carry()
        left = sum(len(x[2]) for x in rest)
        sequence, at, room = 0, 0, 0
        for doc, start, ids, total in rest:
            used = 0
            while used < len(ids):
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                    sequence, at = self._new(), 0
                take = min(room, len(ids) - used)
                self._emit((doc, start + used, ids[used : used + take], total), sequence, at)
                used, at, room, left = used + take, at + take, room - take, left - take


TYPES = [pa.int64()] * 7 + [pa.binary()]
NAMES = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"]


def _made(packer: Packer, carried: list[tuple]) -> pa.RecordBatch:
    """Finished pieces, and carried ones with their ids and no sequence, in one batch; the packer's rows are given up."""
    rows = [(*r, None) for r in packer.rows] + [(doc, start, len(ids), None, total, None, None, ids.astype("<u4").tobytes()) for doc, start, ids, total in carried]
    packer.rows = []
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(TYPES)], names=NAMES)


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 0, open_windows: int = OPEN, per_task: int = ROUND) -> DataFrame:
    """A row for each piece of each document: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    A document is its token ids, then the id ``end``. Whole windows are cut off its front; the
    rest goes, as documents come, to the fill level that keeps the sum of squared counts of
    partially filled windows lowest. Each task packs the documents it reads; what lies in windows
    that are open at its end, or beyond ``open_windows``, is carried to further rounds, in which
    fewer tasks place it, the longest first, by the same rule, up to ``per_task`` pieces each,
    until one task has the rest, or a round places less than three in ten of them. Only what the
    last round leaves open is cut anew, so that nothing is padded: there are some last sequences
    of power-of-two lengths. Sequence ids hold the round and the task, so
    they are unique. Null and empty texts are the end id alone, rows with a null doc_id are
    packed too, repeated rows are packed each, an empty table gives no rows.

    The ids are those of ``tokenizers`` (see :func:`encoder`).
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    schema = f"{SCHEMA}, ids binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(size, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
                packer.add(doc, np.append(encode(text), np.uint32(end)))
                if packer.n_open > open_windows:
                    yield _made(packer, packer.carry())
                elif len(packer.rows) > 20_000:
                    yield _made(packer, [])
        yield _made(packer, packer.carry())

    def further(number: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(size, (number << 58) + (TaskContext.get().partitionId() << 32))
            for batch in batches:
                for doc, start, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                    packer.place((doc, start, np.frombuffer(ids, "<u4"), total))
                    if packer.n_open > open_windows and not last:
                        yield _made(packer, packer.carry())
                if len(packer.rows) > 20_000:
                    yield _made(packer, [])
            if last:
                packer.flush()
            yield _made(packer, [] if last else packer.carry())

        return run

    made = common.materialise(docs.select("doc_id", "text").mapInArrow(first, schema), "packed")
    out, number, before = made.where("ids is null"), 1, None
    while n := made.where("ids is not null").count():
        left = made.where("ids is not null")
        tasks = -(-n // per_task)
        last = tasks == 1 or (before is not None and n > 0.7 * before)
        dealt = left.repartition(tasks, F.xxhash64("ids", "start")) if tasks > 1 else left.coalesce(1)
        made = common.materialise(dealt.sortWithinPartitions(F.desc("length"), F.xxhash64("ids", "doc_id", "start")).mapInArrow(further(number, last), schema), "packed")
        out, number, before = out.union(made.where("ids is null")), number + 1, n
    return out.select(*NAMES[:7])
