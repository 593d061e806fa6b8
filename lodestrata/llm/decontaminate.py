"""Benchmark passages in documents: latent semantic retrieval, then common-subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common

#: Longer items count by passages of PASSAGE words. Documents are read in chunks of CHUNK words, passages are runs of chunks.
PASSAGE, CHUNK = 60, 16
#: Words that a paraphrase may have beyond those of its item, as a share of them.
SLACK = 0.15
#: Chunks of the passages that are factorised.
ROW = 4
RANK, EXTRA = 96, 8
#: Rows of the basis; the words of a benchmark of more distinct ones share rows.
SLOTS = 1 << 16
#: Weight of benchmark passages among the rows of the factorised matrix.
OWN_WEIGHT = 10.0
#: Benchmark passages that one round of the search holds.
BLOCK = 8192
#: Least cosine of a candidate; least shares of an item's words in order, of its last third, and of its rarer words.
COSINE, COMMON, ANSWER, CONTENT = 0.4, 0.7, 0.5, 0.6
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def span(length: int) -> int:
    """Chunks that hold a paraphrase of an item of ``length`` words wherever it starts in the first."""
    return -(-(CHUNK - 1 + int(np.ceil((1 + SLACK) * length))) // CHUNK)


class Benchmark:
    """The distinct words of a benchmark, its frequent ones, and passages of items as word numbers."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocab: dict[str, int] = {}
        self.item: list[int] = []
        self.terms: list[np.ndarray] = []
        for item_id, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words(text)], np.int32)
            starts = [0] if len(ids) <= PASSAGE else [*range(0, len(ids) - PASSAGE, PASSAGE), len(ids) - PASSAGE]
            for s in starts if len(ids) else []:
                self.item.append(item_id)
                self.terms.append(ids[s : s + PASSAGE])
        df = np.zeros(len(self.vocab), np.int64)
        for ids in self.terms:
            df[np.unique(ids)] += 1
        self.frequent = df > max(3, 0.1 * len(self.terms))

    def content(self, ids: np.ndarray) -> np.ndarray:
        ids = np.unique(ids[ids >= 0])
        return ids[~self.frequent[ids]]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word's bits at a time."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := where.get(x, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Check:
    """The checks of a candidate: enough of the item's rarer words, of its words in order, and of its answer, the last third."""

    def __init__(self, bench: Benchmark, item: np.ndarray) -> None:
        self.item, self.answer = item, item[-max(1, len(item) // 3) :]
        self.content = frozenset(bench.content(item).tolist())

    def share(self, passage: np.ndarray) -> float:
        """Share of the item's words in common order with a passage, 0 if a check fails."""
        if len(self.content.intersection(passage.tolist())) < CONTENT * len(self.content):
            return 0.0
        share = lcs(self.item, passage) / len(self.item)
        return share if share >= COMMON and lcs(self.answer, passage) / len(self.answer) >= ANSWER else 0.0


class Chunks:
    """Documents of a batch in chunks; each document is followed by so many empty ones that no passage reaches the next."""

    def __init__(self, blobs: list[bytes], gap: int) -> None:
        self.ids = [np.frombuffer(b, np.int32) for b in blobs]
        n = np.array([-(-len(x) // CHUNK) for x in self.ids], np.int64)
        self.first = np.cumsum(n + gap) - n - gap
        self.count = int(self.first[-1] + n[-1] + gap) if len(n) else 0
        every = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        chunk = np.concatenate([f + np.arange(len(x)) // CHUNK for f, x in zip(self.first, self.ids, strict=True)]) if self.ids else np.zeros(0, np.int64)
        known = every >= 0
        self.terms, self.chunk = every[known], chunk[known]

    def words(self, chunk: int, n: int) -> tuple[int, np.ndarray]:
        """The document's place in the batch, and the words of ``n`` chunks from ``chunk``."""
        doc = int(np.searchsorted(self.first, chunk, "right")) - 1
        at = (chunk - int(self.first[doc])) * CHUNK
        return doc, self.ids[doc][at : at + n * CHUNK]

    def sums(self, rows: np.ndarray, step: int = 1 << 13) -> np.ndarray:
        """For each chunk the sum of its words' rows (the basis, weighed by IDF)."""
        out = np.zeros((self.count, rows.shape[1]), np.float32)
        slot = self.terms % len(rows)
        for k in range(0, len(slot), step):
            chunk = self.chunk[k : k + step]
            start = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            out[chunk[start]] += np.add.reduceat(rows[slot[k : k + step]], start, axis=0)
        return out


def project(terms: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Unit latent vectors of passages."""
    m = np.array([rows[t % len(rows)].sum(axis=0) for t in terms], np.float32).reshape(len(terms), rows.shape[1])
    return m / np.maximum(1e-12, np.linalg.norm(m, axis=1, keepdims=True))


SCANNED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("term", pa.int32()), ("n", pa.int64()), ("ids", pa.binary())])


def _scan(bench):
    """Rows of kind 0: documents as word numbers, -1 for words the benchmark lacks; of kind 1: document counts of words (-1: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = bench.value.vocab.get
        df, n_docs = np.zeros(len(bench.value.vocab), np.int64), 0
        for batch in batches:
            split = map(words, common.texts(batch))
            ids = [np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws)) for ws in split]
            n_docs += len(ids)
            for x in ids:
                df[np.unique(x[x >= 0])] += 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("doc_id"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], schema=SCANNED)
        some = np.flatnonzero(df)
        n = len(some) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[n_docs, df[some]]), pa.nulls(n, pa.binary())], schema=SCANNED)

    return run


def _rows(chunks: Chunks, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The passages that are factorised, ROW chunks each: row and slot of each word, in order, and what makes each row's TF-IDF vector one of unit length."""
    row, slot = chunks.chunk // ROW, chunks.terms % len(idf)
    if not len(row):
        return row, slot, np.zeros(0, np.float32)
    row = np.cumsum(np.r_[0, row[1:] != row[:-1]])
    key, n = np.unique(row * len(idf) + slot, return_counts=True)
    value = idf[key % len(idf)] * n
    start = np.flatnonzero(np.r_[True, np.diff(key // len(idf)) > 0])
    return row, slot, (1 / np.maximum(np.sqrt(np.add.reduceat(value * value, start)), 1e-12)).astype(np.float32)


def _forward(row: np.ndarray, slot: np.ndarray, scale: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows times a dense matrix whose rows are weighed by IDF already."""
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return np.add.reduceat(m[slot], start, axis=0) * scale[:, None]


def _back(out: np.ndarray, row: np.ndarray, slot: np.ndarray, scale: np.ndarray, y: np.ndarray) -> None:
    """Add the transposed unit rows times y to ``out``, but for the weights by IDF."""
    order = np.argsort(slot, kind="stable")
    s = slot[order]
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    out[s[start]] += np.add.reduceat((y * scale[:, None])[row[order]], start, axis=0)


def latent_basis(documents: DataFrame, bench: Benchmark, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors, each over its singular value, of the TF-IDF matrix of all passages of ``documents(ids)``, by randomised SVD.

    A Gaussian sketch goes once through A^T A, spread over the passages; its range is
    orthonormalised, and the small matrix (A Q)^T (A Q), again summed over all passages, turns
    it to the singular vectors. Only matrices of at most SLOTS rows leave the tasks.
    """
    slots = len(idf)
    width = min(slots, rank + EXTRA)
    spark = documents.sparkSession
    own = Chunks([np.r_[t, np.full(-len(t) % (ROW * CHUNK), -1, np.int32)].astype(np.int32).tobytes() for t in bench.terms], 0)

    def add(out: np.ndarray, chunks: Chunks, m: np.ndarray, back: bool, weight: float = 1.0) -> None:
        row, slot, scale = _rows(chunks, idf)
        for k in range(0, len(scale), 256):
            a, b = np.searchsorted(row, (k, k + 256))
            part = row[a:b] - k, slot[a:b], scale[k : k + 256]
            y = _forward(*part, m)
            if back:
                _back(out, *part, weight * y)
            else:
                out += weight * (y.T @ y)

    def passes(matrix: np.ndarray, back: bool) -> np.ndarray:
        weighed = (matrix * idf[:, None]).astype(np.float32)
        held = spark.sparkContext.broadcast(weighed)
        shape = (slots if back else width, width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, m = np.zeros(shape, np.float32), held.value
            for batch in batches:
                blobs = batch.column("ids").to_pylist()
                for k in range(0, len(blobs), 64):
                    part = [b + b"\xff" * (-len(b) % (4 * ROW * CHUNK)) for b in blobs[k : k + 64]]
                    add(out, Chunks(part, 0), m, back)
            some = np.flatnonzero(np.abs(out).sum(axis=1))
            for k in range(0, len(some), 1000):
                part = some[k : k + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([out[x].tobytes() for x in part], pa.binary())], names=["key", "vec"])

        out = np.zeros(shape)
        for key, v in _summed(documents.select("ids").mapInArrow(run, "key int, vec binary")):
            out[key] = v
        add(out, own, weighed, back, OWN_WEIGHT)
        return out * idf[:, None] if back else out

    q, _ = np.linalg.qr(passes(np.random.default_rng(seed).standard_normal((slots, width)), True))
    worth, turn = np.linalg.eigh(passes(q, False))
    order = np.argsort(-worth)[: min(rank, width)]
    order = order[worth[order] > 1e-6 * worth.max()]
    return (q @ turn[:, order] / np.sqrt(worth[order])).astype(np.float32)


def _summed(df: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Sum of the vectors of each key, of which there are at most SLOTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, blob in zip(batch.column("key").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                v = np.frombuffer(blob, np.float32).astype(np.float64)
                total[key] = total[key] + v if key in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["key", "vec"])

    out = df.repartition("key").mapInArrow(run, "key int, vec binary").collect()
    return [(r.key, np.frombuffer(r.vec, np.float32).astype(np.float64)) for r in out]


def candidates(sums: np.ndarray, spans: list[int], own: np.ndarray, cosine: float) -> Iterator[tuple[int, int]]:
    """(chunk, item passage) whose latent vectors have ``cosine`` or more; a passage is as many chunks from there as the item's span."""
    runs = sums
    for n in range(1, max(spans) + 1):
        if n > 1:
            runs = runs[:-1] + sums[n - 1 :]
        which = np.array([j for j, s in enumerate(spans) if s == n], np.int64)
        for k in range(0, len(runs) if len(which) else 0, 4096):
            part = runs[k : k + 4096]
            least = cosine * np.sqrt(np.einsum("ij,ij->i", part, part))
            at, j = np.nonzero((part @ own[which].T >= least[:, None]) & part.any(axis=1)[:, None])
            yield from zip((at + k).tolist(), which[j].tolist(), strict=True)


def search(documents: DataFrame, bench: Benchmark, rows: np.ndarray, which: range, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, similarity) of the passages of ``documents(doc_id, ids)`` that are candidates of a block of item passages and pass the checks."""
    terms = [bench.terms[j] for j in which]
    held = documents.sparkSession.sparkContext.broadcast((rows, project(terms, rows), [Check(bench, t) for t in terms], [span(len(t)) for t in terms], [bench.item[j] for j in which]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own, checks, spans, item = held.value
        for batch in batches:
            ids, blobs, found = batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), {}
            for k in range(0, len(blobs), 64):
                chunks = Chunks(blobs[k : k + 64], max(spans))
                for chunk, j in candidates(chunks.sums(rows), spans, own, cosine):
                    doc, passage = chunks.words(chunk, spans[j])
                    if share := checks[j].share(passage):
                        key = ids[k + doc], item[j]
                        found[key] = max(found.get(key, 0.0), share)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(list(found.values()), pa.float64())], names=["doc_id", "item_id", "similarity"])

    return documents.mapInArrow(run, "doc_id long, item_id long, similarity double")


def find_contamination(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id, similarity)``: documents that hold a benchmark item, or a close paraphrase, in whole.

    Documents are read in passages that start at every CHUNK words, each as long as an item's
    paraphrase may be. All of them are projected on the leading singular vectors of the TF-IDF
    matrix of the corpus's and the benchmark's passages (over the benchmark's words); items of
    ``cosine`` or more are candidates, kept if COMMON of the item's words are there in order,
    CONTENT of its rarer words are there, and ANSWER of its last third is. Items longer than
    PASSAGE words count by their passages. The basis, the word counts and the search cover all
    documents and the whole benchmark; ``block`` item passages are searched for at a time, which
    changes no result. Words of the benchmark are held by the driver and every task.

    Null texts and items are empty and match nothing; a null doc_id is reported as such;
    repeated rows are reported once; empty tables give no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    bench = Benchmark(sorted(tuple(r) for r in benchmark.where("item_id is not null").select("item_id", F.coalesce("text", F.lit(""))).distinct().collect()))
    if not bench.terms:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double")
    held = spark.sparkContext.broadcast(bench)
    table = common.materialise(docs.select("doc_id", "text").mapInArrow(_scan(held), "kind int, doc_id long, term int, n long, ids binary"), "terms")
    counts = {r.term: r.n for r in table.where("kind = 1").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(min(SLOTS, len(bench.vocab)))
    for t in range(len(bench.vocab)):
        df[t % len(df)] = max(df[t % len(df)], counts.get(t, 0))
    idf = np.log((counts.get(-1, 0) + 2) / (df + 1)).astype(np.float32)
    documents = table.where("kind = 0").select("doc_id", "ids")
    rows = latent_basis(documents, bench, idf) * idf[:, None]
    out = None
    for k in range(0, len(bench.terms), block):
        part = search(documents, bench, rows, range(k, min(k + block, len(bench.terms))), cosine)
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, contaminated, item_ids, similarity)`` for every document; see :func:`find_contamination`.

    Texts decide, not ids: rows that share a doc_id, or have none, are each judged by their own text.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    hits = find_contamination(keyed.select(F.col("text_hash").alias("doc_id"), "text"), benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    none = F.array().cast("array<bigint>")
    return keyed.select("doc_id", "text_hash").join(hits.withColumnRenamed("doc_id", "text_hash"), "text_hash", "left").select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark item, whatever their doc_id and other columns."""
    hashed = docs.withColumn("_hit_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    hits = find_contamination(hashed.select(F.col("_hit_text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_hit")).distinct()
    hits = common.materialise(hits, "hits")
    sure, rest = common.suspects(hashed, "_hit_text", hits, "_hit")
    return sure.select(*docs.columns).union(rest.join(hits, F.col("_hit_text") == F.col("_hit"), "left_anti").select(*docs.columns))
