"""Token counts through a cache keyed by digests of content and tokenizer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common

CACHE = "tokenizer string, digest binary, n_tokens long"


@lru_cache(maxsize=8)
def load(path: str):
    """A function from a list of texts to their token counts, by the library of the file's kind."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def version(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    lib = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(lib.encode() + b"\0" + f.read()).hexdigest()


def cache_path(spark, path: str) -> str:
    """A place for a lasting cache of a tokenizer version's counts, in the folder that all executors share."""
    return f"{common.shared_dir(spark)}/lodestrata/token-counts/{version(path)[:16]}"


def cached(spark, cache: str) -> DataFrame:
    """The cache as stored; none yet counts as empty."""
    if common.path_exists(spark, cache):
        return spark.read.schema(CACHE).parquet(cache)
    return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every document, counting each distinct text once.

    Content is normalised to its UTF-8 bytes with null as empty (nothing that could change a
    count) and digested. Digests that the cache lacks for this tokenizer version are encoded,
    one document for each, and appended to the cache; counts then come from the cache alone.
    Texts of hits are digested where they lie; those that are joined with the misses are
    exchanged unless the misses are few enough to be broadcast. Rows with a null doc_id are counted too, repeated rows stay
    repeated, an empty table gives no rows and leaves the cache as it is.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    tokenizer = version(path)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    known = cached(spark, cache).where(F.col("tokenizer") == tokenizer).select("digest")
    first = common.materialise(keyed.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")).alias("r")), "digests")
    misses = first.join(known, "digest", "left_anti").select(F.col("digest").alias("miss"), F.col("r.doc_id").alias("rep"))
    wanted = keyed.join(misses, keyed.doc_id.eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("miss"))).select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = load(path), None
        for batch in batches:
            digests, texts = batch.column("digest").to_pylist(), common.texts(batch)
            own = []
            for k, d in enumerate(digests):  # repeated rows of one doc_id lie together
                if d != last:
                    own.append(k)
                last = d
            for k in range(0, len(own), 64):
                part = own[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array([digests[x] for x in part], pa.binary()), pa.array(count([texts[x] for x in part]), pa.int64())], names=["digest", "n_tokens"])

    new = wanted.mapInArrow(run, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # two runs at once may both store a digest: the counts agree
    stored = cached(spark, cache).where(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")
    # a table of its own, so that a digest of very many documents can be split in the last join
    counts = common.materialise(first.select("digest").join(stored, "digest").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    sized = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    return sized.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
