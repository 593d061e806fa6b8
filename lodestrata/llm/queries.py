"""Queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.embeddings import near_vectors

    return near_vectors(common.table(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.warc import read_archives, write_archives

    pages = common.table(spark, sf_dir, "pages")
    return read_archives(write_archives(pages, common.scratch_path(spark, "warc")))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.repeats import remove_repeats

    return remove_repeats(common.table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.tokens import count_tokens

    # a cache of its own, so that every distinct text is encoded whatever ran before; see tokens.cache_path for a lasting one
    docs = common.table(spark, sf_dir, "documents")
    return count_tokens(docs, tokenizer_path("piece_bpe_32k.model"), common.scratch_path(spark, "token-cache"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.packing import pack

    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.decontaminate import decontaminate

    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.sharding import shard_by_bytes

    return shard_by_bytes(common.table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.quality import judge

    found = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "evidence", "site_rate", "quality_score", "keep")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.simhash import near_duplicates

    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.toxicity import score_toxicity

    return score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


BASE32 = "list_aggregate(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: (substr(bits, i + j + 1, 1) = '1')::INT * (16 >> j)))::INT, 1)), 'string_agg', '')"

SQL = {
    "op1_embedding_near_dup": """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op3_repeats": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS m FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS p FROM d)),
g AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, p) > 1),
i AS (SELECT doc_id, p, sum(CASE WHEN p - last > 100 OR last IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM g)),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, k),
q AS (SELECT s.doc_id, a, b, substr(x, 2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0))) AS part FROM s JOIN d USING (doc_id)),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop, string_agg(part, '' ORDER BY a) AS head FROM q GROUP BY doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op2_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, html, octet_length(encode(html)) AS n, (unhex(sha1(html))::BIT)::VARCHAR AS bits, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM b""",
    "op7_sharding": """WITH RECURSIVE t AS (SELECT list(c ORDER BY k) AS crc FROM (SELECT k, list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k::BIGINT) AS c FROM range(256) r(k)) q),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, octet_length(encode(text)) + 1 AS size, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h, hex(encode(text)) AS x FROM d),
c AS (SELECT doc_id, size, h, xor(list_reduce(list_transform(range(size - 1), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM s, t),
o AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before, sum(size) OVER () AS total FROM c),
g AS (SELECT *, least(15, ((2 * before + size) * 16) // (2 * total))::INT AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM g""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
