"""Queries over the driver's tables, one or more for each group of operators, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import chars, lines, parse
from lodestrata.operators import corpus, noise, render, structure
from lodestrata.sources.corpus import ORDER, vote_format

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_leaves(spark, d):
    return structure.leaves(table(spark, d, "events").select("event_id", "props"), ["event_id"], "props")


@query("""SELECT 'k' AS field_path, 'int' AS type, 1.0::DOUBLE AS dominant_ratio, count(*) AS n_present, 1.0::DOUBLE AS occurrence
FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL HAVING count(*) > 0""")
def json_leaf_types(spark, d):
    leaf = _event_leaves(spark, d).withColumn("unit", F.lit("events"))
    return structure.field_types(leaf, ["unit"], "event_id").select("field_path", "type", "dominant_ratio", "n_present", "occurrence")


JSONL = """WITH l AS (SELECT user_id AS doc, CASE WHEN user_id % 20 > 4 AND event_id % 7 = 0 THEN props || '}' ELSE props END AS line FROM events),
g AS (SELECT doc, count(*) AS n_unit, count(*) FILTER (WHERE json_valid(line)) AS n_clean FROM l GROUP BY doc),
v AS (SELECT doc::VARCHAR AS path, n_unit, n_clean, n_clean / n_unit AS I_strict, CASE WHEN n_clean = 0 THEN 0 ELSE n_clean / n_unit END AS I, CASE WHEN n_clean = n_unit THEN 'tier1' ELSE 'tier2' END AS tier FROM g)"""


def _jsonl(spark, d):
    """Grades of a JSON Lines file for each user, whose lines are events, some of them damaged."""
    ev = table(spark, d, "events")
    line = F.when((F.col("user_id") % 20 > 4) & (F.col("event_id") % 7 == 0), F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    files = ev.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["line"]), "\n")
    return structure.grades(files.select("path", F.lit("jsonl").alias("fmt"), F.lit("utf-8").alias("encoding"), F.lit(1.0).alias("conf"), text.cast("binary").alias("content")))


@query(JSONL + " SELECT path, n_unit, n_clean, round(I_strict, 6) AS I_strict, round(I, 6) AS I, tier FROM v")
def jsonl_grade(spark, d):
    return _jsonl(spark, d).select("path", "n_unit", "n_clean", F.round("I_strict", 6).alias("I_strict"), F.round("I", 6).alias("I"), "tier")


@query(JSONL + " SELECT tier, count(*) AS n FROM v GROUP BY 1")
def tier_distribution(spark, d):
    return structure.tier_counts(_jsonl(spark, d))


@query(JSONL + " SELECT path, n_clean = n_unit AS clean, n_unit - n_clean AS deviations, n_unit, CASE WHEN n_clean < n_unit THEN 'bad_lines' END AS reason FROM v")
def strict_report(spark, d):
    return structure.strict_report(_jsonl(spark, d))


CSV = """WITH l AS (SELECT s_nationkey AS doc_id, s_suppkey AS line_no, concat_ws(',', s_suppkey, s_name, s_nationkey) || CASE WHEN s_suppkey % 5 = 0 THEN ',x' WHEN s_suppkey % 7 = 0 THEN ',' ELSE '' END AS line FROM supplier),
w AS (SELECT doc_id, line_no, len(string_split(line, ',')) AS raw, CASE WHEN line LIKE '%,' THEN len(string_split(line, ',')) - 1 ELSE len(string_split(line, ',')) END AS core FROM l),
p AS (SELECT doc_id, raw, count(*) AS n, min(line_no) AS first FROM w GROUP BY 1, 2),
m AS (SELECT doc_id, raw AS modal FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1)"""


def _csv_lines(spark, d):
    s = table(spark, d, "supplier")
    extra = F.when(F.col("s_suppkey") % 5 == 0, ",x").when(F.col("s_suppkey") % 7 == 0, ",").otherwise("")
    return s.select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("line_no"), F.concat(F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey"), extra).alias("line"))


@query(CSV + " SELECT doc_id, line_no, raw, core FROM w")
def csv_row_width(spark, d):
    return lines.widths(_csv_lines(spark, d), "doc_id", "line")


@query(CSV + """ SELECT w.doc_id, modal, count(*) AS n_rows, count(*) FILTER (WHERE raw = modal OR (raw > modal AND core <= modal)) AS n_clean,
round(avg(CASE WHEN raw = modal OR (raw > modal AND core <= modal) THEN 1.0::DOUBLE ELSE 0 END), 4) AS I_strict, round(stddev_pop(raw) / avg(raw), 6) AS drift FROM w JOIN m USING (doc_id) GROUP BY 1, 2""")
def csv_column_drift(spark, d):
    return lines.column_report(lines.widths(_csv_lines(spark, d), "doc_id", "line"), "doc_id")


@query(CSV + " SELECT doc_id, raw, count(*) AS n FROM w GROUP BY 1, 2")
def csv_col_hist(spark, d):
    return lines.widths(_csv_lines(spark, d), "doc_id", "line").groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT conv_id, turn AS line_no, text AS line FROM conversations WHERE trim(text) <> ''),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY line_no) <= 20),
c AS (SELECT conv_id, line_no, d.name AS delimiter, length(line) - length(replace(line, d.mark, '')) + 1 AS cols FROM f, (VALUES ('tab', chr(9)), ('comma', ','), ('semicolon', ';'), ('pipe', '|'), ('colon', ':')) d(name, mark)),
p AS (SELECT conv_id, delimiter, cols, count(*) AS n, min(line_no) AS first FROM c GROUP BY 1, 2, 3)
SELECT conv_id, delimiter, cols::INT AS cols, round(n / sum(n) OVER (PARTITION BY conv_id, delimiter), 4) AS share FROM p QUALIFY row_number() OVER (PARTITION BY conv_id, delimiter ORDER BY n DESC, first) = 1""")
def delimiter_vote(spark, d):
    conv = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.col("text").alias("line"))
    return lines.delimiter_votes(conv, "conv_id", "line")


@query()
def format_vote(spark, d):
    """Votes for whole texts of documents, pages and records; many patterns differ between regex dialects, so no SQL."""
    text = table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text").union(table(spark, d, "pages").select(F.lit("pages"), "page_id", "html")).union(table(spark, d, "events").select(F.lit("events"), "event_id", "props"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fmt, conf = [], []
            for t in b.column("text").to_pylist():
                head = (t or "")[: 64 << 10]
                s = vote_format([x.strip() for x in head.splitlines() if x.strip()][:20], head)
                best = max(ORDER, key=lambda k: s[k])
                fmt.append(best if s[best] >= 0.5 else "free_text")
                conf.append(s[best])
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("id"), pa.array(fmt, pa.string()), pa.array(conf, pa.float64())], names=["origin", "id", "fmt", "conf"])

    return text.mapInArrow(run, "origin string, id long, fmt string, conf double")


@query("SELECT source AS ext, lang AS fmt, count(*) AS n FROM documents GROUP BY 1, 2")
def corpus_cross_table(spark, d):
    from lodestrata.sources.corpus import cross_table

    return cross_table(table(spark, d, "documents").select(F.col("source").alias("ext"), F.col("lang").alias("fmt")))


@query("""SELECT doc_id, round(len(regexp_extract_all(text, '\\p{L}')) / length(text), 3) AS letter, round(len(regexp_extract_all(text, '\\p{N}')) / length(text), 3) AS number, round(len(regexp_extract_all(text, '\\p{P}')) / length(text), 3) AS punct, round(len(regexp_extract_all(text, '\\p{S}')) / length(text), 3) AS symbol FROM documents""")
def text_char_dist(spark, d):
    return table(spark, d, "documents").select("doc_id", chars.char_dist(F.col("text")).alias("c")).select("doc_id", "c.letter", "c.number", "c.punct", "c.symbol")


@query("""SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-z\\x{c0}-\\x{24f}\\x{1e00}-\\x{1eff}]')) / len(regexp_extract_all(text, '\\p{L}')), 3) AS latin FROM documents WHERE len(regexp_extract_all(text, '\\p{L}')) > 0""")
def text_script_dist(spark, d):
    docs = table(spark, d, "documents").where(chars.count(F.col("text"), r"\p{L}") > 0)
    return docs.select("doc_id", chars.script_dist(F.col("text"))["Latin"].alias("latin"))


@query("""SELECT p_brand AS unit, min(length(p_name))::INT AS len_min, max(length(p_name))::INT AS len_max, round(avg(length(p_name)), 1) AS len_mean, round(median(length(p_name)), 1) AS len_median, round(stddev_pop(length(p_name)), 1) AS len_std, count(*) AS sample_count,
round(avg(round(len(regexp_extract_all(p_name, '\\p{L}')) / length(p_name), 3)), 3) AS avg_letter FROM part GROUP BY 1""")
def value_len_dist(spark, d):
    leaf = table(spark, d, "part").select(F.col("p_brand").alias("unit"), F.lit("p_name").alias("field_path"), F.lit("str").alias("type"), F.col("p_name").alias("value"))
    return structure.profiles(leaf, ["unit"]).select("unit", "len_min", "len_max", "len_mean", "len_median", "len_std", "sample_count", "avg_letter")


@query("SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 1900 AND 2100 THEN 'year_like' WHEN o_orderkey BETWEEN 1 AND 150 THEN 'age_like' WHEN o_orderkey > 100000 THEN 'large_int' ELSE 'int' END AS hint FROM orders")
def numeric_hint(spark, d):
    return table(spark, d, "orders").select("o_orderkey", chars.numeric_hint(F.col("o_orderkey"), F.lit("int")).alias("hint"))


@query("""WITH p AS (SELECT c_custkey, 'L{' || length(regexp_extract(c_name, '^[A-Za-z]+')) || '}P' || 'D{' || length(regexp_extract(c_name, '[0-9]+$')) || '}' AS pattern FROM customer WHERE regexp_matches(c_name, '^[A-Za-z]{2,}#[0-9]{2,}$'))
SELECT pattern, count(*) AS n FROM p GROUP BY 1""")
def value_patterns_top(spark, d):
    c = table(spark, d, "customer").where(F.col("c_name").rlike("^[A-Za-z]{2,}#[0-9]{2,}$")).select("c_custkey", F.lit(0).alias("leaf_seq"), F.lit("c_name").alias("field_path"), F.lit("str").alias("type"), F.col("c_name").alias("value"), F.lit("customer").alias("unit"))
    return structure.top_patterns(c, ["unit"], ["c_custkey"]).select("pattern", "n")


@query("SELECT o_orderkey, regexp_replace(o_orderpriority, '[^\\p{P}\\p{Z}\\s]', '*', 'g') AS masked FROM orders")
def masked_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", chars.mask(F.col("o_orderpriority")).alias("masked"))


@query("""WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1), p AS (SELECT regexp_replace(regexp_replace(o_orderpriority, '[A-Z]', 'L', 'g'), '[0-9]', 'D', 'g') AS pat, o_orderpriority, k FROM f),
b AS (SELECT pat, arg_min(o_orderpriority, k) AS v, min(k) AS k FROM p GROUP BY 1) SELECT row_number() OVER (ORDER BY k)::INT AS rank, v AS sample FROM b QUALIFY row_number() OVER (ORDER BY k) <= 5""")
def value_samples(spark, d):
    o = table(spark, d, "orders").select(F.lit("orders").alias("unit"), F.lit("o_orderpriority").alias("field_path"), F.lit("str").alias("type"), F.col("o_orderpriority").alias("value"), "o_orderkey")
    return structure.samples(o, ["unit"], ["o_orderkey"], "raw").select("rank", "sample")


NAMES = ["user_name", "full name", "phone", "email", "c_acctbal", "address", "ip_addr", "token", "title"]


@query("SELECT * FROM (VALUES ('user_name', false, 'person_name'), ('full name', true, 'person_name'), ('phone', true, 'phone_number'), ('email', true, 'email'), ('c_acctbal', false, 'unknown_pii'), ('address', true, 'address'), ('ip_addr', true, 'address'), ('token', true, 'credential'), ('title', false, 'unknown_pii')) t(name, hit, pii_type)")
def pii_columns(spark, d):
    return spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", chars.implies_pii(F.col("name")).alias("hit"), chars.pii_type(F.col("name")).alias("pii_type"))


@query("""SELECT lang AS unit, 'text' AS field_path, avg(length(text)) >= 100 AND avg(CASE WHEN regexp_matches(text, '[。，？！、；：,.!?;:]') THEN 1.0 ELSE 0 END) > 0.3 AS free_text FROM documents GROUP BY 1""")
def free_text_fields(spark, d):
    leaf = table(spark, d, "documents").select(F.col("lang").alias("unit"), F.lit("text").alias("field_path"), F.lit("str").alias("type"), F.col("text").alias("value"))
    return structure.free_text(leaf, ["unit"])


def _nested(spark, d):
    """Orders as nested JSON; without a status the record has no user, and every eleventh has no leaves."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    place = F.struct(F.struct(F.col("o_totalprice").alias("lat")).alias("geo"), F.col("o_orderstatus").alias("name"))
    whole = F.to_json(F.struct(k.alias("id"), F.when(k % 4 != 0, place).alias("user"), F.array(F.struct(F.col("o_custkey").alias("amt"))).alias("orders"), F.array(F.col("o_orderpriority")).alias("tags")))
    return o.select(F.pmod("o_custkey", F.lit(5)).alias("unit"), k.alias("rec_seq"), F.when(k % 11 == 0, F.lit("{}")).otherwise(whole).alias("rec"))


@query("""WITH u AS (SELECT DISTINCT o_custkey % 5 AS unit FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 4 > 0)
SELECT u.unit, t.* FROM u, (VALUES ('id', 1, NULL, 'id', 3), ('user', 1, NULL, 'user', 3), ('user.name', 2, 'user', 'name', 1), ('user.geo', 2, 'user', 'geo', 1), ('user.geo.lat', 3, 'user.geo', 'lat', 0), ('orders[]', 1, NULL, 'orders', 3), ('orders[].amt', 2, 'orders[]', 'amt', 0), ('tags[]', 1, NULL, 'tags', 3)) t(node, depth, parent, key_name, n_siblings)""")
def topology_nodes(spark, d):
    paths = structure.leaves(_nested(spark, d), ["unit", "rec_seq"]).select("unit", "field_path").distinct()
    return structure.topology(paths, ["unit"]).select("unit", "node", "depth", "parent", "key_name", F.size("siblings").alias("n_siblings"))


@query("""WITH r AS (SELECT o_custkey % 5 AS unit, o_orderkey AS k FROM orders), t AS (SELECT unit, count(*) AS total, count(*) FILTER (WHERE k % 11 > 0) AS full_, count(*) FILTER (WHERE k % 11 > 0 AND k % 4 > 0) AS named FROM r GROUP BY 1)
SELECT unit, p.path AS field_path, CASE WHEN p.path LIKE 'user%' THEN named ELSE full_ END AS n_present, round(CASE WHEN p.path LIKE 'user%' THEN named ELSE full_ END / total, 4) AS occurrence FROM t, (VALUES ('id'), ('user.name'), ('user.geo.lat'), ('orders[].amt'), ('tags[]')) p(path)""")
def presence_rates(spark, d):
    """Occurrence over all records, those without leaves too."""
    recs = _nested(spark, d)
    return structure.field_types(structure.leaves(recs, ["unit", "rec_seq"]), ["unit"], "rec_seq", recs).select("unit", "field_path", "n_present", "occurrence")


def _mixed(spark, d):
    """Orders as JSON of two shapes, a third of them with a text id."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    rec = F.when(k % 3 == 0, F.to_json(F.struct(F.concat(F.lit("K"), k).alias("id"), F.col("o_orderstatus").alias("status")))).when(k % 3 == 1, F.to_json(F.struct(k.alias("id"), F.col("o_orderstatus").alias("status")))).otherwise(F.to_json(F.struct(k.alias("id"), F.col("o_custkey").alias("cust"))))
    return o.select(F.pmod("o_custkey", F.lit(5)).alias("unit"), k.alias("rec_seq"), rec.alias("rec"))


@query("""WITH r AS (SELECT o_custkey % 5 AS unit, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '{"id":<str>,"status":<str>}' WHEN 1 THEN '{"id":<int>,"status":<str>}' ELSE '{"cust":<int>,"id":<int>}' END AS sig FROM orders),
p AS (SELECT unit, sig, count(*) AS n, min(k) AS first FROM r GROUP BY 1, 2)
SELECT unit, arg_max(sig, n * 1000000000 - first) AS template, count(*) AS n_signatures, sum(n)::BIGINT AS n_records FROM p GROUP BY 1""")
def template_backbone(spark, d):
    return structure.template(structure.signatures(_mixed(spark, d), ["unit", "rec_seq"]), ["unit"], "rec_seq")


FOLD = """WITH r AS (SELECT o_custkey % 5 AS unit, o_orderkey AS k FROM orders), l AS (SELECT unit, k, 'id' AS field_path, CASE WHEN k % 3 = 0 THEN 'str' ELSE 'int' END AS type FROM r UNION ALL SELECT unit, k, 'status', 'str' FROM r WHERE k % 3 < 2 UNION ALL SELECT unit, k, 'cust', 'int' FROM r WHERE k % 3 = 2),
c AS (SELECT unit, field_path, type, count(*) AS n FROM l GROUP BY 1, 2, 3), t AS (SELECT unit, count(*) AS total FROM r GROUP BY 1)"""


@query(FOLD + " SELECT c.unit, field_path, arg_max(type, n) AS type, round(max(n) / sum(n), 4) AS dominant_ratio, sum(n)::BIGINT AS n_present, round(sum(n) / any_value(total), 4) AS occurrence FROM c JOIN t USING (unit) GROUP BY 1, 2")
def fold_types(spark, d):
    return structure.field_types(structure.leaves(_mixed(spark, d), ["unit", "rec_seq"]), ["unit"], "rec_seq").drop("types")


@query("""WITH r AS (SELECT o_custkey % 5 AS unit, o_orderkey AS k FROM orders), f AS (SELECT unit, k % 3 = 0 AS s, min(k) AS first, count(*) AS n FROM r GROUP BY 1, 2)
SELECT unit, (row_number() OVER (PARTITION BY unit ORDER BY first) - 1)::INT AS cluster, n FROM f""")
def union_schema_clusters(spark, d):
    got = structure.union_clusters(structure.signatures(_mixed(spark, d), ["unit", "rec_seq"]), ["unit"], "rec_seq")
    return got.groupBy("unit", "cluster").agg(F.sum("n").alias("n"))


def _units(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    entries = F.array(F.struct(F.lit("id").alias("k"), F.when(k % 4 == 0, "float").otherwise("int").alias("v")), F.struct(F.when(k % 3 == 0, "note").otherwise("name").alias("k"), F.when(k % 5 == 0, "null").otherwise("str").alias("v")))
    return c.select(F.format_string("u%08d", k).alias("unit_id"), F.lit("json").alias("fmt"), F.map_from_entries(entries).alias("skeleton"))


@query("""WITH u AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS g FROM customer), s AS (SELECT g, min(k) AS first, count(*) AS n FROM u GROUP BY 1)
SELECT printf('u%08d', k) AS unit_id, printf('u%08d', first) AS representative, n AS cluster_size FROM u JOIN s USING (g)""")
def schema_dedup(spark, d):
    return corpus.dedup_schemas(_units(spark, d))


@query("""WITH p AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), s AS (SELECT k % 2 = 0 AS g, min(k) AS first, count(*) AS n FROM p GROUP BY 1)
SELECT k AS unit_id, first AS representative, s.n AS cluster_size FROM p JOIN s ON (p.k % 2 = 0) = s.g""")
def csv_dedup(spark, d):
    s = table(spark, d, "supplier")
    head = F.when(F.col("s_nationkey") % 2 == 0, "id,name\n").otherwise("Id,Label,Extra\n")
    row = F.when(F.col("s_nationkey") % 2 == 0, F.concat_ws(",", "s_suppkey", "s_name")).otherwise(F.concat_ws(",", "s_suppkey", "s_name", F.lit("x")))
    docs = s.groupBy("s_nationkey").agg(F.concat(F.max(head), F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("text"))
    return corpus.dedup_csv(corpus.fingerprints(docs.select(F.col("s_nationkey").cast("int").alias("unit_id"), "text")))


@query("""WITH r AS (SELECT o_custkey % 5 AS unit, o_orderkey % 3 AS shape, o_orderkey AS k FROM orders), p AS (SELECT unit, shape, count(*) AS n, min(k) AS first FROM r GROUP BY 1, 2),
m AS (SELECT unit, arg_max(shape, n * 1000000000 - first) AS shape FROM p GROUP BY 1), a AS (SELECT count(DISTINCT f) AS A FROM (SELECT unnest(CASE WHEN shape < 2 THEN ['id', 'status'] ELSE ['id', 'cust'] END) AS f FROM r))
SELECT any_value(A) AS A, count(DISTINCT shape) AS B, round(any_value(A) / count(DISTINCT shape), 3) AS A_per_B, 0::BIGINT AS pii_seeds, (SELECT count(*) FROM r) AS records, count(*) AS units FROM m, a""")
def global_view(spark, d):
    recs = _mixed(spark, d)
    units = structure.template(structure.signatures(recs, ["unit", "rec_seq"]), ["unit"], "rec_seq")
    return corpus.global_view(structure.fields(structure.leaves(recs, ["unit", "rec_seq"]), ["unit"], "rec_seq", recs), units)


COLUMNS = [("customer", "full name"), ("customer", "phone"), ("supplier", "full name"), ("supplier", "mobile"), ("part", "title"), ("orders", "title")]


def _vocab(spark):
    fields = spark.createDataFrame(COLUMNS, "unit string, key_name string").withColumn("pii", chars.pii_seed(F.col("key_name"), F.lit(False)))
    return corpus.vocabulary(fields, "unit")


@query("SELECT * FROM (VALUES ('<PERSON_NAME>', 'full name', 'customer,supplier'), ('<PHONE_NUMBER>', 'phone', 'customer'), ('<PHONE_NUMBER>', 'mobile', 'supplier'), ('title', 'title', 'orders,part')) t(semantic_class, key_name, units)")
def vocab_inverted(spark, d):
    return _vocab(spark).select("semantic_class", "key_name", F.array_join("units", ",").alias("units"))


@query("SELECT '<PHONE_NUMBER>' AS semantic_class, 'mobile' AS a, 'phone' AS b")
def name_conflicts(spark, d):
    return corpus.name_conflicts(_vocab(spark)).select("semantic_class", "a", "b")


TEXTS = [("customer", "c_name"), ("customer", "c_mktsegment"), ("supplier", "s_name"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderpriority"), ("orders", "o_orderstatus"), ("nation", "n_name"), ("region", "r_name")]


def _profiled(spark, d):
    """Fields of text columns with length bands; each table is a unit."""
    leaf = None
    for t, c in TEXTS:
        part = table(spark, d, t).select(F.lit(t).alias("unit"), F.lit(c).alias("field_path"), F.lit("str").alias("type"), F.col(c).cast("string").alias("value"))
        leaf = part if leaf is None else leaf.union(part)
    known = structure.profiles(leaf, ["unit"]).withColumn("type", F.lit("str"))
    return known.select("unit", F.col("field_path").alias("key_name"), chars.pii_seed(F.col("field_path"), F.lit(False)).alias("pii"), corpus.bands(known).alias("band"))


BANDS = "WITH f AS (" + " UNION ALL ".join(f"SELECT '{t}' AS unit, '{c}' AS key_name, round_even(log2(round(avg(length({c})), 1) + 1), 0)::INT AS band FROM {t}" for t, c in TEXTS) + """),
w AS (SELECT band FROM f GROUP BY 1 HAVING count(DISTINCT unit) > 1), n AS (SELECT unit, f.key_name, CASE WHEN w.band IS NULL THEN f.key_name ELSE min(f.key_name) OVER (PARTITION BY f.band) END AS semantic_class FROM f LEFT JOIN w USING (band))"""


@query(BANDS + " SELECT semantic_class, key_name, string_agg(DISTINCT unit, ',') AS units FROM n GROUP BY 1, 2")
def vocab_evidence_b(spark, d):
    return corpus.vocabulary(_profiled(spark, d), "unit", evidence_b=True).select("semantic_class", "key_name", F.array_join("units", ",").alias("units"))


@query()
def vocab_uncertain(spark, d):
    """Classes of evidence B that hold names unlike each other (a similarity that SQL lacks)."""
    found = corpus.uncertain(corpus.vocabulary(_profiled(spark, d), "unit", evidence_b=True))
    return found.select("semantic_class", F.array_join("key_names", ",").alias("key_names"), F.array_join("units", ",").alias("units"))


def _dump(spark, d):
    n = table(spark, d, "nation")
    row = F.concat(F.lit("INSERT INTO nation VALUES ("), F.col("n_nationkey"), F.lit(", '"), F.col("n_name"), F.lit(";', "), F.col("n_regionkey"), F.lit(");"))
    return n.groupBy("n_regionkey").agg(F.concat(F.lit("CREATE TABLE `nation` (\n id INT AUTO_INCREMENT,\n name TEXT, region INT);\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n"), F.lit("\nINSERT INTO nation VALUES (1, 'cut")).alias("text"))


@query("SELECT n_regionkey, count(*) + 2 AS n_statements, count(*) + 1 AS n_clean, 1::BIGINT AS n_truncated, 'mysql' AS dialect, 'confident' AS status FROM nation GROUP BY 1")
def sql_statements(spark, d):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(parse.split_sql(t), parse.sql_dialect(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("n_regionkey"), *(pa.array(v, pa.int64()) for v in ([len(s) for s, _ in got], [sum(x[1] and x[2] for x in s) for s, _ in got], [sum(x[3] for x in s) for s, _ in got])), pa.array([x[0] for _, x in got], pa.string()), pa.array([x[1] for _, x in got], pa.string())], names=["n_regionkey", "n_statements", "n_clean", "n_truncated", "dialect", "status"])

    return _dump(spark, d).mapInArrow(run, "n_regionkey int, n_statements long, n_clean long, n_truncated long, dialect string, status string")


def _rows(spark, d, fmt):
    """Nations of a region as rows of a document."""
    n = table(spark, d, "nation")
    row = F.struct("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("row"))
    docs = n.groupBy(F.col("n_regionkey").cast("string").alias("unit_id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"]).alias("rows"))
    skeleton = F.create_map(F.lit("n_nationkey"), F.lit("int"), F.lit("n_name"), F.lit("str"))
    return render.write_rows(docs.select("unit_id", F.lit(fmt).alias("fmt"), skeleton.alias("skeleton"), "rows")).select("unit_id", "text")


@query("SELECT n_regionkey::VARCHAR AS unit_id, 'n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation GROUP BY 1")
def render_csv(spark, d):
    return _rows(spark, d, "csv")


@query("SELECT n_regionkey::VARCHAR AS unit_id, string_agg('{\"n_nationkey\": ' || n_nationkey || ', \"n_name\": \"' || n_name || '\"}' || chr(10), '' ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def render_jsonl(spark, d):
    return _rows(spark, d, "jsonl")


@query("""SELECT n_regionkey::VARCHAR AS unit_id, 'CREATE TABLE `' || n_regionkey || '` (' || chr(10) || '  `n_nationkey` INT,' || chr(10) || '  `n_name` VARCHAR(255)' || chr(10) || ');' || chr(10) || string_agg('INSERT INTO `' || n_regionkey || '` (`n_nationkey`, `n_name`) VALUES (' || n_nationkey || ', ' || chr(39) || n_name || chr(39) || ');' || chr(10), '' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""")
def render_sql(spark, d):
    return _rows(spark, d, "sql")


@query("SELECT printf('u%08d', c_custkey) AS unit_id, 1.0::DOUBLE AS jaccard, true AS ok FROM customer")
def roundtrip_jaccard(spark, d):
    """Documents of every format for units of all customers, read back."""
    k = F.substring("unit_id", 2, 8).cast("int")
    flat = _units(spark, d).withColumn("fmt", F.element_at(F.array(*map(F.lit, ("csv", "json", "jsonl", "sql", "tsv", "xlsx"))), (k % 6 + 1).cast("int")))
    deep = F.map_concat("skeleton", F.create_map(F.lit("user.geo.lat"), F.lit("float"), F.lit("orders[].amt"), F.lit("int"), F.lit("tags[]"), F.lit("str")))
    units = flat.withColumn("skeleton", F.when(F.col("fmt").startswith("json"), deep).otherwise(F.col("skeleton")))
    return render.verify(render.render_units(units), units).select("unit_id", "jaccard", "ok")


@query("SELECT s_suppkey, substr(s_name, 1, CASE WHEN length(s_name) >= 4 THEN (length(s_name) // 2 + s_suppkey % (length(s_name) - length(s_name) // 2))::INT ELSE length(s_name) END) AS text FROM supplier")
def noise_truncate(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", noise.truncate_by_hash(F.col("s_name"), F.col("s_suppkey")).alias("text"))


@query("""WITH c AS (SELECT s_suppkey, s_suppkey || ',' || s_name AS text FROM supplier), x AS (SELECT s_suppkey, text, unnest(generate_series(1, length(text))) - 1 AS i FROM c),
l AS (SELECT s_suppkey, i, substr(text, i + 1, 1) = ',' AS mark, CASE WHEN i > instr(text, ',') - 1 THEN 1 ELSE 0 END AS col, i = 0 OR i = instr(text, ',') AS first FROM x)
SELECT s_suppkey, i::INT AS char_idx, (CASE WHEN mark THEN -100 ELSE col END)::INT AS field, (CASE WHEN NOT mark AND first THEN 1 ELSE 0 END)::INT AS new_field FROM l""")
def noise_labels(spark, d):
    """Field and boundary labels of undamaged one-row texts."""
    return noise.clean_labels(table(spark, d, "supplier").select("s_suppkey", F.concat_ws(",", "s_suppkey", "s_name").alias("text")), "s_suppkey")


@query("SELECT n_nationkey, '[57344, ' || array_to_string(list_transform(string_split(n_name, ''), lambda x: unicode(x)), ', ') || ', 57345, 0, 0]' AS codes FROM nation")
def codepoint_example(spark, d):
    """Code points of names between their marks, padded by two."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("text"))
    return noise.encoded(n, "n_nationkey", 2).select("n_nationkey", F.concat(F.lit("["), F.array_join(F.col("input_ids").cast("array<string>"), ", "), F.lit("]")).alias("codes"))


@query()
def noise_examples(spark, d):
    """Labelled examples of damaged CSV; drawn by a generator that SQL can't follow."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.concat(F.lit("key,name\n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "n_nationkey", "n_name"))), "\n")).alias("text"))
    return noise.examples(n).select("doc_id", "effect", "noised", F.size("input_ids").alias("n_ids"), "field", "damaged")
