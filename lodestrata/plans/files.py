"""Queries over files made of the driver's tables: one file for each nation and format, holding its customers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import chars, lines, parse
from lodestrata.operators import corpus, fill, noise, render, structure
from lodestrata.plans.queries import QUERIES, SQL, _csv_lines, _mixed, _units, query, table
from lodestrata.plans.queries import CSV as WIDTHS
from lodestrata.sources import corpus as sources
from lodestrata.sources.jsonl import valid_lines

__all__ = ["QUERIES", "SQL"]

NATIONS = "WITH n AS (SELECT c_nationkey AS k, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer GROUP BY 1)"
KINDS = "(VALUES ('json', 0.9, 0), ('jsonl', 0.9, 0), ('csv', 0.9, 1), ('tsv', 0.9, 1), ('sql', 0.95, 1), ('log', 0.95, 0)) f(fmt, vote, head)"
FILES = NATIONS + f""", f AS (SELECT k || CASE WHEN k % 2 = 0 THEN '.' || fmt ELSE '-' || fmt || '.dat' END AS path, CASE WHEN k % 2 = 0 THEN fmt ELSE 'dat' END AS ext, fmt,
CASE WHEN k % 2 = 0 AND fmt <> 'log' THEN 1.0 ELSE vote END::DOUBLE AS conf, n, ids, head FROM n, {KINDS})"""


def _customers(spark, d, row):
    """(k, rows): rows of the customers of each nation in order, as one text column ``row`` makes them."""
    c = table(spark, d, "customer")
    per = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))).alias("r"))
    return per.select("k", F.transform("r", lambda x: x["row"]).alias("rows"))


def _id():
    return F.col("c_custkey").cast("string")


def _object():
    return F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


def _parts(spark, d):
    """(k, fmt, text) of each nation in every format."""
    line = lambda row, before="", between="\n", after="": (row, before, between, after)
    forms = {
        "json": line(_object(), "[\n", ",\n", "\n]"),
        "jsonl": line(_object(), after="\n"),
        "csv": line(F.concat_ws(",", _id(), "c_name"), "id,name\n", after="\n"),
        "tsv": line(F.concat_ws("\t", _id(), "c_name"), "id\tname\n", after="\n"),
        "sql": line(F.concat(F.lit("INSERT INTO t VALUES ("), _id(), F.lit(", '"), F.col("c_name"), F.lit("');")), "CREATE TABLE t (id INT, name TEXT);\n"),
        "log": line(F.concat(F.lit("2024-01-01 10:00:00 INFO customer "), _id())),
    }
    out = None
    for fmt, (row, before, between, after) in forms.items():
        part = _customers(spark, d, row).select("k", F.lit(fmt).alias("fmt"), F.concat(F.lit(before), F.array_join("rows", between), F.lit(after)).alias("text"))
        out = part if out is None else out.union(part)
    return out


def _listed(parts):
    """Texts as files; those of odd nations carry an extension that says nothing."""
    even = F.col("k") % 2 == 0
    path = F.concat(F.col("k").cast("string"), F.when(even, F.concat(F.lit("."), F.col("fmt"))).otherwise(F.concat(F.lit("-"), F.col("fmt"), F.lit(".dat"))))
    return parts.select(path.alias("path"), F.col("text").cast("binary").alias("content")).select("path", sources.extension(F.col("path")).alias("ext"), "content")


def _sniffed(spark, d):
    return sources.sniff(_listed(_parts(spark, d)))


def _typed(texts: DataFrame, fmt: str) -> DataFrame:
    """(path, text) as sniffed files of a known format."""
    return texts.select("path", F.lit(fmt).alias("ext"), F.lit(fmt).alias("fmt"), F.lit("utf-8").alias("encoding"), F.lit(1.0).alias("conf"), F.col("text").cast("binary").alias("content"))


def _summed(recs: DataFrame) -> DataFrame:
    """Records and the sum of their ids for each file and partition."""
    return recs.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("rec", "$.id").cast("long")).alias("ids"))


@query(FILES + " SELECT path, ext, fmt, 'utf-8' AS encoding, conf FROM f")
def sniff_formats(spark, d):
    return _sniffed(spark, d).select("path", "ext", "fmt", "encoding", "conf")


@query(FILES + " SELECT ext, fmt, count(*) AS n FROM f GROUP BY 1, 2")
def graded_cross_table(spark, d):
    return sources.graded_cross_table(structure.grades(_sniffed(spark, d)))


@query(NATIONS + " SELECT k || '.txt' AS path, 'txt' AS ext, 'free_text' AS fmt, 0.0::DOUBLE AS conf FROM n")
def low_confidence(spark, d):
    """Files of names alone, which speak for no format."""
    names = _customers(spark, d, F.col("c_name")).select(F.concat(F.col("k").cast("string"), F.lit(".txt")).alias("path"), F.lit("txt").alias("ext"), F.array_join("rows", "\n").cast("binary").alias("content"))
    return sources.low_confidence(sources.sniff(names))


@query(FILES + " SELECT path, CASE fmt WHEN 'log' THEN 'noise' ELSE 'tier1' END AS tier, CASE fmt WHEN 'log' THEN 0 ELSE n + head END AS n_unit, CASE fmt WHEN 'log' THEN 0 ELSE n + head END AS n_clean FROM f")
def file_tiers(spark, d):
    return structure.grades(_sniffed(spark, d)).select("path", "tier", "n_unit", "n_clean")


@query(FILES + " SELECT CASE fmt WHEN 'log' THEN 'noise' ELSE 'tier1' END AS tier, row_number() OVER (PARTITION BY fmt = 'log' ORDER BY path)::INT AS rank, path, NULL::VARCHAR AS reason FROM f QUALIFY row_number() OVER (PARTITION BY fmt = 'log' ORDER BY path) <= 200")
def tier_report(spark, d):
    return structure.tier_samples(structure.grades(_sniffed(spark, d)))


@query(FILES + " SELECT path, CASE WHEN fmt LIKE 'json%' THEN '' WHEN fmt = 'sql' THEN 'table:t' ELSE 'csv' END AS part, n, ids FROM f WHERE fmt <> 'log'")
def file_records(spark, d):
    return _summed(structure.records(_sniffed(spark, d)))


@query(NATIONS + " SELECT k::VARCHAR || '-' || form AS path, tier, n_form, CASE form WHEN 'torn' THEN 0 ELSE n END AS n_recovered, CASE form WHEN 'cut' THEN n ELSE 0 END AS n_clean FROM n, (VALUES ('cut', 'tier2', 'incomplete'), ('joined', 'tier2', 'concatenated_values'), ('relaxed', 'tier2', 'json5'), ('torn', 'tier3', 'other')) t(form, tier, n_form)")
def json_recovery(spark, d):
    """Arrays without an end, values run together, relaxed syntax, and text that is none of these."""
    plain = _customers(spark, d, _object())
    loose = _customers(spark, d, F.concat(F.lit("{id: "), _id(), F.lit(", name: '"), F.col("c_name"), F.lit("', }")))
    named = lambda rows, form, text: rows.select(F.concat(F.col("k").cast("string"), F.lit("-" + form)).alias("path"), text.alias("text"))
    texts = named(plain, "cut", F.concat(F.lit("["), F.array_join("rows", ","))).union(named(plain, "joined", F.array_join("rows", ""))).union(named(loose, "relaxed", F.concat(F.lit("[ "), F.array_join("rows", ", /* next */ "), F.lit(",]")))).union(named(plain, "torn", F.lit("nothing {")))
    files = _typed(texts, "json")
    n = structure.records(files).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return structure.grades(files).join(n, "path", "left").select("path", "tier", "n_form", F.coalesce("n", F.lit(0)).alias("n_recovered"), "n_clean")


@query("SELECT c_nationkey::VARCHAR AS path, CASE WHEN c_custkey % 2 = 0 THEN 'key:even' ELSE 'key:odd' END AS part, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer GROUP BY 1, 2")
def wrapper_keys(spark, d):
    """Documents whose keys hold a list of records each."""
    rows = _customers(spark, d, _object())
    of = lambda rest: F.array_join(F.filter("rows", lambda r: F.get_json_object(r, "$.id").cast("long") % 2 == rest), ",")
    texts = rows.select(F.col("k").cast("string").alias("path"), F.concat(F.lit('{"even": ['), of(0), F.lit('], "note": "x", "odd": ['), of(1), F.lit("]}")).alias("text"))
    return _summed(structure.records(_typed(texts, "json")))


@query("SELECT c_nationkey::VARCHAR AS path, 'table:t' || c_custkey % 3 AS part, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer GROUP BY 1, 2")
def sql_table_rows(spark, d):
    """Rows of three tables in one dump, with quotes, calls and semicolons in values."""
    which = F.concat(F.lit("t"), F.col("c_custkey") % 3)
    row = F.concat(F.lit("INSERT INTO "), which, F.lit(" (id, note, at) VALUES ("), _id(), F.lit(", 'it''s; "), F.col("c_name"), F.lit("', NOW(1, 2));"))
    texts = _customers(spark, d, row).select(F.col("k").cast("string").alias("path"), F.array_join("rows", "\n-- next; one\n").alias("text"))
    return _summed(structure.records(_typed(texts, "sql")))


@query("SELECT c_nationkey::VARCHAR AS path, 'csv' AS part, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer GROUP BY 1")
def csv_quoted_rows(spark, d):
    """Rows with delimiters, quotes and line breaks inside quoted cells."""
    row = F.concat(_id(), F.lit(',"say ""hi"", '), F.col("c_name"), F.lit('\nand go"'))
    texts = _customers(spark, d, row).select(F.col("k").cast("string").alias("path"), F.concat(F.lit("id,note\n"), F.array_join("rows", "\n")).alias("text"))
    return _summed(structure.records(_typed(texts, "csv")))


def _book(ids: list[int]) -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = lambda rows: f"<worksheet {main}><sheetData>" + "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>" for v in r) + "</row>" for r in rows) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="all"/><sheet name="even"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([["id", "k"], *([i, "x"] for i in ids)]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([["id"], *([i] for i in ids if i % 2 == 0)]))
    return out.getvalue()


@query("WITH c AS (SELECT c_nationkey::VARCHAR AS path, c_custkey AS id FROM customer) SELECT path, 'sheet:all' AS part, count(*) AS n, sum(id)::BIGINT AS ids FROM c GROUP BY 1 UNION ALL SELECT path, 'sheet:even', count(*), sum(id)::BIGINT FROM c WHERE id % 2 = 0 GROUP BY 1")
def xlsx_rows(spark, d):
    """Sheets of workbooks that are written and read here."""
    books = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list("c_custkey")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([_book(x) for x in b.column("ids").to_pylist()], pa.binary())], names=["path", "content"])

    files = books.mapInArrow(run, "path string, content binary").select("path", F.lit("xlsx").alias("ext"), "content")
    return _summed(structure.records(sources.sniff(files)))


@query(NATIONS + " SELECT k || '-' || e AS path, e AS encoding, n, n AS n_named FROM n, (VALUES ('utf-8'), ('utf-8-sig'), ('utf-16')) t(e)")
def encodings(spark, d):
    """Files of three encodings, told apart and read."""
    row = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.concat(F.lit("姓名"), F.col("c_name")).alias("name")))
    rows = _customers(spark, d, row).select("k", F.concat(F.array_join("rows", "\n"), F.lit("\n")).alias("text"))
    raw = {"utf-8": F.encode("text", "UTF-8"), "utf-8-sig": F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")), "utf-16": F.encode("text", "UTF-16")}
    files = None
    for e, content in raw.items():
        part = rows.select(F.concat_ws("-", F.col("k").cast("string"), F.lit(e)).alias("path"), F.lit("jsonl").alias("ext"), content.alias("content"))
        files = part if files is None else files.union(part)
    sniffed = sources.sniff(files)
    named = F.get_json_object("rec", "$.name").startswith("姓名").cast("long")
    recs = structure.records(sniffed).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(named).alias("n_named"))
    return sniffed.select("path", "encoding").join(recs, "path")


@query("""SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'trailing_comma' WHEN 2 THEN 'unclosed_string' WHEN 3 THEN 'trailing_comma' WHEN 4 THEN 'single_quotes' WHEN 5 THEN 'incomplete' WHEN 6 THEN 'other' END AS label FROM events""")
def json_error_labels(spark, d):
    """What a strict reader says of events damaged in six ways, as labels."""
    way = F.col("event_id") % 7
    props = F.col("props")
    text = F.when(way == 1, F.expr("substr(props, 1, length(props) - 1) || ',}'")).when(way == 2, F.concat(F.lit('{"'), F.col("user_id"))).when(way == 3, F.replace(props, F.lit('"'), F.lit("'"))).when(way == 4, F.lit('{"k":')).when(way == 5, F.replace(props, F.lit(":"), F.lit(" "))).when(way == 6, F.concat(props, F.lit("}"))).otherwise(props)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array([parse.json_message(t) for t in b.column("text").to_pylist()], pa.string())], names=["event_id", "message"])

    told = table(spark, d, "events").select("event_id", text.alias("text")).mapInArrow(run, "event_id long, message string")
    return told.select("event_id", lines.json_error(F.col("message")).alias("label"))


@query("SELECT event_id, props AS value FROM events WHERE event_id % 5 > 0")
def jsonl_valid(spark, d):
    """Lines of a log of which every fifth is cut."""
    ev = table(spark, d, "events")
    line = F.when(F.col("event_id") % 5 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return valid_lines(ev.select("event_id", line.alias("value")))


@query(WIDTHS + " SELECT w.doc_id, line_no, raw = modal OR (raw > modal AND core <= modal) AS clean FROM w JOIN m USING (doc_id)")
def csv_clean_rows(spark, d):
    return lines.judged_rows(lines.widths(_csv_lines(spark, d), "doc_id", "line"), "doc_id").select("doc_id", "line_no", "clean")


@query(WIDTHS + """, h AS (SELECT doc_id, raw, line_no FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 20)
SELECT doc_id, count(*) >= 2 AND (coalesce(stddev_samp(raw), 0) > 0.5 OR arg_min(raw, line_no) < 2) AS noisy FROM h GROUP BY 1""")
def csv_noisy(spark, d):
    return lines.noisy(_csv_lines(spark, d), "doc_id", "line")


@query("""WITH r AS (SELECT o_custkey % 5 AS unit, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '{"id":<str>,"status":<str>}' WHEN 1 THEN '{"id":<int>,"status":<str>}' ELSE '{"cust":<int>,"id":<int>}' END AS sig FROM orders),
p AS (SELECT unit, sig, count(*) AS n, min(k) AS first FROM r GROUP BY 1, 2)
SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY n DESC, first)::INT AS rank, sig, n, count(*) OVER (PARTITION BY unit) AS n_signatures FROM p""")
def signature_histogram(spark, d):
    return structure.signature_histogram(structure.signatures(_mixed(spark, d), ["unit", "rec_seq"]), ["unit"], "rec_seq")


@query("""WITH r AS (SELECT o_custkey AS unit, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '{"id":<str>,"status":<str>}' WHEN 1 THEN '{"id":<int>,"status":<str>}' ELSE '{"cust":<int>,"id":<int>}' END AS sig FROM orders),
p AS (SELECT unit, sig, count(*) AS n, min(k) AS first FROM r GROUP BY 1, 2), m AS (SELECT unit, arg_max(sig, n * 1000000000 - first) AS template, sum(n) AS n FROM p GROUP BY 1)
SELECT row_number() OVER (ORDER BY count(*) DESC, template)::INT AS rank, template, count(*) AS units, sum(n)::BIGINT AS records FROM m GROUP BY template""")
def top_skeletons(spark, d):
    """Templates of every customer's orders."""
    recs = _mixed(spark, d).drop("unit").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("rec_seq"), F.col("o_custkey").alias("unit")), "rec_seq")
    return corpus.top_skeletons(structure.template(structure.signatures(recs, ["unit", "rec_seq"]), ["unit"], "rec_seq"))


@query(NATIONS + """ SELECT k::VARCHAR AS unit_id, CASE WHEN k % 2 = 0 THEN '["H", ["id", "name"]]' ELSE '["V", 2, [["num"], ["str"]]]' END AS fp FROM n""")
def csv_fingerprints(spark, d):
    """Headers of even nations, cell classes of odd ones, whose files have none."""
    rows = _customers(spark, d, F.concat_ws(",", _id(), "c_name"))
    text = F.concat(F.when(F.col("k") % 2 == 0, F.lit("Id, NAME\n")).otherwise(F.lit("")), F.array_join("rows", "\n"))
    return corpus.fingerprints(rows.select(F.col("k").cast("string").alias("unit_id"), text.alias("text")))


@query("""WITH f AS (SELECT o_orderpriority AS v, min(o_orderkey) AS k FROM orders GROUP BY 1), p AS (SELECT regexp_replace(regexp_replace(v, '[A-Z]', 'L', 'g'), '[0-9]', 'D', 'g') AS pat, v, k FROM f),
b AS (SELECT pat, arg_min(v, k) AS v, min(k) AS k FROM p GROUP BY 1) SELECT row_number() OVER (ORDER BY k)::INT AS rank, regexp_replace(v, '[^\\p{P}\\p{Z}\\s]', '*', 'g') AS sample FROM b QUALIFY row_number() OVER (ORDER BY k) <= 5""")
def masked_samples(spark, d):
    o = table(spark, d, "orders").select(F.lit("orders").alias("unit"), F.lit("o_orderpriority").alias("field_path"), F.lit("str").alias("type"), F.col("o_orderpriority").alias("value"), "o_orderkey")
    return structure.samples(o, ["unit"], ["o_orderkey"]).select("rank", "sample")


@query("""WITH f AS (SELECT n_name AS unit, CASE n_nationkey % 4 WHEN 0 THEN 'phone' WHEN 1 THEN 'mobile' WHEN 2 THEN 'email' ELSE 'remark' END AS key_name FROM nation)
SELECT CASE key_name WHEN 'email' THEN '<EMAIL>' WHEN 'remark' THEN 'remark' ELSE '<PHONE_NUMBER>' END AS semantic_class, key_name, string_agg(unit, ',' ORDER BY unit) AS units FROM f GROUP BY 1, 2""")
def vocab_pii_classes(spark, d):
    key = F.element_at(F.array(*map(F.lit, ("phone", "mobile", "email", "remark"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    fields = table(spark, d, "nation").select(F.col("n_name").alias("unit"), key.alias("key_name")).withColumn("pii", chars.pii_seed(F.col("key_name"), F.lit(False)))
    return corpus.vocabulary(fields, "unit").select("semantic_class", "key_name", F.array_join("units", ",").alias("units"))


@query("""SELECT c_nationkey AS unit, min(length(nfc_normalize(c_name || 'e' || chr(769))))::INT AS len_min, max(length(nfc_normalize(c_name || 'e' || chr(769))))::INT AS len_max, count(*) AS sample_count, 1::BIGINT AS unique_patterns FROM customer GROUP BY 1""")
def value_nfc(spark, d):
    """Profiles of names with a combining mark, which is no character of its own after composing."""
    rec = F.to_json(F.struct(F.concat("c_name", F.lit("e\u0301")).alias("name")))
    leaf = structure.leaves(table(spark, d, "customer").select(F.col("c_nationkey").alias("unit"), "c_custkey", rec.alias("rec")), ["unit", "c_custkey"])
    return structure.profiles(leaf, ["unit"]).select("unit", "len_min", "len_max", "sample_count", "unique_patterns")


@query("""SELECT printf('u%08d', c_custkey) AS unit_id, 2 AS n_fields, 1 AS n_filled, CASE WHEN c_custkey % 3 = 0 THEN 'note' ELSE 'name' END AS missing, 3 AS n_rows, true AS ok FROM customer""")
def filled_units(spark, d):
    """Documents filled by a generator that drops the last field; structure holds whatever it drops."""
    units = _units(spark, d)
    done = fill.fill_units(units, lambda: fill.OfflineValues(drop=1))
    checked = render.verify(done, units).select("unit_id", "ok")
    return done.join(checked, "unit_id").select("unit_id", "n_fields", "n_filled", F.array_join("missing", ",").alias("missing"), "n_rows", "ok")


@query("SELECT 'json' AS fmt, count(*) AS n, count(*) AS n_ok, 1.0::DOUBLE AS ok_rate, 1.0::DOUBLE AS mean_jaccard FROM customer")
def compare_summary(spark, d):
    units = _units(spark, d)
    checked = render.verify(render.render_units(units), units).join(units.select("unit_id", "fmt"), "unit_id")
    return render.summary(checked, ["fmt"])


@query("SELECT c_custkey AS doc_id, true AS fits FROM customer")
def noise_damaged(spark, d):
    """Damage labels of examples mark just the characters that were put in."""
    docs = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), F.concat(F.lit("key,name\n"), F.concat_ws(",", _id(), "c_name"), F.lit("\n")).alias("text"))
    made = noise.examples(docs, size=96).join(docs, "doc_id")
    marked = F.aggregate("damaged", F.lit(0), lambda a, x: a + x)
    return made.select("doc_id", ((marked == F.greatest(F.lit(0), F.length("noised") - F.length("text"))) & (F.size("damaged") == 96)).alias("fits"))
