"""Records, leaves, units and fields: the long tables that every later operator aggregates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import chars, fixed, parse

GRADE = "path string, fmt string, encoding string, conf double, tier string, I double, I_strict double, n_form string, n_struct double, n_detail string, error string, n_unit long, n_clean long"


def grades(sniffed: DataFrame) -> DataFrame:
    """How cleanly each file parses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, fmt, enc, conf, raw in zip(*(b.column(c).to_pylist() for c in ("path", "fmt", "encoding", "conf", "content")), strict=True):
                g = parse.grade(fmt, raw or b"", None if enc == "binary" else enc)
                rows.append((path, fmt, enc, conf, g["tier"], g["I"], g["I_strict"], g["n_form"], g["n_struct"], g["detail"], g["error"], g["n_unit"], g["n_clean"]))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[c.split()[0] for c in GRADE.split(", ")]), schema=pa.schema([(c.split()[0], {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}[c.split()[1]]) for c in GRADE.split(", ")]), preserve_index=False)

    return sniffed.select("path", "fmt", "encoding", "conf", "content").mapInArrow(run, GRADE)


def strict_report(graded: DataFrame) -> DataFrame:
    """Strict verdict and deviations of each file: clean means tier 1 with every unit clean."""
    return graded.select("path", (F.col("tier") == "tier1").alias("clean"), (F.col("n_unit") - F.col("n_clean")).alias("deviations"), "n_unit", F.coalesce("n_form", "error").alias("reason"))


def tier_counts(graded: DataFrame) -> DataFrame:
    return graded.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def tier_samples(graded: DataFrame, k: int = 200) -> DataFrame:
    """The first ``k`` paths of each tier with their reasons: (tier, rank, path, reason); ``k`` is the report's length."""
    rank = F.row_number().over(Window.partitionBy("tier").orderBy("path"))
    return graded.select("tier", rank.alias("rank"), "path", F.coalesce("n_form", "error").alias("reason")).where(F.col("rank") <= k)


def records(sniffed: DataFrame, most: int | None = None) -> DataFrame:
    """(path, fmt, part, rec_seq, rec): records as JSON text, by file and explicit partition; the first ``most`` of each, if set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, fmt, enc, raw in zip(*(b.column(c).to_pylist() for c in ("path", "fmt", "encoding", "content")), strict=True):
                got = parse.file_records(fmt, raw or b"", None if enc == "binary" else enc, most)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(got), pa.string()), pa.array([fmt] * len(got), pa.string()), pa.array([p for p, _ in got], pa.string()), pa.array(range(len(got)), pa.int64()), pa.array([json.dumps(r, ensure_ascii=False, default=str) for _, r in got], pa.string())], names=["path", "fmt", "part", "rec_seq", "rec"])

    return sniffed.select("path", "fmt", "encoding", "content").mapInArrow(run, "path string, fmt string, part string, rec_seq long, rec string")


def leaves(recs: DataFrame, keys: list[str], column: str = "rec") -> DataFrame:
    """One row for each leaf of each JSON record: (*keys, leaf_seq, field_path, type, value); strings in normal form C."""
    schema = recs.select(*keys).schema
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "leaf_seq long, field_path string, type string, value string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, seq, path, kind, value = [], [], [], [], []
            for i, text in enumerate(b.column(column).to_pylist()):
                rec = parse.json_line(text) if text else None
                for k, (p, v) in enumerate(parse.leaves(rec) if isinstance(rec, dict | list) else ()):
                    at.append(i)
                    seq.append(k)
                    path.append(p)
                    kind.append(parse.type_tag(v))
                    value.append(None if v is None else parse.composed(v) if isinstance(v, str) else json.dumps(v))
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(index) for c in keys), pa.array(seq, pa.int64()), pa.array(path, pa.string()), pa.array(kind, pa.string()), pa.array(value, pa.string())], names=[*keys, "leaf_seq", "field_path", "type", "value"])

    return recs.select(*keys, column).mapInArrow(run, ddl)


def field_types(leaf: DataFrame, unit: list[str], record: str, recs: DataFrame | None = None) -> DataFrame:
    """Per unit and path: records with a value, occurrence, dominant type (first seen of several) and its share, all types.

    Occurrence is over all records of ``recs``, those without leaves too; without ``recs`` over
    those with leaves. A path that is always null has type null and occurrence 0.
    """
    total = (leaf if recs is None else recs).groupBy(*unit).agg(F.countDistinct(record).alias("n_records"))
    some = F.col("type") != "null"
    per = leaf.groupBy(*unit, "field_path", record).agg(F.collect_list("type").alias("kinds"))  # one row for each record and path
    kinds = per.select(*unit, "field_path", record, F.explode("kinds").alias("type"))
    typed = kinds.groupBy(*unit, "field_path", "type").agg(F.count(F.lit(1)).alias("n"), F.min(record).alias("first"))
    best = typed.groupBy(*unit, "field_path").agg(F.min(F.when(some, F.struct((-F.col("n")).alias("n"), "first", "type"))).alias("top"), F.sum(F.when(some, F.col("n"))).alias("n"), F.array_sort(F.collect_set(F.when(some, F.col("type")))).alias("types"))
    seen = per.groupBy(*unit, "field_path").agg(F.sum(F.exists("kinds", lambda k: k != "null").cast("long")).alias("n_present"))
    share = F.round(-F.col("top.n") / F.col("n"), 4)
    return best.join(seen, [*unit, "field_path"]).join(total, unit).select(*unit, "field_path", F.coalesce("top.type", F.lit("null")).alias("type"), share.alias("dominant_ratio"), "types", "n_present", F.round(F.col("n_present") / F.col("n_records"), 4).alias("occurrence"))


def signatures(recs: DataFrame, keys: list[str], column: str = "rec") -> DataFrame:
    """Exact structure signature of each record, with its sorted leaf types as a shape."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in recs.select(*keys).schema), "sig string, shape string, multi boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vals = [parse.json_line(t) if t else None for t in b.column(column).to_pylist()]
            shapes = [parse.leaf_types(v) for v in vals]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array([parse.signature(v) for v in vals], pa.string()), pa.array([json.dumps(sorted((p, sorted(t)) for p, t in s.items()), ensure_ascii=False) for s in shapes], pa.string()), pa.array([any(len(t) > 1 for t in s.values()) for s in shapes], pa.bool_())], names=[*keys, "sig", "shape", "multi"])

    return recs.select(*keys, column).mapInArrow(run, ddl)


def template(sigs: DataFrame, unit: list[str], seq: str) -> DataFrame:
    """Modal exact signature of each unit (first seen of several) and how many differ."""
    per = sigs.groupBy(*unit, "sig").agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
    return per.groupBy(*unit).agg(F.max_by("sig", F.struct("n", -F.col("first"))).alias("template"), F.count(F.lit(1)).alias("n_signatures"), F.sum("n").alias("n_records"))


def signature_histogram(sigs: DataFrame, unit: list[str], seq: str, k: int = 50) -> DataFrame:
    """The ``k`` most frequent exact signatures of each unit, the first seen of equals first: (*unit, rank, sig, n, n_signatures)."""
    per = sigs.groupBy(*unit, "sig").agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc("n"), "first"))
    every = F.count(F.lit(1)).over(Window.partitionBy(*unit))
    return per.withColumn("rank", rank).withColumn("n_signatures", every).where(F.col("rank") <= k).select(*unit, "rank", "sig", "n", "n_signatures")


def union_clusters(sigs: DataFrame, unit: list[str], seq: str) -> DataFrame:
    """(*unit, shape, cluster): greedy union-schema clusters over each unit's distinct shapes, in order of appearance.

    Shapes of one type a path fall together whatever their records' order, so only distinct
    shapes are walked. Where a record has several types at one path, its unit is walked record by record.
    """
    mixed = sigs.groupBy(*unit).agg(F.max("multi").alias("mixed"))
    joined = sigs.join(mixed, unit)
    brief = joined.where("not mixed").groupBy(*unit, "shape").agg(F.min(seq).alias("first"), F.count(F.lit(1)).alias("n"))
    walked = brief.unionByName(joined.where("mixed").select(*unit, "shape", F.col(seq).alias("first"), F.lit(1).cast("long").alias("n")))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sigs.select(*unit).schema), "shape string, cluster int, first long, n long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", kind="stable")
        pdf["cluster"] = parse.cluster_shapes([{p: set(t) for p, t in json.loads(s)} for s in pdf["shape"]])
        return pdf[[*unit, "shape", "cluster", "first", "n"]]

    return walked.groupBy(*unit).applyInPandas(run, ddl)


def topology(paths: DataFrame, unit: list[str]) -> DataFrame:
    """Every path and ancestor with depth, parent and siblings."""
    parts = F.split("field_path", r"\.")
    nodes = paths.select(*unit, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("node")).distinct()
    nodes = nodes.withColumn("depth", F.size(F.split("node", r"\."))).withColumn("parent", F.when(F.col("depth") > 1, F.regexp_replace("node", r"\.[^.]*$", "")))
    around = Window.partitionBy(*unit, "parent")
    return nodes.select(*unit, "node", "depth", "parent", F.regexp_replace(F.element_at(F.split("node", r"\."), -1), r"\[.*$", "").alias("key_name"), F.array_except(F.array_sort(F.collect_set("node").over(around)), F.array("node")).alias("siblings"))


def profiles(leaf: DataFrame, unit: list[str]) -> DataFrame:
    """Value profile of each field: lengths (null counts as 0, numbers carry none), mean class shares, patterns."""
    v = F.when(F.col("type") == "str", F.col("value"))
    n = F.when(F.col("type") == "null", 0).when(F.col("type") == "str", F.length("value"))
    rows = leaf.select(*unit, "field_path", "type", v.alias("s"), n.alias("n"), chars.pattern(v).alias("pattern"), chars.char_dist(v).alias("dist"))
    shares = [F.round(F.avg(f"dist.{k}"), 3).alias(f"avg_{k}") for k in chars.CLASSES]
    return rows.groupBy(*unit, "field_path").agg(F.count(F.lit(1)).alias("sample_count"), F.min("n").alias("len_min"), F.max("n").alias("len_max"), F.round(F.avg("n"), 1).alias("len_mean"), F.round(F.median("n"), 1).alias("len_median"), F.round(F.stddev_pop("n"), 1).alias("len_std"), F.count_distinct("pattern").alias("unique_patterns"), *shares)


def top_patterns(leaf: DataFrame, unit: list[str], order: list[str], k: int = 10) -> DataFrame:
    rows = leaf.where("type = 'str'").select(*unit, "field_path", chars.pattern(F.col("value")).alias("pattern"), F.struct(*order).alias("at"))
    per = rows.groupBy(*unit, "field_path", "pattern").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*unit, "field_path").orderBy(F.desc("n"), "first"))
    return per.withColumn("rank", rank).where(F.col("rank") <= k).select(*unit, "field_path", "rank", "pattern", "n")


def samples(leaf: DataFrame, unit: list[str], order: list[str], mode: str = "masked", k: int = 5) -> DataFrame:
    """Up to ``k`` values of each field, the first of each pattern (of each type for others than strings); mode off, raw or masked."""
    kind = F.when(F.col("type") == "str", chars.pattern(F.col("value"))).otherwise(F.col("type"))
    first = leaf.where("type <> 'null'").select(*unit, "field_path", kind.alias("kind"), F.struct(F.struct(*order).alias("at"), "value", "type").alias("r")).groupBy(*unit, "field_path", "kind").agg(F.min("r").alias("r"))
    rank = F.row_number().over(Window.partitionBy(*unit, "field_path").orderBy("r.at"))
    kept = first.withColumn("rank", rank).where(F.col("rank") <= (0 if mode == "off" else k))
    shown = chars.truncate(F.col("r.value"))
    shown = F.when(F.col("r.type") == "bool", F.lit("<bool>")).otherwise(chars.mask(shown)) if mode == "masked" else shown
    return kept.select(*unit, "field_path", "rank", shown.alias("sample"))


def free_text(leaf: DataFrame, unit: list[str]) -> DataFrame:
    s = leaf.where("type = 'str'")
    return s.groupBy(*unit, "field_path").agg(((F.avg(F.length("value")) >= fixed.FREE_TEXT_LENGTH) & (F.avg(F.col("value").rlike(fixed.PUNCTUATION).cast("int")) > 0.3)).alias("free_text"))


def fields(leaf: DataFrame, unit: list[str], record: str, recs: DataFrame | None = None) -> DataFrame:
    """Fields with type, occurrence, requiredness and personal-data seed."""
    typed = field_types(leaf, unit, record, recs).join(free_text(leaf, unit), [*unit, "field_path"], "left")
    key = F.regexp_replace(F.element_at(F.split("field_path", r"\."), -1), r"\[.*$", "")
    return typed.withColumn("key_name", key).withColumn("required", F.col("occurrence") >= 0.9).withColumn("pii", chars.pii_seed(F.col("key_name"), F.coalesce("free_text", F.lit(False))))
