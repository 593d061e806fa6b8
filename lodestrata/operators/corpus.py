"""Over all units: schema dedup with multiplicities, the global view, vocabulary alignment."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import parse


def dedup_schemas(units: DataFrame) -> DataFrame:
    """(unit_id, representative, cluster_size) of units (unit_id, fmt, skeleton map<path, type>).

    Units of one format and path set merge while no path's types differ; a null type matches any.
    Groups without nulls are plain equality; only distinct type vectors are walked, in order of first unit.
    """
    types = F.map_values("skeleton")
    norm = F.transform(types, lambda t: F.when(t.isin("int", "float", "num"), "num").when(t == "null", F.lit(None)).otherwise(t))
    vectors = units.select("unit_id", "fmt", F.to_json(F.array_sort(F.map_entries(F.map_from_arrays(F.map_keys("skeleton"), F.transform(norm, lambda t: F.coalesce(t, F.lit("*"))))))).alias("vec"), F.to_json(F.array_sort(F.map_keys("skeleton"))).alias("paths"))
    distinct = vectors.groupBy("fmt", "paths", "vec").agg(F.min("unit_id").alias("first"), F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        protos, heads, out = [], [], []
        for vec, first in pdf.sort_values("first")[["vec", "first"]].itertuples(index=False):
            v = [e["value"] for e in json.loads(vec)]
            for k, p in enumerate(protos):
                if v and all(a == b or "*" in (a, b) for a, b in zip(p, v, strict=True)):
                    protos[k] = [b if a == "*" else a for a, b in zip(p, v, strict=True)]
                    break
            else:
                k = len(protos)
                protos.append(v)
                heads.append(first)
            out.append((pdf["fmt"].iloc[0], pdf["paths"].iloc[0], vec, heads[k]))
        return pd.DataFrame(out, columns=["fmt", "paths", "vec", "representative"])

    merged = distinct.groupBy("fmt", "paths").applyInPandas(run, f"fmt string, paths string, vec string, representative {units.schema['unit_id'].dataType.simpleString()}")
    rep = vectors.join(merged, ["fmt", "paths", "vec"]).withColumn("representative", F.when(F.col("paths") == "[]", F.col("unit_id")).otherwise(F.col("representative")))
    size = rep.groupBy("representative").agg(F.count(F.lit(1)).alias("cluster_size"))
    return rep.join(size, "representative").select("unit_id", "representative", "cluster_size")


def csv_fingerprint(text: str, delimiter: str | None = None, most: int = 60) -> str:
    """H and the normalised header, or V, the modal width and each column's cell classes."""
    rows = parse.csv_rows(text, delimiter)[0][:most]
    if not rows:
        return ""
    number = lambda c: bool(c.strip()) and c.strip().replace(".", "").replace("-", "").replace(",", "").isdigit()
    if len(rows) > 1 and len(rows[0]) == len(rows[1]) and not any(map(number, rows[0])) and any(map(number, rows[1])):
        return json.dumps(["H", [c.strip().lower() for c in rows[0]]], ensure_ascii=False)
    widths = [len(r) for r in rows]
    modal = max(dict.fromkeys(widths), key=widths.count)
    kind = lambda c: None if not c.strip() else "str" if any(map(str.isalpha, c)) else "num" if any(map(str.isdigit, c)) else "other"
    body = [r for r in rows if len(r) == modal]
    return json.dumps(["V", modal, [sorted({kind(r[j]) for r in body} - {None}) for j in range(modal)]])


def dedup_csv(fingerprints: DataFrame) -> DataFrame:
    """(unit_id, representative, cluster_size) of (unit_id, fp); header prints match exactly, class prints merge when no column's classes are disjoint."""
    kind = fingerprints.schema["unit_id"].dataType.simpleString()
    buckets = fingerprints.where("fp <> ''").groupBy("fp").agg(F.min("unit_id").alias("first"))
    wide = buckets.where("fp like '[\"V\"%'").withColumn("width", F.get_json_object("fp", "$[1]"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        protos, heads, out = [], [], []
        for fp, first in pdf.sort_values("first")[["fp", "first"]].itertuples(index=False):
            cols = [set(c) for c in json.loads(fp)[2]]
            for k, p in enumerate(protos):
                if all(not a or not b or a & b for a, b in zip(p, cols, strict=True)):
                    protos[k] = [a | b for a, b in zip(p, cols, strict=True)]
                    break
            else:
                k = len(protos)
                protos.append(cols)
                heads.append(first)
            out.append((fp, heads[k]))
        return pd.DataFrame(out, columns=["fp", "representative"])

    merged = wide.groupBy("width").applyInPandas(run, f"fp string, representative {kind}").union(buckets.where("fp like '[\"H\"%'").select("fp", "first"))
    rep = fingerprints.join(merged, "fp", "left").select("unit_id", F.coalesce("representative", "unit_id").alias("representative"))
    return rep.join(rep.groupBy("representative").agg(F.count(F.lit(1)).alias("cluster_size")), "representative").select("unit_id", "representative", "cluster_size")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(unit_id, fp) of CSV documents (unit_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [csv_fingerprint(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("unit_id"), pa.array(fp, pa.string())], names=["unit_id", "fp"])

    return docs.select("unit_id", "text").mapInArrow(run, f"unit_id {docs.schema['unit_id'].dataType.simpleString()}, fp string")


def file_fingerprints(sniffed: DataFrame) -> DataFrame:
    """(path, fp) of the CSV and TSV files among ``sniffed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = zip(*(b.column(c).to_pylist() for c in ("fmt", "encoding", "content")), strict=True)
            fp = [csv_fingerprint(parse.decode(raw or b"", enc).removeprefix("\ufeff"), "\t" if fmt == "tsv" else None) for fmt, enc, raw in cells]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(fp, pa.string())], names=["path", "fp"])

    return sniffed.where(F.col("fmt").isin("csv", "tsv")).select("path", "fmt", "encoding", "content").mapInArrow(run, "path string, fp string")


def dedup_units(units: DataFrame, prints: DataFrame) -> DataFrame:
    """(unit_id, representative, cluster_size) of all units: those with a fingerprint (unit_id, fp) merge by it, the others by their schemas."""
    rest = units.join(prints.select("unit_id"), "unit_id", "left_anti")
    return dedup_schemas(rest).unionByName(dedup_csv(prints.join(units.select("unit_id"), "unit_id", "left_semi")))


def top_skeletons(units: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` templates that most units have: (rank, template, units, records), the smaller template first of equals."""
    per = units.groupBy("template").agg(F.count(F.lit(1)).alias("units"), F.sum("n_records").alias("records"))
    top = per.orderBy(F.desc("units"), "template").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("units"), "template")).alias("rank"), "template", "units", "records")


def keep_representatives(units: DataFrame, clusters: DataFrame) -> DataFrame:
    return units.join(clusters.where("unit_id = representative").select("unit_id", "cluster_size"), "unit_id")


def global_view(fields: DataFrame, units: DataFrame) -> DataFrame:
    """One row: distinct skeletons B, distinct field paths A, A/B, personal-data fields, records, units."""
    f = fields.agg(F.countDistinct("field_path").alias("A"), F.sum(F.col("pii").isNotNull().cast("long")).alias("pii_seeds"))
    u = units.agg(F.countDistinct("template").alias("B"), F.count(F.lit(1)).alias("units"), F.sum("n_records").alias("records"))
    return u.crossJoin(f).select("A", "B", F.round(F.col("A") / F.col("B"), 3).alias("A_per_B"), "pii_seeds", "records", "units")  # one row by one row


def bands(profiles: DataFrame) -> Column:
    """Length band of a field from its type and mean length: the type and the rounded binary logarithm, ``nolen`` without lengths."""
    mean = profiles["len_mean"]
    return F.when(profiles["type"].isNotNull(), F.concat_ws(":", profiles["type"], F.when(mean > 0, F.bround(F.log2(mean + 1)).cast("int").cast("string")).otherwise(F.lit("nolen"))))


def _closure(edges: list[tuple[str, str]]) -> dict[str, str]:
    """The smallest of the keys that each key reaches."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def vocabulary(fields: DataFrame, unit: str, evidence_b: bool = False) -> DataFrame:
    """(semantic_class, key_name, units): fields aligned by shared personal-data type, else by key.

    With ``evidence_b`` fields also join by their ``band`` (:func:`bands`), if two units or more
    share it, and by what that reaches: types and bands are the nodes of a graph whose edges
    are the fields that have both. There are a few types and, lengths being rounded to powers
    of two, some dozens of bands for each, so the driver closes the graph over them. A class is
    named by its most frequent personal-data type, else by its most frequent key (the smallest
    of several).
    """
    pii = F.when(F.col("pii.level") == "high_conf", F.col("pii.type"))
    base = fields.select(unit, "key_name", pii.alias("pii_type"), *(["band"] if evidence_b else [F.lit(None).cast("string").alias("band")]))
    if evidence_b:
        wide = base.groupBy("band").agg(F.countDistinct(unit).alias("k")).where("k >= 2").select("band", F.lit(True).alias("ok"))
        base = base.join(F.broadcast(wide), "band", "left").withColumn("band", F.when(F.col("ok"), F.col("band"))).drop("ok")
    node = F.coalesce(F.concat(F.lit("type:"), "pii_type"), F.concat(F.lit("band:"), "band"))
    edges = base.where("pii_type is not null and band is not null").select(F.concat(F.lit("type:"), "pii_type").alias("a"), F.concat(F.lit("band:"), "band").alias("b")).distinct()
    reached = _closure(sorted(tuple(r) for r in edges.collect())) if evidence_b else {}
    labels = fields.sparkSession.createDataFrame(sorted(reached.items()), "node string, label string")
    placed = base.withColumn("node", node).join(F.broadcast(labels), "node", "left").withColumn("cluster", F.coalesce("label", "node", F.concat(F.lit("key:"), "key_name")))
    names = placed.groupBy("cluster", "pii_type", "key_name").agg(F.count(F.lit(1)).alias("n"))
    most = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col("n")).alias("n"), c))).getField(c)
    types = names.groupBy("cluster", "pii_type").agg(F.sum("n").alias("n")).groupBy("cluster").agg(most("pii_type").alias("modal_type"))
    keys = names.groupBy("cluster", "key_name").agg(F.sum("n").alias("n")).groupBy("cluster").agg(most("key_name").alias("modal_key"))
    cls = F.coalesce(F.concat(F.lit("<"), F.upper("modal_type"), F.lit(">")), F.col("modal_key"))
    return placed.join(types.join(keys, "cluster"), "cluster").withColumn("semantic_class", cls).groupBy("semantic_class", "key_name").agg(F.array_sort(F.collect_set(unit)).alias("units"))


def similarity(a: str, b: str) -> float:
    a, b = (re.sub(r"[_\-\s]+", "", s.lower()) for s in (a, b))
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def name_conflicts(vocab: DataFrame, least: float = 0.45) -> DataFrame:
    """Pairs of key names in one class that look unlike each other; classes hold few names, and each distinct pair is rated once."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rated = [similarity(a, b) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(rated, pa.float64())], names=["a", "b", "similarity"])

    a, b = vocab.select("semantic_class", F.col("key_name").alias("a")), vocab.select("semantic_class", F.col("key_name").alias("b"))
    pairs = a.join(b, "semantic_class").where("a < b")
    rated = pairs.select("a", "b").distinct().mapInArrow(rate, "a string, b string, similarity double").where(F.col("similarity") < least)
    return pairs.join(rated, ["a", "b"]).select("semantic_class", "a", "b", "similarity")


def uncertain(vocab: DataFrame, least: float = 0.45) -> DataFrame:
    """(semantic_class, key_names, units) of the classes that hold two names unlike each other."""
    doubted = name_conflicts(vocab, least).select("semantic_class").distinct()
    return vocab.join(doubted, "semantic_class", "left_semi").groupBy("semantic_class").agg(F.array_sort(F.collect_set("key_name")).alias("key_names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("units")))).alias("units"))
