"""Command line: sniff, parse, extract, pipeline, compare."""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import corpus, render, structure
from lodestrata.sources.corpus import cross_table, read_files, sniff
from lodestrata.streaming.ingest import append_grades


def extract(sniffed: DataFrame, graded: DataFrame, mode: str = "template", sample_mode: str = "off") -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """Units, fields, samples, dedup clusters, global view and vocabulary of the tier-1 files; and what to unpersist after use.

    Records, their units and leaves are held on the executors' disks, since every result needs
    them; values aren't written to any table.
    """
    clean = sniffed.join(graded.where("tier = 'tier1'").select("path"), "path", "left_semi")
    recs = structure.records(clean).persist(StorageLevel.DISK_ONLY)
    keys = ["path", "fmt", "part", "rec_seq"]
    sigs = structure.signatures(recs, keys)
    clusters = structure.union_clusters(sigs, ["path", "fmt", "part"], "rec_seq").select("path", "fmt", "part", "shape", "cluster").distinct()
    unit = F.concat_ws("#", "path", "part", F.col("cluster").cast("string")).alias("unit_id")
    of = sigs.join(clusters, ["path", "fmt", "part", "shape"]).select(*keys, "sig", unit).persist(StorageLevel.DISK_ONLY)
    leaf = structure.leaves(recs, keys).join(of.select("path", "fmt", "part", "rec_seq", "unit_id"), keys).persist(StorageLevel.DISK_ONLY)
    units = structure.template(of, ["unit_id", "fmt"], "rec_seq")
    fields = structure.fields(leaf, ["unit_id"], "rec_seq", of)
    if mode == "template":
        first = of.join(units.select("unit_id", F.col("template").alias("sig")), ["unit_id", "sig"]).groupBy("unit_id").agg(F.min("rec_seq").alias("rec_seq"))
        backbone = leaf.join(first, ["unit_id", "rec_seq"], "left_semi").select("unit_id", "field_path").distinct()
        fields = fields.join(backbone, ["unit_id", "field_path"], "left_semi")
    skeleton = fields.groupBy("unit_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_path", "type")))).alias("skeleton"))
    units = units.join(skeleton, "unit_id")
    prints = corpus.file_fingerprints(clean).select(F.concat("path", F.lit("#csv#0")).alias("unit_id"), "fp")
    dedup = corpus.dedup_units(units, prints)
    found = {"units": corpus.keep_representatives(units, dedup), "fields": fields, "profiles": structure.profiles(leaf, ["unit_id"]), "samples": structure.samples(leaf, ["unit_id"], ["rec_seq", "leaf_seq"], sample_mode), "clusters": dedup, "global_view": corpus.global_view(fields, units), "vocabulary": corpus.vocabulary(fields, "unit_id"), "signatures": structure.signature_histogram(of, ["unit_id"], "rec_seq"), "skeletons": corpus.top_skeletons(units)}
    return found, [recs, of, leaf]


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="lodestrata")
    ap.add_argument("command", choices=["sniff", "parse", "extract", "pipeline", "compare"])
    ap.add_argument("root")
    ap.add_argument("-o", "--output", required=True)
    ap.add_argument("-f", "--format")
    ap.add_argument("--restart", action="store_true")
    ap.add_argument("--field-mode", choices=["template", "fold"], default="template")
    ap.add_argument("--keep-samples", action="store_true")
    ap.add_argument("--mask-samples", action="store_true")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    files = read_files(spark, a.root)
    sniffed = sniff(files)
    if a.format:
        sniffed = sniffed.where(F.col("fmt") == a.format)
    if a.command in ("sniff", "pipeline"):
        cross_table(sniffed).coalesce(1).write.mode("overwrite").json(f"{a.output}/sniff")
    if a.command == "sniff":
        return
    if a.restart:
        structure.grades(sniffed).write.mode("overwrite").parquet(f"{a.output}/grades")
    else:
        append_grades(files, f"{a.output}/grades")
    graded = spark.read.parquet(f"{a.output}/grades")
    structure.tier_counts(graded).coalesce(1).write.mode("overwrite").json(f"{a.output}/parse")
    structure.tier_samples(graded).coalesce(1).write.mode("overwrite").json(f"{a.output}/parse_samples")
    if a.command == "parse":
        return
    found, held = extract(sniffed, graded, a.field_mode, "masked" if a.mask_samples else "raw" if a.keep_samples else "off")
    for name, df in found.items():
        df.write.mode("overwrite").parquet(f"{a.output}/{name}")
    for df in held:
        df.unpersist()
    if a.command == "compare":
        units = spark.read.parquet(f"{a.output}/units")
        render.verify(render.render_units(units), units).write.mode("overwrite").parquet(f"{a.output}/compare")
        checked = spark.read.parquet(f"{a.output}/compare").join(units.select("unit_id", "fmt"), "unit_id")
        render.summary(checked, ["fmt"]).coalesce(1).write.mode("overwrite").json(f"{a.output}/compare_summary")


if __name__ == "__main__":
    main()
