"""Built-in expressions over delimited lines: widths, clean rows, drift, delimiter votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.fixed import JSON_ERRORS, UNSTEADY


def widths(lines: DataFrame, key: str, text: str, delimiter: str = ",") -> DataFrame:
    """(key, line_no, raw, core): cells of each quote-free line, and cells up to the last non-blank one."""
    cells = F.split(text, F.lit("\\Q" + delimiter + "\\E"))
    core = F.aggregate(F.transform(cells, lambda c, i: F.when(F.trim(c) != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return lines.where(F.trim(text) != "").select(key, "line_no", F.size(cells).alias("raw"), core.alias("core"))


def modal_width(rows: DataFrame, key: str) -> DataFrame:
    per = rows.groupBy(key, "raw").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    return per.groupBy(key).agg(F.max_by("raw", F.struct("n", -F.col("first"))).alias("modal"))


def judged_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the modal width of their document and whether they are clean: of that width, or only blank cells beyond it."""
    clean = (F.col("raw") == F.col("modal")) | ((F.col("raw") > F.col("modal")) & (F.col("core") <= F.col("modal")))
    return rows.join(modal_width(rows, key), key).withColumn("clean", clean)


def column_report(rows: DataFrame, key: str) -> DataFrame:
    """Clean rows against the modal width, strict share, drift (population CV of widths)."""
    joined, clean = judged_rows(rows, key), F.col("clean")
    return joined.groupBy(key).agg(F.max("modal").alias("modal"), F.count(F.lit(1)).alias("n_rows"), F.sum(clean.cast("long")).alias("n_clean"), F.round(F.avg(clean.cast("double")), 4).alias("I_strict"), F.round(F.stddev_pop("raw") / F.avg("raw"), 6).alias("drift"))


def delimiter_votes(lines: DataFrame, key: str, text: str, head: int = 20) -> DataFrame:
    """For each delimiter of the first lines: modal column count and its share."""
    first = lines.where(F.trim(text) != "").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).where(F.col("_n") <= head)
    marks = F.explode(F.array(*(F.struct(F.lit(n).alias("delimiter"), (F.length(text) - F.length(F.replace(F.col(text), F.lit(d), F.lit(""))) + 1).alias("cols")) for n, d in (("tab", "\t"), ("comma", ","), ("semicolon", ";"), ("pipe", "|"), ("colon", ":")))))
    per = first.select(key, "line_no", marks.alias("m")).groupBy(key, "m.delimiter", "m.cols").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    return per.groupBy(key, "delimiter").agg(F.max_by("cols", F.struct("n", -F.col("first"))).alias("cols"), F.round(F.max("n") / F.sum("n"), 4).alias("share"))


def noisy(lines: DataFrame, key: str, text: str, delimiter: str = ",", head: int = 20) -> DataFrame:
    """(key, noisy): whether the widths of the first ``head`` physical lines scatter, or the first has one cell; false below two lines that aren't blank."""
    first = lines.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).where((F.col("_n") <= head) & (F.trim(text) != ""))
    cells = F.length(text) - F.length(F.replace(F.col(text), F.lit(delimiter), F.lit(""))) + 1
    per = first.select(key, "line_no", cells.alias("cells")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("cells").alias("spread"), F.min_by("cells", "line_no").alias("first"))
    unsteady = (F.col("n") >= 2) & ((F.col("spread") > UNSTEADY) | (F.col("first") < 2))
    return lines.select(key).distinct().join(per, key, "left").select(key, F.coalesce(unsteady, F.lit(False)).alias("noisy"))


def json_error(message: Column) -> Column:
    """Kind of damage that a JSON reader's message tells of; null without a message."""
    low = F.lower(message)
    out = F.when(message.isNotNull(), F.lit("other"))
    for name, marks in reversed(JSON_ERRORS):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | low.contains(mark)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out
