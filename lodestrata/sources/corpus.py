"""Files of a corpus, and the format each is really in."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fixed, parse

TRUSTED = ("json", "jsonl", "ndjson", "csv", "tsv", "sql", "xlsx")
ORDER = ("json", "jsonl", "csv", "tsv", "sql", "log", "free_text")


def extension(path):
    """Lower-cased extension without its dot; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, length, content) of all non-empty files below ``root``; content is only read if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where("length > 0").select("path", extension(F.col("path")).alias("ext"), "length", "content")


_BRACKETS = re.compile(r"[\[\]{}]")


def _balanced(text: str) -> bool:
    stack = []
    for m in _BRACKETS.finditer(text):
        if (ch := m[0]) in "{[":
            stack.append("}" if ch == "{" else "]")
        elif not stack or stack.pop() != ch:
            return False
    return not stack


def head_lines(text: str, most: int) -> list[str]:
    """The first ``most`` lines that aren't blank, whole and stripped."""
    out, at, size = [], 0, fixed.HEAD_BYTES
    while len(out) < most and at < len(text):
        part = text[at : at + size]
        rows = part.splitlines(keepends=True)
        if at + len(part) < len(text):  # the last line may go on, and a carriage return be half an end
            rows.pop()
        if not rows:
            size *= 2
            continue
        out += [x for row in rows if (x := row.strip())]
        at += sum(map(len, rows))
    return out[:most]


def column_profile(lines: list[str], delimiter: str) -> tuple[int, float]:
    """Modal column count and its share of the lines; the first seen of several."""
    n, times = Counter(x.count(delimiter) + 1 for x in lines).most_common(1)[0]
    return n, times / len(lines)


def vote_format(lines: list[str], text: str) -> dict[str, float]:
    """Additive scores of each format from the first lines of a text; brackets are balanced over the whole text."""
    score = dict.fromkeys(ORDER, 0.0)
    if not lines:
        return score
    n = len(lines)
    if lines[0][0] in "{[":
        score["json"] += 0.6 + 0.3 * _balanced(text)
    if sum(parse.json_line(x) is not None for x in lines) > 0.8 * n:
        score["jsonl"] += 0.9
    starts = any(re.match(fixed.SQL_START, x, re.I) for x in lines)
    if starts and any(x.endswith(";") for x in lines):
        score["sql"] += 0.95
    elif starts or re.search(fixed.SQL_KEYWORD, text[: fixed.HEAD_BYTES], re.I):
        score["sql"] += 0.7
    if sum(bool(re.search(fixed.LOG_TIME, x) and re.search(fixed.LOG_LEVEL, x, re.I)) for x in lines) > 0.6 * n:
        score["log"] += 0.95
    elif sum(bool(re.search(fixed.LOG_WEAK, x, re.I)) for x in lines) > 0.6 * n:
        score["log"] += 0.85
    fits = (d for d in "\t,;|:" for width, share in [column_profile(lines, d)] if width >= 2 and share >= 0.7)
    if best := next(fits, None):
        header = len(re.findall(r"\w", lines[0])) > len(lines[0]) / 2
        score["tsv" if best == "\t" else "csv"] += 0.8 + 0.1 * header
    talk = sum(bool(re.search(fixed.PUNCTUATION, x)) for x in lines) > 0.3 * n
    if sum(map(len, lines)) / n > 40 and talk and all(v < 0.5 for v in score.values()):
        score["free_text"] += 0.5
    return score


def sniff_content(raw: bytes) -> tuple[str, str, float]:
    """(format, encoding, confidence) by content alone."""
    if parse.is_binary(raw):
        return "binary_unknown", "binary", 0.6
    encoding = parse.encoding_of(raw)
    text = parse.decode(raw, encoding).removeprefix("﻿")
    score = vote_format(head_lines(text, fixed.HEAD_LINES), text)
    fmt = max(ORDER, key=lambda k: score[k])
    return (fmt if score[fmt] >= fixed.ACCEPT else "free_text"), encoding, round(score[fmt], 4)


def sniff(files: DataFrame) -> DataFrame:
    """(path, ext, fmt, encoding, conf, content): trusted extensions are believed, the rest voted on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ext, raw in zip(batch.column("ext").to_pylist(), batch.column("content").to_pylist(), strict=True):
                raw = raw or b""
                out.append(("jsonl" if ext == "ndjson" else ext, "binary" if ext == "xlsx" else parse.encoding_of(raw), 1.0) if ext in TRUSTED else sniff_content(raw))
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("ext"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)), batch.column("content")], names=["path", "ext", "fmt", "encoding", "conf", "content"])

    return files.select("path", "ext", "content").mapInArrow(run, "path string, ext string, fmt string, encoding string, conf double, content binary")


def cross_table(sniffed: DataFrame) -> DataFrame:
    """Files by extension and real format."""
    return sniffed.groupBy("ext", "fmt").agg(F.count(F.lit(1)).alias("n"))


def graded_cross_table(graded: DataFrame) -> DataFrame:
    """The same from a table of grades, without sniffing again."""
    return cross_table(graded.withColumn("ext", extension(F.col("path"))))


def low_confidence(sniffed: DataFrame, most: int = 200) -> DataFrame:
    return sniffed.where(F.col("conf") < fixed.LOW_CONFIDENCE).select("path", "ext", "fmt", "conf").orderBy("path").limit(most)
