"""One damage done to clean CSV text, and labels of every character of the result."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.parse import csv_cells

INSERTED = -2
CLS, SEP, PAD, IGNORE = 0xE000, 0xE001, 0, -100
EFFECTS = {"A": ("truncation", "unclosed_quote"), "B": ("unescaped_delimiter",), "C": ("delete_delimiter",)}


def classify(v: str) -> str:
    """Type of a cell as Python reads it."""
    if not v.strip():
        return "null"
    if v.strip().lower() in ("true", "false"):
        return "bool"
    for kind in (int, float):
        try:
            kind(v)
            return kind.__name__
        except ValueError:
            pass
    return "str"


def align(text: str) -> dict[int, tuple[int, int, str]]:
    return {i: (r, c, k) for r, c, a, b in csv_cells(text) for k in (classify(text[a:b]),) for i in range(a, b)}


def edit(text: str, at: int, drop: int, add: str) -> tuple[str, list[int]]:
    """Text with one edit, and where each of its characters was before (INSERTED for new ones)."""
    return text[:at] + add + text[at + drop :], [*range(at), *[INSERTED] * len(add), *range(at + drop, len(text))]


def damage(kind: str, text: str, rng: random.Random) -> tuple[str, list[int]] | None:
    cells = [c for c in csv_cells(text) if c[0] > 0]
    if kind == "truncation":
        return edit(text, cut := rng.randrange((len(text) + 1) // 2, len(text)), len(text) - cut, "") if len(text) >= 4 else None
    if kind == "delete_delimiter":
        marks = [b for r, _, _, b in cells if b < len(text) and text[b] == ","]
        return edit(text, rng.choice(marks), 1, "") if marks else None
    least = 2 if kind == "unescaped_delimiter" else 1
    fit = [(a, b) for _, _, a, b in cells if b - a >= least and '"' not in text[a:b]]
    if not fit:
        return None
    a, b = rng.choice(fit)
    return edit(text, (a + b) // 2, 0, ",") if kind == "unescaped_delimiter" else edit(text, a, 0, '"')


def inject(text: str, rng: random.Random, tries: int = 6) -> tuple[str, list[int], str]:
    """One damage of a uniformly chosen effect; unchanged if none fits after ``tries``."""
    for _ in range(tries):
        effect = rng.choice(sorted(EFFECTS))
        if done := damage(rng.choice(EFFECTS[effect]), text, rng):
            return *done, effect
    return text, list(range(len(text))), ""


def boundaries(cells: list[tuple | None]) -> tuple[list[int], list[int], list[int]]:
    """For each character the column of its cell, whether a field begins there, and whether a record does."""
    field, new_field, new_record, last = [], [], [], None
    for cell in cells:
        field.append(cell[1] if cell else IGNORE)
        new_field.append(int(bool(cell) and (last is None or cell[:2] != last[:2])))
        new_record.append(int(bool(cell) and (last is None or cell[0] != last[0])))
        last = cell or last
    return field, new_field, new_record


def encode(text: str, size: int) -> list[int]:
    """Code points between CLS and SEP, cut and padded to ``size``."""
    body = [ord(c) for c in text][: size - 2]
    return [CLS, *body, SEP, *[PAD] * (size - 2 - len(body))]


def example(text: str, rng: random.Random, columns: dict[int, int] | None = None, size: int = 512) -> dict:
    """Labelled training example of a damaged text: code points and, for each, field, boundaries and damage."""
    before = align(text)
    noised, source, effect = inject(text, rng)
    oracle = [before.get(s) if s >= 0 else None for s in source]
    field, new_field, new_record = boundaries(oracle)
    damaged = [int(s == INSERTED) for s in source]
    spans = observe(noised)
    anchor = []
    for _, _, a, b in spans:
        rows = Counter(oracle[i][0] for i in range(a, b) if oracle[i])
        anchor.append(max(rows, key=lambda r: (rows[r], -r)) if rows else -1)
    n = min(len(noised), size - 2)
    room = size - 2 - n
    wrap = lambda xs, edge, pad: [edge, *xs[:n], edge, *[pad] * room]
    return {"input_ids": encode(noised, size), "attention": [1] * (n + 2) + [0] * room, "field": wrap(field, IGNORE, IGNORE), "new_field": wrap(new_field, 0, 0), "new_record": wrap(new_record, 0, 0), "damaged": wrap(damaged, 0, 0), "spans": [[a + 1, b + 1] for _, _, a, b in spans], "anchor": anchor, "effect": effect, "noised": noised}


def observe(text: str) -> list[tuple[int, int, int, int]]:
    """Cells as a reader of the damaged text sees them; an unclosed quote runs to the end."""
    return csv_cells(text)


def examples(docs: DataFrame, size: int = 512) -> DataFrame:
    """Examples of documents (doc_id, text), seeded by doc_id."""
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            out = [example(t or "", random.Random(f"{i}"), size=size) for i, t in zip(ids, b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([e[k] for e in out], ints) for k in ("input_ids", "attention", "field", "new_field", "new_record", "damaged", "anchor")), pa.array([e["effect"] for e in out], pa.string()), pa.array([e["noised"] for e in out], pa.string())], names=["doc_id", "input_ids", "attention", "field", "new_field", "new_record", "damaged", "anchor", "effect", "noised"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, input_ids array<int>, attention array<int>, field array<int>, new_field array<int>, new_record array<int>, damaged array<int>, anchor array<int>, effect string, noised string")


def clean_labels(docs: DataFrame, key: str) -> DataFrame:
    """(key, char_idx, field, new_field) of every character of undamaged texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, field, new = [], [], [], []
            for i, t in zip(b.column(key).to_pylist(), b.column("text").to_pylist(), strict=True):
                cells = align(t or "")
                f, n, _ = boundaries([cells.get(k) for k in range(len(t or ""))])
                ids += [i] * len(f)
                at += range(len(f))
                field += f
                new += n
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(key).type), *(pa.array(x, pa.int32()) for x in (at, field, new))], names=[key, "char_idx", "field", "new_field"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, char_idx int, field int, new_field int")


def encoded(docs: DataFrame, key: str, pad: int = 0) -> DataFrame:
    """(key, input_ids): code points of whole texts between their marks, and ``pad`` places more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode(t or "", len(t or "") + 2 + pad) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(ids, pa.list_(pa.int32()))], names=[key, "input_ids"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, input_ids array<int>")


def truncate_by_hash(text: Column, key: Column) -> Column:
    """A cut in the second half of the text, placed by the key: reproducible in SQL."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.when(F.length(text) >= 4, F.substring(text, F.lit(1), half + F.pmod(key, F.length(text) - half).cast("int"))).otherwise(text)
