"""Documents rendered back from schemas, checked by reading them again; pluggable text generators."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import random
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import parse

TABULAR = ("csv", "tsv", "sql")


def surface(fmt: str) -> str:
    return "csv" if fmt == "xlsx" else fmt


def seed_of(unit_id: str) -> int:
    return int(hashlib.md5(unit_id.encode()).hexdigest()[:8], 16)


def default_value(kind: str, rng: random.Random, length: int | None = None):
    match kind:
        case "int" | "num":
            return rng.randrange(100_000)
        case "float":
            return round(rng.uniform(0, 9999), 2)
        case "bool":
            return rng.random() < 0.5
        case "null" | None:
            return None
    n = min(length, 24) if length else rng.randint(4, 12)
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))


def unfold(skeleton: dict[str, str], value: Callable[[str, str], object]) -> dict:
    """A record from folded paths; each array gets two elements; a path that clashes with another's type is left out."""
    tree: dict = {}
    for path, kind in sorted(skeleton.items()):
        at = tree
        parts = [p for name in path.split(".") for p in [re.sub(r"(\[\])+$", "", name), *["[]"] * name.count("[]")] if p]
        for p in parts[:-1]:
            at = at.setdefault(p, {}) if isinstance(at, dict) else {}
        if isinstance(at, dict):
            at.setdefault(parts[-1], (path, kind))

    def build(node):
        if isinstance(node, tuple):
            return value(*node)
        if set(node) == {"[]"}:
            return [build(node["[]"]) for _ in range(2)]
        return {k: build(v) for k, v in node.items() if k != "[]"}

    return build(tree)


def sql_type(kind: str) -> str:
    return {"int": "INT", "num": "INT", "float": "DOUBLE", "bool": "BOOLEAN", "null": "TEXT"}.get(kind, "VARCHAR(255)")


def write(fmt: str, name: str, skeleton: dict[str, str], rows: list[dict]) -> str:
    """Rows in a format's text."""
    if fmt == "json":
        return json.dumps(rows, ensure_ascii=False, indent=2)
    if fmt == "jsonl":
        return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
    cell = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    if fmt in ("csv", "tsv"):
        out = io.StringIO()
        w = csv.writer(out, delimiter="\t" if fmt == "tsv" else ",", lineterminator="\n")
        w.writerow(list(skeleton))
        w.writerows([[cell(r.get(c)) for c in skeleton] for r in rows])
        return out.getvalue()
    table = re.sub(r"\W", "_", name) or "t"
    quoted = lambda v: "NULL" if v is None else cell(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("\n", " ").replace("'", "''") + "'"
    head = f"CREATE TABLE `{table}` (\n" + ",\n".join(f"  `{c}` {sql_type(k)}" for c, k in skeleton.items()) + "\n);\n"
    names = ", ".join(f"`{c}`" for c in skeleton)
    return head + "".join(f"INSERT INTO `{table}` ({names}) VALUES ({', '.join(quoted(r.get(c)) for c in skeleton)});\n" for r in rows)


def render(unit_id: str, fmt: str, skeleton: dict[str, str], n: int = 3, value: Callable | None = None) -> str:
    """A document of ``n`` records (two at least if tabular), the same for the same unit."""
    rng = random.Random(seed_of(unit_id))
    fill = value or (lambda path, kind: default_value(kind, rng))
    fmt = surface(fmt)
    rows = [{c: fill(c, k) for c, k in skeleton.items()} if fmt in TABULAR else unfold(skeleton, fill) for _ in range(max(2, n) if fmt in TABULAR else n)]
    return write(fmt, unit_id, skeleton, rows)


def recovered_paths(fmt: str, text: str) -> set[str]:
    return {p for _, r in parse.file_records(surface(fmt), text.encode(), "utf-8") for p, _ in parse.leaves(r)}


def render_units(units: DataFrame, n: int = 3) -> DataFrame:
    """(unit_id, fmt, text) of units (unit_id, fmt, skeleton map<path, type>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [render(u, f, dict(s), n) for u, f, s in zip(*(b.column(c).to_pylist() for c in ("unit_id", "fmt", "skeleton")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("unit_id"), b.column("fmt"), pa.array(text, pa.string())], names=["unit_id", "fmt", "text"])

    return units.select("unit_id", "fmt", "skeleton").mapInArrow(run, "unit_id string, fmt string, text string")


def write_rows(docs: DataFrame) -> DataFrame:
    """(unit_id, fmt, text) of documents (unit_id, fmt, skeleton map<path, type>, rows array of JSON objects)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = zip(*(b.column(c).to_pylist() for c in ("unit_id", "fmt", "skeleton", "rows")), strict=True)
            text = [write(surface(f), u, dict(s), [json.loads(r) for r in rows]) for u, f, s, rows in cells]
            yield pa.RecordBatch.from_arrays([b.column("unit_id"), b.column("fmt"), pa.array(text, pa.string())], names=["unit_id", "fmt", "text"])

    return docs.select("unit_id", "fmt", "skeleton", "rows").mapInArrow(run, "unit_id string, fmt string, text string")


def verify(rendered: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, jaccard, ok, missing, extra): paths read back from each document against the unit's."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted(recovered_paths(f, t)) for f, t in zip(b.column("fmt").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("unit_id"), pa.array(got, pa.list_(pa.string()))], names=["unit_id", "got"])

    recovered = rendered.select("unit_id", "fmt", "text").mapInArrow(read, "unit_id string, got array<string>")
    both = recovered.join(units.select("unit_id", F.map_keys("skeleton").alias("want")), "unit_id")
    union = F.size(F.array_union("got", "want"))
    return both.select("unit_id", F.round(F.when(union > 0, F.size(F.array_intersect("got", "want")) / union).otherwise(0.0), 3).alias("jaccard"), ((F.size("want") > 0) & (F.size(F.array_except("want", "got")) == 0)).alias("ok"), F.slice(F.array_sort(F.array_except("want", "got")), 1, 20).alias("missing"), F.slice(F.array_sort(F.array_except("got", "want")), 1, 20).alias("extra"))


def summary(verified: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, n_ok, ok_rate, mean_jaccard) of checked documents."""
    ok = F.col("ok").cast("long")
    return verified.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("n_ok"), F.round(F.avg(ok), 3).alias("ok_rate"), F.round(F.avg("jaccard"), 3).alias("mean_jaccard"))


class Client(Protocol):
    """A text generator; none that reaches a network is shipped."""

    def complete(self, prompt: str) -> str: ...


def prompt_for(fmt: str, skeleton: dict[str, str], n: int) -> str:
    return f"Write {n} records as {fmt}, nothing else.\nFields:\n" + "\n".join(f"- {p}: {k}" for p, k in skeleton.items())


def strip_fences(text: str) -> str:
    m = re.search(r"```\w*\n(.*?)```", text, re.S)
    return (m[1] if m else text).strip()


class OfflineClient:
    """Answers a prompt of :func:`prompt_for` without any model."""

    def complete(self, prompt: str) -> str:
        n, fmt = re.search(r"Write (\d+) records as (\w+)", prompt).groups()
        return render("offline", fmt, dict(re.findall(r"^- (.+): (\w+)$", prompt, re.M)), int(n))


def render_with(client: Client, unit_id: str, fmt: str, skeleton: dict[str, str], n: int = 3) -> tuple[str, str]:
    """(text, by): the client's document if its paths hold, after one more try else the template's."""
    prompt = prompt_for(surface(fmt), skeleton, n)
    for again in ("", "\nEvery field must be there."):
        text = strip_fences(client.complete(prompt + again))
        if set(skeleton) <= recovered_paths(fmt, text):
            return text, "client"
    return render(unit_id, fmt, skeleton, n), "template"


def value_rows(columns: int, cap: int = 20, budget: int = 16_000) -> int:
    return max(1, min(cap, budget // (30 * max(1, columns))))


def parse_matrix(text: str, columns: list[str]) -> list[dict]:
    """Rows of an answer that should be a JSON array of objects, read as leniently as needed; nulls dropped."""
    body = strip_fences(text)
    found = parse.json_line(body)
    if not isinstance(found, list):
        found = [v for v in parse.concatenated_values(body[body.find("[") if "[" in body else 0 :]) if isinstance(v, dict | list)]
        found = [y for x in found for y in (x if isinstance(x, list) else [x])]
    names = {c: c for c in columns} | {c.strip(): c for c in columns}
    return [{names[k.strip()]: v for k, v in r.items() if k.strip() in names and v is not None} for r in found if isinstance(r, dict)]


def fill_with(rows: list[dict]) -> Callable[[str, str], object]:
    """A value function that takes each column's values in turn, else default values."""
    at: dict[str, int] = {}
    rng = random.Random(0)

    def value(path: str, kind: str):
        have = [r[path] for r in rows if path in r]
        if not have:
            return default_value(kind, rng)
        at[path] = at.get(path, -1) + 1
        return have[at[path] % len(have)]

    return value
