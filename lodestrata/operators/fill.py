"""Templates filled with values that a text generator offers column by column."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.functions.fixed import EXAMPLE_BUDGET, EXAMPLE_LEAST, EXAMPLE_MOST
from lodestrata.operators.render import Client, default_value, fill_with, parse_matrix, render, seed_of, value_rows

MISSING = 20
META = "unit_id string, fmt string, text string, n_fields int, n_filled int, n_missing int, missing array<string>, n_rows int, n_asked int, answer string"


def example_of(samples: list | None, most: int) -> str | None:
    """The first sample that shows something: not null, not blank, not mostly starred."""
    for s in samples or ():
        shown = "" if s is None else str(s).rstrip("…").strip()
        if shown and shown.upper() != "NULL" and shown.count("*") < 0.6 * len(shown):
            return shown[:most]
    return None


def value_prompt(skeleton: dict[str, str], rows: int, samples: dict[str, list] | None = None, budget: int = EXAMPLE_BUDGET) -> str:
    """A request for a matrix of values; fields share ``budget`` characters of examples, or have none if that leaves too little for each."""
    room = min(EXAMPLE_MOST, budget // max(1, len(skeleton)))
    fields = []
    for path, kind in skeleton.items():
        shown = example_of((samples or {}).get(path), room) if room >= EXAMPLE_LEAST else None
        fields.append(json.dumps([path, kind, *([shown] if shown else [])], ensure_ascii=False))
    return f"Answer with a JSON array of {rows} objects and nothing else. Each object has all of the keys below; follow the type, and the form of the example where one is given.\nKeys (name, type, example):\n" + "\n".join(fields)


def realistic(path: str, kind: str, rng: random.Random) -> object:
    """A value that suits the name of its field, else a default of its type."""
    if kind in ("int", "num", "float", "bool", "null"):
        return default_value(kind, rng)
    name = re.sub(r"[^a-z]", "", path.split(".")[-1].lower())
    n = rng.randrange(1000, 10_000)
    pools = {"mail": f"user{n}@example.org", "phone": f"+1-555-{n}", "date": f"2024-{1 + n % 12:02d}-{1 + n % 28:02d}", "url": f"https://example.org/{n}", "city": ("Lyon", "Porto", "Quito", "Osaka")[n % 4], "country": ("France", "Portugal", "Ecuador", "Japan")[n % 4], "name": ("Ada Moss", "Ben Roe", "Chi Lam", "Dee Orr")[n % 4]}
    return next((v for k, v in pools.items() if k in name), None) or default_value(kind, rng)


class OfflineValues:
    """Answers a :func:`value_prompt` without any model, if wished without the last ``drop`` fields."""

    def __init__(self, drop: int = 0) -> None:
        self.drop = drop

    def complete(self, prompt: str) -> str:
        rows = int(re.search(r"array of (\d+) objects", prompt)[1])
        fields = [json.loads(x) for x in prompt.split("\n")[2:]]
        rng = random.Random(seed_of(prompt))
        kept = fields[: max(0, len(fields) - self.drop)]
        return json.dumps([{f[0]: realistic(f[0], f[1], rng) for f in kept} for _ in range(rows)], ensure_ascii=False)


def fill(client: Client, unit_id: str, fmt: str, skeleton: dict[str, str], n: int = 3, samples: dict[str, list] | None = None) -> dict:
    """A document whose structure is the template's and whose values are the client's, with what was filled.

    Fields without values get defaults, so every answer gives a whole document; an answer
    without any value is kept for inspection.
    """
    asked = value_rows(len(skeleton), n)
    answer = client.complete(value_prompt(skeleton, asked, samples))
    rows = parse_matrix(answer, list(skeleton))
    filled = {p for r in rows for p in r}
    missing = [p for p in skeleton if p not in filled]
    return {"text": render(unit_id, fmt, skeleton, n, fill_with(rows)), "n_fields": len(skeleton), "n_filled": len(filled), "n_missing": len(missing), "missing": missing[:MISSING], "n_rows": len(rows), "n_asked": asked, "answer": None if filled else answer}


def fill_units(units: DataFrame, client: Callable[[], Client], n: int = 3) -> DataFrame:
    """:func:`fill` for units (unit_id, fmt, skeleton map<path, type>[, samples map<path, array<string>>]); each task makes a client of its own."""
    given = [c for c in ("unit_id", "fmt", "skeleton", "samples") if c in units.columns]
    names = [c.split()[0] for c in META.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = client()
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in given), strict=True):
                u = dict(zip(given, row, strict=True))
                out.append({**u, **fill(asked, u["unit_id"], u["fmt"], dict(u["skeleton"]), n, dict(u.get("samples") or ()))})
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[k.split(maxsplit=1)[1]]) for c, k in zip(names, META.split(", "), strict=True)], names=names)

    return units.select(*given).mapInArrow(run, META)
