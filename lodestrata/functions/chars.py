"""Column functions over characters and values: classes, scripts, patterns, masks, hints, personal-data seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.fixed import PII_KEYS, PII_TYPES, SCRIPTS

CLASSES = {"letter": r"\p{L}", "number": r"\p{N}", "mark": r"\p{M}", "punct": r"\p{P}", "symbol": r"\p{S}", "space": r"[\s\p{Z}]"}


def count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def script_class(name: str) -> str:
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in SCRIPTS[name]) + "]"


def char_dist(col: Column) -> Column:
    """Shares of each character class, rounded to 3 places; 0 for an empty value."""
    n = F.length(col)
    share = lambda c: F.when(n > 0, F.round(c / n, 3)).otherwise(F.lit(0.0))
    counts = {k: count(col, p) for k, p in CLASSES.items()}
    rest = n - sum(counts.values(), F.lit(0))
    return F.struct(*(share(c).alias(k) for k, c in counts.items()), share(rest).alias("other"))


def script_dist(col: Column) -> Column:
    """Share of letters of each script, rounded to 3 places."""
    n = count(col, r"\p{L}")
    return F.map_from_arrays(F.array(*map(F.lit, SCRIPTS)), F.array(*(F.when(n > 0, F.round(count(col, script_class(s)) / n, 3)).otherwise(F.lit(0.0)) for s in SCRIPTS)))


def pattern(col: Column) -> Column:
    """Run-length pattern: D digit, L Latin, C Han, X other letter, M, P, S, space as '_', other '?'; a run of n is T{n}.

    Characters become class letters in private code points first, so that no later step sees its
    own output; runs are then numbered by a fold over the characters.
    """
    out = col
    marks = [("C", script_class("Han")), ("L", script_class("Latin")), ("X", r"\p{L}"), ("D", r"\p{N}"), ("M", r"\p{M}"), ("P", r"\p{P}"), ("S", r"\p{S}"), ("_", r"[\s\p{Z}]"), ("?", r"[^\x{e000}-\x{e0ff}]")]
    for k, (_, p) in enumerate(marks):
        out = F.regexp_replace(out, p, chr(0xE000 + k))
    out = F.translate(out, "".join(chr(0xE000 + k) for k in range(len(marks))), "".join(m for m, _ in marks))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"), F.lit(0).alias("n"))
    text = lambda a: F.when(a["n"] > 1, F.concat(a["done"], a["last"], F.lit("{"), a["n"].cast("string"), F.lit("}"))).otherwise(F.concat(a["done"], a["last"]))
    step = lambda a, x: F.when(a["last"] == x, F.struct(a["done"].alias("done"), x.alias("last"), (a["n"] + 1).alias("n"))).otherwise(F.struct(text(a).alias("done"), x.alias("last"), F.lit(1).alias("n")))
    return F.when(F.length(col) == 0, F.lit("")).otherwise(F.aggregate(F.split(out, ""), start, step, text))


def mask(col: Column) -> Column:
    """Everything but punctuation and space starred."""
    return F.regexp_replace(col, r"[^\p{P}\p{Z}\s]", "*")


def truncate(col: Column, n: int = 64) -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("…"))).otherwise(col)


def numeric_hint(col: Column, kind: Column) -> Column:
    """What a number looks like: a year, an age, a large int, else its kind."""
    x = col.cast("double")
    return F.when(kind == "bool", "bool").when((kind == "int") & x.between(1900, 2100), "year_like").when((kind == "int") & x.between(1, 150), "age_like").when((kind == "int") & (x > 100000), "large_int").otherwise(kind)


def implies_pii(key: Column) -> Column:
    return F.coalesce(key.rlike("(?iU)" + PII_KEYS), F.lit(False))


def pii_type(key: Column) -> Column:
    out = F.lit("unknown_pii")
    for p, name in reversed(PII_TYPES):
        out = F.when(key.rlike(f"(?i){p}"), F.lit(name)).otherwise(out)
    return out


def pii_seed(key: Column, free_text: Column) -> Column:
    """(level, type): high_conf by the key, needs_llm for free text, else null."""
    none = F.lit(None).cast("string")
    return F.when(implies_pii(key), F.struct(F.lit("high_conf").alias("level"), pii_type(key).alias("type"))).when(free_text, F.struct(F.lit("needs_llm").alias("level"), none.alias("type")))


def cell_class(cell: Column) -> Column:
    """Macro class of a CSV cell: null for blank, str with any letter, num for digits, else punct or other."""
    return F.when(F.trim(cell) == "", F.lit(None)).when(cell.rlike(r"\p{L}"), "str").when(cell.rlike(r"^[\p{N}\p{P}\s]*$") & cell.rlike(r"\p{N}"), "num").when(count(cell, r"\p{P}") >= F.greatest(count(cell, r"\p{N}"), count(cell, r"\p{S}")), "punct").when(count(cell, r"\p{S}") >= count(cell, r"\p{N}"), "symbol").otherwise("number")
