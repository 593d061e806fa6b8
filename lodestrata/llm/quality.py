"""Quality of documents: a text classifier's evidence under host and path priors shrunk by empirical Bayes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common
from lodestrata.llm.boosting import Boosted

#: Most labelled rows that the text classifier is fitted on.
SAMPLE = 20_000
MARKS = re.compile(r"[^\w\s]")
SYMBOLS = re.compile(r"[#$%&*|<>{}\[\]\\^~=+_@]")
CAPS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
N_FEATURES = 14


def features(text: str) -> list[float]:
    """Dense features of a whole text; all zero for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    size = len(text)
    lines = [x for x in text.split("\n") if x]
    marks = MARKS.findall(text)
    symbols = len(SYMBOLS.findall(text))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    bare = sum(not any(map(str.isalnum, w)) for w in words)
    ends = sum(w[-1] in ".!?" for w in words)
    shouts = sum(len(w) > 1 and w.isupper() for w in words)
    return [min(n, 2000), size / n, len(CAPS.findall(text)) / size, shouts / n, text.count("!") / n, len(marks) / size, symbols / n, text.count("|") / n, bare / n, again / n, len(set(words)) / n, len(set(lines)) / max(1, len(lines)), ends / n, sum(map(str.isdigit, marks)) / n]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Boosted | None:
    """A text classifier from at most ``sample`` labelled documents, those of smallest id hash; None without labels of both kinds.

    Of several texts under one doc_id the smallest counts.
    """
    picked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([features(t) for t in common.texts(batch)], pa.list_(pa.float64()))], names=["quality", "x"])

    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    rows = texts.select("text", "quality").mapInArrow(run, "quality int, x array<double>").collect()
    rows.sort(key=lambda r: (r.quality, r.x))
    y = np.array([r.quality for r in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    return Boosted(trees=40).fit(np.array([r.x for r in rows]), y)


def evidence(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """The columns of ``docs`` but its text, with ``evidence``, the text classifier's chance of good quality (0.5 without a model)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != "text"]
    at, rest = docs.columns.index("text"), [k for k, c in enumerate(docs.columns) if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            p = held.value.predict(np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)) if held.value else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(p, pa.float64())], names=[*others, "evidence"])

    return docs.mapInArrow(run, docs.select(*others, F.lit(0.0).alias("evidence")).schema)


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: Column) -> float:
    """How many documents a level's prior weighs: the beta prior whose spread matches that between its groups (moments)."""
    dev = (F.col("good") / F.col("n") - prior) ** 2
    room = prior * (1 - prior)
    row = groups.agg(F.sum(F.col("n") * dev).alias("between"), F.sum(room).alias("noise"), F.sum("n").alias("n"), F.sum(F.col("n") * room).alias("room"), F.count(F.lit(1)).alias("k")).first()
    if not row.n or not row.room:
        return 1.0
    spread = (row.between - row.noise) / row.n  # variance of the groups' true rates
    return float(min(1e6, max(1.0, row.room / row.n / spread - 1))) if spread > 1e-9 else 1e6


def site_priors(scored: DataFrame, levels: tuple[str, ...]) -> tuple[float, DataFrame]:
    """The global rate, and a shrunk rate for each full site path.

    Each level's group is shrunk towards its parent's shrunk rate, by a weight fitted to how
    much the groups of that level differ. Only sums by group are exchanged.
    """
    sums = common.materialise(scored.groupBy(*levels).agg(F.sum("evidence").alias("good"), F.count(F.lit(1)).alias("n")), "sites")
    total = sums.agg(F.sum("good"), F.sum("n")).first()
    overall = float(total[0] / total[1]) if total[1] else 0.5
    rates = None
    for depth in range(1, len(levels) + 1):
        keys = list(levels[:depth])
        groups = sums.groupBy(*keys).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
        groups = groups.withColumn("prior", F.lit(overall)) if rates is None else groups.join(rates.withColumnRenamed("rate", "prior"), keys[:-1])
        weight = _strength(groups, F.col("prior"))
        above = [F.struct(F.lit(float(total[0] or 0)).alias("good"), F.lit(int(total[1] or 0)).alias("n"), F.lit(0.0).alias("weight"))] if rates is None else []
        path = F.concat(F.array(*above) if above else F.col("path"), F.array(F.struct("good", "n", F.lit(weight).alias("weight"))))
        rates = groups.select(*keys, ((F.col("good") + weight * F.col("prior")) / (F.col("n") + weight)).alias("rate"), path.alias("path"))
    return overall, common.materialise(rates, "site-rates")


def without(own: Column, path: Column, depth: int) -> Column:
    """The rate of a site from all its documents but one, whose evidence is ``own``: the other documents' sums, shrunk level by level."""
    rate = F.lit(0.5)
    for k in range(depth + 1):
        level = path[k]
        others = level["n"] - 1 + level["weight"]
        rate = F.when(others > 0, (level["good"] - own + level["weight"] * rate) / others).otherwise(rate)
    return F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0))


def judge(docs: DataFrame, labels: DataFrame, levels: tuple[str, ...] = ("source", "lang"), threshold: float = 0.5) -> DataFrame:
    """The columns of ``docs`` but its text, with ``text_hash``, ``evidence``, ``site_rate``, ``quality_score`` and ``keep``.

    A document's log odds are those of its text plus what its site's shrunk rate says beyond the
    global one; the site's rate is that of its other documents. Sites are paths of ``levels``
    (host first); a null level is a site of its own; null and empty texts are judged by all-zero
    features and their site; repeated rows are judged each; an empty table gives no rows.
    Clashing column names of ``docs`` are replaced. Texts are read once for the evidence (and
    a bounded sample of them for the fit), what follows moves evidence and sites only.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.drop("text_hash", "evidence", "site_rate", "quality_score", "keep")
    keys = [f"_site{k}" for k in range(len(levels))]
    model = fit(docs, labels)
    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    thin = common.materialise(evidence(hashed, model), "evidence")
    named = thin.select("*", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(k) for c, k in zip(levels, keys, strict=True)))
    overall, rates = site_priors(named, tuple(keys))
    scored = named.join(rates.withColumnRenamed("path", "_path"), keys, "left").withColumn("site_rate", without(F.col("evidence"), F.col("_path"), len(levels)))
    odds = logit(F.col("evidence")) + logit(F.col("site_rate")) - logit(F.lit(overall))
    out = scored.withColumn("quality_score", 1 / (1 + F.exp(-odds)))
    return out.select(*thin.columns, "site_rate", "quality_score", (F.col("quality_score") >= threshold).alias("keep"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, levels: tuple[str, ...] = ("source", "lang"), threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that :func:`judge` keeps, whatever other columns there are; rows of equal doc_id, text and site fare alike."""
    names = ["_bad_id", "_bad_text", *(f"_bad{k}" for k in range(len(levels)))]
    bad = judge(docs.select("doc_id", "text", *levels), labels, levels, threshold).where("not keep").select("doc_id", "text_hash", *levels).distinct().toDF(*names)
    bad = common.materialise(bad, "rejected")
    hashed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("_text_hash") == F.col("_bad_text")
    for mine, theirs in zip(["doc_id", *levels], [names[0], *names[2:]], strict=True):
        same &= F.col(mine).eqNullSafe(F.col(theirs))
    sure, rest = common.suspects(hashed, "_text_hash", bad, "_bad_text")
    return sure.select(*docs.columns).union(rest.join(bad, same, "left_anti").select(*docs.columns))
