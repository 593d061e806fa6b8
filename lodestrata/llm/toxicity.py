"""Toxicity scores: boosted trees over lexicon and style features, calibrated isotonically."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common
from lodestrata.llm.boosting import Boosted, Isotonic

#: Most labelled rows that are learnt from, and most entries of the learnt lexicon.
SAMPLE, LEXICON = 20_000, 2000
STEM = 5
STRIP = ".,;:!?\"'()[]{}<>«»¿¡…-–—|"
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Words that insult in any corpus; the learnt lexicon adds the corpus's own.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns imbecile retard fool pig bastard shut kill hate ugly".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
INNER = re.compile(r"[^\W\d_][0134577@$!*._-]+[^\W\d_]")
LONG = re.compile(r"([^\W\d_])\1\1")
N_FEATURES = 17


def words_of(text: str) -> list[str]:
    return [w.strip(STRIP) for w in text.lower().split()]


def features(text: str, lexicon: dict[str, float], stems: dict[str, float]) -> list[float]:
    """Dense features of a whole text; all zero for an empty one."""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    hits = [i for i, w in enumerate(words) if w in lexicon or w in INSULTS]
    roots = [i for i, w in enumerate(words) if w[:STEM] in stems]
    second = [i for i, w in enumerate(words) if w in SECOND]
    odd = [i for i, w in enumerate(words) if not w.isalpha() and INNER.search(w)]
    hidden = sum(1 for i in odd if (w := words[i].translate(LEET)) in lexicon or w in INSULTS)
    marks = np.zeros(n + 1, np.int64)
    marks[second] = 1
    run = np.r_[0, np.cumsum(marks)]
    near = sum(1 for i in {*hits, *roots} if run[min(n, i + 6)] > run[max(0, i - 5)])
    weight = [max(lexicon.get(words[i], 0.0), stems.get(words[i][:STEM], 0.0)) for i in {*hits, *roots}]
    letters = len(text)
    caps = len(re.findall(r"[A-ZÀ-Þ]", text))
    shouts = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    points = len(re.findall(r"[^\w\s]", text))
    return [math.log1p(n), len(hits) / n, math.log1p(len(hits)), len({words[i] for i in hits}), len(roots) / n, math.log1p(len(roots)), max(weight, default=0.0), sum(weight) / n, len(second) / n, near, caps / letters, shouts / n, points / letters, text.count("!") / letters, len(odd) / n, hidden, sum(1 for w in words if LONG.search(w)) / n]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, word, toxic documents, other documents) of a partition: words and word beginnings."""
    seen = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(common.texts(batch), batch.column("toxic").to_pylist(), strict=True):
            words = {w for w in words_of(text) if w}
            seen[toxic].update(("w", w) for w in words)
            seen[toxic].update(("s", s) for s in {w[:STEM] for w in words if len(w) > STEM})
            seen[toxic][("n", "")] += 1
    keys = list(seen[0] | seen[1])
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["kind", "word", "n1", "n0"])


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings that toxic documents hold far more often, with their log odds."""
    counts = train.select("text", "toxic").mapInArrow(_counts, "kind string, word string, n1 long, n0 long").groupBy("kind", "word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 >= 3 or kind = 'n'")
    total = counts.where("kind = 'n'").first()
    if total is None or not total.n1 or not total.n0:
        return {}, {}
    rate = total.n1 / (total.n1 + total.n0)
    expected = (F.col("n1") + F.col("n0")) * rate
    z = (F.col("n1") - expected) / F.sqrt(expected * (1 - rate))
    odds = F.log((F.col("n1") + 0.5) / (total.n1 + 1)) - F.log((F.col("n0") + 0.5) / (total.n0 + 1))
    rows = counts.where("kind <> 'n'").select("kind", "word", z.alias("z"), odds.alias("odds")).where("z > 5.5 and odds > 2").orderBy(F.desc("z"), "word").limit(LEXICON).collect()
    return {r.word: r.odds for r in rows if r.kind == "w"}, {r.word: r.odds for r in rows if r.kind == "s"}


class Model:
    """All that scoring needs; pickled to the executors."""

    def __init__(self, lexicon, stems, trees, calibration) -> None:
        self.lexicon, self.stems, self.trees, self.calibration = lexicon, stems, trees, calibration

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon, self.stems) for t in texts]).reshape(len(texts), N_FEATURES)
        if self.trees is None:
            return np.clip(x[:, 3] * 0.4, 0.0, 1.0)
        raw = self.trees.predict(x)
        # a little of the raw score keeps the order within the calibration's steps
        return np.clip(0.98 * self.calibration.predict(raw) + 0.02 * raw, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents (those of smallest id hash), none of which is held out.

    Three tenths of them give the lexicon, a further half the trees, the rest the calibration,
    so that no part learns from what another has already fitted. Of several texts under one
    doc_id that of smallest hash counts, of repeated rows one; no text is exchanged. Without labels of both kinds
    the score counts distinct insults.
    """
    picked = labels.where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)))
    labelled = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(picked), "doc_id")
    chosen = common.materialise(labelled.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "row")).alias("r")).select("r.row"), "toxic-rows")
    rows = common.materialise(labelled.join(F.broadcast(chosen), "row", "left_semi").select("text", "toxic", "fold"), "toxic-train")
    lexicon, stems = learn_lexicon(rows.where("fold < 3"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicon, stems) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("fold"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    got = rows.where("fold >= 3").mapInArrow(run, "toxic int, fold long, x array<double>").collect()
    got.sort(key=lambda r: (r.fold, r.toxic, r.x))
    x, y, fold = np.array([r.x for r in got]).reshape(len(got), N_FEATURES), np.array([r.toxic for r in got], float), np.array([r.fold for r in got])
    fit = fold < 8
    if not (0 < y[fit].sum() < fit.sum()):
        return Model(lexicon, stems, None, None)
    trees = Boosted().fit(x[fit], y[fit])
    rest = ~fit if 0 < y[~fit].sum() < (~fit).sum() else fit
    return Model(lexicon, stems, trees, Isotonic().fit(trees.predict(x[rest]), y[rest]))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document, from its whole text alone.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 3 isn't 1. Null and empty
    texts get the score of all-zero features; a null doc_id isn't held out; repeated rows are
    scored each; an empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(common.texts(batch)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
