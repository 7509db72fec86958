"""Toxicity as ordered grades: cumulative-link regression on sparse text features.

P(grade <= k) = 1 / (1 + exp(w.x - threshold_k)): all thresholds share the weights. Features are
words and word beginnings that are associated with the label; a feature's value is 1 + ln(count). The
expected grade (severity) decides, by a cut that makes the fewest errors on labelled rows held out of the fit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, maybe_broadcast, slices

#: Labelled rows that a model is fitted on: about so many, chosen by a hash of their key; a fifth of them is held out.
LABELLED_ROWS = 12_000
#: Features kept, the least association (G squared) and the least number of rows that have one.
FEATURES, ASSOCIATION, LEAST_ROWS = 4_096, 30.0, 4
BEGINNINGS = (4, 5, 6)
#: Weight of the squared weights in the fit, rounds of the fit, words that a worker remembers.
RIDGE, ROUNDS, REMEMBERED = 0.2, 400, 300_000
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _features_of(word: str) -> list[int]:
    """Hashes of the word and its beginnings."""
    names = [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]
    return [xxhash.xxh64_intdigest(n.encode()) - (1 << 63) for n in names]


@dataclass
class Ordinal:
    """A fitted model: selected features with weights, ascending thresholds, and the cut on severity."""

    features: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = math.inf

    def values(self, text: str | None, known: dict[str, tuple[int, ...]]) -> dict[int, float]:
        """Value of each selected feature that text has; known remembers the features of words."""
        counts: Counter = Counter()
        for w, n in Counter(_words(text)).items():
            own = known.get(w)
            if own is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                own = known[w] = tuple(self.features[h] for h in _features_of(w) if h in self.features)
            for k in own:
                counts[k] += n
        return {k: 1 + math.log(n) for k, n in counts.items()}

    def severity(self, x: dict[int, float]) -> float:
        """Expected grade: the sum over k of P(grade > k)."""
        if not len(self.thresholds):
            return 0.0
        score = math.fsum(self.weights[k] * v for k, v in sorted(x.items()))
        return float(np.sum(_sigmoid(score - self.thresholds)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z)))


def fit_ordinal(rows: list[dict[int, float]], grades: np.ndarray, n_features: int, n_grades: int, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model, by full-batch Adam on the likelihood.

    Thresholds stay in order: the first is free, each next one adds a positive step.
    """
    who = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    what = np.array([k for x in rows for k in x], dtype=np.int64)
    value = np.array([v for x in rows for v in x.values()])
    share = np.array([np.mean(grades <= k) for k in range(n_grades - 1)]).clip(1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    free = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(free), np.zeros_like(free)
    low, high = grades > 0, grades < n_grades - 1
    for t in range(1, rounds + 1):
        w, thresholds = free[:n_features], np.cumsum(np.r_[free[n_features], np.exp(free[n_features + 1 :])])
        score = np.bincount(who, weights=w[what] * value, minlength=len(rows)) if len(what) else np.zeros(len(rows))
        upper = np.where(high, _sigmoid(thresholds[np.minimum(grades, n_grades - 2)] - score), 1.0)
        lower = np.where(low, _sigmoid(thresholds[np.maximum(grades - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # of log p, by each threshold; minus both, by score
        by_score = du - dl
        by_threshold = np.zeros(n_grades - 1)
        np.add.at(by_threshold, grades[high], -du[high])
        np.add.at(by_threshold, grades[low] - 1, dl[low])
        after = np.cumsum(by_threshold[::-1])[::-1]
        slope = np.concatenate([(np.bincount(what, weights=by_score[who] * value, minlength=n_features) if len(what) else np.zeros(n_features)) + ridge * w, after[:1], after[1:] * np.exp(free[n_features + 1 :])])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        free = free - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return free[:n_features], np.cumsum(np.r_[free[n_features], np.exp(free[n_features + 1 :])])


def _association(n_other: int, n_own: int) -> Column:
    """G squared of a feature that n0 of n_other rows without the label and n1 of n_own rows with it have."""
    total, both = n_other + n_own, F.col("n0") + F.col("n1")
    cells = ((F.col("n0"), n_other, both), (F.col("n1"), n_own, both), (n_other - F.col("n0"), n_other, total - both), (n_own - F.col("n1"), n_own, total - both))
    g = F.lit(0.0)
    for seen, of, row in cells:
        g = g + F.when(seen > 0, 2 * seen * F.log(seen * total / (of * row))).otherwise(0.0)
    return g


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = LABELLED_ROWS) -> Ordinal:
    """A model of ``label``'s grades (whole numbers from 0), fitted on about ``rows`` labelled documents.

    With two grades only, rows of the upper one are graded 1 or 2: above the median of their counts of
    associated features, 2. Rows whose key, text or label is null take no part; a key's highest label counts. Without
    rows of two grades the model finds nothing: severity 0, no row above the cut.
    """
    nothing = Ordinal({}, np.zeros(0), np.zeros(0))
    own = labels.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__key__")).agg(F.greatest(F.max(F.col(f"`{label}`")).cast("int"), F.lit(0)).alias("__grade__"))
    n = own.count()
    place = F.pmod(F.xxhash64("__key__"), F.lit(1 << 20))
    some = own.filter(place < min(1 << 20, (rows << 20) // max(n, 1))).checkpoint()
    labelled = docs.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).join(maybe_broadcast(some), F.col("k") == F.col("__key__"))
    labelled = labelled.select("k", "text", F.col("__grade__").alias("grade"), (F.pmod(F.xxhash64("k", F.lit("fold")), F.lit(5)) == 0).alias("held")).checkpoint()
    sizes = {r["grade"]: r["n"] for r in labelled.filter("not held").groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return nothing

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches, "text"):
            for t, g in zip(batch.column("text").to_pylist(), batch.column("grade").to_pylist(), strict=True):
                seen[g > 0].update({f for w in set(_words(t)) for f in _features_of(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array([c[f] for f in names], pa.int64()) for c in seen)], names=["f", "n0", "n1"])

    n_own = sum(c for g, c in sizes.items() if g > 0)
    n_other = sum(sizes.values()) - n_own
    counts = labelled.filter("not held").mapInArrow(counted, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= LEAST_ROWS)
    # All features are ranked before any is left out; at most FEATURES of them come to the driver.
    strong = counts.withColumn("g", F.round(_association(n_other, n_own), 6)).filter(F.col("g") >= ASSOCIATION).orderBy(F.col("g").desc(), "f").limit(FEATURES)
    chosen = [r["f"] for r in strong.collect()]
    if not chosen:
        return nothing
    model = Ordinal({f: k for k, f in enumerate(chosen)}, np.zeros(len(chosen)), np.zeros(0))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in slices(batches, "text"):
            x = [model.values(t, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("grade"), batch.column("held"), pa.array([list(v) for v in x], pa.list_(pa.int32())), pa.array([list(v.values()) for v in x], pa.list_(pa.float64()))], names=["k", "grade", "held", "what", "value"])

    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    found = labelled.mapInArrow(valued, f"k {kind}, grade int, held boolean, what array<int>, value array<double>").orderBy("k", "grade").collect()
    x = [dict(zip(r["what"], r["value"], strict=True)) for r in found]
    grades, held = np.array([r["grade"] for r in found]), np.array([r["held"] for r in found])
    if set(sizes) == {0, max(sizes)}:
        amount = np.array([sum(v.values()) for v in x])
        middle = float(np.median(amount[(grades > 0) & ~held]))
        grades = np.where(grades > 0, 1 + (amount > middle), 0)
    levels = int(grades.max()) + 1
    train = [v for v, h in zip(x, held, strict=True) if not h]
    model.weights, model.thresholds = fit_ordinal(train, grades[~held], len(chosen), levels)
    judged = held if held.any() and len(set((grades[held] > 0).tolist())) == 2 else ~held
    model.cut = best_cut(np.array([model.severity(v) for v, j in zip(x, judged, strict=True) if j]), grades[judged] > 0)
    return model


def best_cut(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the fewest errors; of several, the one in the middle of the widest gap."""
    order = np.argsort(severity, kind="stable")
    s, y = severity[order], toxic[order]
    edges = np.r_[s[0] - 1, s, s[-1] + 1]
    errors = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((~y)[::-1])[::-1], 0]
    gap = np.diff(edges)
    errors = np.where(gap > 0, errors, len(s) + 1)
    best = np.flatnonzero(errors == errors.min())
    at = best[np.argmax(gap[best])]
    return float((edges[at] + edges[at + 1]) / 2)


def scored(docs: DataFrame, model: Ordinal, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., severity, toxic) of each row; a null or empty text has no features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        known: dict = {}
        for batch in slices(batches, len(keep)):
            s = [shared.value.severity(shared.value.values(t, known)) for t in batch.column(len(keep)).to_pylist()]
            yield [*batch.columns[:-1], pa.array(s, pa.float64()), pa.array([v > shared.value.cut for v in s], pa.bool_())]

    return mapped(docs, keep, text, each, [("severity", "double"), ("toxic", "boolean")])


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs' rows and columns, whatever their names, but for rows that a model fitted on labels finds toxic.

    Null and empty texts stay, equal texts share their fate, rows keep their number; an empty table, or one without labels, stays as it is.
    """
    names = docs.columns
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row__"), F.col(f"`{text}`").alias("__t__"))
    return scored(wide, fit(docs, labels, text, key), "__t__", ("__row__",)).filter(~F.col("toxic")).select("__row__.*")
