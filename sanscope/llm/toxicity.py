"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade <= j) = sigmoid(t_j - w.x): one weight per feature, shared by all ordered thresholds t_j.
Features are a text's distinct words, their beginnings and their ends, counted and divided by the
fourth root of the number of distinct words: neither a long text nor a word said a hundred times
moves the score by itself. The features used are those that separate toxic from clean labelled
texts best. The output is the
expected severity, sum of j * P(grade = j).

Training is bounded: SAMPLE labelled rows (least hashes of the id), FEATURES features. Their
counts are aggregated by Spark; only the selected features' counts of the sampled rows reach the
driver. Scoring reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanscope.session import share_code

from .common import Scratch, giving_back, slices, text_or_empty

SAMPLE, FEATURES, LEAST_DOCS = 20_000, 4_000, 4
#: Standard deviations by which a feature's rates among toxic and clean texts must differ. Where so few texts
#: are labelled that no feature differs as much, those count that differ as much as the best one.
APART = 4.5
#: Scale of a feature's value, and words added to each text, so that short texts don't get extreme ones.
SCALE, SMOOTH = 2.0, 15
#: Word scores remembered per Python worker (saves time only).
CACHED_WORDS = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """A word's features: itself, its first three to six letters, its last three and four."""
    out = [word]
    out += ["^" + word[:n] for n in (3, 4, 5, 6) if len(word) >= n]
    out += [word[-n:] + "$" for n in (3, 4) if len(word) > n]
    return out


def distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def unit(words: int) -> float:
    """What one distinct word with a feature adds to it in a text of so many distinct words."""
    return SCALE / (words + SMOOTH) ** 0.25


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def table(self) -> dict[str, float]:
        return dict(zip(self.features, self.weights.tolist()))

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Probabilities of each grade for scores w.x."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        below = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        return np.diff(below, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int,
                        l2: float = 1e-5, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the regularised mean log-likelihood.

    Thresholds are a first one and log-gaps, so they stay in order. Grades are 0 .. top.
    """
    n, top = len(grades), int(grades.max())
    cum = np.array([(grades <= j).mean() for j in range(top)]).clip(1e-3, 1 - 1e-3)
    t = np.log(cum / (1 - cum))
    p = np.concatenate([np.zeros(n_features), t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        t = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=values * w[cols], minlength=n)
        s = _sigmoid(np.concatenate([np.full((n, 1), -np.inf), t[None, :] - score[:, None], np.full((n, 1), np.inf)], axis=1))
        i = np.arange(n)
        hi, lo = s[i, grades + 1], s[i, grades]
        prob = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        dscore = (dhi - dlo) / n
        dt = np.zeros(top)
        for j in range(top):
            dt[j] = -(dhi[grades == j].sum() - dlo[grades == j + 1].sum()) / n
        g = np.concatenate([np.bincount(cols, weights=values * dscore[rows], minlength=n_features) + l2 * w,
                            [dt.sum()], gaps * np.cumsum(dt[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(p[n_features + 1 :])
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(gaps)])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grades, both = batch.column(0).to_pylist(), (Counter(), Counter())
        for g, text in zip(grades, batch.column(1).to_pylist()):
            both[g > 0].update({f for w in distinct_words(text) for f in features_of(w)})
        names = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), pa.array([both[1][f] for f in names], pa.int64()),
            pa.array([both[0][f] for f in names], pa.int64())], names=["feature", "toxic", "clean"])


def _feature_rates(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, vals = [], []
            for text in batch.column(1).to_pylist():
                words = distinct_words(text)
                c: Counter = Counter()
                for w in words:
                    for f in features_of(w):
                        if f in index:
                            c[index[f]] += 1
                n = unit(len(words))
                cols.append(list(c))
                vals.append([k * n for k in c.values()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols, pa.list_(pa.int32())),
                                              pa.array(vals, pa.list_(pa.float64()))], names=["grade", "cols", "vals"])

    return run


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE, features: int = FEATURES) -> Model | None:
    """A model from labelled rows; None without both clean and toxic ones, or if no feature tells them apart.

    Grades are whole numbers, 0 for clean. Where the labels have the grades 0 and 1 only, toxic texts
    are split at the median rate of toxic evidence into moderate (1) and severe (2). Rows with a null
    id or grade are left out; repeated labels count once, the highest; of rows that share an id one text
    counts, the greatest.
    """
    share_code(docs.sparkSession)
    lab = (labels.select(F.col(id_col).alias("doc_id"), F.col(grade_col).cast("int").alias("grade"))
           .where("doc_id is not null and grade >= 0").groupBy("doc_id").agg(F.max("grade").alias("grade"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    # at most ``sample`` rows: an id that many rows share must neither fill the driver nor sway the fit
    rows = (texts.join(F.broadcast(lab), "doc_id").groupBy("doc_id").agg(F.max("grade").alias("grade"), F.max("text").alias("text"))
            .select("grade", "text"))
    rows = Scratch(docs.sparkSession, "toxicity").keep(rows, "labelled")
    seen = rows.groupBy("grade").count().collect()
    n = {True: sum(r[1] for r in seen if r[0] > 0), False: sum(r[1] for r in seen if r[0] == 0)}
    if not (n[True] and n[False]):
        return None
    df = (rows.mapInArrow(giving_back(_document_frequencies), "feature string, toxic bigint, clean bigint").groupBy("feature")
          .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
          .where(F.col("toxic") + F.col("clean") >= LEAST_DOCS))
    a, b = (F.col("toxic") + 0.5) / (n[True] + 1), (F.col("clean") + 0.5) / (n[False] + 1)
    # separation: difference of rates in units of its standard deviation if both were one
    c = (F.col("toxic") + F.col("clean")) / (n[True] + n[False])
    apart = F.abs(a - b) / F.sqrt(c * (1 - c) * (1 / n[True] + 1 / n[False]) + 1e-9)
    ranked = df.select("feature", apart.alias("apart")).where("apart > 0").orderBy(F.desc("apart"), "feature").limit(features).collect()
    best = [r[0] for r in ranked if r[1] >= min(APART, ranked[0][1])]
    if not best:
        return None
    index = {f: k for k, f in enumerate(best)}
    got = rows.mapInArrow(giving_back(_feature_rates(index)), "grade int, cols array<int>, vals array<double>").collect()
    grades = np.array([r[0] for r in got])
    i = np.repeat(np.arange(len(got)), [len(r[1]) for r in got])
    j = np.array([c for r in got for c in r[1]], np.int64)
    x = np.array([c for r in got for c in r[2]], np.float64)
    if grades.max() == 1:
        weights, _ = fit_cumulative_link(i, j, x, grades, len(best), steps=150)
        score = np.bincount(i, weights=x * weights[j], minlength=len(got))
        grades = grades + ((grades == 1) & (score > np.median(score[grades == 1])))
    weights, thresholds = fit_cumulative_link(i, j, x, grades, len(best))
    return Model(best, weights, thresholds)


class Scorer:
    """Scores w.x of texts; word scores are remembered while there is room."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def __call__(self, text: str | None) -> float:
        words, total, known = distinct_words(text or ""), 0.0, self.known
        for w in words:
            s = known.get(w)
            if s is None:
                s = sum(self.weights.get(f, 0.0) for f in features_of(w))
                if len(known) < CACHED_WORDS:
                    known[w] = s
            total += s
        return total * unit(len(words))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in slices(batches):
            out = list(map(score, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they are; one pass, no shuffle.

    Null and empty texts stay, as do all rows if there is no model; repeated rows are judged alike.
    """
    if model is None:
        return docs
    share_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.table())
    most = float(model.thresholds[0])  # grade 0 is likelier than not up to here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([score(t) <= most for t in texts], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)


def severity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity, grade, toxic of every row of ``docs``.

    ``grade`` is the likeliest grade, ``toxic`` whether a grade above 0 is likelier than not. Null and
    empty texts, and all texts if there is no model, have severity 0 and are not toxic. Repeated rows
    are scored like any others; a null id stays null; other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    share_code(spark)
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    if model is None:
        return ids.select("doc_id", F.lit(0.0).alias("expected_severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    shared = spark.sparkContext.broadcast(model.table())  # at most FEATURES entries
    scored = ids.mapInArrow(giving_back(_score(shared)), "doc_id bigint, score double")
    below = [1 / (1 + F.exp(F.col("score") - float(t))) for t in model.thresholds]
    edges = [F.lit(0.0), *below, F.lit(1.0)]
    probs = [edges[j + 1] - edges[j] for j in range(len(edges) - 1)]
    expected = sum((p * j for j, p in enumerate(probs)), F.lit(0.0))
    grade = F.array_position(F.array(*probs), F.array_max(F.array(*probs))) - 1
    return scored.select("doc_id", F.round(expected, 6).alias("expected_severity"), grade.cast("int").alias("grade"),
                         (below[0] < 0.5).alias("toxic"))
