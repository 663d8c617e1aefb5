"""Quality by hierarchical empirical Bayes: document evidence with host and path posteriors.

1. Document evidence: logistic regression on text statistics, all computed by DataFrame
   expressions, fitted on a bounded sample of labelled rows.
2. Site evidence: the documents' probabilities are summed per path, then per host, then over the
   corpus. A host's rate is shrunk to the corpus's, a path's to its host's; how strongly is estimated
   from the spread between sites (method of moments), so sparse sites rest on their parents.
3. A document's log-odds are shifted by those of its path against the corpus.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanscope.session import share_code

from .common import Scratch, text_or_empty

SAMPLE = 20_000
#: Prior strength bounds, in documents: the least and the most that a parent counts.
WEAKEST, STRONGEST = 2.0, 10_000.0
#: Weight of the site's log-odds next to the document's.
SITE_WEIGHT = 0.5
FEATURES = ("words", "word_length", "upper", "digits", "marks", "odd_marks", "distinct", "distinct_lines", "line_words", "bars", "top_run")


def statistics(text: Column) -> dict[str, Column]:
    """Bounded text statistics; every one is defined for the empty text."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")

    def share(kept: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, kept, ""))) / n

    return {
        "words": F.log(n_words), "word_length": F.log1p(n / n_words),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"),
        "marks": share(".,;:'\"()-"), "odd_marks": share("!#$%&*|~^_=+<>{}[]\\@/?"),
        "distinct": F.size(F.array_distinct(words)) / F.sqrt(n_words),
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines, "line_words": F.log1p(n_words / n_lines),
        "bars": share("|"), "top_run": F.size(F.array_distinct(words)) / n_words,
    }


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights (last one the intercept) by Newton's method on standardised columns."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x1.shape[1])
    penalty = np.r_[np.full(x.shape[1], l2 * len(x)), 1e-9]
    for _ in range(steps):
        p = 0.5 * (1 + np.tanh(x1 @ w / 2))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-9),
                               x1.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _expand(cols: dict[str, Column]) -> list[Column]:
    """The statistics, their squares and a few products, as the classifier's inputs."""
    base = [cols[f] for f in FEATURES]
    return base + [c * c for c in base] + [cols["upper"] * cols["odd_marks"], cols["distinct"] * cols["words"],
                                           cols["top_run"] * cols["words"], cols["bars"] * cols["words"]]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(means, deviations, weights) from at most ``sample`` labelled rows; None without both classes.

    Of rows that share an id one text counts, the greatest.
    """
    lab = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y"))
           .where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    # one row per id: an id that many rows share must neither fill the driver nor sway the fit
    rows = texts.join(F.broadcast(lab), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    stats = rows.select("y", *[c.alias(f) for f, c in statistics(F.col("text")).items()])
    rows = np.array([list(r) for r in stats.select("y", *_expand({f: F.col(f) for f in FEATURES})).collect()], float)
    if not len(rows) or len(set(rows[:, 0])) < 2:
        return None
    mean, dev = rows[:, 1:].mean(axis=0), np.maximum(rows[:, 1:].std(axis=0), 1e-6)
    return mean, dev, fit_logistic((rows[:, 1:] - mean) / dev, rows[:, 0])


def document_log_odds(stats: DataFrame, model) -> Column:
    if model is None:
        return F.lit(0.0)
    mean, dev, w = model
    total = F.lit(float(w[-1]))
    for c, m, d, k in zip(_expand({f: F.col(f) for f in FEATURES}), mean, dev, w):
        total = total + (c - float(m)) / float(d) * float(k)
    return F.greatest(F.least(total, F.lit(12.0)), F.lit(-12.0))


def prior_strength(sites: DataFrame, mean: str, parent: str, n: str, within: float) -> float:
    """How many documents the parent counts for: variance within sites over variance between them.

    Method of moments with each site weighted by its size; one small aggregate.
    """
    r = sites.agg(F.sum(F.col(n) * (F.col(mean) - F.col(parent)) ** 2), F.sum(n), F.count(F.lit(1)),
                  F.sum(F.col(n) * F.col(n))).first()
    if not r[1] or r[2] < 2:
        return STRONGEST
    eff = r[1] - r[3] / r[1]
    between = (r[0] - (r[2] - 1) * within) / eff if eff > 0 else 0.0
    return STRONGEST if between <= 0 else min(max(within / between, WEAKEST), STRONGEST)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source", path_col: str = "lang", label_col: str = "quality",
                   sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, doc_score, host_score, path_score, score, kept of every row of ``docs``.

    Null hosts and paths are sites of their own; null and empty texts get the score of an empty text.
    Without labels of both classes every document and site has 0.5. Repeated rows are scored like any
    others and count in their site; other columns are ignored; an empty table gives no rows.
    """
    share_code(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    model = train(docs, labels, label_col, id_col, text_col, sample)
    text = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                       F.col(path_col).cast("string").alias("path"), text_or_empty(text_col).alias("text"))
    stats = text.select("doc_id", "host", "path", *[c.alias(f) for f, c in statistics(F.col("text")).items()])
    scored = scratch.keep(stats.select("doc_id", "host", "path", document_log_odds(stats, model).alias("z"))
                          .withColumn("p", 1 / (1 + F.exp(-F.col("z")))), "documents")
    paths = scratch.keep(scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = scratch.keep(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "hosts")
    n, s, q = paths.agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
    mean = s / n if n else 0.5
    within = max((q / n - mean * mean) if n else 0.0, 1e-6)
    h = hosts.select("host", "hn", "hs", (F.col("hs") / F.col("hn")).alias("m"), F.lit(mean).alias("g"))
    k0 = prior_strength(h, "m", "g", "hn", within)
    h = h.select("host", ((F.col("hs") + k0 * mean) / (F.col("hn") + k0)).alias("host_score"))
    p = paths.alias("a").join(h.alias("h"), F.expr("a.host <=> h.host")).select("a.host", "path", "n", "s", "host_score")
    p = scratch.keep(p, "shrunk-hosts")
    k1 = prior_strength(p.select("n", (F.col("s") / F.col("n")).alias("m"), "host_score"), "m", "host_score", "n", within)
    sites = scratch.keep(p.select("host", "path", "host_score", (
        (F.col("s") + k1 * F.col("host_score")) / (F.col("n") + k1)).alias("path_score")), "sites")
    g = math.log(min(max(mean, 1e-6), 1 - 1e-6) / (1 - min(max(mean, 1e-6), 1 - 1e-6)))
    pc = F.greatest(F.least(F.col("path_score"), F.lit(1 - 1e-6)), F.lit(1e-6))
    joined = scored.alias("d").join(sites.alias("s"), F.expr("d.host <=> s.host and d.path <=> s.path"))
    score = 1 / (1 + F.exp(-(F.col("z") + SITE_WEIGHT * (F.log(pc / (1 - pc)) - g))))
    return joined.select("doc_id", "d.host", "d.path", F.round("p", 6).alias("doc_score"),
                         F.round("host_score", 6).alias("host_score"), F.round("path_score", 6).alias("path_score"),
                         F.round(score, 6).alias("score"), (score >= threshold).alias("kept"))
