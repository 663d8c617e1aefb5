import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sanscope.llm import quality as Q
from sanscope.llm import toxicity as X

from .helpers import docs


def labelled(spark, n=600, seed=0):
    r = random.Random(seed)
    plain = [f"{a}{b}" for a in ("mor", "tal", "sen", "vir", "pon") for b in ("a", "en", "ist", "ula", "ode", "ark")]
    bad = ["zagrud", "zagrudis", "zagrum", "vilkor"]
    rows, lab = [], []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randrange(10, 200))]
        toxic = i % 6 == 0
        for _ in range(max(1, len(w) // 25) if toxic else 0):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        lab.append((i, int(toxic), int(r.random() < 0.5)))
    return rows, spark.createDataFrame(lab, "doc_id long, toxic int, quality int")


def test_toxic_documents_are_found(spark):
    rows, lab = labelled(spark)
    d = docs(spark, rows + [(900, None), (901, ""), (902, "zagrud " * 4000), (None, "mora"), (0, rows[0][1])])
    model = X.train(d, lab.where("doc_id % 2 = 0").union(lab.limit(3)))
    got = X.severity(d, model).collect()
    truth = {i: i % 6 == 0 for i, _ in rows}
    held = [(x.toxic, truth[x.doc_id]) for x in got if x.doc_id is not None and x.doc_id < 900 and x.doc_id % 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    by = {x.doc_id: x for x in got}
    assert not by[900].toxic and not by[901].toxic and by[902].toxic and len(got) == len(rows) + 5
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 2
    assert all(0 <= x.expected_severity <= 2 for x in got) and {x.grade for x in got} <= {0, 1, 2}
    kept = X.drop_toxic(d, model)
    assert kept.schema == d.schema and sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(
        x.doc_id for x in got if not x.toxic and x.doc_id is not None)


def test_scores_come_in_slices():
    class Shared:
        value = {"zagrud": 2.0}

    texts = ["zagrud mora" if k % 3 else "mora" for k in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    got = list(X._score(Shared)(iter([batch])))
    assert [b.num_rows for b in got] == [500, 500, 200]
    assert [x for b in got for x in b.column(1).to_pylist()] == [2.0 * X.unit(2) if k % 3 else 0.0 for k in range(1200)]


def _plain_features(text):
    """(feature -> distinct words that have it, number of distinct words)"""
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    out = collections.Counter()
    for w in words:
        out.update([w] + ["^" + w[:n] for n in range(3, 7) if n <= len(w)] + [w[-n:] + "$" for n in (3, 4) if n < len(w)])
    return out, len(words)


def test_features_and_scores_match_plain_python(spark):
    """The features chosen, and severities of every text from the model's weights and thresholds."""
    rows, lab = labelled(spark)
    model = X.train(docs(spark, rows), lab)
    has = [(set(_plain_features(t)[0]), i % 6 == 0) for i, t in rows]
    n = {y: sum(z == y for _, z in has) for y in (True, False)}
    apart = {}
    for f in set().union(*(fs for fs, _ in has)):
        a, b = (sum(f in fs for fs, z in has if z == y) for y in (True, False))
        if a + b >= X.LEAST_DOCS:
            c = (a + b) / len(rows)
            apart[f] = abs((a + 0.5) / (n[True] + 1) - (b + 0.5) / (n[False] + 1)) / math.sqrt(
                c * (1 - c) * (1 / n[True] + 1 / n[False]) + 1e-9)
    assert set(model.features) == {f for f, z in apart.items() if z >= X.APART}
    weight, texts = dict(zip(model.features, model.weights)), rows + [(900, None), (901, ""), (902, "zagrud " * 4000), (903, "Zagrúd 12 _ mor")]
    for x in X.severity(docs(spark, texts), model).collect():
        counts, words = _plain_features(dict(texts)[x.doc_id])
        score = sum(weight.get(f, 0.0) * k for f, k in counts.items()) * X.SCALE / (words + X.SMOOTH) ** 0.25
        below = [1 / (1 + math.exp(score - t)) for t in model.thresholds]
        probs = [q - p for p, q in zip([0.0, *below], [*below, 1.0])]
        assert abs(x.expected_severity - sum(k * p for k, p in enumerate(probs))) < 2e-6
        assert probs[x.grade] >= max(probs) - 1e-9 and x.toxic == (below[0] < 0.5)


def test_a_shared_id_counts_once(spark):
    rows, lab = labelled(spark, 120)
    once, often = docs(spark, rows), docs(spark, rows + [rows[0], (0, "")] * 300)
    a, b = X.train(once, lab, sample=100), X.train(often, lab, sample=100)
    assert a.features == b.features and np.allclose(sorted(a.weights), sorted(b.weights)) and np.allclose(a.thresholds, b.thresholds)
    assert all(np.allclose(x, y) for x, y in zip(Q.train(once, lab), Q.train(often, lab)))


def test_without_both_classes(spark):
    rows, lab = labelled(spark, 30)
    d = docs(spark, rows)
    assert X.train(d, lab.where("toxic = 0")) is None and X.train(docs(spark, []), lab) is None
    assert {(x.expected_severity, x.toxic) for x in X.severity(d, None).collect()} == {(0.0, False)}
    assert X.drop_toxic(d, None).count() == 30


def test_cumulative_link_shares_weights():
    """Three ordered grades from one score: order of thresholds and of expected severity."""
    r = np.random.default_rng(0)
    x = r.normal(size=2000)
    y = np.digitize(2 * x + r.logistic(size=2000), [-1.0, 2.0])
    w, t = X.fit_cumulative_link(np.arange(2000), np.zeros(2000, int), x, y, 1)
    assert abs(w[0] - 2) < 0.3 and abs(t[0] + 1) < 0.3 and abs(t[1] - 2) < 0.3
    p = X.Model(["f"], w, t).severity(np.array([-4.0, 0.0, 4.0]))
    assert np.allclose(p.sum(axis=1), 1) and (np.diff(p @ np.arange(3)) > 0).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs_, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = lab.where("doc_id % 2 = 0")
    got = X.severity(docs_, X.train(docs_, half)).withColumnRenamed("toxic", "guess").join(lab.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(x.guess == bool(x.toxic) for x in got) >= 0.95 * len(got)
    assert sum(x.guess for x in got if not x.toxic) <= 0.01 * len(got)
    got = Q.quality_scores(docs_, half).join(lab.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(x.kept == bool(x.quality) for x in got) >= 0.95 * len(got)


def test_sparse_sites_rest_on_their_parents(spark):
    rows = []
    for k in range(400):
        rows.append((k, "good words flow along here in a calm line " * 3, "fr" if k % 2 else "en", "clean", 0))
        rows.append((1000 + k, "BAD!! LOUD!! $$$ ### %%% NOISE!! " * 4, "en", "noisy", 0))
    rows += [(5000, "BAD!! LOUD!! $$$ ### %%% NOISE!! " * 4, "xx", "clean", 0), (5001, None, None, None, None),
             (5002, "good words flow along here", "en", "rare", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([(i, int(i < 1000)) for i in list(range(0, 400, 3)) + list(range(1000, 1400, 3))], "doc_id long, quality int")
    got = {x.doc_id: x for x in Q.quality_scores(d, lab).collect()}
    assert len(got) == len(rows) and got[0].kept and not got[1000].kept and not got[5000].kept
    # one bad document moves its path little away from its host, and a rare host little from the corpus
    assert abs(got[5000].path_score - got[5000].host_score) < 0.5 < got[5000].host_score
    assert got[1000].host_score < got[5002].host_score < got[0].host_score
    assert got[5001].host is None and 0 <= got[5001].score <= 1
    assert Q.quality_scores(d.limit(0), lab).count() == 0


def test_posteriors_match_plain_python(spark):
    """The shrunk rates from the documents' probabilities, computed again without Spark."""
    d = "/root/testdata/sf0.001"
    docs_, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = Q.quality_scores(docs_, lab).toPandas()
    mean = got.doc_score.mean()
    within = max((got.doc_score**2).mean() - mean**2, 1e-6)

    def strength(sizes, means, parents):
        total, squares = sizes.sum(), (sizes**2).sum()
        eff = total - squares / total
        between = ((sizes * (means - parents) ** 2).sum() - (len(sizes) - 1) * within) / eff
        return Q.STRONGEST if between <= 0 else min(max(within / between, Q.WEAKEST), Q.STRONGEST)

    hosts = got.groupby("host").doc_score.agg(["sum", "count", "mean"])
    k0 = strength(hosts["count"], hosts["mean"], mean)
    hosts["post"] = (hosts["sum"] + k0 * mean) / (hosts["count"] + k0)
    assert np.allclose(got.host_score, hosts.post[got.host].to_numpy(), atol=1e-4)
    paths = got.groupby(["host", "path"]).doc_score.agg(["sum", "count", "mean"]).reset_index()
    parent = hosts.post[paths.host].to_numpy()
    k1 = strength(paths["count"], paths["mean"], parent)
    paths["post"] = (paths["sum"] + k1 * parent) / (paths["count"] + k1)
    merged = got.merge(paths, on=["host", "path"])
    assert np.allclose(merged.path_score, merged.post, atol=1e-4)


@pytest.mark.parametrize("text", ["", "a", "!!", "\n\n", "A B\nA B"])
def test_statistics_are_finite(spark, text):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "text string").select(*[c.alias(f) for f, c in Q.statistics(F.col("text")).items()]).first()
    assert all(np.isfinite(v) for v in row)


def test_few_labels_still_give_a_model(spark):
    clean = [(k, f"quiet words of number w{'abcdefghij'[k]}") for k in range(10)]
    toxic = [(10 + k, f"quiet words of number w{'abcdefghij'[k]} villain") for k in range(10)]
    df = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 10)) for k in range(20)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in X.severity(df, X.train(df, labels)).collect()}
    assert got == {k: k >= 10 for k in range(20)}
    same = df.withColumn("text", X.F.lit("one text"))  # nothing tells them apart
    assert X.train(same, labels) is None
