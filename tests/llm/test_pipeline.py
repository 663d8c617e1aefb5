import base64

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline

from .helpers import brute_exact, brute_near


def test_stages_against_brute_force(spark, sf, tmp_path):
    """Each stage on its own input: what it keeps, and that it changes nothing else."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [" ".join(_words(t)) for _, t in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.schema.simpleString() == docs.schema.simpleString()
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        after = {r.doc_id for r in out.collect()}
        assert out.count() == len(after) and after <= set(before)
        rows = list(before.items())
        if name == "toxicity":
            wrong = sum((i not in after) != bool(t) for i, t in labels.items() if i in before)
            assert wrong <= 0.05 * len(labels) and len(after) < len(before)
            assert sum(i not in after for i, t in labels.items() if not t) <= 0.01 * len(labels)
        elif name == "exact_dedup":
            assert after == {i for i, x in brute_exact(rows).items() if x[2]}
        elif name == "near_dedup":
            assert after == {i for i, x in brute_near(rows).items() if x[2]}
        elif name == "decontamination":
            leaks = {i for i, t in rows if any(f" {b} " in f" {' '.join(_words(t))} " for b in bench)}
            assert leaks and after == set(before) - leaks
        else:
            with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert after == set(before)
            for r in out.collect():
                assert r.token_ids == tik.encode_ordinary(before[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.lossless
        docs = out


def _words(text):
    import string

    table = {ord(c): " " for c in string.punctuation} | {k: k + 32 for k in range(65, 91)}
    return text.translate(table).split()


def test_odd_rows_pass_through(spark, sf):
    """Nulls, empties and repeated rows: every stage has a defined result."""
    rows = [(1, "some text here", None, None, 3), (1, "some text here", None, None, 3), (2, None, "en", "s", None), (3, "", "en", "s", 0),
            (None, "no id", "en", "s", 5), (4, "some  text here", "en", "s", 4)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    keep = {"toxicity": 6, "exact_dedup": 3, "near_dedup": 3, "decontamination": 3, "bpe": 3}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        assert docs.count() == keep[name], name
    assert sorted((r.doc_id, r.n_tokens) for r in docs.collect() if r.doc_id is not None) == [(1, 3), (2, 0)]


def test_dedup_judges_documents_with_shared_or_no_id(spark, sf):
    long = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"term{k}" for k in range(60))
    rows = [(1, "one text"), (1, "another text"), (1, "another  text"), (2, "one text"), (None, "one text"), (None, "lonely"),
            (None, "lonely"), (None, "else"), (5, long), (5, other), (6, long + " end"), (None, other + " end"), (None, "else " + long), (7, None)]
    docs = spark.createDataFrame([(i, t, None, None, n) for n, (i, t) in enumerate(rows)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    got = corpus_pipeline.drop_copies(spark, docs, sf)
    assert got.schema == docs.schema
    assert sorted((r.doc_id or 0, " ".join((r.text or "").split())) for r in got.collect()) == sorted(
        (i or 0, " ".join((t or "").split())) for i, t in set(rows) - {(2, "one text"), (None, "one text"), (1, "another  text")})
    near = corpus_pipeline.drop_near_copies(spark, got, sf)
    assert near.schema == docs.schema
    gone = {(6, long + " end"), (None, other + " end"), (None, "else " + long)}
    assert sorted((r.doc_id or 0, r.text or "") for r in near.collect()) == sorted(
        (r.doc_id or 0, r.text or "") for r in got.collect() if (r.doc_id, r.text) not in gone)


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_registered(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    assert {"op3_exact_dedup"} <= set(e.oracle_sql())
