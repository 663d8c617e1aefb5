import pytest

from sanscope.llm.exact_dedup import exact_dedup

from .helpers import brute_exact, docs

TEXTS = ["a b", "a\t b", "a  b ", "", None, " ", "x" * 5000, "x" * 4096, "x" * 5000, "y" + "x" * 4999, "x" * 4096 + "y",
         "é" * 3000, "é" * 3000, "é" * 2999 + "e", "z " * 20000, "z  " * 20000, "tail", "tail"]


@pytest.mark.parametrize("block,bits", [(4096, 64), (64, 64), (64, 3)])
def test_matches_brute_force(spark, block, bits):
    """Also with blocks of different content that share a hash."""
    got = {r[0]: tuple(r)[1:] for r in exact_dedup(docs(spark, TEXTS), block_bytes=block, hash_bits=bits).collect()}
    assert got == brute_exact(list(enumerate(TEXTS)))


def test_hot_group_and_repeated_rows(spark):
    rows = [(i, "copy " * 50) for i in range(300)] + [(7, "copy " * 50), (None, "copy " * 50), (400, "own"), (400, "other")]
    got = exact_dedup(docs(spark, rows)).collect()
    hot = [r for r in got if r.group_size == 302]
    assert len(hot) == 301 and {r.keep_id for r in hot} == {0} and [r.doc_id for r in hot if r.kept] == [0]
    assert sorted((r.doc_id, r.group_size) for r in got if r.doc_id == 400) == [(400, 1), (400, 1)]


def test_empty_table(spark):
    df = exact_dedup(docs(spark, []))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0


def test_native_plan(spark, sf):
    from sanscope.llm.queries import QUERIES

    plan = QUERIES["op3_exact_dedup"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_text_is_hashed_once_not_once_per_block(spark):
    import time

    long = spark.range(2).selectExpr("id as doc_id", "repeat('0123456789abcde ', 1000000) as text")  # 16 MB each
    began = time.time()
    got = sorted(tuple(r)[:4] for r in exact_dedup(long).select("doc_id", "keep_id", "group_size", "kept").collect())
    assert got == [(0, 0, 2, True), (1, 0, 2, False)] and time.time() - began < 60
