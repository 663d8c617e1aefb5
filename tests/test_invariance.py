"""Results do not depend on partitioning or on the input's row order."""

from pyspark.sql import functions as F

from sanscope.operators import certs as C
from sanscope.plans.q_certs import entries


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_domain_analysis_invariant_under_repartition(spark, sf):
    e = entries(spark, sf)
    a = C.domain_analysis(C.entry_names(C.dedup_certs(e), keep=("not_before", "not_after")), "2000-01-01 00:00:00")
    shuffled = e.repartition(13, F.rand(7)).sortWithinPartitions(F.rand(3))
    b = C.domain_analysis(C.entry_names(C.dedup_certs(shuffled), keep=("not_before", "not_after")), "2000-01-01 00:00:00")
    assert _rows(a) == _rows(b)


def test_dedup_first_wins_is_order_independent(spark, sf):
    e = entries(spark, sf)
    a = C.dedup_certs(e).select("cert_id", "entry_seq")
    b = C.dedup_certs(e.repartition(5, F.rand(1))).select("cert_id", "entry_seq")
    assert _rows(a) == _rows(b)


def test_novelty_curve_buckets_do_not_change_totals(spark, sf):
    named = C.entry_names(C.dedup_certs(C.text_hits(entries(spark, sf), ["example.com", "mail"]), by=["query_ord"]),
                          keep=("query_ord", "entry_seq"))
    small = C.novelty_curve(named, bucket_width=1 << 12)
    big = C.novelty_curve(named)
    assert _rows(small) == _rows(big)


def test_running_sum_multi_level(spark):
    rows = [(q, i, (i * 7 + q) % 5) for q in (0, 1) for i in range(0, 3000, 3)]
    df = spark.createDataFrame(rows, "q int, o long, v long")
    got = {(r["q"], r["o"]): r["s"] for r in C.running_sum(df, "q", "o", "v", "s", width=4, levels=7).collect()}
    want, acc = {}, {}
    for q, o, v in sorted(rows):
        acc[q] = acc.get(q, 0) + v
        want[(q, o)] = acc[q]
    assert got == want
