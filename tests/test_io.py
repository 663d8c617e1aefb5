"""Sources and sinks on real files."""

import os
import tempfile


from sanscope.sinks import writers as W
from sanscope.sources import readers as R


def _tmp():
    return tempfile.mkdtemp(prefix="sanscope-io-")


def test_cert_entries_json_roundtrip(spark):
    d = _tmp()
    p = os.path.join(d, "entries.jsonl")
    with open(p, "w") as f:
        f.write('{"entry_seq":1,"min_cert_id":0,"id":7,"name_value":"a.com\\nb.com","common_name":"a.com",'
                '"not_before":"2020-01-01T00:00:00","not_after":"2021-01-01T00:00:00Z","extra":1}\n')
    df = R.read_cert_entries(spark, p)
    r = df.collect()[0]
    assert r["id"] == 7 and r["name_value"] == "a.com\nb.com" and r["issuer_ca_id"] is None


def test_targets_cli_then_file(spark):
    d = _tmp()
    p = os.path.join(d, "targets.txt")
    with open(p, "w") as f:
        f.write(" a.com \n\n  \nb.com\na.com\n")
    got = [(r["source_ord"], r["target"]) for r in R.read_targets(spark, [" x ", "y"], p).orderBy("source_ord", "line_ord").collect()]
    assert got == [(0, " x "), (0, "y"), (1, "a.com"), (1, "b.com"), (1, "a.com")]


def test_domains_csv(spark):
    d = _tmp()
    p = os.path.join(d, "d.csv")
    with open(p, "w") as f:
        f.write('dominio,otro\n a.com ,1\n,2\n"b.com",3\n')
    assert sorted(tuple(r) for r in R.read_domains_csv(spark, p).collect()) == [(0, "a.com"), (1, "b.com")]


def test_seen_ids_missing_and_present(spark):
    d = _tmp()
    assert R.read_seen_ids(spark, os.path.join(d, "nope.txt")).count() == 0
    p = os.path.join(d, "seen.txt")
    with open(p, "w") as f:
        f.write(" 10\n\n9\n10\n")
    assert sorted(r[0] for r in R.read_seen_ids(spark, p).collect()) == ["10", "9"]


def test_sinks_sorted_and_versioned(spark):
    d = _tmp()
    doms = spark.createDataFrame([("b.com",), ("a.com",), ("b.com",)], "domain string")
    W.write_domains_csv(doms, os.path.join(d, "domains"))
    back = spark.read.option("header", True).csv(os.path.join(d, "domains")).collect()
    assert [r[0] for r in back] == ["a.com", "b.com"]
    state = spark.createDataFrame([("10",), ("9",)], "cert_id string")
    path = W.write_seen_ids(state, os.path.join(d, "state"), 1)
    assert [r[0] for r in spark.read.text(path).collect()] == ["10", "9"]


def test_jsonl_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    line = W.jsonl_lines(df, ["a", "b"]).collect()[0][0]
    assert line == '{"a":1,"b":null}'


def test_results_header_first_appearance(spark):
    a = spark.createDataFrame([(1, None)], "x int, y string")
    b = spark.createDataFrame([(2, "v")], "x int, z string")
    # a key that is present counts, whatever its values; outputs without rows and the run's ordinals don't
    assert W.header_first_appearance([a, b.limit(0), b.withColumnRenamed("z", "target_seq")]) == ["x", "y"]
    assert W.header_first_appearance([a, b]) == ["x", "y", "z"]


def test_name_index_prefix_pushdown(spark, sf):
    from sanscope.operators import identities as I
    from sanscope.sources import fixtures as X

    d = _tmp()
    ids = X.cert_identities(spark, sf)
    I.write_name_index(ids, os.path.join(d, "idx"), partitions=4)
    idx = spark.read.parquet(os.path.join(d, "idx"))
    hit = idx.where(I.identity_domain_match_indexed("example.com"))
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(rev_name,com.example.)" in plan
    plain = ids.where(I.identity_domain_match("name_value", "example.com"))
    assert hit.count() == plain.count()
