"""flatten_json edge cases."""

from pyspark.sql import functions as F

from sanscope.functions import jsonflat as J


def _flat(spark, doc, prefix="p_"):
    df = spark.createDataFrame([(1, doc)], "k int, body string")
    out = df.select(J.parsed("body", prefix)["flat"].alias("flat"))
    return [(r["key"], r["value"]) for r in out.select(F.explode("flat").alias("kv")).select("kv.*").collect()]


def test_flatten_paths_nulls_and_empties(spark):
    got = _flat(spark, '{"a":[1,{"k":null}],"e":{},"l":[],"b":true,"s":"x"}')
    assert sorted(got, key=lambda x: x[0]) == [("p_a_0", "1"), ("p_a_1_k", None), ("p_b", "True"), ("p_s", "x")]


def test_flatten_deep_nesting_is_not_cut(spark):
    doc = "1"
    for i in range(40):
        doc = '{"k%d":%s}' % (i, doc)
    got = _flat(spark, doc, "")
    assert len(got) == 1 and got[0][1] == "1" and got[0][0].count("_") == 39


def test_flatten_duplicate_path_last_wins(spark):
    got = _flat(spark, '{"a":{"b":2},"a_b":1}', "")
    assert got == [("a_b", "1")]


def test_document_order_repeated_keys_and_number_text(spark):
    got = _flat(spark, '{"z":1,"a_b":1,"a":{"b":2},"z":3,"n":100.0,"big":12345678901234567890,"e":-0.5e1}', "")
    assert got == [("z", "3"), ("a_b", "2"), ("n", "100.0"), ("big", "12345678901234567890"), ("e", "-5.0")]


def test_other_documents(spark):
    rows = [(1, "not json"), (2, None), (3, "[1]"), (4, '{"response":[]}'), (5, '{"response":[{"a":1},{"a":2}]}'), (6, '"s"'), (7, "{}")]
    df = spark.createDataFrame(rows, "k int, body string")
    plain = {r[0]: (r[1].valid, r[1].found) for r in df.select("k", J.parsed("body", "p_").alias("p")).collect()}
    assert plain == {1: (False, False), 2: (False, False), 3: (True, False), 4: (True, True), 5: (True, True), 6: (True, False), 7: (True, True)}
    first = {r[0]: r[1].flat for r in df.select("k", J.parsed("body", "p_", response=True).alias("p")).collect()}
    assert [tuple(x) for x in first[5]] == [("p_a", "1")] and [k for k in first if first[k] is not None] == [5]
