"""Database runs: any terms, extended passes, levels, limit, saved state, the four-field log."""

import datetime

import pytest

from sanscope.plans import discover as P

DAY = datetime.datetime(2024, 1, 1)
ROWS = [(1, "www.acme.com"), (1, "other.org"), (2, "*.shop.acme.com"), (3, "acme.com"), (4, "a.b.acme.com\nx.acme.net"), (5, "x.acme"), (5, "acme"),
        (6, "mail.acme.org"), (7, "ACME.com"), (8, "notacme.com"), (9, None), (10, "my_acme.com.x")]


@pytest.fixture(scope="module")
def tables(spark):
    ids = spark.createDataFrame([(c, n, DAY, DAY, c % 3) for c, n in ROWS],
                                "certificate_id long, name_value string, not_before timestamp, not_after timestamp, issuer_ca_id int")
    return ids.repartition(3), spark.createDataFrame([(0, "CN=A"), (1, "CN=B")], "id int, name string")


def domains(df):
    return sorted({(r.query_ord, r.domain) for r in df.collect()})


def test_own_terms(spark, tables):
    got = domains(P.discover_db(spark, *tables, [("domain", "acme.com"), ("keyword", "mail"), ("keyword", "cme")]))
    # full text asks for whole words: 'cme' is none
    assert got == [(0, "acme.com"), (0, "shop.acme.com"), (0, "www.acme.com"), (1, "mail.acme.org")]


def test_levels_and_kind(spark, tables):
    got = domains(P.discover_db(spark, *tables, [("domain", "acme.com"), ("keyword", "mail")], kind="domain", levels=0))
    assert got == [(0, "acme.com")]


def test_extended_pass_asks_for_the_label(spark, tables):
    rules = spark.createDataFrame([("com",)], "rule string")
    got = domains(P.discover_db(spark, *tables, [("domain", "acme.com")], extended=True, rules=rules))
    assert [d for q, d in got if q == 1] == ["acme", "x.acme"] and (0, "www.acme.com") in got
    state = spark.createDataFrame([("5",)], "cert_id string")
    got = domains(P.discover_db(spark, *tables, [("domain", "acme.com")], seen=state, extended=True, rules=rules))
    assert [d for q, d in got if q == 1] == []


def test_first_pass_owns_a_certificate(spark, tables):
    none = spark.createDataFrame([], "cert_id string")
    searches = [("domain", "acme.com"), ("domain", "www.acme.com")]
    assert {q for q, _ in domains(P.discover_db(spark, *tables, searches, seen=none))} == {0}
    assert {q for q, _ in domains(P.discover_db(spark, *tables, searches))} == {0, 1}


def test_limit_and_log(spark, tables):
    passes = P.db_passes(spark, [("domain", "acme.com"), ("keyword", "mail")])
    log = P.certificate_log_db(P.db_rows(*tables, passes, limit=2))
    rows = sorted(tuple(r) for r in log.collect())
    assert rows == [(0, 1, "www.acme.com", DAY, DAY, "CN=B"), (0, 2, "*.shop.acme.com", DAY, DAY, None), (1, 6, "mail.acme.org", DAY, DAY, "CN=A")]
    assert log.columns[2:] == ["name_value", "not_before", "not_after", "issuer_name"]
