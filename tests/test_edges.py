"""Inputs that the derived tables don't reach."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sanscope.functions import html as H
from sanscope.functions import names as N
from sanscope.operators import identities as I
from sanscope.operators import whois as W
from sanscope.operators.network import enrich_network
from sanscope.plans import discover as P
from sanscope.sinks import writers as S
from sanscope.sources import readers as R
from sanscope.streaming.cert_stream import CertStream

ENTRY = "entry_seq long, min_cert_id long, id long, issuer_ca_id int, common_name string, name_value string, not_before string, not_after string"


def entry(seq, cert, names, after="2030-01-01T00:00:00"):
    return (seq, cert, cert, 1, None, "\n".join(names), "2020-01-01T00:00:00", after)


@pytest.fixture
def zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    yield lambda z: spark.conf.set("spark.sql.session.timeZone", z)
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("z", ["UTC", "America/La_Paz", "Asia/Tokyo"])
def test_times_do_not_depend_on_the_session_zone(spark, zone, z):
    zone(z)
    texts = ["2020-01-01T00:00:00Z", "2020-01-01T00:00:00", "2020-01-01", "2020-01-01T02:00:00+02:00", "2020-01-01T02:30:00.5+0200",
             "12:34", "2020", "2020-1-5", "not-a-date", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", N.iso_date(N.parse_cert_time("t")).alias("d"), N.is_active(N.parse_cert_time("t"), "2019-12-31 23:59:59").alias("a"),
                    N.is_active(N.parse_cert_time("t"), "2020-01-01 00:00:00").alias("b")).orderBy("i").collect()
    assert [r.d for r in got] == ["2020-01-01"] * 5 + [""] * 6
    assert [r.a for r in got] == ["Vigente"] * 5 + ["Expirado"] * 6
    assert [r.b for r in got] == ["Expirado"] * 4 + ["Vigente"] + ["Expirado"] * 6


def test_targets_without_a_block_stay(spark):
    t = spark.createDataFrame([(1, "10.1.9.9"), (2, "10.1.2.7"), (3, "::1"), (4, "host.example.com"), (5, "10.200.0.1"), (6, " ")],
                              "target_seq long, target string")
    n = spark.createDataFrame([(1, "10.1.2.0/24", 11), (2, "10.0.0.0/8", 12), (3, "10.200.0.0/16", 13), (4, "10.1.2.0/25", 14)],
                              "net_id int, cidr string, asn int")
    got = {r.target_seq: r.net_id for r in enrich_network(t, n).collect()}
    assert got == {1: 2, 2: 4, 3: None, 4: None, 5: 3, 6: None}
    assert {r.net_id for r in enrich_network(t, n.where("net_id = 1")).collect() if r.target_seq == 1} == {None}


def test_character_references(spark):
    texts = ["Categor&iacute;a &#243; &#xE9; &lt;b&gt; &amp;lt; &nada; & &apos; &rarr;", None, "plain"]
    df = spark.createDataFrame([(k, None if t is None else f"<table><tr><td>{t}</td></tr></table>") for k, t in enumerate(texts)], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(H.table_rows("t")).collect()]
    assert [[x.cells for x in r] for r in got] == [[["Categoría ó é <b> &lt; &nada; & ' →"]], [], [["plain"]]]


def test_colliding_detail_paths(spark):
    page = ("<table><tr><td>A</td></tr><tr><td>B_C</td><td>1</td></tr><tr><td>A_B</td></tr><tr><td>C</td><td>2</td></tr></table>")
    search = '<table><tr><td>x.bo</td><td><a href="revisar_contacto.php?a=1&amp;id=7">R</a></td></tr></table>'
    t = spark.createDataFrame([(1, "x.bo")], "target_seq long, target string")
    pages = spark.createDataFrame([("x", ".bo", search)], "root string, zone string, html string")
    details = spark.createDataFrame([("https://nic.bo/revisar_contacto.php?a=1&id=7", page)], "url string, html string")
    row = W.envelope_whois(t, pages, details, "now").first()
    assert row.ok and row.whois_dominio == "x.bo" and row["whois_detalles_A_B_C"] == "2"


def test_domain_search_is_by_identity(spark):
    e = spark.createDataFrame([entry(1, 1, ["www.example.com"]), entry(2, 2, ["notexample.com"]), entry(3, 3, ["example.com.evil.net"]),
                               entry(4, 4, ["EXAMPLE.com"], "2021-01-01T00:00:00")], ENTRY)
    e = e.withColumn("cert_id", F.col("id"))
    run = lambda **kw: sorted(r[0] for r in P.discover_domains(spark, e, [("domain", "example.com")], None, **kw).collect())
    assert run() == ["example.com", "www.example.com"]
    assert run(exclude_expired="2025-01-01 00:00:00") == ["www.example.com"]


def test_extended_run_under_state(spark):
    """A certificate counts for the first pass that returned it; saved ones are skipped."""
    e = spark.createDataFrame([entry(1, 1, ["a.acme.com", "acme.org.uk"]), entry(2, 2, ["acme.net.x"]), entry(3, 3, ["acme.de.y"])], ENTRY)
    seen = spark.createDataFrame([("3",)], "cert_id string")
    rules = spark.createDataFrame([("com",), ("uk",)], "rule string")
    got = {r[0] for r in P.discover_extended(spark, e, ["acme.com"], rules, seen).collect()}
    assert got == {"a.acme.com", "acme.org.uk", "acme.net.x"}
    both = {r[0] for r in P.discover_extended(spark, e, ["acme.com"], rules).collect()}
    assert both == got | {"acme.de.y"}


def test_stream_does_not_depend_on_files_or_triggers(spark):
    rows = [entry(5, 7, ["first.com"]), entry(1, 8, ["other.com"])], [entry(1, 7, ["late.com"]), entry(2, 9, ["more.com", "first.com"])]

    def run(slices, at_once):
        s = CertStream(spark)
        s.init_state(spark.createDataFrame([], "cert_id string"))
        for part in rows:
            s.arrive(spark.createDataFrame(part, ENTRY).repartition(slices))
            if not at_once:
                s.run_new_certs()
        s.run_new_certs()
        s.run_analysis()
        s.compact()
        return (sorted(tuple(r) for r in s.new_cert_rows().select("entry_seq", "cert_id").collect()),
                sorted(tuple(r) for r in s.new_domain_rows().collect()), sorted(tuple(r) for r in s.analysis_rows().collect()))

    got = run(1, True)
    assert got[0] == [(1, 8), (2, 9), (5, 7)]
    assert got[1] == [(0, "first.com"), (0, "other.com"), (1, "first.com"), (1, "more.com")]
    assert got == run(2, True) == run(1, False) == run(2, False)


def test_state_versions_and_missing_state(spark):
    root = os.path.join(tempfile.mkdtemp(), "state")
    assert R.read_seen_ids(spark, root).count() == 0
    ids = spark.createDataFrame([("1",), ("2",)], "cert_id string")
    S.write_seen_ids(ids, root, 1)
    S.write_seen_ids(ids.union(spark.createDataFrame([("3",)], "cert_id string")), root, 2)
    os.makedirs(os.path.join(root, "v=000000000003"))  # a write that didn't end
    assert sorted(r[0] for r in R.read_seen_ids(spark, root).collect()) == ["1", "2", "3"]


def test_targets_of_several_files_keep_their_order(spark):
    d = tempfile.mkdtemp()
    for name, lines in (("a.txt", ["x1", "", " x2 "]), ("b.txt", ["y1", "x1"])):
        with open(os.path.join(d, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    got = [r.target for r in R.read_targets(spark, [" c "], d).orderBy("source_ord", "line_ord").collect()]
    assert got == [" c ", "x1", "x2", "y1", "x1"]


def test_limit_takes_the_first_rows_of_all_tasks(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("certificate_id"), F.lit("n").alias("name_value")).repartition(7)
    assert sorted(r[0] for r in I.limit_identities(df, 30).select("certificate_id").collect()) == list(range(30))


def test_raw_entries_keep_further_fields(spark):
    p = tempfile.mkdtemp()
    with open(os.path.join(p, "r.json"), "w") as f:
        f.write('[{"entry_seq":1,"id":5,"name_value":"a.com","issuer_name":"CN=X"},{"entry_seq":2,"id":6,"name_value":"b.com"}]\n')
    e = R.read_cert_entries(spark, p, extra="issuer_name string")
    assert sorted((r.entry_seq, r.issuer_name) for r in e.collect()) == [(1, "CN=X"), (2, None)]
    log = P.certificate_log(e, [("domain", "a.com")])
    assert [c for c in log.columns if c not in S.RUN_COLUMNS][-1] == "issuer_name" and log.count() == 1


def test_no_machine_local_checkpoint_on_a_cluster():
    from types import SimpleNamespace

    from sanscope.session import ensure_checkpoint_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(cluster)
