"""Hand-made edge cases for the scalar functions."""

from pyspark.sql import functions as F

from sanscope.functions import names as N
from sanscope.functions import targets as T
from sanscope.operators import certs as C
from sanscope.operators import suffix


def _one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_normalize_domain(spark):
    cases = {
        "*.A.com.": "a.com", "*.*.a.com": "*.a.com", ".*.a.com": "*.a.com", "*.": None, ".": None,
        "a..b": "a..b", "x@a.com": None, "_dmarc.a.com": None, "1.2.3.4": "1.2.3.4", "xn--a.com": "xn--a.com",
        "ñ.com": None, " www.a.com ": "www.a.com", "a\n.": None, "\x1c a.com \x1f": "a.com", "": None,
    }
    got = _one(spark, N.normalize_domain, list(cases))
    assert got == list(cases.values())


def test_split_names_matches_splitlines(spark):
    seps = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    texts = ["a" + s + "b" + s for s in seps] + ["", "x", "a\n\nb"]
    got = _one(spark, N.split_names, texts)
    assert [list(g) for g in got] == [t.splitlines() for t in texts]


def test_a_name_is_split_and_normalised_once(spark):
    """No filter below the projection computes names again, and the right names remain at their positions."""
    lines = ["*.A.com.\r\n b.com \x85", "", None, "bad@x\n\nc.com", "\u3000*..d.com.. \x1c"]
    df = spark.createDataFrame([(i, v, "CN.com" if i % 2 else None) for i, v in enumerate(lines)], "entry_seq int, name_value string, common_name string")
    named = C.entry_names(df, keep=("entry_seq",))
    assert sorted(map(tuple, named.collect())) == [
        (0, 0, "a.com"), (0, 1, "b.com"), (1, 0, "cn.com"), (3, 2, "c.com"), (3, 3, "cn.com"), (4, 0, "d.com")]
    assert named.columns == ["entry_seq", "name_pos", "domain"]
    plan = C.distinct_domains(named)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [plan.count(f) for f in ("regexp_extract(", "regexp_replace(", "translate(", "split(")] == [1, 0, 1, 1], plan


def test_cert_id(spark):
    df = spark.createDataFrame([(0, 7), (None, 7), (5, 7), (None, None)], "min_cert_id long, id long")
    assert [r[0] for r in df.select(N.cert_id()).collect()] == [7, 7, 5, None]


def test_private_suffix_rules_and_fallback(spark):
    rules = spark.createDataFrame([(r,) for r in ("com", "uk", "co.uk", "de", "*.ck", "!www.ck")], "rule string")
    doms = spark.createDataFrame([(d,) for d in ("www.google.com", "google.co.uk", "com", "a.b.ck", "www.ck", "x.localhost")],
                                 "domain string")
    got = {r["domain"]: r["private_suffix"] for r in suffix.private_suffix(doms, rules).collect()}
    assert got == {"www.google.com": "www.google", "google.co.uk": "google", "com": "com", "a.b.ck": "a",
                   "www.ck": "www", "x.localhost": "x"}
    assert _one(spark, N.fallback_private_suffix, ["www.google.co.uk", "com"]) == ["www.google.co", "com"]


def test_filter_private_suffix_label(spark):
    df = spark.createDataFrame([("www.google.de", "google"), ("www.google.com", "www.google")], "d string, s string")
    assert [r[0] for r in df.select(N.has_label("d", F.col("s"))).collect()] == [True, False]


def test_root_label_and_target_url(spark):
    assert _one(spark, N.root_label, ["umsa.edu.bo", "a.bolivia.bo"]) == ["umsa", "alivia"]
    assert _one(spark, T.target_url, ["a.com", "httpbin.org"]) == ["http://a.com", "httpbin.org"]


def test_validate_target(spark):
    cases = [("  ", False, "El target es requerido"), ("https://a.com", False, "Usa solo host/IP, no URL completa"),
             ("1.2.3.4", True, None), ("::1", True, None), ("as123", True, None), ("a.com", True, None),
             ("-a.com", False, "Target invalido"), ("a-.com", False, "Target invalido"), ("1.2.3.999", True, None),
             ("10.0.0.0/8", False, "Target invalido"), ("localhost", False, "Target invalido")]
    got = _one(spark, T.validate_target, [c[0] for c in cases])
    assert [(g["ok"], g["error"]) for g in got] == [(c[1], c[2]) for c in cases]


def test_resolve_link(spark):
    base = "https://nic.bo/x/y.php?q=1#f"
    cases = {"revisar_contacto.php?id=1": "https://nic.bo/x/revisar_contacto.php?id=1",
             "/r.php": "https://nic.bo/r.php", "//h.bo/r": "https://h.bo/r", "http://o.bo/": "http://o.bo/",
             "../r.php": "https://nic.bo/r.php", "?id=2": "https://nic.bo/x/y.php?id=2", "#g": "https://nic.bo/x/y.php?q=1#g",
             "": base}
    got = _one(spark, lambda c: T.resolve_link(base, c), list(cases))
    assert got == list(cases.values())


def test_links_resolve_as_urljoin_does(spark):
    from urllib.parse import urljoin

    from sanscope.functions.targets import resolve_link

    bases = ["http://x.net/b/c?q=1#f", "https://x.net", "http://x.net/", "http://x.net/a/b/"]
    hrefs = ["", "d", "../d", "../../../d", "./", "..", "d/../e/./f?x=../y#../z", "?p=1", "#f", "//y.net/a", "http://y.net/a/../b",
             "/", "/d", "/d/", "/d/../e", "/../e", "/d/./e/..", "/d/..", "/d?u=/../v", "/d#/../v", "mailto:a@b.c"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", resolve_link(F.col("b"), F.col("h")).alias("u")).collect()
    wrong = [(r.b, r.h, r.u, urljoin(r.b, r.h)) for r in got if r.u != urljoin(r.b, r.h)]
    assert not wrong
