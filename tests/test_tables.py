"""First tables of pages as they come, against a plain tree; wide answers as maps; headers from rows."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sanscope.functions import html as H
from sanscope.functions import jsonflat as J
from sanscope.operators import envelopes as E
from sanscope.operators import ranking as R
from sanscope.operators import whois as W
from sanscope.sinks import writers as S


class Tree(HTMLParser):
    """A whole tree of nodes [tag, attributes, children], text as plain strings."""

    def __init__(self, page):
        super().__init__()
        self.root = ["", {}, []]
        self.stack = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(reversed(attrs)), []]
        self.stack[-1][2].append(node)
        if tag not in ("br", "img", "input", "hr", "meta", "link"):
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        names = [n[0] for n in self.stack]
        if tag in names[1:]:
            del self.stack[len(names) - 1 - names[::-1].index(tag):]

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def every(node, *tags):
    for child in node[2]:
        if not isinstance(child, str):
            if child[0] in tags:
                yield child
            yield from every(child, *tags)


def text(node):
    return "" if node[0] in ("script", "style", "template") else "".join(c if isinstance(c, str) else text(c) for c in node[2])


def plain(page):
    table = next(every(Tree(page or "").root, "table"), None)
    if table is None:
        return None
    return [([text(c).strip() for c in every(row, "td", "th")], next((a[1].get("href") for a in every(row, "a")), None)) for row in every(table, "tr")]


def pages(seed, n=400):
    r = random.Random(seed)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th class='x'>", "</th>", "<a href='y?a=1&amp;b=2'>", "<a>", "</a>", "<br>", "<br/>",
            "<p>", "</p>", "</div>", "<div>", "text ", "&eacute;&#33; ", "<!-- <td>no</td> -->", "<script>var a='<td>';</script>", " a & b < c ", "<TBODY>",
            "<td/>", "<img src=x>", "<style>td{}</style>", "</tr>", "<tr>", "<td>", "<td>"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(n)]


CASES = ["", "no table", "<table></table>", "<table><tr><td>a<td>b<tr><td>c</table>", "<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></table>",
         "<table><tr><td>open", "<TABLE><TR><TD>x</TD></TR></TABLE><table><tr><td>second</td></tr></table>", "</table><tr><td>stray</td></tr>",
         "<table><tr><td><a name=q>n</a><a href=z>z</a></td></tr></table>"]


def test_reader_matches_a_plain_tree():
    for page in CASES + pages(1, 3000):
        assert H.read_table(page) == plain(page), page


def test_rows_of_stored_pages(spark):
    stored = [(k, p) for k, p in enumerate([*CASES, *pages(2, 100), None])]
    df = spark.createDataFrame(stored, "page_id int, html string").repartition(4)
    got = {(r.page_id, r.pos): (r.cells, r.href) for r in W.html_first_table(df).collect()}
    assert got == {(k, n): row for k, p in stored for n, row in enumerate(plain(p) or [])}


def test_long_unclosed_page():
    rows = H.read_table("<table>" + "<tr><td>x" * 300)  # every row lies inside the one before
    assert len(rows) == 300 and rows[-1] == (["x"], None) and len(rows[0][0]) == 300 and rows[0][0][0] == "x" * 300
    assert len(H.read_table("<table>" + "<tr><td>x</td></tr>" * 50_000)) == 50_000


def test_registry_failures(spark):
    page = "<table><tr><td>{}.bo</td><td><a href='revisar_contacto.php?id={}'>R</a></td></tr></table>"
    t = spark.createDataFrame([(k, f"r{k}.bo") for k in range(5)], "target_seq long, target string")
    p = spark.createDataFrame([(f"r{k}", z, page.format(f"r{k}", k), "503 x" if k == 1 and z == ".bo" else None) for k in range(4) for z in (".ia.bo", ".bo")],
                              "root string, zone string, html string, error string")
    d = spark.createDataFrame([(f"https://nic.bo/revisar_contacto.php?id={k}", "<table><tr><td>A:</td><td>1</td></tr></table>", "404 y" if k == 2 else None)
                               for k in range(4)], "url string, html string, error string")
    rows = {r.target_seq: (r.ok, r.status, r.error, r.whois_dominio, r.whois_detalles_General_A) for r in W.envelope_whois(t, p, d, "now").collect()}
    assert rows == {0: (True, "200", "", "r0.bo", "1"), 1: (False, "500", "503 x", None, None), 2: (False, "500", "404 y", None, None),
                    3: (True, "200", "", "r3.bo", "1"), 4: (False, "404", rows[4][2], None, None)}


def test_million_distinct_keys(spark):
    """Ids used as keys: a map column and a catalogue table, no column for each."""
    body = F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: F.concat(
        F.lit('"id'), (F.col("target_seq") * 1000 + k).cast("string"), F.lit('":'), k.cast("string"))), ","), F.lit(',"shared":{"a":null}}'))
    payloads = spark.range(1000).withColumnRenamed("id", "target_seq").select("target_seq", F.lit(200).alias("http_status"), body.alias("body"))
    targets = spark.range(1000).selectExpr("id as target_seq", "'x' as target")
    rows = E.envelope_ipguide(targets, payloads, "now", fields=True)
    catalogue = E.key_catalogue(rows)
    assert catalogue.count() == 1_000_001
    assert catalogue.where("rows > 1").collect()[0].asDict() == {"key": "ipg_shared_a", "rows": 1000, "first_seq": 0}
    picked = E.pick_fields(rows.where("target_seq = 7"), ["ipg_id7005", "ipg_none"]).first()
    assert (picked.ipg_id7005, picked.ipg_none) == ("5", None)
    with pytest.raises(ValueError, match="fields=True"):
        E.envelope_ipguide(targets, payloads, "now")


def test_header_holds_the_keys_of_actual_rows(spark):
    targets = spark.createDataFrame([(1, "10.0.0.1")], "target_seq long, target string")
    none = spark.createDataFrame([], "target_seq long, target string, returncode int, stdout string, stderr string")
    one = spark.createDataFrame([(1, "10.0.0.1", 0, "rtt min/avg/max/mdev = 1.0/2.0/3.0/4.0 ms", "")], none.schema)
    payload = spark.createDataFrame([(1, 200, '{"city":null,"n":100.0}')], "target_seq long, http_status int, body string")
    dig, ping, ipg = E.envelope_dig(targets, none, "t"), E.envelope_ping(targets, one, "t"), E.envelope_ipguide(targets, payload, "t")
    head = ["timestamp", "action", "target", "ok", "status", "error"]
    assert S.header_first_appearance([dig]) == head
    assert S.header_first_appearance([dig, ping]) == [*head, "ping_avg", "ping_max", "ping_min", "ping_mdev"]
    assert S.header_first_appearance([ipg, dig]) == [*head, "ipg_city", "ipg_n"]  # a key with a null is a key
    assert S.header_first_appearance([dig.where(F.lit(False))]) == [] and S.header_first_appearance([]) == []


def test_answers_as_they_come(spark):
    bodies = ['{"response":[{"a":1,"a":2,"b":100.0,"c":true,"d":null,"e":{"x":[1,"y"]}},5,{}]}', "nope", None, "[1]", '{"response":{}}', '{"response":[]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "target_seq int, body string")
    got = [(r.target_seq, r.elem_pos, [(x.key, x.value) for x in r._flat]) for r in R.explode_response(df).collect()]
    assert got == [(0, 0, [("a", "2"), ("b", "100.0"), ("c", "True"), ("d", None), ("e", "{'x': [1, 'y']}")]), (0, 1, []), (0, 2, [])]
    assert [r[0] for r in df.orderBy("target_seq").select(J.kind("body")).collect()] == ["object", None, None, "array", "object", "object"]


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_stored_answers_are_not_broadcast(spark):
    """Made of a few small columns, their texts look small to the optimizer, however long they are."""
    targets = spark.range(300).selectExpr("id target_seq", "concat('www', id, '.acme.com') target")
    answers = targets.selectExpr("target_seq", "target", "200 http_status", """concat('{"ip":"', repeat('x', 5000), target, '"}') body""",
                                 "0 returncode", "repeat('x', 5000) stdout", "'' stderr")
    for rows in (E.envelope_ipguide(targets, answers, "now", fields=True), E.envelope_open_rank(targets, answers, "now", fields=True),
                 E.envelope_dig(targets, answers, "now"), E.envelope_dnslookup(targets, answers, "now"), E.envelope_ping(targets, answers, "now"),
                 E.envelope_traceroute(targets, answers, "now"), E.envelope_curl(targets, answers, "now")):
        assert _broadcasts(rows) == 0 and rows.count() == 300
    some = answers.where("target_seq % 3 = 0").unionByName(answers.where("target_seq = 6"))
    got = E.envelope_ipguide(targets, some, "now", fields=True)
    assert got.count() == 301 and got.where("ok").count() == 101 and got.where("ok and size(fields) = 1").count() == 101


def test_registry_pages_are_not_broadcast(spark):
    from sanscope.operators import whois as W

    targets = spark.range(20).selectExpr("id target_seq", "concat('root', id, '.bo') target")
    pages = spark.range(20).selectExpr("concat('root', id) root", "'.bo' zone", """concat('<table><tr><td>root', id,
        '.bo</td><td><a href="revisar_contacto.php?id=', id, '">x</a></td></tr><tr><td>b', id, '.bo</td><td>free</td></tr></table>') html""")
    details = spark.range(0, 20, 2).selectExpr("concat('https://nic.bo/revisar_contacto.php?id=', id) url",
                                               "concat('<table><tr><td>Titular</td><td>t', id, '</td></tr></table>') html")
    rows = W.envelope_whois(targets, pages, details, "now", fields=True)
    assert "BroadcastHashJoin [root" not in rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [detail_url" not in rows._jdf.queryExecution().executedPlan().toString()
    found = rows.selectExpr("target_seq", "size(fields) n").collect()
    assert sorted(map(tuple, found)) == sorted([(k, 2) for k in range(20)] + [(k, 3 if k % 2 == 0 else 2) for k in range(20)])
