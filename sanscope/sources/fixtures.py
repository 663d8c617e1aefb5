"""Inputs derived by Spark from the driver tables (certificate entries, identities,
lookup payloads, ...). Every frame grows with the tables it reads.

The derivation rules are the shared test recipes; the DuckDB twins live in
``sanscope.checks.duckdb_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sanscope.session import use_utc
from sanscope.sources.tables import table

# FIXED VALUES of the test recipes
NAME_PREFIXES = ("www", "mail", "api", "dev", "a.b", "m")
NAME_BASES = ("example.com", "acme.com.bo", "umsa.edu.bo", "www.acme.com", "google.co.uk", "shop.example.com", "localhost")
# search terms in command-line order: (kind, term)
QUERIES = (("domain", "example.com"), ("domain", "acme.com.bo"), ("keyword", "umsa"),
           ("domain", "google.co.uk"), ("keyword", "mail"))
SUFFIX_RULES = ("com", "bo", "com.bo", "edu.bo", "uk", "co.uk", "*.ck", "!www.ck")
AS_OF = "2000-01-01 00:00:00"
ENVELOPE_TS = "2024-01-01T00:00:00+00:00"


def _pick(index: Column, values) -> Column:
    """``values[index]`` for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def name_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _with_names(_lines(spark, sf))


def _with_names(li: DataFrame) -> DataFrame:
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    host = F.concat(
        _pick(pk % 6, NAME_PREFIXES),
        F.when(sk % 3 == 0, F.lit("")).otherwise(_s(sk % 50)),
        F.lit("."),
        _pick((pk + sk) % 7, NAME_BASES),
    )
    li = li.withColumn("host", host)
    h = F.col("host")
    k = (pk + ln) % 9
    # written so that ``host`` appears twice (not once per variant): filters on names get
    # pushed below this projection and inline it
    pre = _pick(k, ("*.", "", " ", "admin@", "", "_dmarc.", "", "", ""))
    post = _pick(k, ("", "", ". ", "", "", "", "", "", ""))
    name = F.when(k == 4, F.lit("")).otherwise(F.concat(pre, F.when(k == 1, F.upper(h)).otherwise(h), post))
    return li.withColumn("name", name)


def _iso(ts: Column, zulu: Column) -> Column:
    return F.concat(F.replace(_s(ts), F.lit(" "), F.lit("T")), F.when(zulu, F.lit("Z")).otherwise(F.lit("")))


def cert_entries(spark: SparkSession, sf: str) -> DataFrame:
    """HTTP-flavoured CT entries; ``entry_seq`` is the response order."""
    use_utc(spark)
    # the numbers go to their order, the names are written there: they are several times as long
    names = (
        _with_names(_lines(spark, sf).repartition("l_orderkey"))
        .groupBy("l_orderkey")
        .agg(
            F.array_join(
                F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "name"))).getField("name"),
                "\n",
            ).alias("name_value"),
            F.max("host").alias("common_name"),
        )
    )
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    ok = F.col("o_orderkey")
    joined = o.join(names, ok == F.col("l_orderkey"))
    # every fifth order is returned twice (copy 0 and 1)
    joined = joined.withColumn("copy", F.explode(F.when(ok % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return joined.select(
        (ok * 2 + F.col("copy")).alias("entry_seq"),
        F.when(ok % 7 == 0, F.lit(0).cast("bigint")).when(ok % 3 == 0, F.lit(None).cast("bigint")).otherwise(ok).alias("min_cert_id"),
        ok.alias("id"),
        (F.col("o_custkey") % 25).cast("int").alias("issuer_ca_id"),
        "common_name",
        "name_value",
        F.when(ok % 97 == 0, F.lit("not-a-date")).otherwise(_iso(F.col("o_orderdate"), ok % 2 == 0)).alias("not_before"),
        _iso(F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"), ok % 2 == 0).alias("not_after"),
    )


def cert_identities(spark: SparkSession, sf: str) -> DataFrame:
    """DB-flavoured rows, one per certificate identity."""
    use_utc(spark)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n = name_rows(spark, sf).select("l_orderkey", "name")
    return n.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_orderkey").alias("certificate_id"),
        F.col("name").alias("name_value"),
        F.col("o_orderdate").alias("not_before"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("not_after"),
        (F.col("o_custkey") % 25).cast("int").alias("issuer_ca_id"),
    )


def ca(spark: SparkSession, sf: str) -> DataFrame:
    """Issuer dimension (one id missing on purpose)."""
    return (
        table(spark, sf, "nation")
        .where(F.col("n_nationkey") != 7)
        .select(F.col("n_nationkey").alias("id"), F.concat(F.lit("CN="), F.col("n_name")).alias("name"))
    )


def seen_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Saved state of a previous run: certificate ids as strings."""
    return (
        table(spark, sf, "orders")
        .where(F.col("o_orderkey") % 4 == 1)
        .select(F.col("o_orderkey").cast("string").alias("cert_id"))
    )


def suffix_rules(spark: SparkSession) -> DataFrame:
    """Public-suffix rule table (a parameter, like the suffix list file)."""
    return spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")


def targets(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    k = c % 8
    t = (
        F.when(k == 0, F.concat(_s(c % 223 + 1), F.lit("."), _s(c % 251), F.lit(".3.4")))
        .when(k == 1, F.concat(F.lit("AS"), _s(c)))
        .when(k == 2, F.concat(F.lit("https://www"), _s(c), F.lit(".example.com")))
        .when(k == 3, F.lit("  "))
        .when(k == 4, F.lit("10.0.0.0/8"))
        .when(k == 5, F.lit("bad-.example.com"))
        .when(k == 6, F.concat(F.lit(" umsa"), _s(c), F.lit(".edu.bo ")))
        .otherwise(F.concat(F.lit("www"), _s(c), F.lit(".acme.com.bo")))
    )
    return table(spark, sf, "customer").select(c.alias("target_seq"), t.alias("target"))


def rank_payloads(spark: SparkSession, sf: str) -> DataFrame:
    s, t = F.col("target_seq"), F.trim(F.col("target"))
    body = (
        F.when(s % 11 == 0, F.lit("not json"))
        .when(s % 7 == 0, F.lit('{"status_code":200,"response":[]}'))
        .otherwise(F.concat(
            F.lit('{"status_code":200,"response":[{"domain":"'), t, F.lit('","page_rank_integer":'), _s(s % 10),
            F.lit(',"rank":"'), _s(s * 37), F.lit('","error":null}]}')))
    )
    return targets(spark, sf).select(
        s, t.alias("target"), F.when(s % 5 == 0, F.lit(404)).otherwise(F.lit(200)).alias("http_status"), body.alias("body"))


def rank_answers(spark: SparkSession, sf: str) -> DataFrame:
    """``rank_payloads`` with answers as they come: repeated keys, decimals, booleans, nested values, several elements."""
    s = F.col("target_seq")
    odd = F.concat(F.lit('{"status_code":200,"status_code":201,"response":[{"domain":"x","domain":"d'), _s(s), F.lit(
        '","page_rank_decimal":100.0,"rank":null,"known":true,"nested":{"b":1,"a":[1,2]}},{"domain":"second","page_rank_decimal":2.5}]}'))
    return rank_payloads(spark, sf).select(
        s, "target", F.when(s % 10 == 3, F.lit(200)).otherwise(F.col("http_status")).alias("http_status"),
        F.when(s % 10 == 3, odd).when(s % 10 == 9, F.lit('[1]')).otherwise(F.col("body")).alias("body"))


def network_payloads(spark: SparkSession, sf: str) -> DataFrame:
    s, t = F.col("target_seq"), F.trim(F.col("target"))
    body = F.when(s % 9 == 0, F.lit("<html>err</html>")).otherwise(F.concat(
        F.lit('{"ip":"'), t, F.lit('","network":{"cidr":"10.0.0.0/8","autonomous_system":{"asn":'), _s(s + 6568),
        F.lit(',"tags":["a",{"k":"v"}]}},"location":{"country":"Bolivia","city":null},"extra":{}}')))
    return targets(spark, sf).select(
        s, t.alias("target"), F.when(s % 13 == 0, F.lit(502)).otherwise(F.lit(200)).alias("http_status"), body.alias("body"))


def json_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """``network_payloads``, some with repeated keys, paths that meet, number forms and empty parts."""
    s = F.col("target_seq")
    odd = F.concat(F.lit('{"a_b":1,"a":{"b":2},"ip":"x","ip":"y'), _s(s), F.lit(
        '","n":100.0,"e":[1.5,true,null,{"k":""},12345678901],"z":{},"w":[]}'))
    return network_payloads(spark, sf).select(s, "target", F.when(s % 9 == 1, odd).otherwise(F.col("body")).alias("body"))


def networks(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    cidr = (F.when(n % 3 == 0, F.concat(_s(n + 1), F.lit(".0.0.0/8")))
            .when(n % 3 == 1, F.concat(_s(n), F.lit("."), _s(n - 1), F.lit(".0.0/16")))
            .otherwise(F.concat(_s(n * 8 + 1), F.lit("."), _s(n * 8), F.lit("."), _s(n % 5), F.lit(".0/24"))))
    return table(spark, sf, "nation").select(n.alias("net_id"), cidr.alias("cidr"), (n + 6500).alias("asn"))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c.cast("bigint")))


def network_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Nested blocks of both families, some with host bits or in full form."""
    k = F.col("s_suppkey")
    n, dot, six = _s(k % 200 + 1), F.lit("."), F.lit("2800:")
    cidr = (F.when(k % 6 == 0, F.concat(n, F.lit(".0.0.0/8"))).when(k % 6 == 1, F.concat(n, dot, _s(k % 250), F.lit(".9.0/16")))
            .when(k % 6 == 2, F.concat(n, dot, _s(k % 250), dot, _s(k % 100), F.lit(".0/24")))
            .when(k % 6 == 3, F.concat(six, _hex(k), F.lit("::/32")))
            .when(k % 6 == 4, F.concat(six, F.upper(_hex(k - 1)), F.lit(":"), _hex(k % 7), F.lit("::/48")))
            .otherwise(F.concat(F.lit(" "), six, _hex(k - 2), F.lit(":0:"), _hex(k), F.lit(":0:0:0:0/64"))))
    return table(spark, sf, "supplier").select(k.alias("net_id"), cidr.alias("cidr"), (k % 40 + 6500).alias("asn"))


def network_targets(spark: SparkSession, sf: str) -> DataFrame:
    """IPv4, IPv6 in several forms, CIDR blocks of both families, ASNs, hosts and invalid text."""
    c = F.col("c_custkey")
    n, six = c % 97, F.lit("2800:")
    a, b = _s(n % 200 + 1), _s(n % 250)
    t = (F.when(c % 9 == 0, F.concat(a, F.lit("."), b, F.lit("."), _s(n % 100), F.lit("."), _s(c % 250)))
         .when(c % 9 == 1, F.concat(six, _hex(n), F.lit("::"), _hex(c % 65536)))
         .when(c % 9 == 2, F.concat(F.lit(" "), six, F.upper(_hex(n)), F.lit(":0:"), _hex(n + 2), F.lit(":0:0:0:"), _hex(c % 65536), F.lit(" ")))
         .when(c % 9 == 3, F.concat(a, F.lit("."), b, F.lit(".0.0/20")))
         .when(c % 9 == 4, F.concat(six, _hex(n), F.lit("::/40")))
         .when(c % 9 == 5, F.concat(F.lit("AS"), _s(c % 60 + 6490)))
         .when(c % 9 == 6, F.concat(F.lit("www"), _s(c), F.lit(".acme.com.bo")))
         .when(c % 9 == 7, F.concat(six, _hex(n), F.lit("::10.1.2."), _s(c % 250)))
         .when(c % 2 == 0, F.lit("1.2.3.4/33")).otherwise(F.lit("bad-.example.com")))
    return table(spark, sf, "customer").select(c.alias("target_seq"), t.alias("target"))


def host_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Stored addresses of most hosts of ``network_targets``; the second answer lies in another block."""
    c = F.col("c_custkey")
    n = c % 97
    first = F.when(c % 2 == 0, F.concat(_s(n % 200 + 1), F.lit("."), _s(n % 250), F.lit(".1.1"))).otherwise(
        F.concat(F.lit("2800:"), _hex(n), F.lit("::1")))
    answers = F.array(F.struct(F.lit(0).alias("ans_pos"), first.alias("address")), F.struct(F.lit(1).alias("ans_pos"), F.lit("9.9.9.9").alias("address")))
    return (table(spark, sf, "customer").where((c % 9 == 6) & (c % 4 != 0))
            .select(F.concat(F.lit("WWW"), _s(c), F.lit(".acme.com.bo")).alias("host"), F.explode(answers).alias("a")).select("host", "a.*"))


def dig_output(spark: SparkSession, sf: str, record_types: bool = False) -> DataFrame:
    """Stored ``dig +noall +answer`` output. ``record_types=True`` varies the type by target."""
    s, t = F.col("target_seq"), F.trim(F.col("target"))
    tab = F.lit("\t")
    stdout = F.when(s % 5 == 0, F.lit("")).otherwise(F.concat(
        t, F.lit("."), tab, F.lit("300"), tab, F.lit("IN"), tab, F.lit("A"), tab, F.lit("10.0.0."), _s(s % 250),
        F.lit("\nshort line\n"), t, F.lit('. 60 IN TXT "v=spf1  -all x"')))
    rtype = _pick(s % 7, ("A", "AAAA", "CNAME", "MX", "NS", "TXT", "SOA")) if record_types else F.lit("A")
    return targets(spark, sf).select(
        s, t.alias("target"), rtype.alias("record_type"),
        F.when(s % 6 == 0, F.lit(9)).otherwise(F.lit(0)).alias("returncode"),
        stdout.alias("stdout"),
        F.when(s % 6 == 0, F.lit("connection timed out")).otherwise(F.lit("")).alias("stderr"),
    )


def ping_output(spark: SparkSession, sf: str) -> DataFrame:
    s, t = F.col("target_seq"), F.trim(F.col("target"))
    stdout = F.when(s % 5 == 0, F.lit("4 packets transmitted, 0 received")).otherwise(
        F.concat(F.lit("rtt min/avg/max/mdev = 1."), _s(s % 100), F.lit("/2.5/3.75/0.125 ms")))
    return targets(spark, sf).select(
        s, t.alias("target"), F.when(s % 6 == 0, F.lit(1)).otherwise(F.lit(0)).alias("returncode"),
        stdout.alias("stdout"), F.lit("").alias("stderr"))


def curl_output(spark: SparkSession, sf: str) -> DataFrame:
    s, t = F.col("target_seq"), F.trim(F.col("target"))
    stdout = F.when(s % 5 == 0, F.lit("200")).otherwise(F.concat(F.lit("200,0."), _s(s % 1000), F.lit("\n")))
    return targets(spark, sf).select(
        s, t.alias("target"), F.when(s % 6 == 0, F.lit(28)).otherwise(F.lit(0)).alias("returncode"),
        stdout.alias("stdout"), F.lit("").alias("stderr"))


def whois_pages(spark: SparkSession, sf: str, both_zones: bool = False) -> DataFrame:
    """Registry search-result pages. ``both_zones`` adds each root again under the other zone."""
    k = F.col("s_suppkey")
    html = F.when(k % 7 == 0, F.lit("<html><p>sin tabla</p></html>")).otherwise(F.concat(
        F.lit("<html><table><tr><th>Nombre de dominio</th><th>Estado</th></tr><tr><td> root"), _s(k),
        F.lit('.com.bo </td><td><a href="revisar_contacto.php?a=1&amp;id='), _s(k),
        F.lit('">Registrado</a></td></tr><tr><td>root'), _s(k),
        F.lit(".edu.bo</td><td>Disponible &ndash; s&iacute;&#33;</td><td>280 Bs</td></tr></table></html>")))
    zone = F.when(k % 2 == 0, F.lit(".bo")).otherwise(F.lit(".ia.bo"))
    pages = table(spark, sf, "supplier").select(
        k.alias("page_id"), F.concat(F.lit("root"), _s(k)).alias("root"), zone.alias("zone"), html.alias("html"))
    if both_zones:
        swapped = pages.select(
            "page_id", "root",
            F.when(F.col("zone") == ".bo", F.lit(".ia.bo")).otherwise(F.lit(".bo")).alias("zone"), "html")
        pages = pages.unionByName(swapped)
    return pages


def whois_details(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("page_id"),
        F.concat(F.lit("https://nic.bo/revisar_contacto.php?a=1&id="), _s(k)).alias("url"),
        F.concat(F.lit("<table><tr><td>Titular :</td><td>"), F.col("s_name"),
                 F.lit("</td></tr><tr><th>Contacto</th></tr><tr><td>Ciudad:</td><td>La Paz</td></tr>"
                       "<tr><td>Ciudad:</td><td>Oruro</td></tr><tr><td>Tel_Casa</td><td>1</td></tr>"
                       "<tr><th>Contacto_Tel</th></tr><tr><td>Casa</td><td>&aacute;2</td></tr></table>")).alias("html"),
    )


def whois_errors(pages: DataFrame, every: int, at: int) -> DataFrame:
    """Stored pages, some of which could not be fetched."""
    k = F.col("page_id")
    return pages.withColumn("error", F.when(k % every == at, F.concat(F.lit("503 Server Error for page "), _s(k))))


def crtsh_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Domains given to the certificate-search tool (duplicates, padding and blanks kept)."""
    k = F.col("s_suppkey")
    base = F.when(k > 28, F.concat(_s(k), F.lit("."), _pick(k % 7, NAME_BASES))).otherwise(_pick(k % 7, NAME_BASES))
    t = F.when(k % 13 == 0, F.lit("  ")).when(k % 5 == 0, F.concat(F.lit(" "), base, F.lit(" "))).otherwise(base)
    return table(spark, sf, "supplier").select(k.alias("target_seq"), t.alias("target"))


def crtsh_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Stored search answers: lists (their entries are the certificate entries), errors, other text, an object, none."""
    s = F.col("target_seq")
    k = s % 10
    body = (F.when(k == 9, F.lit("busy")).when(k == 8, F.lit("not json")).when(k == 7, F.lit('{"message":"x"}')).otherwise(F.lit("[]")))
    return crtsh_targets(spark, sf).where(k != 6).select(
        s, "target", F.when(k == 9, F.lit(503)).otherwise(F.lit(200)).alias("http_status"), body.alias("body"))


def search_table(spark: SparkSession, sf: str) -> DataFrame:
    """A long list of searches of every mode; terms repeat and differ in case."""
    k = F.col("s_suppkey")
    mode = _pick(k % 4, ("identity", "keyword", "subdomain", "extended"))
    term = (F.when(k % 4 == 0, _pick(k % 7, NAME_BASES))
            .when(k % 4 == 1, F.concat(_pick(k % 6, ("www", "MAIL", "api", "dev", "acme.c", "umsa")), F.when(k % 3 == 0, _s(k % 50)).otherwise(F.lit(""))))
            .when(k % 4 == 2, F.concat(_pick(k % 3, ("", "COM.", "example.")), _pick(k % 5, ("com", "bo", "com.bo", "uk", "edu.bo"))))
            .otherwise(F.concat(_pick(k % 6, NAME_PREFIXES), _s(k % 50))))
    return table(spark, sf, "supplier").select(k.cast("int").alias("query_ord"), mode.alias("mode"), term.alias("term"))


def whois_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Registry targets: most have search pages, every third has none."""
    k = F.col("s_suppkey")
    t = F.when(k % 3 == 0, F.concat(F.lit("nada"), _s(k), F.lit(".bo"))).otherwise(
        F.concat(F.lit("root"), _s(k), F.lit(".com.bo")))
    return table(spark, sf, "supplier").select(k.alias("target_seq"), t.alias("target"))


def record_type_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Record-type arguments as typed by users: lower case, padded, unknown, plain."""
    d = dig_output(spark, sf, record_types=True)
    s, rt = F.col("target_seq"), F.col("record_type")
    raw = (F.when(s % 4 == 0, F.lower(rt)).when(s % 4 == 1, F.concat(F.lit(" "), rt, F.lit(" ")))
           .when(s % 4 == 2, F.concat(rt, F.lit("X"))).otherwise(rt))
    return d.select("target_seq", raw.alias("record_type"))


def link_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    """Detail links in the reference forms urljoin resolves (relative, root, scheme-relative,
    absolute, parent) plus links without the detail marker."""
    s = F.col("target_seq")
    k = s % 6
    q = F.concat(F.lit("revisar_contacto.php?id="), _s(s))
    href = (F.when(k == 0, q).when(k == 1, F.concat(F.lit("/"), q)).when(k == 2, F.concat(F.lit("//nic.bo/"), q))
            .when(k == 3, F.concat(F.lit("https://other.bo/"), q)).when(k == 4, F.concat(F.lit("../"), q))
            .otherwise(F.concat(F.lit("?id="), _s(s))))
    return targets(spark, sf).select(s, href.alias("href"))
