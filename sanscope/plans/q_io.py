"""Sources, sinks (the frames they write, in order), set/union keys and the combined report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanscope import constants as K
from sanscope.checks import duckdb_sql as D
from sanscope.operators import certs as C
from sanscope.operators import envelopes as E
from sanscope.operators import ordering, ranking
from sanscope.operators import whois as W
from sanscope.plans import discover as P
from sanscope.plans import q_html, q_lookups
from sanscope.plans.q_certs import (AS_OF, DEDUP, ENTS, HITS, _compose, _names_sql, _run_sql, entries)
from sanscope.plans.registry import register
from sanscope.sinks import writers as S
from sanscope.sources import fixtures as X
from sanscope.sources import readers as RD
from sanscope.sources.tables import table

TS = X.ENVELOPE_TS
CLI_TARGETS = (" cli.example.com ", "AS6568")  # command-line values come first and are not stripped


# ---------------------------------------------------------------- sources
@register("src_cert_entries", _compose(
    "select entry_seq, min_cert_id, id, issuer_ca_id, common_name, name_value, not_before, not_after from cert_entries",
    [], ("cert_entries",)))
def q_src_cert_entries(spark, sf):
    """Stored responses as JSON Lines text, read back with the declared entry schema."""
    lines = X.cert_entries(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    return RD.parse_cert_entries(lines)


@register("src_targets", _compose(
    " union all ".join(f"select 0 as source_ord, {i} as line_ord, '{t}' as target" for i, t in enumerate(CLI_TARGETS))
    + f" union all select 1, target_seq, {D.strip('target')} from targets where {D.strip('target')} <> ''", [], ("targets",)))
def q_src_targets(spark, sf):
    cli = spark.createDataFrame([(0, i, t) for i, t in enumerate(CLI_TARGETS)], "source_ord int, line_ord long, target string")
    lines = X.targets(spark, sf).select(F.col("target_seq").alias("line_no"), "target")
    return cli.unionByName(RD.target_lines(lines).select(F.lit(1).alias("source_ord"), "line_ord", "target"))


@register("src_domains_csv", _compose(
    f"select target_seq, {D.strip('target')} as dominio from targets where {D.strip('target')} <> ''", [], ("targets",)))
def q_src_domains_csv(spark, sf):
    """The target list rendered as quoted CSV lines, parsed back with the CSV reader rules."""
    lines = X.targets(spark, sf).select(
        "target_seq", F.concat(F.lit('"'), F.replace(F.col("target"), F.lit('"'), F.lit('""')), F.lit('"')).alias("line"))
    return RD.domains_from_csv_lines(lines)


SEEN_LINES_SQL = ("seen_lines as (select case when o_orderkey % 3 = 0 then '  ' || cast(o_orderkey as varchar) || ' ' "
                  "when o_orderkey % 3 = 1 then cast(o_orderkey as varchar) else '' end as value from orders "
                  "where o_orderkey % 4 = 1 union all select cast(o_orderkey as varchar) from orders where o_orderkey % 8 = 1)")


@register("src_seen_ids", _compose(
    f"select distinct {D.strip('value')} as cert_id from seen_lines where {D.strip('value')} <> ''", [SEEN_LINES_SQL], ()))
def q_src_seen_ids(spark, sf):
    """A saved state file's lines (padded, blank and repeated ids) -> the id set."""
    o = table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    padded = o.where(k % 4 == 1).select(
        F.when(k % 3 == 0, F.concat(F.lit("  "), k.cast("string"), F.lit(" "))).when(k % 3 == 1, k.cast("string"))
        .otherwise(F.lit("")).alias("value"))
    repeated = o.where(k % 8 == 1).select(k.cast("string").alias("value"))
    return RD.seen_from_lines(padded.unionByName(repeated))


@register("src_lookup_snapshot", _compose(
    "select target_seq, http_status, case when json_valid(body) then case json_type(body) when 'OBJECT' then 'object' "
    "when 'ARRAY' then 'array' else 'scalar' end end as body_kind from rank_answers", [], ("rank_answers",)))
def q_src_lookup_snapshot(spark, sf):
    return X.rank_answers(spark, sf).select("target_seq", "http_status", RD.body_kind(F.col("body")).alias("body_kind"))


# ---------------------------------------------------------------- sinks (the ordered frame each one writes)
@register("sink_domains_csv", _compose(
    "select domain, row_number() over (order by domain) - 1 as row_no from (select distinct domain from "
    + _names_sql("run", "query_ord, entry_seq, term") + f" and {D.level('domain')} <= {D.level('term')} + 1) d",
    _run_sql("domain", True), ("query_hits", "seen_ids")))
def q_sink_domains_csv(spark, sf):
    domains = P.discover_domains(spark, entries(spark, sf), X.QUERIES, X.seen_ids(spark, sf), levels=1)
    return ordering.order_number(domains, ["domain"], "row_no")


@register("sink_analysis_csv", _compose(
    "select domain, " + D.level("domain") + " as level, "
    + D.iso_date("min(" + D.cert_time("not_before") + ")") + " as first_seen, "
    + D.iso_date("max(" + D.cert_time("not_after") + ")") + " as last_seen, "
    + f"case when max({D.cert_time('not_after')}) > timestamp '{AS_OF}' then 'Vigente' else 'Expirado' end as is_active, "
    + "row_number() over (order by domain) - 1 as row_no from " + _names_sql("dd", "not_before, not_after") + " group by domain",
    [ENTS, DEDUP], ("cert_entries",)))
def q_sink_analysis_csv(spark, sf):
    named = C.entry_names(C.dedup_certs(entries(spark, sf)), keep=("not_before", "not_after"))
    return ordering.order_number(C.domain_analysis(named, AS_OF), ["domain"], "row_no")


JSONL_FIELDS = ("min_cert_id", "id", "issuer_ca_id", "common_name", "name_value", "not_before", "not_after")  # the oracle's list


@register("sink_jsonl", _compose(
    "select query_ord, entry_seq, cast(to_json({" + ", ".join(f"'{f}': {f}" for f in JSONL_FIELDS) + "}) as varchar) as line "
    "from hits where kind = 'domain'", [HITS], ("query_hits",)))
def q_sink_jsonl(spark, sf):
    log = P.certificate_log(entries(spark, sf), X.QUERIES, kinds=("domain",))
    whole = [c for c in log.columns if c not in S.RUN_COLUMNS]
    return log.select("query_ord", "entry_seq", F.to_json(F.struct(*whole), {"ignoreNullFields": "false"}).alias("line"))


@register("sink_seen_ids", _compose(
    "select cert_id, row_number() over (order by cert_id) - 1 as row_no from (select cert_id from seen_ids union "
    "select cast(cert_id as varchar) from hits where kind = 'domain' and cert_id is not null) s",
    [HITS], ("query_hits", "seen_ids")))
def q_sink_seen_ids(spark, sf):
    """State after a ``-d ... --uncached`` run: saved ids U ids of every processed certificate,
    in string order (the order the state file is written in)."""
    processed = P.responses(entries(spark, sf), X.QUERIES, "domain").where(F.col("cert_id").isNotNull())
    merged = S.new_state(X.seen_ids(spark, sf), processed.select(F.col("cert_id").cast("string").alias("cert_id")))
    return ordering.order_number(merged, ["cert_id"], "row_no")


RESULT_TOOLS = (
    (q_lookups.DIG_BODY, ("dig_record_name", "dig_ttl", "dig_class", "dig_type", "dig_value")),
    (q_lookups.PING_BODY, ("ping_avg", "ping_max", "ping_min", "ping_mdev")),
    (q_lookups.CURL_BODY, ("curl_http_code", "curl_latency_seconds")),
)


def _results_sql() -> str:
    own = [c for _, cols in RESULT_TOOLS for c in cols]
    return " union all ".join(
        "select " + ", ".join([*K.ENVELOPE_COLUMNS, *[c if c in cols else f"null as {c}" for c in own]]) + f" from ({body}) t{i}"
        for i, (body, cols) in enumerate(RESULT_TOOLS))


@register("sink_results_csv", _compose(_results_sql(), [], ("targets", "dig_output", "ping_output", "curl_output")))
def q_sink_results_csv(spark, sf):
    """The rows of the results CSV for dig, ping and curl written together, under the union
    of their keys in first-appearance order."""
    t = X.targets(spark, sf)
    return S.results_rows([E.envelope_dig(t, X.dig_output(spark, sf), TS), E.envelope_ping(t, X.ping_output(spark, sf), TS),
                           E.envelope_curl(t, X.curl_output(spark, sf), TS)])


RANK_KEYS = ("domain", "error", "known", "nested", "page_rank_decimal", "page_rank_integer", "rank")
RANK_CTES = [
    q_lookups.ELEMENTS_SQL,
    # the first stored answer of a domain text; a listed domain has all its elements, as often as it is listed
    "answers as (select target_seq, target from rank_answers where http_status = 200 qualify row_number() over (partition by target order by target_seq) = 1)",
    f"asked as (select t.target_seq as asked_seq, a.target_seq from targets t join answers a on a.target = {D.strip('t.target')} "
    f"where {D.strip('t.target')} <> '')"]
RANK_SQL = ("select " + ", ".join(f"max(case when f.key = '{k}' then f.value end) as {k}" for k in RANK_KEYS)
            + " from asked q join elems e on e.target_seq = q.target_seq left join fields f on f.target_seq = e.target_seq and f.elem_pos = e.elem_pos "
              "group by q.asked_seq, e.elem_pos")


@register("sink_rows_sorted_header", _compose(RANK_SQL, RANK_CTES, ("targets", "rank_answers")))
def q_sink_rows_sorted_header(spark, sf):
    """The exported rank rows under the sorted union of the response keys."""
    return S.sorted_header_rows(rank_rows(spark, sf))


# ---------------------------------------------------------------- ordering / batches / sets
@register("sort_domains", _compose(
    "select domain, row_number() over (order by domain) - 1 as sort_pos from (select distinct domain from "
    + _names_sql("dd", "entry_seq") + ") d", [ENTS, DEDUP], ("cert_entries",)))
def q_sort_domains(spark, sf):
    domains = C.distinct_domains(C.entry_names(C.dedup_certs(entries(spark, sf)), keep=("entry_seq",)))
    return ordering.order_number(domains, ["domain"], "sort_pos")


@register("batch_targets", _compose(
    f"select target_seq, dominio, (row_number() over (order by target_seq) - 1) // {K.DEFAULT_RANK_BATCH} as batch_no from "
    f"(select target_seq, {D.strip('target')} as dominio from targets where {D.strip('target')} <> '') d", [], ("targets",)))
def q_batch_targets(spark, sf):
    domains = q_src_domains_csv(spark, sf)
    return ranking.batch_targets(domains, K.DEFAULT_RANK_BATCH)


def rank_rows(spark, sf) -> DataFrame:
    """Domains CSV -> batches of 250 -> stored rank answers by domain text -> every response element, one
    row each, columns = element keys."""
    return E.widen(ranking.rank_rows(q_src_domains_csv(spark, sf), X.rank_answers(spark, sf), K.DEFAULT_RANK_BATCH), "_flat")


@register("rank_targets", _compose(RANK_SQL, RANK_CTES, ("targets", "rank_answers")))
def q_rank_targets(spark, sf):
    return rank_rows(spark, sf).drop(*S.RUN_COLUMNS)


UNION_COLS = ("target_seq", "action", "ok", "status", "ping_avg", "ping_max", "ping_min", "ping_mdev", "curl_http_code",
              "curl_latency_seconds")


@register("union_by_name", _compose(
    "select target_seq, action, ok, status, ping_avg, ping_max, ping_min, ping_mdev, null as curl_http_code, "
    "null as curl_latency_seconds from (" + q_lookups.PING_BODY + ") p union all "
    "select target_seq, action, ok, status, null, null, null, null, curl_http_code, curl_latency_seconds from ("
    + q_lookups.CURL_BODY + ") c", [], ("targets", "ping_output", "curl_output")))
def q_union_by_name(spark, sf):
    t = X.targets(spark, sf)
    ping = E.envelope_ping(t, X.ping_output(spark, sf), TS).drop("timestamp", "target", "error")
    curl = E.envelope_curl(t, X.curl_output(spark, sf), TS).drop("timestamp", "target", "error")
    return S.union_by_name([ping, curl]).select(*UNION_COLS)


# ---------------------------------------------------------------- certificate name choice on decoded certificates
DECODED_SQL = (
    "sans as (select l_orderkey as cert_id, l_linenumber as pos, case when l_orderkey % 11 = 0 or l_partkey % 5 = 0 "
    "then 'IP Address' else 'DNS' end as san_type, name as value from name_rows),\n"
    "subj as (select l_orderkey as cert_id, case when l_orderkey % 13 = 0 then 'Bad Name!' else max(host) end as cn "
    "from name_rows group by l_orderkey)")


@register("san_or_cn", _compose(
    "select cert_id, domain from (select cert_id, " + D.normalize("value") + " as domain from sans where san_type = 'DNS') a "
    "where domain is not null union all select s.cert_id, " + D.normalize("s.cn") + " from subj s where "
    + D.normalize("s.cn") + " is not null and not exists (select 1 from sans x where x.cert_id = s.cert_id and x.san_type = 'DNS' and "
    + D.normalize("x.value") + " is not null)", [DECODED_SQL], ("name_rows",)))
def q_san_or_cn(spark, sf):
    from sanscope.operators.decoded import decoded_certificates, san_or_cn

    sans, subjects = decoded_certificates(spark, sf)
    return san_or_cn(sans, subjects)


# ---------------------------------------------------------------- combined report
ALL_ENVELOPES = (
    ("crtsh", q_lookups.CRT_BODY, ("crt_subdomain", "crt_raw_data")),
    ("dig", q_lookups.DIG_BODY, ("dig_record_name", "dig_ttl", "dig_class", "dig_type", "dig_value")),
    ("dnslookup", q_lookups._raw_tool_sql("dnslookup", "dig_output"), ("raw_output",)),
    ("ping", q_lookups.PING_BODY, ("ping_avg", "ping_max", "ping_min", "ping_mdev")),
    ("traceroute", q_lookups._raw_tool_sql("traceroute", "dig_output"), ("raw_output",)),
    ("curl", q_lookups.CURL_BODY, ("curl_http_code", "curl_latency_seconds")),
    ("ipguide", q_lookups.IPG_BODY, ("ipg_raw_data",) + q_lookups.IPG_KEYS),
    ("open_rank", q_lookups.OPR_BODY, ("opr_raw_data",) + q_lookups.OPR_KEYS),
    ("whois", None, q_html.WHOIS_KEYS),
)


def _report_sql() -> str:
    extra: list[str] = []
    for _, _, cols in ALL_ENVELOPES:
        extra += [c for c in cols if c not in extra]
    parts = []
    for name, body, cols in ALL_ENVELOPES:
        if body is None:
            body = q_html.ENVELOPE_WHOIS_BODY
        sel = ", ".join(["target_seq"] + list(K.ENVELOPE_COLUMNS) + [c if c in cols else f"null as {c}" for c in extra])
        parts.append(f"select {sel} from ({body}) {name}_x")
    ctes = [q_lookups.CRT_CTE, q_html.ENV_SQL, q_html.CATS_SQL]
    fixtures = ("crtsh_targets", "crtsh_answers", "cert_entries", "targets", "dig_output", "ping_output", "curl_output", "network_payloads",
                "rank_payloads", "whois_targets", "whois_pages_both", "whois_details")
    return _compose(" union all ".join(parts), ctes, fixtures)


@register("all_tools_report", _report_sql())
def q_all_tools_report(spark, sf):
    """Every tool's rows in one table (same six leading columns, tool columns side by side)."""
    t = X.targets(spark, sf)
    frames = [
        E.envelope_crtsh(X.crtsh_targets(spark, sf), X.cert_entries(spark, sf), TS, X.crtsh_answers(spark, sf)),
        E.envelope_dig(t, X.dig_output(spark, sf), TS),
        E.envelope_dnslookup(t, X.dig_output(spark, sf), TS),
        E.envelope_ping(t, X.ping_output(spark, sf), TS),
        E.envelope_traceroute(t, X.dig_output(spark, sf), TS),
        E.envelope_curl(t, X.curl_output(spark, sf), TS),
        E.envelope_ipguide(t, X.network_payloads(spark, sf), TS),
        E.envelope_open_rank(t, X.rank_payloads(spark, sf), TS),
        W.envelope_whois(*q_html.envelope_inputs(spark, sf), TS),
    ]
    return S.union_by_name(frames)
