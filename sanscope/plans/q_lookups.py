"""Toolkit queries: target checks, stored-output parsers, JSON flattening, enrichments
and the per-tool result envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sanscope import constants as K
from sanscope.checks import duckdb_sql as D
from sanscope.functions import jsonflat as J
from sanscope.functions import names as N
from sanscope.functions import parsers as PR
from sanscope.functions import targets as T
from sanscope.operators import envelopes as E
from sanscope.operators import network as NET
from sanscope.operators import ranking as R
from sanscope.plans.q_certs import _compose
from sanscope.plans.registry import register
from sanscope.sources import fixtures as X

TS = X.ENVELOPE_TS


def _env_head(action: str, ok: str, status: str, error: str, tseq: str = "target_seq", target: str = "target") -> str:
    return (f"{tseq} as target_seq, '{TS}' as timestamp, '{action}' as action, {target} as target, {ok} as ok, "
            f"{status} as status, {error} as error")


# ---------------------------------------------------------------- scalars
@register("validate_target", _compose(
    f"select target_seq, {D.strip('target')} as value, {D.target_class('target')} is not null as ok, "
    f"{D.target_class('target')} as target_class, {D.target_error('target')} as error from targets", [], ("targets",)))
def q_validate_target(spark, sf):
    return X.targets(spark, sf).select("target_seq", T.validate_target("target").alias("v")).select("target_seq", "v.*")


@register("record_type_ok", _compose(
    f"select target_seq, record_type, upper({D.strip('record_type')}) in "
    f"({', '.join(repr(t) for t in K.ALLOWED_DNS_TYPES)}) as ok from record_type_inputs", [], ("record_type_inputs",)))
def q_record_type_ok(spark, sf):
    return X.record_type_inputs(spark, sf).select("target_seq", "record_type", T.record_type_ok("record_type").alias("ok"))


@register("root_label", _compose(
    "select target_seq, target, string_split(replace(target, '.bo', ''), '.')[1] as root from whois_targets",
    [], ("whois_targets",)))
def q_root_label(spark, sf):
    return X.whois_targets(spark, sf).select("target_seq", "target", N.root_label("target").alias("root"))


@register("target_url", _compose(
    "select target_seq, case when starts_with(target, 'http') then target else 'http://' || target end as url from targets",
    [], ("targets",)))
def q_target_url(spark, sf):
    return X.targets(spark, sf).select("target_seq", T.target_url("target").alias("url"))


@register("resolve_link", _compose(
    "select target_seq, href, case when starts_with(href, '//') then 'https:' || href "
    "when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when starts_with(href, '/') then 'https://nic.bo' || href "
    "when starts_with(href, '../') then 'https://nic.bo/' || substr(href, 4) else 'https://nic.bo/' || href end as url "
    f"from link_hrefs where contains(href, '{K.WHOIS_DETAIL_MARKER}')", [], ("link_hrefs",)))
def q_resolve_link(spark, sf):
    h = X.link_hrefs(spark, sf).where(F.col("href").contains(K.WHOIS_DETAIL_MARKER))
    return h.select("target_seq", "href", T.resolve_link(K.WHOIS_BASE_URL, F.col("href")).alias("url"))


DIG_ANS_SQL = ("select target_seq, unnest(list_transform(range(len(ans)), lambda i: cast(i as int))) as ans_pos, unnest(ans) as t from "
               f"(select target_seq, {D.dig_answers('stdout')} as ans from dig_output) z")


@register("parse_dig_answer", _compose(
    "select target_seq, ans_pos, t[1] as record_name, t[2] as ttl, t[3] as class, t[4] as type, "
    f"array_to_string(t[5:], ' ') as value from ({DIG_ANS_SQL}) y", [], ("dig_output",)))
def q_parse_dig_answer(spark, sf):
    d = X.dig_output(spark, sf).select("target_seq", F.posexplode(PR.parse_dig_answer("stdout")).alias("ans_pos", "a"))
    return d.select("target_seq", "ans_pos", "a.*")


PING_SQL_RE = PR.PING_RTT_RE


@register("parse_ping_rtt", _compose(
    "select target_seq, " + ", ".join(
        f"case when regexp_matches(stdout, '{PING_SQL_RE}') then regexp_extract(stdout, '{PING_SQL_RE}', {i}) end as {c}"
        for i, c in enumerate(("ping_min", "ping_avg", "ping_max", "ping_mdev"), start=1)) + " from ping_output",
    [], ("ping_output",)))
def q_parse_ping_rtt(spark, sf):
    p = X.ping_output(spark, sf).select("target_seq", PR.parse_ping_rtt("stdout").alias("r"))
    return p.select("target_seq", "r.ping_min", "r.ping_avg", "r.ping_max", "r.ping_mdev")


@register("parse_curl_metrics", _compose(
    "select target_seq, len(p) = 2 as ok, case when len(p) = 2 then p[1] end as curl_http_code, "
    "case when len(p) = 2 then p[2] end as curl_latency_seconds from "
    f"(select target_seq, string_split({D.strip('stdout')}, ',') as p from curl_output) z", [], ("curl_output",)))
def q_parse_curl_metrics(spark, sf):
    c = X.curl_output(spark, sf).select("target_seq", PR.parse_curl_metrics("stdout").alias("m"))
    return c.select("target_seq", "m.ok", "m.curl_http_code", "m.curl_latency_seconds")


# ---------------------------------------------------------------- JSON
def _tree_sql(body: str, prefix: str, src: str, where: str) -> str:
    """json_tree leaves -> (target_seq, key, value) with the reference's path naming."""
    path = "regexp_replace(regexp_replace(substr(fullkey, 3), '\\[([0-9]+)\\]', '.\\1', 'g'), '\\.', '_', 'g')"
    val = ("case when type = 'NULL' then null when type = 'BOOLEAN' then case when value::varchar = 'true' then 'True' "
           "else 'False' end when type = 'VARCHAR' then json_extract_string(value, '$') else value::varchar end")
    # of a repeated path the last leaf counts
    return (f"select target_seq, key, value from (select s.target_seq, jt.id as leaf, '{prefix}' || {path} as key, {val} as value "
            f"from (select * from {src} where {where}) s, json_tree(s.{body}) jt where jt.type not in ('OBJECT', 'ARRAY')) leaves "
            "qualify row_number() over (partition by target_seq, key order by leaf desc) = 1")


OBJ_BODY = (f"(starts_with({D.strip('body')}, '{{') and coalesce(case when json_valid(body) then json_type(body) = 'OBJECT' end, "
            "false))")


@register("flatten_json", _compose(_tree_sql("body", K.PREFIX_IPG, "json_payloads", OBJ_BODY), [], ("json_payloads",)))
def q_flatten_json(spark, sf):
    p = X.json_payloads(spark, sf).select("target_seq", J.parsed("body", K.PREFIX_IPG).alias("_p"))
    return J.explode_kv(p.select("target_seq", F.col("_p.flat").alias("_flat")), "_flat", ["target_seq"])


@register("json_or_raw", _compose(
    "select * from (" + _tree_sql("body", K.PREFIX_IPG, "json_payloads", OBJ_BODY)
    + f") t union all select target_seq, 'ipg_raw_data' as key, body as value from json_payloads where not ({OBJ_BODY})",
    [], ("json_payloads",)))
def q_json_or_raw(spark, sf):
    p = X.json_payloads(spark, sf).select("target_seq", "body", J.parsed("body", K.PREFIX_IPG).alias("_p"))
    raw = F.array(F.struct(F.lit("ipg_raw_data").alias("key"), F.col("body").alias("value")))
    flat = p.select("target_seq", F.when(F.col("_p.found"), F.col("_p.flat")).otherwise(raw).alias("_flat"))
    return J.explode_kv(flat, "_flat", ["target_seq"])


@register("results_key_catalogue", _compose(
    "select key, count(*) as rows, min(target_seq) as first_seq from (" + _tree_sql("body", K.PREFIX_IPG, "json_payloads", OBJ_BODY) + ") t group by key",
    [], ("json_payloads",)))
def q_results_key_catalogue(spark, sf):
    """The keys of flattened answers as a table, in place of a column for each."""
    p = X.json_payloads(spark, sf).select("target_seq", J.parsed("body", K.PREFIX_IPG).alias("_p"))
    return E.key_catalogue(E.as_fields(p.select("target_seq", F.col("_p.flat").alias("_flat")), "_flat"))


@register("first_response", _compose(
    _tree_sql("elem", K.PREFIX_OPR, "(select target_seq, json_extract(body, '$.response[0]') as elem from rank_answers "
              "where case when json_valid(body) then json_array_length(json_extract(body, '$.response')) > 0 else false end)", "true"),
    [], ("rank_answers",)))
def q_first_response(spark, sf):
    p = X.rank_answers(spark, sf).select("target_seq", J.parsed("body", K.PREFIX_OPR, response=True).alias("_p"))
    return J.explode_kv(p.select("target_seq", F.col("_p.flat").alias("_flat")), "_flat", ["target_seq"])


#: Text of a JSON value as the original prints it; nested ones in the fixture hold no text.
PRINTED_SQL = ("case json_type({v}) when 'NULL' then null when 'VARCHAR' then json_extract_string({v}, '$') when 'BOOLEAN' then "
               "upper(substr(({v})::varchar, 1, 1)) || substr(({v})::varchar, 2) when 'OBJECT' then "
               "replace(replace(replace(({v})::varchar, chr(34), chr(39)), ':', ': '), ',', ', ') else ({v})::varchar end")
ELEMENTS_SQL = (
    "elems as (select *, unnest(list_transform(range(cast(json_array_length(r) as bigint)), lambda i: cast(i as int))) as elem_pos, unnest(json_extract(r, '$[*]')) as e "
    "from (select target_seq, target, http_status, json_extract(body, '$.response') as r from rank_answers where json_valid(body)) z),\n"
    # of a repeated key the last one counts
    "fields as (select target_seq, target, http_status, elem_pos, k.key as key, " + PRINTED_SQL.format(v="k.value")
    + " as value from elems, json_each(e) k qualify row_number() over (partition by target_seq, elem_pos, k.key order by k.id desc) = 1)")


@register("explode_response", _compose("select target_seq, elem_pos, key, value from fields", [ELEMENTS_SQL], ("rank_answers",)))
def q_explode_response(spark, sf):
    ex = R.explode_response(X.rank_answers(spark, sf))
    return J.explode_kv(ex, "_flat", ["target_seq", "elem_pos"])


# ---------------------------------------------------------------- joins
def _first_sql(table: str, keys: str = "target") -> str:
    return f"(select * from {table} qualify row_number() over (partition by {keys} order by target_seq) = 1)"


@register("enrich_rank", _compose(
    "select t.target_seq, trim(t.target) as target, r.http_status, "
    "case when json_valid(r.body) then json_extract_string(r.body, '$.response[0].page_rank_integer') end as page_rank_integer, "
    "case when json_valid(r.body) then json_extract_string(r.body, '$.response[0].rank') end as rank "
    "from targets t left join " + _first_sql("rank_payloads") + " r on r.target = trim(t.target)", [], ("targets", "rank_payloads")))
def q_enrich_rank(spark, sf):
    j = R.enrich_rank(X.targets(spark, sf), X.rank_payloads(spark, sf))
    first = F.map_from_entries(J.parsed("body", "", response=True)["flat"])
    return j.select("target_seq", "target", "http_status", first.alias("_first")).select(
        "target_seq", "target", "http_status", F.col("_first")["page_rank_integer"].alias("page_rank_integer"), F.col("_first")["rank"].alias("rank"))


def _bits_sql(a: str) -> str:
    """Address text -> its bits as text (32 or 128 characters)."""
    v4 = f"array_to_string(list_transform(string_split({a}, '.'), lambda x: lpad(bin(cast(x as int)), 8, '0')), '')"
    # a dotted tail becomes two groups; the groups left and right of '::' are filled up with zeros
    q = f"string_split(regexp_extract({a}, '([0-9.]+)$', 1), '.')"
    e = (f"case when contains({a}, '.') then regexp_extract({a}, '^(.*:)', 1) || to_hex(cast({q}[1] as int) * 256 + cast({q}[2] as int)) "
         f"|| ':' || to_hex(cast({q}[3] as int) * 256 + cast({q}[4] as int)) else {a} end")
    left = f"list_filter(string_split(split_part({e}, '::', 1), ':'), lambda x: x <> '')"
    right = f"list_filter(string_split(split_part({e}, '::', 2), ':'), lambda x: x <> '')"
    groups = f"list_concat({left}, list_transform(range(8 - len({left}) - len({right})), lambda i: '0'), {right})"
    v6 = f"array_to_string(list_transform({groups}, lambda g: lpad(bin(cast('0x' || g as int)), 16, '0')), '')"
    return f"case when contains({a}, ':') then {v6} when regexp_full_match({a}, '{D.IPV4_RE}') then {v4} end"


def _block_sql(text: str) -> str:
    """(bits of the prefix) of an address or block; null where the length is too large."""
    return (f"(select case when len(s) = 1 then b when cast(s[2] as int) <= length(b) then b[1:cast(s[2] as int)] end from "
            f"(select s, {_bits_sql('s[1]')} as b from (select string_split({text}, '/') as s) z1) z2)")


NET_SQL = [
    f"nb as (select net_id, cidr, asn, contains(cidr, ':') as six, {_block_sql('trim(cidr)')} as p from network_blocks)",
    "ha as (select lower(host) as host, arg_min(address, ans_pos) as address from host_addresses group by all)",
    f"""nt as (select *, case when kind = 'host' then address when kind in ('ip', 'cidr') then ip end as goal from (
  select target_seq, {D.strip("target")} as ip, h.address, case when regexp_matches(ip, '^AS[0-9]+$') then 'asn'
    when ip = '1.2.3.4/33' or contains(ip, 'bad-') then null when contains(ip, '/') then 'cidr'
    when regexp_matches(ip, '^[0-9.]+$') or contains(ip, ':') then 'ip' else 'host' end as kind
  from network_targets left join ha h on h.host = lower({D.strip("target")})) z)""",
    f"ng as (select target_seq, contains(goal, ':') as six, {_block_sql('goal')} as p from nt where goal is not null)",
    "best as (select g.target_seq, nb.* from ng g join nb on nb.six = g.six and starts_with(g.p, nb.p) "
    "qualify row_number() over (partition by g.target_seq order by length(nb.p) desc, net_id, cidr, asn) = 1 "
    "union all select t.target_seq, nb.* from nt t join nb on t.kind = 'asn' and cast(substr(t.ip, 3) as bigint) = nb.asn "
    "qualify row_number() over (partition by t.target_seq order by nb.six, rpad(nb.p, 128, '0'), length(nb.p), net_id) = 1)"]


@register("enrich_network", _compose(
    "select nt.target_seq, nt.ip, nt.kind, best.net_id, best.cidr, best.asn from nt left join best on best.target_seq = nt.target_seq",
    NET_SQL, ("network_targets", "network_blocks", "host_addresses")))
def q_enrich_network(spark, sf):
    """Addresses of both families, CIDR blocks, ASNs and hosts (by their stored addresses) -> network block."""
    return NET.enrich_network(X.network_targets(spark, sf), X.network_blocks(spark, sf), addresses=X.host_addresses(spark, sf))


@register("enrich_dns", _compose(
    "select target_seq, record_type, ans_pos, t[1] as record_name, t[2] as ttl, t[3] as class, t[4] as type, "
    "array_to_string(t[5:], ' ') as value from (select target_seq, record_type, "
    "unnest(case when len(ans) > 0 then list_transform(range(len(ans)), lambda i: cast(i as int)) else [null] end) as ans_pos, "
    "unnest(case when len(ans) > 0 then ans else [null] end) as t from "
    f"(select t.target_seq, d.record_type, case when d.returncode = 0 then {D.dig_answers('d.stdout')} else [] end as ans "
    "from targets t left join " + _first_sql("dig_output_types", "target, record_type") + " d on d.target = trim(t.target)) z) y",
    [], ("targets", "dig_output_types")))
def q_enrich_dns(spark, sf):
    """Targets with the first stored answer of each record type, joined by target text."""
    t = X.targets(spark, sf).select("target_seq", N.py_strip("target").alias("target"))
    d = R.first_answers(X.dig_output(spark, sf, record_types=True), ("target", "record_type"))
    j = t.join(d.select("target", "record_type", "returncode", "stdout"), "target", "left")
    ans = F.when(F.col("returncode") == 0, PR.parse_dig_answer("stdout")).otherwise(
        F.array().cast("array<struct<record_name:string,ttl:string,class:string,type:string,value:string>>"))
    ex = j.select("target_seq", "record_type", F.posexplode_outer(ans).alias("ans_pos", "a"))
    return ex.select("target_seq", "record_type", "ans_pos", "a.*")


@register("enrich_probe", _compose(
    "select t.target_seq, case when regexp_matches(p.stdout, '" + PING_SQL_RE + "') and p.returncode = 0 then regexp_extract(p.stdout, '"
    + PING_SQL_RE + "', 2) end as ping_avg, case when c.returncode = 0 and len(string_split(" + D.strip("c.stdout")
    + ", ',')) = 2 then string_split(" + D.strip("c.stdout") + ", ',')[1] end as curl_http_code, "
    "case when r.returncode = 0 then " + D.strip("r.stdout") + " else " + D.strip("r.stderr") + " end as trace_output "
    "from targets t left join " + _first_sql("ping_output") + " p on p.target = trim(t.target) left join " + _first_sql("curl_output")
    + " c on c.target = trim(t.target) left join " + _first_sql("dig_output") + " r on r.target = trim(t.target)",
    [], ("targets", "ping_output", "curl_output", "dig_output")))
def q_enrich_probe(spark, sf):
    """One row per target with the parsed ping, curl and traceroute outputs (three left joins
    on the target text, each to the first stored answer)."""
    t = X.targets(spark, sf).select("target_seq", N.py_strip("target").alias("target"))
    p = R.first_answers(X.ping_output(spark, sf)).select("target", F.col("returncode").alias("p_rc"), F.col("stdout").alias("p_out"))
    c = R.first_answers(X.curl_output(spark, sf)).select("target", F.col("returncode").alias("c_rc"), F.col("stdout").alias("c_out"))
    r = R.first_answers(X.dig_output(spark, sf)).select("target", F.col("returncode").alias("r_rc"), F.col("stdout").alias("r_out"),
                                                        F.col("stderr").alias("r_err"))
    j = t.join(p, "target", "left").join(c, "target", "left").join(r, "target", "left")
    rtt = PR.parse_ping_rtt("p_out")
    cm = PR.parse_curl_metrics("c_out")
    return j.select(
        "target_seq",
        F.when((F.col("p_rc") == 0) & rtt["matched"], rtt["ping_avg"]).alias("ping_avg"),
        F.when((F.col("c_rc") == 0) & cm["ok"], cm["curl_http_code"]).alias("curl_http_code"),
        F.when(F.col("r_rc") == 0, N.py_strip("r_out")).otherwise(N.py_strip("r_err")).alias("trace_output"))


# ---------------------------------------------------------------- aggregates over lookups
@register("records_by_type", _compose(
    "select target_seq, type_ord, record_type, n_records, records from ("
    "select target_seq, list_position(['A','AAAA','CNAME','MX','NS','TXT','SOA'], t[4]) - 1 as type_ord, t[4] as record_type, "
    "count(*) as n_records, string_agg(array_to_string(t[5:], ' '), chr(10) order by array_to_string(t[5:], ' ')) as records "
    f"from (select target_seq, unnest({D.dig_answers('stdout')}) as t from dig_output_types where returncode = 0) z "
    "where t[4] in ('A','AAAA','CNAME','MX','NS','TXT','SOA') group by target_seq, t[4]) a "
    f"union all select target_seq, null, null, 0, '{K.MSG_NO_COMMON_RECORDS}' from dig_output_types d where not exists "
    f"(select 1 from (select target_seq, unnest({D.dig_answers('stdout')}) as t from dig_output_types where returncode = 0) z "
    "where z.target_seq = d.target_seq and t[4] in ('A','AAAA','CNAME','MX','NS','TXT','SOA'))",
    [], ("dig_output_types",)))
def q_records_by_type(spark, sf):
    from sanscope.operators import dns

    return dns.records_by_type(X.dig_output(spark, sf, record_types=True))


@register("subdomains_per_target", _compose(
    "select t.target_seq, t.target, s.name from crtsh_targets t left join (select distinct h.target, n.name from "
    "(select distinct ct.target, cn.entry_seq from (select distinct target, lower(" + D.strip("target") + ") as q from crtsh_targets "
    "where " + D.strip("target") + " <> '') ct join cn on ends_with(cn.name, '.' || ct.q)) h join cn n on n.entry_seq = h.entry_seq) s "
    "on s.target = t.target",
    ["cn as (select entry_seq, name from (select entry_seq, lower(" + D.strip("unnest(string_split(coalesce(name_value, ''), chr(10)))")
     + ") as name from cert_entries) z where name <> '')"], ("crtsh_targets", "cert_entries")))
def q_subdomains_per_target(spark, sf):
    rows = E.envelope_crtsh(X.crtsh_targets(spark, sf), X.cert_entries(spark, sf), TS)
    return rows.select("target_seq", "target", F.col("crt_subdomain").alias("name"))


@register("subdomain_summary", _compose(
    "select t.target_seq, t.target, count(distinct s.name) as crt_unique_subdomains_count from crtsh_targets t "
    "join (select distinct h.target, n.name from "
    "(select distinct ct.target, cn.entry_seq from (select distinct target, lower(" + D.strip("target") + ") as q from crtsh_targets "
    "where " + D.strip("target") + " <> '') ct join cn on ends_with(cn.name, '.' || ct.q)) h join cn n on n.entry_seq = h.entry_seq) s "
    "on s.target = t.target group by t.target_seq, t.target",
    ["cn as (select entry_seq, name from (select entry_seq, lower(" + D.strip("unnest(string_split(coalesce(name_value, ''), chr(10)))")
     + ") as name from cert_entries) z where name <> '')"], ("crtsh_targets", "cert_entries")))
def q_subdomain_summary(spark, sf):
    """Per target: the number of distinct names (the comma-joined list is not built; it
    would put a whole group into one value - the rows are ``subdomains_per_target``)."""
    rows = E.envelope_crtsh(X.crtsh_targets(spark, sf), X.cert_entries(spark, sf), TS)
    named = rows.where(F.col("crt_subdomain").isNotNull())
    return named.groupBy("target_seq", "target").agg(F.count_distinct("crt_subdomain").alias("crt_unique_subdomains_count"))


# ---------------------------------------------------------------- envelopes
CRT_CTE = ("cn as (select entry_seq, name from (select entry_seq, lower(" + D.strip("unnest(string_split(coalesce(name_value, ''), chr(10)))")
           + ") as name from cert_entries) z where name <> '')")
CRT_BODY = (
    "select " + _env_head("crtsh", "t.ok", "case when blank then '' else coalesce(cast(http_status as varchar), '') end",
                          f"case when blank then '{K.MSG_PARAM_TARGET_REQUIRED}' when http_status is null then '' when http_status <> 200 "
                          f"then body when kind is null then '{K.MSG_NOT_JSON}' else '' end", "t.target_seq", "t.target")
    + ", s.name as crt_subdomain, case when t.ok and kind <> 'ARRAY' then body end as crt_raw_data from (select *, not blank and "
    "coalesce(http_status = 200, false) and kind is not null as ok from (select c.target_seq, c.target, " + D.strip("c.target")
    + " = '' as blank, a.http_status, a.body, case when json_valid(a.body) then json_type(a.body) end as kind from crtsh_targets c "
    "left join (select lower(" + D.strip("target") + ") as q, http_status, body from crtsh_answers qualify row_number() over (partition by q "
    "order by target_seq) = 1) a on a.q = lower(" + D.strip("c.target") + ")) z) t "
    "left join (select distinct h.target, n.name from (select distinct ct.target, cn.entry_seq from (select distinct target, lower("
    + D.strip("target") + ") as q from crtsh_targets where " + D.strip("target") + " <> '') ct join cn on ends_with(cn.name, '.' || ct.q)) h "
    "join cn n on n.entry_seq = h.entry_seq) s on s.target = t.target and t.ok and kind = 'ARRAY'")


@register("envelope_crtsh", _compose(CRT_BODY, [CRT_CTE], ("crtsh_targets", "crtsh_answers", "cert_entries")))
def q_envelope_crtsh(spark, sf):
    return E.envelope_crtsh(X.crtsh_targets(spark, sf), X.cert_entries(spark, sf), TS, X.crtsh_answers(spark, sf))


DIG_BODY = (
    "select " + _env_head("dig", "ran and len(ans) > 0", "case when ran then '0' else '1' end",
                          f"case when cls is null then verr when not ran then coalesce(stderr, '') when len(ans) = 0 "
                          f"then '{K.MSG_NO_ANSWERS}' else '' end")
    + ", x[1] as dig_record_name, x[2] as dig_ttl, x[3] as dig_class, x[4] as dig_type, array_to_string(x[5:], ' ') as dig_value "
    "from (select *, unnest(case when ran and len(ans) > 0 then ans else [null] end) as x from "
    f"(select *, case when ran then {D.dig_answers('stdout')} else [] end as ans from "
    "(select *, cls is not null and coalesce(returncode = 0, false) as ran from "
    f"(select t.target_seq, t.target, d.returncode, d.stdout, d.stderr, {D.target_class('t.target')} as cls, "
    f"{D.target_error('t.target')} as verr from targets t left join dig_output d on d.target_seq = t.target_seq) a) b) c) e")


@register("envelope_dig", _compose(DIG_BODY, [], ("targets", "dig_output")))
def q_envelope_dig(spark, sf):
    return E.envelope_dig(X.targets(spark, sf), X.dig_output(spark, sf), TS)


def _raw_tool_sql(action: str, out: str) -> str:
    return (
        "select " + _env_head(action, "ok", "case when cls is not null then coalesce(cast(returncode as varchar), '') else '' end",
                              "coalesce(verr, '')")
        + f", case when cls is null then '' when ok then {D.strip('coalesce(stdout, chr(0))').replace(chr(0), '')} "
        f"else {D.strip('coalesce(stderr, chr(0))').replace(chr(0), '')} end as raw_output from "
        "(select *, cls is not null and coalesce(returncode = 0, false) as ok from "
        f"(select t.target_seq, t.target, d.returncode, d.stdout, d.stderr, {D.target_class('t.target')} as cls, "
        f"{D.target_error('t.target')} as verr from targets t left join {out} d on d.target_seq = t.target_seq) a) b")


@register("envelope_dnslookup", _compose(_raw_tool_sql("dnslookup", "dig_output"), [], ("targets", "dig_output")))
def q_envelope_dnslookup(spark, sf):
    return E.envelope_dnslookup(X.targets(spark, sf), X.dig_output(spark, sf), TS)


@register("envelope_traceroute", _compose(_raw_tool_sql("traceroute", "dig_output"), [], ("targets", "dig_output")))
def q_envelope_traceroute(spark, sf):
    return E.envelope_traceroute(X.targets(spark, sf), X.dig_output(spark, sf), TS)


PING_BODY = (
    "select " + _env_head("ping", "ok", "case when ok then '0' else '1' end",
                          f"case when cls is null then verr when not ran then case when coalesce(stderr, '') <> '' then stderr "
                          f"else '{K.MSG_PING_FAILED}' end when not ok then '{K.MSG_PING_NO_RTT}' else '' end")
    + "".join(f", case when ok then regexp_extract(stdout, '{PING_SQL_RE}', {i}) end as {c}"
              for i, c in ((2, "ping_avg"), (3, "ping_max"), (1, "ping_min"), (4, "ping_mdev")))
    + f" from (select *, ran and coalesce(regexp_matches(stdout, '{PING_SQL_RE}'), false) as ok from "
    "(select *, cls is not null and coalesce(returncode = 0, false) as ran from "
    f"(select t.target_seq, t.target, d.returncode, d.stdout, d.stderr, {D.target_class('t.target')} as cls, "
    f"{D.target_error('t.target')} as verr from targets t left join ping_output d on d.target_seq = t.target_seq) a) b) c")


@register("envelope_ping", _compose(PING_BODY, [], ("targets", "ping_output")))
def q_envelope_ping(spark, sf):
    return E.envelope_ping(X.targets(spark, sf), X.ping_output(spark, sf), TS)


CURL_BODY = (
    "select " + _env_head("curl", "ok", "case when ok then p[1] else '' end",
                          f"case when not ran then coalesce(stderr, '') when not ok then '{K.MSG_CURL_PARSE}' else '' end")
    + ", case when ok then p[1] end as curl_http_code, case when ok then p[2] end as curl_latency_seconds from "
    "(select *, ran and len(p) = 2 as ok from (select *, coalesce(returncode = 0, false) as ran, "
    f"string_split({D.strip('coalesce(stdout, chr(0))').replace(chr(0), '')}, ',') as p from "
    "(select t.target_seq, t.target, d.returncode, d.stdout, d.stderr from targets t left join curl_output d "
    "on d.target_seq = t.target_seq) a) b) c")


@register("envelope_curl", _compose(CURL_BODY, [], ("targets", "curl_output")))
def q_envelope_curl(spark, sf):
    return E.envelope_curl(X.targets(spark, sf), X.curl_output(spark, sf), TS)


IPG_KEYS = ("ipg_ip", "ipg_location_city", "ipg_location_country", "ipg_network_autonomous_system_asn",
            "ipg_network_autonomous_system_tags_0", "ipg_network_autonomous_system_tags_1_k", "ipg_network_cidr")
IPG_PATHS = ("$.ip", "$.location.city", "$.location.country", "$.network.autonomous_system.asn",
             "$.network.autonomous_system.tags[0]", "$.network.autonomous_system.tags[1].k", "$.network.cidr")
IPG_BODY = (
    "select " + _env_head("ipguide", "ok", "case when blank then '' else coalesce(cast(http_status as varchar), '') end",
                          f"case when blank then '{K.MSG_PARAM_TARGET_QUERY_REQUIRED}' when body is not null and not good then body else '' end")
    + ", case when ok and not obj then body end as ipg_raw_data"
    + "".join(f", case when ok and obj then json_extract_string(body, '{p}') end as {k}" for k, p in zip(IPG_KEYS, IPG_PATHS))
    + f" from (select *, not blank and body is not null and good as ok, coalesce({OBJ_BODY}, false) as obj from "
    f"(select t.target_seq, t.target, p.body, p.http_status, coalesce(p.http_status between 200 and 299, false) as good, "
    f"{D.strip('t.target')} = '' as blank from targets t left join network_payloads p on p.target_seq = t.target_seq) a) b")


@register("envelope_ipguide", _compose(IPG_BODY, [], ("targets", "network_payloads")))
def q_envelope_ipguide(spark, sf):
    return E.envelope_ipguide(X.targets(spark, sf), X.network_payloads(spark, sf), TS)


OPR_KEYS = ("opr_domain", "opr_error", "opr_page_rank_integer", "opr_rank")
OPR_BODY = (
    "select " + _env_head("open_rank", "ok", "case when blank then '' else coalesce(cast(http_status as varchar), '') end",
                          f"case when blank then '{K.MSG_PARAM_TARGET_REQUIRED}' when not http_ok then coalesce(body, '') "
                          f"when not parsed then '{K.MSG_NOT_JSON}' else '' end")
    + ", case when ok and not has_first then body end as opr_raw_data"
    + "".join(f", case when ok and has_first then json_extract_string(body, '$.response[0].{k[4:]}') end as {k}" for k in OPR_KEYS)
    + " from (select *, not blank and http_ok and parsed as ok, coalesce(case when parsed then "
    "json_type(json_extract(body, '$.response')) = 'ARRAY' and json_array_length(json_extract(body, '$.response')) > 0 end, false) "
    "as has_first from (select t.target_seq, t.target, r.http_status, r.body, " + D.strip("t.target") + " = '' as blank, "
    "coalesce(r.http_status = 200, false) as http_ok, coalesce(json_valid(r.body), false) as parsed "
    "from targets t left join rank_payloads r on r.target_seq = t.target_seq) a) b")


@register("envelope_open_rank", _compose(OPR_BODY, [], ("targets", "rank_payloads")))
def q_envelope_open_rank(spark, sf):
    return E.envelope_open_rank(X.targets(spark, sf), X.rank_payloads(spark, sf), TS)
