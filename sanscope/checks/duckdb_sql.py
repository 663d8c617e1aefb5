"""DuckDB statements for the correctness oracle.

``FIXTURES`` restates every derived input as a CTE; ``with_fixtures`` prepends the
ones a statement needs (and their dependencies) in order.
"""

from __future__ import annotations

# The oracle's own patterns: white space and line ends as Python's str.strip and str.splitlines see them.
_BLANK = (r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
STRIP_RE = rf"^[{_BLANK}]+|[{_BLANK}]+$"
LINE_SPLIT_RE = r"\r\n|[\x{A}-\x{D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
IPV4_RE = r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"

FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "name_rows": ((), r"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, host,
  case (l_partkey + l_linenumber) % 9 when 0 then '*.' || host when 1 then upper(host) when 2 then ' ' || host || '. '
    when 3 then 'admin@' || host when 4 then '' when 5 then '_dmarc.' || host else host end as name
from (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case l_partkey % 6 when 0 then 'www' when 1 then 'mail' when 2 then 'api' when 3 then 'dev' when 4 then 'a.b' else 'm' end
  || case when l_suppkey % 3 = 0 then '' else cast(l_suppkey % 50 as varchar) end || '.' ||
  case (l_partkey + l_suppkey) % 7 when 0 then 'example.com' when 1 then 'acme.com.bo' when 2 then 'umsa.edu.bo'
    when 3 then 'www.acme.com' when 4 then 'google.co.uk' when 5 then 'shop.example.com' else 'localhost' end as host
  from lineitem) t"""),
    "cert_entries": (("name_rows",), r"""
select o_orderkey * 2 + copy as entry_seq,
  case when o_orderkey % 7 = 0 then 0 when o_orderkey % 3 = 0 then null else o_orderkey end as min_cert_id,
  o_orderkey as id, cast(o_custkey % 25 as int) as issuer_ca_id, common_name, name_value,
  case when o_orderkey % 97 = 0 then 'not-a-date' else replace(cast(o_orderdate as varchar), ' ', 'T')
    || case when o_orderkey % 2 = 0 then 'Z' else '' end end as not_before,
  replace(cast(o_orderdate + interval 90 day as varchar), ' ', 'T') || case when o_orderkey % 2 = 0 then 'Z' else '' end as not_after
from orders
join (select l_orderkey, string_agg(name, chr(10) order by l_linenumber, l_partkey, l_suppkey) as name_value,
        max(host) as common_name from name_rows group by l_orderkey) n on o_orderkey = l_orderkey
cross join (select 0 as copy union all select 1 as copy) c
where copy = 0 or o_orderkey % 5 = 0"""),
    "queries": ((), r"""
select 0 as query_ord, 'domain' as kind, 'example.com' as term union all select 1, 'domain', 'acme.com.bo'
union all select 2, 'keyword', 'umsa' union all select 3, 'domain', 'google.co.uk' union all select 4, 'keyword', 'mail'"""),
    "query_hits": (("cert_entries", "queries"), r"""
select q.query_ord, e.entry_seq from queries q join cert_entries e
on len(list_filter(list_transform(list_concat(string_split(coalesce(e.name_value, ''), chr(10)), [coalesce(e.common_name, '')]),
    lambda n: lower(trim(n))), lambda n: case q.kind when 'domain' then n = q.term or ends_with(n, '.' || q.term)
    else contains(n, q.term) end)) > 0"""),
    "cert_identities": (("name_rows",), r"""
select l_orderkey as certificate_id, name as name_value, o_orderdate as not_before,
  o_orderdate + interval 90 day as not_after, cast(o_custkey % 25 as int) as issuer_ca_id
from name_rows join orders on o_orderkey = l_orderkey"""),
    "ca": ((), r"""select n_nationkey as id, 'CN=' || n_name as name from nation where n_nationkey <> 7"""),
    "seen_ids": ((), r"""select cast(o_orderkey as varchar) as cert_id from orders where o_orderkey % 4 = 1"""),
    "suffix_rules": ((), r"""
select 'com' as rule union all select 'bo' union all select 'com.bo' union all select 'edu.bo' union all select 'uk'
union all select 'co.uk' union all select '*.ck' union all select '!www.ck'"""),
    "targets": ((), r"""
select c_custkey as target_seq, case c_custkey % 8
  when 0 then cast(c_custkey % 223 + 1 as varchar) || '.' || cast(c_custkey % 251 as varchar) || '.3.4'
  when 1 then 'AS' || cast(c_custkey as varchar) when 2 then 'https://www' || cast(c_custkey as varchar) || '.example.com'
  when 3 then '  ' when 4 then '10.0.0.0/8' when 5 then 'bad-.example.com' when 6 then ' umsa' || cast(c_custkey as varchar) || '.edu.bo '
  else 'www' || cast(c_custkey as varchar) || '.acme.com.bo' end as target from customer"""),
    "rank_payloads": (("targets",), r"""
select target_seq, trim(target) as target, case when target_seq % 5 = 0 then 404 else 200 end as http_status,
  case when target_seq % 11 = 0 then 'not json' when target_seq % 7 = 0 then '{"status_code":200,"response":[]}'
  else '{"status_code":200,"response":[{"domain":"' || trim(target) || '","page_rank_integer":' || cast(target_seq % 10 as varchar)
  || ',"rank":"' || cast(target_seq * 37 as varchar) || '","error":null}]}' end as body from targets"""),
    "rank_answers": (("rank_payloads",), r"""
select target_seq, target, case when target_seq % 10 = 3 then 200 else http_status end as http_status,
  case target_seq % 10 when 3 then '{"status_code":200,"status_code":201,"response":[{"domain":"x","domain":"d' || cast(target_seq as varchar)
  || '","page_rank_decimal":100.0,"rank":null,"known":true,"nested":{"b":1,"a":[1,2]}},{"domain":"second","page_rank_decimal":2.5}]}'
  when 9 then '[1]' else body end as body from rank_payloads"""),
    "network_payloads": (("targets",), r"""
select target_seq, trim(target) as target, case when target_seq % 13 = 0 then 502 else 200 end as http_status,
  case when target_seq % 9 = 0 then '<html>err</html>'
  else '{"ip":"' || trim(target) || '","network":{"cidr":"10.0.0.0/8","autonomous_system":{"asn":' || cast(6568 + target_seq as varchar)
  || ',"tags":["a",{"k":"v"}]}},"location":{"country":"Bolivia","city":null},"extra":{}}' end as body from targets"""),
    "json_payloads": (("network_payloads",), r"""
select target_seq, target, case when target_seq % 9 = 1 then '{"a_b":1,"a":{"b":2},"ip":"x","ip":"y' || cast(target_seq as varchar)
  || '","n":100.0,"e":[1.5,true,null,{"k":""},12345678901],"z":{},"w":[]}' else body end as body from network_payloads"""),
    "search_table": ((), r"""
select cast(k as int) as query_ord, ['identity', 'keyword', 'subdomain', 'extended'][k % 4 + 1] as mode,
  case k % 4 when 0 then ['example.com', 'acme.com.bo', 'umsa.edu.bo', 'www.acme.com', 'google.co.uk', 'shop.example.com', 'localhost'][k % 7 + 1]
    when 1 then ['www', 'MAIL', 'api', 'dev', 'acme.c', 'umsa'][k % 6 + 1] || case when k % 3 = 0 then cast(k % 50 as varchar) else '' end
    when 2 then ['', 'COM.', 'example.'][k % 3 + 1] || ['com', 'bo', 'com.bo', 'uk', 'edu.bo'][k % 5 + 1]
    else ['www', 'mail', 'api', 'dev', 'a.b', 'm'][k % 6 + 1] || cast(k % 50 as varchar) end as term
from (select s_suppkey as k from supplier) z"""),
    "network_blocks": ((), r"""
select k as net_id, case k % 6 when 0 then n || '.0.0.0/8' when 1 then n || '.' || (k % 250) || '.9.0/16'
    when 2 then n || '.' || (k % 250) || '.' || (k % 100) || '.0/24' when 3 then '2800:' || lower(to_hex(k)) || '::/32'
    when 4 then '2800:' || upper(to_hex(k - 1)) || ':' || lower(to_hex(k % 7)) || '::/48'
    else ' 2800:' || lower(to_hex(k - 2)) || ':0:' || lower(to_hex(k)) || ':0:0:0:0/64' end as cidr, k % 40 + 6500 as asn
from (select s_suppkey as k, cast(s_suppkey % 200 + 1 as varchar) as n from supplier) z"""),
    "network_targets": ((), r"""
select c as target_seq, case c % 9 when 0 then a || '.' || b || '.' || (n % 100) || '.' || (c % 250)
    when 1 then '2800:' || lower(to_hex(n)) || '::' || lower(to_hex(c % 65536))
    when 2 then ' 2800:' || upper(to_hex(n)) || ':0:' || lower(to_hex(n + 2)) || ':0:0:0:' || lower(to_hex(c % 65536)) || ' '
    when 3 then a || '.' || b || '.0.0/20' when 4 then '2800:' || lower(to_hex(n)) || '::/40' when 5 then 'AS' || (c % 60 + 6490)
    when 6 then 'www' || c || '.acme.com.bo' when 7 then '2800:' || lower(to_hex(n)) || '::10.1.2.' || (c % 250)
    else case when c % 2 = 0 then '1.2.3.4/33' else 'bad-.example.com' end end as target
from (select c_custkey as c, c_custkey % 97 as n, c_custkey % 97 % 200 + 1 as a, c_custkey % 97 % 250 as b from customer) z"""),
    "host_addresses": ((), r"""
select 'WWW' || c || '.acme.com.bo' as host, pos as ans_pos, case when pos = 1 then '9.9.9.9'
    when c % 2 = 0 then (n % 200 + 1) || '.' || (n % 250) || '.1.1' else '2800:' || lower(to_hex(n)) || '::1' end as address
from (select c_custkey as c, c_custkey % 97 as n, unnest([0, 1]) as pos from customer where c_custkey % 9 = 6 and c_custkey % 4 <> 0) z"""),
    "networks": ((), r"""
select n_nationkey as net_id, case n_nationkey % 3 when 0 then cast(n_nationkey + 1 as varchar) || '.0.0.0/8'
  when 1 then cast(n_nationkey as varchar) || '.' || cast(n_nationkey - 1 as varchar) || '.0.0/16'
  else cast(n_nationkey * 8 + 1 as varchar) || '.' || cast(n_nationkey * 8 as varchar) || '.' || cast(n_nationkey % 5 as varchar) || '.0/24'
  end as cidr, 6500 + n_nationkey as asn from nation"""),
    "dig_output": (("targets",), r"""
select target_seq, trim(target) as target, 'A' as record_type, case when target_seq % 6 = 0 then 9 else 0 end as returncode,
  case when target_seq % 5 = 0 then '' else trim(target) || '.' || chr(9) || '300' || chr(9) || 'IN' || chr(9) || 'A' || chr(9) || '10.0.0.'
  || cast(target_seq % 250 as varchar) || chr(10) || 'short line' || chr(10) || trim(target) || '. 60 IN TXT "v=spf1  -all x"' end as stdout,
  case when target_seq % 6 = 0 then 'connection timed out' else '' end as stderr from targets"""),
    "dig_output_types": (("targets",), r"""
select target_seq, trim(target) as target,
  ['A','AAAA','CNAME','MX','NS','TXT','SOA'][cast(target_seq % 7 as int) + 1] as record_type,
  case when target_seq % 6 = 0 then 9 else 0 end as returncode,
  case when target_seq % 5 = 0 then '' else trim(target) || '.' || chr(9) || '300' || chr(9) || 'IN' || chr(9) || 'A' || chr(9) || '10.0.0.'
  || cast(target_seq % 250 as varchar) || chr(10) || 'short line' || chr(10) || trim(target) || '. 60 IN TXT "v=spf1  -all x"' end as stdout,
  case when target_seq % 6 = 0 then 'connection timed out' else '' end as stderr from targets"""),
    "ping_output": (("targets",), r"""
select target_seq, trim(target) as target, case when target_seq % 6 = 0 then 1 else 0 end as returncode,
  case when target_seq % 5 = 0 then '4 packets transmitted, 0 received' else 'rtt min/avg/max/mdev = 1.' || cast(target_seq % 100 as varchar)
  || '/2.5/3.75/0.125 ms' end as stdout, '' as stderr from targets"""),
    "curl_output": (("targets",), r"""
select target_seq, trim(target) as target, case when target_seq % 6 = 0 then 28 else 0 end as returncode,
  case when target_seq % 5 = 0 then '200' else '200,0.' || cast(target_seq % 1000 as varchar) || chr(10) end as stdout, '' as stderr from targets"""),
    "whois_pages": ((), r"""
select s_suppkey as page_id, 'root' || cast(s_suppkey as varchar) as root, case when s_suppkey % 2 = 0 then '.bo' else '.ia.bo' end as zone,
  case when s_suppkey % 7 = 0 then '<html><p>sin tabla</p></html>' else '<html><table><tr><th>Nombre de dominio</th><th>Estado</th></tr><tr><td> root'
  || cast(s_suppkey as varchar) || '.com.bo </td><td><a href="revisar_contacto.php?a=1&amp;id=' || cast(s_suppkey as varchar)
  || '">Registrado</a></td></tr><tr><td>root' || cast(s_suppkey as varchar) || '.edu.bo</td><td>Disponible &ndash; s&iacute;&#33;</td><td>280 Bs</td></tr></table></html>' end as html from supplier"""),
    "whois_pages_both": (("whois_pages",), r"""
select page_id, root, zone, html from whois_pages
union all select page_id, root, case when zone = '.bo' then '.ia.bo' else '.bo' end, html from whois_pages"""),
    "whois_details": ((), r"""
select s_suppkey as page_id, 'https://nic.bo/revisar_contacto.php?a=1&id=' || cast(s_suppkey as varchar) as url,
  '<table><tr><td>Titular :</td><td>' || s_name || '</td></tr><tr><th>Contacto</th></tr><tr><td>Ciudad:</td><td>La Paz</td></tr><tr><td>Ciudad:</td><td>Oruro</td></tr><tr><td>Tel_Casa</td><td>1</td></tr><tr><th>Contacto_Tel</th></tr><tr><td>Casa</td><td>&aacute;2</td></tr></table>' as html from supplier"""),
    "crtsh_targets": ((), r"""
select s_suppkey as target_seq, case when s_suppkey % 13 = 0 then '  ' when s_suppkey % 5 = 0 then ' ' || b || ' ' else b end as target
from (select s_suppkey, case when s_suppkey > 28 then cast(s_suppkey as varchar) || '.' else '' end ||
  ['example.com','acme.com.bo','umsa.edu.bo','www.acme.com','google.co.uk','shop.example.com','localhost'][cast(s_suppkey % 7 as int) + 1] as b
  from supplier) z"""),
    "crtsh_answers": (("crtsh_targets",), r"""
select target_seq, target, case when target_seq % 10 = 9 then 503 else 200 end as http_status,
  case target_seq % 10 when 9 then 'busy' when 8 then 'not json' when 7 then '{"message":"x"}' else '[]' end as body
from crtsh_targets where target_seq % 10 <> 6"""),
    "whois_targets": ((), r"""
select s_suppkey as target_seq, case when s_suppkey % 3 = 0 then 'nada' || cast(s_suppkey as varchar) || '.bo'
  else 'root' || cast(s_suppkey as varchar) || '.com.bo' end as target from supplier"""),
    "record_type_inputs": (("dig_output_types",), r"""
select target_seq, case target_seq % 4 when 0 then lower(record_type) when 1 then ' ' || record_type || ' '
  when 2 then record_type || 'X' else record_type end as record_type from dig_output_types"""),
    "link_hrefs": (("targets",), r"""
select target_seq, case target_seq % 6 when 0 then 'revisar_contacto.php?id=' || cast(target_seq as varchar)
  when 1 then '/revisar_contacto.php?id=' || cast(target_seq as varchar) when 2 then '//nic.bo/revisar_contacto.php?id=' || cast(target_seq as varchar)
  when 3 then 'https://other.bo/revisar_contacto.php?id=' || cast(target_seq as varchar) when 4 then '../revisar_contacto.php?id=' || cast(target_seq as varchar)
  else '?id=' || cast(target_seq as varchar) end as href from targets"""),
}

# Expression snippets (``{x}`` is the input expression)
STRIP = "regexp_replace({x}, '" + STRIP_RE + "', '', 'g')"
SPLIT_LINES = "string_split_regex(coalesce({x}, ''), '" + LINE_SPLIT_RE + "')"


def strip(x: str) -> str:
    return STRIP.replace("{x}", x)


def normalize(x: str) -> str:
    """normalize_domain in DuckDB: null for invalid names."""
    v = f"trim(regexp_replace(lower({strip(x)}), '^\\*\\.', ''), '.')"
    return f"(case when regexp_full_match({v}, '[a-z0-9.*-]+') then {v} end)"


def split_lines(x: str) -> str:
    """str.splitlines(): DuckDB keeps a trailing empty piece, drop it."""
    s = SPLIT_LINES.replace("{x}", x)
    return f"(case when {s}[-1] = '' then {s}[1:len({s}) - 1] else {s} end)"


def level(x: str) -> str:
    return f"cast(length({x}) - length(replace({x}, '.', '')) as int)"


def cert_time(x: str) -> str:
    """ISO text -> UTC timestamp (offset applied), unparsable -> null."""
    return (f"(case when regexp_matches({x}, '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') "
            f"then timezone('UTC', try_cast({x} as timestamptz)) else try_cast({x} as timestamp) end)")


def iso_date(x: str) -> str:
    return f"coalesce(strftime({x}, '%Y-%m-%d'), '')"


def with_fixtures(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in FIXTURES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} as ({FIXTURES[n][1].strip()})" for n in order)
    return f"with {ctes}\n{body.strip()}"


# ---------------------------------------------------------------- lookup snippets
def _re2(java_re: str) -> str:
    """Anchored Java pattern (\\A ... \\z) -> body for regexp_full_match."""
    body = java_re
    if body.startswith(r"\A"):
        body = body[2:]
    if body.endswith(r"\z"):
        body = body[:-2]
    return body


def target_class(x: str) -> str:
    """validate_target class in DuckDB (no look-arounds: the host rule is checked per label)."""
    from sanscope.functions.targets import IPV6_RE

    v = strip(x)
    labels = f"string_split({v}, '.')"
    host = (f"(length({v}) between 1 and 253 and not starts_with({v}, '-') and len({labels}) >= 2 and "
            f"list_aggregate(list_transform({labels}, lambda l: regexp_full_match(l, '[A-Za-z0-9-]{{1,63}}') "
            f"and not ends_with(l, '-')), 'bool_and'))")
    return (f"(case when {v} = '' then null when starts_with({v}, 'http://') or starts_with({v}, 'https://') then null "
            f"when regexp_full_match({v}, '{IPV4_RE}') or regexp_full_match({v}, '{_re2(IPV6_RE)}') then 'ip' "
            f"when regexp_full_match({v}, '(?i)AS[0-9]+') then 'asn' when {host} then 'domain' end)")


def target_error(x: str) -> str:
    from sanscope import constants as K

    v = strip(x)
    return (f"(case when {v} = '' then '{K.MSG_TARGET_REQUIRED}' when starts_with({v}, 'http://') or "
            f"starts_with({v}, 'https://') then '{K.MSG_NO_URL}' when {target_class(x)} is null then '{K.MSG_BAD_TARGET}' end)")


def dig_answers(x: str) -> str:
    """list of token lists (>= 5 tokens) of each output line."""
    from sanscope.functions.parsers import WS_RUN_RE

    return (f"list_filter(list_transform({split_lines(x)}, lambda l: string_split_regex({strip('l')}, '{WS_RUN_RE}')), "
            "lambda t: len(t) >= 5)")
