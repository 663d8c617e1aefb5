"""HTTP-flavour certificate queries (entries -> names -> domains -> summaries)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sanscope.checks import duckdb_sql as D
from sanscope.functions import names as N
from sanscope.operators import certs as C
from sanscope.operators import indexes as IX
from sanscope.operators import ordering, state, suffix
from sanscope.plans import discover as P
from sanscope.plans.registry import register
from sanscope.session import state_path
from sanscope.sources import fixtures as X

AS_OF = X.AS_OF
VALID_AT = "1996-01-01 00:00:00"  # the moment of the run that leaves out expired certificates


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_cert_id(X.cert_entries(spark, sf))


# ---------------------------------------------------------------- SQL pieces
ENTS = "ents as (select *, coalesce(nullif(min_cert_id, 0), id) as cert_id from cert_entries)"
DEDUP = ("dd as (select * from ents where cert_id is not null "
         "qualify row_number() over (partition by cert_id order by entry_seq) = 1)")
NAME_LIST = f"list_concat({D.split_lines('name_value')}, [common_name])"


def _names_sql(src: str, keep: str) -> str:
    """(keep..., name_pos, domain) rows of ``src`` (normalised, invalid dropped)."""
    return (f"(select {keep}, name_pos, {D.normalize('raw_name')} as domain from "
            f"(select {keep}, unnest(list_transform(range(len(l)), lambda i: cast(i as int))) as name_pos, unnest(l) as raw_name from "
            f"(select *, {NAME_LIST} as l from {src}) z1) z2) z3 where domain is not null")


def _compose(body: str, ctes, fixtures) -> str:
    """fixtures CTEs + extra CTEs + body."""
    base = D.with_fixtures("select 1", *fixtures)
    head = base[: base.rfind("select 1")].rstrip()
    extra = ",\n".join(ctes)
    if head:
        return f"{head},\n{extra}\n{body}" if extra else f"{head}\n{body}"
    return f"with {extra}\n{body}" if extra else body


HITS = ("hits as (select qh.query_ord, q.kind, q.term, e.*, coalesce(nullif(e.min_cert_id, 0), e.id) as cert_id "
        "from query_hits qh join cert_entries e on e.entry_seq = qh.entry_seq join queries q on q.query_ord = qh.query_ord)")
HITS_DEDUP = ("hd as (select * from hits where cert_id is not null "
              "qualify row_number() over (partition by query_ord, cert_id order by entry_seq) = 1)")


def _run_sql(kind: str, uncached: bool) -> list[str]:
    """CTEs: hits of one run (all searches of one kind), per-search dedup, then the
    --uncached state: skip saved ids, each certificate owned by its first search."""
    ctes = [HITS, HITS_DEDUP]
    if uncached:
        ctes.append(f"run as (select * from hd where kind = '{kind}' and cast(cert_id as varchar) not in "
                    "(select cert_id from seen_ids) qualify query_ord = min(query_ord) over (partition by cert_id))")
    else:
        ctes.append(f"run as (select * from hd where kind = '{kind}')")
    return ctes


def ps_sql(p: str, domains: str) -> str:
    """CTEs ``{p}_lab`` and ``{p}_out(domain, private_suffix)`` for the distinct normalised
    domains selected by ``domains`` (one column ``domain``), from the ``suffix_rules`` table."""
    return f"""
{p}_dom as (select distinct domain from ({domains}) d where domain is not null),
{p}_lab as (select domain, string_split(domain, '.') as l from {p}_dom),
{p}_cand as (select domain, n, k, array_to_string(l[n - k + 1:], '.') as cand from
  (select domain, l, len(l) as n, unnest(range(1, len(l) + 1)) as k from {p}_lab) z),
{p}_rules as (select case when rule like '!%' then substr(rule, 2) when rule like '*.%' then substr(rule, 3) else rule end as body,
  case when rule like '!%' then -1 when rule like '*.%' then 1 else 0 end as delta from suffix_rules),
{p}_hit as (select c.domain, c.k + r.delta as ps_len, r.delta = -1 as exc from {p}_cand c join {p}_rules r on c.cand = r.body
  where c.k + r.delta <= c.n),
{p}_len as (select d.domain, coalesce(max(h.ps_len) filter (where h.exc), max(h.ps_len), 1) as ps_len
  from {p}_dom d left join {p}_hit h on h.domain = d.domain group by d.domain),
{p}_out as (select p.domain, case when p.ps_len >= len(l.l) then p.domain else array_to_string(l.l[1:len(l.l) - p.ps_len], '.') end
  as private_suffix from {p}_len p join {p}_lab l on l.domain = p.domain)""".strip()


# ---------------------------------------------------------------- flagship
@register("domain_analysis", _compose(
    "select domain, " + D.level("domain") + " as level, "
    + D.iso_date("min(" + D.cert_time("not_before") + ")") + " as first_seen, "
    + D.iso_date("max(" + D.cert_time("not_after") + ")") + " as last_seen, "
    + f"case when max({D.cert_time('not_after')}) > timestamp '{AS_OF}' then 'Vigente' else 'Expirado' end as is_active "
    + "from " + _names_sql("dd", "not_before, not_after") + " group by domain",
    [ENTS, DEDUP], ("cert_entries",)))
def q_domain_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """cert_entries -> cert_id -> dedup_certs -> entry_names -> domain_analysis."""
    named = C.entry_names(C.dedup_certs(entries(spark, sf)), keep=("not_before", "not_after"))
    return C.domain_analysis(named, AS_OF)


# ---------------------------------------------------------------- scalars on entries
@register("cert_id", _compose("select entry_seq, cert_id from ents", [ENTS], ("cert_entries",)))
def q_cert_id(spark, sf):
    return entries(spark, sf).select("entry_seq", "cert_id")


@register("dedup_certs", _compose("select entry_seq, cert_id from dd", [ENTS, DEDUP], ("cert_entries",)))
def q_dedup_certs(spark, sf):
    return C.dedup_certs(entries(spark, sf)).select("entry_seq", "cert_id")


@register("entry_names", _compose("select * from " + _names_sql("cert_entries", "entry_seq"), [], ("cert_entries",)))
def q_entry_names(spark, sf):
    return C.entry_names(X.cert_entries(spark, sf), keep=("entry_seq",))


@register("split_names", _compose(
    "select entry_seq, unnest(list_transform(range(len(l)), lambda i: cast(i as int))) as pos, unnest(l) as piece from "
    f"(select entry_seq, {D.split_lines('name_value')} as l from cert_entries) z", [], ("cert_entries",)))
def q_split_names(spark, sf):
    return X.cert_entries(spark, sf).select(
        "entry_seq", F.posexplode(N.split_names("name_value")).alias("pos", "piece"))


@register("normalize_domain", _compose(
    f"select l_orderkey, l_linenumber, name, {D.normalize('name')} as domain from name_rows", [], ("name_rows",)))
def q_normalize_domain(spark, sf):
    return X.name_rows(spark, sf).select("l_orderkey", "l_linenumber", "name", N.normalize_domain("name").alias("domain"))


@register("clean_name_basic", _compose(
    "select entry_seq, pos, name from (select entry_seq, unnest(list_transform(range(len(l)), lambda i: cast(i as int))) as pos, "
    f"lower({D.strip('unnest(l)')}) as name from (select entry_seq, string_split(coalesce(name_value, ''), chr(10)) as l "
    "from cert_entries) z) y where name <> ''", [], ("cert_entries",)))
def q_clean_name_basic(spark, sf):
    e = X.cert_entries(spark, sf).select(
        "entry_seq", F.posexplode(F.split(F.coalesce("name_value", F.lit("")), "\n", -1)).alias("pos", "raw"))
    return e.select("entry_seq", "pos", N.clean_name_basic("raw").alias("name")).where(F.col("name").isNotNull())


@register("domain_level", _compose(
    f"select l_orderkey, l_linenumber, domain, {D.level('domain')} as level from "
    f"(select l_orderkey, l_linenumber, {D.normalize('name')} as domain from name_rows) z where domain is not null",
    [], ("name_rows",)))
def q_domain_level(spark, sf):
    d = X.name_rows(spark, sf).select("l_orderkey", "l_linenumber", N.normalize_domain("name").alias("domain"))
    return d.where(F.col("domain").isNotNull()).withColumn("level", N.domain_level("domain"))


@register("parse_cert_time", _compose(
    "select entry_seq, strftime(" + D.cert_time("not_before") + ", '%Y-%m-%d %H:%M:%S') as not_before_ts, "
    "strftime(" + D.cert_time("not_after") + ", '%Y-%m-%d %H:%M:%S') as not_after_ts from cert_entries", [], ("cert_entries",)))
def q_parse_cert_time(spark, sf):
    e = X.cert_entries(spark, sf)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return e.select("entry_seq", N.utc_text(N.parse_cert_time("not_before"), fmt).alias("not_before_ts"),
                    N.utc_text(N.parse_cert_time("not_after"), fmt).alias("not_after_ts"))


@register("iso_date", _compose(
    "select entry_seq, " + D.iso_date(D.cert_time("not_before")) + " as first_seen, "
    + D.iso_date(D.cert_time("not_after")) + " as last_seen from cert_entries", [], ("cert_entries",)))
def q_iso_date(spark, sf):
    e = X.cert_entries(spark, sf)
    return e.select("entry_seq", N.iso_date(N.parse_cert_time("not_before")).alias("first_seen"),
                    N.iso_date(N.parse_cert_time("not_after")).alias("last_seen"))


@register("is_active", _compose(
    f"select entry_seq, case when {D.cert_time('not_after')} > timestamp '{AS_OF}' then 'Vigente' else 'Expirado' end "
    "as is_active from cert_entries", [], ("cert_entries",)))
def q_is_active(spark, sf):
    e = X.cert_entries(spark, sf)
    return e.select("entry_seq", N.is_active(N.parse_cert_time("not_after"), AS_OF).alias("is_active"))


@register("like_pattern", _compose(
    "select target_seq, '%' || trim(target) || '%' as keyword_pattern, '%.' || trim(target) as domain_pattern, "
    "trim(target) || '.%.%' as extended_pattern from targets", [], ("targets",)))
def q_like_pattern(spark, sf):
    t = F.trim(F.col("target"))
    return X.targets(spark, sf).select("target_seq", N.like_contains(t).alias("keyword_pattern"),
                                       N.like_subdomain(t).alias("domain_pattern"), N.like_extended(t).alias("extended_pattern"))


# ---------------------------------------------------------------- filters
@register("filter_valid_name", _compose(
    f"select entry_seq, name_pos, raw_name, {D.normalize('raw_name')} as domain from "
    f"(select entry_seq, unnest(list_transform(range(len(l)), lambda i: cast(i as int))) as name_pos, unnest(l) as raw_name from "
    f"(select *, {NAME_LIST} as l from cert_entries) z1) z2 where {D.normalize('raw_name')} is not null",
    [], ("cert_entries",)))
def q_filter_valid_name(spark, sf):
    e = X.cert_entries(spark, sf).select(
        "entry_seq", F.posexplode(F.concat(N.split_names("name_value"), F.array("common_name"))).alias("name_pos", "raw_name"))
    return e.withColumn("domain", N.normalize_domain("raw_name")).where(F.col("domain").isNotNull())


@register("filter_not_expired", _compose(
    f"select entry_seq, cert_id from ents where {D.cert_time('not_after')} > timestamp '{AS_OF}'", [ENTS], ("cert_entries",)))
def q_filter_not_expired(spark, sf):
    return C.filter_not_expired(entries(spark, sf), AS_OF).select("entry_seq", "cert_id")


def _match_sql(mode: str, t: str) -> str:
    lname = f"lower({D.strip('n')})"
    if mode == "identity":
        cond = f"{lname} = '{t}' or ends_with({lname}, '.{t}')"
    elif mode == "keyword":
        cond = f"{lname} like '%{t}%'"
    elif mode == "extended":
        cond = f"{lname} like '{t}.%.%'"
    else:
        cond = f"{lname} like '%.{t}'"
    return f"len(list_filter(list_filter({NAME_LIST}, lambda n: n is not null), lambda n: {cond})) > 0"


SEARCHES = [("identity" if k == "domain" else "keyword", t) for k, t in X.QUERIES]


@register("match_cert_identity", _compose(
    " union all ".join(f"select {i} as query_ord, entry_seq from cert_entries where {_match_sql(m, t)}"
                       for i, (m, t) in enumerate(SEARCHES)), [], ("cert_entries",)))
def q_match_cert_identity(spark, sf):
    return C.match_cert_identity(X.cert_entries(spark, sf), SEARCHES).select("query_ord", "entry_seq")


@register("match_search_table", _compose(
    "select s.query_ord, e.entry_seq from search_table s join cert_entries e on len(list_filter(list_filter(" + NAME_LIST
    + ", lambda n: n is not null), lambda n: case s.mode when 'identity' then lower(" + D.strip("n") + ") = lower(s.term) or ends_with(lower("
    + D.strip("n") + "), '.' || lower(s.term)) when 'keyword' then contains(lower(" + D.strip("n") + "), lower(s.term)) "
    "when 'subdomain' then ends_with(lower(" + D.strip("n") + "), '.' || lower(s.term)) else lower(" + D.strip("n")
    + ") like lower(s.term) || '.%.%' end)) > 0", [], ("cert_entries", "search_table")))
def q_match_search_table(spark, sf):
    """A table of searches matched by equi joins: the plan doesn't grow with their number."""
    return IX.match_search_table(X.cert_entries(spark, sf), X.search_table(spark, sf)).select("query_ord", "entry_seq")


@register("filter_private_suffix", _compose(
    "select qps.query_ord, n.domain from (select distinct " + D.normalize("name") + " as domain from name_rows) n "
    "join qps on list_contains(list_filter(string_split(n.domain, '.'), lambda x: x <> ''), qps.private_suffix)",
    [ps_sql("tp", "select " + D.normalize("term") + " as domain from queries where kind = 'domain'"),
     "qps as (select q.query_ord, t.private_suffix from queries q join tp_out t on t.domain = " + D.normalize("q.term")
     + " where q.kind = 'domain')"], ("name_rows", "queries", "suffix_rules")))
def q_filter_private_suffix(spark, sf):
    """Names kept by each domain search's private-suffix label (computed by the rule table)."""
    d = X.name_rows(spark, sf).select(N.normalize_domain("name").alias("domain")).distinct()
    ords = [i for i, (k, _) in enumerate(X.QUERIES) if k == "domain"]
    ps = suffix.private_suffix_of_terms(spark, [X.QUERIES[i][1] for i in ords], X.suffix_rules(spark))
    return P.label_hits(d.where(F.col("domain").isNotNull()), dict(zip(ords, ps))).select("query_ord", "domain")


@register("filter_levels", _compose(
    "select query_ord, entry_seq, domain from " + _names_sql("run", "query_ord, entry_seq, term")
    + " and " + D.level("domain") + " <= " + D.level("term") + " + 1",
    _run_sql("domain", False), ("query_hits", "seen_ids")))
def q_filter_levels(spark, sf):
    named = P.run_names(spark, entries(spark, sf), X.QUERIES, "domain", seen=None)
    return C.filter_levels(named, P._by_ord(P.level_bounds(X.QUERIES, 1))).select("query_ord", "entry_seq", "domain")


# ---------------------------------------------------------------- state / sets
@register("anti_seen", _compose(
    "select entry_seq, cert_id from dd where cast(cert_id as varchar) not in (select cert_id from seen_ids)",
    [ENTS, DEDUP], ("cert_entries", "seen_ids")))
def q_anti_seen(spark, sf):
    return state.anti_seen(C.dedup_certs(entries(spark, sf)), X.seen_ids(spark, sf)).select("entry_seq", "cert_id")


STATE_BUCKETS = 64


@register("anti_seen_bucketed", _compose(
    "select entry_seq, cert_id from dd where cast(cert_id as varchar) not in (select cert_id from seen_ids)",
    [ENTS, DEDUP], ("cert_entries", "seen_ids")))
def q_anti_seen_bucketed(spark, sf):
    """The saved ids as a bucketed table: only the run's entries are moved."""
    name, path = f"seen_{uuid.uuid4().hex}", state_path(spark, f"state-tables/{uuid.uuid4().hex}")
    IX.write_state_table(X.seen_ids(spark, sf), name, STATE_BUCKETS, path)
    known = IX.open_state_table(spark, name, STATE_BUCKETS, path)
    return IX.anti_seen_bucketed(C.dedup_certs(entries(spark, sf)), known, STATE_BUCKETS).select("entry_seq", "cert_id")


@register("except_seen", _compose(
    "select cast(cert_id as varchar) as cert_id from ents where cert_id is not null except select cert_id from seen_ids",
    [ENTS], ("cert_entries", "seen_ids")))
def q_except_seen(spark, sf):
    ids = entries(spark, sf).where(F.col("cert_id").isNotNull()).select(F.col("cert_id").cast("string").alias("cert_id"))
    return state.except_seen(ids, X.seen_ids(spark, sf))


@register("state_merge", _compose(
    "select cert_id from seen_ids union select cast(cert_id as varchar) from ents where cert_id is not null",
    [ENTS], ("cert_entries", "seen_ids")))
def q_state_merge(spark, sf):
    processed = entries(spark, sf).where(F.col("cert_id").isNotNull()).select(F.col("cert_id").cast("string").alias("cert_id"))
    return state.state_merge(X.seen_ids(spark, sf), processed)


@register("sort_seen_ids", _compose(
    "select cert_id, row_number() over (order by cert_id) - 1 as sort_pos from "
    "(select cert_id from seen_ids union select cast(cert_id as varchar) from ents where cert_id is not null) s",
    [ENTS], ("cert_entries", "seen_ids")))
def q_sort_seen_ids(spark, sf):
    processed = entries(spark, sf).where(F.col("cert_id").isNotNull()).select(F.col("cert_id").cast("string").alias("cert_id"))
    merged = state.state_merge(X.seen_ids(spark, sf), processed)
    return ordering.order_number(merged, ["cert_id"], "sort_pos")


@register("first_query_owner", _compose(
    "select query_ord, entry_seq, cert_id from hits where cert_id is not null "
    "qualify query_ord = min(query_ord) over (partition by cert_id)", [HITS], ("query_hits",)))
def q_first_query_owner(spark, sf):
    hits = P.responses(entries(spark, sf), X.QUERIES, None).where(F.col("cert_id").isNotNull())
    return C.first_query_owner(hits).select("query_ord", "entry_seq", "cert_id")


# ---------------------------------------------------------------- aggregates and pipelines
@register("distinct_domains", _compose("select distinct domain from " + _names_sql("dd", "entry_seq"),
                                       [ENTS, DEDUP], ("cert_entries",)))
def q_distinct_domains(spark, sf):
    return C.distinct_domains(C.entry_names(C.dedup_certs(entries(spark, sf)), keep=("entry_seq",)))


@register("domains_per_query", _compose(
    "select query_ord, count(distinct domain) as n_domains from " + _names_sql("hd", "query_ord") + " group by query_ord",
    [HITS, HITS_DEDUP], ("query_hits",)))
def q_domains_per_query(spark, sf):
    ded = C.dedup_certs(P.responses(entries(spark, sf), X.QUERIES, None), by=["query_ord"])
    named = C.entry_names(ded, keep=("query_ord",))
    return C.distinct_domains(named, by=["query_ord"]).groupBy("query_ord").agg(F.count("*").alias("n_domains"))


def _discover_sql(kind: str, levels: int | None, valid_at: str | None = None) -> str:
    ctes = _run_sql(kind, True)
    if valid_at is not None:
        ctes[1] = ctes[1].replace("cert_id is not null ", f"cert_id is not null and {D.cert_time('not_after')} > timestamp '{valid_at}' ")
    cond = f" and {D.level('domain')} <= {D.level('term')} + {levels}" if levels is not None else ""
    return _compose("select distinct domain from " + _names_sql("run", "query_ord, entry_seq, term") + cond,
                    ctes, ("query_hits", "seen_ids"))


@register("discover_domains", _discover_sql("domain", 1, VALID_AT))
def q_discover_domains(spark, sf):
    return P.discover_domains(spark, entries(spark, sf), X.QUERIES, X.seen_ids(spark, sf), levels=1, exclude_expired=VALID_AT)


@register("discover_keyword", _discover_sql("keyword", None, VALID_AT))
def q_discover_keyword(spark, sf):
    return P.discover_keyword(spark, entries(spark, sf), X.QUERIES, X.seen_ids(spark, sf), exclude_expired=VALID_AT)


@register("novelty_curve", _compose(
    "select query_ord, entry_seq, new_domains, cast(sum(new_domains) over (partition by query_ord order by entry_seq "
    "rows between unbounded preceding and current row) as bigint) as total_domains from "
    "(select query_ord, entry_seq, count(*) as new_domains from "
    "(select query_ord, domain, min(entry_seq) as entry_seq from "
    + _names_sql("run", "query_ord, entry_seq, term") + f" and {D.level('domain')} <= {D.level('term')} + 1"
    " group by query_ord, domain) f group by query_ord, entry_seq) c",
    _run_sql("domain", True), ("query_hits", "seen_ids")))
def q_novelty_curve(spark, sf):
    named = P.discover_domains(spark, entries(spark, sf), X.QUERIES, X.seen_ids(spark, sf), levels=1, distinct=False)
    return C.novelty_curve(named.select("query_ord", "entry_seq", "domain"))


@register("union_queries", _compose(
    "select distinct domain from " + _names_sql("run", "query_ord, entry_seq, term"),
    [HITS, HITS_DEDUP, "run as (select * from hd)"], ("query_hits",)))
def q_union_queries(spark, sf):
    """Domains of every search (domain and keyword), as one set."""
    named = P.run_names(spark, entries(spark, sf), X.QUERIES, None, seen=None)
    return C.distinct_domains(named)


EXT_TERMS = [t for k, t in X.QUERIES if k == "domain"]
_XNAME = f"list_transform(list_filter({NAME_LIST}, lambda n: n is not null), lambda n: lower({D.strip('n')}))"


@register("union_base_extended", _compose(
    "select distinct domain from " + _names_sql("xrun", "pass, xterm")
    + " and (pass % 2 = 0 or list_contains(list_filter(string_split(domain, '.'), lambda y: y <> ''), xterm)) and "
    + D.level("domain") + " <= " + D.level("xterm") + " + 1",
    [ENTS, ps_sql("xt", " union all ".join(f"select '{t}' as domain" for t in EXT_TERMS)),
     "xpass as (" + " union all ".join(
         f"select {2 * i} as pass, '{t}' as xterm union all select {2 * i + 1}, private_suffix from xt_out where domain = '{t}'"
         for i, t in enumerate(EXT_TERMS)) + ")",
     "xhit as (select p.pass, p.xterm, e.* from ents e join xpass p on len(list_filter(" + _XNAME
     + ", lambda n: case when p.pass % 2 = 0 then n = p.xterm or ends_with(n, '.' || p.xterm) "
       "else n like p.xterm || '.%.%' end)) > 0 where e.cert_id is not null)",
     "xrun as (select * from xhit where cast(cert_id as varchar) not in (select cert_id from seen_ids) "
     "qualify row_number() over (partition by cert_id order by pass, entry_seq) = 1)"],
    ("cert_entries", "suffix_rules", "seen_ids")))
def q_union_base_extended(spark, sf):
    return P.discover_extended(spark, entries(spark, sf), EXT_TERMS, X.suffix_rules(spark), X.seen_ids(spark, sf), levels=1)


@register("output_counts", _compose(
    "select 'n_domains' as metric, count(*) as value from (select distinct domain from "
    + _names_sql("run", "query_ord, entry_seq, term") + f" and {D.level('domain')} <= {D.level('term')} + 1) a "
    "union all select 'n_cert_records', count(*) from hits where kind = 'domain' "
    "union all select 'n_analysis_domains', count(*) from (select distinct domain from "
    + _names_sql("run", "query_ord, entry_seq, term") + f" and {D.level('domain')} <= {D.level('term')} + 1) b",
    _run_sql("domain", True), ("query_hits", "seen_ids")))
def q_output_counts(spark, sf):
    """The run's closing totals: domains written, raw certificate records logged,
    domains in the analysis file (long form: one row per total)."""
    e = entries(spark, sf)
    named = P.discover_domains(spark, e, X.QUERIES, X.seen_ids(spark, sf), levels=1, distinct=False)
    log = P.certificate_log(e, X.QUERIES, kinds=("domain",))
    n_domains = C.distinct_domains(named).agg(F.count("*").alias("value")).select(F.lit("n_domains").alias("metric"), "value")
    n_log = log.agg(F.count("*").alias("value")).select(F.lit("n_cert_records").alias("metric"), "value")
    n_analysis = C.domain_analysis(named, AS_OF).agg(F.count("*").alias("value")).select(
        F.lit("n_analysis_domains").alias("metric"), "value")
    return n_domains.unionByName(n_log).unionByName(n_analysis)


@register("certificate_log", _compose(
    "select query_ord, entry_seq, min_cert_id, id, issuer_ca_id, common_name, name_value, not_before, not_after "
    "from hits where kind = 'domain'", [HITS], ("query_hits",)))
def q_certificate_log(spark, sf):
    return P.certificate_log(entries(spark, sf), X.QUERIES, kinds=("domain",)).drop("cert_id")


@register("private_suffix", _compose(
    "select domain, private_suffix from ps_out",
    [ps_sql("ps", f"select {D.normalize('name')} as domain from name_rows")], ("name_rows", "suffix_rules")))
def q_private_suffix(spark, sf):
    d = X.name_rows(spark, sf).select(N.normalize_domain("name").alias("domain")).where(F.col("domain").isNotNull()).distinct()
    return suffix.private_suffix(d, X.suffix_rules(spark))
