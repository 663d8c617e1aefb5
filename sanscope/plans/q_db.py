"""DB-flavour queries over certificate identities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sanscope import constants as K
from sanscope.checks import duckdb_sql as D
from sanscope.functions import names as N
from sanscope.operators import certs as C
from sanscope.operators import identities as I
from sanscope.operators import indexes as IX
from sanscope.plans import discover as P
from sanscope.plans.q_certs import _compose, ps_sql
from sanscope.plans.registry import register
from sanscope.session import state_path
from sanscope.sources import fixtures as X

DOMAIN_ORDS = [i for i, (k, _) in enumerate(X.QUERIES) if k == "domain"]
KEYWORD_ORDS = [i for i, (k, _) in enumerate(X.QUERIES) if k == "keyword"]
TERM = {i: t for i, (_, t) in enumerate(X.QUERIES)}
LEVELS = 1


def ids(spark: SparkSession, sf: str) -> DataFrame:
    return X.cert_identities(spark, sf)


def _domain_preds(ords):
    return {i: I.identity_domain_match("name_value", TERM[i]) for i in ords}


def _keyword_preds(ords):
    return {i: I.identity_keyword_match("name_value", TERM[i]) for i in ords}


# ---------------------------------------------------------------- SQL pieces
def _dom_sql(t: str) -> str:
    return f"(name_value ilike '%.{t}' or name_value = '{t}')"


def _kw_sql(t: str) -> str:
    return f"(name_value ilike '%{t}%' or name_value = '{t}')"


def _tag_sql(conds: dict[int, str], src: str = "cert_identities") -> str:
    return " union all ".join(f"select {i} as query_ord, * from {src} where {c}" for i, c in conds.items())


def _ft_sql(ords) -> str:
    """CTE ``ft(certificate_id, query_ord)``: certificates holding every lexeme of the search."""
    flags, conds = [], []
    for i in ords:
        cols = []
        for j, lex in enumerate(I.lexemes(TERM[i])):
            flags.append(f"bool_or(list_contains(toks, '{lex}')) as f{i}_{j}")
            cols.append(f"f{i}_{j}")
        conds.append((i, " and ".join(cols) or "false"))
    per = (f"ftc as (select certificate_id, {', '.join(flags)} from (select *, "
           "string_split_regex(lower(name_value), '[^a-z0-9-]+') as toks from cert_identities) z group by certificate_id)")
    ft = "ft as (" + " union all ".join(f"select certificate_id, {i} as query_ord from ftc where {c}" for i, c in conds) + ")"
    return per + ",\n" + ft


# ---------------------------------------------------------------- keys
@register("raw_level", _compose(
    f"select certificate_id, name_value, {D.level('name_value')} as raw_level from cert_identities", [], ("cert_identities",)))
def q_raw_level(spark, sf):
    return ids(spark, sf).select("certificate_id", "name_value", N.raw_level("name_value").alias("raw_level"))


@register("filter_identity_domain", _compose(
    "select query_ord, certificate_id, name_value from (" + _tag_sql({i: _dom_sql(TERM[i]) for i in DOMAIN_ORDS}) + ") z",
    [], ("cert_identities",)))
def q_filter_identity_domain(spark, sf):
    return I.tag_matches(ids(spark, sf), _domain_preds(DOMAIN_ORDS)).select("query_ord", "certificate_id", "name_value")


@register("filter_identity_keyword", _compose(
    "select query_ord, certificate_id, name_value from (" + _tag_sql({i: _kw_sql(TERM[i]) for i in KEYWORD_ORDS}) + ") z",
    [], ("cert_identities",)))
def q_filter_identity_keyword(spark, sf):
    return I.tag_matches(ids(spark, sf), _keyword_preds(KEYWORD_ORDS)).select("query_ord", "certificate_id", "name_value")


ALL_ORDS = list(range(len(X.QUERIES)))


@register("filter_fulltext", _compose(
    "select ft.query_ord, i.certificate_id, i.name_value from cert_identities i join ft on ft.certificate_id = i.certificate_id",
    [_ft_sql(ALL_ORDS)], ("cert_identities",)))
def q_filter_fulltext(spark, sf):
    certs = I.fulltext_certificates(ids(spark, sf), [TERM[i] for i in ALL_ORDS])
    return ids(spark, sf).join(certs, "certificate_id").select("query_ord", "certificate_id", "name_value")


@register("filter_fulltext_indexed", _compose(
    "select ft.query_ord, i.certificate_id, i.name_value from cert_identities i join ft on ft.certificate_id = i.certificate_id",
    [_ft_sql(ALL_ORDS)], ("cert_identities",)))
def q_filter_fulltext_indexed(spark, sf):
    """Full text by stored postings, the rarest word first."""
    path = state_path(spark, f"indexes/lexemes-{uuid.uuid4().hex}")
    IX.write_lexeme_index(ids(spark, sf), path)
    certs = IX.fulltext_certificates_indexed(spark.read.parquet(path), [TERM[i] for i in ALL_ORDS])
    return ids(spark, sf).join(certs, "certificate_id").select("query_ord", "certificate_id", "name_value")


@register("filter_identity_keyword_indexed", _compose(
    "select query_ord, certificate_id, name_value from (" + _tag_sql({i: _kw_sql(TERM[i]) for i in KEYWORD_ORDS}) + ") z",
    [], ("cert_identities",)))
def q_filter_identity_keyword_indexed(spark, sf):
    """Keywords by stored trigram postings, every name verified."""
    path = state_path(spark, f"indexes/trigrams-{uuid.uuid4().hex}")
    IX.write_trigram_index(ids(spark, sf), path)
    found = IX.keyword_identities_indexed(spark, path, {i: TERM[i] for i in KEYWORD_ORDS})
    return found.select("query_ord", "certificate_id", "name_value")


@register("filter_levels_raw", _compose(
    "select query_ord, certificate_id, name_value from (" + _tag_sql(
        {i: f"{_dom_sql(TERM[i])} and {D.level('name_value')} <= {TERM[i].count('.') + LEVELS}" for i in DOMAIN_ORDS})
    + ") z", [], ("cert_identities",)))
def q_filter_levels_raw(spark, sf):
    preds = {i: I.identity_domain_match("name_value", TERM[i]) & (N.raw_level("name_value") <= TERM[i].count(".") + LEVELS)
             for i in DOMAIN_ORDS}
    return I.tag_matches(ids(spark, sf), preds).select("query_ord", "certificate_id", "name_value")


@register("limit_identities", _compose(
    f"select certificate_id, name_value from cert_identities order by certificate_id, name_value limit {K.DB_ROW_LIMIT}",
    [], ("cert_identities",)))
def q_limit_identities(spark, sf):
    return I.limit_identities(ids(spark, sf), K.DB_ROW_LIMIT).select("certificate_id", "name_value")


@register("join_issuer", _compose(
    "select i.certificate_id, i.name_value, ca.name as issuer_name from cert_identities i left join ca on i.issuer_ca_id = ca.id",
    [], ("cert_identities", "ca")))
def q_join_issuer(spark, sf):
    return I.join_issuer(ids(spark, sf), X.ca(spark, sf)).select("certificate_id", "name_value", "issuer_name")


@register("src_cert_identities", _compose(
    "select i.certificate_id, i.name_value, strftime(i.not_before, '%Y-%m-%d %H:%M:%S') as not_before, "
    "strftime(i.not_after, '%Y-%m-%d %H:%M:%S') as not_after, ca.name as issuer_name "
    "from cert_identities i left join ca on i.issuer_ca_id = ca.id", [], ("cert_identities", "ca")))
def q_src_cert_identities(spark, sf):
    """The identity read: certificate id, name, validity, issuer name."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    j = I.join_issuer(ids(spark, sf), X.ca(spark, sf))
    return j.select("certificate_id", "name_value", F.date_format("not_before", fmt).alias("not_before"),
                    F.date_format("not_after", fmt).alias("not_after"), "issuer_name")


def _discover_db_sql(ords, conds) -> str:
    ctes = [
        _ft_sql(ords),
        "tagged as (select t.* from (" + _tag_sql(conds) + ") t join ft on ft.certificate_id = t.certificate_id "
        "and ft.query_ord = t.query_ord)",
        "run as (select * from tagged where cast(certificate_id as varchar) not in (select cert_id from seen_ids) "
        "qualify query_ord = min(query_ord) over (partition by certificate_id))",
    ]
    body = (f"select distinct domain from (select {D.normalize('unnest(' + D.split_lines('name_value') + ')')} as domain "
            "from run) z where domain is not null")
    return _compose(body, ctes, ("cert_identities", "ca", "seen_ids"))


@register("discover_domains_db", _discover_db_sql(DOMAIN_ORDS, {
    i: f"{_dom_sql(TERM[i])} and {D.level('name_value')} <= {TERM[i].count('.') + LEVELS}" for i in DOMAIN_ORDS}))
def q_discover_domains_db(spark, sf):
    named = P.discover_db(spark, ids(spark, sf), X.ca(spark, sf), X.QUERIES, X.seen_ids(spark, sf), "domain", levels=LEVELS)
    return C.distinct_domains(named)


@register("discover_keyword_db", _discover_db_sql(KEYWORD_ORDS, {i: _kw_sql(TERM[i]) for i in KEYWORD_ORDS}))
def q_discover_keyword_db(spark, sf):
    return C.distinct_domains(P.discover_db(spark, ids(spark, sf), X.ca(spark, sf), X.QUERIES, X.seen_ids(spark, sf), "keyword"))


# an extended run over other terms than the fixture's, each followed by the pass of its private suffix
EXT_SEARCHES = (("domain", "example.com"), ("domain", "com.net"), ("domain", "www.localhost"), ("keyword", "umsa"))
EXT_LIMIT = 2000
_EXT_DOMAINS = [t for k, t in EXT_SEARCHES if k == "domain"]


def _extended_sql(select: str) -> str:
    """CTEs of the extended run: passes (0, 2, 4 plain, 1, 3, 5 by private suffix), their first rows, first owners."""
    passes = "xp as (" + " union all ".join(
        f"select {2 * i} as query_ord, '{t}' as term, cast(null as varchar) as label union all "
        f"select {2 * i + 1}, private_suffix, private_suffix from xt_out where domain = '{t}'" for i, t in enumerate(_EXT_DOMAINS)) + ")"
    toks = "string_split_regex(lower({}), '[^a-z0-9-]+')"
    return _compose(select, [
        ps_sql("xt", " union all ".join(f"select '{t}' as domain" for t in _EXT_DOMAINS)), passes,
        f"ctok as (select certificate_id, list_distinct(flatten(list({toks.format('name_value')}))) as toks from cert_identities group by 1)",
        "found as (select p.query_ord, p.label, i.* from xp p join cert_identities i on (i.name_value ilike '%.' || p.term or i.name_value = p.term) "
        f"and {D.level('i.name_value')} <= {D.level('p.term')} + {LEVELS} join ctok c on c.certificate_id = i.certificate_id "
        f"and list_has_all(c.toks, list_filter({toks.format('p.term')}, lambda x: x <> '')) "
        f"qualify row_number() over (partition by p.query_ord order by i.certificate_id, i.name_value) <= {EXT_LIMIT})",
        "owned as (select f.*, ca.name as issuer_name from found f left join ca on f.issuer_ca_id = ca.id where cast(certificate_id as varchar) "
        "not in (select cert_id from seen_ids) qualify query_ord = min(query_ord) over (partition by certificate_id))",
    ], ("cert_identities", "ca", "seen_ids", "suffix_rules"))


def _extended_rows(spark, sf):
    passes = P.db_passes(spark, EXT_SEARCHES, "domain", extended=True, rules=X.suffix_rules(spark))
    return P.db_rows(ids(spark, sf), X.ca(spark, sf), passes, X.seen_ids(spark, sf), EXT_LIMIT, LEVELS), passes


@register("discover_extended_db", _extended_sql(
    f"select distinct query_ord, domain from (select query_ord, label, {D.normalize('unnest(' + D.split_lines('name_value') + ')')} as domain "
    "from owned) z where domain is not null and (label is null or list_contains(list_filter(string_split(domain, '.'), lambda x: x <> ''), label))"))
def q_discover_extended_db(spark, sf):
    """``--use-db --extended --levels --db-limit --uncached`` for terms of the caller's."""
    return P.db_names(*_extended_rows(spark, sf)).select("query_ord", "domain").distinct()


@register("certificate_log_db", _extended_sql(
    "select query_ord, certificate_id, name_value, strftime(not_before, '%Y-%m-%d %H:%M:%S') as not_before, "
    "strftime(not_after, '%Y-%m-%d %H:%M:%S') as not_after, issuer_name from owned"))
def q_certificate_log_db(spark, sf):
    """The raw log of that run."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    rows = P.certificate_log_db(_extended_rows(spark, sf)[0])
    return rows.withColumn("not_before", F.date_format("not_before", fmt)).withColumn("not_after", F.date_format("not_after", fmt))
