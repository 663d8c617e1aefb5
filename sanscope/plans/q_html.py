"""Registry page queries: first-table extraction, search rows, detail categories, scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from sanscope import constants as K
from sanscope.checks import duckdb_sql as D
from sanscope.operators import whois as W
from sanscope.plans.q_certs import _compose
from sanscope.plans.registry import register
from sanscope.sources import fixtures as X

TS = X.ENVELOPE_TS


# The oracle's own patterns and the character references that the pages hold.
TABLE_SQL, ROW_SQL = "(?is)<table[^>]*>(.*?)</table>", "(?is)<tr[^>]*>(.*?)</tr>"
CELL_SQL, HREF_SQL = "(?is)<t[dh][^>]*>(.*?)</t[dh]>", '(?is)<a [^>]*href="([^"]*)"'
REFERENCES = (("&ndash;", 8211), ("&iacute;", 237), ("&aacute;", 225), ("&#33;", 33), ("&amp;", 38))


def _decoded(c: str) -> str:
    for ref, code in REFERENCES:
        c = f"replace({c}, '{ref}', chr({code}))"
    return c


def _cell_text(c: str) -> str:
    return D.strip(_decoded(f"regexp_replace({c}, '(?s)<[^>]*>', '', 'g')"))


def _rows_sql(src: str, keys: str) -> str:
    """(keys, pos, cells, href) rows of the first table of each page of ``src``."""
    table = f"coalesce(case when regexp_matches(html, '{TABLE_SQL}') then regexp_extract(html, '{TABLE_SQL}', 1) end, '')"
    return (f"(select {keys}, pos, list_transform(regexp_extract_all(r, '{CELL_SQL}', 1), lambda c: {_cell_text('c')}) as cells, "
            f"case when regexp_matches(r, '{HREF_SQL}') then {_decoded(f"regexp_extract(r, '{HREF_SQL}', 1)")} end as href from "
            f"(select {keys}, unnest(list_transform(range(len(rs)), lambda i: cast(i as int))) as pos, unnest(rs) as r from "
            f"(select {keys}, regexp_extract_all({table}, '{ROW_SQL}', 1) as rs from {src}) z1) z2)")


def _search_sql(src: str, keys: str) -> str:
    return (f"(select {keys}, pos, cells[1] as dominio, cells[2] as estado, case when len(cells) >= 3 then cells[3] end as precio, "
            f"case when contains(href, '{K.WHOIS_DETAIL_MARKER}') then '{K.WHOIS_BASE_URL}' || href end as detail_url "
            f"from {_rows_sql(src, keys)} r where len(cells) >= 2 and cells[1] <> '{K.WHOIS_HEADER_CELL}')")


CATS_SQL = (
    "dcat as (select url, pos, cells, case when len(cells) = 1 then cells[1] end as open, "
    f"coalesce(last_value(case when len(cells) = 1 then cells[1] end ignore nulls) over (partition by url order by pos "
    f"rows between unbounded preceding and current row), '{K.WHOIS_DEFAULT_CATEGORY}') as category "
    f"from {_rows_sql('whois_details', 'url')} r where len(cells) >= 1),\n"
    "lastopen as (select url, open as category, max(pos) as open_pos from dcat where open is not null group by url, open),\n"
    "kv as (select d.url, d.category, d.pos, regexp_replace(d.cells[1], '[ :]+$', '') as field, d.cells[2] as value "
    "from dcat d left join lastopen l on l.url = d.url and l.category = d.category "
    "where len(d.cells) >= 2 and (l.open_pos is null or d.pos > l.open_pos)),\n"
    "cats as (select url, category, field, arg_max(value, pos) as value from kv group by url, category, field)")

SCAN_SQL = (
    "srch as " + _search_sql("whois_pages_both", "root, zone") + ",\n"
    "scan as (select t.target_seq, t.target, s.* from (select target_seq, target, string_split(replace(target, '.bo', ''), '.')[1] as root "
    "from whois_targets) t join srch s on s.root = t.root qualify row_number() over (partition by t.target_seq, s.dominio "
    f"order by case when s.zone = '{K.WHOIS_ZONES[0]}' then 0 else 1 end, s.pos) = 1)")


@register("html_first_table", _compose(
    f"select page_id, pos, array_to_string(cells, '|') as cells, href from {_rows_sql('whois_pages', 'page_id')} r",
    [], ("whois_pages",)))
def q_html_first_table(spark, sf):
    rows = W.html_first_table(X.whois_pages(spark, sf), ("page_id",))
    return rows.select("page_id", "pos", F.array_join("cells", "|").alias("cells"), "href")


@register("filter_min_cells", _compose(
    f"select page_id, pos, len(cells) as n_cells from {_rows_sql('whois_pages', 'page_id')} r "
    f"where len(cells) >= 2 and cells[1] <> '{K.WHOIS_HEADER_CELL}'", [], ("whois_pages",)))
def q_filter_min_cells(spark, sf):
    rows = W.html_first_table(X.whois_pages(spark, sf), ("page_id",))
    kept = rows.where((F.size("cells") >= 2) & (F.col("cells")[0] != K.WHOIS_HEADER_CELL))
    return kept.select("page_id", "pos", F.size("cells").cast("long").alias("n_cells"))


@register("whois_search_rows", _compose(
    "select * from " + _search_sql("whois_pages", "page_id, root, zone") + " s", [], ("whois_pages",)))
def q_whois_search_rows(spark, sf):
    return W.whois_search_rows(X.whois_pages(spark, sf), ("page_id", "root", "zone"))


@register("whois_categories", _compose("select url, category, field, value from cats", [CATS_SQL], ("whois_details",)))
def q_whois_categories(spark, sf):
    return W.whois_categories(X.whois_details(spark, sf), "url")


@register("whois_dedup", _compose(
    "select root, zone, pos, dominio from " + _search_sql("whois_pages_both", "root, zone")
    + f" s qualify row_number() over (partition by root, dominio order by case when zone = '{K.WHOIS_ZONES[0]}' then 0 else 1 end, pos) = 1",
    [], ("whois_pages_both",)))
def q_whois_dedup(spark, sf):
    rows = W.whois_search_rows(X.whois_pages(spark, sf, both_zones=True))
    return W.whois_dedup(rows, by="root").select("root", "zone", "pos", "dominio")


@register("whois_scan", _compose(
    "select target_seq, zone, dominio, estado, precio, detail_url from scan", [SCAN_SQL], ("whois_targets", "whois_pages_both")))
def q_whois_scan(spark, sf):
    scan = W.whois_scan(X.whois_targets(spark, sf), X.whois_pages(spark, sf, both_zones=True))
    return scan.select("target_seq", "zone", "dominio", "estado", "precio", "detail_url")


@register("join_whois_detail", _compose(
    "select s.target_seq, s.dominio, c.category, c.field, c.value from scan s left join cats c on c.url = s.detail_url",
    [SCAN_SQL, CATS_SQL], ("whois_targets", "whois_pages_both", "whois_details")))
def q_join_whois_detail(spark, sf):
    scan = W.whois_scan(X.whois_targets(spark, sf), X.whois_pages(spark, sf, both_zones=True))
    j = W.join_whois_detail(scan, X.whois_details(spark, sf))
    return j.select("target_seq", "dominio", "category", "field", "value")


# pages that could not be fetched: (every, at) of the page number, for search and for detail pages
SEARCH_ERRORS, DETAIL_ERRORS = (17, 5), (19, 3)
_ERROR = "'503 Server Error for page ' || {p}"
_ZONE = "case when {z} = '" + K.WHOIS_ZONES[0] + "' then 0 else 1 end"
ENV_SQL = (
    f"okpages as (select * from whois_pages_both where page_id % {SEARCH_ERRORS[0]} <> {SEARCH_ERRORS[1]}),\n"
    "esrch as " + _search_sql("okpages", "root, zone") + ",\n"
    "broken as (select root, " + _ZONE.format(z="zone") + " as z, -1 as pos, " + _ERROR.format(p="page_id") + " as error from whois_pages_both "
    f"where page_id % {SEARCH_ERRORS[0]} = {SEARCH_ERRORS[1]} union all select s.root, " + _ZONE.format(z="s.zone") + ", s.pos, "
    + _ERROR.format(p="d.page_id") + f" from esrch s join whois_details d on d.url = s.detail_url where d.page_id % {DETAIL_ERRORS[0]} = {DETAIL_ERRORS[1]}),\n"
    "wt as (select target_seq, target, string_split(replace(target, '.bo', ''), '.')[1] as root from whois_targets),\n"
    "wfail as (select t.target_seq, t.target, b.error from wt t join (select root, arg_min(error, (z, pos, error)) as error from broken group by root) b "
    "on b.root = t.root),\n"
    "wkept as (select * from wt where target_seq not in (select target_seq from wfail)),\n"
    "escan as (select t.target_seq, t.target, s.* from wkept t join esrch s on s.root = t.root qualify row_number() over "
    "(partition by t.target_seq, s.dominio order by " + _ZONE.format(z="s.zone") + ", s.pos) = 1)")

WHOIS_KEYS = ("whois_detalles_Contacto_Ciudad", "whois_detalles_Contacto_Tel_Casa", "whois_detalles_General_Titular",
              "whois_dominio", "whois_estado", "whois_precio")


ENVELOPE_WHOIS_BODY = (
    f"select s.target_seq, '{TS}' as timestamp, 'whois_bo' as action, s.target, true as ok, '200' as status, '' as error, "
    "max(case when c.category = 'Contacto' and c.field = 'Ciudad' then c.value end) as whois_detalles_Contacto_Ciudad, "
    # Contacto / Tel_Casa and Contacto_Tel / Casa join to one path; the later category's value counts
    "coalesce(max(case when c.category = 'Contacto_Tel' and c.field = 'Casa' then c.value end), "
    "max(case when c.category = 'Contacto' and c.field = 'Tel_Casa' then c.value end)) as whois_detalles_Contacto_Tel_Casa, "
    "max(case when c.category = 'General' and c.field = 'Titular' then c.value end) as whois_detalles_General_Titular, "
    "s.dominio as whois_dominio, s.estado as whois_estado, s.precio as whois_precio "
    "from escan s left join cats c on c.url = s.detail_url group by all "
    f"union all select target_seq, '{TS}', 'whois_bo', target, false, '404', '{K.MSG_WHOIS_NONE}', null, null, null, null, null, null "
    "from wkept t where not exists (select 1 from escan s where s.target_seq = t.target_seq) "
    f"union all select target_seq, '{TS}', 'whois_bo', target, false, '500', error, null, null, null, null, null, null from wfail")


def envelope_inputs(spark, sf):
    """Targets, search pages and detail pages, some of which could not be fetched."""
    return (X.whois_targets(spark, sf), X.whois_errors(X.whois_pages(spark, sf, both_zones=True), *SEARCH_ERRORS),
            X.whois_errors(X.whois_details(spark, sf), *DETAIL_ERRORS))


@register("envelope_whois", _compose(ENVELOPE_WHOIS_BODY, [ENV_SQL, CATS_SQL],
                                     ("whois_targets", "whois_pages_both", "whois_details")))
def q_envelope_whois(spark, sf):
    return W.envelope_whois(*envelope_inputs(spark, sf), TS)
