"""Registry search pages -> domain rows, detail pages -> category/key/value, per target.

Pages are parsed per row, a page's headings and fields with it: no shuffle before the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sanscope import constants as K
from sanscope.functions import html as H
from sanscope.functions import names as N
from sanscope.functions import targets as T
from sanscope.operators.envelopes import head, widen


def html_first_table(pages: DataFrame, keys=("page_id",), html_col: str = "html") -> DataFrame:
    """(keys..., pos, cells, href) for the rows of each page's first table; a page
    without a table gives no rows."""
    ex = pages.select(*keys, F.explode_outer(H.table_rows(html_col)).alias("_r")).where(F.col("_r").isNotNull())
    return ex.select(*keys, F.col("_r.pos").alias("pos"), F.col("_r.cells").alias("cells"), F.col("_r.href").alias("href"))


def whois_search_rows(pages: DataFrame, keys=("root", "zone")) -> DataFrame:
    """Search-result rows: rows with >= 2 cells, header row dropped; ``precio`` when a
    third cell exists; ``detail_url`` when the row's first link is a detail link."""
    rows = html_first_table(pages, keys)
    rows = rows.where((F.size("cells") >= 2) & (F.col("cells")[0] != K.WHOIS_HEADER_CELL))
    detail = F.col("href").contains(K.WHOIS_DETAIL_MARKER)
    return rows.select(
        *keys, "pos", F.col("cells")[0].alias("dominio"), F.col("cells")[1].alias("estado"),
        F.when(F.size("cells") >= 3, F.col("cells")[2]).alias("precio"),
        F.when(detail, T.resolve_link(F.lit(K.WHOIS_BASE_URL), F.col("href"))).alias("detail_url"),
    )


def whois_categories(details: DataFrame, key: str = "url") -> DataFrame:
    """(key, category, field, value): one-cell rows open a category (default 'General';
    re-opening one empties it); rows with >= 2 cells are ``field -> value`` with the
    field right-stripped of ' :'; the last duplicate field wins."""
    found = details.select(key, F.explode_outer(H.table_fields("html", K.WHOIS_DEFAULT_CATEGORY)).alias("_f"))
    return found.where(F.col("_f").isNotNull()).select(key, "_f.*")


def whois_dedup(rows: DataFrame, by: str = "target_seq") -> DataFrame:
    """First row per (target, dominio) over the zones in search order ('.ia.bo' then '.bo')."""
    zone_ord = F.when(F.col("zone") == K.WHOIS_ZONES[0], F.lit(0)).otherwise(F.lit(1))
    w = Window.partitionBy(by, "dominio").orderBy(zone_ord, "pos")
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def whois_scan(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets -> root label -> search pages of both zones (equi join on the root) ->
    rows, deduplicated per target."""
    t = targets.select("target_seq", "target", N.root_label("target").alias("root"))
    rows = whois_search_rows(pages)
    return whois_dedup(t.join(rows.hint("merge"), "root"))  # pages are larger than their columns' estimate


def join_whois_detail(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Search rows with a detail link, left-joined to the detail page's categories."""
    cats = whois_categories(details.select(F.col("url").alias("detail_url"), "html"), "detail_url")
    return rows.join(cats, "detail_url", "left")


def _paths(fields: Column) -> Column:
    """Fields -> flattened keys. A category and a field may join to the path of another pair: the place of the
    first and the value of the last count."""
    named = F.transform(fields, lambda f: F.struct(F.concat(F.lit(K.PREFIX_WHOIS + "detalles_"), f["category"], F.lit("_"), f["field"]).alias("key"),
                                                   f["value"].alias("value")))
    keys = F.array_distinct(F.transform(named, lambda x: x["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(named, lambda x: x["key"] == k), -1)["value"].alias("value")))


def failed_targets(targets: DataFrame, pages: DataFrame, details: DataFrame) -> DataFrame:
    """(target_seq, target, error) of the targets one of whose pages could not be fetched: a search page of either
    zone, or a detail page that its rows link to. The first error in the order of the fetches counts."""
    t = targets.select("target_seq", "target", N.root_label("target").alias("root"))
    zone = F.when(F.col("zone") == K.WHOIS_ZONES[0], F.lit(0)).otherwise(F.lit(1)).alias("zone_ord")
    search = pages.where(F.col("error").isNotNull()).select("root", zone, F.lit(-1).alias("pos"), "error")
    linked = whois_search_rows(pages.where(F.col("error").isNull())).where(F.col("detail_url").isNotNull())
    broken = details.where(F.col("error").isNotNull()).select(F.col("url").alias("detail_url"), "error")
    detail = linked.join(broken, "detail_url").select("root", zone, "pos", "error")
    first = search.unionByName(detail).groupBy("root").agg(F.min(F.struct("zone_ord", "pos", "error"))["error"].alias("error"))
    return t.join(first, "root").drop("root")


def envelope_whois(targets: DataFrame, pages: DataFrame, details: DataFrame, ts: str, keys=None, fields: bool = False) -> DataFrame:
    """One row per found domain (``whois_*`` columns), one 404 row per target without results, one 500 row per
    target with a page that could not be fetched (``error`` in the stored pages, where they have that column)."""
    failing = "error" in pages.columns or "error" in details.columns
    none = F.lit(None).cast("string")
    pages = pages if "error" in pages.columns else pages.withColumn("error", none)
    details = details if "error" in details.columns else details.withColumn("error", none)
    flat_type = "array<struct<key:string,value:string>>"
    kept = targets
    if failing:
        failed = failed_targets(targets, pages, details)
        kept = targets.join(failed.select("target_seq"), "target_seq", "left_anti")
    scan = whois_scan(kept, pages.where(F.col("error").isNull()))
    found_fields = details.where(F.col("error").isNull()).select(
        F.col("url").alias("detail_url"), F.explode_outer(F.array(H.table_fields("html", K.WHOIS_DEFAULT_CATEGORY))).alias("_f"))
    rows = scan.join(found_fields.select("detail_url", _paths(F.col("_f")).alias("_dkv")).hint("merge"), "detail_url", "left")

    def one(key: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(K.PREFIX_WHOIS + key).alias("key"), value.alias("value")))

    nothing = F.array().cast(flat_type)
    flat = F.concat(one("dominio", F.col("dominio")), one("estado", F.col("estado")), F.coalesce(F.col("_dkv"), nothing),
                    F.when(F.col("precio").isNotNull(), one("precio", F.col("precio"))).otherwise(nothing))
    out = rows.select("target_seq", *head(ts, "whois_bo", F.lit(True), F.lit("200"), F.lit("")), flat.alias("_flat"))
    missing = kept.join(scan.select("target_seq").distinct(), "target_seq", "left_anti").select(
        "target_seq", *head(ts, "whois_bo", F.lit(False), F.lit("404"), F.lit(K.MSG_WHOIS_NONE)), F.lit(None).cast(flat_type).alias("_flat"))
    out = out.unionByName(missing)
    if failing:
        out = out.unionByName(failed.select("target_seq", *head(ts, "whois_bo", F.lit(False), F.lit("500"), F.col("error")),
                                            F.lit(None).cast(flat_type).alias("_flat")))
    return widen(out, "_flat", keys, fields)
