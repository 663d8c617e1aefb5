"""Certificate-entry operators: dedup, name explode, filters, per-domain analysis.

Shuffle map (for a cluster run):
* ``dedup_certs`` / ``first_owned_entries`` - one pass: the first row per certificate within each task,
  then one shuffle of those rows with the columns the caller selects.
* ``domain_analysis`` / ``distinct_domains`` - one shuffle on ``domain`` with a
  partial aggregate first; a domain holding a third of all rows is reduced map-side.
* filters and ``entry_names`` are narrow (no shuffle) and run inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sanscope.functions import names as N
from sanscope.session import materialize



def with_cert_id(entries: DataFrame) -> DataFrame:
    """Add ``cert_id = min_cert_id or id``."""
    return entries.withColumn("cert_id", N.cert_id("min_cert_id", "id"))


def dedup_certs(entries: DataFrame, by: Sequence[str] = (), order_col: str = "entry_seq") -> DataFrame:
    """First entry per ``cert_id`` (in ``order_col`` order, unique per entry) within each ``by``
    group; entries without an id are dropped."""
    if "cert_id" not in entries.columns:
        entries = with_cert_id(entries)
    return _first_rows(entries, [*by, "cert_id"], [order_col])


def _first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key; rows with a null in the last key go. One read: each task keeps the first row
    of its keys before the shuffle (a pushed-down group limit), so a key that holds a third of
    all rows costs a row per task, and columns nobody selects are neither read nor moved."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.where(F.col(keys[-1]).isNotNull()).withColumn("_place", place).where("_place = 1").drop("_place")


def entry_names(entries: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per normalised name of an entry: the ``name_value`` lines, then
    ``common_name`` (not split). Invalid/blank names dropped, duplicates kept.
    ``name_pos`` is the 0-based position of the name in that list."""
    names = F.concat(N.split_names("name_value"), F.array(F.col("common_name")))
    base = [F.col(c) for c in entries.columns if c not in ("name_value", "common_name")] if not keep else [F.col(c) for c in keep]
    # a generator's output is computed once: a filter on a projected name would compute it again below the projection
    exploded = entries.select(*base, F.posexplode_outer(F.transform(names, N.normal_text)).alias("name_pos", "domain"))
    return exploded.where(F.col("domain") != "")


def domain_analysis(named: DataFrame, as_of: str) -> DataFrame:
    """Per domain: level, first_seen = min(not_before), last_seen = max(not_after),
    is_active against ``as_of``. Output is the analysis CSV schema."""
    agg = named.groupBy("domain").agg(
        F.min(N.parse_cert_time("not_before")).alias("first_ts"),
        F.max(N.parse_cert_time("not_after")).alias("last_ts"),
    )
    return agg.select(
        "domain",
        N.domain_level("domain").alias("level"),
        N.iso_date("first_ts").alias("first_seen"),
        N.iso_date("last_ts").alias("last_seen"),
        N.is_active("last_ts", as_of).alias("is_active"),
    )


def distinct_domains(named: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return named.select(*by, "domain").distinct()


def _name_list(entries_name_value: str = "name_value", common_name: str = "common_name") -> Column:
    return F.filter(F.concat(N.split_names(entries_name_value), F.array(F.col(common_name))), lambda x: x.isNotNull())


def _search_names() -> Column:
    """The entry's names as searches see them: stripped (few have anything to strip) and lower-cased."""
    return F.transform(_name_list(), lambda n: F.lower(F.when(n.rlike(N.EDGE_SPACE_RE), N.py_strip(n)).otherwise(n)))


def identity_match(term: str, mode: str, names: Column | None = None) -> Column:
    """Does any name of the entry match ``term`` the way the certificate search does?

    modes: ``identity`` (name equals the domain or is below it, case-insensitive),
    ``keyword`` (``%kw%``), ``subdomain`` (``%.t``), ``extended`` (``t.%.%``)."""
    t = term.lower()
    if mode == "identity":
        pred = lambda n: (n == F.lit(t)) | n.endswith(F.lit("." + t))
    elif mode == "keyword":
        pred = lambda n: F.like(n, N.like_contains(t))
    elif mode == "subdomain":
        pred = lambda n: F.like(n, N.like_subdomain(t))
    elif mode == "extended":
        pred = lambda n: F.like(n, N.like_extended(t))
    else:
        raise ValueError(f"unknown match mode {mode!r}")
    return F.exists(_search_names() if names is None else names, pred)


def match_cert_identity(entries: DataFrame, searches: Sequence[tuple[str, str]], ords: Sequence[int] | None = None) -> DataFrame:
    """Certificate-level search: an entry is returned by search ``i`` when any of its
    names matches; then all its names come along. One scan for all searches: each
    entry gets the array of search ordinals it satisfies, exploded (no join). ``ords`` restricts the
    run to some of the searches. (``indexes.match_search_table`` takes thousands of searches.)"""
    named = entries.withColumn("_names", F.explode_outer(F.array(_search_names())))  # computed once, for all searches
    hits = F.array(*[F.when(identity_match(term, mode, F.col("_names")), F.lit(i)) for i, (mode, term) in enumerate(searches)
                     if ords is None or i in ords])
    return explode_ords(named, hits).drop("_names")


def text_hits(entries: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(query_ord, entry row) for every term contained in the lower-cased
    ``name_value + '\\n' + common_name`` text (the stored search responses)."""
    text = F.lower(F.concat(F.coalesce("name_value", F.lit("")), F.lit("\n"), F.coalesce("common_name", F.lit(""))))
    hits = F.array(*[F.when(F.like(text, N.like_contains(t)), F.lit(i)) for i, t in enumerate(terms)])
    return explode_ords(entries, hits)


def explode_ords(df: DataFrame, hits: Column, out: str = "query_ord") -> DataFrame:
    """One row per non-null ordinal of ``hits``. ``explode_outer`` + null filter keeps the
    optimizer from inferring a ``size > 0`` filter that would evaluate every match
    predicate a second time below the projection."""
    return df.withColumn(out, F.explode_outer(F.array_compact(hits))).where(F.col(out).isNotNull())


def first_query_owner(hits: DataFrame, key: str = "cert_id", order: str = "query_ord") -> DataFrame:
    """Keep only the rows of the first query (smallest ``order``) that returned each key.

    The owner per key is a partial+final ``min`` (map-side combined, so a certificate
    holding a third of all rows is reduced before the shuffle); rows are then kept by a
    semi join on (key, owner), which AQE splits when one key is skewed."""
    owners = hits.groupBy(key).agg(F.min(order).alias(order))
    return hits.join(owners, [key, order], "left_semi")


def first_owned_entries(hits: DataFrame, key: str = "cert_id", by: str = "query_ord",
                        order_col: str = "entry_seq") -> DataFrame:
    """``dedup_certs`` per search followed by ``first_query_owner``: per certificate, the first
    entry of the first search that returned it, in one pass."""
    return _first_rows(hits, [key], [by, order_col])


def filter_levels(named: DataFrame, max_level: Column) -> DataFrame:
    """Keep names with at most ``max_level`` dots (``--levels``)."""
    return named.where(N.domain_level("domain") <= max_level)


def filter_private_suffix(named: DataFrame, suffix: Column) -> DataFrame:
    """Extended mode: the private suffix must equal one non-empty label of the name."""
    return named.where(N.has_label("domain", suffix))


def filter_not_expired(entries: DataFrame, as_of: str, col: str = "not_after") -> DataFrame:
    """``exclude=expired``: certificate still valid at ``as_of``."""
    return entries.where(N.parse_cert_time(col) > N.utc_time(F.lit(as_of)))


def running_sum(df: DataFrame, by: str, order: str, value: str, out: str, width: int = 1 << 16,
                levels: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` within ``by`` in ``order`` order (``order`` unique
    within ``by``, non-negative integers) without any window partition larger than
    ``width`` rows: sums inside buckets of ``width`` consecutive order values, plus
    offsets = the running sum over the bucket totals, computed the same way one level up.

    The input feeds every level, so it is checkpointed once (to ``spark.checkpoint.dir``;
    this also cuts the lineage); the number of levels is then the smallest with
    ``width ** levels > max(order)``, read from the checkpointed rows."""
    df = materialize(df, "running-sum")
    if levels is None:
        top = int(df.agg(F.max(order)).first()[0] or 0)
        levels = 1
        while width ** levels <= top:
            levels += 1
    return _running_sum(df, by, order, value, out, width, levels, 0)


def _running_sum(df: DataFrame, by: str, order: str, value: str, out: str, width: int, levels: int,
                 level: int) -> DataFrame:
    if level == levels - 1:
        # top level: order values are below ``width`` here, so a group holds < width rows
        w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(w))
    b, loc, tot, off = f"_b{level}", f"_loc{level}", f"_t{level}", f"_o{level}"
    d = df.withColumn(b, F.floor(F.col(order) / F.lit(width)))
    w = Window.partitionBy(by, b).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn(loc, F.sum(value).over(w))
    totals = d.groupBy(by, b).agg(F.sum(value).alias(tot))
    runs = _running_sum(totals, by, b, tot, f"_r{level}", width, levels, level + 1)
    offsets = runs.select(by, b, (F.col(f"_r{level}") - F.col(tot)).alias(off))
    return local.join(offsets, [by, b]).withColumn(out, F.col(loc) + F.col(off)).drop(b, loc, off)


def novelty_curve(named_first: DataFrame, by: str = "query_ord", order: str = "entry_seq",
                  bucket_width: int = 1 << 16) -> DataFrame:
    """'New domains found: n. Total: m' per certificate, only where n > 0.

    ``named_first``: (by, order, domain) for the names each query kept. A domain is
    new at the first ``order`` it appears in its query; the totals are a bounded-partition
    running sum (``running_sum``) - no global or per-search single-task window."""
    firsts = named_first.groupBy(by, "domain").agg(F.min(order).alias(order))
    per_entry = firsts.groupBy(by, order).agg(F.count("*").alias("new_domains"))
    return running_sum(per_entry, by, order, "new_domains", "total_domains", bucket_width).select(
        by, order, "new_domains", "total_domains")
