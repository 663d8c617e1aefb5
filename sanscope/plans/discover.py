"""Discovery runs: stored search responses -> per-search dedup -> saved-state filter ->
names -> suffix / level filters -> distinct domains.

A run is one command line: a list of searches of one kind (domains or keywords)
processed in order. Search terms are command-line parameters, so they become
literals in the plan; everything that grows with the data stays in DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sanscope.functions import names as N
from sanscope.operators import certs as C
from sanscope.operators import identities as I
from sanscope.operators import state, suffix
from sanscope.session import materialize

Search = tuple[str, str]  # (kind, term) with kind 'domain' or 'keyword'


def _ords(searches: Sequence[Search], kind: str | None) -> list[int]:
    return [i for i, (k, _) in enumerate(searches) if kind is None or k == kind]


def _by_ord(values: dict[int, object]) -> Column:
    """Literal lookup ``query_ord -> value`` (a CASE over the command-line searches)."""
    expr = None
    for i, v in values.items():
        expr = (F.when(F.col("query_ord") == i, F.lit(v)) if expr is None
                else expr.when(F.col("query_ord") == i, F.lit(v)))
    return expr if expr is not None else F.lit(None)


def responses(entries: DataFrame, searches: Sequence[Search], kind: str | None) -> DataFrame:
    """Stored responses: the entries each search returned, tagged with ``query_ord``.

    Snapshots that already carry ``query_ord`` (one stored response per search) are used
    as they are; otherwise each entry is tagged with every search it answers: a domain search
    returns certificates with a name equal to or below the domain, a keyword search those with a
    name that contains it (one scan, no join)."""
    ords = _ords(searches, kind)
    if "query_ord" in entries.columns:
        return entries.where(F.col("query_ord").isin(ords)) if kind is not None else entries
    return C.match_cert_identity(entries, [("identity" if k == "domain" else k, t) for k, t in searches], ords)


def run_names(spark: SparkSession, entries: DataFrame, searches: Sequence[Search], kind: str | None,
              seen: DataFrame | None, exclude_expired: str | None = None) -> DataFrame:
    """Names of one run. ``exclude_expired`` is the time at which a certificate must still be valid. With ``seen`` (``--uncached``) saved ids are skipped and a
    certificate only counts for the first search that returned it (the state is
    saved after each search)."""
    if exclude_expired is not None:
        entries = C.filter_not_expired(entries, exclude_expired)
    hits = responses(entries, searches, kind)
    if seen is not None:
        # the saved state does not depend on the search, so it is applied after the
        # combined dedup + first-owner aggregate (one row per certificate left to join)
        ded = state.anti_seen(C.first_owned_entries(hits), seen)
    else:
        ded = C.dedup_certs(hits, by=["query_ord"])
    terms = {i: t for i, (_, t) in enumerate(searches) if i in set(_ords(searches, kind))}
    ded = ded.withColumn("term", _by_ord(terms))
    return C.entry_names(ded, keep=("query_ord", "entry_seq", "cert_id", "term", "not_before", "not_after"))


def level_bounds(searches: Sequence[Search], levels: int, base: dict[int, str] | None = None) -> dict[int, int]:
    """``dots(query_domain) + levels`` per search; ``base`` overrides the query domain
    (the private suffix in extended mode)."""
    out = {}
    for i, (_, t) in enumerate(searches):
        q = (base or {}).get(i) or t
        out[i] = q.count(".") + levels
    return out


def discover_domains(spark: SparkSession, entries: DataFrame, searches: Sequence[Search], seen: DataFrame | None,
                     levels: int | None = None, distinct: bool = True, exclude_expired: str | None = None) -> DataFrame:
    """``-d`` run over the domain searches (plain pass)."""
    named = run_names(spark, entries, searches, "domain", seen, exclude_expired)
    if levels is not None:
        bounds = {i: b for i, b in level_bounds(searches, levels).items() if searches[i][0] == "domain"}
        named = C.filter_levels(named, _by_ord(bounds))
    return C.distinct_domains(named) if distinct else named


def discover_keyword(spark: SparkSession, entries: DataFrame, searches: Sequence[Search], seen: DataFrame | None,
                     distinct: bool = True, exclude_expired: str | None = None) -> DataFrame:
    """``-k`` run: no suffix or level filters (``--levels`` is ignored for keywords)."""
    named = run_names(spark, entries, searches, "keyword", seen, exclude_expired)
    return C.distinct_domains(named) if distinct else named


def discover_extended(spark: SparkSession, entries: DataFrame, domains: Sequence[str], rules: DataFrame | None,
                      seen: DataFrame | None = None, levels: int | None = None, exclude_expired: str | None = None) -> DataFrame:
    """``--extended``: for each domain a plain pass (identity search) and an extended pass
    (``ps.%.%`` search, names must carry the private-suffix label), all as one set.

    With ``seen`` saved ids are skipped and a certificate counts for the first pass that returned
    it only: domain 1 plain, domain 1 extended, domain 2 plain and so on, as the state grows."""
    private = suffix.private_suffix_of_terms(spark, list(domains), rules)
    passes = [p for d, ps in zip(domains, private) for p in (("identity", d), ("extended", ps))]
    if exclude_expired is not None:
        entries = C.filter_not_expired(entries, exclude_expired)
    hits = C.match_cert_identity(C.with_cert_id(entries) if "cert_id" not in entries.columns else entries, passes)
    if seen is not None:
        ded = state.anti_seen(C.first_owned_entries(hits), seen)
    else:
        ded = C.dedup_certs(hits, by=["query_ord"])
    named = C.entry_names(ded, keep=("query_ord", "entry_seq"))
    labels = _by_ord({2 * k + 1: ps for k, ps in enumerate(private)})
    named = named.where((F.col("query_ord") % 2 == 0) | F.coalesce(N.has_label("domain", labels), F.lit(False)))
    if levels is not None:
        base = {2 * k: d for k, d in enumerate(domains)} | {2 * k + 1: ps or d for k, (d, ps) in enumerate(zip(domains, private))}
        named = C.filter_levels(named, _by_ord({i: b.count(".") + levels for i, b in base.items()}))
    return C.distinct_domains(named)


def label_hits(domains: DataFrame, labels_by_ord: dict[int, str]) -> DataFrame:
    """(query_ord, domain) for every search whose private-suffix label the domain carries.
    One pass, no join: each name gets the array of matching search ordinals."""
    hits = F.array(*[F.when(N.has_label("domain", lab), F.lit(i)) for i, lab in labels_by_ord.items()])
    return domains.withColumn("query_ord", F.explode_outer(F.array_compact(hits))).where(
        F.col("query_ord").isNotNull())


def certificate_log(entries: DataFrame, searches: Sequence[Search], kinds: Sequence[str] = ("domain", "keyword")) -> DataFrame:
    """Raw rows written to the JSONL log: every response entry, undeduplicated and
    repeated for every search that returned it."""
    hits = responses(entries, searches, None)
    ords = [i for i, (k, _) in enumerate(searches) if k in kinds]
    cols = [c for c in entries.columns if c not in ("query_ord", "cert_id")]  # entries are logged whole
    return hits.where(F.col("query_ord").isin(ords)).select("query_ord", *cols)


# ---------------------------------------------------------------- database flavour
@dataclass(frozen=True)
class DbPass:
    """One database query of a run. ``term`` is the query text (the private suffix in an extended pass), ``label``
    what an extended pass asks of every name."""

    kind: str
    term: str
    label: str | None = None

    def predicate(self, col: str = "name_value", levels: int | None = None) -> Column:
        row = I.identity_domain_match(col, self.term) if self.kind == "domain" else I.identity_keyword_match(col, self.term)
        if levels is None or self.kind != "domain":
            return row
        return row & (N.raw_level(col) <= self.term.count(".") + levels)

    def implies_fulltext(self) -> bool:
        """A name that ends in a term of plain labels holds the term's words itself."""
        return self.kind == "domain" and bool(self.term) and set(self.term) <= set("abcdefghijklmnopqrstuvwxyz0123456789-.")


def db_passes(spark: SparkSession, searches: Sequence[Search], kind: str | None = None, extended: bool = False,
              rules: DataFrame | None = None) -> list[DbPass]:
    """The queries of a run in their order: for each search its own, and with ``extended`` one for the
    private suffix of each domain after the domain's."""
    chosen = [s for s in searches if kind is None or s[0] == kind]
    domains = [t for k, t in chosen if k == "domain"]
    private = dict(zip(domains, suffix.private_suffix_of_terms(spark, domains, rules))) if extended and domains else {}
    out = []
    for k, t in chosen:
        out.append(DbPass(k, t))
        if extended and k == "domain":
            out.append(DbPass(k, private[t] or t, private[t]))
    return out


def db_rows(identities: DataFrame, ca: DataFrame, passes: Sequence[DbPass], seen: DataFrame | None = None,
            limit: int | None = None, levels: int | None = None) -> DataFrame:
    """What the database returns and the run keeps: full text AND row filter (AND raw level) -> optional LIMIT per
    pass -> issuer -> saved-state filter. (query_ord, *identity columns, issuer_name); ``query_ord`` numbers
    the passes. Without ``limit`` all rows count. With ``seen`` a certificate belongs to the first
    pass that returned it, as the state is saved after each."""
    rows = I.tag_matches(identities, {i: p.predicate(levels=levels) for i, p in enumerate(passes)})
    asked = [i for i, p in enumerate(passes) if not p.implies_fulltext()]
    if asked:
        ft = I.fulltext_certificates(identities, [passes[i].term for i in asked])
        number = F.array(*[F.lit(i) for i in asked])
        ft = ft.select("certificate_id", F.element_at(number, F.col("query_ord") + 1).alias("query_ord"))
        implied = [i for i in range(len(passes)) if i not in asked]
        held = rows.where(F.col("query_ord").isin(asked)).join(ft, ["certificate_id", "query_ord"], "left_semi")
        rows = held.unionByName(rows.where(F.col("query_ord").isin(implied))) if implied else held
    if limit is not None:
        if len(passes) > 1:
            # every pass takes its own first rows: write the matches once instead of finding them per pass
            rows = materialize(rows, "db-matches")
        rows = I.limit_identities(rows, limit, by="query_ord", ords=range(len(passes)))
    rows = I.join_issuer(rows, ca)
    if seen is not None:
        rows = C.first_query_owner(state.anti_seen(rows, seen, id_col="certificate_id"), key="certificate_id")
    return rows


def db_names(rows: DataFrame, passes: Sequence[DbPass]) -> DataFrame:
    """(query_ord, certificate_id, not_before, not_after, domain): the rows' names, split and normalised; an extended
    pass keeps those that carry its private-suffix label."""
    named = I.split_identity_names(rows, keep=("query_ord", "certificate_id", "not_before", "not_after"))
    labels = {i: p.label for i, p in enumerate(passes) if p.label is not None}
    if not labels:
        return named
    return named.where(~F.col("query_ord").isin(list(labels)) | F.coalesce(N.has_label("domain", _by_ord(labels)), F.lit(False)))


def discover_db(spark: SparkSession, identities: DataFrame, ca: DataFrame, searches: Sequence[Search], seen: DataFrame | None = None,
                kind: str | None = None, limit: int | None = None, levels: int | None = None, extended: bool = False,
                rules: DataFrame | None = None) -> DataFrame:
    """A run against the identity tables for any searches: ``db_names`` of its rows."""
    passes = db_passes(spark, searches, kind, extended, rules)
    return db_names(db_rows(identities, ca, passes, seen, limit, levels), passes)


def certificate_log_db(rows: DataFrame) -> DataFrame:
    """The raw log of a database run: four fields per returned row that the saved state didn't hold."""
    return rows.select("query_ord", "certificate_id", "name_value", "not_before", "not_after", "issuer_name")
