"""DB-flavour operators over certificate identities (one row per certificate name).

Differences to the HTTP flavour are deliberate: no certificate dedup, no
``common_name``, the level bound counts dots of the *raw* name, and a LIMIT.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanscope.functions import names as N
from sanscope.operators import ordering

LEXEME_SPLIT_RE = r"[^a-z0-9-]+"


def identity_domain_match(col: str, domain: str) -> Column:
    """``NAME_VALUE ILIKE '%.d' OR NAME_VALUE = d`` (the equality is case-sensitive)."""
    return F.ilike(F.col(col), F.lit("%." + domain)) | (F.col(col) == F.lit(domain))


def reversed_labels(col) -> Column:
    """Lower-cased name with its dot labels reversed: ``www.Example.com`` -> ``com.example.www``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.reverse(F.split(F.lower(c), r"\.", -1)), ".")


def with_name_index(identities: DataFrame, col: str = "name_value") -> DataFrame:
    """Add ``rev_name``. Written sorted by it (``write_name_index``), a suffix search
    becomes a prefix search that parquet row-group statistics can prune."""
    return identities.withColumn("rev_name", reversed_labels(col))


def write_name_index(identities: DataFrame, path: str, col: str = "name_value", partitions: int | None = None) -> None:
    """Range-partition and sort by ``rev_name`` so every file and row group covers a
    narrow, ordered slice of the reversed names."""
    df = with_name_index(identities, col)
    df = df.repartitionByRange(partitions, "rev_name") if partitions else df.repartitionByRange("rev_name")
    df.sortWithinPartitions("rev_name").write.mode("overwrite").parquet(path)


def identity_domain_match_indexed(domain: str, col: str = "name_value", rev_col: str = "rev_name") -> Column:
    """``NAME_VALUE ILIKE '%.d' OR NAME_VALUE = d`` on an indexed table: the suffix test
    is ``rev_name LIKE 'd-reversed.%'`` (pushed to parquet as StringStartsWith)."""
    rev = ".".join(reversed(domain.lower().split(".")))
    return F.col(rev_col).startswith(rev + ".") | (F.col(col) == F.lit(domain))


def identity_keyword_match(col: str, keyword: str) -> Column:
    """``NAME_VALUE ILIKE '%kw%' OR NAME_VALUE = kw``."""
    return F.ilike(F.col(col), F.lit("%" + keyword + "%")) | (F.col(col) == F.lit(keyword))


def lexemes(text: str) -> list[str]:
    """Query lexemes: maximal ``[a-z0-9-]`` runs of the lower-cased term (driver-side
    parameter, same rule as ``identity_lexemes``)."""
    import re

    return [t for t in re.split(LEXEME_SPLIT_RE, text.lower()) if t]


def identity_lexemes(col: str) -> Column:
    return F.split(F.lower(F.col(col)), LEXEME_SPLIT_RE, -1)


#: Lexemes that one mask of 64 bits stands for.
MASK_BITS = 63


def fulltext_certificates(identities: DataFrame, searches: Sequence[str], cert_col: str = "certificate_id",
                          name_col: str = "name_value") -> DataFrame:
    """(cert_col, query_ord) for certificates whose identities hold every lexeme of search ``i``.

    Every identity becomes masks with a bit per searched lexeme it holds; their ``bit_or`` per certificate
    is combined map-side (a few integers, no collected token sets), and a certificate matches a search
    when all its bits are set. Identities without any of the lexemes take no part in the shuffle."""
    wanted = sorted({lex for term in searches for lex in lexemes(term)})
    parts = [wanted[k : k + MASK_BITS] for k in range(0, len(wanted), MASK_BITS)] or [[]]

    def mask(held: Column, part: list[str]) -> Column:
        out = F.lit(0).cast("bigint")
        for k, lex in enumerate(part):
            out = out.bitwiseOR(F.when(F.array_contains(held, F.lit(lex)), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return out

    if not wanted:
        return identities.select(cert_col, F.lit(0).alias("query_ord")).where(F.lit(False))
    held = F.array_intersect(identity_lexemes(name_col), F.array(*[F.lit(x) for x in wanted]))
    # a generator's output: computed once, whatever is asked of it
    rows = identities.select(cert_col, F.explode_outer(F.array(held)).alias("_held")).where(F.size("_held") > 0)
    per_cert = rows.groupBy(cert_col).agg(*[F.bit_or(mask(F.col("_held"), part)).alias(f"_m{k}") for k, part in enumerate(parts)])

    def whole(term: str) -> Column:
        out = F.lit(bool(lexemes(term)))
        for k, part in enumerate(parts):
            need = sum(1 << part.index(lex) for lex in set(lexemes(term)) if lex in part)
            if need:
                out = out & (F.col(f"_m{k}").bitwiseAND(F.lit(need).cast("bigint")) == F.lit(need).cast("bigint"))
        return out

    hit = F.array(*[F.when(whole(term), F.lit(i)) for i, term in enumerate(searches)])
    return per_cert.select(cert_col, F.explode_outer(F.array_compact(hit)).alias("query_ord")).where(
        F.col("query_ord").isNotNull())


def filter_fulltext(identities: DataFrame, searches: Sequence[str], cert_col: str = "certificate_id") -> DataFrame:
    """Identities of certificates matching each search, tagged with ``query_ord``
    (semi join back to the identity rows on the certificate id)."""
    certs = fulltext_certificates(identities, searches, cert_col)
    return identities.join(certs, cert_col)


def tag_matches(identities: DataFrame, preds: dict[int, Column]) -> DataFrame:
    """Explode each identity into the searches whose row predicate it satisfies."""
    hit = F.array(*[F.when(p, F.lit(i)) for i, p in preds.items()])
    return identities.withColumn("query_ord", F.explode_outer(F.array_compact(hit))).where(
        F.col("query_ord").isNotNull())


def join_issuer(identities: DataFrame, ca: DataFrame) -> DataFrame:
    """LEFT JOIN ca ON issuer_ca_id = ca.id; the optimizer broadcasts the issuers if their size allows."""
    dim = ca.select(F.col("id").alias("_ca_id"), F.col("name").alias("issuer_name"))
    return identities.join(dim, identities["issuer_ca_id"] == dim["_ca_id"], "left").drop("_ca_id")


def limit_identities(identities: DataFrame, n: int, order: Sequence[str] = ("certificate_id", "name_value"),
                     by: str | None = None, ords: Sequence[int] = ()) -> DataFrame:
    """``LIMIT n`` with a fixed order (the database's order is arbitrary), per search when ``by``
    is given. Every task keeps its own first n rows, the survivors are ranged and numbered: no
    task merges all tasks' rows, however large n is."""
    def first(df: DataFrame) -> DataFrame:
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        own = df.sortWithinPartitions(*order).withColumn("_place", place).where(F.col("_place") < n).drop("_place")
        return ordering.order_number(own, order, "_place").where(F.col("_place") < n).drop("_place")

    if by is None:
        return first(identities)
    parts = [first(identities.where(F.col(by) == o)) for o in ords]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_identity_names(identities: DataFrame, keep: Sequence[str], col: str = "name_value") -> DataFrame:
    """``splitlines()`` of the raw name, each normalised; invalid names dropped."""
    ex = identities.select(*keep, F.explode_outer(N.split_names(col)).alias("_raw"))
    return ex.select(*keep, N.normalize_domain("_raw").alias("domain")).where(F.col("domain").isNotNull())
