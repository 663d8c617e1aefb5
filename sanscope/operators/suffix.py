"""Private part of a domain from a public-suffix rule table.

Rules: ``com`` (normal), ``*.ck`` (wildcard: one more label), ``!www.ck``
(exception: one label fewer, wins over everything). No matching rule -> the last
label is the public suffix. The private part is the domain without ``.suffix``; a
domain that is itself a suffix stays whole.

Plan: each domain explodes into its <= n label suffixes, equi-joined to the rule
table (broadcast or shuffled by size, as the optimizer decides), then one partial+final
aggregate per domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sanscope.functions import names as N


def rule_table(rules: DataFrame, rule_col: str = "rule") -> DataFrame:
    r = F.col(rule_col)
    return rules.select(
        F.when(r.startswith("!"), F.substring(r, 2, 1 << 20))
        .when(r.startswith("*."), F.substring(r, 3, 1 << 20)).otherwise(r).alias("body"),
        F.when(r.startswith("!"), F.lit(-1)).when(r.startswith("*."), F.lit(1)).otherwise(F.lit(0)).alias("delta"),
    )


def public_suffix_len(domains: DataFrame, rules: DataFrame, col: str = "domain") -> DataFrame:
    """(col, ps_len): number of labels of the public suffix of each distinct value."""
    labels = F.split(F.col(col), r"\.", -1)
    cand = domains.select(col).distinct().select(
        col, F.size(labels).alias("_n"),
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                                 lambda k: F.array_join(F.slice(labels, -k, k), "."))).alias("_k0", "_cand"))
    rt = rule_table(rules)
    hit = cand.join(rt, cand["_cand"] == rt["body"], "left").select(
        col, F.when(F.col("body").isNotNull() & (F.col("_k0") + 1 + F.col("delta") <= F.col("_n")),
                    F.col("_k0") + 1 + F.col("delta")).alias("_len"),
        (F.col("delta") == -1).alias("_exc"))
    return hit.groupBy(col).agg(
        F.coalesce(F.max(F.when(F.col("_exc") & F.col("_len").isNotNull(), F.col("_len"))),
                   F.max("_len"), F.lit(1)).alias("ps_len"))


def private_suffix(domains: DataFrame, rules: DataFrame, col: str = "domain") -> DataFrame:
    """(col, private_suffix) for the distinct values of ``col`` (already normalised)."""
    lens = public_suffix_len(domains, rules, col)
    labels = F.split(F.col(col), r"\.", -1)
    n = F.size(labels)
    return lens.select(
        col,
        F.when(F.col("ps_len") >= n, F.col(col))
        .otherwise(F.array_join(F.slice(labels, 1, n - F.col("ps_len")), ".")).alias("private_suffix"),
    )


def private_suffix_of_terms(spark: SparkSession, terms: list[str], rules: DataFrame | None) -> list[str]:
    """Private suffix of a handful of command-line search terms (driver-side parameters:
    the list is as long as the command line). Without rules: drop the last label."""
    if not terms:
        return []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, term string").select(
        "i", N.normalize_domain("term").alias("domain"))
    if rules is None:
        out = df.select("i", F.coalesce(N.fallback_private_suffix("domain"), F.lit("")).alias("ps"))
    else:
        ps = private_suffix(df.where(F.col("domain").isNotNull()), rules)
        out = df.join(ps, "domain", "left").select("i", F.coalesce("private_suffix", F.lit("")).alias("ps"))
    got = {r["i"]: r["ps"] for r in out.collect()}
    return [got.get(i, "") for i in range(len(terms))]
