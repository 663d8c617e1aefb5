"""Name choice on decoded certificates: DNS subject-alternative names, else the first
common name. (The X.509 decoding itself is not built; the decoded fields are a table.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sanscope.functions import names as N
from sanscope.sources import fixtures as X


def decoded_certificates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(sans(cert_id, pos, san_type, value), subjects(cert_id, cn)) derived from the name rows:
    some certificates carry no DNS name at all, some have an invalid common name."""
    rows = X.name_rows(spark, sf)
    sans = rows.select(
        F.col("l_orderkey").alias("cert_id"), F.col("l_linenumber").alias("pos"),
        F.when((F.col("l_orderkey") % 11 == 0) | (F.col("l_partkey") % 5 == 0), F.lit("IP Address"))
        .otherwise(F.lit("DNS")).alias("san_type"),
        F.col("name").alias("value"))
    subjects = rows.groupBy(F.col("l_orderkey").alias("cert_id")).agg(F.max("host").alias("_cn")).select(
        "cert_id", F.when(F.col("cert_id") % 13 == 0, F.lit("Bad Name!")).otherwise(F.col("_cn")).alias("cn"))
    return sans, subjects


def san_or_cn(sans: DataFrame, subjects: DataFrame) -> DataFrame:
    """(cert_id, domain): the valid normalised DNS SANs; for a certificate without any,
    its first common name when that is valid. An anti join finds the fallback
    certificates, so no certificate's names are gathered into one row."""
    dns = sans.where(F.col("san_type") == "DNS").select("cert_id", N.normalize_domain("value").alias("domain")).where(
        F.col("domain").isNotNull())
    fallback = subjects.join(dns.select("cert_id").distinct(), "cert_id", "left_anti").select(
        "cert_id", N.normalize_domain("cn").alias("domain")).where(F.col("domain").isNotNull())
    return dns.unionByName(fallback)
