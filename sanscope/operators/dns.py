"""DNS records of a domain grouped by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanscope import constants as K
from sanscope.functions import parsers as P


def records_by_type(outputs: DataFrame, key: str = "target_seq") -> DataFrame:
    """(key, type_ord, record_type, n_records, records) in the fixed type order; a domain
    without any of those types gets one row with the 'none found' message. The record
    list of one (domain, type) is bounded by one DNS answer. Records are sorted (D9)."""
    ans = outputs.where(F.col("returncode") == 0).select(key, F.explode_outer(P.parse_dig_answer("stdout")).alias("a")).where(
        F.col("a").isNotNull())
    ans = ans.where(F.col("a.type").isin(*K.DNS_REPORT_TYPES))
    grouped = ans.groupBy(key, F.col("a.type").alias("record_type")).agg(
        F.count("*").alias("n_records"),
        F.array_join(F.array_sort(F.collect_list("a.value")), "\n").alias("records"))
    order = F.array(*[F.lit(t) for t in K.DNS_REPORT_TYPES])
    found = grouped.select(key, (F.array_position(order, F.col("record_type")) - 1).cast("int").alias("type_ord"), "record_type",
                           "n_records", "records")
    none = outputs.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").select(
        key, F.lit(None).cast("int").alias("type_ord"), F.lit(None).cast("string").alias("record_type"),
        F.lit(0).cast("long").alias("n_records"), F.lit(K.MSG_NO_COMMON_RECORDS).alias("records"))
    return found.unionByName(none)
