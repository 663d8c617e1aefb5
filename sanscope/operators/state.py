"""Seen-certificate state: anti join, set difference, merge.

The state can outgrow any broadcast limit (every id ever seen), so no broadcast is
forced: AQE picks broadcast-hash when the runtime size is small and a sort-merge
(or shuffled-hash) anti join otherwise. Keys are compared as strings, like the
saved text file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anti_seen(entries: DataFrame, seen: DataFrame, id_col: str = "cert_id", seen_col: str = "cert_id") -> DataFrame:
    """Drop entries whose id (as text) is in the saved state."""
    keyed = entries.withColumn("_cert_key", F.col(id_col).cast("string"))
    s = seen.select(F.col(seen_col).alias("_cert_key"))
    return keyed.join(s, "_cert_key", "left_anti").drop("_cert_key")


def except_seen(ids: DataFrame, seen: DataFrame, col: str = "cert_id") -> DataFrame:
    """EXCEPT DISTINCT on the id column."""
    return ids.select(F.col(col).cast("string").alias(col)).subtract(seen.select(F.col(col).cast("string").alias(col)))


def state_merge(known: DataFrame, processed: DataFrame, col: str = "cert_id") -> DataFrame:
    """known U processed, as a set of strings."""
    return known.select(F.col(col).cast("string").alias(col)).union(
        processed.select(F.col(col).cast("string").alias(col))).distinct()


def load_seen(spark, path: str | None) -> DataFrame:
    """Saved state: stripped non-blank lines; a missing file is an empty state."""
    from sanscope.sources.readers import read_seen_ids

    return read_seen_ids(spark, path)
