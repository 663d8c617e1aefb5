"""Driver tables: one parquet file per table under an ``sf`` directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; callers select only the columns they need so the
    scan's ReadSchema stays pruned."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
