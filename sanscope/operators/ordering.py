"""Global order numbers without a single-task window.

``order_number`` = 0-based position of each row in a total order, in two passes
and without a global window:

1. range-partition by the order columns and sort inside each partition; the
   partition-local rank is the low 33 bits of ``monotonically_increasing_id``;
2. count rows per partition (a table of exactly ``num_partitions`` rows, so its
   broadcast is bounded), turn the counts into offsets, add them.

The range-partitioned frame is written once under ``spark.checkpoint.dir`` and read
back, so both passes see the same partition assignment even after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sanscope.session import ensure_checkpoint_dir, materialize

_LOCAL_BITS = 33


def order_number(df: DataFrame, order_cols: Sequence[str], out_col: str = "order_no",
                 num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    ranged = materialize(
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid")),
        "order-number")
    counts = ranged.groupBy("_pid").agg(F.count("*").alias("_cnt"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
    )
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS)
    return ranged.join(F.broadcast(offsets), "_pid").withColumn(out_col, F.col("_off") + local).drop(
        "_pid", "_mid", "_off")


def batch_number(df: DataFrame, order_cols: Sequence[str], size: int, out_col: str = "batch_no") -> DataFrame:
    """Chunks of ``size`` rows in input order: ``floor(order_no / size)``."""
    numbered = order_number(df, order_cols, "_ord")
    return numbered.withColumn(out_col, F.floor(F.col("_ord") / F.lit(size)).cast("long")).drop("_ord")
