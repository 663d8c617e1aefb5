"""Shared helpers of the training-data operators: scratch tables, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sanscope.session import share_code, state_path

#: White space of the text contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


#: Tasks that write a narrow scratch table, per core of the cluster.
TASKS_PER_CORE = 3


class Scratch:
    """Tables written below ``spark.checkpoint.dir`` to cut lineage.

    ``keep`` writes a frame once as Parquet and reads it back, so a lost executor costs a
    re-read and never a recomputation of non-repeatable work. ``drop`` removes tables that
    no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        share_code(spark)
        self.spark = spark
        self.root = state_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
        self._n = 0

    def keep(self, df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
        """``narrow``: rows of a few numbers. They are written by a few tasks per core instead of one
        small file per shuffle partition; the number follows the cluster."""
        self._n += 1
        if narrow:
            df = df.coalesce(TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism)
        path = f"{self.root}/{self._n:03d}-{label}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(conf).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows: what a Python worker holds beside its input stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def giving_back(run):
    """The same function over batches; at the task's end the worker, which other stages use again, returns
    what it freed to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim is not None:
                trim(0)

    return wrapped


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of an undirected edge list (a, b); component is the least node reachable.

    Alternating large-star and small-star rounds: every round replaces the edges by at most
    as many, all pointing towards smaller nodes, until each component is a star around its
    least node. Minima are partial aggregates and the joins are plain equi joins, so a hub
    with a third of all edges is pre-aggregated and its join partition can be split. Nulls
    and self-links carry no information and are dropped; only nodes with an edge are returned.
    """
    cur = scratch.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct(), "edges", narrow=True)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = scratch.keep(both.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("m"), F.max("v").alias("top"),
            F.sum((F.col("v") < F.col("u")).cast("long")).alias("below")), "neighbours", narrow=True)
        # all stars: no node has two smaller neighbours, or smaller and larger ones
        if near.where("below > 1 or (below > 0 and top > u)").isEmpty():
            break
        large = scratch.keep(
            both.where("v > u").join(near.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct(), "large", narrow=True)
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), "low", narrow=True)
        nxt = scratch.keep(
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small", narrow=True)
        scratch.drop(cur, near, large, low)
        cur = nxt
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
