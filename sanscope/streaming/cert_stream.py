"""Incremental discovery with Structured Streaming.

Stored search responses land as new files in a source folder. Each run
(``trigger(availableNow=True)``, i.e. "re-run on an ongoing basis") processes only
the files that arrived since the last one:

* ``run_new_certs`` - ``foreachBatch``: first entry per certificate by (arrival, entry) within the
  batch, minus every id already known (saved state + earlier batches).
* new domains - the new certificates -> names -> distinct, per arrival (a known domain in a
  new certificate is reported again, like the original).
* ``run_analysis`` - a second stream over the new certificates: first and last times per domain as a
  streaming aggregate in update mode. Its state is in Spark's keyed state store (RocksDB), read back
  by the state reader; a run reads the new files only.
* ``unique_within`` - the bounded form: ids are remembered for an event-time delay only.

The rows do not depend on how many arrivals or files one trigger takes.

An epoch's folders are written aside and renamed when whole; a manifest (``manifest.py``) then commits
the epoch. A retried epoch that is committed changes nothing, one that isn't is written anew, and
``compact`` commits a new generation of the known ids the same way. Reopening the same root goes on
where the manifest stands, whichever step was interrupted.

All folders live under the shared ``spark.checkpoint.dir``, or below a root the caller names.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanscope.functions import names as N
from sanscope.operators import certs as C
from sanscope.operators import state as S
from sanscope.session import materialize, state_path, use_utc
from sanscope.sources.readers import CERT_ENTRY_SCHEMA
from sanscope.streaming import manifest as M

NEW_CERT_SCHEMA = T.StructType(list(CERT_ENTRY_SCHEMA.fields) + [
    T.StructField("arrival", T.IntegerType()), T.StructField("cert_id", T.LongType())])
KNOWN_SCHEMA = "cert_id string, epoch int"
NEW_DOMAIN_SCHEMA = "arrival int, domain string, epoch int"
#: Files of any age count: the file source would skip what is a week older than the newest file.
ANY_AGE = "36500d"
#: FIXED VALUE: class name of Spark's RocksDB state store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB: beyond memory, and written as changes."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class CertStream:
    """A stream below ``root``. With the root of an earlier one it goes on from its committed state."""

    def __init__(self, spark: SparkSession, root: str | None = None, as_of: str = "2000-01-01 00:00:00"):
        self.spark = spark
        use_utc(spark)
        self.root = root or state_path(spark, f"streams/run-{uuid.uuid4().hex}")
        self.source = f"{self.root}/source"
        self.new_certs = f"{self.root}/new_certs"
        self.new_domains = f"{self.root}/new_domains"
        self.changes = f"{self.root}/analysis_changes"
        self._ckpt_certs, self._ckpt_analysis = f"{self.root}/ckpt_new_certs", f"{self.root}/ckpt_analysis"
        self.as_of = as_of
        self.manifest = M.Manifest(spark, self.root)
        self.state = self.manifest.read()

    # -- folders
    @property
    def known(self) -> str:
        return f"{self.root}/{self.state.generation}"

    def _place(self, df: DataFrame, target: str) -> None:
        """Write aside, then rename: the folder is whole when it appears. One that is there already stays:
        it is the same epoch's, from an attempt that ended before its commit."""
        aside = f"{self.root}/_aside/{uuid.uuid4().hex}"
        df.write.parquet(aside)
        M.move(self.spark, aside, target)

    def _committed(self, path: str, schema) -> DataFrame:
        """Rows of the committed epochs."""
        if not M.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        epochs = [*self.state.epochs, self.state.folded]
        return self.spark.read.schema(schema).parquet(path).where(F.col("epoch") <= max(epochs))

    # -- inputs
    def init_state(self, seen: DataFrame) -> None:
        """Saved ids of earlier runs, once and before the first arrival is processed."""
        if self.state.epochs or self.state.folded >= 0 or M.exists(self.spark, f"{self.known}/epoch=-1"):
            raise RuntimeError(f"{self.root} has state already")
        self._place(seen.select(F.col("cert_id").cast("string").alias("cert_id")), f"{self.known}/epoch=-1")

    def arrive(self, entries: DataFrame) -> None:
        """A new stored response (one folder per arrival, so files of one arrival stay together)."""
        there = [int(n.partition("=")[2]) for n in M.names(self.spark, self.source) if n.startswith("arrival=")]
        number = max([self.state.arrivals, *(n + 1 for n in there)])  # placed but not yet committed ones count
        self._place(entries.select(*[f.name for f in CERT_ENTRY_SCHEMA.fields]), f"{self.source}/arrival={number:06d}")
        self.state = self.manifest.commit(self.state, arrivals=number + 1)

    # -- per-batch logic
    def _known_ids(self, batch_ids: DataFrame) -> DataFrame:
        """Known ids that occur in this batch: a semi join with the batch's distinct ids, which
        the optimizer broadcasts while they are small, so the state is scanned and not shuffled."""
        if not M.exists(self.spark, self.known):
            return self.spark.createDataFrame([], "cert_id string")
        epochs = [-1, *self.state.epochs]
        ids = self.spark.read.schema(KNOWN_SCHEMA).parquet(self.known).where(F.col("epoch").isin(epochs)).select("cert_id")
        probe = batch_ids.select(F.col("cert_id").cast("string").alias("cert_id")).distinct()
        return ids.join(probe, "cert_id", "left_semi")

    def _process(self, batch: DataFrame, epoch: int, stream: str | None = None) -> None:
        if self.state.stream is not None and stream is not None and stream != self.state.stream:
            raise RuntimeError(f"the checkpoint of {self.root} was replaced; its epochs start anew and can't be told apart")
        if self.state.committed(epoch):
            return  # a retry after the commit: the rows are there
        # first by (arrival, entry): the first arrival of each certificate, then its first entry there
        ded = materialize(C.first_owned_entries(C.with_cert_id(batch), by="arrival"), "stream-batch")
        self._place(S.anti_seen(ded, self._known_ids(ded.select("cert_id"))), f"{self.new_certs}/epoch={epoch}")
        written = self.spark.read.schema(NEW_CERT_SCHEMA).parquet(f"{self.new_certs}/epoch={epoch}")
        self._place(written.select(F.col("cert_id").cast("string").alias("cert_id")), f"{self.known}/epoch={epoch}")
        named = C.entry_names(written, keep=("arrival",))
        self._place(C.distinct_domains(named, by=["arrival"]), f"{self.new_domains}/epoch={epoch}")
        self.state = self.manifest.commit(self.state, epochs=sorted([*self.state.epochs, epoch]), stream=stream or self.state.stream)

    def run_new_certs(self) -> None:
        schema = T.StructType(list(CERT_ENTRY_SCHEMA.fields) + [T.StructField("arrival", T.IntegerType())])
        stream = self.spark.readStream.schema(schema).option("maxFileAge", ANY_AGE).parquet(self.source)
        checkpoint = f"{self._ckpt_certs}/metadata"

        def process(df: DataFrame, epoch: int) -> None:
            self._process(df, epoch, json.loads(M.read_text(self.spark, checkpoint))["id"])

        q = (stream.writeStream.foreachBatch(process)
             .option("checkpointLocation", self._ckpt_certs).trigger(availableNow=True).start())
        q.awaitTermination()

    # -- per-domain analysis
    def run_analysis(self) -> dict:
        """Fold the certificates that are new since the last call into the per-domain times; the last
        progress report of the stream (input and state rows)."""
        if not M.exists(self.spark, self.new_certs):
            return {}
        stream = self.spark.readStream.schema(NEW_CERT_SCHEMA).option("maxFileAge", ANY_AGE).parquet(self.new_certs)
        times = (C.entry_names(stream, keep=("not_before", "not_after"))
                 .groupBy("domain").agg(F.min(N.parse_cert_time("not_before")).alias("first_ts"),
                                        F.max(N.parse_cert_time("not_after")).alias("last_ts")))

        def changed(df: DataFrame, epoch: int) -> None:
            df.write.mode("overwrite").parquet(f"{self.changes}/epoch={epoch}")

        with keyed_state_store(self.spark):
            q = (times.writeStream.outputMode("update").foreachBatch(changed)
                 .option("checkpointLocation", self._ckpt_analysis).trigger(availableNow=True).start())
            q.awaitTermination()
        return dict(q.lastProgress or {})

    def compact(self) -> None:
        """Fold the committed known ids into the base of a new generation. The old one stays valid until
        the new one is committed and is removed after that; a failed compaction changes nothing."""
        if not self.state.epochs:
            return
        old, new = self.state.generation, f"known-{uuid.uuid4().hex}"
        ids = self.spark.read.schema(KNOWN_SCHEMA).parquet(self.known).where(F.col("epoch").isin([-1, *self.state.epochs]))
        self._place(ids.select("cert_id").distinct(), f"{self.root}/{new}/epoch=-1")
        self.state = self.manifest.commit(self.state, generation=new, folded=max(self.state.epochs), epochs=[])
        M.delete(self.spark, f"{self.root}/{old}")

    # -- outputs
    def new_cert_rows(self) -> DataFrame:
        return self._committed(self.new_certs, T.StructType([*NEW_CERT_SCHEMA.fields, T.StructField("epoch", T.IntegerType())]))

    def new_domain_rows(self) -> DataFrame:
        return self._committed(self.new_domains, NEW_DOMAIN_SCHEMA).select(F.col("arrival").alias("batch_no"), "domain")

    def analysis_rows(self) -> DataFrame:
        """The analysis as of the last ``run_analysis``, read from the state store."""
        if M.names(self.spark, f"{self._ckpt_analysis}/commits"):
            state = self.spark.read.format("statestore").load(self._ckpt_analysis).select("key.domain", "value.*")
            a = state.toDF("domain", "first_ts", "last_ts")
        else:
            a = self.spark.createDataFrame([], "domain string, first_ts timestamp, last_ts timestamp")
        return a.select("domain", N.domain_level("domain").alias("level"), N.iso_date("first_ts").alias("first_seen"),
                        N.iso_date("last_ts").alias("last_seen"), N.is_active("last_ts", self.as_of).alias("is_active"))


def unique_within(entries: DataFrame, delay: str, event_time: str = "arrived_at") -> DataFrame:
    """Streaming entries with each certificate id once within ``delay`` of event time.

    The bounded form of ``run_new_certs``: an id is forgotten ``delay`` after its event time, so the state
    holds the ids of that span and no more, however long the feed. Rows older than the watermark
    (latest event time seen minus ``delay``) are late and dropped, as are rows without an id; rows
    without an event time have no place in the order and are dropped too. An id that comes again after the
    span is reported again. Which of several rows of one micro-batch stays is open: select the id.
    """
    keyed = C.with_cert_id(entries).where(F.col("cert_id").isNotNull() & F.col(event_time).isNotNull())
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["cert_id"])


class RecentCertStream:
    """``unique_within`` over arrivals that carry their time; ids are appended to ``recent``."""

    def __init__(self, spark: SparkSession, delay: str, root: str | None = None):
        self.spark, self.delay = spark, delay
        use_utc(spark)
        self.root = root or state_path(spark, f"streams/recent-{uuid.uuid4().hex}")
        self.source, self.recent, self._ckpt = f"{self.root}/source", f"{self.root}/recent", f"{self.root}/ckpt_recent"

    def arrive(self, entries: DataFrame, at: str) -> None:
        """Entries of a response that was stored ``at`` (UTC time)."""
        rows = entries.select(*[f.name for f in CERT_ENTRY_SCHEMA.fields], N.utc_time(F.lit(at)).alias("arrived_at"))
        aside = f"{self.root}/_aside/{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        M.move(self.spark, aside, f"{self.source}/arrival={uuid.uuid4().hex}")

    def run(self) -> list[dict]:
        """Process what arrived; the progress reports of the run (state rows, late rows)."""
        schema = T.StructType([*CERT_ENTRY_SCHEMA.fields, T.StructField("arrived_at", T.TimestampType())])
        stream = self.spark.readStream.schema(schema).option("maxFileAge", ANY_AGE).parquet(f"{self.source}/*")
        with keyed_state_store(self.spark):
            q = (unique_within(stream, self.delay).select("cert_id", "arrived_at").writeStream.outputMode("append").format("parquet")
                 .option("path", self.recent).option("checkpointLocation", self._ckpt).trigger(availableNow=True).start())
            q.awaitTermination()
        return [dict(p) for p in q.recentProgress]

    def rows(self) -> DataFrame:
        return self.spark.read.schema("cert_id bigint, arrived_at timestamp").parquet(self.recent)


def replay(spark: SparkSession, entries: DataFrame, seen: DataFrame | None, arrivals: int,
           order_col: str = "entry_seq", analysis: bool = False) -> CertStream:
    """Feed ``entries`` as ``arrivals`` consecutive response files (ranges of ``order_col``)
    and run the stream (and the analysis) after each arrival."""
    stream = CertStream(spark)
    stream.init_state(seen if seen is not None else spark.createDataFrame([], "cert_id string"))
    top = entries.agg(F.max(order_col)).first()[0]
    top = (top if top is not None else 0) + 1
    part = F.least(F.floor(F.col(order_col) * arrivals / F.lit(top)), F.lit(arrivals - 1))
    for k in range(arrivals):
        stream.arrive(entries.where(part == k))
        stream.run_new_certs()
        if analysis:
            stream.run_analysis()
    return stream
