"""Session helpers: local sessions for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

UTC = "UTC"


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None, app: str = "sanscope") -> SparkSession:
    """Local session used by tests and bench; a cluster passes its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", UTC)
        .config("spark.driver.memory", os.environ.get("SANSCOPE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a local run, or a
    folder all machines see); on a cluster that has it installed this changes nothing."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def use_utc(spark: SparkSession) -> None:
    """All certificate times are read and printed in UTC (the reference's naive times are UTC)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``. Only a local session that has none gets a
    scratch folder; on a cluster a folder of one machine would be useless, so that is an error."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    path = tempfile.mkdtemp(prefix="sanscope-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def state_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint root (stream checkpoints, versioned state)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}"


def _scratch_root(spark: SparkSession) -> str:
    return state_path(spark, f"materialized/{spark.sparkContext.applicationId}")


def materialize(df, name: str):
    """Cut the lineage of ``df``: write it once as parquet under the shared checkpoint
    folder and read it back. (``Dataset.checkpoint`` without a persist computes its input
    twice - once to count, once to write.) ``drop_scratch`` removes what a session wrote so."""
    import uuid

    path = f"{_scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables that ``materialize`` wrote in this application. Frames that read them are of no use
    afterwards, so call it when the results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
