"""Sources: stored certificate responses, target lists, domain CSVs, saved state, lookup snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanscope.functions import jsonflat as J
from sanscope.functions import names as N
from sanscope.operators import ordering

CERT_ENTRY_SCHEMA = T.StructType([
    T.StructField("entry_seq", T.LongType()),
    T.StructField("min_cert_id", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("issuer_ca_id", T.IntegerType()),
    T.StructField("common_name", T.StringType()),
    T.StructField("name_value", T.StringType()),
    T.StructField("not_before", T.StringType()),
    T.StructField("not_after", T.StringType()),
])

IDENTITY_SCHEMA = T.StructType([
    T.StructField("certificate_id", T.LongType()),
    T.StructField("name_value", T.StringType()),
    T.StructField("not_before", T.TimestampType()),
    T.StructField("not_after", T.TimestampType()),
    T.StructField("issuer_ca_id", T.IntegerType()),
])


def read_cert_entries(spark: SparkSession, path: str, fmt: str = "json", extra: str = "") -> DataFrame:
    """Stored search responses with the declared schema; the response order must be in the data
    as ``entry_seq``.

    ``fmt``: ``json`` (one entry per line, or a line holding an array of entries), ``json_array``
    (files that are one array over many lines, each read by one task) or ``parquet``. ``extra`` is a
    DDL string of further raw fields to keep (for example ``query_ord int, issuer_name string``)."""
    schema = CERT_ENTRY_SCHEMA if not extra else T.StructType(CERT_ENTRY_SCHEMA.fields + T._parse_datatype_string(extra).fields)
    if fmt == "json_array":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.read.schema(schema).json(path) if fmt == "json" else spark.read.schema(schema).parquet(path)


def parse_cert_entries(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON text lines -> entries (the same parser and schema as ``read_cert_entries``)."""
    return lines.select(F.from_json(F.col(col), CERT_ENTRY_SCHEMA).alias("_e")).select("_e.*")


def read_cert_identities(spark: SparkSession, url: str | None = None, table: str | None = None, path: str | None = None,
                         num_partitions: int = 64, lower: int = 0, upper: int | None = None) -> DataFrame:
    """Identity rows from a database (JDBC, partitioned on ``certificate_id``) or parquet."""
    if path is not None:
        return spark.read.schema(IDENTITY_SCHEMA).parquet(path)
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if upper is not None:
        reader = (reader.option("partitionColumn", "certificate_id").option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
    return reader.load()


def target_lines(lines: DataFrame, col: str = "target", seq_col: str = "line_no") -> DataFrame:
    """File target lines: stripped, blanks dropped, order kept."""
    s = N.py_strip(col)
    return lines.select(F.col(seq_col).alias("line_ord"), s.alias("target")).where(F.col("target") != "")


def read_targets(spark: SparkSession, cli: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """(source_ord, line_ord, target): command-line values first (as given, not
    stripped), then the file's stripped non-blank lines; duplicates kept."""
    cli_df = spark.createDataFrame([(0, i, t) for i, t in enumerate(cli)], "source_ord int, line_ord long, target string")
    if path is None:
        return cli_df
    # one list file is one sequence of lines: read whole, so that line order survives any number of files
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("_f"), "value")
    raw = files.select("_f", F.posexplode(N.split_names("value")).alias("_n", "target"))
    raw = ordering.order_number(raw, ["_f", "_n"], "line_no").select("target", "line_no")
    file_df = target_lines(raw).select(F.lit(1).alias("source_ord"), "line_ord", "target")
    return cli_df.unionByName(file_df)


def read_domains_csv(spark: SparkSession, path: str, col: str = "dominio") -> DataFrame:
    """(target_seq, dominio) of a header CSV: the column stripped, blanks and nulls dropped,
    numbered in file order. Values hold no line breaks (they are domains), so files can be split."""
    df = spark.read.option("header", True).csv(path).withColumn(
        "_at", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                        F.monotonically_increasing_id().alias("i")))
    d = N.py_strip(F.coalesce(F.col(col), F.lit("")))
    kept = df.select(d.alias(col), "_at.f", "_at.b", "_at.i").where(F.col(col) != "")
    return ordering.order_number(kept, ["f", "b", "i"], "target_seq").select("target_seq", col)


def domains_from_csv_lines(lines: DataFrame, line_col: str = "line", keys: Sequence[str] = ("target_seq",),
                           col: str = "dominio") -> DataFrame:
    """CSV data lines (already without the header) -> the stripped non-blank ``dominio``."""
    parsed = lines.select(*keys, F.from_csv(F.col(line_col), f"{col} string").alias("_r"))
    d = N.py_strip(F.coalesce(F.col(f"_r.{col}"), F.lit("")))
    return parsed.select(*keys, d.alias(col)).where(F.col(col) != "")


def read_seen_ids(spark: SparkSession, path: str | None) -> DataFrame:
    """Saved state: stripped non-blank lines as a set; a missing file is an empty state."""
    empty = spark.createDataFrame([], "cert_id string")
    if path is None:
        return empty
    newest = newest_version(spark, path)
    return empty if newest is None else seen_from_lines(spark.read.text(newest), "value")


def newest_version(spark: SparkSession, root: str) -> str | None:
    """The newest complete ``v=`` folder of a versioned state, the path itself if it has none,
    null if nothing is there. Any other failure is an error, not an empty state."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    if not fs.getFileStatus(path).isDirectory():
        return root
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    versions = sorted(n for n in names if n.startswith("v="))
    done = [n for n in versions if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{n}/_SUCCESS"))]
    if versions:
        return f"{root.rstrip('/')}/{done[-1]}" if done else None
    return root


def seen_from_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    s = N.py_strip(col)
    return lines.select(s.alias("cert_id")).where(F.col("cert_id") != "").distinct()


def body_kind(body: Column) -> Column:
    """'object' / 'array' / 'scalar' for JSON text, null when it is not JSON."""
    return J.kind(body)


def read_lookup_snapshot(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored lookup answers ``(target_seq, target, http_status, content_type, body)``."""
    return spark.read.format(fmt).load(path)
