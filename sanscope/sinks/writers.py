"""Sinks: domain CSV, analysis CSV, JSON Lines log, saved state, result CSVs.

Sorted outputs are range-partitioned by the sort key, so part files concatenate in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANALYSIS_COLUMNS = ("domain", "level", "first_seen", "last_seen", "is_active")
#: Columns that runs add to rows for their own order; no output file has them.
RUN_COLUMNS = ("query_ord", "entry_seq", "cert_id", "target_seq", "elem_pos", "batch_no")


def write_domains_csv(domains: DataFrame, path: str) -> None:
    """Header ``domain``, rows sorted ascending."""
    domains.select("domain").distinct().orderBy("domain").write.mode("overwrite").option("header", True).csv(path)


def write_analysis_csv(analysis: DataFrame, path: str) -> None:
    """``domain,level,first_seen,last_seen,is_active`` sorted by domain; empty dates as ""."""
    analysis.select(*ANALYSIS_COLUMNS).orderBy("domain").write.mode("overwrite").option(
        "header", True).option("emptyValue", "").csv(path)


def jsonl_lines(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One JSON object per row, null fields kept."""
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    """Every column but the run's own ordinals, unless ``fields`` names them: raw entries are logged whole."""
    jsonl_lines(df, fields or [c for c in df.columns if c not in RUN_COLUMNS]).write.mode("overwrite").text(path)


def new_state(known: DataFrame, processed: DataFrame, col: str = "cert_id") -> DataFrame:
    from sanscope.operators.state import state_merge

    return state_merge(known, processed, col)


def write_seen_ids(state: DataFrame, root: str, version: int, col: str = "cert_id") -> str:
    """Write the string-sorted state as a new version folder ``root/v=<version>``; readers
    pick the newest complete version, so a failed write never corrupts the old one."""
    path = f"{root.rstrip('/')}/v={version:012d}"
    state.select(F.col(col).cast("string").alias(col)).orderBy(col).write.mode("overwrite").text(path)
    return path


def header_first_appearance(frames: Sequence[DataFrame]) -> list[str]:
    """Union of the keys of actual rows, in first-appearance order over the tool outputs that have rows. A key
    that is present counts, whatever its values; a tool's own column (``envelopes.OPTIONAL``) is a key of the
    rows that have a value. One job for all tools; the run's own ordinals are no keys."""
    found = None
    for k, df in enumerate(frames):
        flags = F.array(*[F.count(F.col(c)) > 0 if df.schema[c].metadata.get("optional") else F.lit(True)
                          for c in df.columns])
        row = df.agg(F.count(F.lit(1)).alias("n"), flags.alias("held")).select(F.lit(k).alias("k"), "n", "held")
        found = row if found is None else found.unionAll(row)
    seen: list[str] = []
    for k, n, held in sorted(tuple(r) for r in found.collect()) if found is not None else []:
        seen += [c for c, h in zip(frames[k].columns, held) if n and h and c not in seen and c not in RUN_COLUMNS]
    return seen


def results_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """The rows of the results CSV: all tools' rows under the joint header."""
    return union_by_name(frames).select(*header_first_appearance(frames))


def sorted_header_rows(df: DataFrame) -> DataFrame:
    """The rows under the sorted union of their keys."""
    return df.select(*sorted(c for c in df.columns if c not in RUN_COLUMNS))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_results_csv(frames: Sequence[DataFrame], path: str) -> list[str]:
    """Rows with different keys in one CSV; header = first-appearance key order; empty
    input writes nothing."""
    header = header_first_appearance(frames)
    if not header:
        return []
    union_by_name(frames).select(*header).write.mode("overwrite").option("header", True).csv(path)
    return header


def write_rows_sorted_header(df: DataFrame, path: str) -> list[str]:
    """Header = sorted key union; written even for empty input."""
    out = sorted_header_rows(df)
    out.write.mode("overwrite").option("header", True).csv(path)
    return out.columns
