"""Parsers for stored probe output (dig, ping, curl)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sanscope.functions.names import PY_SPACE, _c, py_strip, split_names

# FIXED VALUES: the ping summary line
PING_RTT_RE = r"rtt min/avg/max/mdev = ([0-9.]+)/([0-9.]+)/([0-9.]+)/([0-9.]+) ms"
WS_RUN_RE = f"[{PY_SPACE}]+"


def py_split(col) -> Column:
    """``str.split()`` with no argument: whitespace runs, no empty pieces."""
    s = py_strip(col)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WS_RUN_RE, -1))


def parse_dig_answer(col) -> Column:
    """array<struct<record_name, ttl, class, type, value>> from ``dig +noall +answer``
    text: one entry per line with >= 5 whitespace-separated tokens; the value is
    the rest of the line joined by single spaces."""
    toks = F.transform(split_names(col), py_split)
    rows = F.filter(toks, lambda t: F.size(t) >= 5)
    return F.transform(rows, lambda t: F.struct(
        t[0].alias("record_name"), t[1].alias("ttl"), t[2].alias("class"), t[3].alias("type"),
        F.array_join(F.slice(t, 5, F.size(t) - 4), " ").alias("value")))


def parse_ping_rtt(col) -> Column:
    """struct(matched, ping_min, ping_avg, ping_max, ping_mdev) (text fields)."""
    c = _c(col)
    m = c.rlike(PING_RTT_RE)
    g = lambda i: F.when(m, F.regexp_extract(c, PING_RTT_RE, i))
    return F.struct(F.coalesce(m, F.lit(False)).alias("matched"), g(1).alias("ping_min"), g(2).alias("ping_avg"),
                    g(3).alias("ping_max"), g(4).alias("ping_mdev"))


def parse_curl_metrics(col) -> Column:
    """struct(ok, curl_http_code, curl_latency_seconds) from ``code,time``: exactly two parts."""
    parts = F.split(py_strip(F.coalesce(_c(col), F.lit(""))), ",", -1)
    ok = F.size(parts) == 2
    return F.struct(ok.alias("ok"), F.when(ok, parts[0]).alias("curl_http_code"),
                    F.when(ok, parts[1]).alias("curl_latency_seconds"))
