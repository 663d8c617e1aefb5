"""Toolkit result envelopes: ``timestamp, action, target, ok, status, error`` plus
tool-prefixed columns, computed from stored probe output joined to a target list.

Each tool is a left join from the targets (``target_seq`` is the probe id kept with
the stored output) followed by column expressions; tools whose answer has many rows
use ``explode_outer`` so a target without answers keeps one row. A target without a
stored answer gets ``ok = false`` (divergence D3). ``status`` and the tool fields are
text, as in the CSV output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanscope import constants as K
from sanscope.functions import jsonflat as J
from sanscope.functions import names as N
from sanscope.functions import parsers as P
from sanscope.functions import targets as T
from sanscope.operators.ranking import first_answers
from sanscope.session import materialize
from sanscope.sources.readers import body_kind


def head(ts: str, action: str, ok: Column, status: Column, error: Column) -> list[Column]:
    return [F.lit(ts).alias("timestamp"), F.lit(action).alias("action"), F.col("target"),
            ok.alias("ok"), status.cast("string").alias("status"), error.alias("error")]


#: Column metadata: a row without a value doesn't have this key. (Other columns are keys whatever their values.)
OPTIONAL = {"optional": True}


def _stored(targets: DataFrame, answers: DataFrame, *cols: str) -> DataFrame:
    """Targets with the answer stored for each. The optimizer takes an answer's text for as small as the columns
    it is made of and would send all answers through the driver; a merge join sends none."""
    return targets.select("target_seq", "target").join(answers.select("target_seq", *cols).hint("merge"), "target_seq", "left")


def _probe(targets: DataFrame, output: DataFrame) -> DataFrame:
    return _stored(targets, output, "returncode", "stdout", "stderr")


def envelope_dig(targets: DataFrame, output: DataFrame, ts: str, record_type: str = "A") -> DataFrame:
    j = _probe(targets, output).withColumn("_v", T.validate_target("target"))
    rt_ok = T.record_type_ok(F.lit(record_type))
    valid = F.col("_v.ok") & rt_ok
    ran = valid & F.coalesce(F.col("returncode") == 0, F.lit(False))
    j = j.withColumn("_ans", F.when(ran, P.parse_dig_answer("stdout")).otherwise(F.array().cast(
        "array<struct<record_name:string,ttl:string,class:string,type:string,value:string>>")))
    ok = ran & (F.size("_ans") > 0)
    err = (F.when(~F.col("_v.ok"), F.col("_v.error")).when(~rt_ok, F.lit(K.MSG_BAD_DNS_TYPE))
           .when(~ran, F.coalesce(F.col("stderr"), F.lit(""))).when(~ok, F.lit(K.MSG_NO_ANSWERS)).otherwise(F.lit("")))
    status = F.when(ran, F.lit("0")).otherwise(F.lit("1"))
    rows = j.select("target_seq", *head(ts, "dig", ok, status, err), F.explode_outer(F.col("_ans")).alias("_a"))
    a = F.col("_a")
    return rows.select("target_seq", *K.ENVELOPE_COLUMNS, a["record_name"].alias("dig_record_name", metadata=OPTIONAL), a["ttl"].alias("dig_ttl", metadata=OPTIONAL),
                       a["class"].alias("dig_class", metadata=OPTIONAL), a["type"].alias("dig_type", metadata=OPTIONAL), a["value"].alias("dig_value", metadata=OPTIONAL))


def _raw_output_tool(targets: DataFrame, output: DataFrame, ts: str, action: str, extra_ok: Column | None,
                     extra_err: str | None) -> DataFrame:
    j = _probe(targets, output).withColumn("_v", T.validate_target("target"))
    valid = F.col("_v.ok") if extra_ok is None else F.col("_v.ok") & extra_ok
    ok = valid & F.coalesce(F.col("returncode") == 0, F.lit(False))
    status = F.when(valid, F.coalesce(F.col("returncode").cast("string"), F.lit(""))).otherwise(F.lit(""))
    raw = (F.when(~valid, F.lit("")).when(ok, N.py_strip(F.coalesce("stdout", F.lit(""))))
           .otherwise(N.py_strip(F.coalesce("stderr", F.lit("")))))
    err = F.when(~F.col("_v.ok"), F.col("_v.error"))
    if extra_ok is not None:
        err = err.when(~extra_ok, F.lit(extra_err))
    err = err.otherwise(F.lit(""))
    return j.select("target_seq", *head(ts, action, ok, status, err), raw.alias("raw_output"))


def envelope_dnslookup(targets: DataFrame, output: DataFrame, ts: str, record_type: str = "A") -> DataFrame:
    return _raw_output_tool(targets, output, ts, "dnslookup", T.record_type_ok(F.lit(record_type)), K.MSG_BAD_DNS_TYPE)


def envelope_traceroute(targets: DataFrame, output: DataFrame, ts: str) -> DataFrame:
    return _raw_output_tool(targets, output, ts, "traceroute", None, None)


def envelope_ping(targets: DataFrame, output: DataFrame, ts: str) -> DataFrame:
    j = _probe(targets, output).withColumn("_v", T.validate_target("target")).withColumn("_r", P.parse_ping_rtt("stdout"))
    valid = F.col("_v.ok")
    ran = valid & F.coalesce(F.col("returncode") == 0, F.lit(False))
    ok = ran & F.col("_r.matched")
    stderr = F.coalesce(F.col("stderr"), F.lit(""))
    err = (F.when(~valid, F.col("_v.error")).when(~ran, F.when(stderr != "", stderr).otherwise(F.lit(K.MSG_PING_FAILED)))
           .when(~ok, F.lit(K.MSG_PING_NO_RTT)).otherwise(F.lit("")))
    status = F.when(ok, F.lit("0")).otherwise(F.lit("1"))
    return j.select("target_seq", *head(ts, "ping", ok, status, err),
                    *[F.when(ok, F.col(f"_r.{c}")).alias(c, metadata=OPTIONAL) for c in ("ping_avg", "ping_max", "ping_min", "ping_mdev")])


def envelope_curl(targets: DataFrame, output: DataFrame, ts: str) -> DataFrame:
    """No host validation in this tool; the URL is ``target_url(target)``."""
    j = _probe(targets, output).withColumn("_m", P.parse_curl_metrics("stdout"))
    ran = F.coalesce(F.col("returncode") == 0, F.lit(False))
    ok = ran & F.col("_m.ok")
    err = F.when(~ran, F.coalesce(F.col("stderr"), F.lit(""))).when(~ok, F.lit(K.MSG_CURL_PARSE)).otherwise(F.lit(""))
    status = F.when(ok, F.col("_m.curl_http_code")).otherwise(F.lit(""))
    return j.select("target_seq", *head(ts, "curl", ok, status, err),
                    F.when(ok, F.col("_m.curl_http_code")).alias("curl_http_code", metadata=OPTIONAL),
                    F.when(ok, F.col("_m.curl_latency_seconds")).alias("curl_latency_seconds", metadata=OPTIONAL))


# ---------------------------------------------------------------- JSON tools
#: Keys that become columns at most; documents with more go into a map (``fields=True``).
MAX_COLUMNS = 2000
def as_fields(df: DataFrame, flat_col: str, out: str = "fields") -> DataFrame:
    """The flattened keys of a row as one map column, any number of them."""
    flat = F.coalesce(F.col(flat_col), F.array().cast(J.FLAT_TYPE))
    return df.withColumn(out, F.map_from_entries(flat)).drop(flat_col)


def key_catalogue(rows: DataFrame, fields: str = "fields", order: str = "target_seq") -> DataFrame:
    """(key, rows, first_seq) of a map column: which keys occur, how often, and in which row first. A
    partial aggregate per key; it is a table like any other, whatever the number of keys."""
    keys = rows.select(order, F.explode_outer(F.map_keys(fields)).alias("key")).where(F.col("key").isNotNull())
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first_seq"))


def pick_fields(rows: DataFrame, keys: Sequence[str], fields: str = "fields") -> DataFrame:
    """The named keys of a map column as columns."""
    return rows.select("*", *[F.element_at(F.col(fields), F.lit(k)).alias(k) for k in keys]).drop(fields)


def widen(df: DataFrame, flat_col: str, keys: Sequence[str] | None = None, fields: bool = False) -> DataFrame:
    """Flattened keys -> columns, in the order of their names; with ``fields`` -> one map column, without any
    search for keys. ``keys`` names the columns; without it the key catalogue does, up to MAX_COLUMNS: more
    keys than that are an error that names the map form, not a table of a million columns."""
    if fields:
        return as_fields(df, flat_col)
    if keys is None:
        # the flattened rows feed both the catalogue and the result: write them once
        df = materialize(df, "wide")
        found = df.select(F.explode(F.col(flat_col)["key"]).alias("k")).distinct().limit(MAX_COLUMNS + 1).collect()
        if len(found) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} distinct keys: take fields=True and key_catalogue")
        keys = sorted(r[0] for r in found)
    return pick_fields(as_fields(df, flat_col, "_fields"), keys, "_fields")


def envelope_ipguide(targets: DataFrame, payloads: DataFrame, ts: str, keys: Sequence[str] | None = None, fields: bool = False) -> DataFrame:
    """A stored answer with an HTTP status outside 2xx is an error row: its body is the error text."""
    # read after the join, by as many tasks as that has: texts are moved, not what they hold
    j = _stored(targets, payloads, "http_status", "body").withColumn("_p", J.parsed(
        F.when(N.py_strip(F.col("body")).startswith("{"), F.col("body")), K.PREFIX_IPG))
    blank = N.py_strip(F.col("target")) == ""
    found = F.col("body").isNotNull()
    good = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    is_obj = F.coalesce(F.col("_p.found"), F.lit(False))
    ok = ~blank & found & good
    err = F.when(blank, F.lit(K.MSG_PARAM_TARGET_QUERY_REQUIRED)).when(found & ~good, F.col("body")).otherwise(F.lit(""))
    status = F.when(blank, F.lit("")).otherwise(F.coalesce(F.col("http_status").cast("string"), F.lit("")))
    base = j.select("target_seq", *head(ts, "ipguide", ok, status, err), F.when(ok & is_obj, F.col("_p.flat")).alias("_flat"),
                    F.when(ok & ~is_obj, F.col("body")).alias("ipg_raw_data", metadata=OPTIONAL))
    return widen(base, "_flat", keys, fields)


def envelope_open_rank(targets: DataFrame, payloads: DataFrame, ts: str, keys: Sequence[str] | None = None, fields: bool = False) -> DataFrame:
    j = _stored(targets, payloads, "http_status", "body").withColumn("_p", J.parsed("body", K.PREFIX_OPR, response=True))
    blank = N.py_strip(F.col("target")) == ""
    http_ok = F.coalesce(F.col("http_status") == 200, F.lit(False))
    parsed = F.coalesce(F.col("_p.valid"), F.lit(False))
    ok = ~blank & http_ok & parsed
    status = F.when(blank, F.lit("")).otherwise(F.coalesce(F.col("http_status").cast("string"), F.lit("")))
    err = (F.when(blank, F.lit(K.MSG_PARAM_TARGET_REQUIRED)).when(~http_ok, F.coalesce(F.col("body"), F.lit("")))
           .when(~parsed, F.lit(K.MSG_NOT_JSON)).otherwise(F.lit("")))
    has_first = F.coalesce(F.col("_p.found"), F.lit(False))
    base = j.select("target_seq", *head(ts, "open_rank", ok, status, err),
                    F.when(ok & has_first, F.col("_p.flat")).alias("_flat"),
                    F.when(ok & ~has_first, F.col("body")).alias("opr_raw_data", metadata=OPTIONAL))
    return widen(base, "_flat", keys, fields)


# ---------------------------------------------------------------- certificate search tool
def crtsh_name_list(name_value: str = "name_value") -> Column:
    """The toolkit's basic cleaning of an entry's names: split on newline, strip, lower, non-blank."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(name_value), F.lit("")), "\n", -1), N.clean_name_basic),
                    lambda x: x.isNotNull())


def crtsh_names(entries: DataFrame) -> DataFrame:
    """(entry_seq, name) rows of the cleaned names."""
    ex = entries.select("entry_seq", F.explode_outer(crtsh_name_list()).alias("name"))
    return ex.where(F.col("name").isNotNull())


def _dot_suffixes(names: Column) -> Column:
    """Distinct proper dot-suffixes of all names of an entry (``a.b.c`` -> ``b.c``, ``c``)."""
    def sfx(n):
        labels = F.split(n, r"\.", -1)
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                           lambda k: F.array_join(F.slice(labels, -k, k), "."))
    per_name = F.transform(names, lambda n: F.filter(sfx(n), lambda x: n.endswith(F.concat(F.lit("."), x))))
    return F.array_distinct(F.flatten(per_name))


def crtsh_subdomains(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """(target, name): distinct cleaned names of every certificate holding a name below
    the target (``q=%.target``).

    Each entry's distinct dot-suffixes are equi-joined with the distinct lower-cased targets, so one
    (entry, target) pair is one row and no pattern join is needed; the names are joined to the pairs
    afterwards, so they never ride on suffixes that no target asks for. The final distinct on
    (target, name) spreads a target holding a third of all names over every reducer."""
    t = targets.select(F.lower(N.py_strip("target")).alias("_q")).where(F.col("_q") != "").distinct()
    e = entries.select("entry_seq", F.explode_outer(_dot_suffixes(crtsh_name_list())).alias("_q"))
    hits = e.where(F.col("_q").isNotNull()).join(t, "_q")
    return hits.join(crtsh_names(entries), "entry_seq").select(F.col("_q").alias("_target_key"), "name").distinct()


def crtsh_responses(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """(target key, entry_seq) for every entry a target's search returns."""
    t = targets.select(F.lower(N.py_strip("target")).alias("_q")).where(F.col("_q") != "").distinct()
    e = entries.select("entry_seq", F.explode_outer(_dot_suffixes(crtsh_name_list())).alias("_q"))
    return e.where(F.col("_q").isNotNull()).join(t, "_q").select(F.col("_q").alias("target"), "entry_seq")


def envelope_crtsh(targets: DataFrame, entries: DataFrame, ts: str, answers: DataFrame | None = None) -> DataFrame:
    """One row per distinct cleaned name of the certificates each target returned; a target with no
    names keeps one bare row; a blank target is an error row.

    ``answers`` (target, http_status, body) are the stored search answers: a status outside 2xx or a
    body that is no JSON is an error row, JSON that is no list goes to ``crt_raw_data``, a missing
    answer is ``ok = false``. Without them every search counts as answered by a list. Duplicate
    targets in the list are kept: the original prints one block of rows for each."""
    t = targets.select("target_seq", "target", F.lower(N.py_strip("target")).alias("_target_key"))
    if answers is None:
        t = t.select("*", F.lit(200).alias("_status"), F.lit("[]").alias("_body"), F.lit("array").alias("_kind"))
    else:
        a = first_answers(answers.withColumn("target", F.lower(N.py_strip("target"))))
        t = t.join(a.select(F.col("target").alias("_target_key"), F.col("http_status").alias("_status"), F.col("body").alias("_body"),
                            body_kind(F.col("body")).alias("_kind")).hint("merge"), "_target_key", "left")
    blank = F.col("_target_key") == ""
    http_ok = F.coalesce(F.col("_status").between(200, 299), F.lit(False))
    ok = ~blank & http_ok & F.col("_kind").isNotNull()
    err = (F.when(blank, F.lit(K.MSG_PARAM_TARGET_REQUIRED)).when(F.col("_status").isNull(), F.lit(""))
           .when(~http_ok, F.coalesce("_body", F.lit(""))).when(F.col("_kind").isNull(), F.lit(K.MSG_NOT_JSON)).otherwise(F.lit("")))
    status = F.when(blank, F.lit("")).otherwise(F.coalesce(F.col("_status").cast("string"), F.lit("")))
    t = t.select("target_seq", "_target_key", *head(ts, "crtsh", ok, status, err),
                 (ok & (F.col("_kind") == "array")).alias("_listed"),
                 F.when(ok & (F.col("_kind") != "array"), F.col("_body")).alias("crt_raw_data")).alias("t")
    subs = crtsh_subdomains(targets, entries).alias("s")
    rows = t.join(subs, F.expr("t._target_key = s._target_key and t._listed"), "left")
    return rows.select("target_seq", *K.ENVELOPE_COLUMNS, F.col("name").alias("crt_subdomain", metadata=OPTIONAL),
                       F.col("crt_raw_data").alias("crt_raw_data", metadata=OPTIONAL))
