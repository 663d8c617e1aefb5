"""Streaming queries: new certificates, new domains per batch, running domain analysis.

Each key replays the stored responses as three consecutive arrivals through the
streams and returns what the streams wrote; the final state must equal the batch
answer (dedup + saved-state filter), which the oracle states.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sanscope.checks import duckdb_sql as D
from sanscope.plans.q_certs import AS_OF, DEDUP, ENTS, _compose, _names_sql, entries
from sanscope.plans.registry import register
from sanscope.sources import fixtures as X
from sanscope.streaming.cert_stream import RecentCertStream, replay

ARRIVALS = 3


def _stream(spark, sf, analysis=False):
    return replay(spark, entries(spark, sf).drop("cert_id"), X.seen_ids(spark, sf), ARRIVALS, analysis=analysis)


NEW = ("newc as (select * from dd where cast(cert_id as varchar) not in (select cert_id from seen_ids)),\n"
       f"mx as (select max(entry_seq) + 1 as top from cert_entries)")


@register("stream_new_certs", _compose("select entry_seq, cert_id from newc", [ENTS, DEDUP, NEW], ("cert_entries", "seen_ids")))
def q_stream_new_certs(spark, sf):
    return _stream(spark, sf).new_cert_rows().select("entry_seq", "cert_id")


@register("stream_new_domains", _compose(
    f"select distinct least(floor(entry_seq * {ARRIVALS} / (select top from mx)), {ARRIVALS - 1})::int as batch_no, domain from "
    + _names_sql("newc", "entry_seq"), [ENTS, DEDUP, NEW], ("cert_entries", "seen_ids")))
def q_stream_new_domains(spark, sf):
    return _stream(spark, sf).new_domain_rows().select(F.col("batch_no").cast("int").alias("batch_no"), "domain")


@register("stream_domain_analysis", _compose(
    "select domain, " + D.level("domain") + " as level, "
    + D.iso_date("min(" + D.cert_time("not_before") + ")") + " as first_seen, "
    + D.iso_date("max(" + D.cert_time("not_after") + ")") + " as last_seen, "
    + f"case when max({D.cert_time('not_after')}) > timestamp '{AS_OF}' then 'Vigente' else 'Expirado' end as is_active "
    + "from " + _names_sql("newc", "not_before, not_after") + " group by domain",
    [ENTS, DEDUP, NEW], ("cert_entries", "seen_ids")))
def q_stream_domain_analysis(spark, sf):
    return _stream(spark, sf, analysis=True).analysis_rows()


#: Hours at which the arrivals of ``stream_recent_certs`` were stored; the last one is late.
RECENT_HOURS, RECENT_DELAY = ("2024-01-01 10:00:00", "2024-01-01 11:00:00", "2024-01-01 04:00:00"), "3 hours"


@register("stream_recent_certs", _compose(
    f"select distinct cert_id from ents, mx where cert_id is not null and "
    f"least(floor(entry_seq * {ARRIVALS} / mx.top), {ARRIVALS - 1}) < {ARRIVALS - 1}",
    [ENTS, "mx as (select max(entry_seq) + 1 as top from cert_entries)"], ("cert_entries",)))
def q_stream_recent_certs(spark, sf):
    """Ids once within three hours of event time; the third response is older than the watermark."""
    rows = entries(spark, sf).drop("cert_id")
    top = (rows.agg(F.max("entry_seq")).first()[0] or 0) + 1
    part = F.least(F.floor(F.col("entry_seq") * ARRIVALS / F.lit(top)), F.lit(ARRIVALS - 1))
    stream = RecentCertStream(spark, RECENT_DELAY)
    for k, at in enumerate(RECENT_HOURS):
        stream.arrive(rows.where(part == k), at)
        stream.run()
    return stream.rows().select("cert_id")
