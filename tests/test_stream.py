"""Streaming: durable state, exactly-once epochs, keyed analysis, bounded state."""

import pytest
from pyspark.sql import functions as F

from sanscope.operators import certs as C
from sanscope.plans.q_certs import entries
from sanscope.session import state_path
from sanscope.sources import fixtures as X
from sanscope.sources.readers import CERT_ENTRY_SCHEMA
from sanscope.streaming import manifest as M
from sanscope.streaming.cert_stream import CertStream, RecentCertStream

NONE = "cert_id string"


def entry(seq, cert, *names, before="2024-01-01T00:00:00", after="2024-04-01T00:00:00"):
    row = dict.fromkeys((f.name for f in CERT_ENTRY_SCHEMA.fields))
    return {**row, "entry_seq": seq, "min_cert_id": cert, "id": cert, "name_value": "\n".join(names), "not_before": before, "not_after": after}


def response(spark, *rows):
    return spark.createDataFrame(list(rows), CERT_ENTRY_SCHEMA)


def ids(stream):
    return sorted(r["cert_id"] for r in stream.new_cert_rows().select("cert_id").collect())


def domains(stream):
    return sorted(r["domain"] for r in stream.analysis_rows().collect())


def test_retried_epoch_is_idempotent(spark, sf):
    e = entries(spark, sf).drop("cert_id")
    s = CertStream(spark)
    s.init_state(X.seen_ids(spark, sf))
    batch = e.withColumn("arrival", F.lit(0))
    s._process(batch, 0)
    first = sorted(tuple(r) for r in s.new_cert_rows().select("entry_seq", "cert_id").collect())
    s._process(batch, 0)  # the same epoch again, as after a failure
    again = sorted(tuple(r) for r in s.new_cert_rows().select("entry_seq", "cert_id").collect())
    assert first == again and len(first) > 0


def test_second_run_reports_only_new_certificates(spark, sf):
    e = entries(spark, sf).drop("cert_id")
    s = CertStream(spark)
    s.init_state(spark.createDataFrame([], NONE))
    s.arrive(e)
    s.run_new_certs()
    n1 = s.new_cert_rows().count()
    s.arrive(e)  # the same responses arrive again: nothing is new
    s.run_new_certs()
    assert s.new_cert_rows().count() == n1
    assert s.new_cert_rows().select("cert_id").distinct().count() == n1


def test_restart_after_compaction_loses_and_repeats_nothing(spark):
    root = state_path(spark, "streams/test-restart-" + spark.sparkContext.applicationId)
    s = CertStream(spark, root)
    s.init_state(spark.createDataFrame([("9",)], NONE))
    s.arrive(response(spark, entry(1, 1, "a.com"), entry(2, 9, "seen.com")))
    s.run_new_certs()
    s.run_analysis()
    s.arrive(response(spark, entry(3, 2, "b.com"), entry(4, 1, "a.com")))
    s.run_new_certs()
    s.compact()
    s.arrive(response(spark, entry(5, 3, "c.com", "a.com", before="2020-05-05T00:00:00")))
    s.run_new_certs()
    s.run_analysis()
    assert ids(s) == [1, 2, 3] and domains(s) == ["a.com", "b.com", "c.com"]

    again = CertStream(spark, root)  # as another process opens it
    assert again.state == s.state and ids(again) == [1, 2, 3] and domains(again) == ["a.com", "b.com", "c.com"]
    again.arrive(response(spark, entry(6, 3, "c.com"), entry(7, 4, "d.com"), entry(8, 9, "seen.com")))
    again.run_new_certs()
    progress = again.run_analysis()
    assert ids(again) == [1, 2, 3, 4] and domains(again) == ["a.com", "b.com", "c.com", "d.com"]
    assert progress["numInputRows"] == 1  # the new certificate only, not what was folded before
    again.compact()
    third = CertStream(spark, root)
    third.run_new_certs()  # nothing arrived
    assert ids(third) == [1, 2, 3, 4]
    assert [n for n in M.names(spark, root) if n.startswith("known-")] == [third.state.generation]
    assert sorted(int(n[8:]) for n in M.names(spark, third.source)) == [0, 1, 2, 3]
    with pytest.raises(RuntimeError):
        third.init_state(spark.createDataFrame([], NONE))


@pytest.mark.parametrize("step", ["known", "new_domains", "manifest"])
def test_epoch_interrupted_before_its_commit(spark, monkeypatch, step):
    """The process dies while the epoch's folders or its manifest are written: the next one repeats the epoch."""
    s = CertStream(spark)
    s.init_state(spark.createDataFrame([], NONE))
    s.arrive(response(spark, entry(1, 1, "a.com")))
    s.run_new_certs()
    s.arrive(response(spark, entry(2, 1, "a.com"), entry(3, 2, "b.com")))
    place, commit = CertStream._place, M.Manifest.commit

    def broken_place(self, df, target):
        if f"/{step}" in target:
            raise OSError("executor lost")
        return place(self, df, target)

    def broken_commit(self, *a, **k):
        raise OSError("driver lost")

    monkeypatch.setattr(CertStream, "_place", broken_place)
    if step == "manifest":
        monkeypatch.setattr(M.Manifest, "commit", broken_commit)
    with pytest.raises(Exception, match="lost"):
        s.run_new_certs()
    monkeypatch.setattr(CertStream, "_place", place)
    monkeypatch.setattr(M.Manifest, "commit", commit)
    again = CertStream(spark, s.root)
    assert ids(again) == [1]  # what isn't committed isn't seen
    again.compact()
    again.run_new_certs()
    assert ids(again) == [1, 2]
    assert sorted(r["domain"] for r in again.new_domain_rows().collect()) == ["a.com", "b.com"]


def test_replaced_checkpoint_is_refused(spark):
    s = CertStream(spark)
    s.init_state(spark.createDataFrame([], NONE))
    s.arrive(response(spark, entry(1, 1, "a.com")))
    s.run_new_certs()
    M.delete(spark, f"{s.root}/ckpt_new_certs")
    with pytest.raises(Exception, match="checkpoint"):
        CertStream(spark, s.root).run_new_certs()


def test_analysis_state_equals_batch_after_every_run(spark, sf):
    rows = entries(spark, sf).drop("cert_id")
    s = CertStream(spark)
    s.init_state(spark.createDataFrame([], NONE))
    for k in range(3):
        s.arrive(rows.where(F.col("entry_seq") % 3 == k))
        s.run_new_certs()
        s.run_analysis()
        so_far = C.dedup_certs(s.new_cert_rows())
        want = C.domain_analysis(C.entry_names(so_far, keep=("not_before", "not_after")), s.as_of)
        s = CertStream(spark, s.root)
        assert sorted(tuple(r) for r in s.analysis_rows().collect()) == sorted(tuple(r) for r in want.collect())


def test_empty_stream(spark):
    s = CertStream(spark)
    assert s.run_analysis() == {} and ids(s) == [] and domains(s) == [] and s.new_domain_rows().count() == 0


def test_bounded_stream_forgets_and_drops_late_rows(spark):
    """An endless feed of new ids keeps as many in the state as fit the delay; late rows are counted and dropped."""
    s = RecentCertStream(spark, "2 hours")
    state, late = [], 0
    for hour in range(8):
        rows = [entry(100 * hour + k, 100 * hour + k, "a.com") for k in range(5)] + [entry(1, 77_777, "x.com"), entry(2, None, "null.com")]
        s.arrive(response(spark, *rows), f"2024-01-01 {hour:02d}:30:00")
        for p in s.run():
            state.append(p["stateOperators"][0]["numRowsTotal"])
            late += p["stateOperators"][0]["numRowsDroppedByWatermark"]
    assert max(state) <= 6 * 5 and state[-1] <= max(state[: len(state) // 2]) and late == 0
    found = [r["cert_id"] for r in s.rows().collect()]
    assert found.count(203) == 1 and 1 < found.count(77_777) < 8  # reported again after the span, not every time
    s.arrive(response(spark, entry(9, 5, "old.com"), entry(9, 55_555, "late.com")), "2024-01-01 01:00:00")
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in RecentCertStream(spark, "2 hours", s.root).run())
    assert dropped == 2 and 55_555 not in [r["cert_id"] for r in s.rows().collect()]
