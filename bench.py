"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion through the ``noop`` sink (every row is computed,
nothing is collected to the driver). One warm-up pass, then $BENCH_REPEAT timed
passes; the per-query figure is the median. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "domain_analysis",       # flagship: dedup -> names -> per-domain min/max
    "discover_domains",      # search responses -> saved state -> first owner -> levels -> distinct
    "discover_keyword",
    "discover_domains_db",   # identities: full text + row filter + per-search top-n + issuer
    "novelty_curve",         # two-level running totals
    "filter_fulltext",
    "private_suffix",        # rule-table join
    "sort_domains",          # distributed order numbers
    "flatten_json",          # VARIANT flattening per row
    "enrich_network",        # bucketed longest-prefix join
    "envelope_crtsh",        # dot-suffix equi join, names per target
    "envelope_dig",
    "envelope_whois",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "1")))
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]

    from sanscope.plans.registry import QUERIES, load_all
    from sanscope.session import local_session

    load_all()
    spark = local_session(cpus)
    times: dict[str, float] = {}
    for key in keys:
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[key] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
