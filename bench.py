"""Benchmark: the pipeline stages and the 19 reports at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Flow timed (median of BENCH_REPEAT runs each, after one warm-up):
  land_bronze       adapter (test tables -> raw trips) written as Bronze Parquet
                    files, BENCH_CPUS of them, as raw landing data would arrive
  bronze_to_silver  recursive Bronze read with file lineage -> typed, enriched,
                    keyed, filtered Silver, appended
                    to partitioned Parquet in ONE action (metrics via Observation)
  silver_gate       11 Silver rules fused into one aggregate, score to driver
  gold_load         scope run, build star, stage 3 tables, snapshot publish
                    (upsert into the current version + commit log)
  <report>          each dashboard report over the published star
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strata.operators.quality import gate  # noqa: E402
from strata.plans import reports  # noqa: E402
from strata.plans.gold_job import load_gold  # noqa: E402
from strata.plans.silver_job import bronze_to_silver  # noqa: E402
from strata.rulesets import silver_ruleset  # noqa: E402
from strata.session import build_session, shared_dir  # noqa: E402
from strata.sinks.gold import read_star  # noqa: E402
from strata.sources import sample  # noqa: E402
from strata.sources.bronze import read_bronze  # noqa: E402
from strata.sources.silver import read_silver, scope_run  # noqa: E402


def timed(fn, repeat: int) -> float:
    fn()  # warm-up
    runs = []
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        runs.append(time.perf_counter() - t0)
    return statistics.median(runs)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    spark = build_session(f"local[{cpus}]", "strata-bench", shuffle_partitions=max(cpus, 8),
                          conf={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    work = shared_dir(spark, "bench", unique=True)
    zones = sample.zone_lookup(spark, sf_dir)
    q: dict[str, float] = {}
    landing = f"{work}/bronze/fhvhv_trips"

    def land_once():
        raw = sample.raw_trips(spark, sf_dir, lineage=False)
        raw.repartition(cpus).write.mode("overwrite").parquet(landing)

    q["land_bronze"] = timed(land_once, repeat)
    counter = {"n": 0}

    def silver_once():
        counter["n"] += 1
        raw = read_bronze(spark, landing)
        bronze_to_silver(raw, zones, f"run-{counter['n']:04d}", f"{work}/silver")

    q["bronze_to_silver"] = timed(silver_once, repeat)
    silver_path = f"{work}/silver"
    last_run = f"run-{counter['n']:04d}"

    def gate_once():
        silver = scope_run(read_silver(spark, silver_path), last_run)
        decision, _ = gate(silver, silver_ruleset())
        assert decision.passed, decision

    q["silver_gate"] = timed(gate_once, repeat)

    def gold_once():
        load_gold(spark, silver_path, zones, last_run, f"{work}/stage", f"{work}/star")

    q["gold_load"] = timed(gold_once, repeat)

    star = read_star(spark, f"{work}/star")
    for name, fn in reports.REPORTS.items():
        q[name] = timed(lambda fn=fn: fn(star).collect(), repeat)

    total = sum(q.values())
    print(json.dumps({
        "metric": "pipeline_plus_reports_total",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in q.items()},
        "sf": sf,
        "cpus": cpus,
        "repeat": repeat,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
