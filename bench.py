"""Benchmark: headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR.

Each query is built fresh (new DataFrames, so no shuffle output of an earlier
run is reused), warmed up once, then timed once; the result is fully
materialised with the ``noop`` sink (all columns computed, nothing collected).
Prints one JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import re
import sys
import tempfile
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "gps_inconsistent",
    "osa_unusual_non",
    "sos_blocks",
    "pivot_questions",
    "replace_by_visit",
    "build_survey",
    "merge_visits",
    "deviation_summary",
]


def stage_metrics(event_dir: str) -> dict[str, dict[str, int]]:
    """Shuffle bytes written and bytes spilled per job group, from the event log."""
    job_group, stage_job = {}, {}
    per_stage = defaultdict(lambda: defaultdict(int))
    for path in glob.glob(f"{event_dir}/*"):
        files = glob.glob(f"{path}/events*") if os.path.isdir(path) else [path]
        for f in files:
            with open(f, encoding="utf-8") as fh:
                text = fh.read()
            for line in text.split("\n"):  # not splitlines(): U+2028 may occur inside events
                if not line.strip():
                    continue
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    job_group[e["Job ID"]] = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in e.get("Stage IDs", []):
                        stage_job[sid] = e["Job ID"]
                elif kind == "SparkListenerTaskEnd":
                    m = e.get("Task Metrics") or {}
                    st = per_stage[e["Stage ID"]]
                    st["shuffle_write"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    st["spill"] += m.get("Memory Bytes Spilled", 0) + m.get("Disk Bytes Spilled", 0)
    out = defaultdict(lambda: defaultdict(int))
    for sid, metrics in per_stage.items():
        group = job_group.get(stage_job.get(sid))
        if group:
            for k, v in metrics.items():
                out[group][k] += v
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from shelfscan.plans import catalog
    from shelfscan.session import get_session

    event_dir = tempfile.mkdtemp(prefix="shelfscan-bench-events-")
    spark = get_session(f"local[{cpus}]", app="shelfscan-bench", shuffle_partitions=int(cpus),
                        extra={"spark.driver.memory": "16g", "spark.eventLog.enabled": "true",
                               "spark.eventLog.dir": event_dir, "spark.eventLog.compress": "false"})
    times: dict[str, float] = {}
    for name in names:
        fn = catalog.QUERIES[name]
        for run in range(2):
            catalog.reset()
            spark.sparkContext.setJobGroup(f"{name}#{run}", name)
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - t0
        times[name] = round(elapsed, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total_warm",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }
    spark.stop()
    try:
        metrics = stage_metrics(event_dir)
        out["shuffle_bytes"] = {n: metrics.get(f"{n}#1", {}).get("shuffle_write", 0) for n in names}
        out["spill_bytes"] = {n: metrics.get(f"{n}#1", {}).get("spill", 0) for n in names}
    except Exception as exc:  # metrics are extra; the timing line must still print
        out["metrics_error"] = str(exc)[:200]
    print(json.dumps(out))


if __name__ == "__main__":
    main()
