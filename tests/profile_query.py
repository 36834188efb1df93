"""Per-job timings of registered queries from Spark's event log.

usage: python tests/profile_query.py SCRATCH_DIR SF_DIR name [name ...]
The event log is written into SCRATCH_DIR (a fresh folder per run).
"""

from __future__ import annotations

import glob
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_events(scratch: str):
    import zstandard

    for f in sorted(glob.glob(os.path.join(scratch, "*", "events*"))):
        raw = open(f, "rb").read()
        text = zstandard.ZstdDecompressor().stream_reader(__import__("io").BytesIO(raw)).read().decode() if f.endswith(".zstd") else raw.decode()
        for line in text.splitlines():
            try:
                yield json.loads(line)
            except ValueError:
                continue


def main():
    scratch, sf_dir, names = sys.argv[1], sys.argv[2], sys.argv[3:]
    from kharif.session import build_session
    import __spark_entry__ as entry

    spark = build_session(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": scratch})
    qs = entry.queries()
    qs["a1_weekly_rollup"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    marks = []
    for n in names:
        t0 = time.time() * 1000
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        marks.append((n, t0, time.time() * 1000))
    spark.stop()
    jobs = {}
    for ev in read_events(scratch):
        if ev["Event"] == "SparkListenerJobStart":
            jobs[ev["Job ID"]] = {"start": ev["Submission Time"], "stages": len(ev["Stage IDs"]),
                                  "site": ev.get("Properties", {}).get("callSite.short", "")}
        elif ev["Event"] == "SparkListenerJobEnd" and ev["Job ID"] in jobs:
            jobs[ev["Job ID"]]["end"] = ev["Completion Time"]
    for n, a, b in marks:
        js = [j for j in jobs.values() if "end" in j and a <= j["start"] <= b]
        busy = sum(j["end"] - j["start"] for j in js)
        top = sorted(js, key=lambda j: j["start"] - j["end"])[:6]
        print(f"{n}: wall {(b - a) / 1000:.1f}s, {len(js)} jobs, job time {busy / 1000:.1f}s")
        for j in top:
            print(f"   {(j['end'] - j['start']) / 1000:6.2f}s stages={j['stages']} {j['site']}")


if __name__ == "__main__":
    main()
