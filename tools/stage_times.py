"""Summarise stage and job times from a Spark event log (no UI needed).

usage: python tools/stage_times.py <event-log dir or file> [job-group]
Run the job with spark.eventLog.enabled=true and spark.eventLog.dir set to a
scratch folder; tag work with sparkContext.setJobGroup to filter.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path):
    files = sorted(glob.glob(os.path.join(path, "events*"))) if os.path.isdir(path) else [path]
    for f in files:
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        yield from raw.decode().splitlines()


def summarise(path, group=None):
    stages, jobs = {}, {}
    for line in _lines(path):
        e = json.loads(line)
        ev = e["Event"]
        if ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = ((si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000,
                                      si["Stage Name"][:60], si["Number of Tasks"])
        elif ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], (e.get("Properties") or {}).get("spark.jobGroup.id"),
                                 e["Stage IDs"], None]
        elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]][3] = e["Completion Time"]
    out = []
    for j, (start, g, sids, end) in sorted(jobs.items()):
        if group is not None and g != group:
            continue
        out.append({"job": j, "group": g, "sec": round(((end or start) - start) / 1000, 3),
                    "stages": [{"id": s, "sec": stages[s][0], "name": stages[s][1], "tasks": stages[s][2]}
                               for s in sids if s in stages]})
    return out


if __name__ == "__main__":
    for job in summarise(sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else None):
        print(json.dumps(job))
