"""Summarise stage times from a Spark event log (no UI involved).

usage: python tools/stage_times.py <event-log-dir-or-file> [top_n]
Prints, per SQL execution, its wall time and its slowest stages with task
counts, so a plan's cost can be traced to the stage that carries it.
"""

from __future__ import annotations

import glob
import json
import os
import sys


def events(path: str):
    files = [path] if os.path.isfile(path) else sorted(
        f for f in glob.glob(os.path.join(path, "**", "*"), recursive=True)
        if os.path.isfile(f) and not os.path.basename(f).startswith("appstatus"))
    for f in files:
        with open(f, "rb") as fh:
            raw = fh.read()
        if f.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(raw).read()
        for line in raw.decode("utf-8", "replace").splitlines():
            try:
                yield json.loads(line)
            except ValueError:
                continue


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 3
    execs, stages, job_exec, stage_job = {}, {}, {}, {}
    for e in events(path):
        ev = e.get("Event", "")
        if ev.endswith("SparkListenerSQLExecutionStart"):
            execs[e["executionId"]] = {"desc": e.get("description", ""), "start": e["time"], "end": None}
        elif ev.endswith("SparkListenerSQLExecutionEnd"):
            if e["executionId"] in execs:
                execs[e["executionId"]]["end"] = e["time"]
        elif ev == "SparkListenerJobStart":
            eid = (e.get("Properties") or {}).get("spark.sql.execution.id")
            for sid in e.get("Stage IDs", []):
                stage_job[sid] = int(eid) if eid is not None else None
        elif ev == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            if "Submission Time" in info and "Completion Time" in info:
                stages[info["Stage ID"]] = (info["Completion Time"] - info["Submission Time"],
                                            info["Number of Tasks"], info["Stage Name"][:60])
    by_exec: dict = {}
    for sid, (ms, tasks, name) in stages.items():
        by_exec.setdefault(stage_job.get(sid), []).append((ms, sid, tasks, name))
    for eid, x in sorted(execs.items()):
        wall = (x["end"] - x["start"]) if x["end"] else None
        print(f"execution {eid}: {wall} ms  {x['desc'][:70]}")
        for ms, sid, tasks, name in sorted(by_exec.get(eid, []), reverse=True)[:top]:
            print(f"    stage {sid:5d} {ms:7d} ms  {tasks:4d} tasks  {name}")


if __name__ == "__main__":
    main()
