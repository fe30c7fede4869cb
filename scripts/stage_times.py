"""Per-stage task statistics from a Spark event log (no UI needed).

Usage: python scripts/stage_times.py <event-log-file-or-folder> [top_n]
Prints the stages with the largest max task time: tasks, median and max task
time (ms), the max/median ratio (skew) and shuffle read of the largest task.
"""

from __future__ import annotations

import json
import os
import statistics
import sys


def _files(path):
    if not os.path.isdir(path):
        return [path]
    out = []
    for root, _, names in os.walk(path):
        out += [os.path.join(root, n) for n in sorted(names) if not n.startswith(("appstatus", "."))]
    return sorted(out)


def _lines(f):
    if f.endswith(".zstd"):
        import io
        import zstandard
        with open(f, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(f) as fh:
            yield from fh


def events(path):
    for f in _files(path):
        for line in _lines(f):
            if line.strip():
                yield json.loads(line)


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    tasks: dict[tuple, list] = {}
    names: dict[tuple, str] = {}
    for e in events(path):
        kind = e.get("Event")
        if kind == "SparkListenerTaskEnd" and e.get("Task Info"):
            key = (e["Stage ID"], e["Stage Attempt ID"])
            info, metrics = e["Task Info"], e.get("Task Metrics") or {}
            read = (metrics.get("Shuffle Read Metrics") or {})
            rb = read.get("Remote Bytes Read", 0) + read.get("Local Bytes Read", 0)
            tasks.setdefault(key, []).append((info["Finish Time"] - info["Launch Time"], rb))
        elif kind == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            names[(si["Stage ID"], si["Stage Attempt ID"])] = si.get("Stage Name", "")[:60]
    rows = []
    for key, ts in tasks.items():
        times = [t for t, _ in ts]
        med = statistics.median(times)
        mx = max(ts)
        rows.append((mx[0], key, len(ts), med, mx[1], names.get(key, "")))
    rows.sort(reverse=True)
    print(f"{'stage':>8} {'tasks':>6} {'median_ms':>10} {'max_ms':>8} {'skew':>6} {'max_task_read_MB':>16}  name")
    for mx, key, n, med, rb, name in rows[:top]:
        skew = mx / med if med else float("inf")
        print(f"{key[0]:>8} {n:>6} {med:>10.0f} {mx:>8.0f} {skew:>6.1f} {rb / 1e6:>16.2f}  {name}")


if __name__ == "__main__":
    main()
