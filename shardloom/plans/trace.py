"""Reports from a Spark event log: what each stage cost, and how its tasks were spread.

Reads the (uncompressed, unrolled) JSON log line by line; memory is one list of durations per stage."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field


@dataclass
class Stage:
    id: int
    name: str = ""
    seconds: list[float] = field(default_factory=list)
    failed: int = 0
    rows_in: int = 0
    rows_out: int = 0
    shuffle_read: int = 0
    shuffle_written: int = 0
    spilled: int = 0

    def quartiles(self) -> tuple[float, float, float, float, float]:
        """Least, lower quartile, median, upper quartile and largest task time."""
        s = sorted(self.seconds)
        if not s:
            return (0.0,) * 5
        at = lambda q: s[min(len(s) - 1, round(q * (len(s) - 1)))]
        return at(0), at(0.25), at(0.5), at(0.75), at(1)


def stages(lines: Iterable[str]) -> list[Stage]:
    """Stages of a log in order of their numbers."""
    found: dict[int, Stage] = defaultdict(lambda: Stage(-1))
    for line in lines:
        event = json.loads(line)
        kind = event["Event"]
        if kind == "SparkListenerStageCompleted":
            info = event["Stage Info"]
            stage = found[info["Stage ID"]]
            stage.id, stage.name = info["Stage ID"], info["Stage Name"]
        elif kind == "SparkListenerTaskEnd":
            stage = found[event["Stage ID"]]
            stage.id = event["Stage ID"]
            if event["Task End Reason"]["Reason"] != "Success":
                stage.failed += 1
                continue
            m = event.get("Task Metrics") or {}
            read, write = m.get("Shuffle Read Metrics", {}), m.get("Shuffle Write Metrics", {})
            stage.seconds.append(m.get("Executor Run Time", 0) / 1000)
            stage.rows_in += m.get("Input Metrics", {}).get("Records Read", 0) + read.get("Total Records Read", 0)
            stage.rows_out += m.get("Output Metrics", {}).get("Records Written", 0) + write.get("Shuffle Records Written", 0)
            stage.shuffle_read += read.get("Remote Bytes Read", 0) + read.get("Local Bytes Read", 0)
            stage.shuffle_written += write.get("Shuffle Bytes Written", 0)
            stage.spilled += m.get("Disk Bytes Spilled", 0)
    return [found[k] for k in sorted(found)]


def summary(path: str) -> str:
    """One line a stage: tasks, total seconds, quartiles, rows, megabytes shuffled and spilled."""
    with open(path) as lines:
        out = [f"{'stage':>5} {'tasks':>5} {'fail':>4} {'sum s':>8} {'min':>7} {'q1':>7} {'median':>7} {'q3':>7} {'max':>7} {'rows in':>12} {'rows out':>12} {'MB read':>8} {'MB out':>8} {'spilled':>8}  name"]
        for s in stages(lines):
            q = " ".join(f"{x:7.2f}" for x in s.quartiles())
            mb = " ".join(f"{x / 1e6:8.1f}" for x in (s.shuffle_read, s.shuffle_written, s.spilled))
            out.append(f"{s.id:5d} {len(s.seconds):5d} {s.failed:4d} {sum(s.seconds):8.1f} {q} {s.rows_in:12d} {s.rows_out:12d} {mb}  {s.name}")
    return "\n".join(out)


if __name__ == "__main__":
    import sys

    for name in sys.argv[1:]:
        print(summary(name))
