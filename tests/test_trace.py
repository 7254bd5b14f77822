import json

from shardloom.plans import trace


def end(stage, ms, reason="Success"):
    metrics = {"Executor Run Time": ms, "Input Metrics": {"Records Read": 10}, "Shuffle Write Metrics": {"Shuffle Bytes Written": 1000, "Shuffle Records Written": 5}, "Shuffle Read Metrics": {"Local Bytes Read": 7, "Remote Bytes Read": 3, "Total Records Read": 1}, "Disk Bytes Spilled": 2}
    return {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task End Reason": {"Reason": reason}, "Task Metrics": metrics}


def test_summary(tmp_path):
    events = [{"Event": "SparkListenerLogStart"}, *(end(0, ms) for ms in (1000, 2000, 3000, 4000, 5000)), end(0, 9, "ExceptionFailure"), end(1, 500), {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 0, "Stage Name": "scan"}}]
    first, second = trace.stages(map(json.dumps, events))
    assert first.quartiles() == (1, 2, 3, 4, 5) and (first.name, first.failed, first.rows_in, first.rows_out) == ("scan", 1, 55, 25)
    assert (first.shuffle_read, first.shuffle_written, first.spilled) == (50, 5000, 10)
    assert second.id == 1 and trace.Stage(3).quartiles() == (0, 0, 0, 0, 0)
    path = tmp_path / "log"
    path.write_text("\n".join(map(json.dumps, events)))
    assert len(trace.summary(str(path)).splitlines()) == 3
