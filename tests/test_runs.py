"""Run documents hold the whole log, in runs of bounded size."""

import json

import pyarrow as pa
import pyarrow.parquet as pq

from scribespark.plans.fixtures import request_log
from scribespark.queries import QUERIES, service


def test_whole_log_in_bounded_runs(spark, tmp_path, monkeypatch):
    n = 2503
    columns = {
        "event_id": pa.array(range(n), pa.int64()),
        "ts": pa.array([1_700_000_000_000_000 + i for i in range(n)], pa.timestamp("us")),
        "user_id": pa.array(range(n), pa.int64()),
        "event_type": [("click", "view", "error")[i % 3] for i in range(n)],
        "value": [i / 4 for i in range(n)],
        "props": [f'{{"k": {i % 50}}}' for i in range(n)],
    }
    pq.write_table(pa.table(columns), f"{tmp_path}/events.parquet")
    paths = []
    write = service.files.write_runs
    monkeypatch.setattr(service.files, "write_runs", lambda *a: paths.append(a[-1]) or write(*a))
    got = {r.file: r for r in QUERIES["run_json_explode"](spark, str(tmp_path)).collect()}
    want = {r.request_id: r for r in request_log(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(want) == list(range(n))
    assert all((got[i].status, got[i].model, got[i].audio_duration) == (want[i].status, want[i].model, want[i].audio_duration) for i in want)
    runs = [len(json.loads(r.value)["results"]) for r in spark.read.text(paths[0]).collect()]
    assert sorted(runs) == [503, 1000, 1000]
