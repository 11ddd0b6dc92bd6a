"""Streams against their batch answers: order, replays, merged parts, last windows and unmatched calls."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shotloom.operators.calls import call_health
from shotloom.streaming import calls as sc
from shotloom.streaming import folded
from shotloom.streaming import stages as ss

T0 = datetime(2024, 1, 1)


def write_files(folder, rows, size):
    """Rows as line JSON, some per file, in the given order."""
    folder.mkdir()
    for i in range(0, len(rows), size):
        (folder / f"f{i:06d}.json").write_text("\n".join(json.dumps(r) for r in rows[i:i + size]) + "\n")


def stage_rows(rng, n):
    return [
        {"video_id": f"v{rng.randrange(6)}", "stage": rng.choice("ab"), "status": rng.choice(["running", "done", "failed", "skipped"]), "time": (T0 + timedelta(minutes=rng.randrange(400))).isoformat(),
         "seq": i, "error": rng.choice([None, None, f"e{i}"])} for i in range(n)
    ]


def by_row(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_stage_state_equals_batch_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = stage_rows(rng, 120) + [{"video_id": "v1", "stage": "a", "status": "done", "time": None, "seq": 999, "error": None}]
    rng.shuffle(rows)
    write_files(tmp_path / "in", rows, 12)
    q = ss.stream_stage_state(ss.read_stage_events(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/chk", every=3)
    q.awaitTermination()
    batch = ss.stage_state(spark.read.schema(ss.EVENT_SCHEMA).json(f"{tmp_path}/in"))
    assert by_row(ss.latest_state(spark, f"{tmp_path}/out")) == by_row(batch)
    assert batch.count() == 12


def test_parts_are_merged_and_replays_change_nothing(spark, tmp_path):
    rng = random.Random(5)
    out = f"{tmp_path}/out"
    events = [spark.createDataFrame([(r["video_id"], r["stage"], r["status"], datetime.fromisoformat(r["time"]), r["seq"], r["error"]) for r in stage_rows(rng, 10)], ss.EVENT_SCHEMA) for _ in range(12)]
    for n, e in enumerate(events):
        for _ in range(2 if n in (0, 5, 11) else 1):  # a trigger that is run again
            folded.fold_in(ss.partial_states(e), out, n, ss.merge_states, every=3)
        want = ss.stage_state(events[0].sparkSession.createDataFrame([r for x in events[:n + 1] for r in x.collect()], ss.EVENT_SCHEMA))
        if n % 4 == 3:
            assert by_row(ss.latest_state(spark, out)) == by_row(want)
    assert len(folded._numbers(spark, f"{out}/base", "upto")) <= 2 and len(folded._numbers(spark, f"{out}/part", "version")) <= 8


def call(i, kind, minute, parent=None, error=None):
    return {"call_id": f"c{i:03d}", "parent_call_id": parent, "record_type": kind, "function": f"f{i % 3}", "status": "failure" if error else "success", "error": error, "elapsed_sec": i / 8, "time": (T0 + timedelta(minutes=minute)).isoformat()}


def test_call_health_equals_batch(spark, tmp_path):
    rows = [call(i, "provider_call" if i % 4 == 0 else "function_call", 7 * i % 300, error="Request timed out" if i % 5 == 0 else None) for i in range(60)]
    write_files(tmp_path / "in", rows, 9)
    sc.stream_call_health(sc.read_calls(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/chk", every=2).awaitTermination()
    got = sc.call_health_table(spark, f"{tmp_path}/out")
    want = call_health(spark.read.schema(sc.CALL_SCHEMA).json(f"{tmp_path}/in")).where("function is not null")
    assert by_row(got) == by_row(want.select(*got.columns))


def test_heartbeat_brings_out_last_windows_and_unmatched_calls(spark, tmp_path):
    rows = [call(i, "function_call", 10 * i, error="Request timed out" if i % 2 else None) for i in range(12)] + [call(100 + i, "provider_call", 10 * i + 1, f"c{i:03d}") for i in (0, 3, 11)] + [call(200, "provider_call", 110, "c002")]
    write_files(tmp_path / "in", rows, 100)
    log = f"{tmp_path}/in"
    windows = lambda tag: by_row(spark.read.parquet(f"{tmp_path}/{tag}"))
    sc.append_stream(sc.stream_errors(sc.read_calls(spark, log)), f"{tmp_path}/open", f"{tmp_path}/c1").awaitTermination()
    open_windows = windows("open")
    sc.write_heartbeat(spark, log, T0 + timedelta(days=2))
    sc.append_stream(sc.stream_errors(sc.read_calls(spark, log)), f"{tmp_path}/closed", f"{tmp_path}/c2").awaitTermination()
    assert len(open_windows) < len(windows("closed"))
    batch = spark.read.schema(sc.CALL_SCHEMA).json(log).where("error is not null").groupBy(F.window("time", "1 hour")["start"].alias("w"), "function").count()
    assert sorted((str(r.window_start), r.stage, r.errors) for r in spark.read.parquet(f"{tmp_path}/closed").collect()) == sorted((str(r.w), r.function, r["count"]) for r in batch.collect())
    linked = sc.stream_link_calls(sc.read_calls(spark, log), sc.read_calls(spark, log))
    sc.append_stream(linked, f"{tmp_path}/links", f"{tmp_path}/c3").awaitTermination()
    got = {r.call_id: r.raw_call_id for r in spark.read.parquet(f"{tmp_path}/links").collect()}
    assert got == {f"c{i:03d}": {0: "c100", 3: "c103", 11: "c111"}.get(i) for i in range(12)}  # c200 lies more than an hour after c002
