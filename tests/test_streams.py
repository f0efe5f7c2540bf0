"""Streams against their batch forms: several batches, restarts after failures, late rows, malformed lines."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textmill.operators import events as O
from textmill.streaming import events as ST

SCHEMA = "user_id long, ts timestamp, event_id long, value double"
BEGIN = datetime(2024, 1, 1)


def some_events(seed, n, minutes=2000):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), BEGIN + timedelta(minutes=rng.randrange(minutes), microseconds=rng.randrange(3)), i, float(rng.randrange(9))) for i in range(n)]
    return sorted(rows, key=lambda r: (r[1], r[2]))


def write_files(spark, rows, folder, names):
    """Files whose times of change follow their order."""
    for k, name in enumerate(names):
        part = rows[k * len(rows) // len(names) : (k + 1) * len(rows) // len(names)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")
        time.sleep(0.05)


def stream_of(spark, folder, like, files=1):
    return ST.read_events(spark, f"{folder}/*", like, files)


def test_admission_in_batches_equals_the_batch_query_also_after_a_restart(spark, tmp_path):
    rows = some_events(1, 240)
    like = spark.createDataFrame(rows, SCHEMA)
    expected = sorted((r["event_id"], r["admitted"]) for r in O.admitted(like.select("user_id", "ts", "event_id"), "user_id", "ts", 3, 6 * 3600).collect())
    state = str(tmp_path / "state")
    source = str(tmp_path / "in")

    def drained():
        stream = stream_of(spark, source, like).select("user_id", "ts", "event_id")
        return ST.run_once(ST.admitted_stream(stream, "user_id", "ts", ["event_id"], 3, 6 * 3600), "x", state, "append")

    write_files(spark, rows[:120], source, ["a", "b", "c"])
    half = drained()
    assert half.count() == 120
    write_files(spark, rows[120:], source, ["d", "e"])
    out = drained()  # a new query on the old checkpoint
    assert sorted((r["event_id"], r["admitted"]) for r in out.collect()) == expected
    assert not out.where("late").count()
    write_files(spark, [(1, BEGIN + timedelta(minutes=1), 999, 0.0), (2, None, 1000, 0.0)], source, ["late"])
    last = {r["event_id"]: (r["admitted"], r["late"]) for r in drained().where("event_id >= 999").collect()}
    assert last.get(999, (False, True)) == (False, True) and len([1 for _ in drained().collect()]) in (241, 242)


def test_a_failed_batch_is_written_once(spark, tmp_path, monkeypatch):
    rows = some_events(2, 90)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    write_files(spark, rows, source, ["a", "b", "c"])
    like = spark.createDataFrame(rows, SCHEMA)
    real, calls = ST.save_batch, []

    def failing(path, replace=False):
        save = real(path, replace)

        def run(batch, number):
            calls.append(number)
            if number == 1 and calls.count(1) == 1:
                batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")  # rows, but no mark
                raise RuntimeError("killed between rows and mark")
            save(batch, number)

        return run

    monkeypatch.setattr(ST, "save_batch", failing)
    with pytest.raises(Exception, match="killed"):
        ST.run_once(stream_of(spark, source, like), "x", state, "append")
    assert ST.saved(spark, f"{state}/table", like.schema).count() == 30  # what is not marked is not there
    out = ST.run_once(stream_of(spark, source, like), "x", state, "append")
    assert sorted(r["event_id"] for r in out.collect()) == list(range(90)) == sorted(r[2] for r in rows)
    assert calls == [0, 1, 1, 2]
    assert ST.run_once(stream_of(spark, source, like), "x", state, "append").count() == 90


def test_complete_results_replace_each_other(spark, tmp_path):
    rows = some_events(3, 100)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    like = spark.createDataFrame(rows, SCHEMA)
    write_files(spark, rows[:50], source, ["a"])
    counted = lambda: ST.run_once(stream_of(spark, source, like).groupBy("user_id").agg(F.count("*").alias("n")), "x", state)
    assert counted().agg(F.sum("n")).first()[0] == 50
    write_files(spark, rows[50:], source, ["b", "c"])
    assert counted().agg(F.sum("n")).first()[0] == 100


def test_sessions_and_late_rows(spark, tmp_path):
    rows = [r for r in some_events(4, 150) if r[0] is not None]
    like = spark.createDataFrame(rows, SCHEMA)
    batch = sorted(map(repr, ST.sessions(like, "user_id", "40 minutes").collect()))
    source = str(tmp_path / "in")
    write_files(spark, rows, source, ["a", "b", "c", "d"])
    stream = ST.sessions(stream_of(spark, source, like), "user_id", "40 minutes", "10 minutes")
    assert sorted(map(repr, ST.run_once(stream, "x", str(tmp_path / "complete")).collect())) == batch
    # appended sessions are those the watermark has closed; an old row is counted as late
    write_files(spark, [(1, BEGIN - timedelta(days=3), 5000, 1.0), (1, BEGIN + timedelta(days=30), 5001, 1.0)], source, ["old", "z"])
    again = ST.sessions(stream_of(spark, source, like), "user_id", "40 minutes", "10 minutes")
    late = ST.drain(again, str(tmp_path / "append"), "append")
    found = ST.saved(spark, str(tmp_path / "append" / "table"), again.schema)
    assert late >= 1 and sorted(map(repr, found.collect())) == batch


def test_event_logs(spark, tmp_path):
    folder, into = tmp_path / "log", str(tmp_path / "into")
    folder.mkdir()
    line = lambda i, n, v="x": json.dumps({"event_id": i, "seq": n, "value": v})
    (folder / "1.jsonl").write_text("\n".join([line("a", 1), line("b", 2), "{broken", line("c", 6), "", "[1, 2]", line("a", 7, "again")]) + "\n")
    (folder / "2.jsonl").write_text("\n".join([line("b", 1, "copy"), line("d", 2), line("e", None)]) + "\n")
    schema = spark.createDataFrame([], "event_id string, seq long, value string").schema
    events, quarantine, gaps = ST.collect_log(spark, str(folder), schema, "event_id", "seq", into)
    assert sorted((r["event_id"], r["_file"], r["seq"], r["value"]) for r in events.where("seq IS NOT NULL").collect()) == [("a", "1.jsonl", 1, "x"), ("b", "1.jsonl", 2, "x"), ("c", "1.jsonl", 6, "x"), ("d", "2.jsonl", 2, "x")]
    assert events.count() == 5
    assert [r["file"] for r in quarantine.collect()] == ["1.jsonl", "1.jsonl"] and all(len(r["checksum"]) == 64 for r in quarantine.collect())
    assert sorted(tuple(r) for r in gaps.collect()) == [("1.jsonl", 3, 5)]
    (folder / "3.jsonl").write_text(line("f", 4) + "\n" + line("a", 9) + "\n")
    events, quarantine, gaps = ST.collect_log(spark, str(folder), schema, "event_id", "seq", into)
    assert events.count() == 6 and quarantine.count() == 2 and sorted(tuple(r) for r in gaps.collect()) == [("1.jsonl", 3, 5), ("3.jsonl", 5, 8)]


def test_gaps_in_and_between_blocks(spark):
    rng = random.Random(3)
    rows = [(k, n) for k in "ab" for n in rng.sample(range(-300, 900), 200)] + [("a", None), ("c", 5), ("c", 5)]
    rows += rows[:20]
    expected = []
    for k in "abc":
        own = sorted({n for j, n in rows if j == k and n is not None})
        expected += [(k, a + 1, b - 1) for a, b in zip(own, own[1:], strict=False) if b > a + 1]
    frame = spark.createDataFrame(rows, "k string, n long")
    for block in (7, 1 << 16):
        assert sorted(tuple(r) for r in O.gaps(frame, "k", "n", block).collect()) == sorted(expected)
    assert O.gaps(frame.limit(0), "k", "n").collect() == []
