"""Finished streams: results behind the watermark, late rows, empty inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.audit import processing_pairs
from cloakframe.streaming.events import expiry_stream, outcome_windows, pair_stream, past_last, run_to_end, window_ledger
from cloakframe.workload import load

EVENT = "id LONG, file_id LONG, event_type STRING, error_code STRING, created_at TIMESTAMP"
KINDS = ["Queued", "ProcessingStarted", "Completed", "Failed"]


def _rows(n=400, seed=5):
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return [(i, rng.randint(1, 15), rng.choice(KINDS), None, at + dt.timedelta(seconds=rng.randint(0, 200_000))) for i in range(n)]


def _stream(spark, rows, path, files=1, per_batch=None):
    events = spark.createDataFrame(rows, EVENT)
    events.repartition(files, F.hash("id")).write.parquet(path)
    reader = spark.readStream.schema(events.schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return events, reader.parquet(path)


def test_pairs_of_the_last_hour_come_out(spark, tmp_path):
    events, stream = _stream(spark, _rows(), str(tmp_path / "in"))
    out = run_to_end(stream, pair_stream, lambda: past_last(events, 3_600_000), str(tmp_path))
    want = processing_pairs(events).select("file_id", "start_id", "outcome", "duration_ms")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_expiry_counts_up_to_the_last_event(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    minutes = [("Queued", 1, 0), ("Queued", 2, 10), ("Queued", 3, 31), ("Completed", 2, 40), ("Queued", 4, 70)]
    rows = [(i, f, k, None, at + dt.timedelta(minutes=m)) for i, (k, f, m) in enumerate(minutes)]
    events, stream = _stream(spark, rows, str(tmp_path / "in"))
    build = lambda e: expiry_stream(e, "file_id", ["Queued"], ["Completed"], 30)
    out = run_to_end(stream, build, lambda: past_last(events, 60_000), str(tmp_path))
    assert sorted(r.key for r in out.collect()) == ["1", "3"]


def test_windows_of_the_last_day_come_out(spark, tmp_path):
    rows = _rows()
    events, stream = _stream(spark, rows, str(tmp_path / "in"))
    out = run_to_end(stream, outcome_windows, lambda: past_last(events, 3_600_000, 86_400_000), str(tmp_path)).collect()
    assert sum(r.n for r in out) == len(rows)
    assert {r.event_type for r in out} == set(KINDS)


def test_ledger_counts_late_rows(spark, tmp_path):
    rows = _rows()
    events, stream = _stream(spark, rows, str(tmp_path / "in"), files=6, per_batch=1)
    out = window_ledger(stream, str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    want = events.groupBy(F.window("created_at", "1 day")["start"].alias("w"), "event_type").agg(F.count("*").alias("n")).collect()
    assert sorted((r.window_start, r.event_type, r.n) for r in out) == sorted((r.w, r.event_type, r.n) for r in want)
    assert max(r.n_batches for r in out) > 1


def test_empty_input_and_null_keys(spark, tmp_path):
    events, stream = _stream(spark, [], str(tmp_path / "in"))
    assert run_to_end(stream, pair_stream, lambda: past_last(events, 3_600_000), str(tmp_path)).count() == 0
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, None, "ProcessingStarted", None, at), (2, None, "Completed", None, at + dt.timedelta(seconds=1)), (3, 7, None, None, at)]
    events, stream = _stream(spark, rows, str(tmp_path / "in2"))
    out = run_to_end(stream, pair_stream, lambda: past_last(events, 3_600_000), str(tmp_path / "b")).collect()
    assert [(r.file_id, r.start_id, r.duration_ms) for r in out] == [(None, 1, 1000)]


@pytest.mark.parametrize("name", ["stream_mask_available_now", "stream_mask_with_terms"])
def test_masking_streams_read_a_folder_of_files(spark, tmp_path, name):
    texts = [(i, f"call 1390000000{i} or write to alpha{i}@example.com") for i in range(6)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "write home")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = load().QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(6))
    assert all("***PHONE***" in r.masked for r in got)
