"""Event streams: pairing, expiry and counts per window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

END = "EndOfInput"  # event type of the row that closes a finished input

PAIR_SCHEMA = "file_id BIGINT, start_id BIGINT, outcome STRING, duration_ms BIGINT"
_PAIR_STATE = "ts ARRAY<BIGINT>, ids ARRAY<BIGINT>, kinds ARRAY<STRING>, open_ts BIGINT, open_id BIGINT"


def pair_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Start/terminal pairs of a stream (file_id, id, event_type, created_at).

    Events wait until the watermark has passed them and are then read in
    (time, id) order, so a pair is the same as in the batch form. State per
    file: the waiting events of ``delay`` and one open start. Events behind the
    watermark are dropped by Spark and show in ``numRowsDroppedByWatermark``.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        ts, ids, kinds, open_ts, open_id = state.get if state.exists else ([], [], [], None, None)
        waiting = list(zip(ts, ids, kinds))
        if not state.hasTimedOut:
            for pdf in frames:
                waiting += [r for r in zip(pdf["us"].tolist(), pdf["id"].tolist(), pdf["event_type"].tolist()) if r[2] != END]
        mark = state.getCurrentWatermarkMs()
        waiting.sort()
        n = 0
        out = []
        for us, event, kind in waiting:
            if us // 1000 > mark:
                break
            n += 1
            if open_ts is not None and kind in ("Completed", "Failed"):
                out.append((key[0], open_id, kind, (us - open_ts) // 1000))
            open_ts, open_id = (us, event) if kind == "ProcessingStarted" else (None, None)
        rest = waiting[n:]
        if not rest and open_ts is None:
            state.remove()
        else:
            state.update(([w[0] for w in rest], [w[1] for w in rest], [w[2] for w in rest], open_ts, open_id))
            if rest:
                state.setTimeoutTimestamp(rest[0][0] // 1000)
        if out:
            yield pd.DataFrame(out, columns=["file_id", "start_id", "outcome", "duration_ms"])

    work = events.withColumn("us", F.unix_micros("created_at")).withWatermark("created_at", delay)
    return work.groupBy("file_id").applyInPandasWithState(step, PAIR_SCHEMA, _PAIR_STATE, "append", GroupStateTimeout.EventTimeTimeout)


EXPIRY_SCHEMA = "key STRING, since_ms BIGINT, expired_ms BIGINT"


def expiry_stream(events: DataFrame, key: str, start: list[str], end: list[str], ttl_minutes: int, delay: str = "1 minute") -> DataFrame:
    """Keys that started and saw no end within the time to live.

    Serves session expiry (30 minutes from creation) and the alert for batches
    that keep running. One timer per open key; the earliest start counts.
    """
    ttl = ttl_minutes * 60_000

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState):
        mark = state.getCurrentWatermarkMs()
        (waiting,) = state.get if state.exists else ([],)
        items = [(int(w.split("|")[0]), w.split("|")[1]) for w in waiting]
        if not state.hasTimedOut:
            for pdf in frames:
                items += [(ms, "s" if t in start else "e") for ms, t in zip(pdf["ms"].tolist(), pdf["event_type"]) if t != END]
        items.sort()
        out, opened, rest = [], None, []
        for i, (ms, kind) in enumerate(items):
            if ms > mark:
                rest = items[i:]
                break
            if opened is not None and ms > opened + ttl:
                out.append((str(k[0]), opened, opened + ttl))
                opened = None
            if kind == "s":
                opened = ms if opened is None else opened
            else:
                opened = None
        if opened is not None and mark > opened + ttl:
            out.append((str(k[0]), opened, opened + ttl))
            opened = None
        keep = ([(opened, "s")] if opened is not None else []) + rest
        if keep:
            state.update(([f"{ms}|{kind}" for ms, kind in keep],))
            first = opened + ttl if opened is not None else rest[0][0]
            state.setTimeoutTimestamp(max(min([first, *(r[0] for r in rest[:1])]), mark))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "since_ms", "expired_ms"])

    work = (
        events.filter(F.col("event_type").isin(*start, *end, END))
        .withColumn("ms", F.unix_millis("created_at"))
        .withWatermark("created_at", delay)
    )
    return work.groupBy(key).applyInPandasWithState(step, EXPIRY_SCHEMA, "waiting ARRAY<STRING>", "append", GroupStateTimeout.EventTimeTimeout)


def outcome_windows(events: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Outcomes and error codes per tumbling (or sliding) window."""
    window = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    return (
        events.withWatermark("created_at", delay)
        .groupBy(window.alias("w"), "event_type", "error_code")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "error_code", "n")
    )


def _drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available now and read what the watermark has passed."""
    _drain(stream, path, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_end(events: DataFrame, build: Callable[[DataFrame], DataFrame], clock: Callable[[], int], root: str) -> DataFrame:
    """All results of a finished input, those behind the last watermark included.

    ``build`` turns the events into the stream of results. After everything
    available is read, one row of type ``EndOfInput`` with the time ``clock()``
    (microseconds, see :func:`past_last`) enters
    through a second source of the same query, which goes on from its
    checkpoint: the watermark moves on, and the open state comes out through the
    operator itself. ``clock`` is asked after the first run. Empty inputs give no
    rows. A run that was interrupted can be repeated with the same ``root``.
    """
    spark = events.sparkSession
    marks, path, checkpoint = f"{root}/marks", f"{root}/out", f"{root}/checkpoint"
    spark.createDataFrame([], events.schema).write.mode("ignore").parquet(marks)
    ends = spark.readStream.schema(events.schema).parquet(marks)
    stream = build(events.unionByName(ends))
    _drain(stream, path, checkpoint)
    at = clock()
    if at is not None:
        row = {"event_type": F.lit(END), "created_at": F.timestamp_micros(F.lit(at))}
        fields = [row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
        spark.range(1).select(*fields).coalesce(1).write.mode("append").parquet(marks)
        _drain(stream, path, checkpoint)
    return spark.read.schema(stream.schema).parquet(path)


def past_last(events: DataFrame, delay_ms: int, extra_ms: int = 0) -> int | None:
    """The time of an end row that lifts the watermark one millisecond (and ``extra_ms``) past the last event; None without events."""
    last = events.agg(F.max(F.unix_millis(F.col("created_at").cast("timestamp")))).first()[0]
    return None if last is None else (last + 1 + delay_ms + extra_ms) * 1000


def window_ledger(events: DataFrame, path: str, checkpoint: str, width: str = "1 day") -> DataFrame:
    """Outcomes per window that count late rows too, however late.

    Each micro-batch writes its own counts per window (a repeated batch
    overwrites its folder), so no row waits for a watermark and none is dropped;
    a row behind the windows already written corrects them. Returns the sums, with
    ``n_batches``: how many micro-batches a window's counts came from. State does
    not grow; the ledger holds a row for each window, outcome and batch.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.window("created_at", width)["start"].alias("window_start"), "event_type", "error_code").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    codes = events.schema["error_code"].dataType.simpleString()
    ledger = spark.read.schema(f"window_start TIMESTAMP, event_type STRING, error_code {codes}, n BIGINT, batch BIGINT").parquet(path)
    return ledger.groupBy("window_start", "event_type", "error_code").agg(F.sum("n").alias("n"), F.count("*").alias("n_batches"))
