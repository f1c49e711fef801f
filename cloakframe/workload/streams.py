"""Streaming queries run over the shared tables with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.plans.rules import default_rules
from cloakframe.streaming.events import expiry_stream, outcome_windows, pair_stream, past_last, run_to_end, window_ledger
from cloakframe.streaming.masking import file_stream, mask_stream, read_stream_output
from cloakframe.streaming.workdir import work_dir
from cloakframe.workload.auditing import VIEWS, ctes, view
from cloakframe.workload.library import TERMS_MASKED_SQL, library
from cloakframe.workload.mask_sql import mask_ctes
from cloakframe.workload.masking import DOCS
from cloakframe.workload.registry import query, table


MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def _stream(spark, sf, name):
    # a glob in the path takes a table that is one file and one that is a folder of files
    return file_stream(spark, f"{sf}/[{name[0]}]{name[1:]}.parquet", table(spark, sf, name).schema)


def _job_events(spark, sf):
    _, sql = VIEWS["job_events"]
    return spark.sql(sql, events=_stream(spark, sf, "events")).withColumn("created_at", F.col("created_at").cast("timestamp"))


def _to_end(spark, sf, name, columns, build, delay_ms, extra_ms=0):
    """All results over the finished event table."""
    return run_to_end(_job_events(spark, sf).select(*columns), build, lambda: past_last(view(spark, sf, "job_events"), delay_ms, extra_ms), work_dir(spark, name))


@query(
    "stream_mask_available_now",
    f"WITH {mask_ctes(DOCS)} SELECT k AS doc_id, masked, n AS masked_entity_count FROM masked",
    covers="X1 X2",
)
def q_mask(spark, sf):
    root = work_dir(spark, "mask")
    docs = _stream(spark, sf, "documents").select("doc_id", "text")
    mask_stream(docs, "doc_id", "text", default_rules(), f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    return read_stream_output(spark, f"{root}/out").select("doc_id", "masked", "masked_entity_count")


@query("stream_mask_with_terms", TERMS_MASKED_SQL, covers="X6")
def q_mask_terms(spark, sf):
    root = work_dir(spark, "mask-terms")
    docs = _stream(spark, sf, "documents").select("doc_id", "text")
    mask_stream(
        docs, "doc_id", "text", default_rules(), f"{root}/out", f"{root}/checkpoint", terms=lambda: library(spark, sf), available_now=True
    ).awaitTermination()
    return read_stream_output(spark, f"{root}/out").select("doc_id", "masked", "masked_entity_count")


@query(
    "stream_pairs",
    ctes("job_events") + """, nxt AS (SELECT *, lead(event_type) OVER w AS nt, lead(created_at) OVER w AS ne FROM job_events WINDOW w AS (PARTITION BY file_id ORDER BY created_at, id))
    SELECT file_id, id AS start_id, nt AS outcome, (epoch_us(ne) - epoch_us(created_at)) // 1000 AS duration_ms FROM nxt
    WHERE event_type = 'ProcessingStarted' AND nt IN ('Completed', 'Failed')""",
    covers="X3",
)
def q_pairs(spark, sf):
    return _to_end(spark, sf, "pairs", ["file_id", "id", "event_type", "created_at"], pair_stream, HOUR)


@query(
    "stream_daily_outcomes",
    ctes("job_events") + """SELECT CAST(date_trunc('day', created_at) AS VARCHAR)[1:10] AS day, event_type, error_code, count(*) AS n FROM job_events
    GROUP BY ALL""",
    covers="X5",
)
def q_daily(spark, sf):
    done = _to_end(spark, sf, "daily", ["event_type", "error_code", "created_at"], outcome_windows, HOUR, extra_ms=DAY)
    return done.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "error_code", "n")


@query(
    "stream_late_outcomes",
    ctes("job_events") + """SELECT CAST(date_trunc('day', created_at) AS VARCHAR)[1:10] AS day, event_type, error_code, count(*) AS n FROM job_events GROUP BY ALL""",
    covers="X5",
)
def q_late(spark, sf):
    """The events arrive shuffled over eight files and as many micro-batches; every window is corrected by what comes late."""
    root = work_dir(spark, "late")
    events = view(spark, sf, "job_events").withColumn("created_at", F.col("created_at").cast("timestamp"))
    events.repartition(8, F.hash("id")).write.parquet(f"{root}/in")
    arriving = file_stream(spark, f"{root}/in", events.schema, max_files=1)
    done = window_ledger(arriving, f"{root}/out", f"{root}/checkpoint")
    return done.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "error_code", "n")


def expiry_sql(key: str, start: str, ttl_minutes: int) -> str:
    """The expiry rule read event by event."""
    ttl = ttl_minutes * 60_000
    return "WITH RECURSIVE " + ctes("job_events").removeprefix("WITH ") + f""", e AS (
        SELECT CAST({key} AS VARCHAR) AS key, epoch_us(created_at) // 1000 AS ms, CASE WHEN event_type = '{start}' THEN 's' ELSE 'e' END AS kind
        FROM job_events WHERE event_type IN ('{start}', 'Completed', 'Failed')),
    z AS (SELECT max(epoch_us(created_at) // 1000) + 1 AS mark FROM job_events),
    m AS (SELECT key, ms, kind, row_number() OVER (PARTITION BY key ORDER BY ms, kind) AS rn FROM e),
    r AS (SELECT DISTINCT key, 0::BIGINT AS rn, NULL::BIGINT AS opened, NULL::BIGINT AS fired FROM m
        UNION ALL SELECT m.key, m.rn,
            CASE WHEN m.kind = 'e' THEN NULL WHEN r.opened IS NULL OR m.ms > r.opened + {ttl} THEN m.ms ELSE r.opened END,
            CASE WHEN m.ms > r.opened + {ttl} THEN r.opened END
        FROM r JOIN m ON m.key = r.key AND m.rn = r.rn + 1),
    done AS (SELECT key, fired FROM r WHERE fired IS NOT NULL
        UNION ALL SELECT key, opened FROM (SELECT key, arg_max(opened, rn) FILTER (WHERE opened IS NOT NULL) AS opened, max(rn) AS last, max(rn) FILTER (WHERE opened IS NOT NULL) AS open_rn FROM r GROUP BY key), z
        WHERE last = open_rn AND mark > opened + {ttl})
    SELECT key, fired AS since_ms, fired + {ttl} AS expired_ms FROM done"""


@query("stream_expired_sessions", expiry_sql("file_id", "Queued", 30), covers="X4")
def q_expired(spark, sf):
    return _to_end(spark, sf, "expired", ["file_id", "event_type", "created_at"], lambda e: expiry_stream(e, "file_id", ["Queued"], ["Completed", "Failed"], 30), MINUTE)


@query("stream_stuck_batches", expiry_sql("batch_id", "ProcessingStarted", 60), covers="X7")
def q_stuck(spark, sf):
    return _to_end(spark, sf, "stuck", ["batch_id", "event_type", "created_at"], lambda e: expiry_stream(e, "batch_id", ["ProcessingStarted"], ["Completed", "Failed"], 60), MINUTE)
