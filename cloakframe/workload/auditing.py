"""Operational queries over views derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import audit as a
from cloakframe.operators.mask import mask_documents
from cloakframe.plans.rules import default_rules
from cloakframe.workload.mask_sql import mask_ctes
from cloakframe.workload.masking import DOCS
from cloakframe.workload.registry import query, table

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

# The same definitions serve Spark and DuckDB; {hours} and {ntz} differ.
VIEWS = {
    "job_events": ("events", """SELECT event_id AS id, 'b' || (user_id % 20) AS batch_id, user_id AS file_id,
        CASE event_type WHEN 'signup' THEN 'Queued' WHEN 'click' THEN 'ProcessingStarted' WHEN 'view' THEN 'Completed'
            WHEN 'error' THEN 'Failed' ELSE 'RetryQueued' END AS event_type,
        CASE event_type WHEN 'view' THEN 'Completed' WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'Processing' ELSE 'Pending' END AS status,
        CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'INPUT_CORRUPTED' ELSE 'OCR_TIMEOUT' END END AS error_code,
        ts AS created_at FROM {events}"""),
    "batch_files": ("documents", """SELECT doc_id AS id, source AS batch_id, 'doc-' || doc_id || '.txt' AS display_name, 'text' AS input_format,
        CASE WHEN doc_id % 10 = 9 THEN 'Failed' WHEN doc_id % 25 = 3 THEN 'Pending' WHEN doc_id % 50 = 7 THEN 'Processing' ELSE 'Completed' END AS status,
        1 AS attempt,
        CASE WHEN doc_id % 10 = 9 OR doc_id % 25 = 3 OR doc_id % 50 = 7 THEN NULL ELSE n_chars % 17 END AS masked_entity_count,
        CASE WHEN doc_id % 10 = 9 OR doc_id % 25 = 3 OR doc_id % 50 = 7 THEN NULL ELSE 'art-' || doc_id END AS artifact_id,
        CASE WHEN doc_id % 10 = 9 OR doc_id % 25 = 3 OR doc_id % 50 = 7 OR doc_id % 4 = 0 THEN NULL ELSE 'map-' || doc_id END AS mapping_object_key,
        CASE WHEN doc_id % 10 = 9 THEN 'INPUT_CORRUPTED' END AS error_code,
        CASE WHEN doc_id % 10 = 9 THEN 'broken' END AS error_message,
        {hours} AS created_at, {hours} AS updated_at FROM {documents}"""),
    "batches": ("documents", """SELECT DISTINCT source AS id, 'Running' AS status FROM {documents}"""),
    "artifacts": ("documents", """SELECT 'art-' || doc_id AS id, source AS batch_id, doc_id AS file_id,
        CASE WHEN doc_id % 6 = 0 THEN 'excel' ELSE 'markdown' END AS artifact_kind, n_chars AS size_bytes, {hours} AS created_at
        FROM {documents} WHERE doc_id % 12 <> 5"""),
    "restore_events": ("orders", """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'RestoreSucceeded' WHEN 'O' THEN 'RestoreFailed' ELSE 'RestoreOther' END AS event_type,
        CASE o_orderstatus WHEN 'F' THEN 'success' ELSE 'failed' END AS status, CASE o_orderstatus WHEN 'O' THEN 'CMAP_MISMATCH' END AS error_code,
        o_orderkey % 9 AS restored_entity_count, o_orderdate AS timestamp FROM {orders}"""),
    "upload_events": ("orders", """SELECT o_orderkey AS id, 'b' || (o_custkey % 20) AS batch_id, o_custkey AS file_id, 'order-' || o_orderkey AS display_name,
        CASE WHEN o_orderkey % 2 = 0 THEN 'success' ELSE 'failed' END AS status, CAST(NULL AS STRING) AS error_code, o_orderdate AS created_at
        FROM {orders} WHERE o_orderpriority = '1-URGENT'"""),
    "previews": ("customer", """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Ready' WHEN 1 THEN 'ReadyWithErrors' WHEN 2 THEN 'Confirming'
        WHEN 3 THEN 'Confirmed' WHEN 4 THEN 'Processing' ELSE 'Failed' END AS status, CASE WHEN c_custkey % 6 IN (2, 3) THEN 1 ELSE 0 END AS confirming,
        CASE WHEN c_custkey % 6 = 3 THEN 'old-' || c_custkey END AS confirmed_batch_id, {expires} AS expires_at FROM {customer}"""),
    "preview_files": ("orders", """SELECT o_orderkey AS id, o_custkey AS preview_id, CASE WHEN o_custkey % 5 = 0 THEN 'Ready' WHEN o_custkey % 5 = 1 AND o_orderkey % 2 = 0 THEN 'Ready'
        WHEN o_custkey % 5 = 2 AND o_orderkey % 3 = 0 THEN 'Pending' ELSE 'Failed' END AS status, o_orderkey % 13 AS masked_entity_count, o_orderdate AS created_at FROM {orders}"""),
    "history": ("lineitem", """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status,
        CAST(l_quantity AS INT) AS masked_count, CAST(l_quantity * 10 + l_linenumber AS BIGINT) AS processing_time_ms, l_shipdate AS created_at FROM {lineitem}"""),
    "managed_files": ("part", """SELECT p_partkey AS id, p_name AS original_name, 'masked ' || p_brand AS masked_name, p_size % 2 = 0 AS uploaded, p_size * 1000 AS size_bytes,
        {added} AS created_at FROM {part}"""),
}
_SPARK = {
    "hours": "timestampadd(HOUR, CAST(doc_id AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')",
    "expires": "timestampadd(MINUTE, CAST(c_custkey AS INT), TIMESTAMP_NTZ '2024-01-30 12:00:00')",
    "added": "timestampadd(MINUTE, CAST(p_partkey AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')",
}
_DUCK = {
    "hours": "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INT))",
    "expires": "TIMESTAMP '2024-01-30 12:00:00' + to_minutes(c_custkey)",
    "added": "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey)",
}


def view(spark, sf, name):
    base, sql = VIEWS[name]
    for k, v in _SPARK.items():
        sql = sql.replace("{" + k + "}", v)
    return spark.sql(sql, **{base: table(spark, sf, base)})


def ctes(*names: str) -> str:
    out = []
    for name in names:
        base, sql = VIEWS[name]
        for k, v in _DUCK.items():
            sql = sql.replace("{" + k + "}", v)
        out.append(f"{name} AS ({sql.replace('{' + base + '}', base)})")
    return "WITH " + ", ".join(out) + " "


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


# --- joins and roll-ups ---


@query(
    "next_pending",
    ctes("batch_files", "batches") + "SELECT f.id, f.batch_id, b.status AS parent_status FROM batch_files f JOIN batches b ON b.id = f.batch_id WHERE f.status = 'Pending' ORDER BY f.created_at, f.id LIMIT 7",
    covers="J1 L6",
)
def q_next(spark, sf):
    return a.backlog(view(spark, sf, "batch_files"), view(spark, sf, "batches"), "batch_id", 7).select("id", "batch_id", "parent_status")


@query(
    "preview_backlog",
    ctes("preview_files", "previews") + "SELECT f.id, f.preview_id, p.status AS parent_status FROM preview_files f JOIN previews p ON p.id = f.preview_id WHERE f.status = 'Pending' ORDER BY f.created_at, f.id LIMIT 5",
    covers="J7",
)
def q_preview_backlog(spark, sf):
    return a.backlog(view(spark, sf, "preview_files"), view(spark, sf, "previews"), "preview_id", 5).select("id", "preview_id", "parent_status")


@query(
    "batch_summary",
    ctes("batch_files", "batches") + """SELECT b.id, count(f.id) AS file_count, count(*) FILTER (WHERE f.status = 'Completed') AS completed_count,
    count(*) FILTER (WHERE f.status = 'Failed') AS failed_count, CAST(coalesce(sum(f.masked_entity_count), 0) AS BIGINT) AS masked_entity_count
    FROM (SELECT id FROM batches UNION ALL SELECT 'empty') b LEFT JOIN batch_files f ON f.batch_id = b.id GROUP BY b.id""",
    covers="J2 G1 G5",
)
def q_batch_summary(spark, sf):
    batches = view(spark, sf, "batches").select("id")
    batches = batches.unionByName(batches.agg(F.lit("empty").alias("id")))
    return a.batch_summary(batches, view(spark, sf, "batch_files"))


@query(
    "batch_status",
    ctes("batch_files") + """, c AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'Pending') AS pending_count, count(*) FILTER (WHERE status = 'Processing') AS processing_count,
    count(*) FILTER (WHERE status = 'Completed') AS completed_count, count(*) FILTER (WHERE status = 'Failed') AS failed_count FROM (SELECT batch_id || '-' || (id % 5) AS batch_id, status FROM batch_files) GROUP BY batch_id)
    SELECT *, CASE WHEN pending_count > 0 OR processing_count > 0 THEN 'Running' WHEN completed_count = total THEN 'Completed' WHEN completed_count > 0 AND failed_count > 0 THEN 'CompletedWithErrors' ELSE 'Failed' END AS status FROM c""",
    covers="G1 G2",
)
def q_batch_status(spark, sf):
    files = view(spark, sf, "batch_files").withColumn("batch_id", F.concat("batch_id", F.lit("-"), (F.col("id") % 5).cast("string")))
    return a.batch_status(files)


@query(
    "preview_status",
    ctes("preview_files") + """, c AS (SELECT preview_id, count(*) AS total, count(*) FILTER (WHERE status = 'Pending') AS pending_count, count(*) FILTER (WHERE status = 'Processing') AS processing_count,
    count(*) FILTER (WHERE status = 'Ready') AS ready_count, count(*) FILTER (WHERE status = 'Failed') AS failed_count FROM preview_files GROUP BY preview_id)
    SELECT *, CASE WHEN pending_count > 0 OR processing_count > 0 THEN 'Processing' WHEN ready_count = total THEN 'Ready' WHEN ready_count > 0 AND failed_count > 0 THEN 'ReadyWithErrors' ELSE 'Failed' END AS status FROM c""",
    covers="G3",
)
def q_preview_status(spark, sf):
    return a.preview_status(view(spark, sf, "preview_files"))


@query(
    "preview_detail",
    ctes("preview_files") + "SELECT preview_id, count(*) FILTER (WHERE status = 'Ready') AS ready, count(*) FILTER (WHERE status = 'Failed') AS failed, CAST(coalesce(sum(CASE WHEN status = 'Ready' THEN masked_entity_count END), 0) AS BIGINT) AS masked_total FROM preview_files GROUP BY preview_id",
    covers="G4",
)
def q_preview_detail(spark, sf):
    return a.preview_detail(view(spark, sf, "preview_files"))


@query(
    "batch_detail",
    ctes("batch_files", "artifacts") + "SELECT f.id, f.status, CASE WHEN f.artifact_id IS NOT NULL THEN coalesce(x.artifact_kind, 'markdown') END AS artifact_kind, f.mapping_object_key IS NOT NULL AS restore_available FROM batch_files f LEFT JOIN artifacts x ON x.id = f.artifact_id",
    covers="J3",
)
def q_batch_detail(spark, sf):
    return a.batch_detail(view(spark, sf, "batch_files"), view(spark, sf, "artifacts")).select("id", "status", "artifact_kind", "restore_available")


@query(
    "completed_artifacts",
    ctes("batch_files", "artifacts") + "SELECT x.id, f.display_name, x.size_bytes FROM artifacts x JOIN batch_files f ON f.id = x.file_id WHERE f.status = 'Completed'",
    covers="J4",
)
def q_completed(spark, sf):
    return a.completed_artifacts(view(spark, sf, "artifacts"), view(spark, sf, "batch_files")).select("id", "display_name", "size_bytes")


@query(
    "upload_candidates",
    ctes("batch_files", "artifacts") + "SELECT x.id, f.display_name FROM artifacts x JOIN batch_files f ON f.id = x.file_id WHERE f.status = 'Completed' AND x.artifact_kind = 'markdown' AND x.batch_id = 'src7'",
    covers="J5",
)
def q_candidates(spark, sf):
    return a.upload_candidates(view(spark, sf, "artifacts"), view(spark, sf, "batch_files"), "src7").select("id", "display_name")


@query(
    "eligible_artifacts",
    ctes("batch_files", "artifacts") + "SELECT x.id, f.display_name FROM artifacts x JOIN batch_files f ON f.id = x.file_id WHERE f.status = 'Completed' AND x.artifact_kind = 'markdown' AND f.mapping_object_key IS NOT NULL",
    covers="R7 J8",
)
def q_eligible(spark, sf):
    from cloakframe.operators.restore import eligible_artifacts

    files = view(spark, sf, "batch_files")
    mapped = files.filter("mapping_object_key IS NOT NULL").select("artifact_id")
    return eligible_artifacts(view(spark, sf, "artifacts"), files, mapped).select("id", "display_name")


@query(
    "event_enrichment",
    ctes("job_events", "batch_files") + "SELECT e.id, e.event_type, f.display_name, f.masked_entity_count FROM job_events e LEFT JOIN batch_files f ON f.id = e.file_id",
    covers="J6",
)
def q_enrich(spark, sf):
    return a.enrich_events(view(spark, sf, "job_events"), view(spark, sf, "batch_files")).select("id", "event_type", "display_name", "masked_entity_count")


# --- event log ---

_LOG = ctes("job_events", "batch_files", "restore_events", "upload_events") + """, elog AS (
    SELECT CAST(e.id AS VARCHAR) AS event_id, e.event_type, e.created_at AS timestamp, e.batch_id, CAST(e.file_id AS VARCHAR) AS file_id, f.display_name, f.input_format, e.status, f.masked_entity_count, e.error_code,
        NULL::BIGINT AS restored_entity_count, CASE e.event_type WHEN 'Completed' THEN 'success' WHEN 'RetryQueued' THEN 'warning' WHEN 'Failed' THEN 'error' ELSE 'info' END AS level
        FROM job_events e LEFT JOIN batch_files f ON f.id = e.file_id
    UNION ALL SELECT CAST(id AS VARCHAR), event_type, timestamp, NULL, NULL, NULL, NULL, status, NULL, error_code, restored_entity_count,
        CASE event_type WHEN 'RestoreSucceeded' THEN 'success' WHEN 'RestoreFailed' THEN 'error' ELSE 'info' END FROM restore_events
    UNION ALL SELECT CAST(id AS VARCHAR), 'Upload', created_at, batch_id, CAST(file_id AS VARCHAR), display_name, NULL, status, NULL, error_code, NULL,
        CASE status WHEN 'success' THEN 'success' WHEN 'failed' THEN 'error' ELSE 'info' END FROM upload_events) """


def log(spark, sf):
    return a.event_log(*[view(spark, sf, v) for v in ("job_events", "batch_files", "restore_events", "upload_events")])


@query("audit_log", _LOG + "SELECT * FROM elog", covers="U1 U2")
def q_log(spark, sf):
    return log(spark, sf)


@query("audit_levels", _LOG + "SELECT level, event_type, count(*) AS n FROM elog GROUP BY ALL", covers="U2")
def q_levels(spark, sf):
    return log(spark, sf).groupBy("level", "event_type").agg(F.count("*").alias("n"))


@query("audit_log_page", _LOG + "SELECT event_id, event_type, timestamp, level FROM elog ORDER BY timestamp DESC, event_id DESC LIMIT 10 OFFSET 20", covers="L1")
def q_page(spark, sf):
    return a.log_page(log(spark, sf), 3, 10).select("event_id", "event_type", "timestamp", "level")


@query("audit_page_info", _LOG + "SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM elog WHERE level = 'error'", covers="L1 V9")
def q_page_info(spark, sf):
    return a.page_info(a.filter_log(log(spark, sf), level="error"), 10)


@query("audit_log_filtered", _LOG + "SELECT event_id, event_type, batch_id FROM elog WHERE level = 'error' AND status = 'Failed' AND starts_with(batch_id, 'b1')", covers="L2")
def q_filtered(spark, sf):
    return a.filter_log(log(spark, sf), level="error", status="Failed", batch_prefix="b1").select("event_id", "event_type", "batch_id")


@query("log_list", ctes("job_events") + "SELECT id, event_type FROM job_events WHERE status = 'Failed' ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 50", covers="L3")
def q_log_list(spark, sf):
    return a.newest(view(spark, sf, "job_events"), "created_at", "id", 100, 50, F.col("status") == "Failed").select("id", "event_type")


@query("history_page", ctes("history") + "SELECT id, status, masked_count FROM history ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50", covers="L4")
def q_history_page(spark, sf):
    return a.newest(view(spark, sf, "history"), "created_at", "id", 50, 50).select("id", "status", "masked_count")


@query("managed_files_page", ctes("managed_files") + "SELECT id, original_name FROM managed_files ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20", covers="L5")
def q_managed_page(spark, sf):
    return a.newest(view(spark, sf, "managed_files"), "created_at", "id", 20, 20).select("id", "original_name")


@query("managed_files_search", ctes("managed_files") + "SELECT id, original_name FROM managed_files WHERE original_name LIKE '%1%' OR masked_name LIKE '%1%' ORDER BY created_at DESC, id DESC LIMIT 50", covers="L8")
def q_managed_search(spark, sf):
    return a.search_files(view(spark, sf, "managed_files"), "1").select("id", "original_name")


@query("batch_search", ctes("batches") + "SELECT id FROM batches WHERE contains(lower(id), 'rc1') AND status = 'Running'", covers="L9")
def q_batch_search(spark, sf):
    return a.search_batches(view(spark, sf, "batches"), " RC1", "Running").select("id")


@query(
    "output_listing",
    """SELECT page_id, name FROM (SELECT page_id, 'out-' || page_id || CASE WHEN page_id % 3 = 0 THEN '.cmap' ELSE '.md' END AS name FROM pages) WHERE NOT suffix(name, '.cmap') AND contains(name, '1')""",
    covers="L10",
)
def q_outputs(spark, sf):
    files = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("file:/out/out-"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".cmap").otherwise(".md")).alias("path"),
        (F.col("page_id") % 50).alias("modificationTime"), F.length("html").alias("length"),
    )
    return a.list_outputs(files, "1").select("page_id", "name")


# --- pairing and statistics ---

_PAIRS = ctes("job_events", "batch_files", "history", "restore_events") + """, nxt AS (SELECT *, lead(event_type) OVER w AS nt, lead(created_at) OVER w AS ne,
    sum(CASE WHEN event_type = 'ProcessingStarted' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS round
    FROM job_events WINDOW w AS (PARTITION BY file_id ORDER BY created_at, id)),
    pairs AS (SELECT file_id, id AS start_id, nt AS outcome, (epoch_us(ne) - epoch_us(created_at)) // 1000 AS duration_ms, round FROM nxt WHERE event_type = 'ProcessingStarted' AND nt IN ('Completed', 'Failed')) """


@query("processing_pairs", _PAIRS + "SELECT file_id, start_id, outcome, duration_ms FROM pairs", covers="W1 V8")
def q_pairs(spark, sf):
    return a.processing_pairs(view(spark, sf, "job_events")).select("file_id", "start_id", "outcome", "duration_ms")


@query("retry_rounds", _PAIRS + "SELECT file_id, start_id, outcome, duration_ms, CAST(round AS BIGINT) AS round FROM pairs", covers="W2")
def q_rounds(spark, sf):
    return a.retry_rounds(view(spark, sf, "job_events")).select("file_id", "start_id", "outcome", "duration_ms", "round")


@query(
    "processing_stats",
    _PAIRS + f"""SELECT count(*) AS total_files, count(*) FILTER (WHERE status = 'Completed') AS successful_files, count(*) FILTER (WHERE status = 'Failed') AS failed_files,
    CAST(coalesce(sum(masked_entity_count) FILTER (WHERE status = 'Completed'), 0) AS BIGINT) AS total_masked_items, count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 7 DAY) AS recent_files_7days,
    (SELECT CAST(sum(duration_ms) // count(*) AS BIGINT) FROM pairs) AS average_processing_time_ms,
    count(*) FILTER (WHERE status = 'Completed') / (count(*) FILTER (WHERE status IN ('Completed', 'Failed'))) * 100.0 AS success_rate FROM batch_files""",
    covers="G6",
)
def q_stats(spark, sf):
    return a.processing_statistics(view(spark, sf, "batch_files"), view(spark, sf, "job_events"), now())


@query(
    "history_stats",
    _PAIRS + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status <> 'success') AS failed, CAST(sum(masked_count) AS BIGINT) AS masked,
    count(*) FILTER (WHERE status = 'success') / count(*) * 100.0 AS success_rate, avg(processing_time_ms) FILTER (WHERE status = 'success') AS mean_ms FROM history""",
    covers="G7",
)
def q_history(spark, sf):
    return a.history_statistics(view(spark, sf, "history"))


@query("event_store_status", _PAIRS + "SELECT 'ready' AS status, (SELECT count(*) FROM job_events) + (SELECT count(*) FROM restore_events) AS event_count", covers="G9")
def q_store(spark, sf):
    return a.event_store_status(view(spark, sf, "job_events"), view(spark, sf, "restore_events"))


@query("error_code_shares", _PAIRS + "SELECT error_code, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM job_events WHERE error_code IS NOT NULL GROUP BY error_code", covers="G10 V12")
def q_shares(spark, sf):
    return a.outcome_shares(view(spark, sf, "job_events"), "error_code")


@query("mean_files_per_batch", _PAIRS + "SELECT avg(n) AS mean_files FROM (SELECT count(*) AS n FROM batch_files GROUP BY batch_id)", covers="G10")
def q_mean_files(spark, sf):
    return a.mean_files_per_batch(view(spark, sf, "batch_files"))


@query("distinct_batches", _PAIRS + "SELECT count(DISTINCT batch_id) AS n FROM job_events", covers="G8 U3")
def q_distinct(spark, sf):
    return a.distinct_count(view(spark, sf, "job_events"), "batch_id")


@query("managed_file_stats", ctes("managed_files") + "SELECT count(*) AS total, count(*) FILTER (WHERE uploaded) AS uploaded, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM managed_files", covers="G12")
def q_managed_stats(spark, sf):
    return a.managed_file_statistics(view(spark, sf, "managed_files"))


# --- maintenance ---


@query("retention_kept", ctes("job_events") + f"SELECT id, event_type FROM job_events WHERE created_at >= {NOW} - INTERVAL 5 DAY", covers="U5")
def q_retention(spark, sf):
    return a.retention(view(spark, sf, "job_events"), "created_at", now(), 5).select("id", "event_type")


@query("clear_logs", ctes("job_events", "restore_events") + "SELECT (SELECT count(*) FROM job_events) AS deleted_job_events, (SELECT count(*) FROM restore_events) AS deleted_restore_events", covers="U4")
def q_clear(spark, sf):
    return a.clear_logs(view(spark, sf, "job_events"), view(spark, sf, "restore_events"))[2]


@query(
    "retry_transition",
    ctes("batch_files") + """, r AS (SELECT DISTINCT o_orderkey AS file_id FROM orders)
    SELECT r.file_id, CASE WHEN f.id IS NULL THEN 'NOT_FOUND' WHEN f.status <> 'Failed' THEN 'RETRY_CONFLICT' ELSE 'Pending' END AS result, CASE WHEN f.status = 'Failed' THEN f.attempt + 1 END AS attempt
    FROM r LEFT JOIN batch_files f ON f.id = r.file_id""",
    covers="U6",
)
def q_retry(spark, sf):
    requests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"))
    updated, _, rejects = a.retry_requests(requests, view(spark, sf, "batch_files"), now())
    return updated.select(F.col("id").alias("file_id"), F.col("status").alias("result"), "attempt").unionByName(
        rejects.select("file_id", F.col("error_code").alias("result"), F.lit(None).cast("int").alias("attempt"))
    )


@query(
    "recover_interrupted",
    ctes("batch_files") + "SELECT status, error_code, count(*) AS n FROM (SELECT CASE WHEN status = 'Processing' THEN 'Failed' ELSE status END AS status, CASE WHEN status = 'Processing' THEN 'PROCESS_INTERRUPTED' ELSE error_code END AS error_code FROM batch_files) GROUP BY ALL",
    covers="U7",
)
def q_recover(spark, sf):
    updated, _ = a.recover_interrupted(view(spark, sf, "batch_files"), now())
    return updated.groupBy("status", "error_code").agg(F.count("*").alias("n"))


@query(
    "finish_files",
    ctes("batch_files") + "SELECT id, CASE WHEN status = 'Pending' THEN CASE WHEN id % 2 = 0 THEN 'Completed' ELSE 'Failed' END ELSE status END AS status, CASE WHEN status = 'Pending' THEN CASE WHEN id % 2 = 0 THEN 3 END ELSE masked_entity_count END AS masked_entity_count FROM batch_files",
    covers="U8",
)
def q_finish(spark, sf):
    files = view(spark, sf, "batch_files")
    outcomes = files.filter("status = 'Pending'").select(
        "id", F.lit(3).cast("bigint").alias("masked_entity_count"), F.when(F.col("id") % 2 != 0, "INPUT_CORRUPTED").alias("error_code")
    )
    updated, _ = a.finish_files(files, outcomes, now())
    return updated.select("id", "status", "masked_entity_count")


@query(
    "confirm_previews",
    ctes("previews") + """, r AS (SELECT DISTINCT o_custkey * 2 AS preview_id FROM orders) SELECT preview_id,
    CASE WHEN p.id IS NULL THEN 'NOT_FOUND' WHEN confirmed_batch_id IS NOT NULL THEN 'ALREADY_CONFIRMED' WHEN status IN ('Ready', 'ReadyWithErrors') THEN 'CONFIRMED' WHEN status = 'Confirming' THEN 'IN_FLIGHT' ELSE 'NOT_READY' END AS outcome,
    CASE WHEN confirmed_batch_id IS NULL AND status IN ('Ready', 'ReadyWithErrors') THEN 'batch-' || left(sha256(CAST(preview_id AS VARCHAR)), 16) ELSE confirmed_batch_id END AS batch_id
    FROM r LEFT JOIN previews p ON p.id = r.preview_id""",
    covers="U9",
)
def q_confirm(spark, sf):
    requests = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("preview_id"))
    return a.confirm_previews(requests, view(spark, sf, "previews"))


@query(
    "confirmed_rows",
    ctes("previews", "preview_files") + """, r AS (SELECT DISTINCT o_custkey * 2 AS preview_id FROM orders),
    n AS (SELECT preview_id, 'batch-' || left(sha256(CAST(preview_id AS VARCHAR)), 16) AS batch_id FROM r JOIN previews p ON p.id = r.preview_id WHERE confirmed_batch_id IS NULL AND p.status IN ('Ready', 'ReadyWithErrors')),
    f AS (SELECT batch_id, f.id AS file_id, CASE WHEN f.status = 'Ready' THEN 'Completed' ELSE 'Failed' END AS status, masked_entity_count FROM preview_files f JOIN n USING (preview_id))
    SELECT 'batch' AS kind, batch_id AS id, batch_id, 'Running' AS status, NULL::BIGINT AS masked_entity_count FROM n
    UNION ALL SELECT 'file', CAST(file_id AS VARCHAR), batch_id, status, CAST(masked_entity_count AS BIGINT) FROM f
    UNION ALL SELECT 'event', batch_id || '-' || file_id, batch_id, status, NULL FROM f""",
    covers="U9",
)
def q_confirmed_rows(spark, sf):
    requests = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("preview_id"))
    outcomes = a.confirm_previews(requests, view(spark, sf, "previews"))
    batches, files, events = a.confirmed_rows(outcomes, view(spark, sf, "preview_files"), now())
    none = F.lit(None).cast("bigint").alias("masked_entity_count")
    rows = batches.select(F.lit("batch").alias("kind"), "id", F.col("id").alias("batch_id"), "status", none)
    rows = rows.union(files.select(F.lit("file"), F.col("id").cast("string"), "batch_id", "status", F.col("masked_entity_count").cast("bigint")))
    return rows.union(events.select(F.lit("event"), "id", "batch_id", "status", none))


@query("expired_sessions", ctes("previews") + f"SELECT id, status FROM previews WHERE expires_at < {NOW} AND status NOT IN ('Confirming', 'Confirmed')", covers="U10")
def q_expired(spark, sf):
    return a.expired_sessions(view(spark, sf, "previews"), now()).select("id", "status")


@query(
    "settings_upsert",
    """SELECT o_custkey AS key, arg_max(v, (u, p)) AS value FROM (SELECT o_custkey, o_orderpriority AS v, o_orderdate AS u, 0 AS p, o_orderkey FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_custkey, 'patched', o_orderdate, 1, o_orderkey FROM orders WHERE o_orderkey % 3 = 1) GROUP BY o_custkey""",
    covers="U11 U12",
)
def q_upsert(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderdate").alias("updated_at"), "o_orderkey")
    base = rows.filter("o_orderkey % 3 = 0").drop("o_orderkey")
    patch = rows.filter("o_orderkey % 3 = 1").drop("o_orderkey").withColumn("value", F.lit("patched"))
    return a.upsert(base, patch, ["key"]).select("key", "value")


@query("delete_files", ctes("managed_files") + "SELECT id, uploaded FROM managed_files WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", covers="U12 T11 J8")
def q_delete(spark, sf):
    gone = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return a.delete_rows(view(spark, sf, "managed_files"), gone, "id").select("id", "uploaded")


@query("first_files_per_batch", ctes("batch_files") + "SELECT batch_id, id FROM batch_files QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY created_at, id) <= 3", covers="W4")
def q_first(spark, sf):
    return a.first_n_per_group(view(spark, sf, "batch_files"), ["batch_id"], [F.col("created_at"), F.col("id")], 3).select("batch_id", "id")


@query(
    "entity_stats_cube",
    f"""WITH {mask_ctes(DOCS)}, v AS (SELECT f.rule_id, d.source, d.lang FROM fresh f JOIN documents d ON d.doc_id = f.k)
    SELECT rule_id, source, lang, count(*) AS n, GROUPING(rule_id) * 4 + GROUPING(source) * 2 + GROUPING(lang) AS level
    FROM v GROUP BY CUBE (rule_id, source, lang)""",
    covers="G11",
)
def q_cube(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    wide = mask_documents(docs, "doc_id", "text", default_rules()).wide
    values = wide.select("source", "lang", F.explode_outer("mapping").alias("m")).filter("m IS NOT NULL")
    return a.entity_cube(values.select("source", "lang", F.col("m.rule_id").alias("rule_id")), ["rule_id", "source", "lang"])
