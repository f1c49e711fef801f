"""Operational tables: roll-ups, event log, pairing, statistics, maintenance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.operators.ordering import next_row, running_sum, time_bucket
from cloakframe.plans import lexicon as lx


class InvalidQuery(ValueError):
    code = "INVALID_QUERY"


def _status_is(status: str) -> Column:
    return F.col("status") == status


# --- joins ---------------------------------------------------------------------


def backlog(files: DataFrame, parents: DataFrame, parent_key: str, n: int = 1, pending: str = "Pending") -> DataFrame:
    """Oldest pending files with their batch (or preview session)."""
    head = parents.select(F.col("id").alias(parent_key), F.col("status").alias("parent_status"))
    return files.filter(_status_is(pending)).join(head, parent_key).orderBy("created_at", "id").limit(n)


def batch_summary(batches: DataFrame, files: DataFrame) -> DataFrame:
    """Every batch with its counts; files are counted before the join."""
    per = files.groupBy("batch_id").agg(
        F.count("*").alias("file_count"),
        F.count_if(_status_is("Completed")).alias("completed_count"),
        F.count_if(_status_is("Failed")).alias("failed_count"),
        F.coalesce(F.sum("masked_entity_count"), F.lit(0)).alias("masked_entity_count"),
    )
    return batches.join(per, batches["id"] == per["batch_id"], "left").select(
        batches["id"],
        *[F.coalesce(per[c], F.lit(0)).alias(c) for c in ("file_count", "completed_count", "failed_count", "masked_entity_count")],
    )


def batch_detail(files: DataFrame, artifacts: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Files with artifact kind (default ``markdown``) and whether a restore is possible."""
    if batch_id is not None:
        files = files.filter(F.col("batch_id") == batch_id)
    kinds = artifacts.select(F.col("id").alias("artifact_id"), F.col("artifact_kind").alias("_kind"))
    return (
        files.join(kinds, "artifact_id", "left")
        .withColumn("artifact_kind", F.when(F.col("artifact_id").isNotNull(), F.coalesce("_kind", F.lit("markdown"))))
        .withColumn("restore_available", F.col("mapping_object_key").isNotNull())
        .drop("_kind")
    )


def completed_artifacts(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    done = files.filter(_status_is("Completed")).select(F.col("id").alias("file_id"), "display_name")
    return artifacts.join(done, "file_id")


def upload_candidates(artifacts: DataFrame, files: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Completed Markdown artifacts by creation time."""
    out = completed_artifacts(artifacts.filter("artifact_kind = 'markdown'"), files)
    if batch_id is not None:
        out = out.filter(F.col("batch_id") == batch_id)
    return out.orderBy("created_at", "id")


def enrich_events(job_events: DataFrame, files: DataFrame) -> DataFrame:
    """Job events with the attributes of their file."""
    attrs = files.select(F.col("id").alias("file_id"), "display_name", "input_format", "masked_entity_count")
    return job_events.join(attrs, "file_id", "left")


# --- aggregations ----------------------------------------------------------------


def status_counts(files: DataFrame, key: str, statuses: list[str]) -> DataFrame:
    return files.groupBy(key).agg(
        F.count("*").alias("total"), *[F.count_if(_status_is(s)).alias(f"{s.lower()}_count") for s in statuses]
    )


def batch_status(files: DataFrame) -> DataFrame:
    """running > completed > completed with errors > failed."""
    counts = status_counts(files, "batch_id", ["Pending", "Processing", "Completed", "Failed"])
    status = (
        F.when((F.col("pending_count") > 0) | (F.col("processing_count") > 0), "Running")
        .when((F.col("total") > 0) & (F.col("completed_count") == F.col("total")), "Completed")
        .when((F.col("completed_count") > 0) & (F.col("failed_count") > 0), "CompletedWithErrors")
        .otherwise("Failed")
    )
    return counts.withColumn("status", status)


def preview_status(files: DataFrame) -> DataFrame:
    counts = status_counts(files, "preview_id", ["Pending", "Processing", "Ready", "Failed"])
    status = (
        F.when((F.col("pending_count") > 0) | (F.col("processing_count") > 0), "Processing")
        .when((F.col("total") > 0) & (F.col("ready_count") == F.col("total")), "Ready")
        .when((F.col("ready_count") > 0) & (F.col("failed_count") > 0), "ReadyWithErrors")
        .otherwise("Failed")
    )
    return counts.withColumn("status", status)


def preview_detail(files: DataFrame) -> DataFrame:
    return files.groupBy("preview_id").agg(
        F.count_if(_status_is("Ready")).alias("ready"),
        F.count_if(_status_is("Failed")).alias("failed"),
        F.coalesce(F.sum(F.when(_status_is("Ready"), F.col("masked_entity_count"))), F.lit(0)).alias("masked_total"),
    )


def processing_statistics(files: DataFrame, job_events: DataFrame, now: Column) -> DataFrame:
    """One row: totals, rate over terminal files, files of seven days, mean processing time."""
    since = now - F.expr("INTERVAL 7 DAYS")
    totals = files.agg(
        F.count("*").alias("total_files"),
        F.count_if(_status_is("Completed")).alias("successful_files"),
        F.count_if(_status_is("Failed")).alias("failed_files"),
        F.coalesce(F.sum(F.when(_status_is("Completed"), F.col("masked_entity_count"))), F.lit(0)).alias("total_masked_items"),
        F.count_if(F.col("created_at") >= since).alias("recent_files_7days"),
    )
    terminal = F.col("successful_files") + F.col("failed_files")
    mean = mean_processing_ms(processing_pairs(job_events))
    return totals.crossJoin(mean).withColumn(
        "success_rate", F.when(terminal > 0, F.col("successful_files") / terminal * 100.0).otherwise(0.0)
    )


def mean_processing_ms(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.coalesce(F.expr("sum(duration_ms) div count(*)"), F.lit(0)).alias("average_processing_time_ms"))


def history_statistics(history: DataFrame) -> DataFrame:
    """Desktop form: failed = total - success, rate over all, mean over successes."""
    ok = F.col("status") == "success"
    return history.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("success"),
        (F.count("*") - F.count_if(ok)).alias("failed"),
        F.coalesce(F.sum("masked_count"), F.lit(0)).alias("masked"),
        F.when(F.count("*") > 0, F.count_if(ok) / F.count("*") * 100.0).otherwise(0.0).alias("success_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("processing_time_ms"))), F.lit(0.0)).alias("mean_ms"),
    )


def event_store_status(job_events: DataFrame, restore_events: DataFrame) -> DataFrame:
    """Number of stored events; uploads are not counted."""
    both = job_events.select(F.lit(1).alias("x")).unionByName(restore_events.select(F.lit(1).alias("x")))
    return both.agg(F.lit("ready").alias("status"), F.count("*").alias("event_count"))


def outcome_shares(df: DataFrame, key: str) -> DataFrame:
    """Count and share per value; the shares window runs over the grouped values only."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")


def mean_files_per_batch(files: DataFrame) -> DataFrame:
    return files.groupBy("batch_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_files"))


def entity_cube(findings: DataFrame, dims: list[str]) -> DataFrame:
    """Entity counts over every combination of the dimensions."""
    return findings.cube(*dims).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def managed_file_statistics(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("total"), F.count_if("uploaded").alias("uploaded"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")
    )


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(fn(column).alias("n"))


# --- windows ----------------------------------------------------------------------


def processing_pairs(job_events: DataFrame, bucket_width: str = "DAY") -> DataFrame:
    """Each start with the event right behind it, kept when that is terminal."""
    nxt = next_row(
        job_events.select("file_id", "id", "event_type", "created_at"), "file_id", ["created_at", "id"],
        time_bucket(F.col("created_at"), bucket_width), ["event_type", "created_at"],
    )
    pairs = nxt.filter(
        (F.col("event_type") == "ProcessingStarted") & F.col("next_event_type").isin("Completed", "Failed")
    ).withColumn("duration_ms", F.expr("timestampdiff(MILLISECOND, created_at, next_created_at)"))
    return pairs.filter("duration_ms >= 0").select(
        "file_id", F.col("id").alias("start_id"), F.col("created_at").alias("started_at"), F.col("next_created_at").alias("ended_at"),
        F.col("next_event_type").alias("outcome"), "duration_ms",
    )


def retry_rounds(job_events: DataFrame, bucket_width: str = "DAY") -> DataFrame:
    """Pairs with the number of their round within the file."""
    starts = job_events.select("file_id", "id", "event_type", "created_at")
    rounds = running_sum(
        starts, "file_id", ["created_at", "id"], time_bucket(F.col("created_at"), bucket_width),
        (F.col("event_type") == "ProcessingStarted").cast("int"), "round",
    ).filter("event_type = 'ProcessingStarted'")
    return processing_pairs(job_events, bucket_width).join(
        rounds.select("file_id", F.col("id").alias("start_id"), "round"), ["file_id", "start_id"]
    )


# --- event log --------------------------------------------------------------------


def _level(column: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column), F.lit("info"))


def event_log(job_events: DataFrame, files: DataFrame, restore_events: DataFrame, upload_events: DataFrame) -> DataFrame:
    """Union of the three event tables on one schema, with a level."""
    jobs = enrich_events(job_events, files).select(
        F.col("id").cast("string").alias("event_id"), "event_type", F.col("created_at").alias("timestamp"), "batch_id",
        F.col("file_id").cast("string").alias("file_id"), "display_name", "input_format", "status", "masked_entity_count", "error_code",
        _level(F.col("event_type"), lx.JOB_EVENT_LEVELS).alias("level"),
    )
    restores = restore_events.select(
        F.col("id").cast("string").alias("event_id"), "event_type", "timestamp", "status", "error_code", "restored_entity_count",
        _level(F.col("event_type"), lx.RESTORE_EVENT_LEVELS).alias("level"),
    )
    uploads = upload_events.select(
        F.col("id").cast("string").alias("event_id"), F.lit("Upload").alias("event_type"), F.col("created_at").alias("timestamp"),
        "batch_id", F.col("file_id").cast("string").alias("file_id"), "display_name", "status", "error_code",
        _level(F.col("status"), lx.UPLOAD_STATUS_LEVELS).alias("level"),
    )
    return jobs.unionByName(restores, allowMissingColumns=True).unionByName(uploads, allowMissingColumns=True)


def filter_log(log: DataFrame, level: str | None = None, status: str | None = None, batch_prefix: str | None = None) -> DataFrame:
    if level is not None and level not in lx.LOG_LEVELS:
        raise InvalidQuery(f"unknown level {level!r}")
    if batch_prefix is not None and not re.fullmatch(r"[0-9A-Fa-f-]{1,36}", batch_prefix):
        raise InvalidQuery("a batch prefix holds up to 36 hexadecimal digits and hyphens")
    if level is not None:
        log = log.filter(F.col("level") == level)
    if status is not None:
        log = log.filter(F.col("status") == status)
    if batch_prefix is not None:
        log = log.filter(F.col("batch_id").startswith(batch_prefix))
    return log


def page(df: DataFrame, order: list[Column], page: int = 1, size: int = 10, max_size: int = 100) -> DataFrame:
    """One page of a stable order (top-k, no full sort)."""
    if page < 1 or not 1 <= size <= max_size:
        raise InvalidQuery("page starts at 1; size is between 1 and the maximum")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def log_page(log: DataFrame, page_no: int = 1, size: int = 10) -> DataFrame:
    return page(log, [F.desc("timestamp"), F.desc("event_id")], page_no, size)


def page_info(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).cast("bigint").alias("pages"))


def newest(df: DataFrame, time_col: str, id_col: str, limit: int = 100, offset: int = 0, condition: Column | None = None) -> DataFrame:
    """Desktop lists: newest first, with an offset."""
    out = df if condition is None else df.filter(condition)
    return out.orderBy(F.desc(time_col), F.desc(id_col)).offset(offset).limit(limit)


def search_files(files: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    like = f"%{pattern}%"
    return files.filter(F.col("original_name").like(like) | F.col("masked_name").like(like)).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def search_batches(batches: DataFrame, text: str = "", status: str | None = None) -> DataFrame:
    out = batches.filter(F.contains(F.lower("id"), F.lit(text.strip().lower())))
    return out if status is None else out.filter(_status_is(status))


def list_outputs(files: DataFrame, text: str = "") -> DataFrame:
    """Output files (``path``, ``modificationTime``, ``length``): mapping files are hidden, newest first."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    return (
        files.withColumn("name", name)
        .filter(~F.lower("name").rlike(r"\.(cmap|ecmap)$") & F.contains(F.lower("name"), F.lit(text.lower())))
        .orderBy(F.desc("modificationTime"), "name")
    )


# --- table maintenance -------------------------------------------------------------


def clear_logs(job_events: DataFrame, restore_events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Emptied job and restore events, and both counts (upload events are kept)."""
    counts = (
        job_events.select(F.lit(1).alias("j"), F.lit(0).alias("r"))
        .unionByName(restore_events.select(F.lit(0).alias("j"), F.lit(1).alias("r")))
        .agg(F.coalesce(F.sum("j"), F.lit(0)).alias("deleted_job_events"), F.coalesce(F.sum("r"), F.lit(0)).alias("deleted_restore_events"))
    )
    return job_events.limit(0), restore_events.limit(0), counts


def retention(df: DataFrame, time_col: str, now: Column, days: int) -> DataFrame:
    """Rows that are at most ``days`` old."""
    return df.filter(F.col(time_col) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def retry_requests(requests: DataFrame, files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(updated files, events, rejects)``: only failed files go back to pending."""
    found = F.col("id").isNotNull()
    joined = requests.select(F.col("file_id").alias("_want")).distinct().join(files, F.col("_want") == files["id"], "left")
    rejects = joined.filter(~found | ~_status_is("Failed")).select(
        F.col("_want").alias("file_id"), F.when(found, "RETRY_CONFLICT").otherwise("NOT_FOUND").alias("error_code")
    )
    ok = joined.filter(found & _status_is("Failed")).drop("_want")
    cleared = {c: F.lit(None).cast(files.schema[c].dataType) for c in ("masked_entity_count", "artifact_id", "error_code", "error_message") if c in files.columns}
    updated = ok.withColumns({"status": F.lit("Pending"), "attempt": F.col("attempt") + 1, **cleared, "updated_at": now})
    events = updated.select("batch_id", F.col("id").alias("file_id"), F.lit("RetryQueued").alias("event_type"), "status", F.lit(None).cast("string").alias("error_code"), now.alias("created_at"))
    return updated, events, rejects


def recover_interrupted(files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Files left in processing become failed; one event each."""
    hit = _status_is("Processing")
    code = "PROCESS_INTERRUPTED"
    updated = files.withColumns({
        "error_code": F.when(hit, code).otherwise(F.col("error_code")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        "status": F.when(hit, "Failed").otherwise(F.col("status")),
    })
    events = files.filter(hit).select(
        "batch_id", F.col("id").alias("file_id"), F.lit("RecoveredInterrupted").alias("event_type"), F.lit("Failed").alias("status"),
        F.lit(code).alias("error_code"), now.alias("created_at"),
    )
    return updated, events


def finish_files(files: DataFrame, outcomes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Apply outcomes (id, masked_entity_count, error_code): completed or failed, one event each."""
    out = outcomes.select("id", F.col("masked_entity_count").alias("_n"), F.col("error_code").alias("_e"), F.lit(True).alias("_o"))
    joined = files.join(out, "id", "left")
    hit, failed = F.col("_o").isNotNull(), F.col("_e").isNotNull()
    updated = joined.withColumns({
        "status": F.when(hit & failed, "Failed").when(hit, "Completed").otherwise(F.col("status")),
        "masked_entity_count": F.when(hit & ~failed, F.col("_n")).when(hit, None).otherwise(F.col("masked_entity_count")),
        "error_code": F.when(hit, F.col("_e")).otherwise(F.col("error_code")),
    }).drop("_n", "_e", "_o")
    events = joined.filter(hit).select(
        "batch_id", F.col("id").alias("file_id"), F.when(failed, "Failed").otherwise("Completed").alias("event_type"),
        F.when(failed, "Failed").otherwise("Completed").alias("status"), F.col("_e").alias("error_code"), now.alias("created_at"),
    )
    return updated, events


def confirm_previews(requests: DataFrame, previews: DataFrame) -> DataFrame:
    """Outcome per requested preview; running it again gives the same batch.

    New batches take an id derived from the preview id, so a repeated run
    cannot create a second one.
    """
    ready = F.col("status").isin("Ready", "ReadyWithErrors") & (F.col("confirming") == 0)
    joined = requests.select(F.col("preview_id")).distinct().join(previews.withColumnRenamed("id", "preview_id"), "preview_id", "left")
    outcome = (
        F.when(F.col("status").isNull(), "NOT_FOUND")
        .when(F.col("confirmed_batch_id").isNotNull(), "ALREADY_CONFIRMED")
        .when(ready, "CONFIRMED")
        .when(F.col("status") == "Confirming", "IN_FLIGHT")
        .otherwise("NOT_READY")
    )
    return joined.withColumn("outcome", outcome).select(
        "preview_id", "outcome",
        F.when(F.col("outcome") == "CONFIRMED", F.concat(F.lit("batch-"), F.left(F.sha2(F.col("preview_id").cast("string"), 256), F.lit(16))))
        .otherwise(F.col("confirmed_batch_id")).alias("batch_id"),
    )


def confirmed_rows(outcomes: DataFrame, preview_files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that newly confirmed previews add: ``(batches, files, events)``.

    A ready preview file becomes a completed file, any other a failed one, each with the one event of that outcome. Ids follow
    from the preview's, so an ``upsert`` of the rows of a repeated run changes nothing.
    """
    new = outcomes.filter("outcome = 'CONFIRMED'").select("preview_id", "batch_id")
    batches = new.select(F.col("batch_id").alias("id"), F.lit("Running").alias("status"), now.alias("created_at"))
    status = F.when(F.col("status") == "Ready", "Completed").otherwise("Failed")
    files = preview_files.withColumn("status", status).join(new, "preview_id").withColumn("created_at", now).withColumn("updated_at", now)
    events = files.select(
        F.concat_ws("-", "batch_id", F.col("id").cast("string")).alias("id"), "batch_id", F.col("id").alias("file_id"),
        F.col("status").alias("event_type"), "status", now.alias("created_at"),
    )
    return batches, files.drop("preview_id"), events


def expired_sessions(previews: DataFrame, now: Column) -> DataFrame:
    """Sessions to sweep: past their time and neither confirming nor confirmed."""
    return previews.filter((F.col("expires_at") < now) & ~F.col("status").isin("Confirming", "Confirmed"))


def upsert(df: DataFrame, patch: DataFrame, keys: list[str], version: str = "updated_at") -> DataFrame:
    """Insert or replace by key; the newest version wins, the patch wins ties.

    Aggregates with a map-side combine, so a key with very many versions is
    reduced before the shuffle.
    """
    both = df.withColumn("_p", F.lit(0)).unionByName(patch.withColumn("_p", F.lit(1)))
    rest = [c for c in df.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_p")).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def delete_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def keep_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def first_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each group; Spark trims each partition to n per group before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")
