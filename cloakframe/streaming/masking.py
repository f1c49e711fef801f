"""Masking documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.operators.mask import mask_documents
from cloakframe.operators.snapshots import read_version, write_snapshot
from cloakframe.plans.rules import RuleSet


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet file stream, oldest files first."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def frozen_terms(spark: SparkSession, terms: Callable[[], DataFrame], path: str, batch_id: int) -> DataFrame:
    """Term snapshot of a micro-batch: taken once, read again when the batch is repeated; batches over an unchanged library share one copy."""
    return read_version(spark, path, write_snapshot(terms(), str(batch_id), path))


def mask_stream(
    stream: DataFrame, id_col: str, text_col: str, rules: RuleSet, out: str, checkpoint: str, *,
    terms: Callable[[], DataFrame] | None = None, available_now: bool = False, interval: str = "1 second",
) -> StreamingQuery:
    """Start masking a stream into ``out/masked`` and ``out/mapping``.

    Counters belong to one document, so batches share no state. Each
    micro-batch writes its own folder and overwrites it when it is repeated
    after a failure: a document is written once, whoever retries. Masked text
    is computed once; the mapping and the event rows are read back from it.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        library = frozen_terms(spark, terms, f"{out}/terms", batch_id) if terms is not None else None
        target = f"{out}/masked/batch_id={batch_id}"
        mask_documents(df, id_col, text_col, rules, terms=library).wide.write.mode("overwrite").parquet(target)
        stored = spark.read.parquet(target)
        stored.select(id_col, F.inline("mapping")).write.mode("overwrite").parquet(f"{out}/mapping/batch_id={batch_id}")
        events = stored.select(
            F.col(id_col).alias("file_id"), F.lit("Completed").alias("event_type"), "masked_entity_count", F.current_timestamp().alias("created_at")
        )
        events.write.mode("overwrite").parquet(f"{out}/events/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def read_stream_output(spark: SparkSession, out: str, part: str = "masked") -> DataFrame:
    return spark.read.parquet(f"{out}/{part}")
