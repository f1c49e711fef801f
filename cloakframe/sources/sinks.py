"""Sinks: masked output with its mapping, manifests and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.text import clean_display_name, clean_output_stem, file_stem
from cloakframe.operators.mask import MaskOutput


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def _replace(df: DataFrame, path: str) -> None:
    """Replace the batches that ``df`` holds, no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def write_masked_batch(output: MaskOutput, batch_id: str, path: str) -> None:
    """An open status row, masked text and mapping, then the status row: readers trust finished batches only.

    The open row comes first, so that a batch written again is not read while its parts are replaced.

    The wide result is written once and read back for the mapping and the
    status, so the rules run once, and a lost executor repeats its tasks only.
    """
    spark = output.wide.sparkSession
    tag = F.lit(batch_id).alias("batch_id")
    opened = spark.createDataFrame([(batch_id, 0, 0, "Running")], "batch_id STRING, documents LONG, masked_entity_count LONG, status STRING")
    _replace(opened, f"{path}/status")
    _replace(output.wide.select("*", tag), f"{path}/masked")
    stored = spark.read.parquet(f"{path}/masked").filter(F.col("batch_id") == batch_id)
    rows = stored.select(output.id_col, F.explode("mapping").alias("m"), "batch_id").select(output.id_col, "m.*", "batch_id")
    _replace(rows, f"{path}/mapping")
    status = stored.groupBy("batch_id").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("masked_entity_count"), F.lit(0)).alias("masked_entity_count")
    ).withColumn("status", F.lit("Completed"))
    _replace(status, f"{path}/status")


def read_finished(spark: SparkSession, path: str, part: str = "masked") -> DataFrame:
    """Rows of completed batches."""
    done = spark.read.parquet(f"{path}/status").filter("status = 'Completed'").select("batch_id")
    return spark.read.parquet(f"{path}/{part}").join(done, "batch_id", "left_semi")


def write_mapping(mapping: DataFrame, path: str, fmt: str = "parquet") -> None:
    mapping.write.mode("overwrite").format(fmt).save(path)


def read_mapping(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def manifest(df: DataFrame, members: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Add ``members``: kind, name, size and hash per output (``kind -> (name, content)``)."""
    parts = [
        F.struct(
            F.lit(kind).alias("kind"), name.alias("name"), F.octet_length(content).cast("bigint").alias("size_bytes"),
            F.sha2(content.cast("binary"), 256).alias("sha256"),
        )
        for kind, (name, content) in members.items()
    ]
    return df.withColumn("members", F.array(*parts))


def pick_member(df: DataFrame, id_col: str, kind: str) -> DataFrame:
    return df.select(id_col, F.inline("members")).filter(F.col("kind") == kind)


def masked_file_name(name: Column) -> Column:
    stem = F.coalesce(F.nullif(file_stem(clean_display_name(name)), F.lit("")), F.lit("masked_file"))
    return clean_display_name(F.concat(stem, F.lit("_脱敏.md")))


def restored_file_name(name: Column) -> Column:
    stem = F.coalesce(F.nullif(file_stem(clean_display_name(name)), F.lit("")), F.lit("restored_file"))
    return clean_display_name(F.concat(stem, F.lit("_还原.md")))


def masked_stem_name(stem: Column, pages: tuple[int, int] | None = None) -> Column:
    suffix = "_脱敏" if pages is None else f"_脱敏_p{pages[0]}-{pages[1]}"
    return clean_output_stem(F.concat(stem, F.lit(suffix)))
