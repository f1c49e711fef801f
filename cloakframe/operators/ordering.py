"""Ordered per-key work that a hot key cannot pull into one task.

Plain ``Window.partitionBy(key)`` sorts all rows of a key in one task. Here the
key's rows are cut into buckets along the order (usually time). Windows run per
(key, bucket); a summary with one row per (key, bucket) carries what crosses
the bucket borders. Results equal the plain window exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(ts: Column, width: str = "DAY") -> Column:
    """Bucket along time; pick a width that keeps a bucket of the hottest key small."""
    return F.date_trunc(width, ts)


def next_row(df: DataFrame, key: str, order: list[str], bucket: Column, values: list[str], prefix: str = "next_") -> DataFrame:
    """LEAD of ``values`` per key by ``order``; ``bucket`` must grow with ``order``."""
    work = df.withColumn("_b", bucket)
    row = F.struct(*values)
    inside = work.withColumn("_lead", F.lead(row).over(Window.partitionBy(key, "_b").orderBy(*order)))
    firsts = work.groupBy(key, "_b").agg(F.min_by(row, F.struct(*order)).alias("_first"))
    border = firsts.select(key, "_b", F.lead("_first").over(Window.partitionBy(key).orderBy("_b")).alias("_border"))
    joined = inside.join(border, [key, "_b"], "left")
    nxt = F.coalesce("_lead", "_border")
    return joined.select(*df.columns, *[nxt[v].alias(f"{prefix}{v}") for v in values])


def running_sum(df: DataFrame, key: str, order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` per key by ``order``, current row included."""
    work = df.withColumn("_b", bucket).withColumn("_v", value)
    w = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = work.withColumn("_in", F.sum("_v").over(w))
    totals = work.groupBy(key, "_b").agg(F.sum("_v").alias("_t"))
    before = totals.select(
        key, "_b",
        F.coalesce(
            F.sum("_t").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    return inside.join(before, [key, "_b"]).select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


def global_rank(df: DataFrame, key: str, order: list[str], bucket: Column, name: str) -> DataFrame:
    """ROW_NUMBER per key by ``order`` (a total order), starting at 1."""
    work = df.withColumn("_b", bucket)
    inside = work.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)))
    sizes = work.groupBy(key, "_b").agg(F.count("*").alias("_c"))
    before = sizes.select(
        key, "_b",
        F.coalesce(
            F.sum("_c").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    return inside.join(before, [key, "_b"]).select(*df.columns, (F.col("_before") + F.col("_rn")).alias(name))
