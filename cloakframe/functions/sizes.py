"""Spreading of inputs that sit in one row group."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Spread an input over ``partitions`` tasks before work that is heavy per row.

    A small file often is a single row group and thus a single task. It is the caller's choice, as it costs a
    shuffle of the input: a table of many row groups needs none.
    """
    return df.repartition(partitions)


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` for a Python step over texts: lowers the session's rows and bytes an Arrow batch, as ten thousand texts are a large one."""
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= 1_000:
        conf.set(rows, "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df
