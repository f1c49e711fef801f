"""Helpers shared by the corpus operators: written tables, Arrow batches, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 1 << 20
BATCH_ROWS = 1_000


_local_roots: dict[str, str] = {}
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    A local session without the setting gets one temporary folder; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_roots.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="shared-")
        _local_roots[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, computed once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``saved`` writes inside are removed at the end; the given function saves one that stays."""
    mine: list[str] = []
    _scratch.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        out = saved(df)
        mine.pop()
        return out

    try:
        yield keep
    finally:
        _scratch.remove(mine)
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def by_text(df: DataFrame) -> DataFrame:
    """``df`` for a Python step over texts: lowers the session's rows an Arrow batch, as ten thousand documents are a large one."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def sized(lengths: list[int], limit: int = BATCH_BYTES) -> Iterator[slice]:
    """Slices of texts of these lengths of about ``limit`` in all; one longer text makes a slice alone."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def parts(batch: pa.RecordBatch, text_at: int, limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of an Arrow batch with their texts as UTF-8 bytes (null: empty); only one slice's texts are held at a time."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    for at in sized(lengths, limit):
        rows = batch.slice(at.start, at.stop - at.start)
        yield rows, [b"" if t is None else t for t in rows.column(text_at).cast(pa.binary()).to_pylist()]


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, *columns: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns' values alone."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the position of each row (from 1) in the global order; no task sorts more than its range.

    Rows that are equal in ``order`` get distinct positions. ``order`` should tell rows apart, or one range could hold them all.
    """
    kept = df.columns
    cut = df.select(F.struct(*kept).alias("_row"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    cut = saved(cut.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = cut.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    return inside.join(F.broadcast(offsets), "_part").select("_row.*", (F.col("_before") + F.col("_rn")).alias(name))
