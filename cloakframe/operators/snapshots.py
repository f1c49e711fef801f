"""Frozen term sets, stored once by content.

The enabled terms of a library are written under the digest of their content, their version. A batch holds a pointer to a version, so ten
thousand batches over one library cost one copy of it. Both are published by renaming a finished folder to a name that must not
exist: of two writers one wins, the other drops its own folder and takes what is there. Equal libraries have one version whatever the order
of their rows; a batch that has a pointer keeps it, whatever happens to the library. The folder has to lie on a file system whose rename
is atomic.

An empty library, or one without enabled terms, is a version too. Nulls in a term's columns count as values; repeated rows are kept.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("id", "term", "category", "enabled")
PARTS = 64  # one version's rows are joined in this many parts


def enabled_terms(terms: DataFrame) -> DataFrame:
    return terms.filter("enabled").select(F.col("id").cast("string").alias("id"), "term", "category", "enabled")


def snapshot_version(terms: DataFrame) -> str:
    """Digest of the enabled terms: rows are digested, then 4,096 buckets of them, then the buckets."""
    digest = F.sha2(F.to_json(F.struct(*COLUMNS)), 256)
    rows = enabled_terms(terms).select(digest.alias("h"))
    buckets = rows.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("d"))
    return buckets.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list(F.concat("b", "d")))), 256)).first()[0]


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def publish(df: DataFrame, target: str) -> bool:
    """Write ``df`` aside and rename it to ``target``; false where ``target`` has come into being before."""
    spark = df.sparkSession
    aside = f"{target.rsplit('/', 2)[0]}/_new-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    (fs, new), (_, at) = _files(spark, aside), _files(spark, target)
    fs.mkdirs(at.getParent())
    option = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    only_new = spark.sparkContext._gateway.new_array(option, 1)
    only_new[0] = option.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(new, at, only_new)
    except Py4JJavaError:
        fs.delete(new, True)
        if not fs.exists(at):
            raise
        return False
    return True


def write_version(terms: DataFrame, path: str) -> str:
    """Store the enabled terms once and give their version."""
    version = snapshot_version(terms)
    target = f"{path}/versions/{version}"
    if not _exists(terms.sparkSession, target):
        publish(enabled_terms(terms), target)
    return version


def read_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path}/versions/{version}").select(*COLUMNS)


def _pointer(path: str, batch_id: str) -> str:
    name = "".join(c if c.isascii() and c.isalnum() else f"-{ord(c):x}-" for c in batch_id)
    return f"{path}/batches/b-{name}"


def write_snapshot(terms: DataFrame, batch_id: str, path: str) -> str:
    """The version of a batch: that of ``terms`` as they are now, unless the batch has one."""
    spark, target = terms.sparkSession, _pointer(path, batch_id)
    if not _exists(spark, target):
        version = write_version(terms, path)
        publish(spark.createDataFrame([(batch_id, version)], "batch_id STRING, version STRING").coalesce(1), target)
    return spark.read.parquet(target).first()["version"]


def read_snapshot(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    """The terms of a batch; a batch without a pointer is an error."""
    version = spark.read.parquet(_pointer(path, batch_id)).first()["version"]
    return read_version(spark, path, version).withColumn("batch_id", F.lit(batch_id))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, version) of all batches with a pointer."""
    return spark.read.parquet(f"{path}/batches/*")


def expand(pointers: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of many batches as rows, from (batch_id, version) and terms with their version: an equi-join in ``PARTS`` parts, since all batches may point at one version."""
    part = F.pmod(F.xxhash64("term", "id"), F.lit(PARTS)).cast("int")
    spread = pointers.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return spread.join(terms.withColumn("_part", part), ["version", "_part"]).drop("_part")


def freeze_snapshot(terms: DataFrame, batches: DataFrame, path: str) -> DataFrame:
    """(batch_id, version, id, term, category, enabled) of every batch that asked for terms (``wants_terms``), from one stored version; later edits do not change it."""
    version = write_version(terms, path)
    pointers = batches.filter("wants_terms").select("batch_id", F.lit(version).alias("version"))
    return expand(pointers, read_version(terms.sparkSession, path, version).withColumn("version", F.lit(version)))
