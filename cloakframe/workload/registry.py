"""Registry of named queries over the shared tables, each with its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloakframe.functions.sizes import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, sql: str | None = None, covers: str = "") -> Callable[[Query], Query]:
    """Register a query; ``covers`` names the inventory rows it exercises."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return add


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """A shared table, read as its files lie.

    The test tables have one row group each. Where a session says so (``spark.cloakframe.partitions``, as the bench
    and the tests do) or ``partitions`` is given, text tables are spread first, whatever their size.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = partitions or int(spark.conf.get("spark.cloakframe.partitions", "0"))
    return spread(df, n) if n and name in TEXT_TABLES else df
