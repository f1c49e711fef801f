"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. A row's fractional rank (rank - 1/2) / rows of the source spreads each
source evenly over (0, 1); the rows sorted by it are cut into ``shards`` runs whose lengths differ by one at most, so every shard has the
mixture of the whole. Ranks are global positions over ranges of the order, so no task holds a whole source.

Null texts have size ``overhead``; null sources form one source, after all others at equal fractional ranks. Repeated rows and ids are rows of
their own. With fewer rows than shards some shards stay empty; an empty table gives an empty result. Only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import ranked, saved

SHARDS, SEED, OVERHEAD = 40, "shards", 16


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, overhead: int = OVERHEAD) -> DataFrame:
    """One row per document: id, source, size, text_crc32, shard, slot (gapless from 0 within the shard, in interleaved order)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"),
    )
    # the row number of the written table tells equal rows apart, so that many of them don't meet in one range
    rows = saved(rows).withColumn("u", F.monotonically_increasing_id())
    by_source = [F.col("source").isNull(), F.col("source"), F.col("key"), F.col("size"), F.col("text_crc32"), F.col("u")]
    placed = ranked(rows, by_source, "place")
    placed = saved(placed)
    sources = placed.groupBy(F.col("source").alias("of")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    sources = saved(sources)  # also what the number of rows is taken from
    total = sources.agg(F.sum("n")).first()[0] or 0
    joined = placed.join(sources, F.col("source").eqNullSafe(F.col("of")))
    fraction = (2 * (F.col("place") - F.col("first")) + 1) / (2 * F.col("n"))
    spread = joined.select("id", "source", "size", "text_crc32", "place", fraction.alias("fraction"))
    cut = ranked(spread, [F.col("fraction"), F.col("place")], "position")
    shard = F.expr(f"(position - 1) * {shards} div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    out = cut.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("position") - 1 - start).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "text_crc32", "shard", "slot")
