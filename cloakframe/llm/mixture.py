"""Mixing sources to target weights.

Tokens are summed by source, a target is set for each source, and target / size is the source's repetition rate. Each document is
emitted floor(rate) times plus one Bernoulli copy with the probability of the remaining fraction, seeded by hashes. The draws of a source
are spread: its documents stand by size, equal ones by a hash of seed and id, and one hash-seeded number decides for all where copies fall.
Every document keeps exactly its probability, while the source's total misses the target by one document's size at most; independent draws
missed it by up to a third where a source has few or very unequal documents.

Targets: sources in code point order, null last, take the weights in turn and share the total. A source's target stops at ``most`` times
its size; the excess is shared by weight among the others, again and again, until none is above. Null texts have size 0; a source
without words has target 0 and rate 0. Repeated rows and ids are drawn one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import draw, ranked, saved, word_count

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mixture"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size), one row a source."""
    placed = ranked(sizes, [F.col("source").isNull(), F.col("source")], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = saved(placed.withColumn("weight", weight))
    per_weight = F.col("source_size") * most / F.col("weight")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # each round stops at least one more source; a few rounds in practice
        stopped = per_weight <= level
        at_most, rest = placed.agg(F.sum(F.when(stopped, F.col("source_size") * most)), F.sum(F.when(~stopped, F.col("weight")))).first()
        after = (total - (at_most or 0)) / rest if rest else level
        if after <= level:
            break
        level = after
    target = F.least(F.col("source_size") * float(most), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return placed.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _drawn(rows: DataFrame, aims: DataFrame, seed: str) -> DataFrame:
    """``rows`` (id, source, size, u and more) with source_size, target and copies; u tells equal rows apart."""
    order = [F.col("source").isNull(), F.col("source"), -F.col("size"), F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")))), F.col("u")]
    placed = ranked(rows, order, "place")
    placed = saved(placed)
    counts = saved(placed.groupBy("source").agg(F.min("place").alias("first")).withColumnRenamed("source", "s"))
    aims = aims.join(counts, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("start", draw(seed, "source"))
    joined = placed.join(saved(aims.drop("s").withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
    whole = F.floor("rate")
    upto = lambda n: F.floor(n * (F.col("rate") - whole) + F.col("start"))
    n = F.col("place") - F.col("first") + 1
    return joined.withColumn("copies", (whole + upto(n) - upto(n - 1)).cast("long"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: id, size, source_size, target, copies."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = saved(rows).withColumn("u", F.monotonically_increasing_id())
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    return _drawn(rows, aims, seed).select(F.col("id").alias(id_col), "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is to be taken."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = row.withColumn("u", F.monotonically_increasing_id())
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    often = _drawn(rows, aims, seed).filter("copies > 0")
    return often.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
