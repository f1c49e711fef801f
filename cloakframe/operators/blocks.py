"""Masking of very large texts: one text is split over many tasks.

:func:`cloakframe.operators.mask.mask_documents` handles a text in one row, which is best while texts are small against a task. Here
every text is cut into blocks of whole lines, and a block is a row of its own. No rule of a document reads beyond its line, so blocks are
masked apart, up to the placeholders: each block keeps its text with sentinels and its distinct values. Values are then numbered over the
blocks of a text in the order of first appearance (running sums over block buckets, nothing gathers a text), the names go back to the
blocks that hold the values, and blocks are written. The results equal those of ``mask_documents``.

Blocks are shuffled twice: once to spread the work, once by (text, block) for the join with the names. A line longer than a block is a
block alone. Null and empty texts stay what they are. ``id_col`` tells rows apart (null counts as a value); where it does not,
``masked`` raises an error. Other columns are carried along, whatever their names; those of this module begin with ``_b_``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.hof import constant_array, let
from cloakframe.operators.mask import (
    active_rules,
    distinct_values,
    foreign_marks,
    is_whole,
    joined_lines,
    marks_in_order,
    rule_lines,
    segments,
    values_in_order,
)
from cloakframe.operators.ordering import running_sum
from cloakframe.plans.rules import RuleSet

BLOCK_CHARS = 1 << 15
KEY = ["_b_key", "_b_no"]


def line_blocks(text: Column, block_chars: int = BLOCK_CHARS) -> Column:
    """The text as an array of blocks of whole lines, of at most ``block_chars`` + 1 characters unless a line is longer."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s:.{{0,{block_chars}}})\\n|[^\\n]+\\n?"), F.lit(0))
    return F.when(F.size(cut) > 0, cut).otherwise(F.array(text))


def _worked(text: Column, carried: list[Column], rules: RuleSet) -> Column:
    """One block after all rules: marked text, what stands at each sentinel, distinct values, sizes."""
    whole = is_whole(active_rules(rules, "document"), "document")

    def shape(state: Column, ordered: Column, by_value: Column, values: Column) -> Column:
        slots = F.flatten(
            F.transform(
                values,
                lambda v, i: F.transform(
                    F.sequence(v["start"], v["start"] + v["n"] - 1),
                    lambda j: F.struct(F.get(by_value, j)["at"].alias("at"), i.alias("value"), F.lit(None).cast("string").alias("out")),
                ),
            )
        )
        foreign = F.transform(foreign_marks(ordered), lambda m: F.struct(m["at"].alias("at"), F.lit(None).cast("int").alias("value"), m["out"].alias("out")))
        return F.struct(
            *carried,
            F.when(text.isNotNull(), state["t"]).alias("marked"),
            F.sort_array(F.concat(slots, foreign)).alias("slots"),
            F.transform(
                values,
                lambda v, i: F.struct(
                    i.alias("value"), v["original"].alias("original"), v["pos"].alias("pos"), v["rank"].alias("rank"),
                    v["line"].alias("line"), v["n"].alias("n"),
                ),
            ).alias("values"),
            F.size(by_value).cast("long").alias("n_marks"),
            F.regexp_count(state["t"], F.lit("\n")).cast("long").alias("n_lines"),
        )

    def of(state: Column) -> Column:
        return let(
            marks_in_order(state, "document", whole),
            lambda o: let(values_in_order(o), lambda a: let(distinct_values(a), lambda d: shape(state, o, a, d))),
        )

    return let(joined_lines(rule_lines(text, rules)), of)


@dataclass
class BlockOutput:
    """Results of :func:`mask_in_blocks`; nothing is computed before one of them is read."""

    worked: DataFrame
    entries: DataFrame
    id_col: str

    @property
    def parts(self) -> DataFrame:
        """(id, block, masked): masked texts in numbered parts, for texts that no row should hold."""
        return self._written().select(F.col("_b_id").alias(self.id_col), F.col("_b_no").alias("block"), "masked")

    @property
    def masked(self) -> DataFrame:
        """One row per input row: all columns but the text, ``masked`` and ``masked_entity_count``."""
        part = F.struct("_b_no", "masked")
        n = F.aggregate("_b_values", F.lit(0).cast("long"), lambda s, v: s + v["n"])
        whole = self._written().withColumn("_b_n", F.coalesce(n, F.lit(0).cast("long"))).groupBy("_b_key").agg(
            F.first("_b_row", ignorenulls=True).alias("_b_row"),
            F.array_sort(F.collect_list(part)).alias("_b_parts"),
            F.sum("_b_n").alias("_b_n"),
            F.count_if(F.col("_b_no") == 0).alias("_b_rows"),
        )
        text = F.when(F.col("_b_parts")[0]["masked"].isNotNull(), F.array_join(F.transform("_b_parts", lambda p: p["masked"]), ""))
        one = F.when(F.col("_b_rows") > 1, F.raise_error(F.lit("rows with equal ids cannot be masked in blocks"))).otherwise(text)
        return whole.select("_b_row.*", one.alias("masked"), F.col("_b_n").alias("masked_entity_count"))

    @property
    def mapping(self) -> DataFrame:
        """Long mapping table, as :attr:`cloakframe.operators.mask.MaskOutput.mapping`."""
        before = self._before()
        shared = self.entries.groupBy("_b_key", "masked").agg(F.count("*").alias("_b_shared"))
        ids = self._firsts().select("_b_key", F.col("_b_id").alias(self.id_col))
        out = self.entries.join(before, KEY).join(shared, ["_b_key", "masked"]).join(ids, "_b_key")
        return out.select(
            self.id_col, "original", "masked", "rule_id", (F.col("pos") + F.col("_b_marks")).cast("int").alias("first_seen"),
            (F.col("line") + F.col("_b_lines")).cast("int").alias("line"), F.col("n").cast("int").alias("n_occurrences"),
            (F.col("_b_shared") == 1).alias("restorable"),
        )

    @property
    def summary(self) -> DataFrame:
        """(id, masked_entity_count, distinct_values) for every input row."""
        counts = self.entries.groupBy("_b_key").agg(F.sum("n").alias("_b_n"), F.count("*").alias("_b_d"))
        ids = self._firsts().select("_b_key", F.col("_b_id").alias(self.id_col))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        return ids.join(counts, "_b_key", "left").select(self.id_col, zero("_b_n").alias("masked_entity_count"), zero("_b_d").cast("int").alias("distinct_values"))

    def _state(self) -> DataFrame:
        return unpacked(self.worked)

    def _firsts(self) -> DataFrame:
        # told by the state, which the first block's row is part of: a filter by number would move below the exchange and make it another one
        return self._state().filter("_b_row IS NOT NULL")

    def _before(self) -> DataFrame:
        """Masked places and lines in the blocks before each block: one small row a block.

        The bucket is never null, or joins would put a filter on it below the exchange.
        """
        sizes = self._state().select(*KEY, F.struct(F.col("_b_marks"), F.col("_b_lines")).alias("_b_size"), F.shiftright("_b_no", 10).alias("_b_bucket"))
        out = sizes
        for name in ("_b_marks", "_b_lines"):
            own = F.col("_b_size")[name]
            out = running_sum(out, "_b_key", ["_b_no"], F.col("_b_bucket"), own, name).withColumn(name, F.col(name) - own)
        return out.select(*KEY, "_b_marks", "_b_lines")

    def _written(self) -> DataFrame:
        state = self._state()
        held = state.select(*KEY, F.inline_outer("_b_values")).filter("value IS NOT NULL")
        names = held.join(self.entries.select("_b_key", "original", "masked"), ["_b_key", "original"])
        per_block = names.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("value", "masked"))), lambda v: v["masked"]).alias("_b_names"))
        written = let(
            F.col("_b_names"),
            lambda ns: F.array_join(
                F.zip_with(
                    segments(F.col("_b_marked")), F.col("_b_slots"),
                    lambda p, s: F.concat(p, F.coalesce(s["out"], F.get(ns, s["value"]), F.lit(""))),
                ),
                "",
            ),
        )
        return state.join(per_block, KEY, "left").select(
            *KEY, "_b_row", "_b_id", F.when(F.col("_b_marked").isNotNull(), written).alias("masked"), "_b_values"
        )


def unpacked(worked: DataFrame) -> DataFrame:
    # by a generator: fields taken out one by one would be computed apart, below the exchange, for each reader;
    # an outer one, from which Spark does not derive a filter that works the texts once more
    state = worked.select(*KEY, F.inline_outer("_b_state"))
    return state.select(
        *KEY, "_b_id", "_b_row", F.col("marked").alias("_b_marked"), F.col("slots").alias("_b_slots"), F.col("values").alias("_b_values"),
        F.coalesce("n_marks", F.lit(0)).alias("_b_marks"), F.coalesce("n_lines", F.lit(0)).alias("_b_lines"),
    )


def mask_in_blocks(df: DataFrame, id_col: str, text_col: str, rules: RuleSet, block_chars: int = BLOCK_CHARS) -> BlockOutput:
    """Mask a column of very large texts with the rules of a document; see the module for what becomes of odd rows.

    Terms and findings need the whole text and are refused here.
    """
    rules = rules.checked(df.sparkSession)
    if rules.terms:
        raise ValueError("texts are masked in blocks with rules only")
    active = active_rules(rules, "document")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in df.columns if c != text_col]
    # the key is never null, so that joins derive no filter on it, which would make the readers' plans differ
    cut = df.select(
        F.coalesce(F.to_json(F.struct(F.col(id_col).alias("id"))), F.lit("")).alias("_b_key"), F.col(id_col).alias("_b_id"), F.struct(*kept).alias("_b_all"),
        F.posexplode(line_blocks(F.col(text_col), block_chars)).alias("_b_no", "_b_text"),
    )
    cut = cut.withColumn("_b_row", F.when(F.col("_b_no") == 0, F.col("_b_all"))).drop("_b_all")
    # rules cost far more than the bytes tell: a fixed number of tasks, which adaptive execution does not merge
    cut = cut.repartition(tasks, F.xxhash64(*KEY))
    # an array of one state: its fields stay together, so that all readers share one exchange behind the rules
    worked = cut.select(*KEY, F.array(_worked(F.col("_b_text"), [F.col("_b_id"), F.col("_b_row")], rules)).alias("_b_state")).repartition(tasks, *KEY)

    values = unpacked(worked).select(*KEY, F.inline_outer("_b_values")).filter("value IS NOT NULL")
    firsts = values.groupBy("_b_key", "original").agg(F.min(F.struct("_b_no", "pos", "rank", "line")).alias("f"), F.sum("n").alias("n"))
    firsts = firsts.select("_b_key", "original", "f.*", "n")
    told = lambda what, kind="string": F.get(constant_array([getattr(r, what) for r in active], kind), F.col("rank") - 1)
    described = firsts.select("*", told("template").alias("prefix"), told("id").alias("rule_id"), told("use_counter", "boolean").alias("counted"))
    # a bucket of blocks, so that one text's values are numbered in many windows
    numbered = running_sum(described, "_b_key", ["_b_no", "pos"], F.col("_b_no"), F.col("counted").cast("int"), "number")
    masked = F.when(F.col("counted"), F.concat("prefix", F.col("number").cast("string"))).otherwise(F.col("prefix"))
    return BlockOutput(worked, numbered.withColumn("masked", masked), id_col)
