"""Texts masked in blocks against the same texts in one row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.blocks import line_blocks, mask_in_blocks
from cloakframe.operators.mask import mask_documents
from cloakframe.plans.rules import Term, activate, default_rules


def both(df, rules, size, id_col="doc_id"):
    one, cut = mask_documents(df, id_col, "text", rules), mask_in_blocks(df, id_col, "text", rules, size)
    pairs = [(one.wide.drop("mapping"), cut.masked), (one.mapping, cut.mapping), (one.summary, cut.summary)]
    return [tuple(sorted((tuple(r) for r in d.select(pair[0].columns).collect()), key=repr) for d in pair) for pair in pairs]


def test_blocks_are_the_text(spark):
    texts = ["", "a", "\n", "\n\n\n", "ab\ncd\n", "x" * 50, "x" * 50 + "\n" + "y\n" * 9 + "tail", "é\U0001F600\n" * 7, "a\r\nb\rc\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("b", line_blocks(F.col("text"), 8))
    for r in df.collect():
        assert "".join(r.b) == r.text
        assert all(b.endswith("\n") for b in r.b[:-1]) and all(len(b) <= 9 or "\n" not in b[:-1] for b in r.b)
    assert df.filter("text IS NULL").count() == 0 and spark.sql("SELECT CAST(NULL AS STRING) AS text").select(line_blocks(F.col("text"))).first()[0] == [None]


def test_one_text_of_many_lines(spark):
    rng = random.Random(3)
    lines = [f"{rng.choice(['tel', 'mail'])} 1{rng.randrange(30_000, 99_000) * 10 ** 5 + rng.randrange(300)} u{rng.randrange(500)}@x.com" for _ in range(100_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:50]))], "doc_id int, text string")
    for one, cut in both(df, activate(["phone", "email"]), 1 << 14):
        assert one == cut


def test_random_texts_and_odd_rows(spark):
    rng = random.Random(5)
    bits = ["13900000000", "13900000001", "a@b.com", "10.0.0.1", "\n", "\n", " ", "x", "1", "\U000F0001", "\U0010FFFD", "张三", "2024-01-02"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60))), f"row {i}") for i in range(120)]
    rows += [(900, None, "null"), (901, "", None), (None, "13900000000\n13900000001 13900000000", "no id")]
    df = spark.createDataFrame(rows, "doc_id int, text string, block string").withColumn("masked_before", F.lit(1))
    rules = default_rules().add("digits", r"\d(?=\s*$)", "***D***").add("word", "x+", "<X>", use_counter=False)
    for one, cut in both(df, rules, 12):
        assert one == cut
    assert mask_in_blocks(df.limit(0), "doc_id", "text", rules).masked.count() == 0


def test_parts_and_refusals(spark):
    df = spark.createDataFrame([(1, "13900000000\nab\n13900000000\n")], "doc_id int, text string")
    out = mask_in_blocks(df, "doc_id", "text", activate(["phone"]), 6)
    assert [tuple(r) for r in out.parts.orderBy("block").collect()] == [(1, 0, "***PHONE***1\n"), (1, 1, "ab\n"), (1, 2, "***PHONE***1\n")]
    with pytest.raises(Exception, match="equal ids"):
        mask_in_blocks(df.union(df), "doc_id", "text", activate(["phone"])).masked.collect()
    with pytest.raises(ValueError):
        mask_in_blocks(df, "doc_id", "text", activate([], [Term("1", "ab", "C")]))


def test_rules_run_once(spark):
    """All readers of the worked blocks share one exchange."""
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit("\n13900000000\n")).alias("text"))
    out = mask_in_blocks(df, "doc_id", "text", activate(["phone"])).masked
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    spread = [line for line in plan.split("\n") if "REPARTITION_BY_NUM" in line]
    assert sum("ReusedExchange" not in line for line in spread) == 2 and len(spread) > 2


def test_readers_of_a_mapping_share_the_blocks_after_the_rules(spark):
    docs = spark.createDataFrame([(1, "13900000000\nx"), (2, "a@b.cn\n13900000001\n13900000000")], "doc_id long, text string")
    plan = mask_in_blocks(docs, "doc_id", "text", default_rules(), block_chars=12).mapping._jdf.queryExecution().optimizedPlan().toString()
    # a filter of one reader below the exchange would make its exchange another one, and the rules run again
    assert plan.count("Generate posexplode") > 1 and not re.search(r"Filter [^\n]*\n[^\n]*Generate posexplode", plan)
