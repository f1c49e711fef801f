"""Greedy choice of non-overlapping spans inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,priority:int,neg_len:int,ord:int,stop:int,text:string,rule_id:string,template:string>"


def span(start: Column, stop: Column, priority: Column, ord: Column, text: Column, rule_id: Column, template: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), priority.cast("int").alias("priority"), (start - stop).cast("int").alias("neg_len"),
        ord.cast("int").alias("ord"), stop.cast("int").alias("stop"), text.alias("text"), rule_id.alias("rule_id"), template.alias("template"),
    )


def choose_spans(spans: Column) -> Column:
    """By start, then priority, then longest; a span that begins inside an accepted one is dropped."""
    zero = F.struct(F.lit(0).alias("last"), F.array().cast(f"array<{SPAN}>").alias("kept"))
    return F.aggregate(
        F.sort_array(spans),
        zero,
        lambda acc, s: F.when(s["start"] < acc["last"], acc).otherwise(
            F.struct(s["stop"].alias("last"), F.concat(acc["kept"], F.array(s)).alias("kept"))
        ),
        lambda acc: acc["kept"],
    )
