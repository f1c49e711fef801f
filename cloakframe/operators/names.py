"""Masking names of files: partial masks on the stem, extension kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.hof import constant_array, let
from cloakframe.functions.partial import partial_mask
from cloakframe.functions.text import clean_display_name, file_extension, file_stem
from cloakframe.operators.detect import file_name_names, pattern_entities
from cloakframe.operators.spans import SPAN, choose_spans, span
from cloakframe.operators.term_match import candidate_terms
from cloakframe.plans import lexicon as lx
from cloakframe.plans.rules import Rule, RuleSet, java_pattern

_GUARD = {
    # a number inside a longer number, a passport inside a longer word
    "phone": "[0-9]", "id_card": "[0-9]", "bank_card": "[0-9]", "passport": "[A-Za-z0-9]",
}


def _guarded(entities: Column, stem: Column, neighbours: str) -> Column:
    """Drop matches with a neighbour of the given class (bytes = ASCII around)."""

    def touches(e: Column) -> Column:
        raw = stem.cast("binary")
        before = F.substring(raw, e["start"], F.lit(1)).cast("string")
        after = F.substring(raw, e["end"] + 1, F.lit(1)).cast("string")
        return ((e["start"] > 0) & F.rlike(before, F.lit(f"^{neighbours}$"))) | F.rlike(after, F.lit(f"^{neighbours}$"))

    return F.filter(entities, lambda e: ~touches(e))


def _rule_span(order: int, rule: Rule):
    priority = lx.NAME_SPAN_PRIORITY.get(rule.id, 8)
    return lambda e: span(
        e["start"], e["end"], F.lit(priority), F.lit(order), e["text"], F.lit(rule.id), F.lit(rule.template)
    )


def name_spans(stem: Column, rules: RuleSet) -> Column:
    """Candidate spans of all enabled rules, terms and personal names."""
    parts = []
    for i, rule in enumerate(r for r in rules.rules if r.enabled and r.id != "chinese_name"):
        found = pattern_entities(stem, rule.id, java_pattern(rule.pattern))
        if rule.id in _GUARD:
            found = _guarded(found, stem, _GUARD[rule.id])
        parts.append(F.transform(found, _rule_span(i, rule)))
    if rules.terms:
        labels = constant_array([f"[{t.category}]" for t in rules.terms])
        ids = constant_array([t.rule_id for t in rules.terms])

        def of_term(c: Column) -> Column:
            hits = F.regexp_extract_all(stem, c["pattern"], F.lit(0))
            gaps = F.split(stem, c["pattern"], -1)
            # names are short: begin of each hit by the gaps before it
            starts = F.transform(
                hits,
                lambda h, k: F.aggregate(
                    F.slice(gaps, 1, k + 1), F.lit(0), lambda acc, g: acc + F.octet_length(g)
                ) + k * F.octet_length(h),
            )
            return F.zip_with(
                hits, starts,
                lambda h, s: span(s, s + F.octet_length(h), F.lit(0), F.lit(1000) + c["rank"], h, F.get(ids, c["rank"]), F.get(labels, c["rank"])),
            )

        parts.append(F.flatten(F.transform(candidate_terms(stem, rules.terms, 0), of_term)))
    if any(r.id == "chinese_name" and r.enabled for r in rules.rules):
        parts.append(
            F.transform(
                file_name_names(stem),
                lambda e: span(e["start"], e["end"], F.lit(7), F.lit(100000), e["text"], F.lit("chinese_name"), F.lit("姓名")),
            )
        )
    return F.concat(*parts) if parts else F.array().cast(f"array<{SPAN}>")


def mask_stem(stem: Column, rules: RuleSet) -> Column:
    """Struct (masked, mapping, masked_entity_count) of a stem."""

    def write(chosen: Column) -> Column:
        masked = lambda s: partial_mask(s["rule_id"], s["text"], s["template"])
        raw = stem.cast("binary")
        pieces = F.transform(
            chosen,
            lambda s, i: F.concat(
                F.substring(
                    raw, F.when(i == 0, 0).otherwise(F.get(chosen, i - 1)["stop"]) + 1,
                    s["start"] - F.when(i == 0, 0).otherwise(F.get(chosen, i - 1)["stop"]),
                ).cast("string"),
                masked(s),
            ),
        )
        last = F.coalesce(F.get(chosen, F.size(chosen) - 1)["stop"], F.lit(0))
        rest = F.substring(raw, last + 1, F.octet_length(stem)).cast("string")
        return F.struct(
            F.concat(F.array_join(pieces, ""), rest).alias("masked"),
            F.array_distinct(
                F.transform(chosen, lambda s: F.struct(s["text"].alias("original"), masked(s).alias("masked"), s["rule_id"].alias("rule_id")))
            ).alias("mapping"),
            F.size(chosen).cast("bigint").alias("masked_entity_count"),
        )

    return let(choose_spans(name_spans(stem, rules)), write)


def mask_names(df: DataFrame, name_col: str, rules: RuleSet, prefix: str = "masked") -> DataFrame:
    """Add ``<prefix>_name``, its mapping and count. The name is cleaned before and after."""
    rules = rules.checked(df.sparkSession)
    work = df.withColumn("_clean", clean_display_name(F.col(name_col))).withColumn("_stem", file_stem(F.col("_clean")))
    work = work.withColumn("_m", mask_stem(F.col("_stem"), rules))
    ext = file_extension(F.col("_clean"))
    masked = F.col("_m.masked")
    final = F.when(F.regexp_replace(masked, r"^[ .]+|[ .]+$", "") == "", "upload").otherwise(masked)
    rebuilt = F.when(ext.isNotNull() & (ext != ""), F.concat(final, F.lit("."), ext)).otherwise(final)
    return work.select(
        *df.columns, clean_display_name(rebuilt).alias(f"{prefix}_name"), F.col("_m.mapping").alias(f"{prefix}_mapping"),
        F.col("_m.masked_entity_count").alias(f"{prefix}_count"),
    )


