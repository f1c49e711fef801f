"""Masking all cells of tables with one counter per table.

A table can be far larger than a task, so cells are masked in steps that each
scale: matches become occurrences; occurrences are reduced to distinct values
per table (map-side first); values are numbered by first appearance with the
bucketed rank of :mod:`cloakframe.operators.ordering`; and the placeholders are
joined back. A value that fills a third of all cells costs one row after the
reduction; on the way back its join partition is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.hof import SENTINEL_CLASS, sentinel_char
from cloakframe.functions.sizes import small_batches
from cloakframe.operators.detect import entities_column
from cloakframe.operators.finding_sweep import swept_findings
from cloakframe.operators.mask import FINDINGS_TYPE, active_findings, apply_pattern, is_wide, token_part, word_sides
from cloakframe.operators.ordering import global_rank
from cloakframe.operators.term_join import LINES_TYPE, TERMS_TYPE, attach_terms, swept
from cloakframe.plans.rules import RuleSet, java_pattern

ROWS_PER_BUCKET = 100_000


def _marked(value: Column, rules: list) -> Column:
    """Struct (t, occ): value with sentinels, and what they stand for."""
    occ_type = "array<struct<rank:int,original:string>>"
    state = F.struct(
        F.regexp_replace(value, SENTINEL_CLASS, sentinel_char(0)).alias("t"),
        F.transform(
            F.regexp_extract_all(value, F.lit(SENTINEL_CLASS), F.lit(0)),
            lambda m: F.struct(F.lit(0).alias("rank"), m.alias("original")),
        ).cast(occ_type).alias("occ"),
    )
    steps = F.array(state)
    for rank, rule in enumerate(rules, start=1):
        steps = apply_pattern(steps, rank, java_pattern(rule.pattern), is_wide(rule.pattern))
    return F.get(steps, F.lit(0))


def _swept_cells(cells: DataFrame, active: list, rules: RuleSet, findings: str | None, terms: DataFrame | None, either: bool) -> DataFrame:
    """``cells`` with ``_s`` (t, occ) after rules, terms and findings, null without a match, and ``_terms`` and ``_found`` to describe ranks."""
    value = F.coalesce("value", F.lit(""))
    df = cells.withColumn("_found", active_findings(F.col(findings), rules.enabled_ids()) if findings else F.array().cast(FINDINGS_TYPE))
    lines = F.array(_marked(value, active))
    if either:
        lines = F.when(F.size("_found") > 0, F.array(_marked(value, []))).otherwise(lines)
    first = len(active) + 1
    df = df.withColumn("_lines", lines.cast(LINES_TYPE))
    if terms is None:
        df = df.withColumn("_terms", F.lit(None).cast(TERMS_TYPE)).withColumn("_swept", F.col("_lines"))
    else:
        df = attach_terms(df, F.get("_lines", F.lit(0))["t"], terms)
        if either:
            df = df.withColumn("_terms", F.when(F.size("_found") == 0, F.col("_terms")))
        df = df.withColumn("_swept", swept(F.col("_lines"), F.col("_terms"), first, *word_sides(active)))
    if findings:
        number = F.lit(first) + F.greatest(F.coalesce(F.size("_terms"), F.lit(0)), F.lit(0))
        df = df.withColumn("_swept", swept_findings(F.col("_swept"), F.transform("_found", lambda f: f["text"]), number, sentinel_char(first + 1)))
    state = F.get("_swept", F.lit(0))
    return df.withColumn("_s", F.when(F.size(state["occ"]) > 0, state)).drop("_lines", "_swept")


def _shared(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` behind one exchange that all its readers share, so that sweeps run once.

    A row is an array of one struct: its fields stay together, else each reader's exchange would hold its own columns.
    """
    packed = df.select(F.xxhash64(*keys).alias("_key"), F.array(F.struct("*")).alias("_row")).repartition("_key")
    return packed.select(F.inline_outer("_row"))


def mask_table_cells(
    cells: DataFrame, rules: RuleSet, table_col: str = "workbook", *,
    findings: str | None = None, terms: DataFrame | None = None, either: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(masked cells, mapping)`` for cells(workbook, sheet, row, col, value).

    Values are numbered per ``table_col``, sheet by sheet (by ``sheet_ord`` where the cells have it, else by
    name), in row-major order. Rules are the counted and constant rules of the set; cells use every rule. ``terms`` is a library as a
    table of any size, looked for after the rules; ``findings`` names an array column of (text, entity_type), looked for after both, in its own cell only. With
    ``either``, a cell with a finding is masked by its findings alone, another one by rules and terms. A rule set that holds terms itself is
    refused: they are given as a table. Null cells stay null.
    """
    rules = rules.checked(cells.sparkSession)
    if rules.terms:
        raise ValueError("terms of cells are given as a table")
    sheet = [c for c in ("sheet_ord", "sheet") if c in cells.columns]
    active = [r for r in rules.rules if r.enabled]
    keys = [table_col, *sheet, "row", "col"]
    swept_too = findings is not None or terms is not None
    if swept_too:
        marked = _shared(_swept_cells(small_batches(cells), active, rules, findings, terms, either), keys)
        untouched = marked.filter(F.col("_s").isNull()).select(*cells.columns)
    else:
        hit = F.lit(False)
        for r in active:
            hit = hit | F.rlike(F.col("value"), F.lit(java_pattern(r.pattern)))
        marked = cells.withColumn("_s", F.when(hit, _marked(F.col("value"), active)))
        untouched = cells.filter(~F.coalesce(hit, F.lit(False)))

    templates = F.lit([""] + [r.template for r in active])
    ids = F.lit([""] + [r.id for r in active])
    counted = F.lit([False] + [r.use_counter for r in active])

    def token(rank: Column) -> Column:
        """What is written for a value of this rank: (prefix, suffix, rule_id, counted)."""
        of_rule = F.struct(
            F.get(templates, rank).alias("prefix"), F.lit("").alias("suffix"), F.get(ids, rank).alias("rule_id"), F.get(counted, rank).alias("counted")
        )
        if not swept_too:
            return of_rule
        n_terms = F.greatest(F.coalesce(F.size("_terms"), F.lit(0)), F.lit(0))
        term, kind = F.get("_terms", rank - len(active) - 1), F.get("_found", rank - len(active) - 1 - n_terms)["entity_type"]
        of_term = F.struct(
            F.concat(F.lit("["), term["category"], F.lit("]")).alias("prefix"), F.lit("").alias("suffix"),
            F.concat(F.lit("sensitive_term_"), term["id"]).alias("rule_id"), F.lit(False).alias("counted"),
        )
        of_finding = F.struct(
            token_part(kind, 1).alias("prefix"), token_part(kind, 2).alias("suffix"), token_part(kind, 3).alias("rule_id"), F.lit(True).alias("counted")
        )
        return F.when(rank <= len(active), of_rule).when(rank <= len(active) + n_terms, of_term).otherwise(of_finding)

    # sentinels in text order, lined up with the recorded values
    marks = F.sort_array(
        F.transform(F.regexp_extract_all("_s.t", F.lit(SENTINEL_CLASS), F.lit(0)), lambda c, i: F.struct(c.alias("c"), i.alias("at")))
    )
    occ = F.zip_with(
        marks, "_s.occ",
        lambda m, o: F.struct(o["rank"].alias("rank"), m["at"].alias("at"), o["original"].alias("original"), token(o["rank"]).alias("token")),
    )
    with_hits = marked.filter(F.col("_s").isNotNull()).select(*keys, occ.alias("occ"))
    long = with_hits.select(*keys, F.explode("occ").alias("o")).select(*keys, "o.*")
    place = [*sheet, "row", "col", "rank", "at"]
    first = F.struct(*place, "token")
    values = long.filter("rank > 0").groupBy(table_col, "original").agg(F.min(first).alias("f"), F.count("*").alias("n_occurrences"))
    values = values.select(table_col, "original", "n_occurrences", "f.*").select("*", "token.*").drop("token")

    bucket = F.struct(*sheet, F.floor(F.col("row") / ROWS_PER_BUCKET).alias("part"))
    mapping = global_rank(values.filter("counted"), table_col, place, bucket, "no").withColumn(
        "masked", F.concat("prefix", F.col("no").cast("string"), "suffix")
    ).drop("no")
    if terms is not None or not all(r.use_counter for r in active):
        mapping = mapping.unionByName(values.filter("NOT counted").withColumn("masked", F.col("prefix")))

    placed = long.select(*keys, "rank", "at", "original").join(mapping.select(table_col, "original", "masked"), [table_col, "original"], "left")
    outs = placed.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("at", F.when(F.col("rank") == 0, F.col("original")).otherwise(F.col("masked")).alias("out")))).alias("outs")
    )
    # cells without a match are not shuffled
    joined = marked.filter(F.col("_s").isNotNull()).join(outs, keys, "left")
    text = F.array_join(
        F.zip_with(F.split("_s.t", SENTINEL_CLASS, -1), "outs", lambda p, r: F.concat(p, F.coalesce(r["out"], F.lit("")))), ""
    )
    changed = joined.withColumn("masked", F.when(F.col("outs").isNull(), F.col("value")).otherwise(text)).select(*cells.columns, "masked")
    masked = untouched.withColumn("masked", F.col("value")).unionByName(changed)
    return masked, mapping.select(table_col, "original", "masked", "rule_id", "n_occurrences")


def choose_cell_mode(cells: DataFrame, detectors: list[str] = ("regex",)) -> tuple[DataFrame, DataFrame]:
    """Split cells for the either/or mode: ``(cells with findings, cells without)`` per table.

    A table with any finding uses findings only, another one uses the rules.
    """
    flagged = cells.withColumn("_f", F.size(entities_column(F.col("value"), list(detectors))) > 0)
    has = flagged.groupBy("workbook").agg(F.bool_or("_f").alias("_any"))
    joined = flagged.drop("_f").join(has, "workbook")
    return joined.filter("_any").drop("_any"), joined.filter("NOT _any").drop("_any")


def preview_rows(cells: DataFrame, rules: RuleSet, n: int = 10, **how) -> tuple[DataFrame, DataFrame]:
    """Mask only the first n data rows (by row number) of each table; ``how`` as for :func:`mask_table_cells`."""
    return mask_table_cells(cells.filter(F.col("row").between(2, n + 1)), rules, **how)


def with_entities(cells: DataFrame, detectors: list[str] = ("regex",), name: str = "entities") -> DataFrame:
    """``cells`` with what the detectors find in each value, an array that serves as findings and as a preview's entities."""
    return cells.withColumn(name, entities_column(F.col("value"), list(detectors)))
