"""Column and cell policies for tables.

Tables are long ``cells(workbook, sheet, row, col, value)`` with 1-based sheet
rows and columns; row 1 is the header. Policies, headers and overrides are
usually small: they are broadcast once their row count has been checked, so
that the cells themselves are not shuffled; larger ones take a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.partial import apply_strategy
from cloakframe.functions.text import a1_decode, a1_encode, normalize_header

CELL_KEYS = ["workbook", "sheet", "row", "col"]


class BindingAmbiguous(ValueError):
    code = "EXCEL_BINDING_AMBIGUOUS"


# --- tables to cells and back --------------------------------------------------


def table_to_cells(df: DataFrame, row_col: str, columns: list[str], workbook: Column | str = "", sheet: Column | str = "Sheet1") -> DataFrame:
    """Unpivot a table with a row number (1-based data rows) into cells, header included.

    Data row n is sheet row n + 1; every value becomes text, NULL becomes ''.
    """
    wb = F.lit(workbook) if isinstance(workbook, str) else workbook
    sh = F.lit(sheet) if isinstance(sheet, str) else sheet
    cells = F.array(*[
        F.struct(F.lit(i + 1).alias("col"), F.lit(c).alias("header"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"))
        for i, c in enumerate(columns)
    ])
    data = df.select(wb.alias("workbook"), sh.alias("sheet"), (F.col(row_col) + 1).cast("long").alias("row"), F.explode(cells).alias("c"))
    return data.select("workbook", "sheet", "row", "c.col", "c.value")


def headers_of(columns: list[str], spark, sheet: str = "Sheet1", workbook: str = "") -> DataFrame:
    rows = [(workbook, sheet, i + 1, c) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "workbook STRING, sheet STRING, col INT, header STRING")


def cells_to_table(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Pivot cells of one layout back to rows."""
    return cells.groupBy("workbook", "sheet", "row").agg(
        *[F.max(F.when(F.col("col") == i + 1, F.col("value"))).alias(c) for i, c in enumerate(columns)]
    )


def table_profile(cells: DataFrame, headers: DataFrame, samples: int = 5) -> DataFrame:
    """Header, first samples and extent per column. Sheet rows are numbered, so
    the samples are a filter on the row number and nothing is sorted."""
    keys = ["workbook", "sheet", "col"]
    first = F.col("row").between(2, samples + 1)
    per = cells.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.when(first, F.struct("row", "value")))), lambda x: x["value"]
        ).alias("samples"),
        F.max("row").alias("max_row"),
    )
    extent = per.groupBy("workbook", "sheet").agg(F.max("max_row").alias("max_row"), F.max("col").alias("max_col"))
    return per.drop("max_row").join(headers, keys, "left").join(extent, ["workbook", "sheet"]).select(
        *keys, "header", "samples", "max_row", "max_col"
    )


# --- policy binding --------------------------------------------------------------


def _book(*tables: DataFrame) -> list[str]:
    """``workbook`` where every table has it; a table without it speaks for all workbooks."""
    return ["workbook"] if all("workbook" in t.columns for t in tables) else []


def bind_policy(policy: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve column rules to columns: ``(bindings, conflicts)``.

    ``policy``: rule_ord, sheet, col_index (0-based), header_text, strategy,
    replacement. A rule binds to its index when index and header agree, else to
    the only column with its header, else to the index alone. Each workbook of
    ``headers`` is bound by itself; a policy with a ``workbook`` column speaks for that one only.
    """
    key = [*_book(headers), "sheet"]
    on = [*_book(headers, policy), "sheet"]
    h = headers.select(*key, (F.col("col") - 1).alias("h_index"), normalize_header(F.col("header")).alias("h_norm"))
    sheets = h.select(*key).distinct()
    known = policy.join(sheets, on).withColumn("norm", normalize_header(F.col("header_text")))
    unknown = policy.join(sheets, on, "left_anti")
    joined = known.join(h, key, "left")
    per_rule = joined.groupBy(*known.columns).agg(
        F.bool_or(F.col("h_index") == F.col("col_index")).alias("index_ok"),
        F.bool_or((F.col("h_index") == F.col("col_index")) & (F.col("h_norm") == F.col("norm"))).alias("agrees"),
        F.count_if(F.col("h_norm") == F.col("norm")).alias("n_match"),
        F.min(F.when(F.col("h_norm") == F.col("norm"), F.col("h_index"))).alias("header_index"),
    )
    unique = (F.col("norm") != "") & (F.col("n_match") == 1)
    crossed = unique & F.col("index_ok") & (F.col("header_index") != F.col("col_index"))
    code = (
        F.when(F.col("agrees"), None)
        .when(crossed, "INDEX_HEADER_MISMATCH")
        .when(unique, None)
        .when(F.col("n_match") > 1, "HEADER_AMBIGUOUS")
        .when(F.col("index_ok"), None)
        .otherwise("NO_COLUMN")
    )
    resolved = per_rule.withColumn("conflict", code).withColumn(
        "target",
        F.when(F.col("conflict").isNotNull(), None)
        .when(F.col("agrees"), F.col("col_index"))
        .when(unique, F.col("header_index"))
        .otherwise(F.col("col_index")),
    )
    rank = F.row_number().over(Window.partitionBy(*key, "target").orderBy("rule_ord"))
    ranked = resolved.withColumn("rn", F.when(F.col("target").isNotNull(), rank))
    bindings = ranked.filter("rn = 1").select(
        *key, (F.col("target") + 1).cast("int").alias("col"), "rule_ord", "strategy", "replacement"
    )
    conflicts = (
        ranked.filter("conflict IS NOT NULL OR rn > 1")
        .select(*key, "rule_ord", F.coalesce("conflict", F.lit("DUPLICATE_COLUMN")).alias("conflict"))
        .unionByName(unknown.select(*on, "rule_ord", F.lit("UNKNOWN_SHEET").alias("conflict")), allowMissingColumns=True)
        .withColumn("severity", F.lit("error"))
    )
    return bindings, conflicts


def bind_overrides(overrides: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cell overrides (1-based): the last duplicate wins. ``(overrides, conflicts)``.

    A duplicate is an error; an override over a bound column wins and is a warning.
    """
    key, on = [*_book(overrides), "sheet"], [*_book(overrides, bindings), "sheet"]
    book = _book(bindings)
    per_cell = overrides.groupBy(*key, "row", "col").agg(
        F.max_by(F.struct("strategy", "replacement", "rule_ord"), "rule_ord").alias("o"), F.count("*").alias("n")
    )
    chosen = per_cell.select(*key, "row", "col", "o.*")
    duplicate = per_cell.filter("n > 1").select(
        *key, "o.rule_ord", F.lit("DUPLICATE_OVERRIDE").alias("conflict"), F.lit("error").alias("severity")
    )
    over_bound = chosen.join(bindings.select(*{*book, *on}, "col"), [*on, "col"]).select(
        *{*book, *key}, "rule_ord", F.lit("OVERRIDE_ON_BOUND_COLUMN").alias("conflict"), F.lit("warning").alias("severity")
    )
    return chosen, duplicate.unionByName(over_bound, allowMissingColumns=True)


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """``Sheet!A1:B3`` entries (rule_ord, sheet, range, strategy, replacement) to one override per cell."""
    part = F.regexp_replace("range", r"(?s)^.*!", "")
    corner = lambda i: a1_decode(F.coalesce(F.get(F.split(part, ":"), F.lit(i)), F.get(F.split(part, ":"), F.lit(0))), F.col("sheet"))
    boxed = ranges.withColumn("a", corner(0)).withColumn("b", corner(1)).filter("a IS NOT NULL AND b IS NOT NULL")
    rows = F.sequence(F.least("a.row", "b.row"), F.greatest("a.row", "b.row"))
    cols = F.sequence(F.least("a.col", "b.col"), F.greatest("a.col", "b.col"))
    cells = boxed.select("*", F.explode(rows).alias("row")).select("*", F.explode(cols).alias("col"))
    last = cells.groupBy("sheet", "row", "col").agg(F.max_by(F.struct("rule_ord", "strategy", "replacement"), "rule_ord").alias("o"))
    return last.select("sheet", "row", "col", "o.*")


# --- applying a policy -------------------------------------------------------------


def check_conflicts(conflicts: DataFrame) -> None:
    """Refuse to write while there are errors; the conflict table itself is the report."""
    if conflicts.filter("severity = 'error'").limit(1).count():
        raise BindingAmbiguous("column rules or overrides are ambiguous")


def mask_cells(cells: DataFrame, bindings: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Override, then column rule, else unchanged. Adds ``strategy`` and ``masked``."""
    on = [*_book(cells, bindings), "sheet"]
    cols = bindings.select(*on, "col", F.col("strategy").alias("_cs"), F.col("replacement").alias("_cr"))
    out = cells.join(cols, [*on, "col"], "left")
    strategy, replacement = F.col("_cs"), F.col("_cr")
    if overrides is not None:
        key = [*_book(cells, overrides), "sheet"]
        ov = overrides.select(*key, "row", "col", F.col("strategy").alias("_os"), F.col("replacement").alias("_or"))
        out = out.join(ov, [*key, "row", "col"], "left")
        replacement = F.when(F.col("_os").isNotNull(), F.col("_or")).otherwise(replacement)
        strategy = F.coalesce("_os", "_cs")
    value = F.coalesce("value", F.lit(""))
    data = (F.col("row") > 1)
    return (
        out.withColumn("value", value)
        .withColumn("strategy", F.when(data & (value != ""), strategy))
        .withColumn("masked", apply_strategy(F.col("value"), F.col("strategy"), replacement))
        .drop("_cs", "_cr", "_os", "_or")
    )


def mask_columns(df: DataFrame, strategies: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Wide form: ``column -> (strategy, replacement)``, one projection, no shuffle."""
    return df.select(*[
        apply_strategy(
            F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(strategies[c][0]), F.lit(strategies[c][1]).cast("string")
        ).alias(c)
        if c in strategies
        else F.col(c)
        for c in df.columns
    ])


def policy_preview(masked_cells: DataFrame, n: int = 20) -> DataFrame:
    """First data rows of each sheet, original and masked side by side."""
    return masked_cells.filter(F.col("row").between(2, n + 1)).select("workbook", "sheet", "row", "col", "value", "masked", "strategy")


def cell_mapping(masked_cells: DataFrame) -> DataFrame:
    """Changed cells with the hash and a short preview of the original."""
    return masked_cells.filter(F.col("masked") != F.col("value")).select(
        "workbook",
        a1_encode(F.col("row"), F.col("col")).alias("cell_ref"),
        F.sha2("value", 256).alias("original_sha256"),
        F.left(F.col("value"), F.lit(8)).alias("original_preview"),
        "masked",
        F.col("strategy").alias("strategy_id"),
        F.col("col").alias("col_index"),
        F.col("row").alias("row_index"),
        "sheet",
    )


def coverage_report(masked_cells: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Hits, covered cells and ratio per sheet, with its number of conflicts."""
    out = masked_cells.filter((F.col("row") > 1) & (F.col("value") != "")).groupBy("workbook", "sheet").agg(
        F.count_if(F.col("masked") != F.col("value")).alias("hits"), F.count("*").alias("covered_cells")
    )
    out = out.withColumn("coverage_ratio", F.when(F.col("covered_cells") > 0, F.col("hits") / F.col("covered_cells")).otherwise(0.0))
    if conflicts is None:
        return out
    if not _book(conflicts):
        conflicts = conflicts.withColumn("workbook", F.lit(None).cast("string"))
    # a conflict without a workbook stands for all of them
    own = conflicts.filter("workbook IS NOT NULL").groupBy("workbook", "sheet").agg(F.count("*").alias("_own"))
    shared = conflicts.filter("workbook IS NULL").groupBy("sheet").agg(F.count("*").alias("_all"))
    out = out.join(own, ["workbook", "sheet"], "left").join(shared, "sheet", "left")
    return out.withColumn("conflicts", F.coalesce("_own", F.lit(0)) + F.coalesce("_all", F.lit(0))).drop("_own", "_all")


def strategy_summary(masked_cells: DataFrame, totals: bool = False) -> DataFrame:
    """Changed cells per sheet and strategy; ``totals`` adds roll-up rows."""
    changed = masked_cells.filter(F.col("masked") != F.col("value"))
    grouped = changed.rollup("sheet", "strategy") if totals else changed.groupBy("sheet", "strategy")
    return grouped.agg(F.count("*").alias("entity_count"))


# --- saved policies -----------------------------------------------------------------


_TEMPLATE_FIELDS = ("rule_ord", "sheet", "col_index", "header_text", "strategy", "replacement")


def policy_templates(policies: DataFrame, policy_col: str = "policy_id") -> DataFrame:
    """Each policy of a table of rules with its content and the hash that names it; policies of equal content get one name."""
    body = F.to_json(F.sort_array(F.collect_list(F.struct(*_TEMPLATE_FIELDS))))
    named = policies.groupBy(policy_col).agg(body.alias("policy_json"), F.count("*").alias("n_rules"))
    return named.withColumn("template_id", F.left(F.sha2("policy_json", 256), F.lit(16)))


def policy_template(policy: DataFrame) -> DataFrame:
    """Saved policy named by the hash of its content (a policy is small)."""
    body = F.to_json(
        F.sort_array(F.collect_list(F.struct("rule_ord", "sheet", "col_index", "header_text", "strategy", "replacement")))
    )
    return policy.agg(body.alias("policy_json")).withColumn("template_id", F.left(F.sha2("policy_json", 256), F.lit(16)))


def write_template(policy: DataFrame, path: str) -> None:
    """Save a policy under the hash of its content; saving it twice leaves one copy."""
    name = policy_template(policy).first()["template_id"]
    tagged = policy.withColumn("template_id", F.lit(name))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("template_id").json(path)


def read_template(spark, path: str, template_id: str) -> DataFrame:
    schema = "rule_ord INT, sheet STRING, col_index INT, header_text STRING, strategy STRING, replacement STRING, template_id STRING"
    return spark.read.schema(schema).json(path).filter(F.col("template_id") == template_id).drop("template_id")
