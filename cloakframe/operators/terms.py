"""The term library as a table: checks, edits, search and import (for snapshots see :mod:`cloakframe.operators.snapshots`).

``terms``: id, term, category, description, enabled, created_at, updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.plans import lexicon as lx

TERM_SCHEMA = "id STRING, term STRING, category STRING, description STRING, enabled BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP"


class ImportRejected(ValueError):
    code = "TERM_IMPORT_REJECTED"


def term_error(term: Column, category: Column, description: Column) -> Column:
    """First failed check of a trimmed entry, or NULL."""
    return (
        F.when(term.isNull() | (term == ""), "TERM_REQUIRED")
        .when(category.isNull() | (category == ""), "CATEGORY_REQUIRED")
        .when(F.char_length(term) > lx.TERM_MAX_CHARS, "TERM_TOO_LONG")
        .when(F.char_length(category) > lx.CATEGORY_MAX_CHARS, "CATEGORY_TOO_LONG")
        .when(F.char_length(description) > lx.DESCRIPTION_MAX_CHARS, "DESCRIPTION_TOO_LONG")
    )


def _trimmed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in ("term", "category", "description")})


def create_terms(terms: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejects)``: entries are checked one by one; a term exists only once.

    Of several new entries with the same term the first id wins.
    """
    work = _trimmed(new).withColumn("error_code", term_error(F.col("term"), F.col("category"), F.col("description")))
    valid, invalid = work.filter("error_code IS NULL").drop("error_code"), work.filter("error_code IS NOT NULL").select("id", "term", "error_code")
    # what may stay, as rows of its own: joined by term and id, a term with very many entries is in no task as a whole
    free = valid.groupBy("term").agg(F.min("id").alias("_id")).join(terms.select("term").distinct(), "term", "left_anti")
    no_id = F.lit(None).cast(valid.schema["id"].dataType)  # an entry without an id is no second one
    free = free.select(F.col("term").alias("_term"), F.explode(F.array_distinct(F.array("_id", no_id))).alias("_id"), F.lit(True).alias("_ok"))
    done = valid.join(free, (F.col("term") == F.col("_term")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    rejects = done.filter("_ok IS NULL").select("id", "term", F.lit("TERM_DUPLICATE").alias("error_code"))
    return done.filter("_ok").select(*new.columns), invalid.unionByName(rejects)


def over_capacity(terms: DataFrame, n_new: int, max_rows: int = lx.TERM_MAX_ROWS) -> bool:
    """Whether the library would outgrow ``max_rows`` (a bounded count)."""
    room = max_rows - n_new
    return room < 0 or terms.limit(room + 1).count() > room


def update_terms(terms: DataFrame, patch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``(terms, rejects)``: NULL keeps the old value; the result is checked again.

    ``patch``: id, term, category, description, enabled. A patched term may
    not equal another entry's term.
    """
    p = patch.select("id", *[F.col(c).alias(f"_{c}") for c in ("term", "category", "description", "enabled")], F.lit(True).alias("_hit"))
    joined = terms.join(p, "id", "left")
    next_values = joined.withColumns({
        f"new_{c}": F.coalesce(F.trim(f"_{c}"), c) for c in ("term", "category", "description")
    }).withColumn("new_enabled", F.coalesce("_enabled", "enabled"))
    holders = terms.select(F.col("term").alias("new_term"), F.col("id").alias("_holder"))
    changed = next_values.filter("_hit").select("id", "new_term", "new_category", "new_description").join(holders, "new_term", "left")
    checked = changed.groupBy("id", "new_term", "new_category", "new_description").agg(
        F.bool_or(F.coalesce(F.col("_holder") != F.col("id"), F.lit(False))).alias("_dup")
    )
    code = F.coalesce(
        term_error(F.col("new_term"), F.col("new_category"), F.col("new_description")), F.when(F.col("_dup"), "TERM_DUPLICATE")
    )
    verdicts = checked.select("id", code.alias("error_code"))
    unknown = patch.join(terms.select("id"), "id", "left_anti").select("id", F.lit("NOT_FOUND").alias("error_code"))
    rejects = verdicts.filter("error_code IS NOT NULL").unionByName(unknown)
    final = next_values.join(verdicts.withColumnRenamed("error_code", "_err"), "id", "left")
    use = F.col("_hit").isNotNull() & F.col("_err").isNull()
    cols = {c: F.when(use, F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("term", "category", "description", "enabled")}
    return final.select("id", *[v.alias(k) for k, v in cols.items()], "created_at", F.when(use, now).otherwise(F.col("updated_at")).alias("updated_at")), rejects


def delete_terms(terms: DataFrame, ids: DataFrame) -> DataFrame:
    return terms.join(ids.select("id"), "id", "left_anti")


def search_terms(terms: DataFrame, text: str | None = None, category: str | None = None, enabled_only: bool = False) -> DataFrame:
    """Substring of term or category (literal), newest first."""
    out = terms
    if category is not None:
        out = out.filter(F.col("category") == category)
    if text:
        out = out.filter(F.contains("term", F.lit(text)) | F.contains("category", F.lit(text)))
    if enabled_only:
        out = out.filter("enabled")
    return out.orderBy(F.desc("created_at"), "id")


def search_terms_desktop(terms: DataFrame, text: str) -> DataFrame:
    """Pattern search (``%`` and ``_`` are wildcards) over term and description."""
    like = f"%{text}%"
    return terms.filter(F.col("term").like(like) | F.col("description").like(like)).orderBy("category", "term")


def term_page(terms: DataFrame, page: int, size: int, text: str | None = None, category: str | None = None, dictionary_order: bool = False) -> DataFrame:
    """One page, newest first or in Chinese dictionary order; the category is ignored while searching."""
    out = search_terms(terms, text, None if text else category)
    if dictionary_order:
        out = out.orderBy(F.collate("term", "zh"), "id")
    return out.offset((page - 1) * size).limit(size)


def categories(terms: DataFrame) -> DataFrame:
    return terms.select("category").distinct().orderBy("category")


def term_statistics(terms: DataFrame) -> DataFrame:
    return terms.agg(
        F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"),
        F.count_distinct("category").alias("categories"),
    )


# --- import and export ------------------------------------------------------------


def import_rejects(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """Why an import must be refused: invalid rows, duplicates inside it or against the library."""
    work = _trimmed(rows).withColumn("error_code", term_error(F.col("term"), F.col("category"), F.col("description")))
    invalid = work.filter("error_code IS NOT NULL").select("term", "error_code")
    twice = work.groupBy("term").agg(F.count("*").alias("n")).filter("n > 1").select("term", F.lit("DUPLICATE_IN_FILE").alias("error_code"))
    known = work.select("term").distinct().join(terms.select("term"), "term", "left_semi").select("term", F.lit("TERM_DUPLICATE").alias("error_code"))
    return invalid.unionByName(twice).unionByName(known)


def import_terms(terms: DataFrame, rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """All or nothing: the library with the new rows, or an error. ``max_rows`` bounds the library where one is wanted."""
    rejects = import_rejects(terms, rows).limit(1).count()
    if rejects or max_rows is not None and over_capacity(terms, rows.limit(max_rows + 1).count(), max_rows):
        raise ImportRejected("the import holds invalid, duplicate or too many rows")
    return terms.unionByName(_trimmed(rows).select(*terms.columns))


def read_term_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Strict term file: exact header, four columns, status 启用 or 禁用; one bad row, or more than ``max_rows``, rejects all."""
    names = ["category", "term", "description", "status"]
    schema = ", ".join(f"{n} STRING" for n in names) + ", _bad STRING"
    raw = spark.read.schema(schema).csv(path, header=False, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    head = F.array(F.regexp_replace("category", "^﻿", ""), "term", "description", "status")
    is_head = head == F.lit(lx.TERM_CSV_HEADER)
    ok_status = F.col("status").isin("启用", "禁用")
    checks = raw.agg(
        F.count_if(is_head).alias("heads"), F.count("*").alias("n"),
        F.count_if(~is_head & (F.col("_bad").isNotNull() | ~F.coalesce(ok_status, F.lit(False)))).alias("bad"),
    ).first()
    if checks["heads"] != 1 or checks["bad"] or max_rows is not None and checks["n"] - 1 > max_rows:
        raise ImportRejected("the term file has a wrong header, a bad row or too many rows")
    rows = raw.filter(~F.coalesce(is_head, F.lit(False)))
    return rows.select("term", "category", F.coalesce("description", F.lit("")).alias("description"), (F.col("status") == "启用").alias("enabled"))


def parse_term_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lenient import: comma split, short or blank rows skipped, missing status means enabled."""
    parts = F.transform(F.split(col, ",", -1), lambda s: F.trim(s))
    rows = lines.select(parts.alias("p")).filter((F.size("p") >= 2) & (F.get("p", F.lit(0)) != "") & (F.get("p", F.lit(1)) != ""))
    rows = rows.filter(F.get("p", F.lit(0)) != lx.TERM_CSV_HEADER[0])
    status = F.get("p", F.lit(3))
    return rows.select(
        F.get("p", F.lit(1)).alias("term"), F.get("p", F.lit(0)).alias("category"), F.coalesce(F.get("p", F.lit(2)), F.lit("")).alias("description"),
        F.coalesce(~status.isin("禁用"), F.lit(True)).alias("enabled"),
    )


def term_export(terms: DataFrame) -> DataFrame:
    head = lx.TERM_CSV_HEADER
    return terms.select(
        F.col("category").alias(head[0]), F.col("term").alias(head[1]), F.coalesce("description", F.lit("")).alias(head[2]),
        F.when(F.col("enabled"), "启用").otherwise("禁用").alias(head[3]),
    )


def write_term_csv(terms: DataFrame, path: str) -> None:
    term_export(terms).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")
