"""Text helpers: cell references, header names, Markdown escaping, clean names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cloakframe.plans import lexicon as lx

# --- cell references -------------------------------------------------------------


def a1_column(col: Column) -> Column:
    """1-based column number to letters (bijective base 26, up to three letters)."""

    def letter(n: Column) -> Column:
        return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (n % 26 + 1).cast("int"), F.lit(1))

    n = col.cast("int")
    one = letter(n - 1)
    two = letter(F.floor((n - 27) / 26).cast("int"))
    three = letter(F.floor((n - 703) / 676).cast("int"))
    return F.when(n <= 26, one).when(n <= 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def a1_encode(row: Column, col: Column) -> Column:
    return F.concat(a1_column(col), row.cast("string"))


def a1_decode(ref: Column, sheet: Column) -> Column:
    """Struct (row, col), or NULL when the reference is not a cell of ``sheet``."""
    bang = F.when(F.contains(ref, F.lit("!")), F.regexp_extract(ref, r"(?s)^(.*)!", 1))
    quoted = bang.rlike(r"(?s)^'.*'$") & (F.char_length(bang) >= 2)
    unquoted = F.when(quoted, F.substring(bang, F.lit(2), F.char_length(bang) - 2)).otherwise(bang)
    same_sheet = F.coalesce((unquoted == "") | (unquoted == sheet), F.lit(True))
    cleaned = F.replace(F.regexp_extract(ref, r"(?s)([^!]*)$", 1), F.lit("$"), F.lit(""))
    letters = F.upper(F.regexp_extract(cleaned, r"^([A-Za-z]{1,7})([0-9]+)$", 1))
    digits = F.regexp_extract(cleaned, r"^([A-Za-z]{1,7})([0-9]+)$", 2)
    col = F.aggregate(
        F.regexp_extract_all(letters, F.lit("[A-Z]"), F.lit(0)), F.lit(0).cast("bigint"),
        lambda acc, c: acc * 26 + F.ascii(c) - 64,
    )
    row = F.when(F.char_length(F.ltrim(digits, F.lit("0"))) <= 9, F.try_to_number(digits, F.lit("9" * 38)).cast("bigint"))
    ok = (
        same_sheet & (letters != "")
        & row.between(1, lx.SHEET_MAX_ROW) & col.between(1, lx.SHEET_MAX_COL)
    )
    return F.when(ok, F.struct(row.cast("int").alias("row"), col.cast("int").alias("col")))


def normalize_header(header: Column) -> Column:
    """Trimmed, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(header)), r"[^\p{L}\p{N}]", "")


# --- Markdown ---------------------------------------------------------------------


def markdown_cell(value: Column) -> Column:
    """Escape a table cell: backslash, pipe, backtick; line ends become <br>."""
    escaped = F.regexp_replace(value, r"([\\|`])", r"\\$1")
    return F.regexp_replace(escaped, r"\r\n|\r|\n", "<br>")


def markdown_text(value: Column) -> Column:
    """Escape the eight Markdown characters of slide text; line ends become LF."""
    escaped = F.regexp_replace(value, r"([\\`*_#|\[\]])", r"\\$1")
    return F.regexp_replace(escaped, r"\r\n|\r", "\n")


def markdown_named_cell(value: Column) -> Column:
    """Cell of a table with named headers: carriage returns go, LF becomes <br>."""
    escaped = F.regexp_replace(value, r"([\\|])", r"\\$1")
    return F.replace(F.replace(escaped, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("<br>"))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, markdown_cell), " | ", ""), F.lit(" |"))


# --- names ------------------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/\\]*)$", 1)


def file_stem(name: Column) -> Column:
    """Name without its last extension; a leading dot does not start one."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_replace(name, r"(?s)\.[^.]*$", "")).otherwise(name)


def file_extension(name: Column) -> Column:
    """Last extension or NULL."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)\.([^.]*)$", 1))


def clean_display_name(name: Column) -> Column:
    """Base name of at most 120 characters, no control or reserved characters."""
    short = F.left(base_name(name), F.lit(120))
    safe = F.regexp_replace(short, r"[\p{Cc}:?\"<>|]", "_")
    trimmed = F.regexp_replace(safe, r"^[ .]+|[ .]+$", "")
    return F.when(trimmed == "", "upload").otherwise(trimmed)


_DEVICE = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|$)"


def clean_output_stem(stem: Column, fallback: str = "masked_file") -> Column:
    """As :func:`clean_display_name`, and reserved device names get a leading '_'."""
    safe = F.regexp_replace(stem, r"[\p{Cc}:?\"<>|/\\]", "_")
    trimmed = F.regexp_replace(safe, r"^[ .]+|[ .]+$", "")
    named = F.when(trimmed == "", fallback).otherwise(trimmed)
    return F.when(named.rlike(_DEVICE), F.concat(F.lit("_"), named)).otherwise(named)


def ascii_stem(name: Column, content: Column, job_id: Column) -> Column:
    """ASCII stem + 8 characters of the content hash + 8 of the job id."""
    lowered = F.regexp_replace(F.translate(file_stem(name), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", "-")
    stem = F.regexp_replace(lowered, "^-+|-+$", "")
    stem = F.when(stem == "", "excel-file").otherwise(stem)
    return F.concat_ws("-", stem, F.left(F.sha2(content.cast("binary"), 256), F.lit(8)), F.left(job_id, F.lit(8)))


# --- errors -----------------------------------------------------------------------


def retryable(code: Column) -> Column:
    """Whether an error code may be retried (unknown codes may not)."""
    return code.isin(*[c for c, flag in lx.ERROR_CODES if flag])


def error_codes(spark: SparkSession):
    return spark.createDataFrame(lx.ERROR_CODES, "error_code STRING, retryable BOOLEAN")
