"""Sources: format routing, decoding, CSV, pages, sheets and OCR results.

Inputs are one row per file. Bad inputs are never dropped: they carry an
``error_code`` and can be split off with :func:`quarantine`. Everything that
gathers rows into documents gives numbered parts of bounded size, so no row is
dropped and no group can outgrow a task. Limits are reported, not applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.functions.hof import let
from cloakframe.functions.text import base_name, markdown_named_cell, markdown_row, markdown_text, retryable
from cloakframe.operators.ordering import global_rank, running_sum
from cloakframe.plans import lexicon as lx
from cloakframe.streaming.workdir import work_dir

# --- files ---------------------------------------------------------------------


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def route_formats(files: DataFrame, name_col: str) -> DataFrame:
    """Add extension, logical and input format; unknown or refused ones get an error code."""
    name = base_name(F.col(name_col))
    ext = F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))

    def lookup(i: int) -> Column:
        pairs = [F.lit(x) for row in lx.FORMATS if row[i] is not None for x in (row[0], row[i])]
        return F.element_at(F.create_map(*pairs), F.col("extension"))

    accepted = F.col("extension").isin(*[r[0] for r in lx.FORMATS if r[3]])
    return (
        files.withColumn("extension", F.when(ext != "", ext))
        .withColumns({"logical_format": lookup(1), "input_format": lookup(2)})
        .withColumn("error_code", F.when(~F.coalesce(accepted, F.lit(False)), "INPUT_FORMAT_UNSUPPORTED"))
    )


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good rows, bad rows with code and retry flag)``."""
    good = df.filter("error_code IS NULL").drop("error_code")
    return good, df.filter("error_code IS NOT NULL").withColumn("retryable", retryable(F.col("error_code")))


def decode_text(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Strict UTF-8; binary files in disguise and invalid bytes are ``INPUT_CORRUPTED``."""
    raw = F.col(content_col)
    head = F.hex(F.substring(raw, 1, 8))
    binary = F.lit(False)
    for magic in lx.BINARY_MAGIC_HEX:
        binary = binary | head.startswith(magic)
    bad = binary | ~F.is_valid_utf8(raw.cast("string"))
    return df.withColumn("text", F.when(~bad, raw.cast("string"))).withColumn("error_code", F.when(bad, "INPUT_CORRUPTED"))


def decode_lenient(df: DataFrame, content_col: str = "content") -> DataFrame:
    """UTF-8, else GBK when free of errors, else UTF-8 with replacement characters.

    GBK needs ``spark.sql.legacy.javaCharsets`` (the charset) and
    ``spark.sql.legacy.codingErrorAction`` (errors become replacement
    characters, which are looked for here); without both the last form is used.
    """
    raw = F.col(content_col)
    candidates = [F.try_validate_utf8(raw.cast("string"))]
    needed = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    if all(str(df.sparkSession.conf.get(name, "false")).lower() == "true" for name in needed):
        gbk = F.decode(raw, "GBK")
        candidates.append(F.when(~F.contains(gbk, F.lit("�")), gbk))
    return df.withColumn("text", F.coalesce(*candidates, F.make_valid_utf8(raw.cast("string"))))


# --- CSV -------------------------------------------------------------------------

_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",\r\n]*+)'
_RECORD = rf"{_FIELD}(?:,{_FIELD})*+(?:\r\n|\n|\r|\z)"


def csv_records(text: Column) -> Column:
    """Struct (rows, error_code, limit_code) of a CSV text, read strictly inside the row.

    Stray or open quotes and ragged rows are ``INPUT_CORRUPTED``, an input
    without fields is ``INPUT_NO_CONTENT``. Larger ones than the limits keep their
    rows and have the limit code ``INPUT_LIMIT_EXCEEDED``. Files that are large for
    one value are read by :func:`read_csv_table`.
    """
    body = F.regexp_replace(text, "^\\x{FEFF}", "")

    def unquote(f: Column) -> Column:
        return F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.char_length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)

    def fields(record: Column) -> Column:
        line = F.concat(F.regexp_replace(record, r"(?:\r\n|\n|\r)\z", ""), F.lit(","))
        return F.transform(F.regexp_extract_all(line, F.lit(f"({_FIELD}),"), F.lit(1)), unquote)

    def check(raw: Column) -> Column:
        whole = F.array_join(raw, "") == body
        kept = F.filter(raw, lambda r: F.regexp_replace(r, r"[\r\n]", "") != "")
        return let(F.transform(kept, fields), lambda rows: F.struct(rows.alias("rows"), code(rows, whole).alias("error_code"), limit(rows).alias("limit_code")))

    def code(rows: Column, whole: Column) -> Column:
        width = F.size(F.get(rows, F.lit(0)))
        ragged = F.exists(rows, lambda r: F.size(r) != width)
        return (
            F.when(~whole, "INPUT_CORRUPTED")
            .when(F.trim(body) == "", "INPUT_NO_CONTENT")
            .when(F.size(rows) == 0, "INPUT_NO_CONTENT")
            .when(ragged, "INPUT_CORRUPTED")
        )

    def limit(rows: Column) -> Column:
        width = F.size(F.get(rows, F.lit(0)))
        too_long = F.exists(rows, lambda r: F.exists(r, lambda f: F.octet_length(f) > lx.LIMITS["csv_field_bytes"]))
        large = (F.octet_length(text) > lx.LIMITS["csv_bytes"]) | (F.size(rows) > lx.LIMITS["csv_records"]) | (width > lx.LIMITS["csv_columns"])
        return F.when(large | too_long, "INPUT_LIMIT_EXCEEDED")

    return let(F.regexp_extract_all(body, F.lit(_RECORD), F.lit(0)), check)


def parse_csv(df: DataFrame, text_col: str = "text") -> DataFrame:
    done = df.withColumn("_c", csv_records(F.col(text_col)))
    return done.select(*df.columns, F.when(F.col("_c.error_code").isNull(), F.col("_c.rows")).alias("rows"), F.col("_c.error_code").alias("error_code"), F.col("_c.limit_code").alias("limit_code"))


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every column is text."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


# --- Markdown documents from tables ------------------------------------------------


def _rule(width: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))


def rows_to_markdown(rows: Column) -> Column:
    """Array of rows to a Markdown table with generic headers ``Column i``."""
    width = F.size(F.get(rows, F.lit(0)))
    header = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Column "), i.cast("string")))
    return F.array_join(F.concat(F.array(markdown_row(header), _rule(width)), F.transform(rows, markdown_row)), "\n")


def _pad(cells: Column, width: Column) -> Column:
    return F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))


def named_rows_to_markdown(rows: Column, headers: Column | None = None, widest: Column | None = None, first: Column | None = None) -> Column:
    """One column becomes plain lines; else a table with named headers, short rows padded.

    For parts of a document ``widest`` is the document's width and ``first`` tells the part with the header;
    the document is its parts, one after the other.
    """
    if widest is None:
        widest = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    first = F.lit(True) if first is None else first
    given = headers if headers is not None else F.array().cast("array<string>")
    width = F.greatest(widest, F.size(given))
    line = lambda cells: F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(" "), markdown_named_cell(c), F.lit(" |"))), ""))

    def table(w: Column) -> Column:
        named = F.when(F.size(given) > 0, given).otherwise(
            F.transform(F.sequence(F.lit(1), w), lambda i: F.concat(F.lit("列"), i.cast("string")))
        )
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), w), ""))
        body = F.transform(rows, lambda r: line(_pad(r, w)))
        lines = F.when(first, F.concat(F.array(line(_pad(named, w)), rule), body)).otherwise(body)
        return F.concat(F.array_join(lines, "\n"), F.lit("\n"))

    plain = F.array_join(F.transform(rows, lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit(""))), "\n")
    plain = F.when(plain.endswith("\n"), plain).otherwise(F.concat(plain, F.lit("\n")))
    return F.when(width <= 1, plain).otherwise(let(width, table))


def ragged_table_to_markdown(rows: Column, width: Column | None = None, first: Column | None = None) -> Column:
    """First row is the header; every row is padded to the widest.

    For parts of a document ``width`` is the document's width and ``first`` tells the part with the header;
    the document is its parts with a line feed between them.
    """
    if width is None:
        width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(1))
    first = F.lit(True) if first is None else first
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))

    def table(w: Column) -> Column:
        lines = F.transform(rows, lambda r: line(_pad(r, w)))
        headed = F.concat(F.slice(lines, 1, 1), F.array(_rule(w)), F.slice(lines, F.lit(2), F.size(lines)))
        return F.array_join(F.when(first, headed).otherwise(lines), "\n")

    return let(width, table)


PART_ROWS, PART_PAGES = 100_000, 1_000


def in_parts(df: DataFrame, keys: list[str], order_col: str, size: int, *ties: str) -> DataFrame:
    """Add ``part_no``: the rows of a document, by a numeric order column and then ``ties``, in parts of ``size`` rows, numbered from 0."""
    keyed = df.withColumn("_key", F.struct(*keys))
    ranked = global_rank(keyed, "_key", [order_col, *ties], F.floor(F.col(order_col) / size), "_rank")
    return ranked.withColumn("part_no", F.floor((F.col("_rank") - 1) / size).cast("int")).drop("_key", "_rank")


def collect_rows(cells: DataFrame, keys: list[str], row_col: str, cells_col: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Row table (keys, row, cells) to numbered parts (keys, part_no, rows, width) of ``part_rows`` rows at most.

    No row is dropped and no part grows with the document; ``width`` is the widest row of the whole document.
    """
    widest = cells.groupBy(*keys).agg(F.max(F.size(cells_col)).alias("width"))
    row = F.struct(F.col(row_col).alias("r"), F.col(cells_col).alias("c"))
    parts = in_parts(cells, keys, row_col, part_rows, cells_col).groupBy(*keys, "part_no").agg(
        F.transform(F.sort_array(F.collect_list(row)), lambda x: x["c"]).alias("rows")
    )
    return parts.join(widest, keys)


def sheet_limits(cells: DataFrame) -> DataFrame:
    """Per workbook: sheets, rows, columns and cells against the limits."""
    lim = lx.LIMITS
    per_sheet = cells.groupBy("workbook", "sheet").agg(F.max("row").alias("height"), F.max("col").alias("width"))
    return per_sheet.groupBy("workbook").agg(
        F.count("*").alias("sheets"), F.max("height").alias("max_rows"), F.max("width").alias("max_columns"),
        F.sum(F.col("height").cast("bigint") * F.col("width")).alias("cells"),
    ).withColumn(
        "error_code",
        F.when(
            (F.col("sheets") > lim["sheets"]) | (F.col("max_rows") > lim["sheet_rows"]) | (F.col("max_columns") > lim["sheet_columns"])
            | (F.col("cells") > lim["workbook_cells"]),
            "INPUT_LIMIT_EXCEEDED",
        ),
    )


def sheets_to_documents(cells: DataFrame, sheets: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Long cells and ``sheets(workbook, sheet, sheet_ord, visible, has_formula)`` to Markdown documents.

    Visible sheets in order, empty ones skipped. A workbook comes in parts (workbook, part_no, sheet, text): each
    sheet is cut every ``part_rows`` sheet rows, its first part has the title and the table's head. An empty line
    stands between sheets, a line feed between parts of a sheet. Limits are only reported.
    """
    limits = sheet_limits(cells)
    visible = sheets.filter("visible").select("workbook", "sheet", "sheet_ord", "has_formula")
    cell = F.struct("col", F.coalesce("value", F.lit("")).alias("value"))
    extent = cells.groupBy("workbook", "sheet").agg(F.max("col").alias("width"), F.min(F.floor(F.col("row") / part_rows)).alias("first"))
    rows = cells.groupBy("workbook", "sheet", "row").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    per_part = rows.groupBy("workbook", "sheet", F.floor(F.col("row") / part_rows).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("rows")
    )

    def filled_row(r: Column) -> Column:
        values = F.transform(r["cells"], lambda c: c["value"])
        sparse = let(
            F.map_from_entries(r["cells"]),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.coalesce(F.element_at(m, c), F.lit(""))),
        )
        return F.when(F.size(values) == F.col("width"), values).otherwise(sparse)

    filled = per_part.join(extent, ["workbook", "sheet"]).withColumn("rows", F.transform("rows", filled_row))
    head = F.concat(F.lit("## Sheet: "), F.col("sheet"), F.lit("\n\n"), rows_to_markdown(F.col("rows")))
    tail = F.array_join(F.transform("rows", markdown_row), "\n")
    shown = filled.withColumn("text", F.when(F.col("part") == F.col("first"), head).otherwise(tail)).join(visible, ["workbook", "sheet"])
    # one row a part is ranked, not the cells
    order = Window.partitionBy("workbook").orderBy("sheet_ord", "part")
    parts = shown.select("workbook", "sheet", "text", (F.row_number().over(order) - 1).alias("part_no"))
    formulas = cells.select("workbook", "sheet").distinct().join(visible, ["workbook", "sheet"]).groupBy("workbook").agg(F.bool_or("has_formula").alias("has_formula"))
    warnings = F.when(F.col("has_formula"), F.array(F.lit(lx.FORMULA_CELLS_WARNING))).otherwise(F.array().cast("array<string>"))
    return limits.select("workbook", F.col("error_code").alias("limit_code")).join(parts, "workbook", "left").join(formulas, "workbook", "left").select(
        "workbook", "part_no", "sheet", "text", warnings.alias("warnings"), "limit_code", F.when(F.col("text").isNull(), "INPUT_CORRUPTED").alias("error_code"),
    )


# --- pages and slides --------------------------------------------------------------


def _gather(df: DataFrame, keys: list[str], order: str, *values: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), *values))).alias("p"))


def pages_to_documents(pages: DataFrame, doc: str, page_col: str, text_col: str, part_pages: int = PART_PAGES) -> DataFrame:
    """``## Page n`` blocks in numbered parts (an empty line stands between parts); a document without any text needs OCR."""
    trimmed = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    whole = pages.groupBy(doc).agg(F.count("*").cast("int").alias("page_count"), F.bool_and(F.regexp_replace(trimmed, r"\s", "") == "").alias("blank"))
    g = _gather(in_parts(pages, [doc], page_col, part_pages), [doc, "part_no"], page_col, trimmed.alias("t")).join(whole, doc)
    number = lambda i: (F.col("part_no") * part_pages + i + 1).cast("string")
    text = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("## Page "), number(i), F.lit("\n\n"), F.regexp_replace(x["t"], r"^\s+|\s+$", ""))), "\n\n")
    return g.select(doc, "part_no", F.when(~F.col("blank"), F.concat(text, F.lit("\n"))).alias("text"), "page_count", F.when(F.col("blank"), "OCR_COMPONENT_REQUIRED").alias("error_code"))


def slides_to_documents(slides: DataFrame, doc: str, order_col: str, text_col: str, hidden_col: str | None = None, part_pages: int = PART_PAGES) -> DataFrame:
    """Slides in numbered parts (an empty line stands between parts)."""
    hidden = F.col(hidden_col) if hidden_col else F.lit(False)
    shown = markdown_text(F.coalesce(F.col(text_col), F.lit("")))
    whole = slides.groupBy(doc).agg(F.count("*").cast("int").alias("page_count"), F.bool_and(shown == "").alias("empty"), F.bool_or(hidden).alias("any_hidden"))
    g = _gather(in_parts(slides, [doc], order_col, part_pages), [doc, "part_no"], order_col, shown.alias("t")).join(whole, doc)
    number = lambda i: (F.col("part_no") * part_pages + i + 1).cast("string")
    text = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("## 幻灯片 "), number(i), F.lit("\n\n"), x["t"])), "\n\n")
    warn = F.when(F.col("any_hidden"), F.array(F.lit(lx.HIDDEN_SLIDES_WARNING))).otherwise(F.array().cast("array<string>"))
    return g.select(doc, "part_no", F.when(~F.col("empty"), text).alias("text"), "page_count", warn.alias("warnings"), F.when(F.col("empty"), "INPUT_NO_CONTENT").alias("error_code"))


def page_range(pages: DataFrame, doc: str, page_col: str, text_col: str, start: int, end: int, banner: str = "页") -> DataFrame:
    """Chosen pages with a banner each; a start beyond the last page is an error."""
    if start < 1 or start > end:
        raise ValueError("the first page is at least 1 and not behind the last")
    totals = pages.groupBy(doc).agg(F.max(page_col).alias("total"))
    head = F.lit("--- 第 ") if banner == "页" else F.lit(f"--- {banner} ")
    tail = F.lit(" 页 ---\n") if banner == "页" else F.lit(" ---\n")
    chosen = pages.filter(F.col(page_col).between(start, end))
    g = _gather(chosen, [doc], page_col, F.concat(head, F.col(page_col).cast("string"), tail, F.col(text_col), F.lit("\n")).alias("t"))
    return totals.join(g, doc, "left").select(
        doc, F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"), F.when(F.col("total") < start, "PAGE_RANGE_INVALID").alias("error_code")
    )


def estimated_pages(df: DataFrame, text_col: str, total_col: str) -> DataFrame:
    """Spread the lines of a text evenly over its estimated number of pages."""
    lines = F.split(F.regexp_replace(text_col, r"\r?\n\z", ""), r"\r?\n", -1)
    t = F.col(total_col).cast("bigint")

    def pages(ls: Column) -> Column:
        n = F.size(ls).cast("bigint")  # of the bound lines: a text is cut once, not once for each page
        at = lambda p: F.floor(p * n / t).cast("int")
        return F.transform(F.sequence(F.lit(0), t.cast("int") - 1), lambda p: F.array_join(F.slice(ls, at(p) + 1, at(p + 1) - at(p)), "\n"))

    single = (t <= 1) | (F.col(text_col) == "")
    return df.withColumn("pages", F.when(single, F.array(F.col(text_col))).otherwise(let(lines, pages)))


def pages_by_breaks(blocks: DataFrame, doc: str, order_col: str, break_col: str) -> DataFrame:
    """Page number of each block: one more than the breaks before it."""
    step = F.col(break_col).cast("int")
    run = running_sum(blocks, doc, [order_col], F.floor(F.col(order_col) / 10_000), step, "page_no")
    return run.withColumn("page_no", F.col("page_no") - step + 1)


# --- OCR results ---------------------------------------------------------------------

OCR_SCHEMA = (
    "pages ARRAY<STRUCT<page_number INT, width DOUBLE, height DOUBLE, "
    "blocks ARRAY<STRUCT<text STRING, bbox ARRAY<DOUBLE>, confidence DOUBLE, language STRING>>>>, "
    "quality STRUCT<total_pages INT, empty_pages INT, failed_pages INT, avg_confidence DOUBLE>"
)


def read_ocr(df: DataFrame, json_col: str) -> DataFrame:
    return df.withColumn("ocr", F.from_json(json_col, OCR_SCHEMA))


def ocr_blocks(df: DataFrame, id_col: str) -> DataFrame:
    """Long table of blocks."""
    pages = df.select(id_col, F.explode("ocr.pages").alias("p"))
    return pages.select(id_col, "p.page_number", "p.width", "p.height", F.posexplode("p.blocks").alias("block_ord", "b")).select(
        id_col, "page_number", "width", "height", "block_ord", "b.*"
    )


def _unit(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)


def validate_ocr(df: DataFrame) -> DataFrame:
    """First failed check of an OCR result, or NULL."""
    pages, q = F.col("ocr.pages"), F.col("ocr.quality")
    numbers = F.transform(pages, lambda p: p["page_number"])
    order = F.exists(
        F.sequence(F.lit(0), F.size(pages) - 1), lambda i: (i > 0) & (F.get(numbers, i) <= F.get(numbers, i - 1))
    )
    bad_block = F.exists(pages, lambda p: F.exists(p["blocks"], lambda b: ~_unit(b["confidence"])))
    problem = (
        F.when(pages.isNull() | (F.size(pages) == 0), "no pages")
        .when(q["total_pages"] != F.size(pages), "total_pages differs from the number of pages")
        .when(q["failed_pages"] > 0, "failed pages")
        .when(q["empty_pages"] > q["total_pages"], "empty_pages exceeds total_pages")
        .when(~_unit(q["avg_confidence"]), "avg_confidence out of range")
        .when(F.exists(numbers, lambda n: n == 0), "page_number is 1-based")
        .when(order, "pages out of order")
        .when(bad_block, "block confidence out of range")
    )
    return df.withColumn("problem", problem)


def ocr_quality(blocks: DataFrame, pages: DataFrame, id_col: str) -> DataFrame:
    """Pages in total, empty and failed ones, mean block confidence (4 digits)."""
    totals = pages.groupBy(id_col).agg(
        F.count_distinct("page_number").alias("total_pages"), F.count_if("is_empty").alias("empty_pages"), F.count_if("failed").alias("failed_pages")
    )
    conf = blocks.groupBy(id_col).agg(F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    return totals.join(conf, id_col, "left").withColumn("avg_confidence", F.coalesce("avg_confidence", F.lit(0.0)))


def ocr_to_text(ocr: Column) -> Column:
    """Page headings with their non-blank blocks, one per line."""
    def page(p: Column) -> Column:
        lines = F.transform(F.filter(p["blocks"], lambda b: F.regexp_replace(b["text"], r"\s", "") != ""), lambda b: b["text"])
        return F.concat(F.lit("## Page "), p["page_number"].cast("string"), F.lit("\n\n"), F.array_join(lines, "\n"))

    return F.array_join(F.transform(ocr["pages"], page), "\n")


# --- admission --------------------------------------------------------------------------


def batch_limits(files: DataFrame) -> DataFrame:
    """Per batch: files, largest file and bytes against the limits."""
    per = files.groupBy("batch_id").agg(F.count("*").alias("files"), F.max("size_bytes").alias("largest"), F.sum("size_bytes").alias("bytes"))
    return per.withColumn(
        "error_code",
        F.when((F.col("files") > lx.BATCH_MAX_FILES) | (F.col("largest") > lx.BATCH_MAX_FILE_BYTES) | (F.col("bytes") > lx.BATCH_MAX_BYTES), "INPUT_LIMIT_EXCEEDED"),
    )


def first_over_budget(files: DataFrame, budget: int = lx.BATCH_MAX_BYTES) -> DataFrame:
    """First file of each batch with which the running size passes the budget."""
    run = running_sum(files, "batch_id", ["file_ord"], F.floor(F.col("file_ord") / 10_000), F.col("size_bytes"), "running_bytes")
    return run.filter(F.col("running_bytes") > budget).groupBy("batch_id").agg(F.min("file_ord").alias("file_ord"))


def admit_files(
    files: DataFrame, max_files: int = lx.BATCH_MAX_FILES, max_file: int = lx.BATCH_MAX_FILE_BYTES, max_bytes: int = lx.BATCH_MAX_BYTES, bucket: int = 10_000
) -> DataFrame:
    """Admission with reasons, file after file; later smaller files may still fit.

    ``files``: batch_id, file_ord (a total order within a batch), name, size_bytes, mtime. A size that is null or negative counts
    as 0; nulls in the other columns are values like any other. Each batch is worked off in rounds over all batches at once, see
    :func:`_admitted`; windows run over ``bucket`` numbers of file_ord, so no task holds a whole batch.
    """
    batch, key = F.to_json(F.struct("batch_id")), F.to_json(F.struct("batch_id", "name", "size_bytes", "mtime"))
    routed = route_formats(files, "name").select(
        *files.columns, F.col("error_code").isNotNull().alias("_unsupported"), batch.alias("_batch"), key.alias("_key"),
        F.greatest(F.coalesce("size_bytes", F.lit(0)), F.lit(0)).cast("long").alias("_size"),
    )
    root = work_dir(files.sparkSession, "admit")
    firsts = routed.groupBy("_key").agg(F.min("file_ord").alias("_first"))
    judged = routed.join(firsts, "_key")
    eligible = judged.filter("file_ord = _first AND NOT _unsupported").select("_batch", "file_ord", "_size")
    accepted, state = _admitted(eligible, root, max_files, max_file, max_bytes, bucket)
    full = state.filter(F.col("n") >= max_files).select("_batch", F.col("pos").alias("_full"))
    out = judged.join(full, "_batch", "left").join(accepted.withColumn("_ok", F.lit(True)), ["_batch", "file_ord"], "left")
    reason = (
        F.when(F.col("file_ord") != F.col("_first"), "DUPLICATE")
        .when(F.col("_unsupported"), "UNSUPPORTED")
        .when(F.col("_ok"), "ACCEPTED")
        .when((F.col("file_ord") > F.col("_full")) | F.lit(max_files <= 0), "COUNT_LIMIT")
        .when(F.col("_size") > max_file, "FILE_TOO_LARGE")
        .otherwise("BATCH_TOO_LARGE")
    )
    return out.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ACCEPTED").select(*files.columns, "reason", "accepted")


def _admitted(eligible: DataFrame, root: str, max_files: int, max_file: int, max_bytes: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """``(accepted files, final state of each batch: pos, used, n, open)`` of the greedy rule.

    With r bytes left and u the largest power of two up to r, every file below u fits until less than u is left, and one file from
    u on that fits brings the rest below u as well. So a round takes the running sums of the files below u behind the last position,
    finds the first place where less than u is left or the count is full, and answers everything before it. The rest falls below
    the next power of two each round: as many rounds as ``max_bytes`` has bits at most, whatever the number of files. Rounds are
    written below ``root``; the driver learns only whether a batch is open.
    """
    spark = eligible.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    work = stored(eligible.filter(F.col("_size") <= max_file), "eligible")
    zero = F.lit(0).cast("long")
    state = stored(
        work.select("_batch").distinct().select("_batch", F.lit(None).cast(work.schema["file_ord"].dataType).alias("pos"), zero.alias("used"), zero.alias("n"), F.lit(max_files > 0).alias("open")), "state-0"
    )
    taken_schema = work.select("_batch", "file_ord").schema
    work.limit(0).select("_batch", "file_ord").write.mode("overwrite").parquet(f"{root}/accepted/round=0")
    number = 0
    while not state.filter("open").isEmpty():
        number += 1
        left = F.lit(max_bytes) - F.col("used")
        # shiftright of the highest bit: bin() has as many digits as the number has bits
        unit = F.when(left > 0, F.expr("1L").cast("long") * F.pow(F.lit(2.0), F.length(F.bin(left)) - 1).cast("long")).otherwise(zero)
        now = (
            work.join(state.filter("open").withColumn("left", left).withColumn("unit", unit), "_batch")
            .filter((F.col("pos").isNull() | (F.col("file_ord") > F.col("pos"))) & (F.col("_size") <= F.col("left")))
            .withColumn("small", (F.col("_size") < F.col("unit")) | (F.col("left") == 0))
            .withColumn("b", F.floor(F.col("file_ord") / bucket))
        )
        size, one = F.when(F.col("small"), F.col("_size")).otherwise(zero), F.col("small").cast("long")
        inside = Window.partitionBy("_batch", "b").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = Window.partitionBy("_batch").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        totals = now.groupBy("_batch", "b").agg(F.sum(size).alias("s"), F.sum(one).alias("c"))
        carried = totals.select("_batch", "b", F.coalesce(F.sum("s").over(before), zero).alias("bs"), F.coalesce(F.sum("c").over(before), zero).alias("bc"))
        run = (
            now.withColumn("s", F.sum(size).over(inside)).withColumn("c", F.sum(one).over(inside)).join(carried, ["_batch", "b"])
            .withColumn("s", F.col("bs") + F.col("s")).withColumn("c", F.col("bc") + F.col("c"))
        )
        rest = F.col("left") - F.col("s")
        ends = (F.col("small") & ((rest < F.col("unit")) | (F.col("n") + F.col("c") >= max_files))) | (~F.col("small") & (F.col("_size") <= rest))
        at = F.struct("file_ord", (F.col("s") + F.when(F.col("small"), zero).otherwise(F.col("_size"))).alias("s"), (F.col("c") + 1 - one).alias("c"))
        run = stored(run.select("_batch", "file_ord", "small", ends.alias("ends"), at.alias("at")), f"run-{number}")
        stop = run.groupBy("_batch").agg(F.min(F.when(F.col("ends"), F.col("at"))).alias("stop"))
        fits = (F.col("small") & (F.col("stop").isNull() | (F.col("file_ord") <= F.col("stop.file_ord")))) | (~F.col("small") & (F.col("file_ord") == F.col("stop.file_ord")))
        run.join(stop, "_batch").filter(fits).select("_batch", "file_ord").write.mode("overwrite").parquet(f"{root}/accepted/round={number}")
        more = F.col("open") & F.col("stop").isNotNull()
        count = F.when(more, F.col("n") + F.col("stop.c")).otherwise(F.col("n"))
        state = stored(
            state.join(stop, "_batch", "left").select(
                "_batch", F.when(more, F.col("stop.file_ord")).otherwise(F.col("pos")).alias("pos"),
                F.when(more, F.col("used") + F.col("stop.s")).otherwise(F.col("used")).alias("used"), count.alias("n"), (more & (count < max_files)).alias("open"),
            ),
            f"state-{number}",
        )
    return spark.read.schema(taken_schema).parquet(f"{root}/accepted").select("_batch", "file_ord"), state
