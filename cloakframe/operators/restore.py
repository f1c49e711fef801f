"""Restoring masked text from mappings, and the checks around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.hof import let, lookup
from cloakframe.functions.text import clean_display_name, file_extension, file_stem
from cloakframe.operators.finding_sweep import swept_originals

# Placeholders as written by numbered rules and findings.
PLACEHOLDER = r"\*\*\*[A-Z]+\*\*\*[0-9]+|\*\*\*[A-Z]+[0-9]+\*\*\*|姓名[0-9]+"


def _one_pass(text: Column, mapping: Column) -> Column:
    """Read all placeholders at once and look each up: O(n log n) in the row."""
    table = F.sort_array(
        F.transform(mapping, lambda m: F.struct(m["masked"].alias("masked"), m["original"].alias("original")))
    )

    def resolve(tb: Column, p: Column) -> Column:
        """Original of the longest known beginning, and what follows it."""
        stem = F.char_length(F.regexp_replace(p, "[0-9]+$", ""))
        cuts = F.sequence(F.char_length(p), F.least(stem + 1, F.char_length(p)), F.lit(-1))
        tried = F.transform(
            cuts,
            lambda c: F.struct(
                lookup(tb, F.left(p, c), "masked", "original").alias("o"), F.substring(p, c + 1, F.char_length(p)).alias("rest")
            ),
        )
        exact = lookup(tb, p, "masked", "original")
        return let(
            exact,
            lambda e: F.when(e.isNotNull(), F.struct(e.alias("o"), F.lit("").alias("rest"))).otherwise(
                F.get(F.filter(tried, lambda x: x["o"].isNotNull()), F.lit(0))
            ),
        )

    def build(tb: Column) -> Column:
        tokens = F.transform(
            F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)),
            lambda p: let(
                resolve(tb, p), lambda r: F.struct(F.concat(r["o"], r["rest"]).alias("o"), p.alias("p"))
            ),
        )
        return let(
            tokens,
            lambda ts: F.struct(
                F.array_join(
                    F.zip_with(
                        F.split(text, PLACEHOLDER, -1), ts,
                        lambda gap, t: F.concat(gap, F.coalesce(t["o"], t["p"], F.lit(""))),
                    ),
                    "",
                ).alias("t"),
                F.size(F.filter(ts, lambda t: t["o"].isNotNull())).cast("bigint").alias("n"),
            ),
        )

    return let(table, build)


def restore_column(text: Column, mapping: Column) -> Column:
    """Struct (t, n): restored text and number of replacements.

    Nothing is replaced when two entries share a masked value: which original
    belongs where can't be told. Masked values are replaced longest first (in bytes)
    and what has been put in is not read again. Mappings of placeholders only, whose
    originals could form none, are read with expressions alone; everything else goes
    through one sweep (:func:`swept_originals`), which gives the same where both
    apply. Both are linear in text and mapping, up to a logarithm. ``text`` and
    ``mapping`` should be plain columns.
    """
    plain = F.forall(mapping, lambda m: F.rlike(m["masked"], F.lit(f"^(?:{PLACEHOLDER})$")))
    masked = F.transform(mapping, lambda m: m["masked"])
    unique = F.size(F.array_distinct(masked)) == F.size(mapping)
    inert = ~F.exists(mapping, lambda m: F.rlike(m["original"], F.lit("[*]|姓名")))
    # a text right behind a placeholder must not lengthen or complete another one
    clear = ~F.rlike(text, F.lit(r"[*]{4}|[0-9][*]{3}[A-Z]+[*]{3}[0-9]|[*]{3}[A-Z]+[*]{3}[0-9]+[*]|[0-9]姓名"))
    fast = plain & inert & clear
    none = (F.coalesce(F.size(mapping), F.lit(0)) <= 0) | ~unique
    swept = swept_originals(text, mapping, ~none & ~F.coalesce(fast, F.lit(False)))
    empty = F.struct(text.alias("t"), F.lit(0).cast("bigint").alias("n"))
    return F.when(none, empty).otherwise(F.coalesce(swept, _one_pass(text, mapping)))


def collect_mapping(mapping: DataFrame, id_col: str) -> DataFrame:
    """Long mapping table to one array per document (bounded by that document)."""
    seq = F.col("first_seen") if "first_seen" in mapping.columns else F.lit(0)
    return mapping.groupBy(id_col).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(seq.alias("seq"), "original", "masked", "rule_id"))),
            lambda m: F.struct(m["original"].alias("original"), m["masked"].alias("masked"), m["rule_id"].alias("rule_id")),
        ).alias("mapping")
    )


def restore_documents(masked: DataFrame, mapping: DataFrame | str, id_col: str, masked_col: str = "masked") -> DataFrame:
    """Add ``restored`` and ``n_restored``; a document without any hit, or with an ambiguous mapping, gets ``CMAP_MISMATCH``.

    ``mapping`` is a long table (grouped and joined by document) or the name of
    an array column, which needs no shuffle.
    """
    if isinstance(mapping, DataFrame):
        masked = masked.join(collect_mapping(mapping, id_col), id_col, "left")
        mapping = "mapping"
    done = masked.withColumn("_r", restore_column(F.col(masked_col), F.col(mapping)))
    return (
        done.select("*", F.col("_r.t").alias("restored"), F.col("_r.n").alias("n_restored"))
        .drop("_r")
        .withColumn("error_code", F.when(F.col("n_restored") == 0, "CMAP_MISMATCH"))
    )


def restore_names(names: DataFrame, name_col: str, mapping_col: str) -> DataFrame:
    """Restore the stem of a masked name, keep the extension, clean the result."""
    name = F.col(name_col)
    restored = restore_column(F.col("_stem"), F.col(mapping_col))["t"]
    ext = file_extension(name)
    return (
        names.withColumn("_stem", file_stem(name))
        .withColumn(
            "restored_name",
            clean_display_name(F.when(ext.isNotNull() & (ext != ""), F.concat(restored, F.lit("."), ext)).otherwise(restored)),
        )
        .drop("_stem")
    )


def validate_mappings(mapping: DataFrame, id_col: str, format_tag: str | None = None, version: int | None = None) -> DataFrame:
    """One row per mapping with ``error_code`` NULL or ``CMAP_MISMATCH``.

    Checks format and version (when the columns exist), a non-empty id, at
    least one entry and unique masked values.
    """
    per = mapping.groupBy(id_col, "masked").agg(F.count("*").alias("c"))
    agg = per.groupBy(id_col).agg(
        F.sum("c").alias("n_entries"), F.count("masked").alias("n_masked"), F.sum(F.when(F.col("masked").isNotNull(), F.col("c"))).alias("n_valued")
    )
    bad = F.col(id_col).isNull() | (F.col(id_col).cast("string") == "") | (F.col("n_masked") == 0) | (F.col("n_valued") > F.col("n_masked"))
    if format_tag is not None or version is not None:
        head = mapping.groupBy(id_col).agg(
            F.bool_and((F.col("format") == F.lit(format_tag)) & (F.col("version") == F.lit(version))).alias("_head_ok")
        )
        agg = agg.join(head, id_col, "left")
        bad = bad | ~F.coalesce(F.col("_head_ok"), F.lit(False))
    return agg.select(id_col, "n_entries", F.when(bad, "CMAP_MISMATCH").alias("error_code"))


def check_binding(requests: DataFrame, mappings: DataFrame, request_id: str, artifact_col: str) -> DataFrame:
    """The mapping of a request must carry the requested artifact id."""
    have = mappings.select(F.col(request_id), F.col(artifact_col).alias("_bound"))
    return (
        requests.join(have, request_id, "left")
        .withColumn(
            "error_code",
            F.when(F.col("_bound").isNull(), "CMAP_MISMATCH").when(F.col("_bound") != F.col(artifact_col), "ARTIFACT_ID_MISMATCH"),
        )
        .drop("_bound")
    )


def restore_events(restored: DataFrame, id_col: str, at: Column) -> DataFrame:
    """Outcome rows of restores, in the shape of the audit log."""
    ok = F.col("error_code").isNull()
    return restored.select(
        F.concat(F.lit("restore-"), F.col(id_col).cast("string")).alias("id"),
        F.when(ok, "RestoreSucceeded").otherwise("RestoreFailed").alias("event_type"),
        F.when(ok, "success").otherwise("failed").alias("status"),
        "error_code",
        F.when(ok, F.col("n_restored")).alias("restored_entity_count"),
        at.alias("timestamp"),
    )


def eligible_artifacts(artifacts: DataFrame, files: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """Completed Markdown artifacts that have a mapping."""
    done = files.filter("status = 'Completed'").select(F.col("id").alias("file_id"), "display_name")
    out = artifacts.filter("artifact_kind = 'markdown'").join(done, "file_id")
    return out.join(mappings.select("artifact_id"), out["id"] == mappings["artifact_id"], "left_semi") if mappings is not None else out


def verify_sources(sources: DataFrame, recorded: DataFrame, key: str, content_col: str) -> DataFrame:
    """Accept a source only when its hash equals the recorded one."""
    actual = sources.withColumn("sha256", F.sha2(F.col(content_col).cast("binary"), 256))
    joined = actual.join(recorded.select(key, F.col("sha256").alias("_want")), key, "left")
    return joined.withColumn("accepted", F.coalesce(F.col("sha256") == F.col("_want"), F.lit(False))).drop("_want")


def verify_cells(cells: DataFrame, cell_mapping: DataFrame) -> DataFrame:
    """Restored cells whose hash differs from the mapping entry."""
    book = [c for c in ("workbook",) if c in cells.columns and c in cell_mapping.columns]
    keys = [*book, "sheet", "row", "col"]
    entries = cell_mapping.select(
        *book, "sheet", F.col("row_index").alias("row"), F.col("col_index").alias("col"), "cell_ref", "original_sha256"
    )
    joined = entries.join(cells, keys, "left")
    same = F.sha2(F.col("value").cast("binary"), 256) == F.col("original_sha256")
    return joined.select(*keys, "cell_ref", F.coalesce(same, F.lit(False)).alias("verified"))


def round_trip_audit(source: DataFrame, restored: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents whose restored text differs from the source (hashes are joined, not texts)."""
    want = source.select(id_col, F.sha2(F.col(text_col), 256).alias("_want"))
    have = restored.select(id_col, F.sha2(F.col("restored"), 256).alias("_have"))
    return want.join(have, id_col, "left").filter(~F.col("_want").eqNullSafe(F.col("_have"))).select(id_col)


def round_trip(df: DataFrame, id_col: str, text_col: str, rules) -> DataFrame:
    """Mask and restore in one pass over the rows; ``same`` tells whether the text came back."""
    from cloakframe.operators.mask import mask_documents

    kept = df.withColumn("_source", F.col(text_col))
    wide = mask_documents(kept, id_col, text_col, rules).wide
    return restore_documents(wide, "mapping", id_col).select(
        id_col, "n_restored", "masked_entity_count", F.col("restored").eqNullSafe(F.col("_source")).alias("same")
    )
