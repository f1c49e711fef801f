"""Manual find and replace on masked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.hof import count_matches
from cloakframe.functions.text import clean_output_stem, file_extension, file_stem
from cloakframe.plans import lexicon as lx


def edit_cells(df: DataFrame, original: str, masked: str, find: str, replace: str) -> DataFrame:
    """Literal edit per cell: in the masked text, else rebuilt from the original. Adds ``n_hits``."""
    f, r = F.lit(find), F.lit(replace)
    if not find.strip():
        return df.withColumn("n_hits", F.lit(0).cast("bigint"))
    in_masked, in_original = F.contains(F.col(masked), f), F.contains(F.col(original), f)
    return df.withColumns({
        masked: F.when(in_masked, F.replace(F.col(masked), f, r)).when(in_original, F.replace(F.col(original), f, r)).otherwise(F.col(masked)),
        "n_hits": F.when(in_masked, count_matches(F.col(masked), f)).when(in_original, count_matches(F.col(original), f)).otherwise(F.lit(0).cast("bigint")),
    })


def edit_mapping(mapping: DataFrame, find: str, replace: str) -> DataFrame:
    """Masked text holds the search text: edit it; else the edited original becomes the masked text."""
    f, r = F.lit(find), F.lit(replace)
    return mapping.withColumn(
        "masked",
        F.when(F.contains("masked", f), F.replace("masked", f, r))
        .when(F.contains("original", f), F.replace("original", f, r))
        .otherwise(F.col("masked")),
    )


def edit_name(df: DataFrame, name: str, mapping: str, find: str, replace: str) -> DataFrame:
    """Edit a masked name: in its stem, else through the mapping entries that the edit changes."""
    f, r = F.lit(find), F.lit(replace)
    stem, ext = file_stem(F.col(name)), file_extension(F.col(name))

    def through(acc: Column, m: Column) -> Column:
        use = F.contains(m["original"], f) & F.contains(acc["t"], m["masked"])
        edited = F.when(F.contains(m["masked"], f), F.replace(m["masked"], f, r)).otherwise(F.replace(m["original"], f, r))
        return F.when(
            use, F.struct(F.replace(acc["t"], m["masked"], edited).alias("t"), (acc["n"] + count_matches(m["original"], f)).alias("n"))
        ).otherwise(acc)

    direct = F.struct(F.replace(stem, f, r).alias("t"), count_matches(stem, f).alias("n"))
    folded = F.aggregate(F.col(mapping), F.struct(stem.alias("t"), F.lit(0).cast("bigint").alias("n")), through)
    done = df.withColumn("_e", F.when(F.contains(stem, f), direct).otherwise(folded))
    clean = clean_output_stem(F.col("_e.t"))
    return done.withColumns({
        "edited_name": F.when(ext.isNotNull() & (ext != ""), F.concat(clean, F.lit("."), ext)).otherwise(clean),
        "n_hits": F.col("_e.n"),
    }).drop("_e")


def edit_many(df: DataFrame, original: str, masked: str, entries: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Entries in order, blank searches ignored. ``(rows, hits per entry)``."""
    valid = [(f, r) for f, r in entries if f.strip()]
    out = df
    for i, (f, r) in enumerate(valid):
        out = edit_cells(out, original, masked, f, r).withColumnRenamed("n_hits", f"_n{i}")
    counts = out.agg(*[F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(valid))])
    rows = F.array(*[
        F.struct(F.lit(i).alias("entry"), F.lit(f).alias("find"), F.col(f"n{i}").alias("hits")) for i, (f, _) in enumerate(valid)
    ])
    return out.drop(*[f"_n{i}" for i in range(len(valid))]), counts.select(F.inline(rows))


def pick_list(findings: DataFrame, order_col: str) -> DataFrame:
    """Distinct values (the last type wins) with their default replacement."""
    table = F.create_map(*[F.lit(x) for kv in lx.PICK_LIST_DEFAULTS.items() for x in kv])
    last = findings.groupBy("text").agg(F.max_by("entity_type", order_col).alias("entity_type"))
    return last.withColumn("replacement", F.coalesce(F.element_at(table, F.col("entity_type")), F.lit(lx.PICK_LIST_FALLBACK)))
