"""Document masking, seeds, counts and leak checks over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators.blocks import mask_in_blocks
from cloakframe.operators.mask import SEED_TYPE, leak_check, mask_documents, mask_fragments, masked_counts
from cloakframe.plans import lexicon as lx
from cloakframe.plans.rules import activate, default_rules
from cloakframe.workload.mask_sql import mask_ctes
from cloakframe.workload.registry import query, table

DOCS = "SELECT doc_id, text FROM documents"


def masked_docs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mask_documents(docs, "doc_id", "text", default_rules())


@query(
    "mask_documents",
    f"WITH {mask_ctes(DOCS)} SELECT k AS doc_id, masked, n AS masked_entity_count FROM masked",
    covers="T1 T2 A1 A2 A3 W3 E4",
)
def q_mask_documents(spark, sf):
    return masked_docs(spark, sf).wide.select("doc_id", "masked", "masked_entity_count")


@query(
    "mask_mapping",
    f"""WITH {mask_ctes(DOCS)} SELECT k AS doc_id, original, masked, rule_id, first_seen, n AS n_occurrences,
    count(*) OVER (PARTITION BY k, masked) = 1 AS restorable FROM fresh""",
    covers="A1 A3 S35 V11",
)
def q_mask_mapping(spark, sf):
    return masked_docs(spark, sf).mapping.select(
        "doc_id", "original", "masked", "rule_id", F.col("first_seen").cast("bigint").alias("first_seen"),
        F.col("n_occurrences").cast("bigint").alias("n_occurrences"), "restorable",
    )


@query(
    "mask_in_blocks",
    f"WITH {mask_ctes(DOCS)} SELECT k AS doc_id, masked, n AS masked_entity_count FROM masked",
    covers="A1 A2 A3 W3",
)
def q_mask_in_blocks(spark, sf):
    """The same masked texts from blocks of about a thousand characters, numbered over all blocks of a text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mask_in_blocks(docs, "doc_id", "text", default_rules(), block_chars=1_000).masked


@query(
    "mask_in_blocks_mapping",
    f"""WITH {mask_ctes(DOCS)} SELECT k AS doc_id, original, masked, rule_id, first_seen, n AS n_occurrences,
    count(*) OVER (PARTITION BY k, masked) = 1 AS restorable FROM fresh""",
    covers="A1 A3 W3",
)
def q_mask_in_blocks_mapping(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mask_in_blocks(docs, "doc_id", "text", default_rules(), block_chars=1_000).mapping.select(
        "doc_id", "original", "masked", "rule_id", F.col("first_seen").cast("bigint").alias("first_seen"),
        F.col("n_occurrences").cast("bigint").alias("n_occurrences"), "restorable",
    )


@query(
    "mask_counts_by_source",
    f"""WITH {mask_ctes(DOCS)} SELECT d.source, count(*) AS n_docs,
    CAST(coalesce(sum(m.n), 0) AS BIGINT) AS masked_entities, count(*) FILTER (WHERE m.n > 0) AS docs_with_hits
    FROM documents d JOIN masked m ON m.k = d.doc_id GROUP BY d.source""",
    covers="A26 G5",
)
def q_mask_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    wide = mask_documents(docs, "doc_id", "text", default_rules()).wide
    return wide.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("masked_entity_count"), F.lit(0)).alias("masked_entities"),
        F.count_if(F.col("masked_entity_count") > 0).alias("docs_with_hits"),
    )


@query(
    "masked_counts_per_file",
    f"""WITH {mask_ctes(DOCS)} SELECT d.doc_id, CASE WHEN d.doc_id % 10 <> 9 THEN coalesce(m.n, 0) END AS masked_entity_count
    FROM documents d LEFT JOIN masked m ON m.k = d.doc_id""",
    covers="A26",
)
def q_masked_counts_per_file(spark, sf):
    files = table(spark, sf, "documents").select("doc_id")
    return masked_counts(files, masked_docs(spark, sf).summary, "doc_id", F.col("doc_id") % 10 == 9)


# A conversation turn whose session already masked its first capitalised word:
# the seed entry is reused, new values continue after the seed's counter.
_CAP = ("word", "词", "[A-Z][a-z]{3,}", "***WORD***")
_SEED_SQL = """SELECT conv_id * 1000 + turn AS k, regexp_extract(text, '[A-Z][a-z]{3,}') AS original, '***WORD***7' AS masked, 7 AS counter
    FROM conversations WHERE regexp_extract(text, '[A-Z][a-z]{3,}') <> ''"""


@query(
    "mask_conversations_seeded",
    f"""WITH {mask_ctes("SELECT conv_id * 1000 + turn AS k0, text FROM conversations", "k0", [_CAP], seed=_SEED_SQL)}
    SELECT k AS turn_key, masked, n AS masked_entity_count FROM masked""",
    covers="A4 T3 E1",
)
def q_mask_conversations_seeded(spark, sf):
    first = F.regexp_extract("text", _CAP[2], 0)
    seed = F.when(
        first != "",
        F.array(F.struct(first.alias("original"), F.lit("***WORD***7").alias("masked"), F.lit("word").alias("rule_id"))),
    ).otherwise(F.array().cast(SEED_TYPE))
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_key"), "text",
        seed.alias("seed"), F.when(first != "", 7).otherwise(0).alias("counter"),
    )
    rules = activate([]).add("word", _CAP[2], _CAP[3])
    return mask_documents(turns, "turn_key", "text", rules, seed="seed", seed_counter="counter").wide.select(
        "turn_key", "masked", "masked_entity_count"
    )


@query(
    "mask_fragments",
    f"""WITH {mask_ctes("SELECT page_id AS k0, html AS text FROM pages", "k0", lx.BUILTIN_RULES)}
    SELECT k AS page_id, masked, n AS masked_entity_count FROM masked""",
    covers="A7",
)
def q_mask_fragments(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return mask_fragments(pages, "page_id", "html", activate([r[0] for r in lx.BUILTIN_RULES])).wide.select(
        "page_id", "masked", "masked_entity_count"
    )


@query(
    "leak_check",
    f"""WITH {mask_ctes(DOCS)}, {mask_ctes(DOCS, rules=[r for r in lx.BUILTIN_RULES if r[0] == "email"], prefix="e_")}
    SELECT f.k AS doc_id, f.original, f.rule_id FROM fresh f JOIN e_masked m ON m.k = f.k WHERE contains(m.masked, f.original)""",
    covers="A27",
)
def q_leak_check(spark, sf):
    """What stays readable when only the e-mail rule is switched on."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("text").alias("copy"))
    full = mask_documents(docs, "doc_id", "text", default_rules()).wide.select("doc_id", "copy", "mapping")
    partly = mask_documents(full.withColumnRenamed("mapping", "all_values"), "doc_id", "copy", activate(["email"])).wide
    return leak_check(partly, "doc_id", "masked", "all_values")
