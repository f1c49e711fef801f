"""Queries that write through a sink and read the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import terms as t
from cloakframe.operators.mask import mask_documents
from cloakframe.operators.term_match import quote_column
from cloakframe.plans.rules import default_rules, read_rules, write_rules
from cloakframe.sources import ingest as g
from cloakframe.sources import sinks as s
from cloakframe.streaming.workdir import work_dir
from cloakframe.workload.library import TERMS_SQL, library
from cloakframe.workload.mask_sql import mask_ctes
from cloakframe.workload.masking import DOCS, masked_docs
from cloakframe.workload.registry import query, table


@query(
    "csv_write_and_read",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations""",
    covers="S7 S8",
)
def q_csv(spark, sf):
    path = work_dir(spark, "csv")
    s.write_csv(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), path)
    return g.read_csv_table(spark, path)


@query("terms_csv_import", TERMS_SQL + "SELECT term, category, description, enabled FROM terms", covers="S25 S27")
def q_terms_csv(spark, sf):
    path = work_dir(spark, "terms")
    t.write_term_csv(library(spark, sf).coalesce(1), path)
    return t.read_term_csv(spark, path)


@query(
    "rules_from_json",
    f"WITH {mask_ctes(DOCS)} SELECT rule_id, count(*) AS distinct_values, CAST(sum(n) AS BIGINT) AS n FROM fresh GROUP BY rule_id",
    covers="S28",
)
def q_rules(spark, sf):
    path = work_dir(spark, "rules")
    write_rules(default_rules(), spark, path)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    mapping = mask_documents(docs, "doc_id", "text", read_rules(spark, path)).mapping
    return mapping.groupBy("rule_id").agg(F.count("*").alias("distinct_values"), F.sum("n_occurrences").alias("n"))


@query(
    "masked_batch_sink",
    f"""WITH {mask_ctes(DOCS)} SELECT (SELECT count(*) FROM masked) AS documents, (SELECT count(*) FROM fresh) AS mapping_rows,
    (SELECT CAST(sum(n) AS BIGINT) FROM masked) AS masked_entity_count, 'Completed' AS status""",
    covers="S29 S35",
)
def q_sink(spark, sf):
    path = work_dir(spark, "batch")
    s.write_masked_batch(masked_docs(spark, sf), "b1", path)
    docs = s.read_finished(spark, path).agg(F.count("*").alias("documents"))
    rows = s.read_finished(spark, path, "mapping").agg(F.count("*").alias("mapping_rows"))
    status = spark.read.parquet(f"{path}/status").select("masked_entity_count", "status")
    return docs.crossJoin(rows).crossJoin(status)


@query(
    "rule_warnings",
    f"WITH {mask_ctes(DOCS)} SELECT 'INVALID_RULE_PATTERN:broken' AS warning, CAST(sum(n) AS BIGINT) AS masked_entities FROM masked",
    covers="T6",
)
def q_warnings(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = mask_documents(docs, "doc_id", "text", default_rules().add("broken", "([", "x"))
    return out.warnings.crossJoin(out.summary.agg(F.sum("masked_entity_count").alias("masked_entities")))


@query(
    "text_functions",
    r"""SELECT doc_id, length(text) AS n_characters, strlen(text) AS n_bytes, len(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS distinct_words,
    len(regexp_extract_all(text, '\.')) AS dots, regexp_matches(text, '^' || regexp_escape(left(text, 5))) AS quoted_start FROM documents""",
    covers="V2 V3 V10",
)
def q_text(spark, sf):
    docs = table(spark, sf, "documents")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    return docs.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_characters"), F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.size(F.array_distinct(words)).cast("bigint").alias("distinct_words"),
        F.size(F.regexp_extract_all("text", F.lit(r"\."), F.lit(0))).cast("bigint").alias("dots"),
        F.rlike(F.col("text"), F.concat(F.lit("^"), quote_column(F.left("text", F.lit(5))))).alias("quoted_start"),
    )
