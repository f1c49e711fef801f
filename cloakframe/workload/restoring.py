"""Restore queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import restore as r
from cloakframe.plans.rules import default_rules
from cloakframe.workload.mask_sql import mask_ctes
from cloakframe.workload.masking import DOCS, masked_docs
from cloakframe.workload.registry import query, table


@query("restore_roundtrip", "SELECT doc_id, text AS restored FROM documents", covers="R1 R10 L7")
def q_restore(spark, sf):
    out = masked_docs(spark, sf)
    return r.restore_documents(out.wide, "mapping", "doc_id").select("doc_id", "restored")


@query("restore_from_mapping_table", "SELECT doc_id, text AS restored FROM documents", covers="R1 S35")
def q_restore_table(spark, sf):
    out = masked_docs(spark, sf)
    return r.restore_documents(out.masked, out.mapping, "doc_id").select("doc_id", "restored")


@query(
    "restore_outcomes",
    f"""WITH {mask_ctes(DOCS)} SELECT 'restore-' || k AS id, CASE WHEN n > 0 THEN 'RestoreSucceeded' ELSE 'RestoreFailed' END AS event_type,
    CASE WHEN n > 0 THEN 'success' ELSE 'failed' END AS status, CASE WHEN n = 0 THEN 'CMAP_MISMATCH' END AS error_code,
    CASE WHEN n > 0 THEN n END AS restored_entity_count FROM masked""",
    covers="R5 R6",
)
def q_outcomes(spark, sf):
    out = masked_docs(spark, sf)
    done = r.restore_documents(out.wide, "mapping", "doc_id")
    return r.restore_events(done, "doc_id", F.lit("2024-01-31").cast("timestamp")).drop("timestamp")


@query("round_trip_audit", "SELECT count(*) AS documents, count(*) AS unchanged FROM documents", covers="R10")
def q_round_trip(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return r.round_trip(docs, "doc_id", "text", default_rules()).agg(
        F.count("*").alias("documents"), F.count_if("same").alias("unchanged")
    )


@query(
    "mapping_validation",
    """SELECT o_custkey AS artifact_id, count(*) AS n_entries,
    CASE WHEN count(DISTINCT o_orderpriority || (o_orderkey % 3)) < count(*) THEN 'CMAP_MISMATCH' END AS error_code
    FROM orders GROUP BY o_custkey""",
    covers="R3",
)
def q_validate(spark, sf):
    entries = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("artifact_id"),
        F.concat("o_orderpriority", (F.col("o_orderkey") % 3).cast("string")).alias("masked"),
        F.lit("mapping").alias("format"), F.lit(1).alias("version"),
    )
    return r.validate_mappings(entries, "artifact_id", "mapping", 1)


@query(
    "mapping_binding",
    """SELECT o.o_orderkey AS request, CASE WHEN c.c_custkey IS NULL THEN 'CMAP_MISMATCH'
        WHEN c.c_custkey % 7 <> o.o_orderkey % 7 THEN 'ARTIFACT_ID_MISMATCH' END AS error_code
    FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0""",
    covers="R4",
)
def q_binding(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request"), "o_custkey", (F.col("o_orderkey") % 7).alias("artifact_id")
    )
    owners = table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", (F.col("c_custkey") % 7).alias("artifact_id"))
    mappings = orders.select("request", "o_custkey").join(owners, F.col("o_custkey") == F.col("c_custkey")).select("request", "artifact_id")
    return r.check_binding(orders, mappings, "request", "artifact_id").select("request", "error_code")


@query(
    "restore_names",
    """SELECT c_custkey, regexp_replace(regexp_replace(c_name, '[:?"<>|]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') || '.txt' AS restored_name FROM customer""",
    covers="R2",
)
def q_restore_names(spark, sf):
    names = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit("***NAME1***_"), F.substring("c_name", 10, 20), F.lit(".txt")).alias("masked_name"),
        F.array(
            F.struct(
                F.substring("c_name", 1, 9).alias("original"), F.lit("***NAME1***_").alias("masked"), F.lit("name_ner").alias("rule_id")
            )
        ).alias("mapping"),
    )
    return r.restore_names(names, "masked_name", "mapping").select("c_custkey", "restored_name")


@query(
    "verified_sources",
    """SELECT page_id, page_id % 5 <> 0 AS accepted FROM pages""",
    covers="R8",
)
def q_verify_sources(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    recorded = pages.select(
        "page_id", F.sha2(F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("sha256")
    )
    return r.verify_sources(pages, recorded, "page_id", "html").select("page_id", "accepted")


