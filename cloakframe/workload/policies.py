"""Column and cell policy queries over customers, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.functions import partial as pm
from cloakframe.functions import text as tx
from cloakframe.operators import policy as p
from cloakframe.workload.registry import query, table


def mid(v: str, pre: int, suf: int) -> str:
    """SQL of the keep/mask function."""
    return (
        f"CASE WHEN length({v}) = 0 THEN '' WHEN {pre + suf} >= length({v}) THEN repeat('*', length({v})) "
        f"ELSE left({v}, {pre}) || repeat('*', length({v}) - {pre + suf}) || right({v}, {suf}) END"
    )


# Customers as a sheet: columns 1..5, data row n = c_custkey + 1.
CUST_COLS = ["c_custkey", "c_name", "c_mktsegment", "c_nationkey", "email"]
MAIL = "lower(c_mktsegment) || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '@mail' || c_nationkey || '.example' END"
CELLS_SQL = f"""SELECT c_custkey + 2 AS "row", unnest([1, 2, 3, 4, 5]) AS col,
    unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR), {MAIL}]) AS v FROM customer"""
POLICY = [
    # rule_ord, sheet, col_index (0-based), header_text, strategy, replacement
    (1, "customers", 1, "C_Name", "PHONE_MID4", None),
    (2, "customers", 9, " c mktsegment ", "FULL_MASK", "[SEGMENT]"),
    (3, "customers", 4, "email", "EMAIL_USER_MASK", None),
    (4, "customers", 4, "", "CLEAR_COL", None),
    (5, "customers", 0, "c_name", "DEFAULT_VALUE", None),
    (6, "customers", 3, "no such header", "BANKCARD_LAST4", None),
    (7, "customers", 40, "nowhere", "FULL_MASK", None),
    (8, "orders", 0, "o_orderkey", "FULL_MASK", None),
]
POLICY_SCHEMA = "rule_ord INT, sheet STRING, col_index INT, header_text STRING, strategy STRING, replacement STRING"
# One override per hundredth customer, on the segment and on the key column.
OVERRIDE_SQL = """SELECT c_custkey + 2 AS "row", CASE WHEN c_custkey % 200 = 0 THEN 3 ELSE 1 END AS col FROM customer WHERE c_custkey % 100 = 0"""
EMAIL_SQL = (
    f"CASE WHEN instr(v, '@') = 0 THEN {mid('v', 1, 1)} WHEN instr(v, '@') <= 3 THEN repeat('*', greatest(instr(v, '@') - 1, 1)) || substr(v, instr(v, '@')) "
    f"ELSE {mid('left(v, instr(v, chr(64)) - 1)', 1, 1)} || substr(v, instr(v, '@')) END"
)
MASKED_SQL = f"""SELECT c."row", c.col, v, CASE WHEN o.col IS NOT NULL THEN 'IDCARD_MID10' WHEN c.col = 2 THEN 'PHONE_MID4'
        WHEN c.col = 3 THEN 'FULL_MASK' WHEN c.col = 5 THEN 'EMAIL_USER_MASK' WHEN c.col = 4 THEN 'BANKCARD_LAST4' END AS strategy,
    CASE WHEN v = '' THEN v WHEN o.col IS NOT NULL THEN {mid('v', 4, 4)} WHEN c.col = 2 THEN {mid('v', 3, 4)} WHEN c.col = 3 THEN '[SEGMENT]'
        WHEN c.col = 5 THEN {EMAIL_SQL} WHEN c.col = 4 THEN {mid('v', 0, 4)} ELSE v END AS masked
    FROM ({CELLS_SQL}) c LEFT JOIN ({OVERRIDE_SQL}) o ON o."row" = c."row" AND o.col = c.col"""


def customer_cells(spark, sf):
    cust = table(spark, sf, "customer").withColumn("email", F.expr(MAIL)).withColumn("n", F.col("c_custkey") + 1)
    return p.table_to_cells(cust, "n", CUST_COLS, sheet="customers")


def bound(spark):
    policy = spark.createDataFrame(POLICY, POLICY_SCHEMA)
    return p.bind_policy(policy, p.headers_of(CUST_COLS, spark, "customers"))


def overrides(spark, sf):
    keys = table(spark, sf, "customer").filter("c_custkey % 100 = 0")
    return keys.select(
        F.lit("customers").alias("sheet"), (F.col("c_custkey") + 2).alias("row"),
        F.when(F.col("c_custkey") % 200 == 0, 3).otherwise(1).alias("col"),
        F.lit("IDCARD_MID10").alias("strategy"), F.lit(None).cast("string").alias("replacement"),
        F.col("c_custkey").cast("int").alias("rule_ord"),
    )


def masked_customer_cells(spark, sf):
    bindings, _ = bound(spark)
    chosen, _ = p.bind_overrides(overrides(spark, sf), bindings)
    return p.mask_cells(customer_cells(spark, sf), bindings, chosen)


@query(
    "mask_customer_columns",
    f"""SELECT c_custkey, {mid('c_name', 3, 4)} AS c_name, c_nationkey, c_acctbal, '[SEGMENT]' AS c_mktsegment FROM customer""",
    covers="P6 P7 P8",
)
def q_columns(spark, sf):
    return p.mask_columns(
        table(spark, sf, "customer"), {"c_name": ("PHONE_MID4", None), "c_mktsegment": ("FULL_MASK", "[SEGMENT]")}
    )


@query(
    "mask_orders_policy",
    f"""SELECT o_orderkey, {mid("o_orderpriority", 0, 4)} AS last4, {mid("o_orderpriority", 4, 4)} AS mid10, '[MASKED]' AS fixed,
    '' AS cleared, {mid("o_orderpriority", 0, 0)} AS unknown_strategy,
    CASE WHEN length(o_orderpriority) <= 5 THEN repeat('#', length(o_orderpriority)) ELSE left(o_orderpriority, 2) || repeat('#', length(o_orderpriority) - 5) || right(o_orderpriority, 3) END AS custom
    FROM orders""",
    covers="P7 P8 P10 P11 E2",
)
def q_orders(spark, sf):
    v = F.col("o_orderpriority")
    s = lambda name: pm.apply_strategy(v, F.lit(name), F.lit(None).cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey", s("BANKCARD_LAST4").alias("last4"), s("IDCARD_MID10").alias("mid10"), s("DEFAULT_VALUE").alias("fixed"),
        s("CLEAR_COL").alias("cleared"), s("SOMETHING_ELSE").alias("unknown_strategy"),
        pm.configurable_mask(v, pattern=".*", replacement="x", keep_prefix=2, keep_suffix=3, mask_char="#").alias("custom"),
    )


@query(
    "partial_mask_functions",
    f"""SELECT c_custkey, left(c_name, 1) || repeat('*', length(c_name) - 1) AS name, left(c_name, 3) || '****' || right(c_name, 4) AS phone,
    left(c_name, 6) || repeat('*', length(c_name) - 10) || right(c_name, 4) AS id_card,
    left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) AS bank_card,
    left(c_name, 1) || repeat('*', length(c_name) - 3) || right(c_name, 2) AS passport,
    CASE WHEN instr(m, '@') = 0 THEN '***EMAIL***' ELSE left(m, 1) || '***' || substr(m, instr(m, '@')) END AS email,
    {EMAIL_SQL.replace('(v', '(m').replace('left(v', 'left(m').replace('right(v', 'right(m').replace('substr(v', 'substr(m')} AS email_user,
    (c_custkey % 256) || '.' || (c_nationkey) || '.*.*' AS ip
    FROM (SELECT *, {MAIL} AS m FROM customer)""",
    covers="A12 A13 A14 A15 A16 A17 A18 P9 E3",
)
def q_partial(spark, sf):
    """The masks by their SQL names."""
    pm.register_functions(spark)
    cust = table(spark, sf, "customer").withColumn("m", F.expr(MAIL))
    return cust.selectExpr(
        "c_custkey", "mask_name(c_name) AS name", "mask_phone(c_name) AS phone", "mask_id_card(c_name) AS id_card",
        "mask_bank_card(c_name) AS bank_card", "mask_passport(c_name) AS passport", "mask_email(m) AS email",
        "mask_email_user(m) AS email_user",
        "mask_ipv4(concat(c_custkey % 256, '.', c_nationkey, '.7.9')) AS ip",
    )


@query(
    "partial_mask_dispatch",
    """SELECT rule_id, count(*) AS n, count(DISTINCT masked) AS distinct_masked FROM (
        SELECT CASE c_custkey % 4 WHEN 0 THEN 'phone_ner' WHEN 1 THEN 'name_ner' WHEN 2 THEN 'sensitive_term_x' ELSE 'passport' END AS rule_id,
        CASE c_custkey % 4 WHEN 0 THEN left(c_name, 3) || '****' || right(c_name, 4) WHEN 1 THEN left(c_name, 1) || repeat('*', length(c_name) - 1)
        WHEN 2 THEN '[T]' ELSE left(c_name, 1) || repeat('*', length(c_name) - 3) || right(c_name, 2) END AS masked FROM customer) GROUP BY rule_id""",
    covers="A19",
)
def q_dispatch(spark, sf):
    rule = F.get(F.lit(["phone_ner", "name_ner", "sensitive_term_x", "passport"]), (F.col("c_custkey") % 4).cast("int"))
    cust = table(spark, sf, "customer").select(rule.alias("rule_id"), "c_name")
    masked = cust.withColumn("masked", pm.partial_mask(F.col("rule_id"), F.col("c_name"), F.lit("[T]")))
    return masked.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("masked").alias("distinct_masked"))


@query("mask_cells_policy", f'SELECT "row", col, strategy, masked FROM ({MASKED_SQL}) WHERE v <> \'\'', covers="P3 P5 P6 J6")
def q_cells(spark, sf):
    return masked_customer_cells(spark, sf).select("row", "col", "strategy", "masked")


@query(
    "policy_bindings",
    """SELECT s AS sheet, c AS col, r AS rule_ord, t AS strategy, n_rows FROM (VALUES
        ('customers', 2, 1, 'PHONE_MID4'), ('customers', 3, 2, 'FULL_MASK'), ('customers', 4, 6, 'BANKCARD_LAST4'), ('customers', 5, 3, 'EMAIL_USER_MASK')) AS b(s, c, r, t),
        (SELECT count(*) AS n_rows FROM customer)""",
    covers="P2 P3",
)
def q_bindings(spark, sf):
    bindings, _ = bound(spark)
    rows = customer_cells(spark, sf).groupBy("sheet", "col").agg(F.count("*").alias("n_rows"))
    return bindings.join(rows, ["sheet", "col"]).select("sheet", "col", "rule_ord", "strategy", "n_rows")


@query(
    "policy_conflicts",
    f"""SELECT r AS rule_ord, c AS conflict, sev AS severity FROM (VALUES (4, 'DUPLICATE_COLUMN', 'error'), (5, 'INDEX_HEADER_MISMATCH', 'error'),
        (7, 'NO_COLUMN', 'error'), (8, 'UNKNOWN_SHEET', 'error')) AS x(r, c, sev)
    UNION ALL SELECT CAST("row" - 2 AS INTEGER), 'OVERRIDE_ON_BOUND_COLUMN', 'warning' FROM ({OVERRIDE_SQL}) WHERE col IN (2, 3, 4, 5)""",
    covers="P3 P4 P5",
)
def q_conflicts(spark, sf):
    bindings, conflicts = bound(spark)
    _, more = p.bind_overrides(overrides(spark, sf), bindings)
    return conflicts.unionByName(more).select("rule_ord", "conflict", "severity")


@query(
    "cell_mapping",
    f"""SELECT substr('ABCDE', col, 1) || "row" AS cell_ref, sha256(v) AS original_sha256, left(v, 8) AS original_preview, masked,
    strategy AS strategy_id, col AS col_index, "row" AS row_index FROM ({MASKED_SQL}) WHERE masked <> v""",
    covers="P13 P14 V4",
)
def q_cell_mapping(spark, sf):
    return p.cell_mapping(masked_customer_cells(spark, sf)).drop("sheet", "workbook")


@query("policy_preview", f'SELECT "row", col, v AS value, masked FROM ({MASKED_SQL}) WHERE "row" BETWEEN 2 AND 21', covers="P12 W4")
def q_preview(spark, sf):
    return p.policy_preview(masked_customer_cells(spark, sf)).select("row", "col", "value", "masked")


@query(
    "coverage_report",
    f"""SELECT count(*) FILTER (WHERE masked <> v) AS hits, count(*) AS covered_cells, count(*) FILTER (WHERE masked <> v) / count(*) AS coverage_ratio,
    4 + (SELECT count(*) FROM ({OVERRIDE_SQL}) WHERE col = 3) AS conflicts FROM ({MASKED_SQL}) WHERE v <> ''""",
    covers="P16",
)
def q_coverage(spark, sf):
    bindings, conflicts = bound(spark)
    chosen, more = p.bind_overrides(overrides(spark, sf), bindings)
    cells = p.mask_cells(customer_cells(spark, sf), bindings, chosen)
    all_conflicts = conflicts.unionByName(more).withColumn("sheet", F.lit("customers"))
    return p.coverage_report(cells, all_conflicts).drop("sheet", "workbook")


@query(
    "strategy_summary",
    f"""SELECT strategy, count(*) AS entity_count FROM ({MASKED_SQL}) WHERE masked <> v GROUP BY ROLLUP (strategy)
    UNION ALL SELECT NULL, count(*) FROM ({MASKED_SQL}) WHERE masked <> v""",
    covers="P17",
)
def q_summary(spark, sf):
    return p.strategy_summary(masked_customer_cells(spark, sf), totals=True).select("strategy", "entity_count")


@query(
    "table_profile",
    f"""SELECT col, h AS header, samples, max_row, 5 AS max_col FROM (
        SELECT col, string_agg(v, '|' ORDER BY "row") FILTER (WHERE "row" BETWEEN 2 AND 6) AS samples, max("row") AS max_row FROM ({CELLS_SQL}) GROUP BY col)
        JOIN (VALUES (1, 'c_custkey'), (2, 'c_name'), (3, 'c_mktsegment'), (4, 'c_nationkey'), (5, 'email')) AS t(c, h) ON c = col""",
    covers="P1 W4",
)
def q_profile(spark, sf):
    headers = p.headers_of(CUST_COLS, spark, "customers")
    profile = p.table_profile(customer_cells(spark, sf), headers).drop("workbook", "sheet")
    return profile.withColumn("samples", F.array_join("samples", "|"))


@query(
    "range_overrides",
    """SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, arg_max(s, o) AS strategy FROM (
        SELECT unnest(range(2 + n_nationkey * 10, 5 + n_nationkey * 10)) AS r, n_nationkey AS o, 'FULL_MASK' AS s FROM nation) x,
        (SELECT unnest(range(1, 4)) AS c) GROUP BY r, c""",
    covers="P15 P20",
)
def q_ranges(spark, sf):
    ranges = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("rule_ord"), F.lit("customers").alias("sheet"),
        F.concat(F.lit("customers!$A$"), (F.col("n_nationkey") * 10 + 2).cast("string"), F.lit(":C"), (F.col("n_nationkey") * 10 + 4).cast("string")).alias("range"),
        F.lit("FULL_MASK").alias("strategy"), F.lit(None).cast("string").alias("replacement"),
    )
    return p.expand_ranges(ranges).select("row", "col", "strategy")


@query(
    "a1_roundtrip",
    """SELECT l_orderkey, l_linenumber, CASE WHEN (l_partkey * 37) % 16384 + 1 <= 26 THEN '' WHEN (l_partkey * 37) % 16384 + 1 <= 702 THEN chr(CAST(65 + ((l_partkey * 37) % 16384 + 1 - 27) // 26 AS INT))
        ELSE chr(CAST(65 + ((l_partkey * 37) % 16384 + 1 - 703) // 676 AS INT)) || chr(CAST(65 + (((l_partkey * 37) % 16384 + 1 - 27) // 26) % 26 AS INT)) END
        || chr(CAST(65 + ((l_partkey * 37) % 16384) % 26 AS INT)) || l_orderkey AS ref,
    CASE WHEN l_orderkey BETWEEN 1 AND 1048576 THEN l_orderkey END AS "row", CASE WHEN l_orderkey BETWEEN 1 AND 1048576 THEN (l_partkey * 37) % 16384 + 1 END AS col FROM lineitem""",
    covers="P14 P15",
)
def q_a1(spark, sf):
    ref = tx.a1_encode(F.col("l_orderkey"), (F.col("l_partkey") * 37) % 16384 + 1)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ref.alias("ref"))
    cell = tx.a1_decode(F.concat(F.lit("'My Sheet'!$"), F.col("ref")), F.lit("My Sheet"))
    return rows.withColumn("c", cell).select("l_orderkey", "l_linenumber", "ref", F.col("c.row").cast("bigint").alias("row"), F.col("c.col").cast("bigint").alias("col"))


@query(
    "verify_restored_cells",
    f"""SELECT "row", col, "row" % 9 <> 0 AS verified FROM ({MASKED_SQL}) WHERE masked <> v""",
    covers="R9",
)
def q_verify_cells(spark, sf):
    from cloakframe.operators.restore import verify_cells

    mapping = p.cell_mapping(masked_customer_cells(spark, sf))
    restored = customer_cells(spark, sf).withColumn(
        "value", F.when(F.col("row") % 9 == 0, F.concat("value", F.lit("?"))).otherwise(F.col("value"))
    )
    return verify_cells(restored, mapping).select("row", "col", "verified")


@query(
    "policy_template",
    """SELECT 8 * count(*) AS rules, 16 AS id_length FROM customer""",
    covers="P19",
)
def q_template(spark, sf):
    """Template id of the policy, counted over the rows it would be applied to."""
    template = p.policy_template(spark.createDataFrame(POLICY, POLICY_SCHEMA))
    n = table(spark, sf, "customer").agg(F.count("*").alias("n"))
    rules = F.size(F.from_json("policy_json", "array<struct<rule_ord:int>>"))
    return template.crossJoin(n).select((rules * F.col("n")).alias("rules"), F.char_length("template_id").alias("id_length"))


@query(
    "policy_templates",
    """WITH r AS (SELECT DISTINCT c_custkey % 100 AS policy_id, c_mktsegment AS seg, c_nationkey % 2 AS nat FROM customer),
    p AS (SELECT policy_id, '[' || string_agg('{"rule_ord":' || (ascii(seg) * 2 + nat) || ',"sheet":"' || seg || '","col_index":' || (policy_id % 4) || ',"header_text":"' || lower(seg)
        || '","strategy":"' || CASE WHEN nat = 0 THEN 'PHONE_MID4"' ELSE 'DEFAULT_VALUE","replacement":"' || policy_id % 3 || '"' END || '}', ',' ORDER BY ascii(seg) * 2 + nat) || ']' AS j, count(*) AS n_rules FROM r GROUP BY 1)
    SELECT policy_id, n_rules, left(sha256(j), 16) AS template_id, j AS policy_json FROM p""",
    covers="P19",
)
def q_templates(spark, sf):
    """A policy for each hundredth of the customers: a rule for each segment and half of the nations met there."""
    rules = table(spark, sf, "customer").select((F.col("c_custkey") % 100).alias("policy_id"), F.col("c_mktsegment").alias("seg"), (F.col("c_nationkey") % 2).alias("nat")).distinct()
    number = F.col("policy_id").cast("int")
    policies = rules.select(
        "policy_id", (F.ascii("seg") * 2 + F.col("nat")).cast("int").alias("rule_ord"), F.col("seg").alias("sheet"), (number % 4).alias("col_index"),
        F.lower("seg").alias("header_text"), F.when(F.col("nat") == 0, "PHONE_MID4").otherwise("DEFAULT_VALUE").alias("strategy"),
        F.when(F.col("nat") != 0, (number % 3).cast("string")).alias("replacement"),
    )
    return p.policy_templates(policies)


@query(
    "output_stems",
    """SELECT page_id, CASE WHEN s = '' THEN 'excel-file' ELSE s END || '-' || left(sha256(html), 8) || '-' || left('job' || page_id || '000000000', 8) AS stem FROM (
        SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', ''), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s0, lower(s0) AS s FROM pages)""",
    covers="P18 V1",
)
def q_stems(spark, sf):
    pages = table(spark, sf, "pages")
    stem = tx.ascii_stem(tx.base_name(F.col("url")), F.col("html"), F.concat(F.lit("job"), F.col("page_id").cast("string"), F.lit("000000000")))
    return pages.select("page_id", stem.alias("stem"))
