"""Names, cells, previews and manual edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.functions import text as tx
from cloakframe.operators import cells as c
from cloakframe.operators import detect as d
from cloakframe.operators import edits as e
from cloakframe.operators import names as n
from cloakframe.operators.policy import table_to_cells
from cloakframe.plans import lexicon as lx
from cloakframe.plans.rules import activate
from cloakframe.workload.detection import _ALL_SQL, CARDS_SQL, _lit, cards
from cloakframe.workload.mask_sql import mask_ctes
from cloakframe.workload.registry import query, table

ALL_IDS = [r[0] for r in lx.BUILTIN_RULES]


# A name with a phone, an identity number, a card and a personal name.
_NAME_SQL = """substr('王李张刘陈', CAST(c_custkey % 5 + 1 AS INT), 1) || '伟_' || CAST(13000000000 + c_custkey * 7919 AS STRING)
    || '_110105' || CAST(1950 + c_custkey % 50 AS STRING) || '1112' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || 'X_6222'
    || lpad(CAST(c_custkey AS STRING), 15, '0') || '_合同.docx'"""


@query(
    "mask_names",
    f"""SELECT c_custkey, left(nm, 1) || '*_' || substr(nm, 4, 3) || '****' || substr(nm, 11, 4) || '_' || substr(nm, 16, 6) || '********' || substr(nm, 30, 4)
        || '_6222***********' || right(lpad(CAST(c_custkey AS VARCHAR), 15, '0'), 4) || '_合同.docx' AS masked_name, 4::BIGINT AS masked_count
    FROM (SELECT c_custkey, {_NAME_SQL} AS nm FROM customer)""",
    covers="A9 A10 A11 D16",
)
def q_names(spark, sf):
    names = table(spark, sf, "customer").select("c_custkey", F.expr(_NAME_SQL).alias("name"))
    return n.mask_names(names, "name", activate(ALL_IDS)).select("c_custkey", "masked_name", "masked_count")


@query(
    "clean_names",
    r"""SELECT page_id, CASE WHEN trim(s, ' .') = '' THEN 'upload' ELSE trim(s, ' .') END AS display_name, stem AS output_stem
    FROM (SELECT page_id, regexp_replace(left(regexp_extract(url, '[^/]*$'), 120), '[:?"<>|]', '_', 'g') AS s,
        CASE WHEN page_id % 3 = 0 THEN '_con' ELSE regexp_replace(url, '[:?"<>|/\\]', '_', 'g') END AS stem FROM pages)""",
    covers="A20 A21",
)
def q_clean(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select(
        "page_id", tx.clean_display_name(F.col("url")).alias("display_name"),
        tx.clean_output_stem(F.when(F.col("page_id") % 3 == 0, "con").otherwise(F.col("url"))).alias("output_stem"),
    )


# Conversations as one table: row = conversation, column = turn.
_CONV = "SELECT 'conversations' AS workbook, 'Sheet1' AS sheet, conv_id + 2 AS row, CAST(turn + 1 AS INT) AS col, text AS value FROM {conversations}"
_WORD = ("word", "词", "[A-Z][a-z]{5,}", "***WORD***")
# Row-major order over the whole table: cells become the lines of one text.
_CONV_TEXT = """SELECT 1 AS k0, string_agg(replace(text, chr(10), chr(11)), chr(10) ORDER BY conv_id, turn) AS text FROM conversations"""


def conversation_cells(spark, sf):
    return spark.sql(_CONV, conversations=table(spark, sf, "conversations"))


@query(
    "mask_table_cells",
    f"""WITH {mask_ctes(_CONV_TEXT, "k0", [_WORD])}, l AS (SELECT unnest(string_split(masked, chr(10))) AS m, unnest(range(1, len(string_split(masked, chr(10))) + 1)) AS i FROM masked),
    c AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations)
    SELECT c.conv_id + 2 AS row, CAST(c.turn + 1 AS INTEGER) AS col, replace(l.m, chr(11), chr(10)) AS masked FROM c JOIN l USING (i)""",
    covers="A8",
)
def q_cells(spark, sf):
    rules = activate([]).add("word", _WORD[2], _WORD[3])
    masked, _ = c.mask_table_cells(conversation_cells(spark, sf), rules)
    return masked.select("row", "col", "masked")


@query(
    "table_cell_mapping",
    f"WITH {mask_ctes(_CONV_TEXT, 'k0', [_WORD])} SELECT original, masked, rule_id, n AS n_occurrences FROM fresh",
    covers="A8",
)
def q_cell_map(spark, sf):
    rules = activate([]).add("word", _WORD[2], _WORD[3])
    return c.mask_table_cells(conversation_cells(spark, sf), rules)[1].drop("workbook")


@query(
    "preview_table_cells",
    f"""WITH {mask_ctes(_CONV_TEXT.replace("FROM conversations", "FROM conversations WHERE conv_id < 10"), "k0", [_WORD])} SELECT original, masked, n AS n_occurrences FROM fresh""",
    covers="A22",
)
def q_preview(spark, sf):
    rules = activate([]).add("word", _WORD[2], _WORD[3])
    return c.preview_rows(conversation_cells(spark, sf), rules)[1].select("original", "masked", "n_occurrences")


# Three sheets of customers; a rule finds the names, a library the segments, a finding of the cell every second nation.
_THREE = """SELECT 'w' AS workbook, 'S' || c_custkey % 3 AS sheet, c_custkey + 2 AS row, col, value, CASE WHEN col = 1 AND c_nationkey % 2 = 0 THEN 'nation' || c_nationkey END AS found
    FROM (SELECT c_custkey, c_nationkey, 1 AS col, c_name || ' in nation' || c_nationkey AS value FROM {customer}
    UNION ALL SELECT c_custkey, c_nationkey, 2, 'buys ' || c_mktsegment FROM {customer})"""
_KINDS = [
    ("cust", "客户", "Customer#[0-9]+", "***CUST***"), ("sensitive_term_1", "t", r"\bFURNITURE\b", "[GOODS]"),
    ("sensitive_term_2", "t", r"\bMACHINERY\b", "[GOODS]"), ("chinese_name_ner", "f", r"nation[0-9]?[02468]\b", "姓名"),
]
_KINDS_SQL = f"""WITH cells AS ({_THREE.replace("{customer}", "customer")}), {mask_ctes("SELECT 1 AS k0, string_agg(value, chr(10) ORDER BY sheet, row, col) AS text FROM cells", "k0", _KINDS, const={"sensitive_term_1": "[GOODS]", "sensitive_term_2": "[GOODS]"})}"""


def _three_kinds(spark, sf):
    found = F.when(F.col("found").isNotNull(), F.array(F.struct(F.col("found").alias("text"), F.lit("姓名").alias("entity_type"))))
    cells = spark.sql(_THREE, customer=table(spark, sf, "customer")).withColumn("found", found)
    terms = spark.createDataFrame([(1, "FURNITURE", "GOODS", True), (2, "MACHINERY", "GOODS", True), (3, "BUILDING", "GOODS", False)], "id INT, term STRING, category STRING, enabled BOOLEAN")
    rules = activate(["chinese_name"]).add(_KINDS[0][0], *_KINDS[0][2:])
    return c.mask_table_cells(cells, rules, findings="found", terms=terms)


@query(
    "mask_cells_all_kinds",
    _KINDS_SQL + """, l AS (SELECT unnest(string_split(masked, chr(10))) AS m, unnest(range(1, len(string_split(masked, chr(10))) + 1)) AS i FROM masked),
    n AS (SELECT sheet, row, col, row_number() OVER (ORDER BY sheet, row, col) AS i FROM cells) SELECT sheet, row, col, m AS masked FROM n JOIN l USING (i)""",
    covers="A8",
)
def q_all_kinds(spark, sf):
    """Rules, a library of terms and findings in the cells of three sheets, one counter over all."""
    return _three_kinds(spark, sf)[0].select("sheet", "row", "col", "masked")


@query("cells_all_kinds_mapping", _KINDS_SQL + " SELECT original, masked, rule_id, n AS n_occurrences FROM fresh", covers="A8")
def q_all_kinds_mapping(spark, sf):
    return _three_kinds(spark, sf)[1].drop("workbook")


@query(
    "cell_mode_split",
    f"""SELECT nationkey AS workbook, bool_or(hit) AS uses_findings, count(*) AS cells FROM (SELECT CAST(c_nationkey AS VARCHAR) AS nationkey,
        unnest([regexp_matches(c_name, '[0-9]{{11}}'), c_nationkey % 2 = 0]) AS hit FROM customer) GROUP BY 1""",
    covers="A8",
)
def q_mode(spark, sf):
    cust = table(spark, sf, "customer").withColumn("n", F.col("c_custkey") + 1).withColumn(
        "contact", F.when(F.col("c_nationkey") % 2 == 0, "tel 13900000000 ").otherwise("none")
    )
    cells = table_to_cells(cust, "n", ["c_name", "contact"], workbook=F.col("c_nationkey").cast("string"))
    with_findings, without = c.choose_cell_mode(cells)
    count = lambda df, flag: df.groupBy("workbook").agg(F.lit(flag).alias("uses_findings"), F.count("*").alias("cells"))
    return count(with_findings, True).unionByName(count(without, False))


@query(
    "manual_edit_cells",
    """SELECT o_orderkey, CASE WHEN contains(m, 'O') THEN replace(m, 'O', '#') WHEN contains(o_orderpriority, 'O') THEN replace(o_orderpriority, 'O', '#') ELSE m END AS masked,
    CASE WHEN contains(m, 'O') THEN length(m) - length(replace(m, 'O', '')) ELSE length(o_orderpriority) - length(replace(o_orderpriority, 'O', '')) END AS n_hits
    FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN '***' ELSE o_orderpriority END AS m FROM orders)""",
    covers="A23",
)
def q_edit(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "***").otherwise(F.col("o_orderpriority")).alias("masked"))
    return e.edit_cells(rows, "o_orderpriority", "masked", "O", "#").select("o_orderkey", "masked", "n_hits")


@query(
    "manual_edit_mapping",
    """SELECT c_custkey, CASE WHEN contains(m, 'BUILD') THEN replace(m, 'BUILD', 'x') WHEN contains(c_mktsegment, 'BUILD') THEN replace(c_mktsegment, 'BUILD', 'x') ELSE m END AS masked
    FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN '***SEG***' || c_custkey ELSE 'BUILD-' || c_custkey END AS m FROM customer)""",
    covers="A24",
)
def q_edit_mapping(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("original"),
        F.concat(F.when(F.col("c_custkey") % 2 == 0, "***SEG***").otherwise("BUILD-"), F.col("c_custkey").cast("string")).alias("masked"),
    )
    return e.edit_mapping(rows, "BUILD", "x").select("c_custkey", "masked")


@query(
    "manual_edit_names",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Client***.txt' ELSE CASE WHEN c_mktsegment = 'BUILDING' THEN 'a-xING.txt' ELSE 'a-***NAME1***.txt' END END AS edited_name,
    CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END END::BIGINT AS n_hits FROM customer""",
    covers="A25",
)
def q_edit_names(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, "Client***.txt").otherwise("a-***NAME1***.txt").alias("name"),
        F.array(F.struct(F.col("c_mktsegment").alias("original"), F.lit("***NAME1***").alias("masked"))).alias("mapping"),
    )
    return e.edit_name(rows, "name", "mapping", "BUILD", "x").select("c_custkey", "edited_name", "n_hits")


@query(
    "manual_edit_totals",
    """SELECT 0 AS entry, 'URGENT' AS find, CAST(sum(CASE WHEN contains(o_orderpriority, 'URGENT') THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM orders
    UNION ALL SELECT 1, 'nothing', CAST(sum(0) AS BIGINT) FROM orders UNION ALL SELECT 2, 'HIGH', CAST(sum(CASE WHEN contains(o_orderpriority, 'HIGH') THEN 1 ELSE 0 END) AS BIGINT) FROM orders""",
    covers="A28",
)
def q_edit_many(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.lit("***").alias("masked"))
    return e.edit_many(rows, "o_orderpriority", "masked", [("URGENT", "u"), (" ", "x"), ("nothing", "x"), ("HIGH", "h")])[1]


_DEFAULTS = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in lx.PICK_LIST_DEFAULTS.items())


@query(
    "entity_pick_list",
    f"""SELECT text, arg_max(entity_type, o) AS entity_type, CASE arg_max(entity_type, o) {_DEFAULTS} ELSE '***MASKED***' END AS replacement
    FROM (SELECT *, doc_id * 1000 + CASE entity_type {" ".join(f"WHEN {_lit(k)} THEN {i}" for i, (k, _) in enumerate(lx.DETECTOR_PATTERNS))} END AS o FROM ({_ALL_SQL})) GROUP BY text""",
    covers="A29",
)
def q_pick(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    order = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(lx.DETECTOR_PATTERNS) for x in (k, i)])
    found = d.detect(docs, "doc_id", "text").withColumn("o", F.col("doc_id") * 1000 + F.element_at(order, F.col("entity_type")))
    return e.pick_list(found, "o")


_CARD_RULES = [r for r in lx.BUILTIN_RULES if r[0] in ("phone", "id_card")]
# Cards hold at most one finding that is masked: the labelled name of line one
# and the addressed name of line two are written as two last rules per line.
_CARD_FINDINGS = [*_CARD_RULES, ("label", "", "[王李张刘陈杨黄赵周吴][伟芳娜敏静]明?", "姓名"), ("address", "", "欧阳锋", "姓名")]


@query(
    "mask_cards_with_findings",
    f"WITH {mask_ctes(CARDS_SQL, 'doc_id', _CARD_FINDINGS)} SELECT k AS doc_id, masked, n AS masked_entity_count FROM masked",
    covers="A5 A6 F15",
)
def q_card_findings(spark, sf):
    from cloakframe.operators.mask import mask_documents

    found = cards(spark, sf).withColumn("found", F.transform(d.labelled_names(F.col("text")), lambda x: F.struct(x["text"].alias("text"), x["entity_type"].alias("entity_type"))))
    rules = activate(["phone", "id_card", "chinese_name"])
    return mask_documents(found, "doc_id", "text", rules, findings="found").wide.select("doc_id", "masked", "masked_entity_count")
