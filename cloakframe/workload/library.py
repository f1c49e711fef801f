"""Term library queries: terms come from the benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import terms as t
from cloakframe.operators.mask import mask_documents
from cloakframe.operators.snapshots import freeze_snapshot
from cloakframe.plans import lexicon as lx
from cloakframe.plans.rules import activate, default_rules, rule_catalogue, validate_rule_requests
from cloakframe.streaming.workdir import work_dir
from cloakframe.workload.mask_sql import mask_ctes
from cloakframe.workload.registry import query, table

_TERMS = """SELECT CAST(min(item_id) AS STRING) AS id, term, 'C' || (min(item_id) % 5) AS category, 'from ' || min(item_id) AS description,
    min(item_id) % 4 <> 0 AS enabled, min(item_id) AS created_at, min(item_id) AS updated_at
    FROM (SELECT item_id, {extract} AS term FROM {benchmark}) WHERE term <> '' GROUP BY term"""
TERMS_SQL = "WITH terms AS (" + _TERMS.replace("{extract}", "regexp_extract(text, '[A-Za-z]{5,}')").replace("{benchmark}", "benchmark") + ") "


def library(spark, sf):
    sql = _TERMS.replace("{extract}", "regexp_extract(text, '[A-Za-z]{{5,}}', 0)")
    return spark.sql(sql, benchmark=table(spark, sf, "benchmark"))


@query("terms_stats", TERMS_SQL + "SELECT count(*) AS total, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE NOT enabled) AS disabled, count(DISTINCT category) AS categories FROM terms", covers="T15 G8")
def q_stats(spark, sf):
    return t.term_statistics(library(spark, sf))


@query("terms_search", TERMS_SQL + "SELECT id, term FROM terms WHERE (contains(term, 'th') OR contains(category, 'th')) AND enabled", covers="T12")
def q_search(spark, sf):
    return t.search_terms(library(spark, sf), "th", enabled_only=True).select("id", "term")


@query("terms_search_desktop", TERMS_SQL + "SELECT id, term FROM terms WHERE term LIKE '%t_e%' OR description LIKE '%t_e%'", covers="T13")
def q_desktop(spark, sf):
    return t.search_terms_desktop(library(spark, sf), "t_e").select("id", "term")


@query("terms_page", TERMS_SQL + "SELECT id, term FROM terms WHERE category = 'C1' ORDER BY created_at DESC, id LIMIT 3 OFFSET 3", covers="T18")
def q_page(spark, sf):
    return t.term_page(library(spark, sf), 2, 3, category="C1").select("id", "term")


@query("terms_page_dictionary", TERMS_SQL + "SELECT id, term FROM (SELECT *, row_number() OVER (ORDER BY lower(term), id) AS i FROM terms WHERE contains(term, 'e')) WHERE i BETWEEN 6 AND 10", covers="T18")
def q_page_zh(spark, sf):
    return t.term_page(library(spark, sf), 2, 5, text="e", dictionary_order=True).select("id", "term")


@query("term_categories", TERMS_SQL + "SELECT DISTINCT category FROM terms", covers="T14 U3")
def q_categories(spark, sf):
    return t.categories(library(spark, sf))


@query(
    "terms_create_rejects",
    TERMS_SQL + """, n AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN (SELECT min(term) FROM terms) WHEN 2 THEN repeat('x', 257) ELSE 'new' || o_custkey END AS term FROM orders)
    SELECT id, term, CASE WHEN term = '' THEN 'TERM_REQUIRED' WHEN length(term) > 256 THEN 'TERM_TOO_LONG' ELSE 'TERM_DUPLICATE' END AS error_code FROM n
    WHERE term = '' OR length(term) > 256 OR term IN (SELECT term FROM terms) OR id > (SELECT min(id) FROM n m WHERE m.term = n.term)""",
    covers="T9",
)
def q_create(spark, sf):
    lib = library(spark, sf)
    smallest = lib.agg(F.min("term").alias("smallest"))
    k = F.col("o_orderkey") % 5
    new = table(spark, sf, "orders").crossJoin(F.broadcast(smallest)).select(
        F.col("o_orderkey").alias("id"),
        F.when(k == 0, "  ").when(k == 1, F.col("smallest")).when(k == 2, F.lit("x" * 257)).otherwise(F.concat(F.lit(" new"), F.col("o_custkey").cast("string"))).alias("term"),
        F.lit("C9").alias("category"), F.lit(None).cast("string").alias("description"), F.lit(True).alias("enabled"),
    )
    return t.create_terms(lib, new)[1]


@query(
    "terms_update",
    TERMS_SQL + "SELECT id, term, CASE WHEN enabled THEN category ELSE 'moved' END AS category, CASE WHEN enabled THEN enabled ELSE true END AS enabled FROM terms",
    covers="T10",
)
def q_update(spark, sf):
    lib = library(spark, sf)
    none = F.lit(None).cast("string")
    patch = lib.filter("NOT enabled").select("id", none.alias("term"), F.lit(" moved ").alias("category"), none.alias("description"), F.lit(True).alias("enabled"))
    return t.update_terms(lib, patch, F.lit(0).cast("bigint"))[0].select("id", "term", "category", "enabled")


@query(
    "terms_update_rejects",
    TERMS_SQL + "SELECT id, 'TERM_DUPLICATE' AS error_code FROM terms WHERE term <> (SELECT min(term) FROM terms)",
    covers="T10",
)
def q_update_rejects(spark, sf):
    lib = library(spark, sf)
    smallest = lib.agg(F.min("term").alias("term"))
    none = F.lit(None).cast("string")
    patch = lib.select("id").crossJoin(smallest).select("id", "term", none.alias("category"), none.alias("description"), F.lit(None).cast("boolean").alias("enabled"))
    return t.update_terms(lib, patch, F.lit(0).cast("bigint"))[1]


@query("terms_delete", TERMS_SQL + "SELECT id, term FROM terms WHERE CAST(id AS BIGINT) NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 3 <> 0)", covers="T11")
def q_delete(spark, sf):
    ids = table(spark, sf, "conversations").filter("conv_id % 3 <> 0").select(F.col("conv_id").cast("string").alias("id"))
    return t.delete_terms(library(spark, sf), ids).select("id", "term")


@query(
    "terms_import_rejects",
    TERMS_SQL + """, r AS (SELECT regexp_extract(text, '[A-Za-z]{5,}') AS term FROM documents)
    SELECT term, 'TERM_REQUIRED' AS error_code FROM r WHERE term = ''
    UNION ALL SELECT term, 'DUPLICATE_IN_FILE' FROM r GROUP BY term HAVING count(*) > 1
    UNION ALL SELECT DISTINCT term, 'TERM_DUPLICATE' FROM r WHERE term IN (SELECT term FROM terms)""",
    covers="T16 J8",
)
def q_import(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.regexp_extract("text", "[A-Za-z]{5,}", 0).alias("term"), F.lit("C").alias("category"), F.lit("").alias("description")
    )
    return t.import_rejects(library(spark, sf), rows)


@query(
    "terms_lenient_import",
    """SELECT term, category, description, enabled FROM (SELECT o_orderkey AS term, o_orderpriority AS category, 'd' AS description, o_orderkey % 2 = 0 AS enabled, o_orderkey FROM orders)
    WHERE o_orderkey % 3 <> 0""".replace("o_orderkey AS term", "CAST(o_orderkey AS VARCHAR) AS term"),
    covers="S26",
)
def q_lenient(spark, sf):
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.lit("only one column")).otherwise(
        F.concat_ws(",", "o_orderpriority", k.cast("string"), F.lit(" d "), F.when(k % 2 == 0, "启用").otherwise("禁用"))
    )
    return t.parse_term_lines(table(spark, sf, "orders").select(line.alias("value")))


@query(
    "terms_export",
    TERMS_SQL + """SELECT category AS "分类", term AS "敏感词", description AS "描述", CASE WHEN enabled THEN '启用' ELSE '禁用' END AS "状态" FROM terms""",
    covers="S27",
)
def q_export(spark, sf):
    return t.term_export(library(spark, sf))


@query(
    "terms_snapshot",
    TERMS_SQL + "SELECT batch_id, id, term FROM (SELECT DISTINCT source AS batch_id FROM documents) , terms WHERE enabled AND suffix(batch_id, '1')",
    covers="T17",
)
def q_snapshot(spark, sf):
    batches = table(spark, sf, "documents").select(F.col("source").alias("batch_id")).distinct().withColumn("wants_terms", F.col("batch_id").endswith("1"))
    return freeze_snapshot(library(spark, sf), batches, work_dir(spark, "snapshots")).select("batch_id", "id", "term")


_DEFAULT = [r for r in lx.BUILTIN_RULES if r[0] not in lx.DEFAULT_OFF_RULES]
# The term step for single words: each word of the text left by the rules is
# looked up; words and the text between them are put together again.
_MASKED_SQL = f"""{TERMS_SQL}, {mask_ctes("SELECT doc_id, text FROM documents")},
    marks AS (SELECT k, t FROM t{len(_DEFAULT)}),
    w AS (SELECT k, unnest(regexp_extract_all(t, '[\\pL\\pN\\pM_]+')) AS word, unnest(range(1, len(regexp_extract_all(t, '[\\pL\\pN\\pM_]+')) + 1)) AS i FROM marks),
    n AS (SELECT w.k, count(t.term) AS n FROM w LEFT JOIN terms t ON t.enabled AND t.term = w.word GROUP BY w.k)
    SELECT d.doc_id, coalesce(m.n, 0) + coalesce(n.n, 0) AS masked_entity_count FROM documents d LEFT JOIN masked m ON m.k = d.doc_id LEFT JOIN n ON n.k = d.doc_id"""


@query("terms_masked_counts", _MASKED_SQL, covers="T7 T8")
def q_masked_counts(spark, sf):
    return q_masked(spark, sf).select("doc_id", "masked_entity_count")


_WORDS_SQL = TERMS_SQL + r""", p AS (SELECT doc_id, unnest(string_split_regex(text, '[\pL\pN\pM_]+')) AS gap, unnest(range(1, len(string_split_regex(text, '[\pL\pN\pM_]+')) + 1)) AS i FROM documents),
    w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pN\pM_]+')) AS word, unnest(range(1, len(regexp_extract_all(text, '[\pL\pN\pM_]+')) + 1)) AS i FROM documents)
    SELECT p.doc_id, string_agg(p.gap || CASE WHEN t.term IS NOT NULL THEN '[' || t.category || ']' ELSE coalesce(w.word, '') END, '' ORDER BY p.i) AS masked
    FROM p LEFT JOIN w ON w.doc_id = p.doc_id AND w.i = p.i LEFT JOIN terms t ON t.enabled AND t.term = w.word GROUP BY p.doc_id"""


@query("terms_only_masked_docs", _WORDS_SQL, covers="T7 T8 A2")
def q_terms_only(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mask_documents(docs, "doc_id", "text", activate([]), terms=library(spark, sf)).wide.select("doc_id", "masked")


# Words of the pieces between placeholders are looked up; the rules' numbers do not depend on terms.
_W = "'[\\pL\\pN\\pM_]+'"
TERMS_MASKED_SQL = f"""{TERMS_SQL}, {mask_ctes("SELECT doc_id, text FROM documents")},
    gap AS (SELECT k, part, unnest(string_split_regex(p, {_W})) AS gap, unnest(range(1, len(string_split_regex(p, {_W})) + 1)) AS i FROM part),
    word AS (SELECT k, part, unnest(regexp_extract_all(p, {_W})) AS word, unnest(range(1, len(regexp_extract_all(p, {_W})) + 1)) AS i FROM part),
    piece AS (SELECT g.k, g.part, count(t.term) AS n,
        string_agg(g.gap || CASE WHEN t.term IS NOT NULL THEN '[' || t.category || ']' ELSE coalesce(w.word, '') END, '' ORDER BY g.i) AS p
        FROM gap g LEFT JOIN word w ON w.k = g.k AND w.part = g.part AND w.i = g.i LEFT JOIN terms t ON t.enabled AND t.term = w.word GROUP BY g.k, g.part)
    SELECT p.k AS doc_id, string_agg(p.p || coalesce(l.masked, ''), '' ORDER BY p.part) AS masked, CAST(count(s.original) + sum(p.n) AS BIGINT) AS masked_entity_count
    FROM piece p LEFT JOIN seen s ON s.k = p.k AND s.part = p.part LEFT JOIN lookup l ON l.k = s.k AND l.original = s.original GROUP BY p.k"""


@query("terms_masked_docs", TERMS_MASKED_SQL, covers="T7 T8")
def q_masked(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = mask_documents(docs, "doc_id", "text", default_rules(), terms=library(spark, sf))
    return out.wide.select("doc_id", "masked", "masked_entity_count")


# A library of every word and every pair of neighbours of the passages and conversations, far above 10,000 terms. Single words have five
# letters or more, pairs have shorter words only, so that a pair overlaps pairs alone: of a chain of overlapping pairs one stands if the walk from it to
# smaller and smaller terms, on either side, has an even number of steps.
BIG_SQL = """WITH src AS (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations),
    ws AS (SELECT regexp_extract_all(text, '[\\pL\\pN\\pM_]+') AS ws, string_split_regex(text, '[\\pL\\pN\\pM_]+') AS gaps FROM src),
    one AS (SELECT DISTINCT w AS term FROM (SELECT unnest(ws) AS w FROM ws) WHERE length(w) >= 5),
    two AS (SELECT DISTINCT a || ' ' || b AS term FROM (SELECT unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b, unnest(gaps[2:-2]) AS g FROM ws) WHERE g = ' ' AND length(a) < 5 AND length(b) < 5),
    terms AS (SELECT term, 'C' || (length(term) % 5) AS category FROM (SELECT * FROM one UNION ALL SELECT * FROM two)),
    d AS (SELECT doc_id, regexp_extract_all(text, '[\\pL\\pN\\pM_]+') AS ws, string_split_regex(text, '[\\pL\\pN\\pM_]+') AS gaps FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS w, unnest(gaps[:-2]) AS gap, unnest(range(1, len(ws) + 1)) AS i FROM d),
    p AS (SELECT *, lead(w) OVER o AS w2, lead(gap) OVER o AS g2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    h AS (SELECT p.doc_id, p.i, t.term, t.category FROM p JOIN terms t ON p.g2 = ' ' AND t.term = p.w || ' ' || p.w2),
    n AS (SELECT *, lag(i) OVER o = i - 1 AND lag(term) OVER o <= term AS down_left, lead(i) OVER o = i + 1 AND lead(term) OVER o < term AS down_right FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    k AS (SELECT *, i - max(CASE WHEN coalesce(down_left, false) THEN NULL ELSE i END) OVER (PARTITION BY doc_id ORDER BY i) AS l,
        min(CASE WHEN coalesce(down_right, false) THEN NULL ELSE i END) OVER (PARTITION BY doc_id ORDER BY i DESC) - i AS r FROM n),
    pair AS (SELECT doc_id, i, category FROM k WHERE l % 2 = 0 AND r % 2 = 0),
    x AS (SELECT w.doc_id, w.i, w.gap, w.w, t.category AS c1, a.category AS c2, b.category AS before
        FROM w LEFT JOIN terms t ON t.term = w.w LEFT JOIN pair a ON a.doc_id = w.doc_id AND a.i = w.i LEFT JOIN pair b ON b.doc_id = w.doc_id AND b.i = w.i - 1),
    m AS (SELECT doc_id, string_agg(CASE WHEN before IS NOT NULL THEN '' ELSE gap || CASE WHEN c2 IS NOT NULL THEN '[' || c2 || ']' WHEN c1 IS NOT NULL THEN '[' || c1 || ']' ELSE w END END, '' ORDER BY i) AS t,
        count(c1) + count(c2) AS n FROM x GROUP BY doc_id)
    SELECT d.doc_id, coalesce(m.t, '') || d.gaps[len(d.gaps)] AS masked, coalesce(m.n, 0)::BIGINT AS masked_entity_count FROM d LEFT JOIN m USING (doc_id)"""


def big_library(spark, sf):
    """Words of five letters or more and pairs of shorter neighbours of all passages and conversations."""
    texts = table(spark, sf, "benchmark").select("text").union(table(spark, sf, "conversations").select("text"))
    words = texts.select(F.regexp_extract_all("text", F.lit(r"[\pL\pN\pM_]+"), F.lit(0)).alias("w"), F.split("text", r"[\pL\pN\pM_]+", -1).alias("g"))
    near = words.select(F.inline(F.transform("w", lambda a, i: F.struct(a.alias("a"), F.get("w", i + 1).alias("b"), F.get("g", i + 1).alias("g")))))
    # a word gives one term at most: itself, or with the next
    short = near.selectExpr("CASE WHEN length(a) >= 5 THEN a WHEN g = ' ' AND length(b) < 5 THEN concat(a, ' ', b) END AS term")
    term = short.filter("term IS NOT NULL").distinct()
    return term.select(F.col("term").alias("id"), "term", F.concat(F.lit("C"), F.length("term") % 5).alias("category"), F.lit(True).alias("enabled"))


@query("terms_any_size", BIG_SQL, covers="T7 T8")
def q_any_size(spark, sf):
    """A library of tens of thousands of words and overlapping pairs, joined and not collected."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mask_documents(docs, "doc_id", "text", activate([]), terms=big_library(spark, sf)).wide.select("doc_id", "masked", "masked_entity_count")


@query(
    "terms_hits",
    TERMS_SQL + r"""SELECT t.term, t.category, count(DISTINCT w.doc_id) AS docs, count(*) AS n_occurrences
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pN\pM_]+')) AS term FROM documents) w JOIN terms t ON t.enabled AND t.term = w.term GROUP BY ALL""",
    covers="T8",
)
def q_hits(spark, sf):
    lib = library(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = mask_documents(docs, "doc_id", "text", activate([]), terms=lib)
    hits = out.mapping.withColumn("id", F.regexp_replace("rule_id", "^sensitive_term_", ""))
    return hits.join(lib.select("id", "term", "category"), "id").groupBy("term", "category").agg(
        F.count("*").alias("docs"), F.sum("n_occurrences").alias("n_occurrences")
    )


_KNOWN = ", ".join(f"'{r[0]}'" for r in lx.BUILTIN_RULES)


@query(
    "rule_requests",
    f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'INVALID_RULES' WHEN 2 THEN 'INVALID_RULES' END AS error_code,
    CASE o_orderkey % 4 WHEN 1 THEN 'phone|email' WHEN 3 THEN 'ipv4|sensitive_terms' END AS rule_ids FROM orders""",
    covers="T4",
)
def q_requests(spark, sf):
    spec = F.get(F.lit(["", '["phone","email"]', "phone,bogus", "ipv4, sensitive_terms"]), (F.col("o_orderkey") % 4).cast("int"))
    req = table(spark, sf, "orders").select("o_orderkey", spec.alias("rules"))
    return validate_rule_requests(req).select("o_orderkey", "error_code", F.array_join("rule_ids", "|").alias("rule_ids"))


@query(
    "rule_usage",
    f"""WITH {mask_ctes("SELECT doc_id, text FROM documents")}, c AS (SELECT unnest([{_KNOWN}]) AS id, unnest(range(0, {len(lx.BUILTIN_RULES)})) AS rule_ord)
    SELECT CAST(c.rule_ord AS INTEGER) AS rule_ord, c.id, c.id <> 'chinese_name' AS enabled_by_default, count(f.k) AS distinct_values FROM c LEFT JOIN fresh f ON f.rule_id = c.id GROUP BY ALL""",
    covers="T1 T5",
)
def q_usage(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    used = mask_documents(docs, "doc_id", "text", default_rules()).mapping.groupBy("rule_id").agg(F.count("*").alias("distinct_values"))
    cat = rule_catalogue(spark)
    return cat.join(used, cat["id"] == used["rule_id"], "left").select(
        "rule_ord", "id", "enabled_by_default", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values")
    )
