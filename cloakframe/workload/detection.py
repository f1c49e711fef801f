"""Detection queries over documents, conversations and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import detect as d
from cloakframe.plans import lexicon as lx
from cloakframe.workload.registry import query, table

PAT = dict(lx.DETECTOR_PATTERNS)


def _lit(s):
    return "'" + s.replace("'", "''") + "'"


def _sql_pattern(kind: str) -> str:
    """RE2 knows no look-around: digit neighbours are compared afterwards."""
    return PAT[kind].replace("(?<![0-9])", "").replace("(?![0-9])", "")


def detect_sql(kind: str, source: str = "SELECT doc_id AS k, text FROM documents", key: str = "doc_id") -> str:
    """Findings of one detector with byte offsets, straight from the definition."""
    p = _lit(_sql_pattern(kind))
    guard = ""
    if kind == "手机号":
        guard = "WHERE NOT (suffix(before, '0') OR regexp_matches(before, '[0-9]$') OR regexp_matches(after, '^[0-9]'))"
    return f"""SELECT k AS {key}, m AS text, {_lit(kind)} AS entity_type,
        CAST(strlen(before) AS INTEGER) AS "start", CAST(strlen(before) + strlen(m) AS INTEGER) AS "end"
    FROM (SELECT k, ms[i] AS m,
            list_aggregate(list_concat([''], list_transform(range(1, i), lambda j: gs[j] || ms[j])), 'string_agg', '') || gs[i] AS before,
            gs[i + 1] AS after
          FROM (SELECT k, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gs,
                       unnest(range(1, len(regexp_extract_all(text, {p})) + 1)) AS i
                FROM ({source}))) {guard}"""


# One contact card per customer, so that every entity type occurs.
CARDS = """SELECT c_custkey AS doc_id,
    '客户姓名：' || substr('王李张刘陈杨黄赵周吴', CAST(c_custkey % 10 + 1 AS INT), 1)
    || substr('伟芳娜敏静', CAST(c_custkey % 5 + 1 AS INT), 1) || CASE WHEN c_custkey % 3 = 0 THEN '明' ELSE '' END
    || '，电话 ' || CAST(13000000000 + c_custkey * 7919 AS STRING) || chr(10)
    || CASE WHEN c_custkey % 4 = 0 THEN '欧阳锋先生 ' WHEN c_custkey % 4 = 1 THEN '不知老师 ' ELSE '' END
    || '身份证 110105' || CAST(1950 + c_custkey % 50 AS STRING) || '0' || CAST(1 + c_custkey % 9 AS STRING)
    || '1' || CAST(c_custkey % 10 AS STRING) || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || 'X' || chr(10)
    || '护照 E' || lpad(CAST(c_custkey AS STRING), 8, '0') || ' 生日 ' || CAST(1950 + c_custkey % 50 AS STRING)
    || '年' || CAST(1 + c_custkey % 12 AS STRING) || '月' || CAST(1 + c_custkey % 28 AS STRING) || '日'
    || ' 余额 ¥' || CAST(1 + c_custkey % 900 AS STRING) || ',' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '.50'
    || ' 地址 ' || CASE c_nationkey % 3 WHEN 0 THEN '北京市' WHEN 1 THEN '广东省广州市' ELSE '新疆自治区' END
    || '朝阳区建国路' || CAST(c_custkey % 100 AS STRING) || '号' || chr(10) || c_mktsegment AS text FROM {customer}"""
CARDS_SQL = CARDS.replace("{customer}", "customer")


def cards(spark, sf):
    return spark.sql(CARDS, customer=table(spark, sf, "customer"))


def _register(name: str, kind: str, covers: str) -> None:
    both = f"SELECT doc_id AS k, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM ({CARDS_SQL})"

    @query(name, detect_sql(kind, both), covers=covers)
    def run(spark, sf, kind=kind):
        docs = table(spark, sf, "documents").select("doc_id", "text")
        notes = cards(spark, sf).select((-1 - F.col("doc_id")).alias("doc_id"), "text")
        return d.finding_rows(d.detect(docs.unionByName(notes), "doc_id", "text", kinds=[kind]), "doc_id")


for _name, _kind, _covers in [
    ("detect_id_card", "身份证号", "D2"),
    ("detect_phone_guarded", "手机号", "D3"),
    ("detect_email", "邮箱", "D4"),
    ("detect_ipv4", "IP地址", "D5"),
    ("detect_bank_card", "银行卡号", "D6"),
    ("detect_passport", "护照号", "D7"),
    ("detect_date", "日期", "D8"),
    ("detect_place", "地名", "D9"),
    ("detect_amount", "金额", "D10"),
    ("detect_address", "地址", "D11"),
]:
    _register(_name, _kind, _covers)


_ALL_SQL = " UNION ALL ".join(detect_sql(k) for k, _ in lx.DETECTOR_PATTERNS)


@query("detect_all_offsets", _ALL_SQL, covers="D1 D23")
def q_detect_all(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return d.finding_rows(d.detect(docs, "doc_id", "text"), "doc_id")


_SEARCH_SQL = """SELECT doc_id, substr(text, i, 11) AS text, '手机号' AS entity_type,
    CAST(strlen(substr(text, 1, i - 1)) AS INTEGER) AS "start", CAST(strlen(substr(text, 1, i - 1)) + 11 AS INTEGER) AS "end"
    FROM (SELECT doc_id, text, unnest(range(1, length(text) - 9)) AS i FROM documents WHERE regexp_matches(text, '1[0-9]{10}'))
    WHERE regexp_matches(substr(text, i, 11), '^1[0-9]{10}$')"""


@query("detect_digit_windows", _SEARCH_SQL, covers="D17")
def q_windows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return d.finding_rows(d.detect(docs, "doc_id", "text", detectors=["search"]), "doc_id")


@query(
    "merge_detections",
    f"""WITH f AS (SELECT *, 1.0 AS conf, 'regex' AS src, 0 AS so, row_number() OVER () AS rn FROM ({_ALL_SQL})
        UNION ALL SELECT *, 0.7, 'search', 4, row_number() OVER () FROM ({_SEARCH_SQL})),
    g AS (SELECT doc_id, text, "start", "end", max(conf) AS confidence,
        arg_max(entity_type, conf * 1000 + so * 100 + CASE entity_type {" ".join(f"WHEN {_lit(k)} THEN {i}" for i, (k, _) in enumerate(lx.DETECTOR_PATTERNS))} ELSE 0 END) AS entity_type,
        'union(' || string_agg(src, ',' ORDER BY so, CASE entity_type {" ".join(f"WHEN {_lit(k)} THEN {i}" for i, (k, _) in enumerate(lx.DETECTOR_PATTERNS))} ELSE 0 END) || ')' AS source
        FROM f GROUP BY ALL)
    SELECT doc_id, text, entity_type, "start", "end", CAST(confidence AS FLOAT) AS confidence, source FROM g""",
    covers="D18",
)
def q_merge(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return d.merge_detections(d.detect(docs, "doc_id", "text", detectors=["regex", "ner", "search"]), "doc_id")


@query(
    "detect_customer_rows",
    f"""SELECT DISTINCT k AS c_custkey, text, entity_type FROM (
        {detect_sql("身份证号", "SELECT c_custkey AS k, c_name || ' ' || c_mktsegment || ' ' || CAST(c_custkey * 7919 + 13000000000 AS VARCHAR) AS text FROM customer", "k")}
        UNION ALL {detect_sql("手机号", "SELECT c_custkey AS k, c_name || ' ' || c_mktsegment || ' ' || CAST(c_custkey * 7919 + 13000000000 AS VARCHAR) AS text FROM customer", "k")})""",
    covers="D20",
)
def q_rows(spark, sf):
    cust = table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", (F.col("c_custkey") * 7919 + F.lit(13000000000)).alias("phone")
    )
    return d.detect_rows(cust, "c_custkey", ["c_name", "c_mktsegment", "phone"], kinds=["身份证号", "手机号"]).select(
        "c_custkey", "text", "entity_type"
    )


@query(
    "detect_batch_positions",
    f"""SELECT d.doc_id, count(f.text) AS n_findings FROM documents d LEFT JOIN ({detect_sql("IP地址")}) f USING (doc_id) GROUP BY d.doc_id""",
    covers="D21",
)
def q_batch(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = d.detect(docs, "doc_id", "text", kinds=["IP地址"], keep_empty=True)
    return rows.groupBy("doc_id").agg(F.count("text").alias("n_findings"))


@query(
    "document_classes",
    f"""SELECT doc_id, max(CASE WHEN entity_type IN ({", ".join(_lit(t) for t in lx.C3_ENTITY_TYPES)}) THEN 3 ELSE 2 END) AS class_level,
    CASE max(CASE WHEN entity_type IN ({", ".join(_lit(t) for t in lx.C3_ENTITY_TYPES)}) THEN 3 ELSE 2 END) WHEN 3 THEN 'C3_SENSITIVE' ELSE 'C2_INTERNAL' END AS data_class
    FROM ({_ALL_SQL}) GROUP BY doc_id""",
    covers="D24",
)
def q_classes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return d.document_class(d.detect(docs, "doc_id", "text"), "doc_id")


_ALIASES = {a: k for k, al in lx.ENTITY_ALIASES.items() for a in al}
_RAW = ["email", "电话", "ID", "ip", "公司", "other"]


@query(
    "normalize_types",
    f"""SELECT CASE event_id % 6 {" ".join(f"WHEN {i} THEN {_lit(_ALIASES.get(r, r))}" for i, r in enumerate(_RAW))} END AS entity_type,
    count(*) AS n FROM events GROUP BY 1""",
    covers="D19",
)
def q_types(spark, sf):
    raw = F.get(F.lit(_RAW), (F.col("event_id") % 6).cast("int"))
    ev = table(spark, sf, "events").select(raw.alias("raw"))
    return ev.groupBy(d.normalize_type(F.col("raw")).alias("entity_type")).agg(F.count("*").alias("n"))


# Answers derived from the documents: first e-mail and first IPv4 of each text,
# and one value that does not occur.
_EMAIL, _IP = _lit(_sql_pattern("邮箱").replace(r"\b", "")), _lit(_sql_pattern("IP地址").replace(r"\b", ""))


@query(
    "parse_model_answers",
    f"""WITH a AS (SELECT doc_id, text, regexp_extract(text, {_EMAIL}) AS e, regexp_extract(text, {_IP}) AS ip FROM documents)
    SELECT doc_id, e AS text, '邮箱' AS entity_type, CAST(strlen(substr(text, 1, instr(text, e) - 1)) AS INTEGER) AS "start",
        CAST(strlen(substr(text, 1, instr(text, e) - 1)) + strlen(e) AS INTEGER) AS "end" FROM a WHERE e <> ''
    UNION ALL SELECT doc_id, ip, 'IP地址', CAST(strlen(substr(text, 1, instr(text, ip) - 1)) AS INTEGER),
        CAST(strlen(substr(text, 1, instr(text, ip) - 1)) + strlen(ip) AS INTEGER) FROM a WHERE ip <> ''""",
    covers="D22",
)
def q_answers(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    email = F.regexp_extract("text", _sql_pattern("邮箱").replace(r"\b", ""), 0)
    ip = F.regexp_extract("text", _sql_pattern("IP地址").replace(r"\b", ""), 0)
    answers = docs.select(
        "doc_id",
        F.concat(F.lit("没有更多\nemail|"), email, F.lit("\nIP："), ip, F.lit(",\n姓名|\U0001F600none\n")).alias("answer"),
    )
    return d.finding_rows(d.parse_model_answers(answers, docs, "doc_id", "text"), "doc_id")


@query(
    "judge_model_answers",
    """WITH v AS (SELECT doc_id, text, 1 AS k, left(text, 30) AS value FROM documents UNION ALL SELECT doc_id, text, 2, left(text, 120) FROM documents
        UNION ALL SELECT doc_id, text, 3, 'absent-' || doc_id FROM documents),
    w AS (SELECT doc_id, text, trim(regexp_replace(value, '[^A-Za-z0-9-]+', ' ', 'g')) AS value FROM v)
    SELECT doc_id, value AS text, CASE WHEN strlen(value) > 100 THEN 'VALUE_TOO_LONG' WHEN instr(text, value) = 0 THEN 'NOT_IN_TEXT' END AS reason FROM w WHERE value <> ''""",
    covers="D22",
)
def q_judged(spark, sf):
    """Three values for each document, as a model may give them: one cut from the text, one too long, one that isn't there."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    value = lambda c: F.trim(F.regexp_replace(c, "[^A-Za-z0-9-]+", " "))
    lines = [F.concat(F.lit("name|"), value(x)) for x in (F.left("text", F.lit(30)), F.left("text", F.lit(120)), F.concat(F.lit("absent-"), F.col("doc_id").cast("string")))]
    answers = docs.select("doc_id", F.concat_ws("\n", *lines).alias("answer"))
    return d.judge_model_answers(answers, docs, "doc_id", "text").select("doc_id", "text", "reason")


@query(
    "score_expected_fields",
    f"""WITH f AS (SELECT DISTINCT doc_id, text FROM ({_ALL_SQL})),
    x AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{{11,}}'))) AS text FROM documents)
    SELECT CASE length(x.text) WHEN 11 THEN 'phone' ELSE 'card' END AS category, count(*) AS expected, count(f.text) AS found,
        count(*) FILTER (WHERE length(x.text) = 11) AS required,
        count(f.text) FILTER (WHERE length(x.text) = 11) AS required_found, count(f.text) / count(*) AS recall
    FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.text = x.text GROUP BY 1""",
    covers="D25",
)
def q_score(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    values = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{11,}"), F.lit(0))))
    expected = (
        docs.select("doc_id", values.alias("text"))
        .withColumn("required", F.char_length("text") == 11)
        .withColumn("category", F.when(F.col("required"), "phone").otherwise("card"))
    )
    return d.score_expected(expected, d.detect(docs, "doc_id", "text"), ["doc_id"])


_HAN_NAME = f"""regexp_matches(%s, '^[一-龥]{{2,4}}$') AND (regexp_matches(%s, '^({'|'.join(lx.COMPOUND_SURNAMES)})[一-龥]+$')
    OR regexp_matches(%s, '^[{''.join(lx.COMMON_SURNAMES)}]'))"""


@query(
    "detect_labelled_names",
    f"""WITH c AS ({CARDS_SQL}),
    m AS (SELECT doc_id, unnest(regexp_extract_all(text, {_lit(lx.LABELLED_NAME_PATTERNS[0])}, 1)) AS text FROM c
          UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, {_lit(lx.LABELLED_NAME_PATTERNS[1])}, 1)) FROM c)
    SELECT m.doc_id, m.text, CAST(strlen(substr(c.text, 1, instr(c.text, m.text) - 1)) AS INTEGER) AS "start"
    FROM m JOIN c USING (doc_id) WHERE {_HAN_NAME.replace("%s", "m.text")}""",
    covers="D14 D15",
)
def q_labelled(spark, sf):
    return d.detect(cards(spark, sf), "doc_id", "text", detectors=["label"]).select("doc_id", "text", "start")


_STOP = ", ".join(_lit(w) for w in lx.NAME_STOP_WORDS)
_CTX = " OR ".join(f"contains(near, {_lit(w)})" for w in lx.NAME_CONTEXT_WORDS)


@query(
    "detect_surname_windows",
    f"""WITH c AS ({CARDS_SQL}),
    p AS (SELECT doc_id, text AS doc, unnest(range(0, length(text))) AS i FROM c),
    w AS (SELECT doc_id, doc, i, n, substr(doc, i + 1, n) AS t,
              substr(doc, greatest(i - 20, 0) + 1, i + 20 - greatest(i - 20, 0)) AS near FROM p, (VALUES (2), (3), (4)) AS l(n))
    SELECT doc_id, t AS text, CAST(strlen(substr(doc, 1, i)) AS INTEGER) AS "start", ({_CTX}) AS in_context
    FROM w WHERE length(t) = n AND regexp_matches(t, '^[{''.join(lx.COMMON_SURNAMES)}][一-龥]*$') AND t NOT IN ({_STOP})
        AND (({_CTX}) OR n < 4)""",
    covers="D12 D13",
)
def q_surnames(spark, sf):
    rows = d.detect(cards(spark, sf), "doc_id", "text", detectors=["ner"])
    return rows.select("doc_id", "text", "start", (F.col("confidence") > 0.8).alias("in_context"))
