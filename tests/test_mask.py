import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.mask import attach_findings, leak_check, mask_documents, mask_fragments
from cloakframe.operators.restore import restore_documents, round_trip
from cloakframe.plans import lexicon as lx
from cloakframe.plans.rules import InvalidRules, Rule, RuleSet, Term, activate, builtin_rules, default_rules, parse_rule_ids
from sequential import mask as sequential

DATA = "/root/testdata/sf0.001"
SIX = [(r[0], r[2], r[3], True) for r in lx.BUILTIN_RULES if r[0] != "chinese_name"]


def masked(spark, texts, rules, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    rows = mask_documents(df, "doc_id", "text", rules, **kw).wide.orderBy("doc_id").collect()
    return [(r.masked, r.masked_entity_count, [(m.original, m.masked, m.rule_id) for m in r.mapping]) for r in rows]


VECTORS = [
    ("13900000000 / 13900000000", ["phone"], "***PHONE***1 / ***PHONE***1", 2, 1),
    ("13900000000 unit.test@example.invalid 110105199901011234", ["phone", "email", "id_card"], "***PHONE***2 ***EMAIL***3 ***IDCARD***1", 3, 3),
    ("项目代号：流程验证\n备注：完成验收", ["chinese_name"], "项目代号：流程验证\n备注：完成验收", 0, 0),
    ("13900000000@qq.com", ["phone", "email"], "***PHONE***1@qq.com", 1, 1),
    ("", ["phone"], "", 0, 0),
]


@pytest.mark.parametrize("text,ids,want,count,distinct", VECTORS)
def test_vectors(spark, text, ids, want, count, distinct):
    assert [(m, c, len(p)) for m, c, p in masked(spark, [text], activate(ids))] == [(want, count, distinct)]


def test_findings_follow_rules_on_each_line(spark):
    df = spark.createDataFrame([(1, "客户姓名：张三\n联系电话：13900000000\n日期 张三")], "doc_id LONG, text STRING")
    found = spark.createDataFrame([(1, "张三", "姓名"), (1, "日期", "日期")], "doc_id LONG, text STRING, entity_type STRING")
    row = mask_documents(df, "doc_id", "text", activate(["chinese_name", "phone"]), findings=found).wide.first()
    assert row.masked == "客户姓名：姓名1\n联系电话：***PHONE***2\n***DATE3*** 姓名1"
    off = mask_documents(df, "doc_id", "text", activate(["phone"]), findings=found).wide.first()
    assert off.masked == "客户姓名：张三\n联系电话：***PHONE***1\n***DATE2*** 张三"
    assert attach_findings(df, found, "doc_id").first()["_findings"][0].text in ("张三", "日期")


def test_terms(spark):
    terms = [Term("1", "CEO", "职位"), Term("2", "a.b*c", "内部代号"), Term("3", "项目甲", "项目"), Term("4", "off", "x", False)]
    rules = activate(["phone"], terms)
    got = masked(spark, ["our CEO said; CEOs elsewhere agree", "code a.b*c here, but not axbyyc", "我项目甲的 off", "13900000000CEO CEO"], rules)
    assert [g[0] for g in got] == [
        "our [职位] said; CEOs elsewhere agree", "code [内部代号] here, but not axbyyc", "我[项目]的 off", "***PHONE***1CEO [职位]",
    ]


def test_terms_in_rule_order_not_by_length(spark):
    rules = activate([], [Term("1", "甲乙", "A"), Term("2", "乙丙丁", "B")])
    assert masked(spark, ["甲乙丙丁 乙丙丁"], rules)[0][0] == "[A]丙丁 [B]"


def test_existing_private_characters_survive(spark):
    text = "x\U000F0000y\U000F0003 13900000000 \U00100001"
    assert masked(spark, [text], default_rules())[0][:2] == ("x\U000F0000y\U000F0003 ***PHONE***1 \U00100001", 1)


def test_wide_and_line_bound_custom_rules(spark):
    rules = RuleSet((Rule("p", "p", r"1[3-9]\d{9}", "***PHONE***"), Rule("rest", "rest", r"id=[^;]+", "<ID>"), Rule("s", "s", r"a\s+b", "<S>")))
    got = masked(spark, ["id=x 13900000000 y; a \n b\na  b"], rules)[0]
    # the second rule cannot swallow the placeholder; the third cannot cross a line
    assert got[0] == "<ID>2***PHONE***1 y; a \n b\n<S>3"


def test_seed_continues(spark):
    df = spark.createDataFrame([(1, "13900000000 13800000000")], "doc_id LONG, text STRING")
    seed = F.array(F.struct(F.lit("13800000000").alias("original"), F.lit("***PHONE***7").alias("masked"), F.lit("phone").alias("rule_id")))
    row = mask_documents(df.withColumn("s", seed).withColumn("c", F.lit(7)), "doc_id", "text", activate(["phone"]), seed="s", seed_counter="c").wide.first()
    assert row.masked == "***PHONE***8 ***PHONE***7"
    assert [(m.original, m.n_occurrences) for m in row.mapping] == [("13800000000", 1), ("13900000000", 1)]


def test_fragment_uses_name_rule(spark):
    df = spark.createDataFrame([(1, "张三丰 13900000000")], "id LONG, v STRING")
    assert mask_fragments(df, "id", "v", builtin_rules()).wide.first().masked == "姓名2 ***PHONE***1"


def test_invalid_pattern_is_reported(spark):
    df = spark.createDataFrame([(1, "13900000000")], "doc_id LONG, text STRING")
    out = mask_documents(df, "doc_id", "text", activate(["phone"]).add("bad", "(", "x"))
    assert out.masked.first().masked == "***PHONE***1"
    assert [r.warning for r in out.warnings.collect()] == ["INVALID_RULE_PATTERN:bad"]


def test_rule_ids():
    assert parse_rule_ids('["phone"]') == ["phone"]
    assert parse_rule_ids("phone, email") == ["phone", "email"]
    for bad in ("", "[]", "phone,nope"):
        with pytest.raises(InvalidRules):
            parse_rule_ids(bad)


def random_texts(n, seed):
    rng = random.Random(seed)
    values = ["13900000000", "13800000001", "a.b@c.de", "x@y.example", "10.0.0.1", "6222021381234567890", "E12345678", "110105199901011234", "word", "CEO", "\n", " ", "-", "Z9"]
    return ["".join(rng.choice(values) + rng.choice(["", " ", "\n", ";"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_random_texts_equal_sequential(spark):
    texts = random_texts(300, 1)
    rules = default_rules().add("word", "[a-z]{4}", "[W]", use_counter=False)
    got = masked(spark, texts, rules)
    want = [sequential(t, [*SIX, ("word", "[a-z]{4}", "[W]", False)]) for t in texts]
    assert got == [(m, c, p) for m, p, c in want]


def test_documents_equal_sequential_and_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    a = {r.doc_id: (r.masked, r.masked_entity_count) for r in mask_documents(docs, "doc_id", "text", default_rules()).wide.collect()}
    b = {r.doc_id: (r.masked, r.masked_entity_count) for r in mask_documents(docs.repartition(7, "text"), "doc_id", "text", default_rules()).wide.collect()}
    want = {r.doc_id: (lambda x: (x[0], x[2]))(sequential(r.text, SIX)) for r in docs.collect()}
    assert a == b == want


def test_term_path_equals_sequential(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("alpha", "beta", "gam") for b in range(40)]
    terms = [Term(str(i), w, f"C{i % 4}") for i, w in enumerate(sorted(words))]
    texts = [" ".join(rng.choice([*words, "other", "alpha", "13900000000"]) for _ in range(80)) for _ in range(40)]
    rules = [*SIX, *[(t.rule_id, rf"\b{t.term}\b", f"[{t.category}]", False) for t in terms]]
    got = masked(spark, texts, default_rules().with_terms(terms))
    assert got == [(m, c, p) for m, p, c in (sequential(t, rules) for t in texts)]


def test_no_shuffle_and_no_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    plan = mask_documents(docs, "doc_id", "text", default_rules()).wide._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan


def test_restore_round_trip_and_leaks(spark):
    texts = [t for t in random_texts(100, 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    spaced = df.withColumn("text", F.regexp_replace("text", r"([0-9@a-zA-Z.]+)", " $1 ;"))
    assert round_trip(spaced, "doc_id", "text", default_rules()).filter("NOT same").count() == 0
    assert leak_check(mask_documents(spaced, "doc_id", "text", default_rules()).wide, "doc_id").count() == 0


def test_restore_longest_first_and_zero_hits(spark):
    m = "array<struct<original:string,masked:string,rule_id:string>>"
    rows = [(1, "***PHONE***1 ***PHONE***10", [("a", "***PHONE***1", "p"), ("b", "***PHONE***10", "p")]), (2, "none", [("a", "***PHONE***1", "p")])]
    out = restore_documents(spark.createDataFrame(rows, f"doc_id LONG, masked STRING, mapping {m}"), "mapping", "doc_id").orderBy("doc_id").collect()
    assert (out[0].restored, out[0].n_restored, out[0].error_code) == ("a b", 2, None)
    assert (out[1].n_restored, out[1].error_code) == (0, "CMAP_MISMATCH")


def test_restore_of_long_mappings_takes_one_pass_with_equal_result(spark):
    n = 200
    mapping = [(f"v{i}x", f"***PHONE***{i}", "p") for i in range(1, n + 1)]
    text = " ".join(f"***PHONE***{i}" for i in range(1, n + 60)) + " ***PHONE***2007 ***EMAIL***1"
    m = "array<struct<original:string,masked:string,rule_id:string>>"
    row = restore_documents(spark.createDataFrame([(1, text, mapping)], f"doc_id LONG, masked STRING, mapping {m}"), "mapping", "doc_id").first()
    want, count = text, 0
    for original, mask_, _ in sorted(mapping, key=lambda e: -len(e[1])):
        count += want.count(mask_)
        want = want.replace(mask_, original)
    assert (row.restored, row.n_restored) == (want, count)
