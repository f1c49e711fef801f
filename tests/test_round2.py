"""Answers on input that the registered queries don't contain."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import cells as cl
from cloakframe.operators import detect as d
from cloakframe.operators import policy as p
from cloakframe.operators import snapshots
from cloakframe.operators.mask import mask_documents
from cloakframe.operators.restore import restore_documents, verify_cells
from cloakframe.plans import lexicon as lx
from cloakframe.plans.rules import Term, activate, default_rules
from cloakframe.sources import crypto as cr
from cloakframe.sources import sinks as s
from cloakframe.streaming.workdir import work_dir

CELLS = "workbook STRING, sheet STRING, row LONG, col INT, value STRING"
POLICY = "rule_ord INT, sheet STRING, col_index INT, header_text STRING, strategy STRING, replacement STRING"


def test_sheets_of_a_workbook_are_masked_apart_and_share_the_counter(spark):
    df = spark.createDataFrame([("w", "A", 2, 1, "13900000001"), ("w", "B", 2, 1, "13900000002"), ("w", "B", 3, 1, "13900000001")], CELLS)
    masked, _ = cl.mask_table_cells(df, activate(["phone"]))
    assert {(r.sheet, r.row): r.masked for r in masked.collect()} == {("A", 2): "***PHONE***1", ("B", 2): "***PHONE***2", ("B", 3): "***PHONE***1"}


def test_cells_refuse_terms_and_wide_rules_keep_marks_out(spark):
    df = spark.createDataFrame([("w", "A", 2, 1, "13900000001,rest")], CELLS)
    with pytest.raises(ValueError):
        cl.mask_table_cells(df, activate(["phone"], terms=[Term("1", "rest", "C")]))
    _, mapping = cl.mask_table_cells(df, activate(["phone"]).add("all", "[^,]+", "***ALL***"))
    assert {r.original for r in mapping.collect()} == {"13900000001", "rest"}


def test_ambiguous_mappings_restore_nothing(spark):
    rows = [(1, "T and T", [("alpha", "T", "x"), ("beta", "T", "x")]), (2, "***PHONE***1 x", [("139", "***PHONE***1", "phone")])]
    df = spark.createDataFrame(rows, "id LONG, masked STRING, mapping ARRAY<STRUCT<original:STRING,masked:STRING,rule_id:STRING>>")
    got = {r.id: (r.restored, r.error_code) for r in restore_documents(df, "mapping", "id").collect()}
    assert got == {1: ("T and T", "CMAP_MISMATCH"), 2: ("139 x", None)}


def test_restorable_is_told_for_many_values(spark):
    text = " ".join(f"139{i:08d}" for i in range(3000))
    out = mask_documents(spark.createDataFrame([(1, text)], "id LONG, text STRING"), "id", "text", default_rules())
    assert out.mapping.filter("restorable").count() == 3000


def test_missing_key_is_a_code_and_keeps_the_row(spark):
    keys = spark.createDataFrame([("mapping", bytes(32))], "domain STRING, key BINARY")
    df = spark.createDataFrame([(i, [("a", "b", "c")]) for i in range(3)], "id LONG, mapping ARRAY<STRUCT<original:STRING,masked:STRING,rule_id:STRING>>")
    none = cr.encrypt_mappings(df, "mapping", "id", F.lit("now"), keys, "other")
    assert [(r.container, r.error_code) for r in none.collect()] == [(None, "KEY_MISSING")] * 3
    with pytest.raises(ValueError):
        cr.check_encrypted(none)
    good = cr.encrypt_mappings(df, "mapping", "id", F.lit("now"), keys).drop("mapping", "error_code")
    assert [r.error_code for r in cr.decrypt_mappings(good, keys, "other").collect()] == ["KEY_MISSING"] * 3
    assert cr.decrypt_mappings(cr.check_encrypted(good.withColumn("error_code", F.lit(None))), keys).filter("error_code IS NULL").count() == 3


def test_workbooks_are_bound_and_verified_apart(spark):
    heads = p.headers_of(["Name", "Id"], spark, "S", "w1").union(p.headers_of(["Id", "Name"], spark, "S", "w2"))
    policy = spark.createDataFrame([(1, "S", 9, "name", "FULL_MASK", None), (2, "gone", 0, "x", "FULL_MASK", None)], POLICY)
    bindings, conflicts = p.bind_policy(policy, heads)
    assert {(r.workbook, r.col) for r in bindings.collect()} == {("w1", 1), ("w2", 2)}
    assert [r.conflict for r in conflicts.collect()] == ["UNKNOWN_SHEET"]
    df = spark.createDataFrame([(w, "S", 2, c, f"{w}{c}") for w in ("w1", "w2") for c in (1, 2)], CELLS)
    over = spark.createDataFrame([("S", 2, 2, "CLEAR_COL", None, 5)], "sheet STRING, row INT, col INT, strategy STRING, replacement STRING, rule_ord INT")
    chosen, more = p.bind_overrides(over, bindings)
    masked = p.mask_cells(df, bindings, chosen)
    assert {(r.workbook, r.col): r.strategy for r in masked.collect()} == {("w1", 1): "FULL_MASK", ("w1", 2): "CLEAR_COL", ("w2", 1): None, ("w2", 2): "CLEAR_COL"}
    assert [(r.workbook, r.conflict) for r in more.collect()] == [("w2", "OVERRIDE_ON_BOUND_COLUMN")]
    assert {r.verified for r in verify_cells(df, p.cell_mapping(masked)).collect()} == {True} and verify_cells(df, p.cell_mapping(masked)).count() == 3
    report = {r.workbook: r.conflicts for r in p.coverage_report(masked, conflicts.withColumn("sheet", F.lit("S")).unionByName(more, allowMissingColumns=True)).collect()}
    assert report == {"w1": 1, "w2": 2}


def test_foreign_marks_do_not_move_offsets(spark):
    df = spark.createDataFrame([(1, "\U000F0000 x 13900000001"), (2, "13900000001 13900000002")], "id INT, text STRING")
    got = {r.id: [e.start for e in r.e] for r in df.select("id", d.digit_windows(F.col("text")).alias("e")).collect()}
    assert got == {1: [7], 2: [0, 12]}


def test_saved_things_stay_what_they_were(spark):
    path = work_dir(spark, "snap")
    terms = lambda word: spark.createDataFrame([(1, word, "C", True)], "id INT, term STRING, category STRING, enabled BOOLEAN")
    snapshots.write_snapshot(terms("first"), "b1", path)
    snapshots.write_snapshot(terms("second"), "b1", path)
    assert [r.term for r in snapshots.read_snapshot(spark, path, "b1").collect()] == ["first"]
    policy = spark.createDataFrame([(1, "S", 9, "name", "FULL_MASK", None)], POLICY)
    where = work_dir(spark, "template")
    for _ in range(2):
        p.write_template(policy, where)
    name = p.policy_template(policy).first().template_id
    assert p.read_template(spark, where, name).count() == 1


def test_a_batch_that_is_written_again_is_not_read_meanwhile(spark):
    path = work_dir(spark, "batch")
    docs = spark.createDataFrame([(1, "13900000001")], "id LONG, text STRING")
    s.write_masked_batch(mask_documents(docs, "id", "text", default_rules()), "b1", path)
    assert s.read_finished(spark, path).count() == 1
    opened = spark.createDataFrame([("b1", 0, 0, "Running")], "batch_id STRING, documents LONG, masked_entity_count LONG, status STRING")
    s._replace(opened, f"{path}/status")
    assert s.read_finished(spark, path).count() == 0


def test_surname_windows_stay_right_beside_each_other(spark):
    rows = [(1, "王小明王小红联系人：" + "填" * 30 + "李四是张三"), (2, "王五王五王五"), (3, "a\U000F0000姓名 王小明 b")]
    df = spark.createDataFrame(rows, "id INT, text STRING")
    for r in df.select("text", d.name_candidates(F.col("text")).alias("e")).collect():
        raw = r.text.encode()
        assert r.e and all(raw[e.start : e.end].decode() == e.text for e in r.e)
        near = {e.start: any(w in r.text[max(0, len(raw[: e.start].decode()) - 20) : len(raw[: e.start].decode())] for w in lx.NAME_CONTEXT_WORDS) for e in r.e}
        assert all((e.confidence > 0.8) == near[e.start] for e in r.e)


def test_guarded_rules_look_at_digit_neighbours(spark):
    df = spark.createDataFrame([(1, "13900000001 x 139000000012 913900000001\n13900000001")], "id LONG, text STRING")
    out = mask_documents(df, "id", "text", activate(["phone"]).guarded()).masked.first().masked
    assert out == "***PHONE***1 x 139000000012 913900000001\n***PHONE***1"


def test_required_rules_are_reported():
    assert activate(["phone", "email"]).missing_required() == ["id_card", "bank_card", "passport", "address"]


def test_estimated_pages_cut_a_text_once(spark):
    from cloakframe.sources.ingest import estimated_pages

    docs = spark.createDataFrame([(1, "a\r\nb\nc\nd\n", 3), (2, "", 3), (3, "one", 1), (4, None, 2), (5, "x\n\n", 2)], "doc_id long, text string, total int")
    paged = estimated_pages(docs, "text", "total")
    assert {r.doc_id: r.pages for r in paged.collect()} == {1: ["a", "b", "c\nd"], 2: [""], 3: ["one"], 4: [None, None], 5: ["x", ""]}
    assert paged._jdf.queryExecution().analyzed().toString().count("split(") == 1
