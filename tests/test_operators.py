import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import partial as pm
from cloakframe.functions import text as tx
from cloakframe.functions.hof import prefix_sums, sentinel, sentinel_char
from cloakframe.operators import audit as a
from cloakframe.operators import detect as d
from cloakframe.operators import policy as p
from cloakframe.operators import terms as t
from cloakframe.operators.cells import mask_table_cells
from cloakframe.operators.names import mask_names
from cloakframe.plans.rules import Term, activate, builtin_rules
from cloakframe.sources import crypto as cr
from cloakframe.sources import ingest as g
from cloakframe.sources import sinks as s
from cloakframe.streaming.events import expiry_stream, pair_stream, run_to_parquet

ALL_IDS = [r.id for r in builtin_rules().rules]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_helpers(spark):
    assert one(spark, prefix_sums(F.array(*[F.lit(i) for i in range(1, 12)]))) == [sum(range(1, i + 1)) for i in range(1, 12)]
    for rank in (0, 1, 63, 64, 4095, 4096, 65533, 65534, 70000):
        assert one(spark, sentinel(F.lit(rank))) == sentinel_char(rank)


@pytest.mark.parametrize("text", ["913812345678", "138123456789", "0013812345678", "62220213812345678"])
def test_phone_inside_longer_numbers(spark, text):
    df = spark.createDataFrame([(1, text)], "id LONG, text STRING")
    assert d.detect(df, "id", "text", kinds=["手机号"]).count() == 0


def test_phone_beside_han(spark):
    df = spark.createDataFrame([(1, "是13812345678。")], "id LONG, text STRING")
    row = d.detect(df, "id", "text", kinds=["手机号"]).first()
    assert (row.text, row.start, row.end) == ("13812345678", 3, 14)


def test_names(spark):
    names = ["张三_13812345678_11010519491231002X_6222020202020202020_合同.docx", "6222021381234567890.txt", "plain.txt", "欧阳锋_E12345678", "...", "dir/a:b.txt"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id LONG, name STRING")
    got = {r.id: (r.masked_name, r.masked_count) for r in mask_names(df, "name", activate(ALL_IDS, [Term("1", "plain", "分类")])).collect()}
    assert got[0] == ("张*_138****5678_110105********002X_6222***********2020_合同.docx", 4)
    assert got[1] == ("6222***********7890.txt", 1)
    assert got[2] == ("[分类].txt", 1)
    assert got[3] == ("欧**_E******78", 2)
    assert got[4][0] == "upload" and got[5][0] == "a_b.txt"


def test_partial_masks_agree_with_sql(spark):
    pm.register_functions(spark)
    values = ["", "a", "张三", "13812345678", "ab@c.de", "@x", "u@v", "abc@d.e", "10.1.2.3", "1.2", "E12345678", "110105199901011234"]
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    v = F.col("v")
    pairs = [
        (pm.mask_name(v), "mask_name(v)"), (pm.mask_phone(v), "mask_phone(v)"), (pm.mask_id_card(v), "mask_id_card(v)"),
        (pm.mask_bank_card(v), "mask_bank_card(v)"), (pm.mask_passport(v), "mask_passport(v)"), (pm.mask_email(v), "mask_email(v)"),
        (pm.mask_ipv4(v), "mask_ipv4(v)"), (pm.mask_email_user(v), "mask_email_user(v)"), (pm.mask_middle(v, 3, 4), "mask_middle(v, 3, 4)"),
        (pm.keep_mask(v, 2, 1, "#"), "mask_keep(v, 2, 1, '#')"),
    ]
    for row in df.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(pairs)], *[F.expr(e).alias(f"e{i}") for i, (_, e) in enumerate(pairs)]).collect():
        for i in range(len(pairs)):
            assert row[f"c{i}"] == row[f"e{i}"], pairs[i][1]


@pytest.mark.parametrize("ref,want", [("Sheet!$Z$26", (26, 26)), ("XFD1048576", (1048576, 16384)), ("Wrong$A1", None), ("Other!A1", None), ("'Sheet'!b2", (2, 2)), ("A0", None), ("XFE1", None), ("1A", None)])
def test_a1(spark, ref, want):
    got = one(spark, tx.a1_decode(F.lit(ref), F.lit("Sheet")))
    assert (None if got is None else tuple(got)) == want


def test_ambiguous_policy_blocks(spark):
    headers = p.headers_of(["Name", "Name", "Id"], spark, "S")
    policy = spark.createDataFrame([(1, "S", 9, "name", "FULL_MASK", None), (2, "S", 2, "id", "CLEAR_COL", None)], "rule_ord INT, sheet STRING, col_index INT, header_text STRING, strategy STRING, replacement STRING")
    bindings, conflicts = p.bind_policy(policy, headers)
    assert [(r.col, r.strategy) for r in bindings.collect()] == [(3, "CLEAR_COL")]
    assert [r.conflict for r in conflicts.collect()] == ["HEADER_AMBIGUOUS"]
    with pytest.raises(p.BindingAmbiguous):
        p.check_conflicts(conflicts)


def test_table_cells_share_one_counter_over_buckets(spark):
    rows = [("w", "S", r, c, f"13{(r * 7 + c) % 90 + 10:02d}0000000 x") for r in (1, 2, 150_000, 300_000) for c in (1, 2)]
    cells = spark.createDataFrame(rows, "workbook STRING, sheet STRING, row LONG, col INT, value STRING")
    masked, mapping = mask_table_cells(cells, activate(["phone"]))
    seen, want = {}, {}
    for _, _, r, c, v in sorted(rows, key=lambda x: (x[2], x[3])):
        phone = v.split()[0]
        seen.setdefault(phone, f"***PHONE***{len(seen) + 1}")
        want[(r, c)] = seen[phone] + " x"
    assert {(r.row, r.col): r.masked for r in masked.collect()} == want
    assert {r.original: r.masked for r in mapping.collect()} == seen


def _event(i, f, kind, sec):
    return (i, f, kind, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=sec))


ROUNDS = [
    _event(1, 1, "ProcessingStarted", 0), _event(2, 1, "Failed", 2), _event(3, 1, "RetryQueued", 10), _event(4, 1, "ProcessingStarted", 86_399),
    _event(5, 1, "Completed", 86_400), _event(6, 1, "ProcessingStarted", 90_000), _event(7, 1, "RecoveredInterrupted", 99_000),
    _event(8, 1, "ProcessingStarted", 200_000), _event(9, 1, "Completed", 200_003),
]
EVENT = "id LONG, file_id LONG, event_type STRING, created_at TIMESTAMP"


def test_rounds_mean_two_seconds(spark):
    events = spark.createDataFrame(ROUNDS, EVENT)
    pairs = a.processing_pairs(events)
    assert sorted(r.duration_ms for r in pairs.collect()) == [1000, 2000, 3000]
    assert a.mean_processing_ms(pairs).first()[0] == 2000
    assert sorted((r.start_id, r.round) for r in a.retry_rounds(events).collect()) == [(1, 1), (4, 2), (8, 4)]


def _write(spark, rows, schema, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_stream_pairs(spark, tmp_path):
    tail = [_event(99, 2, "Queued", 900_000)]
    stream = _write(spark, ROUNDS + tail, EVENT, tmp_path)
    out = run_to_parquet(pair_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.start_id, r.duration_ms) for r in out.collect()) == [(1, 2000), (4, 1000), (8, 3000)]


def expired_brute(events, start, end, ttl, mark):
    out = []
    for key in {e[1] for e in events}:
        opened = None
        for ms, kind in sorted((int(e[3].timestamp() * 1000), "s" if e[2] in start else "e") for e in events if e[1] == key and e[2] in start + end):
            if ms > mark:
                break
            if opened is not None and ms > opened + ttl:
                out.append((str(key), opened))
                opened = None
            if kind == "s":
                opened = ms if opened is None else opened
            else:
                opened = None
        if opened is not None and mark > opened + ttl:
            out.append((str(key), opened))
    return sorted(out)


def test_stream_expiry_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [_event(i, rng.randint(1, 20), rng.choice(["Queued", "Completed", "Other"]), rng.randint(0, 40_000)) for i in range(300)]
    rows = [(i, f, k, ts.replace(tzinfo=dt.timezone.utc)) for i, f, k, ts in rows]
    stream = _write(spark, rows, EVENT, tmp_path)
    out = run_to_parquet(expiry_stream(stream, "file_id", ["Queued"], ["Completed"], 30), str(tmp_path / "out"), str(tmp_path / "cp"))
    used = [r for r in rows if r[2] != "Other"]
    mark = max(int(r[3].timestamp() * 1000) for r in used) - 60_000
    assert sorted((r.key, r.since_ms) for r in out.collect()) == expired_brute(used, ["Queued"], ["Completed"], 30 * 60_000, mark)


@pytest.mark.parametrize("text,code", [
    ('a,b\n1,"x""y"\n', None), ("a,b\n1\n", "INPUT_CORRUPTED"), ('a,"b\n', "INPUT_CORRUPTED"), ('a,"b"c\n', "INPUT_CORRUPTED"), ("", "INPUT_NO_CONTENT"), ("\n\n", "INPUT_NO_CONTENT"),
    ('"l1\nl2",b\r\nc,d', None),
])
def test_csv(spark, text, code):
    row = g.parse_csv(spark.createDataFrame([(text,)], "text STRING")).first()
    assert row.error_code == code
    if text.startswith('"l1'):
        assert row.rows == [["l1\nl2", "b"], ["c", "d"]]


def test_csv_markdown_escapes(spark):
    df = g.parse_csv(spark.createDataFrame([("a|b,c\\d,e`f\n",)], "text STRING"))
    assert df.select(g.rows_to_markdown(F.col("rows")).alias("m")).first().m.split("\n")[2] == "| a\\|b | c\\\\d | e\\`f |"


def test_decoding(spark):
    rows = [(1, b"ok \xe4\xbd\xa0"), (2, b"\xff\xfe"), (3, b"PK\x03\x04zip"), (4, "你好".encode("gbk"))]
    df = spark.createDataFrame(rows, "id INT, content BINARY")
    assert {r.id: r.error_code for r in g.decode_text(df).collect()} == {1: None, 2: "INPUT_CORRUPTED", 3: "INPUT_CORRUPTED", 4: "INPUT_CORRUPTED"}
    assert {r.id: r.text for r in g.decode_lenient(df).collect()}[4] == "你好"


def test_oversize_documents_are_not_gathered(spark):
    cells = spark.range(30).select((F.col("id") % 2 * 10 + F.when(F.col("id") > 25, 1).otherwise(0)).alias("doc"), "id", F.array(F.col("id").cast("string")).alias("cells"))
    got = g.collect_rows(cells, ["doc"], "id", "cells", part_rows=5).collect()
    assert all(len(r.rows) <= 5 for r in got) and sum(len(r.rows) for r in got) == cells.count()
    assert {r.doc: max(x.part_no for x in got if x.doc == r.doc) > 0 for r in got} == {0: True, 10: True, 1: False, 11: False}


def test_admission_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(b, i, rng.choice(["a.txt", "b.exe", "c.md"]) if rng.random() < 0.3 else f"{i}.txt", rng.choice([5, 50, 90, 200]), rng.randint(0, 2)) for i in range(120) for b in [rng.randint(0, 2)]]
    df = spark.createDataFrame(rows, "batch_id INT, file_ord LONG, name STRING, size_bytes LONG, mtime INT")
    want = {}
    for b in range(3):
        keys, n, used = set(), 0, 0
        for _, i, name, size, mtime in [r for r in rows if r[0] == b]:
            key = (name, size, mtime)
            if key in keys:
                want[(b, i)] = "DUPLICATE"
            elif name.endswith(".exe"):
                want[(b, i)] = "UNSUPPORTED"
                keys.add(key)
            elif n >= 12:
                want[(b, i)] = "COUNT_LIMIT"
                keys.add(key)
            elif size > 100:
                want[(b, i)] = "FILE_TOO_LARGE"
                keys.add(key)
            elif used + size > 700:
                want[(b, i)] = "BATCH_TOO_LARGE"
                keys.add(key)
            else:
                want[(b, i)] = "ACCEPTED"
                n, used = n + 1, used + size
                keys.add(key)
    got = {(r.batch_id, r.file_ord): r.reason for r in g.admit_files(df, 12, 100, 700).collect()}
    assert got == want


def test_encrypted_mapping(spark):
    keys = spark.createDataFrame([("mapping", bytes(32)), ("cells", bytes(range(32)))], "domain STRING, key BINARY")
    m = "array<struct<original:string,masked:string,rule_id:string>>"
    df = spark.createDataFrame([("a1", [("张三", "姓名1", "n")])], f"id STRING, mapping {m}")
    enc = cr.encrypt_mappings(df, "mapping", "id", F.lit("now"), keys).drop("mapping")
    first, second = enc.first().container, enc.first().container
    assert first != second
    stored = spark.createDataFrame([(1, bytes(first)), (2, bytes(first)[:-1]), (3, b"nope"), (4, bytes(first)[:20] + b"!" + bytes(first)[21:]), (5, bytes(first)[:12])], "i INT, container BINARY")
    got = {r.i: r for r in cr.decrypt_mappings(stored, keys).collect()}
    assert got[1].mapping[0].original == "张三" and got[1].header.artifact_id == "a1"
    assert [got[i].error_code for i in (1, 2, 3, 4, 5)] == [None, "CMAP_AUTH_FAILED", "CMAP_VERSION_UNSUPPORTED", "CMAP_AUTH_FAILED", "CMAP_AUTH_FAILED"]
    wrong = cr.decrypt_mappings(stored, keys, "cells").filter("i = 1").first()
    assert wrong.error_code == "CMAP_AUTH_FAILED"
    assert "0102030405" not in enc._jdf.queryExecution().toString().lower().replace(" ", "")


def test_term_files(spark, tmp_path):
    good = tmp_path / "t.csv"
    good.write_text('﻿分类,敏感词,描述,状态\n职位,CEO,"a,b",启用\n项目,甲,,禁用\n', encoding="utf-8")
    rows = {r.term: (r.category, r.description, r.enabled) for r in t.read_term_csv(spark, str(good)).collect()}
    assert rows == {"CEO": ("职位", "a,b", True), "甲": ("项目", "", False)}
    bad = tmp_path / "b.csv"
    bad.write_text("分类,敏感词,描述,状态\n职位,CEO,x,maybe\n", encoding="utf-8")
    with pytest.raises(t.ImportRejected):
        t.read_term_csv(spark, str(bad))


def test_masked_batch_sink(spark, tmp_path):
    from cloakframe.operators.mask import mask_documents
    from cloakframe.plans.rules import default_rules

    df = spark.createDataFrame([(1, "13900000000"), (2, "x")], "doc_id LONG, text STRING")
    out = str(tmp_path / "out")
    for _ in range(2):
        s.write_masked_batch(mask_documents(df, "doc_id", "text", default_rules()), "b1", out)
    assert s.read_finished(spark, out).count() == 2
    assert s.read_finished(spark, out, "mapping").count() == 1


def test_ocr_order(spark):
    page = lambda n, c=0.5: {"page_number": n, "blocks": [{"text": "t", "confidence": c}]}
    import json

    q = {"total_pages": 2, "empty_pages": 0, "failed_pages": 0, "avg_confidence": 0.5}
    rows = [(1, json.dumps({"pages": [page(1), page(2)], "quality": q})), (2, json.dumps({"pages": [page(2), page(1)], "quality": q})), (3, json.dumps({"pages": [page(1), page(2, 1.5)], "quality": q})), (4, json.dumps({"pages": [], "quality": q}))]
    got = {r.i: r.problem for r in g.validate_ocr(g.read_ocr(spark.createDataFrame(rows, "i INT, j STRING"), "j")).collect()}
    assert got == {1: None, 2: "pages out of order", 3: "block confidence out of range", 4: "no pages"}
