"""Findings of any number: one sweep against one literal replacement after another."""

import random
import time

import pytest

from cloakframe.operators.mask import active_findings, mask_documents
from cloakframe.operators.restore import restore_documents
from cloakframe.plans.rules import RuleSet, activate

FOUND = "doc_id LONG, text STRING, found ARRAY<STRUCT<text: STRING, entity_type: STRING>>"


def _replaced(line: str, values: list[str]) -> list[str]:
    """Originals of one replacement after another, as they are numbered within a line."""
    taken, spans = set(), []
    for v in dict.fromkeys(v for v in values if v):
        at = line.find(v)
        while at >= 0:
            if taken.isdisjoint(range(at, at + len(v))):
                taken.update(range(at, at + len(v)))
                spans.append((at, v))
                at = line.find(v, at + len(v))
            else:
                at = line.find(v, at + 1)
    return [v for _, v in spans]


def test_random_findings_equal_sequential_replacement(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        text = "".join(rng.choice("ab张三\n 1") for _ in range(rng.randint(0, 60)))
        values = ["".join(rng.choice("ab张三 1") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 8))]
        rows.append((i, text, [(v, "地址") for v in values]))
    df = spark.createDataFrame(rows, FOUND)
    out = {r.doc_id: r for r in mask_documents(df, "doc_id", "text", RuleSet(()), findings="found").wide.collect()}
    for i, text, found in rows:
        want = [v for line in text.splitlines(keepends=True) for v in _replaced(line, [f[0] for f in found])]
        assert out[i].masked_entity_count == len(want)
        assert [m.original for m in out[i].mapping] == list(dict.fromkeys(want))


def test_more_findings_than_sentinels(spark):
    n = 140_000
    values = [f"v{i:06d}" for i in range(n)]
    df = spark.createDataFrame([(1, "\n".join(" ".join(values[a : a + 1000]) for a in range(0, n, 1000)), [(v, "地址") for v in values])], FOUND)
    began = time.time()
    wide = mask_documents(df, "doc_id", "text", activate(["phone"]), findings="found").wide.cache()
    row = wide.select("masked_entity_count", "masked").first()
    assert row.masked_entity_count == n and "v0" not in row.masked
    assert all(ord(c) < 0xF0000 for c in set(row.masked))
    print("seconds", time.time() - began)
    mapping = wide.select("mapping").first().mapping
    assert len({m.masked for m in mapping}) == n and [m.original for m in mapping] == values


@pytest.mark.parametrize("found", [None, [], [(None, "姓名"), ("", "地址")]])
def test_no_findings(spark, found):
    df = spark.createDataFrame([(1, "13912345678 x", found), (2, None, found)], FOUND)
    out = mask_documents(df, "doc_id", "text", activate(["phone"]), findings="found").wide.orderBy("doc_id").collect()
    assert out[0].masked_entity_count == 1 and out[1].masked is None


def test_first_of_equal_values_and_unknown_types(spark):
    df = spark.createDataFrame([(1, "x", [("b", "地址"), ("a", None), ("b", "姓名"), ("a", "地址")])], FOUND)
    row = df.select(active_findings(df.found, [])).first()[0]
    assert [(f.text, f.entity_type) for f in row] == [("b", "地址"), ("a", None)]


def test_findings_after_terms_and_rules_come_back(spark):
    text = "客户张三 13912345678 alpha beta\n张三 alpha"
    df = spark.createDataFrame([(1, text, [("张三", "姓名"), ("beta", "地址")])], FOUND)
    terms = spark.createDataFrame([("1", "alpha", "code", True)], "id STRING, term STRING, category STRING, enabled BOOLEAN")
    out = mask_documents(df, "doc_id", "text", activate(["chinese_name", "phone"]), findings="found", terms=terms).wide
    row = restore_documents(out, "mapping", "doc_id").first()
    assert row.restored == text and row.masked_entity_count == 6
