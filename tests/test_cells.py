"""Cells with rules, terms and findings, against the cell masked as a text of its own."""

import pytest

from cloakframe.operators.cells import mask_table_cells, preview_rows, with_entities
from cloakframe.operators.mask import mask_documents
from cloakframe.plans.rules import Term, activate

CELLS = "workbook STRING, sheet STRING, row LONG, col INT, value STRING, found array<struct<text:string,entity_type:string>>"
ROWS = [
    ("w", "A", 2, 1, "Acme tel 13900000000 met Bob", [("Bob", "PERSON")]),
    ("w", "A", 2, 2, "Bob and 13900000001 at Acme", []),
    ("w", "A", 3, 1, None, None),
    ("w", "B", 2, 1, "", []),
    ("w", "B", 2, 2, "13900000000 Bob Li Acme Corp", [("Li", "PERSON"), ("Bob", "PERSON"), ("Li", "PERSON")]),
    ("v", "A", 2, 1, "\U000F0001 Bob 13900000001", [("Bob", None)]),
    ("v", "A", 9, 1, "nothing here", None),
]
TERMS = [(1, "Acme", "ORG", True), (2, "Acme Corp", "CO", True), (3, "tel", "X", False)]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(ROWS, CELLS)


@pytest.fixture(scope="module")
def library(spark):
    return spark.createDataFrame(TERMS, "id INT, term STRING, category STRING, enabled BOOLEAN")


def told(out):
    masked, mapping = out
    return {(r.workbook, r.sheet, r.row, r.col): r.masked for r in masked.collect()}, {(r.workbook, r.original): (r.masked, r.rule_id, r.n_occurrences) for r in mapping.collect()}


def test_all_three_kinds_share_one_counter(cells, library):
    text, mapping = told(mask_table_cells(cells, activate(["phone"]), findings="found", terms=library))
    phone, org = mapping["w", "13900000000"], mapping["w", "Acme"]
    assert phone[0] == "***PHONE***1" and phone[2] == 2 and org == ("[ORG]", "sensitive_term_1", 3)
    assert mapping["w", "Bob"][2] == 2 and mapping["w", "Li"][2] == 1 and mapping["w", "13900000001"][0] == "***PHONE***3"
    bob = mapping["w", "Bob"][0]
    assert "2" in bob and text["w", "A", 2, 1] == f"[ORG] tel ***PHONE***1 met {bob}"
    assert text["w", "A", 2, 2] == "Bob and ***PHONE***3 at [ORG]"  # a finding is looked for in its own cell
    assert text["w", "B", 2, 2] == f"***PHONE***1 {bob} {mapping['w', 'Li'][0]} [ORG] Corp"
    assert text["w", "A", 3, 1] is None and text["w", "B", 2, 1] == "" and text["v", "A", 9, 1] == "nothing here"
    assert text["v", "A", 2, 1].startswith("\U000F0001 ") and mapping["v", "13900000001"][0] == "***PHONE***1"
    assert len(text) == len(ROWS)


def test_either_findings_or_rules(cells, library):
    text, mapping = told(mask_table_cells(cells, activate(["phone"]), findings="found", terms=library, either=True))
    bob = mapping["w", "Bob"][0]
    assert text["w", "A", 2, 1] == f"Acme tel 13900000000 met {bob}" and "1" in bob
    assert text["w", "A", 2, 2] == "Bob and ***PHONE***2 at [ORG]"
    assert ("w", "13900000000") not in mapping


def test_one_cell_is_masked_as_a_text(spark, cells, library):
    one = cells.filter("workbook = 'w' AND sheet = 'B'")
    text, mapping = told(mask_table_cells(one, activate(["phone"]), findings="found", terms=library))
    row = mask_documents(one.filter("col = 2"), "col", "value", activate(["phone"]), findings="found", terms=library).wide.first()
    assert text["w", "B", 2, 2] == row.masked
    assert {k[1]: v[:2] for k, v in mapping.items()} == {m.original: (m.masked, m.rule_id) for m in row.mapping}


def test_preview_tells_entities(cells, library):
    shown = with_entities(cells.drop("found"))
    masked, mapping = preview_rows(shown, activate(["phone"]), 1, findings=None, terms=library)
    got = {(r.workbook, r.sheet, r.row, r.col): [e.text for e in r.entities or []] for r in masked.collect()}
    assert ("w", "A", 3, 1) not in got and "13900000000" in got["w", "A", 2, 1]
    with pytest.raises(ValueError):
        mask_table_cells(cells, activate(["phone"], [Term("1", "Acme", "ORG")]))
    assert all(d.count() == 0 for d in mask_table_cells(cells.limit(0), activate(["phone"]), findings="found", terms=library))
