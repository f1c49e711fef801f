"""Large libraries: texts written a batch at a time equal texts swept one by one, and work grows with partitions' tokens, not with texts x terms."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import term_batch, term_join
from cloakframe.operators.mask import mask_documents
from cloakframe.operators.term_join import Sweep
from cloakframe.plans.rules import activate, default_rules
from tests.test_terms import TERMS, masked, one_after_another


@pytest.fixture
def joined(monkeypatch):
    monkeypatch.setattr(term_join.attach_terms, "__defaults__", ("_terms", 0))


def join_rows(plan) -> int:
    """Rows out of all joins of a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return join_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return join_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    kids = plan.children()
    return own + sum(join_rows(kids.apply(i)) for i in range(kids.size()))


def test_terms_are_joined_with_the_tokens_of_partitions(spark, joined):
    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, f"{' '.join(words)} {i}") for i in range(400)], "doc_id long, text string")
    library = spark.createDataFrame([(w, w, "C", True) for w in words], TERMS)
    out = mask_documents(docs, "doc_id", "text", activate([]), terms=library).wide.select("doc_id", "masked", "masked_entity_count")
    assert all(r.masked == " ".join(["[C]"] * 50) + f" {r.doc_id}" and r.masked_entity_count == 50 for r in out.collect())
    # 50 rows of the library by itself and 50 for each of four partitions; one for each term of each text would be 20,000
    assert join_rows(out._jdf.queryExecution().executedPlan()) <= 50 + 4 * 50


def test_plain_texts_equal_one_after_another(spark, joined):
    rng = random.Random(8)
    words = ["ab", "b", "abc", "Été", "x_y", "d1", "ß", "zz"]
    gaps = [" ", " ", " ", ", ", "\n", "  ", "-"]
    make = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    for rules in (activate([]), default_rules()):
        terms = list({t: (f"{i}", t, f"K{i % 3}") for i in range(40) if (t := make(rng.randint(1, 4)).strip(" ,\n-")) and "\n" not in t}.values())
        texts = [make(rng.randint(0, 40)) for _ in range(200)]
        got = masked(spark, texts, terms, rules)
        for i, text in enumerate(texts):
            assert got[i].masked == one_after_another(text, terms), (text, terms)
            # the mapping is made from the sweep of each text
            assert got[i].masked_entity_count == sum(m.n_occurrences for m in got[i].mapping)


def test_equal_to_the_sweep_of_one_text():
    rng = random.Random(9)
    words = ["a", "b", "aa", "Ωé", "c", "中文", "中"]
    for _ in range(150):
        make = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "", "+"]) for _ in range(n))
        texts = [make(rng.randint(0, 25)) for _ in range(8)] + [None, "\U000f0001 a"]
        rows = []
        for term in sorted({t for _ in range(12) if (t := make(rng.randint(1, 3)).strip())}, key=str.encode):
            found, _, han, _ = (p.findall(term) for p in term_batch.patterns())
            kind = ("pair" if len(term) > 1 else "single") if han else "words" if len(found) > 1 else "word" if found else "other"
            key = {"pair": term[:2], "single": term, "words": "\n".join(found[:2]), "word": found and found[0], "other": term[0]}[kind]
            rows.append({"term": term, "id": term, "category": f"{len(term) % 3}", "key": key, "han": bool(han), "kind": kind})
        library = term_batch.Library(pa.Table.from_pylist(rng.sample(rows, len(rows)), term_batch.ROWS))
        text, n, left = (x.to_pylist() for x in library.masked(pa.array(texts)))
        for t, t_masked, t_n, t_left in zip(texts, text, n, left, strict=True):
            if t is None or "\U000f0001" in t or t_masked is None:
                assert (t_masked, t_n) == (None, None)
                continue
            terms = [{k: r[k] for k in ("term", "id", "category", "key", "han")} for r in rows]
            want = Sweep(terms, 1, frozenset(), frozenset()).line({"t": t, "occ": []})
            marks = [f"[{terms[o['rank'] - 1]['category']}]" for o in want["occ"]]
            pieces = want["t"].split("\U000f0001")
            assert t_masked == "".join(a + b for a, b in zip(pieces, [*marks, ""], strict=True)), (t, terms)
            assert t_n == len(marks) and t_left is None


def test_hits_are_taken_in_order():
    rng = np.random.RandomState(3)
    for _ in range(400):
        n = rng.randint(0, 12)
        rows = sorted({(int(s), int(t)) for s, t in zip(rng.randint(0, 15, n), rng.randint(0, 5, n), strict=True)})
        size = rng.randint(1, 6, 5)
        start, term = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([], [])))
        end, used, want = start + size[term], set(), set()
        for i in sorted(range(len(rows)), key=lambda i: (term[i], start[i])):
            if not used & set(range(start[i], end[i])):
                used |= set(range(start[i], end[i]))
                want.add(i)
        assert set(np.flatnonzero(term_batch.taken(start, end, term)).tolist()) == want


def test_words_are_those_of_the_patterns():
    rng = random.Random(4)
    points = [*range(32, 127), *range(160, 1500), *range(0x0900, 0x0980), *range(0x4E00, 0x4E20), 0x9FA5, 0x200C, 0x1D400, 0x1F600, 10]
    texts = ["".join(chr(rng.choice(points)) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a" * 9_000, "a" * 4_096 + "b", ""]
    batch = term_batch.Texts(pa.array(["x", *texts]).slice(1))
    words, others, _, _ = term_batch.patterns()
    got = [[] for _ in texts]
    for where, s, e in zip(batch.where.tolist(), batch.starts.tolist(), batch.ends.tolist(), strict=True):
        got[where].append(batch.data[s:e].tobytes().decode())
    assert got == [words.findall(t) for t in texts]
    flat = [w for t in got for w in t]
    assert len(set(flat)) == len(set(batch.hash.tolist())) and term_batch.of_strings(flat).tolist() == batch.hash.tolist()
    where, hash_ = batch.tokens({"words"})
    want = [(i, f"{a}\n{b}") for i, t in enumerate(texts) for a, b in zip(others.findall(t), others.findall(t)[1:], strict=False)]
    keys = term_batch.key_hashes(pa.array(["words"] * len(want)), pa.array([k for _, k in want]))
    assert where.tolist() == [i for i, _ in want] and hash_.tolist() == keys.tolist()


def test_columns_nulls_and_large_texts(spark, joined):
    long = "no " * 1_000_000
    rows = [(1, "cat", {"k": 1}, "a"), (1, "cat", {"k": 1}, "a"), (2, None, None, None), (3, "", {}, "b"), (4, long + "cat", None, "c"), (5, "none", None, None), (None, "the\ncat 13900000000", None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, masked string, m map<string,int>, note string")
    library = spark.createDataFrame([("1", "cat", None, True), ("2", "the cat", "T", True), ("0", "cat", "C", True), ("3", "off", "C", False)], TERMS)
    out = mask_documents(docs, "doc_id", "masked", default_rules(), terms=library).wide
    assert out.columns == ["doc_id", "m", "note", "masked", "mapping", "masked_entity_count"]
    got = sorted(((r.doc_id or 0, r.masked, r.m, r.note, r.masked_entity_count) for r in out.collect()), key=lambda r: (r[0], str(r)))
    assert got == [(0, "the\n[C] ***PHONE***1", None, "d", 2), (1, "[C]", {"k": 1}, "a", 1), (1, "[C]", {"k": 1}, "a", 1), (2, None, None, None, 0), (3, "", {}, "b", 0), (4, long + "[C]", None, "c", 1), (5, "none", None, None, 0)]
    none = mask_documents(docs, "doc_id", "masked", activate([]), terms=library.limit(1)).wide
    assert {r.masked for r in none.select("masked").filter("doc_id = 1").collect()} == {""}  # a term without a category leaves nothing


def test_seeds_and_findings_beside_a_large_library(spark, joined):
    docs = spark.createDataFrame([(1, "the cat saw Bob", [("cat", "KEPT", "r")], [("Bob", "PERSON")])], "doc_id long, text string, seed array<struct<original:string,masked:string,rule_id:string>>, f array<struct<text:string,entity_type:string>>")
    library = spark.createDataFrame([("1", "cat", "A", True), ("2", "the dog", "B", True)], TERMS)
    seeded = mask_documents(docs, "doc_id", "text", activate([]), terms=library, seed="seed").wide.select("masked").first()
    assert seeded.masked == "the KEPT saw Bob"
    found = mask_documents(docs, "doc_id", "text", default_rules(), terms=library, findings="f").wide.select("masked", F.size("mapping").alias("n")).first()
    assert found.masked.startswith("the [A] saw ") and "Bob" not in found.masked and found.n == 2


def test_cells_with_a_joined_library(spark, monkeypatch):
    from cloakframe.operators.cells import mask_table_cells
    from tests.test_cells import CELLS, ROWS, told
    from tests.test_cells import TERMS as OF_CELLS

    cells = spark.createDataFrame(ROWS, CELLS)
    library = spark.createDataFrame(OF_CELLS, "id INT, term STRING, category STRING, enabled BOOLEAN")
    want = [told(mask_table_cells(cells, activate(["phone"]), findings="found", terms=library, either=e)) for e in (False, True)]
    monkeypatch.setattr(term_join.attach_terms, "__defaults__", ("_terms", 0))
    assert [told(mask_table_cells(cells, activate(["phone"]), findings="found", terms=library, either=e)) for e in (False, True)] == want
