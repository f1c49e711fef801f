"""Term libraries held as tables: equal to trying all terms one after another."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from cloakframe.operators import term_join
from cloakframe.operators.mask import mask_documents
from cloakframe.plans.rules import Term, activate, default_rules

TERMS = "id string, term string, category string, enabled boolean"


def one_after_another(text, terms):
    """All terms in order on a text; a placeholder is one private-use character until the end."""
    found = []
    word = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    for id_, term, category in sorted(terms, key=lambda t: (t[1].encode(), t[0])):
        han = any("一" < c < "龥" for c in term)
        body = regex.escape(term, literal_spaces=True)
        mark = chr(0xF0000 + len(found))
        found.append(f"[{category}]")
        text = regex.sub(body if han else f"{edge}{body}{edge}", mark, text)
    return re.sub("[\U000f0000-\U000ffffd]", lambda m: found[ord(m[0]) - 0xF0000], text)


def masked(spark, texts, terms, rules=None, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = spark.createDataFrame([(*t, True) for t in terms], TERMS)
    return {r.doc_id: r for r in mask_documents(docs, "doc_id", "text", rules or activate([]), terms=library, **how).wide.collect()}


PIECES = ["ab", "b", "abc", "a b", "x_y", ".", "-", " ", " ", "  ", "中", "中文", "文字", "é", "C++", "\n", "ab-b", "1"]


@pytest.mark.parametrize("few", [0, 2_000])
def test_equal_to_one_after_another(spark, monkeypatch, few):
    monkeypatch.setattr(term_join.attach_terms, "__defaults__", ("_terms", few))  # joined, and as a constant
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice(PIECES) for _ in range(n))
    for _ in range(2):
        terms = list({t: (f"{i}", t, f"K{i % 3}") for i in range(60) if (t := make(rng.randint(1, 4)).strip("\n")) and "\n" not in t
                      and not (regex.search("[一-龥]", t) and regex.search("[^一-龥]", t))}.values())
        texts = [make(rng.randint(0, 40)) for _ in range(150)]
        got = masked(spark, texts, terms)
        for i, text in enumerate(texts):
            assert got[i].masked == one_after_another(text, terms), (text, terms)


def test_equal_to_the_collected_library(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    terms = [(f"{i:03}", w, f"C{i % 4}") for i, w in enumerate([*words[:25], "w1 w30", "w30 w31", "w31 w32", "w2, w3", "w39 13900000000", "C++", "中文", "中"])]
    texts = [" ".join(rng.choice([*words, "13900000000", "a@b.cn", "中文w3", "w2, w3", "C++", "x13900000000 w5"]) for _ in range(30)) for _ in range(60)]
    for rules in (default_rules(), activate(["phone"])):
        got = masked(spark, texts, terms, rules)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = mask_documents(docs, "doc_id", "text", rules.with_terms([Term(*t) for t in sorted(terms, key=lambda t: (t[1].encode(), t[0]))])).wide.collect()
        for r in want:
            g = got[r.doc_id]
            if "中文w" not in texts[r.doc_id]:  # only the table frees words beside Han terms
                assert (g.masked, g.masked_entity_count) == (r.masked, r.masked_entity_count)
                assert [(m.original, m.masked, m.rule_id, m.n_occurrences) for m in g.mapping] == [(m.original, m.masked, m.rule_id, m.n_occurrences) for m in r.mapping]


def test_twenty_thousand_terms_in_one_text(spark):
    n = 20_000
    text = " ".join(f"t{i}" for i in range(n))
    library = spark.range(n).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("term"), F.lit("C").alias("category"), F.lit(True).alias("enabled"))
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in mask_documents(docs, "doc_id", "text", activate([]), terms=library).wide.select("doc_id", "masked", "masked_entity_count").collect()}
    assert out[1].masked == " ".join(["[C]"] * n) and out[1].masked_entity_count == n
    assert (out[2].masked, out[3].masked, out[4].masked) == ("none", None, "")


def test_keys_and_empty_libraries(spark):
    rows = [("2", "the cat", "A", True), ("1", "the cat", "B", True), ("3", "the dog", "A", True), ("4", "off", "A", False), ("5", "中文字", "A", True), ("6", "中", "A", True), ("7", "!!", "A", True)]
    got = {r.term: (r.kind, r.key, r.id) for r in term_join.term_index(spark.createDataFrame(rows, TERMS)).collect()}
    assert got == {"the cat": ("word", "cat", "1"), "the dog": ("word", "dog", "3"), "中文字": ("pair", "中文", "5"), "中": ("single", "中", "6"), "!!": ("other", "!", "7")}
    assert masked(spark, ["the cat off"], [], default_rules())[0].masked == "the cat off"
    assert masked(spark, ["a!!b the cat"], [r[:3] for r in rows])[0].masked == "a[A]b [B]"


def test_terms_of_several_words_are_filed_under_two_neighbours(spark):
    library = spark.createDataFrame([("1", "to be", "A", True), ("2", "be to", "B", True), ("3", "alone", "C", True), ("4", "a b c", "D", True)], TERMS)
    index = {r.term: (r.kind, r.key) for r in term_join.term_index(library).collect()}
    assert index == {"to be": ("words", "to\nbe"), "be to": ("words", "be\nto"), "alone": ("word", "alone"), "a b c": ("words", "a\nb")}
    docs = spark.createDataFrame([(1, "to see, or be"), (2, "not to be alone"), (3, "a b"), (4, "中to be文 a b c")], "doc_id long, text string")
    got = {r.doc_id: r._terms and [t.term for t in r._terms] for r in term_join.attach_terms(docs, F.col("text"), library, few=0).collect()}
    assert got == {1: None, 2: ["alone", "to be"], 3: ["a b c"], 4: ["a b c", "to be"]}


def test_a_python_step_over_texts_gets_small_batches(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(rows, "10000")
    spark.conf.set(size, "64m")
    masked(spark, ["to be"], [("1", "be", "A")])
    assert int(spark.conf.get(rows)) <= 1_000 and spark.conf.get(size) == "4m"


def test_new_terms_are_checked_by_term_and_id(spark):
    from cloakframe.operators.terms import create_terms

    entry = "id long, term string, category string, description string, enabled boolean"
    make = lambda rows: spark.createDataFrame([(i, t, "C", None, True) for i, t in rows], entry)
    new = make([(1, "new"), (2, "new "), (2, "new"), (3, "old"), (None, "new"), (None, "old"), (None, "none"), (4, " "), (5, None), (6, "x" * 257), (1, "new")])
    accepted, rejects = create_terms(make([(9, "old"), (10, None)]).select("term"), new)
    assert sorted(((r.id or 0), r.term) for r in accepted.collect()) == [(0, "new"), (0, "none"), (1, "new"), (1, "new")]
    code = {"old": "TERM_DUPLICATE", "new": "TERM_DUPLICATE", "": "TERM_REQUIRED", None: "TERM_REQUIRED", "x" * 257: "TERM_TOO_LONG"}
    got = rejects.collect()
    assert sorted((r.id or 0, r.error_code) for r in got) == [(0, "TERM_DUPLICATE"), (2, "TERM_DUPLICATE"), (2, "TERM_DUPLICATE"), (3, "TERM_DUPLICATE"), (4, "TERM_REQUIRED"), (5, "TERM_REQUIRED"), (6, "TERM_TOO_LONG")]
    assert all(code[r.term] == r.error_code for r in got)
    # the entries meet one table only, by term and id: by term alone, a frequent one would be in one task
    assert rejects._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
