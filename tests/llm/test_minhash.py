"""Near-duplicates by exact similarity against brute force, and the edge cases that the docstring defines."""

import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from cloakframe.llm import minhash, simhash  # noqa: E402
from cloakframe.llm.common import saved, scratch  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words)))))


def kept_by_brute_force(rows):
    """Smallest id of every component of the links |a & b| >= 0.8 * |a | b|, from the whole matrix of intersections."""
    ids = [i for i, _ in rows]
    sets = [shingles(t) for _, t in rows]
    places = defaultdict(list)
    for r, s in enumerate(sets):
        for x in s:
            places[x].append(r)
    shared = [p for p in places.values() if len(p) > 1]
    table = np.zeros((len(rows), len(shared) + 1), np.float32)
    for c, p in enumerate(shared):
        table[p, c] = 1
    both, n = table @ table.T, np.array([len(s) for s in sets])
    linked = 5 * both >= 4 * (n[:, None] + n - both)  # empty sets are equal
    least = np.array(ids)
    while True:
        now = np.where(linked | np.eye(len(ids), dtype=bool), least, np.iinfo(np.int64).max).min(axis=1)
        if (now == least).all():
            return sorted(set(least.tolist()))
        least = now


def kept(spark, rows, **how):
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    return sorted(r.doc_id for r in minhash.deduplicate(df, **how).select("doc_id").collect())


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def crowd(n, seed=1, own=(16, 16)):
    """Texts that share a passage of 124 words (120 shingles) and have words of their own; among them planted pairs at about 0.81 and 0.89."""
    rng = random.Random(seed)
    passage = words(rng, 124)
    rows = []
    for i in range(n):
        mine = words(rng, rng.randint(*own))
        rows.append((len(rows), " ".join(passage + mine)))
        if i % 20 in (0, 1):  # a partner that has most of the own words too
            same = 2 if i % 20 else 9
            rows.append((len(rows), " ".join(passage + mine[:same] + words(rng, len(mine) - same))))
    rng.shuffle(rows)
    return rows


def test_a_passage_that_many_share_hides_no_pair(spark):
    rows = crowd(2_000)
    want = kept_by_brute_force(rows)
    assert 1900 < len(want) < len(rows) - 150
    assert kept(spark, rows) == want
    assert kept(spark, rows[:700], rounds=1, few=2) == kept_by_brute_force(rows[:700])


def test_own_parts_of_many_sizes(spark):
    rows = crowd(500, 2, (5, 60))
    assert kept(spark, rows) == kept_by_brute_force(rows)


def test_near_copies_in_groups(spark):
    rng = random.Random(4)
    rows, base = [], [words(rng, 60) for _ in range(12)]
    for i in range(900):
        w = list(base[i % 12 if i % 3 else 0])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    assert kept(spark, rows) == kept_by_brute_force(rows)


def test_documents_of_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert kept(spark, rows) == kept_by_brute_force(rows)


def test_prefixes_alone_are_exact(spark):
    rows = crowd(150, 5, (5, 40))
    df = spark.createDataFrame(rows, DOCS).select("text", F.col("doc_id").alias("sig"))
    sets = saved(minhash._mapped(df, ("sig",), "sig", minhash._held, "held array<bigint>"))
    comp = minhash.settle_prefixes(sets.select("sig", F.col("sig").alias("comp")), sets)
    assert sorted({r.comp for r in comp.collect()}) == kept_by_brute_force(rows)


def test_odd_documents(spark):
    texts = [None, "", " \t\n", "a", "A", "one two three", "one two  THREE", "x" * 3000, "w " * 5000, "w " * 9, "ÄÖ ü 中文 " * 40, "ÄÖ ü 中文 " * 41, "😀 é\x00"]
    rows = list(enumerate(texts))
    clash = [F.lit(9).alias(c) for c in ("id", "key", "row", "sig", "n", "fp", "bands", "band", "comp", "_text", "held", "u", "v", "members")]
    df = spark.createDataFrame([*rows, rows[3], rows[5], (5, "another text under that id"), (None, "no id at all"), (None, "A")], DOCS).select("*", *clash)
    out = minhash.deduplicate(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    first = min(("one two three", "another text under that id"), key=len)
    want = [(False, i, texts[i] or "") for i in kept_by_brute_force(rows)] + [(False, 5, "another text under that id"), (True, 0, "no id at all")]
    assert first and got == sorted(want)
    assert minhash.deduplicate(spark.createDataFrame([], DOCS)).collect() == []


def test_repeated_rows_and_tables_that_go(spark, tmp_path):
    rows = [(1, "the same words in every row of this table")] * 400 + [(2, "the same words in every row of this table")] * 5 + [(3, "something else altogether stands in this one")]
    assert kept(spark, rows) == [1, 3]
    with scratch(spark) as keep:
        gone, stays = saved(spark.range(3)), keep(spark.range(4))
    assert stays.count() == 4
    assert not Path(gone.inputFiles()[0].removeprefix("file://")).exists()


def test_bands_and_majority():
    text = b"one two three four five six seven"
    hashes = simhash.shingle_hashes(text, 5)
    found = np.unique(hashes)
    assert len(hashes) == 3 and len(set(minhash.bands(found).tolist())) == minhash.BANDS
    assert simhash.majority(hashes) == simhash.fingerprint(text, 5) and simhash.majority(simhash.shingle_hashes(b" ")) == 0
    many = np.unique(simhash.shingle_hashes(" ".join(map(str, range(5_000))).encode(), 5))
    assert 0 < (minhash.bands(np.append(many, np.uint64(1))) == minhash.bands(many)).sum()
