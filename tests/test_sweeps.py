"""Restoring and leak checks over many values: one sweep against the definition."""

import random
import time

from pyspark.sql import functions as F

from cloakframe.operators import restore as r
from cloakframe.operators.finding_sweep import swept_originals
from cloakframe.operators.mask import leak_check
from cloakframe.operators.restore import restore_documents

MAPPING = "array<struct<original:string,masked:string,rule_id:string>>"


def _restored(text, mapping):
    """Longest masked value first, left to right; places already restored are left alone."""
    taken, spans = set(), []
    for original, masked, _ in sorted((m for m in mapping if m[1] and m[0] is not None), key=lambda m: -len(m[1].encode())):
        at = text.find(masked)
        while at >= 0:
            free = taken.isdisjoint(range(at, at + len(masked)))
            if free:
                taken.update(range(at, at + len(masked)))
                spans.append((at, at + len(masked), original))
            at = text.find(masked, at + (len(masked) if free else 1))
    out, end = "", 0
    for a, b, original in sorted(spans):
        out, end = out + text[end:a] + original, b
    return out + text[end:], len(spans)


def test_random_mappings(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        kinds = ["姓名1", "姓名12", "***PHONE***1", "***PHONE***11", "[code]", "a", "ab", "b*", ""]
        picked = rng.sample(kinds, rng.randint(1, 6))
        mapping = [(rng.choice(["x", "", "张三", "姓名1", "***", None]), k, "r") for k in picked]
        rows.append((i, "".join(rng.choice([*kinds, " ", "\n"]) for _ in range(rng.randint(0, 12))), mapping))
    df = spark.createDataFrame(rows, f"doc_id INT, masked STRING, mapping {MAPPING}")
    for row, (_, text, mapping) in zip(restore_documents(df, "mapping", "doc_id").orderBy("doc_id").collect(), rows):
        assert (row.restored, row.n_restored) == _restored(text, mapping), (text, mapping)


def test_both_ways_agree_on_placeholders(spark):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        mapping = [(f"o{j}", f"***PHONE***{j}", "r") for j in rng.sample(range(1, 130), 12)] + [(f"n{j}", f"姓名{j}", "r") for j in rng.sample(range(1, 130), 6)]
        rows.append((i, " ".join(rng.choice(["***PHONE***", "姓名"]) + str(rng.randint(1, 1300)) for _ in range(20)), mapping))
    df = spark.createDataFrame(rows, f"doc_id INT, text STRING, mapping {MAPPING}")
    both = df.select(r._one_pass(df.text, df.mapping).alias("a"), swept_originals(df.text, df.mapping, F.lit(True)).alias("b")).collect()
    assert all(x.a == x.b for x in both)


def test_mixed_mapping_takes_the_time_of_its_text(spark):
    n = 8000
    mapping = [(f"value {i}", f"<{i}>" if i % 2 else f"***PHONE***{i}", "r") for i in range(n)]
    text = " ".join(m[1] for m in mapping)
    df = spark.createDataFrame([(1, text, mapping)], f"doc_id INT, masked STRING, mapping {MAPPING}")
    began = time.time()
    row = restore_documents(df, "mapping", "doc_id").first()
    assert row.restored == " ".join(m[0] for m in mapping) and row.n_restored == n
    assert time.time() - began < 30


def test_leaks_of_many_originals(spark):
    rng = random.Random(10)
    rows = []
    for i in range(40):
        text = "".join(rng.choice("abc张") for _ in range(rng.randint(0, 80)))
        values = ["".join(rng.choice("abc张") for _ in range(rng.randint(0, 5))) for _ in range(rng.choice([0, 3, 33, 90]))]
        rows.append((i, text, [(v, "m", "r") for v in values] + [(None, "m", "r")]))
    big = " ".join(f"w{i}" for i in range(0, 200_000, 2))
    rows.append((99, big, [(f"w{i}x" if i % 3 else f"w{i} ", "m", "r") for i in range(10_000)]))
    df = spark.createDataFrame(rows, f"doc_id INT, masked STRING, mapping {MAPPING}")
    began = time.time()
    got = sorted((x.doc_id, x.original) for x in leak_check(df, "doc_id").collect())
    assert time.time() - began < 30
    assert got == sorted((i, o) for i, text, mapping in rows for o, _, _ in mapping if o is not None and o in text)
