"""Hard negatives against scoring of all pairs, and the edge cases that the docstring defines."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from cloakframe.llm import hard_negatives as hn  # noqa: E402

SCHEMA = "vec_id long, label long, x array<long>"


def brute(rows, is_anchor, positives=hn.POSITIVES, negatives=hn.NEGATIVES):
    rows = [r for r in rows if None not in r and r[2]]
    anchors = {}
    for r in sorted((r for r in rows if is_anchor(r[0])), key=lambda r: (len(r[2]), r[1], r[2])):
        anchors.setdefault(r[0], r)
    out = []
    for a in anchors.values():
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in rows if len(r[2]) == len(a[2]))
        for s, i, _ in [t for t in scored if t[2] == a[1] and t[1] != a[0]][:positives]:
            found = [t for t in scored if t[2] != a[1] and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives]
            out += [(a[0], i, n + 1, t[1], -s, -t[0]) for n, t in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, hn.mine(df, F.col("vec_id") % 5 == 0, **how).collect()))


def vectors(n, dim, seed, spread=90):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(4)]
    out = []
    for i in range(n):
        c = rng.randrange(4)
        out.append((i, rng.randrange(3) if i % 9 == 0 else c % 3, [int(m + rng.gauss(0, spread / 2)) for m in centres[c]]))
    return out


@pytest.mark.parametrize(("dim", "block"), [(5, 40), (64, 100), (70, 33)])
def test_equals_scoring_of_all_pairs(spark, dim, block):
    rows = vectors(300, dim, dim)
    assert mined(spark, rows, block_rows=block) == brute(rows, lambda i: i % 5 == 0)


def test_intervals_hold_and_choose():
    rng = np.random.default_rng(1)
    x = rng.integers(-120, 120, (900, 64))
    rows = hn.coded(np.arange(900), np.zeros(900, np.int64), x)
    low, high = hn.intervals(rows, x[:60])
    true = x[:60] @ x.T
    assert (low <= true).all() and (true <= high).all()
    assert np.median(high - low) < 1.3 * true.std()  # narrow against the spread of scores
    one = hn.coded(np.arange(900), np.zeros(900, np.int64), x, levels=1)
    low, high = hn.intervals(one, x[:60])
    assert (low <= true).all() and (true <= high).all()


def test_odd_rows(spark):
    same = [7, -3, 2, 9]
    rows = [(i, i % 2, same) for i in range(40)]  # one vector that all share: every score ties
    rows += [(100 + i, i % 2, [4, 1, -2, 5]) for i in range(30)]
    rows += [(55, None, same), (60, 1, None), (65, 1, []), (None, 1, same), (70, 0, [0, 0, 0, 0]), (75, 1, [-v for v in same]), (80, 0, [1, 2]), (85, 1, [1, 2]), (90, 0, [3, 3])]
    rows += [rows[3], rows[5], rows[5], (10, 1, [9, 9, 9, 9]), (95, 5, same)]
    assert mined(spark, rows, block_rows=16) == brute(rows, lambda i: i % 5 == 0)
    assert mined(spark, []) == []


def test_large_values(spark):
    big = 1 << 28
    rows = [(i, i % 2, [big - i, i, -big]) for i in range(12)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    assert hn.exact(np.array([[1 << 40, 1]]), np.array([[1 << 22, 5]]), np.array([0]), np.array([0])).tolist() == [(1 << 62) + 5]
    with pytest.raises(ValueError, match="64 bits"):
        hn.exact(np.array([[1 << 40]]), np.array([[1 << 40]]), np.array([0]), np.array([0]))


def test_integers_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, 1, [0.5, -0.001]), (1, 1, [float("nan"), 1.0]), (2, 1, [None, 1.0]), (3, 1, None), (4, 1, [float("inf"), 1.0]), (5, 1, [])], "vec_id long, label long, v array<double>")
    assert [r.x for r in df.select(hn.integers(F.col("v")).alias("x")).collect()] == [[128, -1], None, None, None, None, None]
    rows = vectors(60, 6, 3)
    clash = [F.lit(9).alias(c) for c in ("id", "dim", "kind", "lane", "part", "seq", "block", "scores", "asked", "anchor_id", "place", "_n")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *clash)
    assert sorted(map(tuple, hn.mine(df, F.col("vec_id") % 5 == 0).collect())) == brute(rows, lambda i: i % 5 == 0)
