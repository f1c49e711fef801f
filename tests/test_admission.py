"""File admission in rounds against the greedy rule, file after file."""

import random

import pytest

from cloakframe.sources import ingest as g

FILES = "batch_id INT, file_ord LONG, name STRING, size_bytes LONG, mtime INT, reason STRING"


def _greedy(rows, max_files, max_file, max_bytes):
    want, state, seen = {}, {}, set()
    for b, i, name, size, mtime, _ in sorted(rows, key=lambda r: r[1]):
        n, used = state.get(b, (0, 0))
        fits = max(size or 0, 0)
        if (b, name, size, mtime) in seen:
            want[b, i] = "DUPLICATE"
        elif name is not None and name.endswith(".exe"):
            want[b, i] = "UNSUPPORTED"
        elif n >= max_files:
            want[b, i] = "COUNT_LIMIT"
        elif fits > max_file:
            want[b, i] = "FILE_TOO_LARGE"
        elif used + fits > max_bytes:
            want[b, i] = "BATCH_TOO_LARGE"
        else:
            want[b, i] = "ACCEPTED"
            state[b] = (n + 1, used + fits)
        seen.add((b, name, size, mtime))
    return want


@pytest.mark.parametrize("limits", [(1000, 10_000, 5000), (25, 300, 2000), (0, 10, 10), (1000, 100, 0)])
def test_rounds_equal_the_greedy_rule(spark, limits):
    rng = random.Random(sum(limits))
    rows = []
    for i in range(600):
        b = rng.choice([1, 1, 1, 2, 3, None])
        size = rng.choice([0, 1, 2, rng.randint(1, 60), rng.randint(50, 700), 2 ** rng.randint(0, 12), None])
        rows.append((b, i * 37, rng.choice([f"{i}.txt", "x.txt", f"{i}.exe"]), size, rng.choice([1, None]), "theirs"))
    # one file less each time: the plain longest-prefix rule would need a round for every pair
    rows += [(9, 2 * i + j, f"{i}{j}.txt", 300 - i if j else 1, 1, None) for i in range(150) for j in (0, 1)]
    out = g.admit_files(spark.createDataFrame(rows, FILES).drop("reason"), *limits, bucket=500).collect()
    assert len(out) == len(rows)
    assert {(r.batch_id, r.file_ord): r.reason for r in out} == _greedy(rows, *limits)


def test_no_files(spark):
    assert g.admit_files(spark.createDataFrame([], FILES).drop("reason")).collect() == []
