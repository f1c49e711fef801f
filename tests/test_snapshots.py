"""Term sets that are stored once and pointed at."""

from concurrent.futures import ThreadPoolExecutor

from cloakframe.operators import snapshots as sn
from cloakframe.streaming.workdir import work_dir

TERMS = "id INT, term STRING, category STRING, enabled BOOLEAN"


def library(spark, *words, off=()):
    return spark.createDataFrame([(i, w, "C", w not in off) for i, w in words], TERMS)


def stored(spark, path):
    fs, at = sn._files(spark, f"{path}/versions")
    return sorted(f.getPath().getName() for f in fs.listStatus(at))


def test_version_is_the_content(spark):
    a = library(spark, (1, "x"), (2, "y"), (3, None))
    assert sn.snapshot_version(a) == sn.snapshot_version(a.orderBy("id", ascending=False).repartition(3))
    assert sn.snapshot_version(a) == sn.snapshot_version(library(spark, (1, "x"), (2, "y"), (3, None), (9, "z"), off=("z",)))
    others = [library(spark, (1, "x"), (2, "y")), library(spark, (1, "x"), (2, "y"), (3, "")), a.union(a), a.filter("false")]
    assert len({sn.snapshot_version(d) for d in [a, *others]}) == 5


def test_batches_share_a_version_and_keep_it(spark):
    path = work_dir(spark, "snapshots")
    first, second = library(spark, (1, "x"), (2, "y")), library(spark, (1, "x"))
    names = ["b1", "a/b", "a b", "名", "A-b", ""]
    versions = {sn.write_snapshot(first, n, path) for n in names}
    assert len(versions) == 1 and stored(spark, path) == sorted(versions)
    assert sn.write_snapshot(second, "b1", path) in versions and sn.write_snapshot(second, "b2", path) not in versions
    assert {r.batch_id: r.version in versions for r in sn.snapshots(spark, path).collect()} == dict.fromkeys(names, True) | {"b2": False}
    assert sorted(r.term for r in sn.read_snapshot(spark, path, "a/b").collect()) == ["x", "y"]
    assert sn.write_snapshot(first.filter("false"), "none", path) and sn.read_snapshot(spark, path, "none").count() == 0


def test_of_two_writers_one_wins(spark):
    path = work_dir(spark, "snapshots")
    libraries = [library(spark, (1, "x")), library(spark, (1, "y"))] * 3
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda d: sn.write_snapshot(d, "b", path), libraries))
    assert len(set(got)) == 1 and sn.snapshots(spark, path).count() == 1
    same = library(spark, (5, "same"))
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: sn.write_snapshot(same, f"s{n}", path), range(4)))
    assert len(set(got)) == 1 and sn.read_snapshot(spark, path, "s3").count() == 1
    fs, at = sn._files(spark, path)
    assert not [f for f in fs.listStatus(at) if f.getPath().getName().startswith("_new")]


def test_many_batches_without_a_cross_join(spark):
    path = work_dir(spark, "snapshots")
    batches = spark.createDataFrame([(f"b{i}", i % 3 == 0) for i in range(30)], "batch_id STRING, wants_terms BOOLEAN")
    out = sn.freeze_snapshot(library(spark, *[(i, f"t{i}") for i in range(50)]), batches, path)
    assert out.count() == 500 == out.distinct().count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
