"""Stored tables: merges by the bucket, old versions, failures, other writers."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import outputs, upserts
from siltstone.operators.stored import StoredTable
from siltstone.sources.shared import Workspace, versions

SCHEMA = "k int, name string, conf double, src string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(found):
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.fixture
def table(spark):
    old = [(k, f"n{k}", 0.5, "old") for k in range(400)] + [(None, "none", 0.5, "old")]
    return StoredTable.create(frame(spark, old).repartition(3), Workspace(spark, "stored").root, ["k"], buckets=32)


def test_a_merge_writes_the_buckets_of_its_keys_only(spark, table):
    before, first = table.manifest(), rows_of(table.read())
    new = frame(spark, [(k, "new", 0.9, "new") for k in range(395, 405)])
    touched = table.merge(new, lambda a, b: upserts.upsert(a, b, ["k"]))
    after = table.manifest()
    assert len(touched) <= 10 and {b for b in after if after[b] != before.get(b)} == touched and table.version() == 2
    assert rows_of(table.read()) == rows_of(upserts.upsert(table.read(1), new, ["k"])) != first
    assert rows_of(table.read(1)) == first  # whoever reads the old version still does
    plan = [f for f in table.read(buckets=touched).inputFiles()]
    assert plan and all("/data/2/" in f for f in plan)


@pytest.mark.parametrize(
    "how",
    [
        lambda a, b: upserts.upsert(a, b, ["k"]),
        lambda a, b: upserts.insert_absent(a, b, ["k"]),
        lambda a, b: upserts.upsert_if_surer(a, b, ["k"], "conf", ["src"]),
        lambda a, b: upserts.fill_blanks(a, b, ["k"]),
        lambda a, b: upserts.upsert(a, b, ["k"], fill=True),
    ],
)
def test_merges_equal_those_of_whole_tables(spark, table, how):
    new = frame(spark, [(k, None if k % 2 else "new", k / 500, "new") for k in range(0, 500, 7)] + [(None, "x", 0.9, "new")])
    want = rows_of(how(table.read(), new))
    table.merge(new, how)
    assert rows_of(table.read()) == want and sum(n for _, n in table.manifest().values()) == len(want)


def test_a_failed_merge_changes_nothing(spark, table):
    first, manifest = rows_of(table.read()), table.manifest()
    new = frame(spark, [(1, "x", 0.1, "s")])
    with pytest.raises(Exception, match="lost"):
        table.merge(new, lambda a, b: a.withColumn("name", F.raise_error("lost").cast("string")))
    with pytest.raises(ValueError, match="key"):
        table.merge(new, lambda a, b: a.withColumn("k", F.col("k") + 1000))
    assert rows_of(table.read()) == first and table.manifest() == manifest and table.version() == 1
    table.merge(new, lambda a, b: upserts.upsert(a, b, ["k"]))
    assert table.read().where("name = 'x'").count() == 1 and table.version() > 1


def test_of_two_writers_one_merges_again(spark, table):
    other = StoredTable(spark, table.path)

    def slow(a, b):
        other.merge(frame(spark, [(2, "other", 0.1, "s")]), lambda x, y: upserts.upsert(x, y, ["k"]))
        return upserts.upsert(a, b, ["k"])

    with pytest.raises(RuntimeError, match="meanwhile"):
        table.merge(frame(spark, [(1, "mine", 0.1, "s")]), slow)
    assert {r["name"] for r in table.read().where("k IN (1, 2)").collect()} == {"n1", "other"}
    with pytest.raises(Exception, match="exists|EXISTS"):
        StoredTable.create(frame(spark, []), table.path, ["k"])


def test_rewrites_and_vacuum(spark, table):
    for k in range(3):
        table.merge(frame(spark, [(k, f"v{k}", 0.1, "s")]), lambda a, b: upserts.upsert(a, b, ["k"]))
    table.rewrite(lambda a: upserts.replace_source(a, frame(spark, [(900, "again", 0.1, "old")]), "src", "old"))
    want = rows_of(table.read())
    assert len(want) == 4
    before = rows_of(table.read(table.version() - 1))
    gone = table.vacuum(keep=2)
    assert rows_of(table.read()) == want and rows_of(table.read(table.version() - 1)) == before
    assert not set(gone) & {v for v, _ in table.manifest().values()} and versions(spark, f"{table.path}/manifests") == [4, 5]
    table.vacuum(keep=1)
    assert versions(spark, f"{table.path}/data") == [5]


def test_empty_tables(spark):
    empty = StoredTable.create(frame(spark, []), Workspace(spark, "stored").root, ["k"])
    assert empty.read().count() == 0 and empty.manifest() == {} and empty.merge(frame(spark, []), lambda a, b: b) == set()
    empty.merge(frame(spark, [(1, "a", 0.1, "s")]), lambda a, b: upserts.upsert(a, b, ["k"]))
    assert rows_of(empty.read()) == [(1, "a", 0.1, "s")]
    empty.merge(frame(spark, [(1, "a", 0.1, "s")]), lambda a, b: a.limit(0))
    assert empty.read().count() == 0


def test_a_failed_refresh_keeps_the_view(spark, tmp_path):
    path = str(tmp_path / "view")
    with pytest.raises(FileNotFoundError):
        outputs.refreshed(spark, path)
    outputs.refresh(spark.range(3), path)
    reader = outputs.refreshed(spark, path)
    with pytest.raises(Exception, match="lost"):
        outputs.refresh(spark.range(5).withColumn("id", F.when(F.col("id") == 4, F.raise_error("lost").cast("long")).otherwise(F.col("id"))), path)
    assert outputs.refreshed(spark, path).count() == 3
    outputs.refresh(spark.range(7), path)
    assert outputs.refreshed(spark, path).count() == 7 and reader.count() == 3
    for n in (8, 9):
        outputs.refresh(spark.range(n), path)
    assert len(versions(spark, path)) == 2
