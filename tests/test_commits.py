"""Commits over several tables: all or nothing, one of two writers, few files."""

import re
from threading import Thread

import pytest
from pyspark.sql import functions as F

from meritpool.sources.commits import CommitConflict, Store, upsert_files
from tests.conftest import rows

SCHEMA = "id bigint, v string"


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_tables_change_together(spark, store):
    schema = frame(spark, (1, "a")).schema
    assert store.version() == 0 and store.read("one", schema).collect() == []
    change = store.begin()
    change.replace("one", frame(spark, (1, "a")))
    change.replace_slices("two", frame(spark, (1, "x"), (2, "y")), "id", [1, 2])
    assert store.version() == 0 and store.read("one", schema).collect() == []
    assert change.commit() == 1
    change = store.begin()
    change.append("one", frame(spark, (2, "b")))
    change.replace_slices("two", frame(spark, (2, "z"), (3, "not named")), "id", [2, 4])
    assert change.commit() == 2
    assert rows(store.read("one", schema)) == [(1, "a"), (2, "b")]
    assert rows(store.read("two", schema)) == [(1, "x"), (2, "z")]
    assert rows(store.read("one", schema, version=1)) == [(1, "a")]
    assert rows(store.read("two", schema, version=1)) == [(1, "x"), (2, "y")]


def test_of_two_writers_one_fails_and_changes_nothing(spark, store):
    schema = frame(spark, (1, "a")).schema
    one, two = store.begin(), store.begin()
    one.replace("t", frame(spark, (1, "one")))
    two.replace("t", frame(spark, (1, "two")))
    two.replace("u", frame(spark, (1, "two")))
    assert one.commit() == 1
    with pytest.raises(CommitConflict):
        two.commit()
    assert store.version() == 1 and list(store.tables()) == ["t"]
    assert rows(store.read("t", schema)) == [(1, "one")]
    again = store.begin()
    again.append("t", frame(spark, (2, "two")))
    assert again.commit() == 2


def test_no_update_is_lost(spark, store):
    """Many writers, each beginning anew after a conflict."""

    def write(n):
        while True:
            change = store.begin()
            change.append("t", frame(spark, (n, "x")))
            try:
                change.commit()
                return
            except CommitConflict:
                continue

    threads = [Thread(target=write, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.version() == 6
    assert [r.id for r in store.read("t", frame(spark, (1, "x")).schema).orderBy("id").collect()] == list(range(6))


def many_files(spark, store, key=None):
    df = spark.range(0, 4000, 1, 8).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"))
    change = store.begin()
    change.replace("t", df, key=key)
    change.commit()
    return df


def test_an_upsert_of_one_key_rewrites_one_file(spark, store):
    schema = many_files(spark, store).schema
    before = set(store.files("t"))
    version, files = upsert_files(store, "t", schema, frame(spark, (700, "new")), ["id"], ["v"])
    after = set(store.files("t"))
    assert version == 2 and len(files) == 1 and len(before - after) == 1 and len(before & after) == len(before) - 1
    table = store.read("t", schema)
    assert table.count() == 4000 and table.where("v = 'new'").collect()[0].id == 700
    assert store.read("t", schema, version=1).where("v = 'new'").count() == 0


def test_an_upsert_inserts_what_no_file_holds(spark, store):
    schema = many_files(spark, store).schema
    assert upsert_files(store, "t", schema, frame(spark, (9000, "new")), ["id"], ["v"])[1] == []
    assert upsert_files(store, "t", schema, frame(spark, (9000, "newer"), (9001, "new"), (3, "x")), ["id"], ["v"])[0] == 3
    table = {r.id: r.v for r in store.read("t", schema).collect()}
    assert len(table) == 4002 and (table[9000], table[9001], table[3]) == ("newer", "new", "x")
    empty = Store(spark, store.root + "-empty")
    change = empty.begin()
    change.replace("t", spark.createDataFrame([], schema))
    change.commit()
    upsert_files(empty, "t", schema, frame(spark, (1, "a")), ["id"], ["v"])
    assert rows(empty.read("t", schema)) == [(1, "a")]


def test_newest_rows_come_from_few_files(spark, store):
    schema = many_files(spark, store, key="id").schema
    newest = store.newest("t", schema, 300)
    assert [r.id for r in newest.collect()] == list(range(3999, 3699, -1))
    assert len(newest.inputFiles()) == 1
    assert [r.id for r in store.newest("t", schema, 700).collect()] == list(range(3999, 3299, -1))
    upsert_files(store, "t", schema, frame(spark, (3998, "new"), (5000, "new")), ["id"], ["v"], stats_key="id")
    got = store.newest("t", schema, 3).collect()
    assert [(r.id, r.v) for r in got] == [(5000, "new"), (3999, "v3999"), (3998, "new")]
    assert store.newest("t", schema, 10_000).count() == 4001
    assert store.newest("none", schema, 5).collect() == []


def test_a_filter_by_slice_prunes_folders(spark, store):
    change = store.begin()
    change.replace_slices("t", frame(spark, (1, "a"), (2, "b")), "id", [1, 2])
    change.commit()
    plan = store.read("t", frame(spark, (1, "a")).schema).where("id = 2")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*id", plan)
