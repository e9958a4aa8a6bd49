"""Batches loaded twice, corrected, and out of order."""

import random

from pyspark.sql import functions as F

from meritpool.plans import loads as ld
from meritpool.sources.commits import Store
from tests.conftest import rows

SCHEMA = "batch_id string, key string, score bigint"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def ledger_of(spark):
    return spark.createDataFrame([], ld.ledger_schema(frame(spark, []).schema["batch_id"].dataType))


A = [("a", "1", 5), ("a", "1", 5), ("a", "2", None)]
B = [("b", "1", 7)]
FIXED = [("a", "1", 6)]
UNNAMED = [(None, "9", 1)]


def test_the_same_batch_twice_gives_the_same_table(spark):
    table, ledger = ld.loaded(frame(spark, []), ledger_of(spark), frame(spark, A + B + UNNAMED))
    assert rows(table) == sorted(A + B + UNNAMED, key=repr)
    again, same = ld.loaded(table, ledger, frame(spark, list(reversed(A)) + UNNAMED).repartition(3))
    assert rows(again) == rows(table) and rows(same) == rows(ledger)


def test_a_corrected_batch_replaces_its_own_rows_only(spark):
    table, ledger = ld.loaded(frame(spark, A + B), ledger_of(spark), frame(spark, A + B))
    table, ledger = ld.loaded(table, ledger, frame(spark, FIXED + UNNAMED))
    assert rows(table) == sorted(FIXED + B + UNNAMED, key=repr)
    assert {(r.batch_id, r.n_rows) for r in ledger.collect()} == {("a", 1), ("b", 1), (None, 1)}


def test_a_load_of_nothing_changes_nothing(spark):
    table, ledger = ld.loaded(frame(spark, A), ledger_of(spark), frame(spark, []))
    assert rows(table) == sorted(A, key=repr) and ledger.count() == 0


def test_digests_tell_rows_apart(spark):
    """Order does not count; a copy, a value, or a null in another column does."""
    def digest(data):
        return ld.batch_digests(frame(spark, data)).first().digest

    data = [("a", str(n), n) for n in range(50)]
    shuffled = random.Random(1).sample(data, 50)
    assert digest(data) == digest(shuffled)
    assert len({digest(x) for x in (data, data[:-1], [*data, data[0]], [*data[:-1], ("a", "49", 48)])}) == 4
    assert digest([("a", None, None)]) != digest([("a", None, 42)]) != digest([("a", "x", None)])
    one, two = [("a", "x", None), ("a", None, 3)], [("a", "x", 3), ("a", None, None)]
    assert digest(one) != digest(two)


def test_batches_in_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    schema = frame(spark, []).schema
    assert ld.load_batches(store, "rows", frame(spark, A + B)) == ["a", "b"]
    before = dict(store.tables()["rows"]["slices"])
    assert ld.load_batches(store, "rows", frame(spark, A + B)) == [] and store.version() == 1
    assert ld.load_batches(store, "rows", frame(spark, FIXED + B)) == ["a"]
    assert rows(store.read("rows", schema)) == sorted(FIXED + B, key=repr)
    after = dict(store.tables()["rows"]["slices"])
    assert after["b"] == before["b"] and after["a"] != before["a"]
    assert rows(store.read("rows", schema, version=1)) == sorted(A + B, key=repr)
    ledger = store.read(f"rows_{ld.LOADS}", ledger_of(spark).schema)
    assert {(r.batch_id, r.n_rows) for r in ledger.collect()} == {("a", 1), ("b", 1)}


def test_a_failed_load_leaves_table_and_ledger(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ld.load_batches(store, "rows", frame(spark, A))
    broken = frame(spark, FIXED).withColumn("key", F.when(F.col("score") == 6, F.raise_error(F.lit("stop"))).cast("string"))
    try:
        ld.load_batches(store, "rows", broken)
    except Exception as error:
        assert "stop" in str(error)
    assert store.version() == 1
    assert ld.load_batches(store, "rows", frame(spark, A)) == []
