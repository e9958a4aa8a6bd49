"""A batch of changes against a row-by-row account of the same batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meritpool.operators.ids import assign_ids, highest_id
from meritpool.plans import changes as ch
from meritpool.sources import writers as wr
from tests.conftest import rows

RESULTS = (
    "id bigint, academic_period_id bigint, student_id bigint, student_enrollment_id bigint, "
    "criterion_id bigint, grade_at_result smallint, grade_track string, base_score decimal(12,4), "
    "dynamic_bonus decimal(12,4), total_score decimal(12,4), raw_result_value string, "
    "result_date date, source_type string, comment string, created_by_user_id bigint, "
    "created_at timestamp, updated_at timestamp"
)
CHANGES = (
    "change_id bigint, op string, result_id bigint, student_id bigint, criterion_id bigint, "
    "grade_at_result smallint, grade_track string, dynamic_bonus string, "
    "raw_result_value string, result_date string, comment string"
)
OLD = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def base(spark):
    from decimal import Decimal as D

    results = [
        (i, 1 + i % 2, 1 + i % 3, None, 1, 9, "regular", D(1), D(0), D(1), "v", None, "excel_import",
         None, 77, OLD, OLD)
        for i in range(1, 9)
    ]
    return {
        "results": spark.createDataFrame(results, RESULTS),
        "students": spark.createDataFrame([(1,), (2,), (3,)], "id bigint"),
        "criteria": spark.createDataFrame([(1, "2.5"), (2, "4")], "id bigint, s string")
        .select("id", F.col("s").cast("decimal(12,4)").alias("base_score")),
        "enrollments": spark.createDataFrame(
            [(10, 1, 1, 9, "regular"), (9, 1, 1, 9, "regular"), (11, 1, 2, 9, "regular"),
             (12, 2, 1, 11, "course")],
            "id bigint, student_id bigint, academic_period_id bigint, grade smallint, grade_track string",
        ),
        "periods": spark.createDataFrame([(1, "now"), (2, "old")], "id bigint, name string"),
    }


def batch(spark, base, changes, period="now", folder=None):
    return ch.ChangeBatch(
        spark.createDataFrame(changes, CHANGES), base["results"], base["students"],
        base["criteria"], base["enrollments"], base["periods"], period,
        with_ids=lambda new: assign_ids(new, ["change_id"], highest_id(base["results"])),
        folder=folder,
    )


def test_create(spark, base):
    got = batch(spark, base, [
        (1, "create", None, 1, 1, 9, "regular", "", "", "2024-05-06", ""),
        (2, "create", None, 2, 2, 10, "regular", "1.5", "90", "", "note"),
    ])
    one, two = got.created.orderBy("change_id").collect()
    assert (one.student_enrollment_id, float(one.total_score), one.raw_result_value) == (9, 2.5, None)
    assert one.result_date == dt.date(2024, 5, 6) and one.comment is None
    assert (two.student_enrollment_id, float(two.total_score), two.comment) == (None, 5.5, "note")
    assert {one.source_type, two.source_type} == {"web_form"}
    assert sorted([one.id, two.id]) == [9, 10]
    after = got.results_after
    assert after.count() == 10
    assert after.where("id > 8 and created_at > '2021-01-01'").count() == 2


def test_update_keeps_period_and_touches(spark, base):
    got = batch(spark, base, [
        (1, "update", 3, 1, 2, 9, "regular", "1", "x", "", "first"),
        (2, "update", 3, 1, 1, 9, "regular", "", "", "", ""),
    ])
    after = {r.id: r for r in got.results_after.collect()}
    row = after[3]
    assert (row.academic_period_id, row.student_enrollment_id) == (2, 11)
    assert (float(row.total_score), row.comment, row.source_type) == (2.5, None, "web_form_edit")
    assert row.created_by_user_id == 77 and row.created_at == OLD and row.updated_at > OLD
    assert after[4].updated_at == OLD
    assert got.log.count() == 2


def test_delete_takes_children(spark, base):
    got = batch(spark, base, [(1, "delete", 2) + (None,) * 8, (2, "delete", 2) + (None,) * 8])
    links = spark.createDataFrame([(2, 5), (3, 5)], "student_result_id bigint, teacher_id bigint")
    assert rows(got.children_after(links)) == [(3, 5)]
    assert got.results_after.where("id = 2").count() == 0
    assert [(r.change_id, r.rules) for r in got.rejected.collect()] == [(2, ["result_known"])]
    assert [(r.entity_id, r.details) for r in got.log.collect()] == [("2", "{}")]


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ((1, "merge", 1, 1, 1, 9, "regular", "", "", "", ""), "op_known"),
        ((1, None, 1, 1, 1, 9, "regular", "", "", "", ""), "op_known"),
        ((1, "create", None, 0, 1, 9, "regular", "", "", "", ""), "fields_required"),
        ((1, "create", None, 1, 1, 9, "", "", "", "", ""), "fields_required"),
        ((1, "update", None, 1, 1, 9, "regular", "", "", "", ""), "result_required"),
        ((1, "delete", 0) + (None,) * 8, "result_known"),
        ((1, "update", 1, None, 1, 9, "regular", "", "", "", ""), "not_null"),
        ((1, "create", None, 1, 1, 12, "regular", "", "", "", ""), "grade_range"),
        ((1, "create", None, 1, 1, 9, "evening", "", "", "", ""), "track_word"),
        ((1, "create", None, 1, 1, 9, "regular", "x", "", "", ""), "bonus_number"),
        ((1, "create", None, 1, 1, 9, "regular", "-1", "", "", ""), "bonus_not_negative"),
        ((1, "create", None, 1, 1, 9, "regular", "", "", "31.12.24", ""), "date_valid"),
        ((1, "create", None, 1, 1, 9, "regular", "", "x" * 101, "", ""), "value_length"),
        ((1, "create", None, 1, 7, 9, "regular", "", "", "", ""), "criterion_known"),
        ((1, "create", None, 9, 1, 9, "regular", "", "", "", ""), "student_known"),
        ((1, "update", 99, 1, 1, 9, "regular", "", "", "", ""), "result_known"),
    ],
)
def test_rejects(spark, base, change, rule):
    got = batch(spark, base, [change])
    assert rule in got.rejected.first().rules
    assert got.accepted.count() == 0


def test_unknown_period_rejects_creates_only(spark, base):
    got = batch(spark, base, [
        (1, "create", None, 1, 1, 9, "regular", "", "", "", ""),
        (2, "update", 1, 1, 1, 9, "regular", "", "", "", ""),
    ], period="none")
    assert [(r.change_id, r.rules) for r in got.rejected.collect()] == [(1, ["period_known"])]
    assert got.updated.count() == 1


@pytest.mark.parametrize("written", [False, True])
def test_batch_like_one_by_one(spark, base, written, tmp_path):
    """Random changes, many of them to the same result."""
    rng = random.Random(5)
    changes = []
    for n in range(1, 61):
        op = rng.choice(["create", "update", "update", "update", "delete"])
        result = None if op == "create" else rng.choice([1, 1, 1, 2, 3, 4, 5, 99])
        if op == "delete" and rng.random() < 0.6:
            op = "update"
        payload = (None,) * 8 if op == "delete" else (
            rng.choice([1, 2, 3, 4]), rng.choice([1, 2, 5]), rng.choice([9, 11, 12]),
            rng.choice(["regular", "course"]), rng.choice(["", "2", "bad"]), "v", "", f"c{n}",
        )
        changes.append((n, op, result, *payload))
    alive = {r.id: None for r in base["results"].collect()}
    created, rejected = set(), set()
    for n, op, result, *p in changes:
        fields = op == "delete" or (p[0] <= 3 and p[1] <= 2 and p[2] <= 11 and p[4] != "bad")
        if not fields or (op != "create" and result not in alive):
            rejected.add(n)
        elif op == "create":
            created.add(n)
        elif op == "update":
            alive[result] = f"c{n}"
        else:
            del alive[result]
    got = batch(spark, base, changes, folder=str(tmp_path) if written else None)
    assert {r.change_id for r in got.rejected.collect()} == rejected
    assert {r.change_id for r in got.created.collect()} == created
    after = {r.id: r.comment for r in got.results_after.where("id <= 8").collect()}
    assert after == alive
    assert got.results_after.count() == len(alive) + len(created)
    assert got.log.count() == len(changes) - len(rejected)
    assert got.accepted.count() + got.rejected.count() == len(changes)


def test_only_touched_periods_are_rewritten(spark, base, tmp_path):
    path = str(tmp_path / "results")
    wr.replace_periods(base["results"], path, [1, 2])
    before = dict(wr.period_folders(spark, path))
    stored = wr.read_periods(spark, path, base["results"].schema)
    got = batch(spark, {**base, "results": stored}, [
        (1, "update", 3, 1, 2, 9, "regular", "1", "x", "", "new"),
        (2, "delete", 1) + (None,) * 8,
    ])
    assert got.touched_periods == [2]
    expected = rows(got.results_after.select("id", "comment", "academic_period_id"))
    wr.replace_periods(got.results_after, path, got.touched_periods)
    back = wr.read_periods(spark, path, base["results"].schema)
    assert rows(back.select("id", "comment", "academic_period_id")) == expected
    assert back.count() == 7
    after = dict(wr.period_folders(spark, path))
    assert after[1] == before[1] and after[2] != before[2]


def test_oversized_sums_are_rejected(spark, base):
    """Each number fits its column, their sum does not."""
    large = base["criteria"].withColumn("base_score", F.lit("99999999").cast("decimal(12,4)"))
    got = batch(spark, {**base, "criteria": large}, [
        (1, "create", None, 1, 1, 9, "regular", "99999999", "", "", ""),
        (2, "update", 3, 1, 1, 9, "regular", "99999999", "", "", ""),
        (3, "create", None, 1, 1, 9, "regular", "0.5", "", "", ""),
    ])
    assert [(r.change_id, r.rules) for r in got.rejected.orderBy("change_id").collect()] == [
        (1, ["total_score_precision"]), (2, ["total_score_precision"])]
    assert got.created.count() == 1 and got.results_after.count() == 9


def test_small_batch_does_not_shuffle_the_table(spark, base, tmp_path):
    """The table is filtered and rewritten against broadcast keys."""
    path = str(tmp_path / "results")
    wr.append(base["results"], path, ["academic_period_id"])
    stored = spark.read.schema(base["results"].schema).parquet(path)
    got = batch(spark, {**base, "results": stored}, [(1, "delete", 1) + (None,) * 8])
    one = got.results_after.where("academic_period_id = 2")
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scan = next(x for x in plan.splitlines() if "FileScan" in x and str(tmp_path) in x and "base_score" in x)
    assert "PartitionFilters: [isnotnull(academic_period_id" in scan
    assert "BroadcastHashJoin" in plan
