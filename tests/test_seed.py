"""The whole way on the seed: import, summary, snapshot, card."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from meritpool import schemas
from meritpool.operators.quality import conform, row_violations, unique_violations
from meritpool.plans import imports as im
from meritpool.plans import snapshot as sn
from meritpool.plans import summary as su
from tests import seed
from tests.conftest import rows


@pytest.fixture(scope="module")
def imported(spark):
    tables = seed.base_tables(spark)
    results, matrix = seed.staged(spark)
    students = im.new_students(tables.students, results, matrix).cache()
    none = spark.createDataFrame([], schemas.ENROLLMENTS.struct)
    enrollments = im.enrollment_inserts(
        im.new_enrollments(none, matrix, students, tables.periods, seed.PERIOD), none
    ).cache()
    none = spark.createDataFrame([], schemas.ASSIGNMENTS.struct)
    assignments = im.assignment_inserts(
        im.new_assignments(none, matrix, students, tables.teachers, tables.periods, seed.PERIOD),
        none,
    ).cache()
    loaded, rejected = im.import_results(
        results, students, enrollments, tables.criteria, tables.periods, seed.PERIOD
    )
    none = spark.createDataFrame([], schemas.RESULTS.struct)
    loaded = im.result_inserts(loaded, none).cache()
    return replace(
        tables, students=students, enrollments=enrollments, assignments=assignments,
        results=loaded,
    ), rejected


def test_counts_of_the_import(imported):
    tables, rejected = imported
    assert tables.students.count() == 14
    assert tables.assignments.count() == 72
    assert tables.enrollments.count() == 72
    assert tables.results.count() == 14
    assert rejected.count() == 0
    ids = [r.id for r in tables.students.collect()]
    assert sorted(ids) == list(range(1, 15))


def test_grade_picks(imported):
    tables, _ = imported
    picks = im.grade_picks(tables.students, tables.enrollments, tables.periods, seed.PERIOD)
    named = picks.join(tables.students.select(F.col("id").alias("student_id"), "full_name"), "student_id")
    got = {
        r.full_name.strip().upper(): (r.picked_grade, r.picked_track) for r in named.collect()
    }
    others = {"S08": (9, "regular"), "S09": (10, "regular"), "S10": (9, "regular")}
    expected = {s: others.get(s, (11, "course")) for s, *_ in seed.MATRIX}
    assert got == expected


def test_imported_rows_carry_enrollment_and_mismatch(imported):
    tables, _ = imported
    got = tables.results.collect()
    assert all(r.student_enrollment_id is not None for r in got)
    assert {r.comment for r in got} == {im.COMMENT_MISMATCH}
    assert {r.source_type for r in got} == {"excel_import"}
    assert {r.result_date for r in got} == {None}


def test_summary_is_the_expected_one(imported):
    tables, _ = imported
    got = {r.teacher_short_name: r for r in su.teacher_summary(tables).collect()}
    assert sorted(got) == [e[0] for e in seed.SUMMARY]
    for name, n, total, raw, factor, points, share, weight, employee, incentive, fund in seed.SUMMARY:
        r = got[name]
        assert (r.student_count_with_results, r.total_student_count) == (n, total)
        assert float(r.raw_points) == raw
        assert r.avg_group_size == pytest.approx(2.8)
        assert r.normalization_factor == pytest.approx(factor, abs=1e-6)
        assert r.normalized_points == pytest.approx(points, abs=1e-6)
        assert r.normalized_share_percent == pytest.approx(share, abs=1e-9)
        assert r.reverse_weight == pytest.approx(weight, abs=1e-9)
        assert r.total_reverse_weight == pytest.approx(0.4102092352, abs=1e-9)
        assert r.employee_share == pytest.approx(employee, abs=1e-9)
        assert r.reverse_incentive_amount == pytest.approx(incentive, abs=1e-4)
        assert r.normalized_fund_amount == pytest.approx(fund, abs=0.01)
        assert float(r.distributable_fund) == 986.94
        assert r.is_dismissed == (name == seed.DISMISSED)


def test_shares_and_funds_add_up(imported):
    tables, _ = imported
    sums = su.teacher_summary(tables).agg(
        F.sum("normalized_share_percent"), F.sum("employee_share"),
        F.sum("reverse_incentive_amount"), F.sum("normalized_fund_amount"),
    ).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)
    assert sums[2] == pytest.approx(986.94) and sums[3] == pytest.approx(986.94)


def test_second_load_changes_nothing(spark, imported):
    tables, _ = imported
    results, matrix = seed.staged(spark)
    assert im.new_students(tables.students, results, matrix).count() == 0
    again = im.new_enrollments(
        tables.enrollments, matrix, tables.students, tables.periods, seed.PERIOD
    )
    assert again.count() == 0
    again = im.new_assignments(
        tables.assignments, matrix, tables.students, tables.teachers, tables.periods, seed.PERIOD
    )
    assert again.count() == 0


def test_snapshot_rounds_by_type_and_fits_its_rules(imported):
    tables, _ = imported
    stored = sn.snapshot_rows(tables, [1])
    got = {r.teacher_id: r for r in stored.collect()}
    assert str(got[8].normalized_points) == "30.8000"
    assert str(got[8].reverse_weight) == "0.0129870130"
    assert str(got[8].uvsotr_amount) == "31.2460"
    assert str(got[8].final_amount) == "266.96"
    assert got[8].avg_group_ratio is None
    assert got[17].is_dismissed_snapshot is True
    full = conform(stored.withColumn("id", F.col("teacher_id")), schemas.CALCULATIONS)
    assert row_violations(full, schemas.CALCULATIONS).count() == 0
    assert unique_violations(full, schemas.CALCULATIONS).count() == 0


def test_no_settings_no_amounts(spark, imported):
    tables, _ = imported
    bare = replace(tables, settings=tables.settings.limit(0))
    got = su.teacher_summary(bare).collect()
    assert {r.normalized_fund_amount for r in got} == {None}
    assert {r.distributable_fund for r in got} == {None}
    assert sum(r.employee_share for r in got) == pytest.approx(1)
    stored = sn.snapshot_rows(bare, [1]).collect()
    assert {float(r.final_amount) for r in stored} == {0.0}


def test_other_period_has_no_rows(imported):
    tables, _ = imported
    assert su.teacher_summary(tables, periods=[2]).count() == 0
    assert sn.snapshot_rows(tables, [2]).count() == 0


def test_inactive_assignment_counts_for_nothing(imported):
    tables, _ = imported
    idle = tables.assignments.withColumn("is_active", F.col("teacher_id") != 8)
    got = {r.teacher_short_name for r in su.teacher_summary(replace(tables, assignments=idle)).collect()}
    assert got == {e[0] for e in seed.SUMMARY} - {"T08"}


def test_student_assigned_twice_counts_twice(imported):
    tables, _ = imported
    first = tables.assignments.where("teacher_id = 1")
    twice = tables.assignments.unionByName(
        first.withColumn("assignment_type", F.lit("curator"))
        .withColumn("share_percent", F.lit(50).cast("decimal(5,2)"))
    )
    got = su.teacher_summary(replace(tables, assignments=twice)).where("teacher_short_name = 'T01'").first()
    assert (float(got.raw_points), got.student_count_with_results, got.total_student_count) == (9, 1, 1)


def test_hot_name_is_split(spark, imported):
    """Most rows, copies of each other, under one name: no row is lost and the
    join by name is split."""
    tables, _ = imported
    results, _ = seed.staged(spark)
    one = results.where("row_key = 'r0'")
    number = F.explode(F.sequence(F.lit(1), F.lit(20_000)))
    copies = one.withColumn("n", number).withColumn(
        "row_key", F.concat_ws("-", "row_key", F.col("n").cast("string"))
    ).drop("n")
    staged = results.unionByName(copies).repartition(6, "row_key")
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        loaded, _ = im.import_results(
            staged, tables.students, tables.enrollments, tables.criteria, tables.periods, seed.PERIOD
        )
        got = loaded.groupBy("student_id").count().collect()
        only = loaded.select("row_key", "student_id")
        only.collect()
        plan = only._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for key in small:
            spark.conf.unset(key)
    assert sorted(r["count"] for r in got) == [1] * 13 + [20_001]
    assert "skew=true" in plan


def test_import_edges(spark, imported):
    """A student only in the 11 practicum is booked as regular without an
    enrollment; one never enrolled is rejected; unknown names drop."""
    tables, _ = imported
    students = spark.createDataFrame([(1, "A"), (2, "B")], "id bigint, full_name string")
    enrollments = spark.createDataFrame(
        [(7, 1, 1, 11, "practicum")],
        "id bigint, student_id bigint, academic_period_id bigint, grade smallint, grade_track string",
    )
    staged = spark.createDataFrame(
        [("r1", "a", "ЕГЭ 50–59", "1", None), ("r2", "B ", "ЕГЭ 50–59", "2", None),
         ("r3", "C", "ЕГЭ 50–59", "2", None), ("r4", "A", "none", "2", None)],
        "row_key string, student_name string, criterion_name string, base_score string, dynamic_bonus string",
    ).withColumn("base_score", F.col("base_score").cast("decimal(12,4)")).withColumn(
        "dynamic_bonus", F.col("dynamic_bonus").cast("decimal(12,4)")
    )
    loaded, rejected = im.import_results(
        staged, students, enrollments, tables.criteria, tables.periods, seed.PERIOD
    )
    got = loaded.first()
    assert loaded.count() == 1
    assert (got.row_key, got.grade_at_result, got.grade_track) == ("r1", 11, "regular")
    assert got.student_enrollment_id is None and got.comment == im.COMMENT
    assert (float(got.dynamic_bonus), float(got.total_score)) == (0, 1)
    assert [(r.row_key, r.rules) for r in rejected.collect()] == [("r2", ["grade_at_result_required"])]


def test_teachers_of_one_name_are_diverted(imported):
    """Both rows would go under the smaller id, against the unique rule."""
    tables, _ = imported
    name = F.when(F.col("id").isin(1, 2), F.lit("Same")).otherwise(F.col("full_name"))
    same = replace(tables, teachers=tables.teachers.withColumn("full_name", name))
    stored, rejects = sn.snapshot_rows(same, [1]), sn.snapshot_rejects(same, [1])
    assert sorted(r.teacher_id for r in stored.collect())[:2] == [3, 4]
    assert [(r.teacher_id, r.rules) for r in rejects.collect()] == [
        (1, ["academic_period_id_teacher_id_unique"])] * 2
    assert unique_violations(stored, schemas.CALCULATIONS).count() == 0
    assert stored.count() + rejects.count() == sn.snapshot_rows(tables, [1]).count()


def test_null_scores_are_rejected(imported, spark):
    tables, _ = imported
    results, _ = seed.staged(spark)
    first = results.orderBy("row_key").first().row_key
    score = F.when(F.col("row_key") != first, F.lit(99999998)).cast("decimal(12,4)")
    bad = results.withColumns(
        {"base_score": score, "dynamic_bonus": F.lit("99999999").cast("decimal(12,4)")}
    )
    loaded, rejected = im.import_results(
        bad, tables.students, tables.enrollments, tables.criteria, tables.periods, seed.PERIOD
    )
    rules = sorted(",".join(r.rules) for r in rejected.collect())
    assert loaded.count() == 0
    assert rules == ["base_score_required"] + ["total_score_precision"] * 13
