"""Deletes against a row-by-row account of the same references."""

import random

from pyspark.sql import functions as F

from meritpool import schemas
from meritpool.operators import quality
from meritpool.operators.deletes import deletion, parents_first
from tests.conftest import rows

COLUMNS = {
    "academic_periods": ["id"], "students": ["id"], "teachers": ["id"], "criterion_groups": ["id"],
    "criteria": ["id", "criterion_group_id"], "criterion_grade_weights": ["id", "criterion_id"],
    "student_enrollments": ["id", "student_id", "academic_period_id"],
    "student_teacher_assignments": ["id", "student_id", "teacher_id", "academic_period_id"],
    "student_results": ["id", "academic_period_id", "student_id", "student_enrollment_id", "criterion_id"],
    "student_result_teacher_links": ["id", "student_result_id", "teacher_id"],
    "calculation_settings": ["id", "academic_period_id"],
    "teacher_calculations": ["id", "academic_period_id", "teacher_id"],
    "teacher_calculation_items": ["id", "teacher_calculation_id", "student_result_id", "student_id"],
}


def made(seed):
    rng = random.Random(seed)
    sizes = {"academic_periods": 4, "students": 9, "teachers": 5, "criterion_groups": 3, "criteria": 6}
    tables = {}
    for name, columns in COLUMNS.items():
        parents = {r.column: r.table for r in schemas.ALL[name].references}
        tables[name] = [
            {c: n if c == "id" else rng.choice([*range(sizes.get(parents[c], 14)), None]) for c in columns}
            for n in range(sizes.get(name, 14))
        ]
    return tables


def plain(tables, deleted):
    """Rows go one by one until nothing more goes."""
    gone = {name: set(ids) & {r["id"] for r in tables[name]} for name, ids in deleted.items()}
    gone = {name: gone.get(name, set()) for name in tables}
    changed = True
    while changed:
        changed = False
        for name, held in tables.items():
            for ref in schemas.ALL[name].references:
                for r in held:
                    if ref.on_delete == "cascade" and r[ref.column] in gone[ref.table] and r["id"] not in gone[name]:
                        gone[name].add(r["id"])
                        changed = True
    after, refused = {}, set()
    for name, held in tables.items():
        after[name] = []
        for r in held:
            if r["id"] in gone[name]:
                continue
            r = dict(r)
            for ref in schemas.ALL[name].references:
                if r[ref.column] in gone[ref.table]:
                    if ref.on_delete == "set_null":
                        r[ref.column] = None
                    elif ref.on_delete == "restrict":
                        refused.add((ref.table, f"used_by_{name}", str(r[ref.column])))
            after[name].append(tuple(r.values()))
    return after, gone, refused


def frames(spark, tables):
    return {
        name: spark.createDataFrame([tuple(r.values()) for r in held], ", ".join(f"{c} bigint" for c in COLUMNS[name]))
        for name, held in tables.items()
    }


def keys(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def test_closure_against_one_row_after_the_other(spark):
    for seed, deleted in enumerate([
        {"students": [1, 2, 2, 99]}, {"academic_periods": [0, 3], "teachers": [1, 4]},
        {"criterion_groups": [1], "criteria": [0, 5], "student_results": [3], "student_enrollments": [2, 7]},
        {"teachers": []},
    ]):
        tables = made(seed)
        got = deletion(frames(spark, tables), {n: keys(spark, ids) for n, ids in deleted.items()})
        after, gone, refused = plain(tables, deleted)
        for name in tables:
            assert rows(got.after[name]) == sorted(after[name], key=repr), (deleted, name)
            found = {r.id for r in got.gone[name].collect()} if name in got.gone else set()
            assert found == gone[name], (deleted, name)
        assert {tuple(r) for r in got.refused.collect()} == refused, deleted


def test_a_student_takes_links_and_items_of_the_results_along(spark):
    given = {
        "student_results": spark.createDataFrame([(1, 7), (2, 8)], "id bigint, student_id bigint"),
        "student_result_teacher_links": spark.createDataFrame([(1, 5), (2, 5)], "student_result_id bigint, teacher_id bigint"),
        "teacher_calculation_items": spark.createDataFrame([(1, "a"), (2, "b")], "student_result_id bigint, note string"),
    }
    left = quality.cascade(keys(spark, [7]), [(schemas.ALL[n], df) for n, df in given.items()], schemas.STUDENTS)
    assert rows(left["student_result_teacher_links"]) == [(2, 5)]
    assert rows(left["teacher_calculation_items"]) == [(2, "b")]


def test_a_teacher_named_below_a_period(spark):
    """The period takes its rows along; only rows that stay hold a teacher back."""
    results = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, academic_period_id bigint")
    links = spark.createDataFrame([(1, 5), (1, 6), (2, 6)], "student_result_id bigint, teacher_id bigint")
    tables = {"academic_periods": keys(spark, [1, 2]), "teachers": keys(spark, [5, 6]),
              "student_results": results, "student_result_teacher_links": links}
    got = deletion(tables, {"academic_periods": keys(spark, [1]), "teachers": keys(spark, [5, 6])})
    assert rows(got.refused) == [("teachers", "used_by_student_result_teacher_links", "6")]
    alone = deletion(tables, {"teachers": keys(spark, [5])})
    assert rows(alone.refused) == [("teachers", "used_by_student_result_teacher_links", "5")]


def test_order_of_tables():
    order = parents_first(COLUMNS)
    for name in COLUMNS:
        assert all(order.index(r.table) < order.index(name) for r in schemas.ALL[name].references)


def test_a_small_batch_does_not_shuffle_the_tables(spark, tmp_path):
    for name in ("student_results", "student_result_teacher_links"):
        rows_of = spark.range(2000).select(F.col("id"), (F.col("id") % 50).alias("student_id"), F.col("id").alias("student_result_id"))
        rows_of.write.parquet(str(tmp_path / name))
    given = {n: spark.read.parquet(str(tmp_path / n)) for n in ("student_results", "student_result_teacher_links")}
    left = deletion(given, {"students": keys(spark, [3])}).after["student_result_teacher_links"]
    assert left.count() == 1960
    left.collect()
    plan = left._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
