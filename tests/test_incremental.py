"""Stored sums brought up to a batch against a rebuild from the tables."""

import random

import pytest
from pyspark.sql import functions as F

from meritpool.plans import changes as ch
from meritpool.plans import incremental as inc
from meritpool.plans import summary as su
from meritpool.sources.commits import Store
from meritpool.sources.tables import Tables
from tests.conftest import rows
from tests.test_changes import CHANGES


@pytest.fixture(scope="module")
def base(star):
    return Tables(assignments=star.assignments, results=star.results, teachers=star.teachers, periods=star.periods,
                  settings=star.settings, students=star.students, criteria=star.criteria, enrollments=star.enrollments)


def batch_of(spark, base, seed):
    """Random changes to the results of some students, many of them to one result."""
    rng = random.Random(seed)
    known = base.results.orderBy("id").limit(200).collect()
    hot, changes = known[0], []
    for n in range(1, 80):
        row = hot if rng.random() < 0.3 else rng.choice(known)
        op = rng.choice(["create", "update", "update", "delete"])
        result = None if op == "create" else row.id
        payload = (None,) * 8 if op == "delete" else (
            row.student_id, row.criterion_id, row.grade_at_result, row.grade_track, rng.choice(["", "2.5"]), "v", "", "")
        changes.append((n, op, result, *payload))
    schema = CHANGES.replace("result_id bigint", "result_id string")
    return ch.ChangeBatch(
        spark.createDataFrame(changes, schema), base.results, base.students, base.criteria, base.enrollments,
        base.periods, "1997", with_ids=lambda new: new.withColumn("id", F.concat(F.lit("new-"), "change_id")),
    )


def exact(df):
    return rows(df.select(*inc.KEY, F.col("weighted").cast("string"), "n_scored"))


def test_merged_sums_equal_a_rebuild(spark, base):
    batch = batch_of(spark, base, 1)
    merged = inc.sums_after(inc.student_sums(base.assignments, base.results), base.assignments, inc.score_changes(batch))
    rebuilt = inc.student_sums(base.assignments, batch.results_after)
    assert exact(merged) == exact(rebuilt)
    assert exact(merged) != exact(inc.student_sums(base.assignments, base.results))


def test_the_summary_of_the_sums_is_the_summary(base):
    def sorted_rows(df):
        return rows(df.select(*su.SUMMARY_COLUMNS))

    sums = inc.student_sums(base.assignments, base.results)
    assert sorted_rows(inc.summary_of(sums, base)) == sorted_rows(su.teacher_summary(base))


def test_only_touched_periods_are_written_again(spark, base, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    years = [r.id for r in base.periods.collect()]
    change = store.begin()
    first = inc.student_sums(base.assignments, base.results)
    change.replace_slices(inc.SUMS, first, su.PERIOD, years)
    change.commit()
    batch = batch_of(spark, base, 2)
    touched = batch.touched_periods
    before = dict(store.tables()[inc.SUMS]["slices"])
    assert inc.refresh(store, base.assignments, batch) == 2
    after = dict(store.tables()[inc.SUMS]["slices"])
    assert {y for y in years if before[y] != after[y]} == set(touched)
    stored = store.read(inc.SUMS, first.schema)
    assert exact(stored) == exact(inc.student_sums(base.assignments, batch.results_after))
