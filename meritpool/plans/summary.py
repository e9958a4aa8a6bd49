"""Points, normalisation, reverse weights and fund shares by period.

Shape of the job (rows in brackets):

    assignments ---------------- left join on 4 keys --- by student --- by teacher
    results -- sum by 4 keys ---/     (assignments)    (pairs)       (teachers)

Results are added up before the join, so the join to the assignments is many to
one however many results a student has. Both student counts come out of the one
pass: every (teacher, student) pair is counted, and those with results as well.
Totals by period are taken over teachers in one aggregate and joined back, each
period spread over many tasks.

Scores are exact decimals up to the points of a teacher; ratios are doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritpool.functions.scores import exact_sum, part_of_fund, reverse_weight, share_of
from meritpool.operators.joins import spread_join
from meritpool.sources.tables import Tables

PERIOD = "academic_period_id"
MATCH = [PERIOD, "student_id", "grade", "grade_track"]

SUMMARY_COLUMNS = [
    "academic_period", "teacher_name", "teacher_short_name", "is_dismissed",
    "student_count_with_results", "total_student_count", "avg_group_size", "raw_points",
    "normalization_factor", "normalized_points", "normalized_share_percent",
    "reverse_weight", "total_reverse_weight", "employee_share", "total_fund",
    "dismissed_fund", "distributable_fund", "uvsotr_value", "reverse_incentive_amount",
    "normalized_fund_amount",
]


def of_periods(df: DataFrame, periods: Sequence[int] | None) -> DataFrame:
    """Rows of the named periods; put on the scans, where it prunes folders."""
    return df if periods is None else df.where(F.col(PERIOD).isin(list(periods)))


def active_scope(assignments: DataFrame, periods: Sequence[int] | None = None) -> DataFrame:
    """Active assignments: who teaches whom, in which grade and track.

    The keys are required columns; naming that here gives every later use of
    the frame the same filters, so that Spark computes it once.
    """
    return (
        of_periods(assignments, periods)
        .where("is_active")
        .where(F.col(PERIOD).isNotNull() & F.col("teacher_id").isNotNull())
        .select(PERIOD, "teacher_id", "student_id", "grade", "grade_track", "share_percent")
    )


def scores_by_match(results: DataFrame, periods: Sequence[int] | None = None) -> DataFrame:
    """Total score by period, student, grade and track."""
    return (
        of_periods(results, periods)
        .groupBy(PERIOD, "student_id", F.col("grade_at_result").alias("grade"), "grade_track")
        .agg(F.sum("total_score").alias("score"))
        .withColumn("scored", F.lit(True))
    )


def student_points(scope: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per (period, teacher, student) of the scope.

    ``has_results`` tells students with a matching result from those without;
    a student assigned twice at one grade counts the points twice. The unique
    key of the assignments bounds the rows of one match by four per teacher, so
    no key of this join is hot.
    ``weighted`` is points times 100, exact.
    """
    joined = scope.join(scores, MATCH, "left")
    return joined.groupBy(PERIOD, "teacher_id", "student_id").agg(
        F.sum(F.col("score") * F.col("share_percent")).cast("decimal(30,6)").alias("weighted"),
        (F.count("scored") > 0).alias("has_results"),
    )


def _points(weighted: Column) -> Column:
    return weighted * F.lit(0.01).cast("decimal(2,2)")


def points_by_student(students: DataFrame) -> DataFrame:
    """Weighted points of the students that have results."""
    return students.where("has_results").select(
        PERIOD, "teacher_id", "student_id",
        _points(F.col("weighted")).alias("raw_points_by_student"),
    )


def teacher_scope(students: DataFrame) -> DataFrame:
    """Student counts and raw points by teacher; 0 for those without results."""
    return (
        students.groupBy(PERIOD, "teacher_id")
        .agg(
            F.count_if("has_results").alias("student_count_with_results"),
            F.count("*").alias("total_student_count"),
            F.sum("weighted").cast("decimal(30,6)").alias("weighted"),
        )
        .select(
            PERIOD, "teacher_id", "student_count_with_results", "total_student_count",
            F.coalesce(_points(F.col("weighted")), F.lit(0).cast("decimal(33,8)")).alias("raw_points"),
        )
    )


def teacher_points(teachers: DataFrame) -> DataFrame:
    """Count and points of the teachers that have results."""
    return teachers.where("student_count_with_results > 0").select(
        PERIOD, "teacher_id", "student_count_with_results", "raw_points"
    )


def period_totals(teachers: DataFrame) -> DataFrame:
    """Average group, total of normalised points and of reverse weights.

    With the average of a period being one number, the total of raw * (avg / n)
    is avg * total of raw / n, so one aggregate gives all three. Map tasks send
    one row per period, and the sums do not depend on the order of the rows.
    """
    n = F.col("student_count_with_results")
    raw = F.col("raw_points").cast("double")
    return (
        teachers.groupBy(PERIOD)
        .agg(
            F.avg(F.when(n > 0, n)).alias("avg_group_size"),
            exact_sum(F.when(n > 0, raw / n)).alias("_points_per_student"),
            exact_sum(reverse_weight(raw)).alias("total_reverse_weight"),
        )
        .select(
            PERIOD, "avg_group_size",
            F.coalesce(F.col("avg_group_size") * F.col("_points_per_student"), F.lit(0.0))
            .alias("total_normalized_points"),
            "total_reverse_weight",
        )
    )


def average_group(totals: DataFrame) -> DataFrame:
    return totals.select(PERIOD, "avg_group_size")


def with_totals(teachers: DataFrame, totals: DataFrame) -> DataFrame:
    """Teachers with the totals of their period."""
    return spread_join(teachers, totals, [PERIOD], "left", ["teacher_id"])


def normalized(teachers: DataFrame) -> DataFrame:
    """Points as if each teacher had a group of average size."""
    n = F.col("student_count_with_results")
    usable = (n > 0) & (F.col("avg_group_size") > 0)
    factor = F.col("avg_group_size") / n
    return teachers.withColumns(
        {
            "normalization_factor": F.when(usable, factor).otherwise(F.lit(0.0)),
            "normalized_points": F.when(usable, F.col("raw_points").cast("double") * factor)
            .otherwise(F.lit(0.0)),
        }
    )


def reverse_weights(teachers: DataFrame) -> DataFrame:
    return teachers.withColumn("reverse_weight", reverse_weight(F.col("raw_points").cast("double")))


def fund_settings(settings: DataFrame, periods: Sequence[int] | None = None) -> DataFrame:
    """Funds of a period and what is left of the whole to hand out."""
    total, dismissed = F.col("total_fund"), F.col("dismissed_fund")
    return of_periods(settings, periods).select(
        PERIOD, "total_fund", "dismissed_fund",
        (F.coalesce(total, F.lit(0)) - F.coalesce(dismissed, F.lit(0))).alias("distributable_fund"),
        "uvsotr_value",
    )


def allocated(teachers: DataFrame) -> DataFrame:
    """Shares and amounts. Amounts are null without settings or a positive total."""
    fund = F.col("distributable_fund").cast("double")
    points, all_points = F.col("normalized_points"), F.col("total_normalized_points")
    weight, all_weights = F.col("reverse_weight"), F.col("total_reverse_weight")
    return teachers.withColumns(
        {
            "normalized_share_percent": share_of(points, all_points),
            "employee_share": share_of(weight, all_weights),
            "reverse_incentive_amount": part_of_fund(fund, weight, all_weights),
            "normalized_fund_amount": part_of_fund(fund, points, all_points),
        }
    )


def scored_teachers(tables: Tables, periods: Sequence[int] | None = None) -> DataFrame:
    """Counts and points by period and teacher, straight from the base tables."""
    scope = active_scope(tables.assignments, periods)
    scores = scores_by_match(tables.results, periods)
    return teacher_scope(student_points(scope, scores))


def teacher_allocation(tables: Tables, periods: Sequence[int] | None = None) -> DataFrame:
    """The summary with the ids of period and teacher in front.

    Everything that hangs on the period alone (totals, name, settings) is
    brought together first, a few rows, and joined to the teachers once.
    """
    return allocation_of(scored_teachers(tables, periods), tables, periods)


def allocation_of(
    teachers: DataFrame, tables: Tables, periods: Sequence[int] | None = None
) -> DataFrame:
    """The same from counts and points by period and teacher."""
    names = tables.periods.select(F.col("id").alias(PERIOD), F.col("name").alias("academic_period"))
    by_period = (
        period_totals(teachers)
        .join(names, PERIOD)
        .join(fund_settings(tables.settings, periods), PERIOD, "left")
    )
    people = tables.teachers.select(
        F.col("id").alias("teacher_id"),
        F.col("full_name").alias("teacher_name"),
        F.col("short_name").alias("teacher_short_name"),
        "is_dismissed",
    )
    joined = spread_join(teachers, by_period, [PERIOD], "inner", ["teacher_id"])
    shares = allocated(reverse_weights(normalized(joined.join(people, "teacher_id"))))
    return shares.select(PERIOD, "teacher_id", *SUMMARY_COLUMNS)


def teacher_summary(tables: Tables, periods: Sequence[int] | None = None) -> DataFrame:
    """One row per period and teacher with an active assignment.

    ``normalized_share_percent`` is a fraction. Dismissed teachers and the pool
    of departed staff take part in every total.
    """
    return teacher_allocation(tables, periods).select(*SUMMARY_COLUMNS)
