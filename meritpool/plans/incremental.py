"""The summary kept up to date from changes alone.

Stored are the sums below everything else: weighted points (a decimal, exact) and
the count of results that went into them, by period, teacher and student. A batch
of changes takes the old scores of the results it touches away and adds the new ones; by
matching key that is a small frame, which the assignments carry to the stored
sums. The sums of teachers, the totals of periods and all shares follow from there as
in a full rebuild, and as the sums are exact the outcome is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritpool.operators.joins import apart
from meritpool.plans.changes import ChangeBatch
from meritpool.plans.summary import MATCH, PERIOD, active_scope, allocation_of, teacher_scope
from meritpool.sources.commits import Store
from meritpool.sources.tables import Tables

KEY = [PERIOD, "teacher_id", "student_id"]
#: The stored sums' table in a store.
SUMS = "student_sums"
_WEIGHTED = T.DecimalType(30, 6)


def _sums(scored: DataFrame, *more: Column) -> DataFrame:
    """Weighted points and results by key of rows with score, share and n."""

    def total(value: Column, kind: T.DataType) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast(kind)

    return scored.groupBy(*KEY).agg(
        total(F.col("score") * F.col("share_percent"), _WEIGHTED).alias("weighted"),
        total(F.col("n"), T.LongType()).alias("n_scored"),
        *more,
    )


def _by_match(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MATCH).agg(F.sum("score").alias("score"), F.sum("n").alias("n"))


def _scored(assignments: DataFrame, scores: DataFrame) -> DataFrame:
    """The active scope with the ``scores`` of its matches, null without one. Its rows go to them
    whole and none is left out, so that a plan with several of these fills one exchange."""
    row = F.array(F.struct(*KEY, "share_percent")).alias("_row")
    scope = active_scope(assignments).select(*MATCH, row)
    found = [c for c in scores.columns if c not in MATCH]
    rows = scope.join(scores, MATCH, "left").select(*found, F.inline_outer("_row"))
    return rows.where(F.col(PERIOD).isNotNull() & F.col("teacher_id").isNotNull())  # as in ``active_scope``


def _scores(results: DataFrame, sign: Column | None = None) -> DataFrame:
    score = F.col("total_score")
    return results.select(
        PERIOD, "student_id", F.col("grade_at_result").alias("grade"), "grade_track",
        (score if sign is None else F.when(sign < 0, -score).otherwise(score)).alias("score"),
        (F.lit(1) if sign is None else sign).cast("bigint").alias("n"),
    )


def student_sums(assignments: DataFrame, results: DataFrame) -> DataFrame:
    """The sums from the base tables: a row for each active period, teacher and student."""
    return _sums(_scored(assignments, _by_match(_scores(results))))


def score_changes(batch: ChangeBatch) -> DataFrame:
    """What a batch adds to the score and the count of each matching key.

    Of the results only those are read that the batch edits.
    """
    rows = batch.before_and_after(PERIOD, "student_id", "grade_at_result", "grade_track", "total_score")
    return _by_match(_scores(rows, F.col("sign")))


def sums_after(sums: DataFrame, assignments: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored sums with the score changes of a batch."""
    scored = _scored(assignments, changes.withColumn("_found", F.lit(1)))
    added = _sums(scored, F.count("_found").alias("_found")).where("_found > 0").select(
        *KEY, F.col("weighted").alias("_weighted"), F.col("n_scored").alias("_n")
    )
    nothing = F.lit(0)
    return sums.join(apart(added), KEY, "left").select(
        *KEY,
        (F.col("weighted") + F.coalesce("_weighted", nothing.cast(_WEIGHTED))).cast(_WEIGHTED).alias("weighted"),
        (F.col("n_scored") + F.coalesce("_n", nothing)).alias("n_scored"),
    )


def summary_of(sums: DataFrame, tables: Tables) -> DataFrame:
    """The summary, with ids in front, from the stored sums."""
    students = sums.select(*KEY, "weighted", (F.col("n_scored") > 0).alias("has_results"))
    return allocation_of(teacher_scope(students), tables)


def refresh(store: Store, assignments: DataFrame, batch: ChangeBatch) -> int:
    """The stored sums brought up to a batch, in one commit: its version.

    Only the periods that the batch touches are read and written again.
    """
    periods = batch.touched_periods
    change = store.begin()
    schema = T.StructType(
        [T.StructField(k, T.LongType()) for k in KEY]
        + [T.StructField("weighted", _WEIGHTED), T.StructField("n_scored", T.LongType())]
    )
    touched = F.col(PERIOD).isin(periods)
    sums = store.read(SUMS, schema, change.base).where(touched)
    new = sums_after(sums, assignments.where(touched), score_changes(batch))
    change.replace_slices(SUMS, new, PERIOD, periods)
    return change.commit()
