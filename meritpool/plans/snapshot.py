"""The stored calculation of a period, rebuilt from the summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritpool import schemas
from meritpool.operators.merge import delete_keys, replace_slice
from meritpool.operators.quality import rule_list
from meritpool.plans.summary import PERIOD, teacher_allocation
from meritpool.sources.commits import Store
from meritpool.sources.tables import Tables
from meritpool.sources.writers import log_rows

CALCULATIONS, ITEMS = schemas.CALCULATIONS.name, schemas.ITEMS.name

# Stored column -> summary column. Nulls are stored as 0 (or false).
STORED = {
    "raw_points": "raw_points",
    "normalized_points": "normalized_points",
    "reverse_weight": "reverse_weight",
    "employee_share": "employee_share",
    "uvsotr_amount": "reverse_incentive_amount",
    "final_amount": "normalized_fund_amount",
    "student_count_with_results": "student_count_with_results",
    "total_student_count": "total_student_count",
}


def _stored(name: str, given: str, summary: DataFrame) -> Column:
    """A summary column in its stored type. Ratios are doubles; the noise of
    their last digits goes first, so that a half rounds as a half."""
    kind = schemas.data_type(schemas.CALCULATIONS.column(name).type)
    value = F.col(given)
    if isinstance(summary.schema[given].dataType, T.DoubleType):
        value = F.round(value, kind.scale + 4)
    return F.coalesce(value, F.lit(0)).cast(kind).alias(name)


def _numbered(
    tables: Tables, periods: Sequence[int], calculated_at: Column | None
) -> DataFrame:
    """The summary as stored rows, with ``_bearers``: how many summary rows meet
    under one period and teacher. Teachers are stored under the smallest id that
    bears their full name, so every bearer of the name is counted by a window
    over a key that as many rows share as there are such teachers."""
    summary = teacher_allocation(tables, periods).withColumnRenamed("teacher_id", "_own_id")
    names = tables.teachers.select(F.col("full_name").alias("teacher_name"), "id")
    first_ids = names.groupBy("teacher_name").agg(F.min("id").alias("teacher_id"))
    stored = [_stored(name, given, summary) for name, given in STORED.items()]
    return summary.join(first_ids, "teacher_name").select(
        PERIOD, "teacher_id", *stored,
        F.lit(None).cast("decimal(14,6)").alias("avg_group_ratio"),
        F.coalesce("is_dismissed", F.lit(False)).alias("is_dismissed_snapshot"),
        (F.current_timestamp() if calculated_at is None else calculated_at).alias("calculated_at"),
        F.count("*").over(Window.partitionBy(PERIOD, "teacher_id")).alias("_bearers"),
    )


def snapshot_rows(
    tables: Tables, periods: Sequence[int], calculated_at: Column | None = None
) -> DataFrame:
    """The summary of the periods as stored rows, rounded by the column types.

    Rows of teachers that share a full name would meet under one key, which the
    unique rule of the table forbids; they are left out and ``snapshot_rejects``
    has them.
    """
    return _numbered(tables, periods, calculated_at).where("_bearers = 1").drop("_bearers")


def snapshot_rejects(
    tables: Tables, periods: Sequence[int], calculated_at: Column | None = None
) -> DataFrame:
    """The rows that ``snapshot_rows`` leaves out, with the rule they break."""
    rule = "_".join(schemas.CALCULATIONS.unique[0]) + "_unique"
    rows = _numbered(tables, periods, calculated_at).where("_bearers > 1").drop("_bearers")
    return rows.withColumn("rules", rule_list(F.lit(rule)))


def calculations_after(calculations: DataFrame, periods: Sequence[int], new: DataFrame) -> DataFrame:
    """Stored calculations with the periods replaced, also by nothing."""
    return replace_slice(calculations, PERIOD, periods, new.select(*calculations.columns))


def items_after(items: DataFrame, calculations: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Items left when the calculations of the periods go."""
    gone = calculations.where(F.col(PERIOD).isin(list(periods))).select("id")
    return delete_keys(items, gone, {"teacher_calculation_id": "id"})


def rebuild_log(new: DataFrame, period_names: DataFrame) -> DataFrame:
    """One log row per period rebuilt, with the count of rows stored."""
    counts = new.groupBy(PERIOD).agg(F.count("*").alias("inserted"))
    named = period_names.select(F.col("id").alias(PERIOD), F.col("name").alias("period")).join(
        counts, PERIOD, "left"
    )
    details = F.to_json(F.struct(F.coalesce("inserted", F.lit(0)).alias("inserted"), "period"))
    return log_rows(named, F.lit("recalculate"), "teacher_calculations", F.col(PERIOD), details)


def rebuild_period(tables: Tables, period_id: int, store: Store) -> DataFrame:
    """Rebuild the stored calculation of a period kept in ``store``.

    The new rows and the period's items, which go as nothing fills them again, are one
    commit: readers see both changes or neither. A job that fails, or another
    writer who commits first, leaves both tables. Returns the log row to append.
    """
    new = snapshot_rows(tables, [period_id])
    change = store.begin()
    change.replace_slices(CALCULATIONS, new, PERIOD, [period_id])
    columns = [f for f in schemas.ITEMS.struct.fields if f.name != PERIOD]
    items = new.sparkSession.createDataFrame([], T.StructType(columns))
    change.replace_slices(ITEMS, items.withColumn(PERIOD, F.lit(period_id).cast("bigint")), PERIOD, [period_id])
    version = change.commit()
    stored = store.read(CALCULATIONS, new.schema, version).where(F.col(PERIOD) == period_id)
    return rebuild_log(stored, tables.periods.where(F.col("id") == period_id))
