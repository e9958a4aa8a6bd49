"""Comparable output: doubles rounded by column, dates and times as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = {
    "avg_group_size": 8, "normalization_factor": 8, "normalized_share_percent": 10,
    "reverse_weight": 10, "total_reverse_weight": 10, "employee_share": 10,
    "raw_points": 6, "raw_points_by_student": 6, "normalized_points": 6,
    "total_normalized_points": 5, "score": 4, "weight_value": 6,
    "total_fund": 2, "dismissed_fund": 2, "distributable_fund": 2, "uvsotr_value": 2,
    "reverse_incentive_amount": 2, "normalized_fund_amount": 2, "final_amount": 2,
    "Raw points": 6, "Normalized points": 6, "Reverse incentive": 2, "Normalized fund": 2,
}


def digits(name: str) -> int:
    return DIGITS.get(name, 4)


def _plain(name: str, kind: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.DecimalType, T.DoubleType)):
        return F.round(column.cast("double"), digits(name)).alias(name)
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd").alias(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)
    return column


def plain(df: DataFrame) -> DataFrame:
    return df.select(*[_plain(f.name, f.dataType) for f in df.schema.fields])
