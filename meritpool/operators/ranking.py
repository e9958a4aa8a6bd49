"""First rows by group, for all groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest ``order`` columns of each group.

    A maximum, so map tasks send one row per group and a hot group costs no
    more than the others.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their ``place``.

    Spark cuts each group to ``n`` rows inside the map tasks before the
    shuffle (WindowGroupLimit), so a hot group arrives small.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)
