"""Dense ids without a sequence and without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritpool.operators.joins import once_by

BUCKETS = 4096


def assign_ids(df: DataFrame, key: Sequence[str], start: Column, buckets: int = BUCKETS) -> DataFrame:
    """Add ``id`` = start + 1, start + 2, ... over rows with a unique ``key``.

    Rows are numbered inside hash buckets of the key and each bucket is moved
    up by the sizes of the buckets before it. The running total is taken over
    ``buckets`` rows at most, the only frame that is broadcast. Ids depend on
    the data alone, so a task that is run again gives the same ids.
    """
    bucket = F.coalesce(F.pmod(F.xxhash64(*key), F.lit(buckets)), F.lit(0)).cast("int")
    # sizes and rows come from one exchange: what ``df`` is made of is worked out once
    bucketed = once_by(df.withColumn("_bucket", bucket), "_bucket")
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy(*key)
    return (
        bucketed.withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("id", (start + F.col("_offset") + F.col("_place")).cast("bigint"))
        .drop("_bucket", "_offset", "_place")
    )


def highest_id(table: DataFrame) -> Column:
    """The highest id of a table as a scalar, 0 for an empty table."""
    return table.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
