"""New versions of a table: insert, upsert, delete, replace a slice.

Each function returns the rows a table holds afterwards, or the rows to
append; writing them is left to ``meritpool.sources.writers``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by its other columns; nulls are a key too."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    # copies go first, in a hash aggregate; the ordered minimum sorts what is left
    least = df.distinct().groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
    return least.select(*[F.col(c) if c in key else F.col(f"_row.{c}") for c in df.columns])


def absent_rows(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key ``target`` does not hold, one per key.

    Keys compare null-safely, so that a load run twice adds nothing the second
    time even where a key column is null.
    """
    left = one_per_key(new, key).alias("n")
    right = target.select(*key).alias("t")
    matched = F.lit(True)
    for k in key:
        matched = matched & F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}"))
    return left.join(right, matched, "left_anti")


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    touched_at: Column | None = None,
) -> DataFrame:
    """Insert absent keys; on known keys overwrite ``columns`` and nothing else.

    Columns that ``source`` lacks are null on new rows; ``inserts.with_new_ids``
    fills them. The column ``updated_at`` is set to ``touched_at``, by default
    the current time, on rows that were overwritten. Both sides hold a key
    once, so no key is hot.
    """
    touched_at = F.current_timestamp() if touched_at is None else touched_at
    t = target.withColumn("_known", F.lit(True)).alias("t")
    s = one_per_key(source, key).withColumn("_given", F.lit(True)).alias("s")
    joined = t.join(s, list(key), "full_outer")
    given, known = F.col("_given").isNotNull(), F.col("_known").isNotNull()

    def merged(c: str) -> Column:
        if c in key:
            return F.col(c)
        if c == "updated_at":
            new = F.col(f"s.{c}") if c in source.columns else touched_at
            return F.when(given & known, touched_at).when(given, new).otherwise(F.col(f"t.{c}")).alias(c)
        if c in columns:
            return F.when(given, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
        if c in source.columns:
            return F.when(known, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
        return F.col(f"t.{c}").alias(c)

    return joined.select(*[merged(c) for c in target.columns])


def delete_keys(df: DataFrame, deleted: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``df`` not named by ``deleted``; ``on`` maps df to deleted columns."""
    keys = deleted.select(*[F.col(d).alias(c) for c, d in on.items()])
    return df.join(keys, list(on), "left_anti").select(*df.columns)


def set_null(df: DataFrame, deleted: DataFrame, column: str, deleted_key: str = "id") -> DataFrame:
    """``df`` with ``column`` emptied where it names a deleted key.

    The deleted keys are unique, as ids are. They are not made so here: with
    both sides straight from an exchange Spark can split a hot key or the rows
    that name no key at all.
    """
    gone = deleted.select(F.col(deleted_key).alias(column), F.lit(True).alias("_gone"))
    return (
        df.join(gone, column, "left")
        .withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
        .select(*df.columns)
    )


def replace_slice(df: DataFrame, column: str, values: Iterable, new: DataFrame) -> DataFrame:
    """``df`` without the slices ``values``, plus the rows of ``new``.

    The slices go even where ``new`` is empty.
    """
    kept = df.where(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))
    return kept.unionByName(new)
