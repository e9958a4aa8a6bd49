"""Rows as a table stores them: ids, defaults, generated columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritpool.operators.ids import assign_ids, highest_id
from meritpool.operators.quality import conform, with_null_defaults
from meritpool.schemas import Table


def inserted(new: DataFrame, target: DataFrame, table: Table, key: Sequence[str]) -> DataFrame:
    """``new`` as rows of ``table``: ids go on from the highest of ``target`` in
    the order of ``key`` by hash bucket, what is left out gets its default."""
    return conform(assign_ids(new.drop("id"), key, highest_id(target)), table)


def with_new_ids(merged: DataFrame, target: DataFrame, table: Table, key: Sequence[str]) -> DataFrame:
    """A merged table whose new rows, those without an id, get one and the defaults."""
    held = [c for c in table.columns if c.name in merged.columns]
    new = assign_ids(merged.where("id is null").drop("id"), key, highest_id(target))
    filled = with_null_defaults(new, Table(table.name, tuple(held)))
    return merged.where("id is not null").unionByName(filled.select(*merged.columns))


def id_summary(rows: DataFrame) -> DataFrame:
    """How many rows and ids, and the first and the last id."""
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"),
    )
