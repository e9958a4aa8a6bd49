"""Deletes that follow references to the last level.

The tables form a graph by their references, without a circle. A walk from
parents to children carries the keys that go from each table: those named by
the batch and those that name a row that goes through a cascading reference. A
set-null reference to a row that goes is emptied. Nothing goes while a row that
stays names a row that goes through a restricting reference.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritpool import schemas
from meritpool.operators.joins import FANOUT, apart


def parents_first(names: Iterable[str]) -> list[str]:
    """The tables in an order in which each stands after those it names."""
    left, order = set(names), []
    while left:
        ready = sorted(n for n in left if not any(r.table in left - {n} for r in schemas.ALL[n].references))
        if not ready:
            raise ValueError(f"references form a circle: {sorted(left)}")
        order += ready
        left -= set(ready)
    return order


#: So many ids of a batch, or fewer, may each be named by a large part of a table.
FEW = 10_000


def _salted(rows: DataFrame, keys: DataFrame, batch: DataFrame, table: schemas.Table) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: few keys are repeated FANOUT times, and the rows that name one are
    dealt out over so many tasks; of more keys, counted in their ``batch``, each stays one row."""
    fanout = F.when(batch.agg(F.count("*")).scalar() <= FEW, F.lit(FANOUT)).otherwise(F.lit(1))
    by = ["id"] if "id" in rows.columns else [r.column for r in table.references if r.column in rows.columns]
    salt = F.coalesce(F.pmod(F.xxhash64(*by), fanout), F.lit(0)).cast("int")
    return rows.withColumn("_salt", salt), keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), fanout - 1)))


@dataclass(frozen=True)
class Deletion:
    """What a batch of deletes comes to; each frame is lazy.

    ``after`` holds the rows left of each table, ``gone`` the keys that go, and
    ``refused`` (table_name, rule, row_key) the keys that rows which stay still
    name. As in one transaction, the batch is to be applied only if there are none.
    """

    after: dict[str, DataFrame]
    gone: dict[str, DataFrame]
    refused: DataFrame

    def counts(self) -> DataFrame:
        """How many rows of each table go."""
        found = None
        for name, keys in self.gone.items():
            counted = keys.agg(F.count("*").alias("n_gone")).select(F.lit(name).alias("table_name"), "n_gone")
            found = counted if found is None else found.unionByName(counted)
        return found


def deletion(tables: Mapping[str, DataFrame], deleted: Mapping[str, DataFrame]) -> Deletion:
    """The closure of ``deleted``, frames with ``id`` by table name, over ``tables``.

    Each table is read once for its own marks: rows are joined to the keys that go
    from each parent, one row per key. Keys of a small batch are broadcast by Spark's
    size check and the table is not shuffled; beyond that a hot key is split.
    Ids named twice count once; ids that are not there delete nothing. Tables that nobody
    names need no ``id``. Tables that are not given are not looked at, but for the
    keys that go from them.
    """
    keys = {name: apart(ids.select("id").distinct()) for name, ids in deleted.items()}
    gone: dict[str, DataFrame] = {name: ids for name, ids in keys.items() if name not in tables}
    given = {name: deleted[name] for name in gone}
    after: dict[str, DataFrame] = {}
    for name in parents_first(tables):
        table, rows = schemas.ALL[name], tables[name]
        columns, marks = rows.columns, []

        def marked(
            rows: DataFrame, keys: DataFrame, column: str, batch: DataFrame | None = None,
            marks: list[str] = marks, table: schemas.Table = table,
        ) -> DataFrame:
            flag = f"_gone_{len(marks)}"
            marks.append(flag)
            keys = keys.select(F.col("id").alias(column), F.lit(True).alias(flag))
            if batch is None:
                return rows.join(keys, column, "left")
            rows, keys = _salted(rows, keys, batch, table)
            return rows.join(keys, [column, "_salt"], "left").drop("_salt")

        if name in deleted:
            rows = marked(rows, keys[name], "id")
        for ref in table.references:
            if ref.table in gone and ref.column in columns and ref.on_delete == "cascade":
                rows = marked(rows, gone[ref.table], ref.column, given.get(ref.table))
        goes = F.lit(False)
        for flag in marks:
            goes = goes | F.col(flag).isNotNull()
        left = rows.where(~goes)
        if marks and "id" in columns:
            gone[name] = rows.where(goes).select("id")
            if name in deleted and len(marks) == 1:
                given[name] = deleted[name]  # no other keys go
        for ref in table.references:
            if ref.table in gone and ref.column in columns and ref.on_delete == "set_null":
                emptied = gone[ref.table].select(F.col("id").alias(ref.column), F.lit(True).alias("_emptied"))
                left = left.join(emptied, ref.column, "left").withColumn(
                    ref.column, F.when(F.col("_emptied").isNull(), F.col(ref.column))
                ).drop("_emptied")
        after[name] = left.select(*columns)
    return Deletion(after, gone, _refused(after, gone))


def _refused(after: Mapping[str, DataFrame], gone: Mapping[str, DataFrame]) -> DataFrame:
    found = None
    for name, rows in after.items():
        for ref in schemas.ALL[name].references:
            if ref.on_delete != "restrict" or ref.table not in gone or ref.column not in rows.columns:
                continue
            used = rows.select(F.col(ref.column).alias("id")).distinct()
            still = gone[ref.table].join(used, "id", "left_semi").select(
                F.lit(ref.table).alias("table_name"), F.lit(f"used_by_{name}").alias("rule"),
                F.col("id").cast("string").alias("row_key"),
            )
            found = still if found is None else found.unionByName(still)
    if found is None:
        spark = next(iter(after.values())).sparkSession
        found = spark.createDataFrame([], "table_name string, rule string, row_key string")
    return found
