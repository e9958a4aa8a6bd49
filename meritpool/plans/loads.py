"""Loads that may come twice: a ledger of batches.

Rows come in batches, named by a column. A batch has a digest of its rows that
does not depend on their order or on the way they are dealt out; the ledger holds the
digest of each batch that has been loaded. A batch that is known with its
digest is skipped; one that is known with another digest has been corrected, and its
rows stand for those it brought before. Rows of other batches are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritpool.operators.joins import apart, once
from meritpool.sources.commits import Store

#: The ledger's table in a store.
LOADS = "loads"


def ledger_schema(batch_type: T.DataType, batch: str = "batch_id") -> T.StructType:
    return T.StructType(
        [T.StructField(batch, batch_type), T.StructField("n_rows", T.LongType()),
         T.StructField("digest", T.StringType())]
    )


def batch_digests(rows: DataFrame, batch: str = "batch_id", columns: Sequence[str] | None = None) -> DataFrame:
    """One row per batch with its number of rows and a digest of ``columns``, by default all.

    Two 64-bit hashes of each row are added up exactly, so equal rows count as often as
    they come, and map tasks send one row per batch however large one is.
    """
    held = [c for c in (columns or rows.columns) if c != batch]
    given = F.concat(*[F.when(F.col(c).isNull(), F.lit(f"{i}")).otherwise(F.lit("")) for i, c in enumerate(held)])
    one, two = F.xxhash64(*held, given), F.xxhash64(F.lit(1), *held, given)
    sums = [F.sum(h.cast("decimal(20,0)")).cast("string") for h in (one, two)]
    return rows.groupBy(batch).agg(F.count("*").alias("n_rows"), F.concat_ws(":", *sums).alias("digest"))


def due_batches(digests: DataFrame, ledger: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The batches that are new or have changed since they were loaded."""
    known = ledger.select(F.col(batch).alias("_batch"), F.col("n_rows").alias("_rows"), F.col("digest").alias("_digest"))
    same = (
        F.col(batch).eqNullSafe(F.col("_batch")) & (F.col("n_rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest"))
    )
    return digests.join(known, same, "left_anti")


def _of(rows: DataFrame, batches: DataFrame, batch: str, how: str) -> DataFrame:
    named = apart(batches.select(F.col(batch).alias("_batch")))
    return rows.join(named, F.col(batch).eqNullSafe(F.col("_batch")), how)


def loaded(
    target: DataFrame, ledger: DataFrame, rows: DataFrame, batch: str = "batch_id"
) -> tuple[DataFrame, DataFrame]:
    """The table and the ledger after a load, as lazy frames.

    ``rows`` may hold several batches; a null batch is a batch. A batch that is not
    in ``rows`` stays as it is.
    """
    given = once(rows, *rows.columns)
    due = due_batches(batch_digests(given, batch), ledger, batch)
    fresh = _of(given, due, batch, "left_semi")
    table = _of(target, due, batch, "left_anti").unionByName(fresh.select(*target.columns))
    entries = _of(ledger, due, batch, "left_anti").unionByName(due.select(*ledger.columns))
    return table, entries


def load_batches(store: Store, name: str, rows: DataFrame, batch: str = "batch_id") -> list:
    """The batches of ``rows`` that were due, loaded into a table of the store and its ledger in
    one commit; nothing is written and no commit made where none is.

    Table and ledger are kept by batch, so the folders of other batches are not read.
    """
    schema = ledger_schema(rows.schema[batch].dataType, batch)
    change = store.begin()
    ledger = store.read(f"{name}_{LOADS}", schema, change.base)
    digests = batch_digests(rows.where(F.col(batch).isNotNull()), batch)
    due = store.spark.createDataFrame(due_batches(digests, ledger, batch).collect(), schema)  # a row per batch of this load
    batches = sorted(r[0] for r in due.select(batch).collect())
    if batches:
        change.replace_slices(name, rows, batch, batches)
        change.replace_slices(f"{name}_{LOADS}", due, batch, batches)
        change.commit()
    return batches
