"""Joins that stay balanced when one key holds much of the data.

* Two inputs that each come straight from an exchange, as tables and staging
  rows do: plain ``join`` without a hint. Spark broadcasts a side only after
  checking its size (file size when planning, measured shuffle size when
  running); beyond that it is a sort-merge join, in which the adaptive planner
  splits the rows of a hot key over several tasks.
* Many rows joined to an aggregate by the aggregate's own keys: the aggregate
  would not be shuffled again, and the adaptive planner would leave the join
  alone. Where a key can be hot the aggregate is ``apart``: it gets an exchange
  of its own, and the join is split as above.
* A frame that several parts of one plan read (``once``): an exchange that they share.
* A wide frame with several look-ups, each by another column (``once_by``): it is dealt out by
  one key, each look-up goes out and comes back by that key with no more than it needs.
* Many rows joined to a frame with few keys, such as totals by period
  (``spread_join``): each key holds a large part of the rows, so all are salted
  and the small side is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key of a ``spread_join`` go to, unless the caller
#: names another number: the cores of the cluster by the number of keys is a good one.
FANOUT = 32


def _salt(spread_by: Sequence[str], salts: int) -> Column:
    """Salt by row hash. It is never null, and saying so keeps the planner from
    adding a null filter, which would make two uses of one frame differ and
    stop it from computing them once."""
    return F.coalesce(F.pmod(F.xxhash64(*spread_by), F.lit(salts)), F.lit(0)).cast("int")


def apart(aggregated: DataFrame) -> DataFrame:
    """An aggregate dealt out anew, so that a join by its keys has an exchange
    of its own on this side too and Spark can split a hot key of the other."""
    return aggregated.hint("rebalance")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` behind one exchange by ``keys`` that carries its rows whole.

    Frames made from the result ask for the same exchange, whatever rows and columns
    each of them needs, and so one query fills it once and reads it several times.
    Without this, filters and column pruning go below each reader's own copy and make the
    copies differ. Rows are packed into a list of one, which neither gets through; the
    outer form of unpacking keeps Spark from putting a test of the list below.
    """
    packed = df.select(*[F.col(k).alias(f"_by_{i}") for i, k in enumerate(keys)], F.array(F.struct(*df.columns)).alias("_row"))
    return packed.repartition(*[f"_by_{i}" for i in range(len(keys))]).select(F.inline_outer("_row"))


def once_by(df: DataFrame, key: str) -> DataFrame:
    """``once`` by a column that is never null, and dealt out by it from then on.

    Groups and joins by ``key`` alone need no exchange of their own. That the key is never null
    has to be known to the planner, which would else filter each reader's own copy.
    """
    rest = F.array(F.struct(*[c for c in df.columns if c != key])).alias("_row")
    return df.select(key, rest).repartition(key).select(key, F.inline_outer("_row"))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    fanout: int = FANOUT,
) -> DataFrame:
    """Equi-join to a frame with few rows and few keys, every key salted.

    If the right side measures small, Spark turns this into a broadcast join
    while running; if not, the rows of each key still go to ``fanout`` tasks.
    """
    salted_left = left.withColumn("_salt", _salt(spread_by, fanout))
    salted_right = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1)))
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def named_by(table: DataFrame, batch: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a large table whose key a batch names.

    With a batch small enough by Spark's size check, its keys are broadcast and
    the table is filtered where it is read; only what is left takes part in the
    joins to come.
    """
    return table.join(batch.select(*on).distinct(), list(on), "left_semi")


def prefiltered(table: DataFrame, batch: DataFrame, on: Sequence[str]) -> DataFrame:
    """``named_by`` where Spark plans to broadcast the keys of the batch, else the table whole.

    For a join to come that needs no filter: one by a larger batch would shuffle the table
    once more. The size is the planner's own estimate; no job runs.
    """
    keys = batch.select(*on).distinct()
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(keys._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return named_by(table, batch, on) if size <= limit else table
