"""Typed scans, landing files, inline rows and the set of model tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritpool import schemas
from meritpool.operators.quality import conform, divert


@dataclass(frozen=True)
class Tables:
    """The tables a job reads. A job needs only those it names."""

    periods: DataFrame | None = None
    students: DataFrame | None = None
    teachers: DataFrame | None = None
    enrollments: DataFrame | None = None
    groups: DataFrame | None = None
    criteria: DataFrame | None = None
    weights: DataFrame | None = None
    assignments: DataFrame | None = None
    results: DataFrame | None = None
    links: DataFrame | None = None
    settings: DataFrame | None = None
    calculations: DataFrame | None = None
    items: DataFrame | None = None
    log: DataFrame | None = None


def read_table(spark: SparkSession, table: schemas.Table, path: str) -> DataFrame:
    """A Parquet table with its declared schema; nothing is inferred."""
    return spark.read.schema(table.struct).parquet(path)


#: Copies of one row of a file that one task numbers together.
COPIES = 10_000


def read_landing(
    spark: SparkSession, table: schemas.Table, path: str, fmt: str = "csv", header: bool = True,
    copies: int = COPIES,
) -> tuple[DataFrame, DataFrame]:
    """Staging rows from a landing folder, and the rows with a bad cell.

    Each has a ``row_key``: the file, a digest of the row's text and a number that
    tells copies of a row in a file apart. The key stays the same however the
    files are split. Cells are read as text and cast; a row with a text that does
    not fit its type is diverted as it came, with ``rules``, and ends no load.

    Copies are counted, not gathered: a map task sends one row for all its copies
    of a row. The count is then dealt out in runs of ``copies``, and each run is
    numbered where it is, so a file that repeats one row spreads over the tasks.
    """
    names = [c.name for c in table.columns]
    reader = spark.read.schema(", ".join(f"`{n}` string" for n in names))
    if fmt == "csv":
        reader = reader.option("header", header)
    text = reader.format(fmt).load(path).select(*names, F.col("_metadata.file_name").alias("_file"))
    counted = text.groupBy("_file", *names).agg(F.count("*").alias("_copies"))
    digest = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    run = F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / copies)))
    dealt = counted.withColumn("_digest", digest).withColumn("_run", run).repartition("_file", "_digest", "_run")
    last = F.least("_copies", (F.col("_run") + 1) * copies)
    number = F.explode(F.sequence(F.col("_run") * copies + 1, last))
    keyed = dealt.withColumn("_number", number).withColumn(
        "row_key", F.concat_ws(":", "_file", "_digest", F.col("_number").cast("string"))
    ).select(*names, "row_key")
    bad = {
        f"{c.name}_type": F.col(c.name).isNotNull() & F.col(c.name).try_cast(c.type).isNull()
        for c in table.columns
    }
    passed, rejected = divert(keyed, bad)
    typed = [F.col(c.name).try_cast(c.type).alias(c.name) for c in table.columns]
    return passed.select(*typed, "row_key"), rejected


def inline_rows(
    spark: SparkSession, columns: Sequence[str], types: Sequence[str], rows: Sequence[tuple]
) -> DataFrame:
    """A short constant relation with named, typed columns.

    Values are given as Python literals or text and cast to the type.
    """
    as_text = [tuple(None if v is None else str(v) for v in r) for r in rows]
    raw = spark.createDataFrame(as_text, ", ".join(f"`{c}` string" for c in columns))
    return raw.select(*[F.col(c).cast(t).alias(c) for c, t in zip(columns, types, strict=True)])


def typed_rows(
    spark: SparkSession, table: schemas.Table, columns: Sequence[str], rows: Sequence[tuple]
) -> DataFrame:
    """Inline rows of a model table, filled up with defaults."""
    types = [table.column(c).type for c in columns]
    return conform(inline_rows(spark, columns, types, rows), table)
