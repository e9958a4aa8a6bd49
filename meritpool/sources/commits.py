"""One commit over several tables.

A store is a folder with data folders by table and a list of commit records, one
small file each, named by its version. A record says which folders make up every table;
readers go by the newest record, or by an older one. Writers put rows into fresh folders
first, which nobody sees, and then make the record of the next version. It is made in full
under another name and then renamed, which fails if the version is there: of two
writers that began at one version one commits and the other gets ``CommitConflict``
and has changed nothing. The file system must rename without overwriting in one step, as
HDFS does.

A table is either a list of folders, perhaps without some of their files, or a folder for
each slice (a period, a batch). Whole files are replaced: an upsert rewrites those
that hold one of its keys and leaves the others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritpool.operators.merge import upsert


class CommitConflict(RuntimeError):
    """Another writer has committed since this one began."""


class _Files:
    """The few calls on the file system that Spark's readers do not have."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.folder = folder
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        if not self.fs.exists(self.path("")):
            return []
        return [f.getPath().getName() for f in self.fs.listStatus(self.path(""))]

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make the file with its whole content, or say that it is there."""
        self.fs.mkdirs(self.path(""))
        hidden = self.path(f".{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        try:
            context.rename(hidden, self.path(name), options)
        except Exception:
            self.fs.delete(hidden, False)
            if self.fs.exists(self.path(name)):
                return False
            raise
        return True


class Store:
    """The tables under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = _Files(spark, f"{self.root}/commits")

    def version(self) -> int:
        """Number of the newest commit; 0 before the first."""
        return max((int(n) for n in self._files.names() if n.isdigit()), default=0)

    def tables(self, version: int | None = None) -> dict[str, dict]:
        """The entries of a commit by table name."""
        version = self.version() if version is None else version
        return json.loads(self._files.text(f"{version:020d}"))["tables"] if version else {}

    def begin(self) -> Transaction:
        return Transaction(self)

    def read(self, name: str, schema: T.StructType, version: int | None = None) -> DataFrame:
        """A table as a commit has it, empty if it has none. A filter by slice prunes folders."""
        entry = self.tables(version).get(name)
        if entry is None:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if "slices" in entry:
            found = None
            for folder, values in _by_folder(entry).items():
                part = reader.parquet(folder).where(F.col(entry["by"]).isin(values))
                part = part.select(*[F.col(f.name) for f in schema.fields])
                found = part if found is None else found.unionByName(part)
            return self.spark.createDataFrame([], schema) if found is None else found
        if entry["without"]:
            files = self.files(name, version)
            return reader.parquet(*files) if files else self.spark.createDataFrame([], schema)
        return reader.parquet(*entry["folders"])

    def files(self, name: str, version: int | None = None) -> list[str]:
        """The files of a table that is kept as a list of folders. Spark gives each file a name
        of its own, by which those that were rewritten are left out."""
        entry = self.tables(version)[name]
        without = set(entry["without"])
        return sorted(f for f in self.spark.read.parquet(*entry["folders"]).inputFiles() if _name(f) not in without)

    def newest(self, name: str, schema: T.StructType, n: int, key: str = "id") -> DataFrame:
        """The ``n`` rows with the greatest keys, read from as few files as is sure.

        The least and greatest key and the rows of each file were counted when it was
        written. Files with the greatest low ends that hold ``n`` rows together
        give a bound; only files that reach up to it can hold one of the rows.
        """
        entry = self.tables().get(name)
        if entry is None:
            return self.spark.createDataFrame([], schema)
        stats = self.spark.read.parquet(*entry["stats"]).where(~F.substring_index("file", "/", -1).isin(entry["without"]))
        before = Window.orderBy(F.desc("low"), "file").rowsBetween(Window.unboundedPreceding, -1)
        bound = stats.withColumn("so_far", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).where(F.col("so_far") < n)
        least = bound.agg(F.min("low").alias("bound"))
        files = [r.file for r in stats.join(F.broadcast(least), F.col("high") >= F.col("bound")).select("file").collect()]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files).orderBy(F.desc(key)).limit(n)


def _name(file: str) -> str:
    return file.rsplit("/", 1)[-1]


def _by_folder(entry: dict) -> dict[str, list]:
    out: dict[str, list] = {}
    for value, folder in entry["slices"]:
        out.setdefault(folder, []).append(value)
    return out


class Transaction:
    """Changes to some tables of a store, seen by nobody before ``commit``."""

    def __init__(self, store: Store):
        self.store = store
        self.base = store.version()
        self.tables = store.tables(self.base)

    def _written(self, df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> str:
        folder = f"{self.store.root}/{name}/data-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(folder)
        return folder

    def _stats(self, folder: str, name: str, key: str | None) -> list[str]:
        """Rows, least and greatest key of each file, read from the one column of it."""
        if key is None:
            return []
        rows = self.store.spark.read.parquet(folder)
        stats = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count("*").alias("n_rows"), F.min(key).alias("low"), F.max(key).alias("high")
        )
        return [self._written(stats, f"{name}/stats")]

    def replace(self, name: str, df: DataFrame, partition_by: Iterable[str] = (), key: str | None = None) -> None:
        """The table is ``df`` from now on. ``df`` may be read from the table itself.
        With a ``key`` its ends are kept for each file, for ``newest``."""
        folder = self._written(df, name, partition_by)
        self.tables[name] = {"folders": [folder], "without": [], "stats": self._stats(folder, name, key)}

    def append(self, name: str, df: DataFrame, partition_by: Iterable[str] = (), key: str | None = None) -> None:
        if name not in self.tables:
            return self.replace(name, df, partition_by, key)
        entry, folder = self.tables[name], self._written(df, name, partition_by)
        self.tables[name] = {
            "folders": [*entry["folders"], folder], "without": entry["without"],
            "stats": [*entry["stats"], *self._stats(folder, name, key)],
        }
        return None

    def rewrite(self, name: str, files: Sequence[str], df: DataFrame, key: str | None = None) -> None:
        """``df`` stands for the rows of some files; the others are not touched."""
        entry = self.tables[name]
        self.append(name, df, key=key)
        self.tables[name]["without"] = sorted({*entry["without"], *map(_name, files)})

    def replace_slices(self, name: str, df: DataFrame, by: str, values: Iterable) -> None:
        """The slices ``values`` of column ``by`` are the rows ``df`` has of them, if any."""
        values = sorted(set(values))
        folder = self._written(df.where(F.col(by).isin(values)), name, [by])
        kept = [s for s in self.tables.get(name, {"slices": []})["slices"] if s[0] not in values]
        self.tables[name] = {"by": by, "slices": sorted([*kept, *([v, folder] for v in values)])}

    def commit(self) -> int:
        """All changes at once; ``CommitConflict`` if another commit came first."""
        version = self.base + 1
        record = json.dumps({"version": version, "tables": self.tables}, ensure_ascii=False, indent=0)
        if not self.store._files.create(f"{version:020d}", record):
            raise CommitConflict(f"version {version} of {self.store.root} was committed by another writer")
        return version


def upsert_files(
    store: Store, name: str, schema: T.StructType, source: DataFrame, key: Sequence[str], columns: Sequence[str],
    touched_at: Column | None = None, stats_key: str | None = None,
) -> tuple[int, list[str]]:
    """``merge.upsert`` on a table of the store as one commit: its version, and the files rewritten.

    The files are found by the keys of ``source``: with a small batch these are broadcast, and
    of the table only the key columns are read. Rows of other files are not read again,
    sorted, shuffled or written. Keys that no file holds are inserted.
    """
    change = store.begin()
    target = store.read(name, schema, change.base)
    named = target.select(*key, F.col("_metadata.file_path").alias("_file"))
    found = named.join(source.select(*key).distinct(), list(key), "left_semi").select("_file").distinct()
    files = sorted(r[0] for r in found.collect())  # as many as the table has files at most
    held = store.spark.read.schema(schema).parquet(*files) if files else store.spark.createDataFrame([], schema)
    change.rewrite(name, files, upsert(held, source, key, columns, touched_at), stats_key)
    return change.commit(), files
