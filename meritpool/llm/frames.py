"""Frame helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy helpers look at together; a longer text goes alone.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.TemporaryDirectory()  # the driver's own; Spark serves the file from here until it ends
    archive = f"{folder.name}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped[context.applicationId] = folder


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session that runs in one process gets one of its own where that is unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def landed(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder of ``spark.checkpoint.dir`` and read back.

    Cuts the lineage: executors lost later don't take the rows along.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key() -> Column:
    """With doc_id, names a document: rows that agree in both are one document."""
    return F.xxhash64("text")


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, by the modulus; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def blocks(
    texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES, lower: bool = False
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts as (first row, end row, bytes, offsets); null is empty.

    Only the texts of a run are converted at a time.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < len(texts):
        before = int(ends[row - 1]) if row else 0
        end = max(row + 1, int(np.searchsorted(ends, before + limit, "right")))
        part = texts.slice(row, end - row).cast(pa.large_string()).fill_null("")
        part = pc.utf8_lower(part) if lower else part
        _, at, data = part.buffers()
        offsets = np.frombuffer(at, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        yield row, end, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        row = end


def pylist(texts: pa.Array) -> Iterable[str]:
    return (t.as_py() or "" for t in texts)
