"""SimHash near-duplicates through a grid over segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritpool.llm.components import components
from meritpool.llm.frames import landed, pylist

SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SLICE = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """The fingerprint of one text; zero where it has no word."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        part = np.array(hashes[i : i + SLICE], "<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long, for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in pylist(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _cells(fp: Column) -> list[tuple[int, Column]]:
    """(half, point): the counts of set bits in 2-bit segments, 16 of them to a half.

    A point holds each count (0 to 2) in two bits of a long, so that one step
    along axis i is an addition of 4**i.
    """
    halves = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return [(i, half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))) for i, half in enumerate(halves)]


def _above(point: Column, axis: int) -> Column:
    """The neighbour one step up along an axis; null where the count is at its end."""
    count = F.shiftright(point, 2 * axis).bitwiseAND(F.lit(3))
    return F.when(count < 2, point + F.lit(4**axis))


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (v, u) of different fingerprints of ``nodes`` (fp) at most ``max_bits`` apart.

    The Manhattan distance between two points of segment counts is never above
    the number of differing bits. So of the two halves of linked fingerprints at
    least one pair lies max_bits // 2 or fewer steps apart: in one cell of the
    grid, or, from two bits on, in two cells that touch. Each fingerprint stands in
    its two cells and asks there and in the cells one step up; the answers are
    verified bit by bit inside the join. A crowded cell is split by Spark's skew join.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid looks one step around: max_bits is 0 to 3")
    stand = nodes.select(
        F.col("fp").alias("u"),
        F.explode(F.array(*(F.struct(F.lit(h).alias("half"), p.alias("cell")) for h, p in _cells(F.col("fp"))))).alias("at"),
    ).select("u", "at.half", "at.cell")
    steps = [
        F.struct(F.lit(h).alias("half"), (p if axis < 0 else _above(p, axis)).alias("cell"), F.lit(axis >= 0).alias("up"))
        for h, p in _cells(F.col("fp"))
        for axis in range(-1, 16 if max_bits >= 2 else 0)
    ]
    ask = (
        nodes.select(F.col("fp").alias("v"), F.explode(F.array(*steps)).alias("at"))
        .select("v", "at.half", "at.cell", "at.up")
        .where("cell is not null")
    )
    near = F.bit_count(F.col("v").bitwiseXOR(F.col("u"))) <= max_bits
    return ask.join(stand, ["half", "cell"]).where(near & (F.col("up") | (F.col("v") > F.col("u")))).select("v", "u")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of ``docs``.

    component_id is the smallest doc_id that links of ``max_bits`` or fewer
    differing bits reach. Copies meet in one fingerprint before anything is joined.
    Null and empty texts have the fingerprint zero, which links like any other.
    Rows with a null doc_id get a fingerprint and a component, and name none; a
    component of such rows only is null. Repeated rows come out as often as they
    came in. Other columns are left alone. An empty table gives no rows.
    """
    marked = landed(fingerprints(docs, shingle))
    nodes = landed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes, max_bits))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).hint("rebalance")
    named = landed(rooted.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component.

    That is the row whose doc_id is the component's smallest. Rows that repeat a
    doc_id are one document and stay or go together; so are those whose doc_id is
    null, which stay if one of them is in a component without a named row.
    """
    first = near_duplicates(docs, shingle, max_bits).where("doc_id <=> component_id")
    kept = first.select(F.col("doc_id").alias("first")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["first"]), "left_semi")
