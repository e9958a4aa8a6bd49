"""A Merkle manifest of a table: a log of tree nodes by source, roots, and proofs.

Every row is a leaf; the leaves of a source stand in the order of doc_id (rows with one
doc_id by their digests, null ids first). While more than one node remains, each run of
ARITY neighbours (the last run may be shorter, even one) becomes a node. What remains
is the source's subroot; the subroots in the order of their sources are the leaves of the
top tree, whose last node is the root. A node's digest is the sha256 of its children's
digests as hex text; a leaf's is that of its row (``leaf_digest``).

The log holds the nodes of a tree in the order in which they are complete when leaves are
appended one by one: postorder. A node that covers the leaves up to ``end`` (not included)
at ``level`` has the place

    level + floor((end - 1) / ARITY^0) + floor((end - 1) / ARITY^1) + ...

so the place of any sibling is known without a look at the tree. Builders take aligned
runs of ARITY^height leaves, which are whole subtrees, and write their nodes in that order;
their last nodes are the leaves of the builders above. Hot sources are many builders.
Proofs come from the log in the same steps, from the top down: a builder's nodes prove the
way to its own last node, and the proof of that node is the same for all of its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritpool.llm.frames import landed

ARITY = 3
#: Levels that one builder works up: its leaves are ARITY^HEIGHT at most.
HEIGHT = 7
#: Fixed value: the columns of a leaf, in their order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

#: A tier of the log. ``claimed`` is what is said to be the digest of a leaf.
_LOG = "tree string, block long, level int, at long, index long, size long, digest string, doc_id long, claimed string"
_STEPS = "array<struct<left:string,right:string>>"
_PROVED = f"tree string, index long, digest string, doc_id long, claimed string, proof {_STEPS}"
_FOLDED = "tree string, index long, digest string, doc_id long, claimed string, proof_sha256 string, folded_root string"

_ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(),
    _STEPS: pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])),
}


def leaf_digest(**values: Column) -> Column:
    """sha256 of the values in the order of COLUMNS, each with its length in bytes; null is '-'."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(part(values[c]) for c in COLUMNS)), 256)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def place(end: int, level: int) -> int:
    """Where the log has the node of ``level`` whose leaves end before ``end``."""
    out, rest = level, end - 1
    while rest:
        out, rest = out + rest, rest // ARITY
    return out


def height_of(size: int) -> int:
    """Levels above the leaves of a tree."""
    out = 0
    while size > 1:
        out, size = out + 1, -(-size // ARITY)
    return out


def _numbered(nodes: DataFrame) -> DataFrame:
    """tree, index, size, digest, doc_id and claimed of leaves with tree, by, digest, tie, doc_id
    and claimed: each leaf's index in its tree by ``by`` and digest, and the tree's size.

    A range partitioning splits a hot tree; rows are counted within a part, and the counts of
    the parts before are added. ``tie`` tells equal rows apart, so that copies are split too.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "by", "digest", "tie"]
    dealt = nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    counted = landed(dealt.mapInArrow(_count, T.StructType([*dealt.schema.fields, T.StructField("n", T.LongType())])))
    counts = counted.groupBy("tree", "part").agg(F.count("*").alias("own"))
    before = Window.partitionBy("tree").orderBy("part")
    offsets = counts.select(
        F.col("tree").alias("_tree"), F.col("part").alias("_part"), (F.sum("own").over(before) - F.col("own")).alias("offset"),
        F.sum("own").over(Window.partitionBy("tree")).alias("size"),
    )
    joined = counted.join(offsets, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("part") == F.col("_part")))
    return joined.select("tree", (F.col("offset") + F.col("n")).alias("index"), "size", "digest", "doc_id", "claimed")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted rows of a part by tree."""
    tree, n = object(), 0
    for batch in batches:
        numbers = []
        for own in batch.column("tree").to_pylist():
            tree, n = own, (n + 1 if own == tree else 0)
            numbers.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "n"])


def _by_builder(rows: Callable[[list[dict]], Iterator[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows`` of each builder's group, from parts that are sorted by tree and block."""
    names, kinds = zip(*(f.split(" ", 1) for f in schema.split(", ")), strict=True)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and (row["tree"], row["block"]) != (group[0]["tree"], group[0]["block"]):
                    yield group
                    group = []
                group.append(row)
        if group:
            yield group

    def batch(kept: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for group in groups(batches):
            for row in rows(group):
                kept.append(row)
                if len(kept) == 4096:
                    yield batch(kept)
                    kept = []
        if kept:
            yield batch(kept)

    return run


def _builder(base: int, height: int) -> Callable[[list[dict]], Iterator[tuple]]:
    """Appends the nodes above the nodes of level ``base`` to the log, and leaves themselves."""

    def build(group: list[dict]) -> Iterator[tuple]:
        size, block, tree = group[0]["size"], group[0]["block"], group[0]["tree"]
        top = min(base + height, height_of(size))
        runs: list[list[str]] = [[] for _ in range(height)]
        for row in group:
            level, digest, own = base, row["digest"], (row["doc_id"], row["claimed"])
            end = min((row["index"] + 1) * ARITY**base, size)
            while True:
                if level > base or not base:
                    yield tree, block, level, place(end, level), (end - 1) // ARITY**level, size, digest, *own
                if level == top:
                    break
                run, own = runs[level - base], (None, None)
                run.append(digest)
                if len(run) < ARITY and end < size:
                    break
                digest = sha("".join(run))
                run.clear()
                level += 1

    return build


def _block(height: int) -> Column:
    return F.floor(F.col("index") / F.lit(ARITY**height)).alias("block")


def _tiers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The log by tiers of builders, bottom first."""
    levels = height_of(nodes.agg(F.max("size")).first()[0] or 0)
    tiers: list[DataFrame] = []
    while True:
        base = len(tiers) * height
        dealt = nodes.withColumn("block", _block(height)).repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
        tiers.append(landed(dealt.mapInArrow(_by_builder(_builder(base, height), _LOG), _LOG)))
        if base + height >= levels:
            return tiers
        nodes = tiers[-1].where(F.col("level") == base + height)


def _roots(tiers: list[DataFrame]) -> DataFrame:
    """tree, root (the digest of its last node) and levels."""
    columns = ("tree", "level", "index", "digest")
    nodes = tiers[0].select(*columns)
    for log in tiers[1:]:
        nodes = nodes.unionByName(log.select(*columns))
    return nodes.where("index = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("root"), F.max("level").alias("levels"))


def _prover(base: int, height: int, folded: bool) -> Callable[[list[dict]], Iterator[tuple]]:
    """The ways from the nodes of level ``base`` up to their tree's root, and on along ``above``.

    The siblings are taken from the builder's part of the log by their places.
    """

    def prove(group: list[dict]) -> Iterator[tuple]:
        size = group[0]["size"]
        above = next((row["above"] for row in group if row["above"] is not None), [])
        top = min(base + height, height_of(size))
        log = {row["at"]: row["digest"] for row in group}
        for row in group:
            if row["level"] != base:
                continue
            index, proof = row["index"], []
            for level in range(base, top):
                span, first = ARITY**level, index - index % ARITY
                run = range(first, min(first + ARITY, -(-size // span)))
                digests = [log[place(min((i + 1) * span, size), level)] for i in run]
                own = index - first
                proof.append({"left": "".join(digests[:own]), "right": "".join(digests[own + 1 :])})
                index = first // ARITY
            proof += above
            named = (row["tree"], row["index"], row["digest"], row["doc_id"], row["claimed"])
            if folded:
                yield *named, sha("".join(s["left"] + s["right"] for s in proof)), fold(row["claimed"], proof)
            else:
                yield *named, proof

    return prove


def _proofs(tiers: list[DataFrame], over: DataFrame, height: int, folded: bool = False) -> DataFrame:
    """The leaves of all trees with their proofs, or with the digest of the proof and the root it leads to.

    ``over`` has tree, levels and above: the proof of the tree's own root. From the top tier down,
    the proof of a builder's last node is what lies above its leaves; only its first leaf
    carries it to the builder.
    """
    proved = None
    for tier in reversed(range(len(tiers))):
        base, log = tier * height, tiers[tier]
        if tier:  # the leaves of these builders were written by the tier below
            log = log.unionByName(tiers[tier - 1].where(F.col("level") == base).withColumn("block", _block(height)))
        small = over.where(F.col("levels") < base + height) if proved is not None else over
        above = small.select("tree", F.lit(0).cast("long").alias("block"), "above")
        if proved is not None:
            above = above.unionByName(proved.select("tree", F.col("index").alias("block"), F.col("proof").alias("above")))
        above = above.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "above")
        first = (F.col("level") == base) & (F.col("index") == F.col("block") * ARITY**height)
        same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))
        rows = log.where(first).join(above, same, "left").drop("_tree", "_block").unionByName(
            log.where(~first).withColumn("above", F.lit(None).cast(_STEPS))
        )
        dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
        schema = _FOLDED if folded and not tier else _PROVED
        proved = dealt.mapInArrow(_by_builder(_prover(base, height, folded and not tier), schema), schema)
        if tier:
            proved = landed(proved)
    return proved


@dataclass
class Manifest:
    """The logs of the trees of all sources and of the top tree, written down.

    ``roots`` has tree (a source), subroot, levels, above (the proof of the subroot) and root.
    """

    log: list[DataFrame]
    top: list[DataFrame]
    roots: DataFrame
    height: int

    def proofs(self) -> DataFrame:
        """tree, index, digest, doc_id, claimed and proof (siblings by level) of each leaf."""
        return _proofs(self.log, self.roots, self.height)

    def verified(self) -> DataFrame:
        """tree, index, digest, doc_id, claimed, proof_sha256 (of the siblings, one after the other),
        folded_root (what the claimed leaf leads to), subroot, root and verified of each leaf."""
        folded = _proofs(self.log, self.roots, self.height, folded=True)
        roots = self.roots.select(F.col("tree").alias("_tree"), "subroot", "root")
        joined = folded.join(roots, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
        return joined.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of ``docs``.

    There may be a column ``claimed_text``: the text that a copy of the row is said to
    have, whose leaf is then proved against the original siblings. Nulls are
    values of their own; a null source is a source before all others. Repeated rows are leaves
    each. Other columns are not looked at. An empty table has no roots and no rows.
    """
    values = {c: F.col(c) for c in COLUMNS}
    own = leaf_digest(**values)
    said = own
    if "claimed_text" in docs.columns:
        text, other = F.col("text"), F.col("claimed_text")
        said = F.when(~text.eqNullSafe(other), leaf_digest(**{**values, "text": other})).otherwise(own)
    leaves = landed(
        docs.select(
            F.col("source").alias("tree"), F.col("doc_id").alias("by"), own.alias("digest"),
            F.monotonically_increasing_id().alias("tie"), "doc_id", said.alias("claimed"),
        )
    )
    log = _tiers(_numbered(leaves), height)
    subroots = _roots(log)
    heads = subroots.select(
        F.lit("").alias("tree"), F.col("tree").alias("by"), F.col("root").alias("digest"), F.lit(0).alias("tie"),
        F.lit(None).cast("long").alias("doc_id"), F.col("tree").alias("claimed"),  # the source's name goes along
    )
    top = _tiers(_numbered(heads), height)
    last = _roots(top)
    nothing = last.select("tree", "levels", F.array().cast(_STEPS).alias("above"))
    ways = _proofs(top, nothing, height).join(last.drop("levels"), "tree").select(
        F.col("claimed").alias("_tree"), F.col("proof").alias("above"), "root"
    )
    roots = landed(
        subroots.withColumnRenamed("root", "subroot").join(ways, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    )
    return Manifest(log, top, roots, height)


def tampered(docs: DataFrame) -> DataFrame:
    """``docs`` with claimed_text: where 2 divides the crc32 of the decimal doc_id, the text without line ends."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.withColumn("claimed_text", F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def fold(leaf: str, proof: list[dict]) -> str:
    """The root that a leaf and its siblings lead to."""
    for step in proof:
        leaf = sha(step["left"] + leaf + step["right"])
    return leaf
