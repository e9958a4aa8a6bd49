"""Exact removal of byte strings that occur twice, over a sampled suffix array.

Every window of ``length`` bytes selects one place in it: the leftmost of the
grams of GRAM bytes with the smallest hash. Equal windows select the same place in
them, so windows that are equal anywhere meet under the gram of their place. Windows
in a row that select one place are one run, and a run is one row.

Grams that occur once are done. Runs with equal bytes are repeated as a whole; they
are counted by hash, in the map tasks first, and not sorted. What is left under a gram
are runs that differ: their suffixes from the place on, and the reversed prefixes before
it, are sorted by ``deep_shallow`` (multikey quicksort, then blind tries). Two runs
whose common prefix and common suffix around the place add up to ``length`` share
windows. Joining neighbours in the suffix order by falling common prefix, and looking
at neighbours in the prefix order only, finds all windows without comparing all pairs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritpool.llm import deep_shallow
from meritpool.llm.frames import blocks, landed, text_key
from meritpool.llm.words import least, prefix, spans

LENGTH = 400
GRAM = 100
#: Different runs under one gram that one task sorts. Grams with more are split by
#: window instead: each window is a row, and equal ones are counted by Spark.
GROUP = 10_000
#: Bytes of a document that are looked at together; window starts are dealt out to such parts.
PART = 1 << 20

_HIGH = np.uint64(0xFFFFFFFF00000000)


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, place - start, gram hash, content hash) of each run.

    start counts from the beginning of the text; the content is all bytes of the run's windows.
    """
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = prefix(data)
    at = np.arange(len(data) - gram + 1)
    grams = spans(sums, at, at + gram)
    best = (least((grams & _HIGH) | at.astype(np.uint64), length - gram + 1) & ~_HIGH).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(best)]
    start = np.flatnonzero(np.arange(len(best)) + length <= offsets[text + 1])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    place, text = best[start], text[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(start)))
    begin, place, text = start[first], place[first], text[first]
    content = spans(sums, begin, begin + windows - 1 + length)
    return text, begin - offsets[text], windows, place - begin, grams[place].view(np.int64), content.view(np.int64)


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of all documents: doc_id, key, start, windows, place, gram, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in blocks(batch.column(2), PART):
                # a text larger than a part is cut into parts that overlap by a window
                for cut in range(0, max(1, len(data)), PART) if len(offsets) == 2 else [0]:
                    some = data[cut : cut + PART + length - 1] if len(offsets) == 2 else data
                    ends = np.array([0, len(some)]) if len(offsets) == 2 else offsets
                    text, start, windows, place, key, content = runs_of(some, ends, length, gram)
                    who = pa.array(text + row, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(who), batch.column(1).take(who), pa.array(start + cut, pa.int64()),
                            pa.array(windows.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(key), pa.array(content),
                        ],
                        ["doc_id", "key", "start", "windows", "place", "gram", "content"],
                    )

    return docs.select("doc_id", "key", "text").mapInArrow(
        run, "doc_id long, key long, start long, windows int, place int, gram long, content long"
    )


def shared_windows(contents: list[bytes], places: list[int], windows: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each of some different runs under one gram, the ranges [low, high] of its
    windows that another of them has too. ``places`` are those of the gram in the runs."""
    n = len(contents)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    right = [c[p:] for c, p in zip(contents, places, strict=True)]
    left = [c[:p][::-1] for c, p in zip(contents, places, strict=True)]
    order = deep_shallow.sort(right)
    rank = [0] * n
    for r, i in enumerate(deep_shallow.sort(left)):
        rank[i] = r
    by_rank = sorted(range(n), key=rank.__getitem__)
    common = [deep_shallow.common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]

    def look(a: int, b: int, ahead: int) -> None:
        back = deep_shallow.common(left[a], left[b])
        if back + ahead >= length:
            for i in (a, b):
                low, high = places[i] - back, places[i] - (length - ahead)
                low, high = max(0, low), min(windows[i] - 1, high)
                if low <= high:
                    found[i].append((low, high))

    head = list(range(n))
    ranks = [[rank[i]] for i in range(n)]

    def top(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    # clusters of runs that agree for `ahead` bytes from the gram on; a pair that is
    # not next to each other in the order of prefixes has better partners in between
    for at in sorted(range(n - 1), key=lambda k: -common[k]):
        ahead = common[at]
        a, b = top(order[at]), top(order[at + 1])
        if len(ranks[a]) < len(ranks[b]):
            a, b = b, a
        into = ranks[a]
        for r in ranks[b]:
            spot = bisect_left(into, r)
            for near in (spot - 1, spot):
                if 0 <= near < len(into):
                    look(by_rank[r], by_rank[into[near]], ahead)
            insort(into, r)
        ranks[b] = []
        head[b] = a
    return found


def _solved(rows: DataFrame, length: int) -> DataFrame:
    """Byte spans of the runs that share windows with others under their gram.

    ``rows`` are dealt out by gram and sorted; a task holds the runs of one gram at a
    time, of which the caller sends GROUP at most.
    """

    def solve(group: list[tuple]) -> Iterator[tuple]:
        group = list({g[:3]: g for g in group}.values())  # repeated rows bring a run twice
        if len(group) < 2:
            return
        found = shared_windows([g[5] for g in group], [g[4] for g in group], [g[3] for g in group], length)
        for (doc, key, start, *_), ranges in zip(group, found, strict=True):
            for low, high in set(ranges):
                yield doc, key, start + low, start + high + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, group, out = None, [], []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "key", "low", "high"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            for g, *row in zip(batch.column(0).to_pylist(), *columns, strict=True):
                if g != gram:
                    out.extend(solve(group))
                    gram, group = g, []
                group.append(tuple(row))
            if len(out) > 50_000:
                yield batch_of()
                out.clear()
        out.extend(solve(group))
        yield batch_of()

    return (
        rows.select("gram", "doc_id", "key", "start", "windows", "place", "bytes")
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(run, "doc_id long, key long, low long, high long")
    )


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many runs, window by window."""
    window = F.substring("bytes", F.col("at") + 1, length)
    windows = (
        rows.select("gram", "doc_id", "key", "start", "bytes", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("at"))
        .select("doc_id", "key", (F.col("start") + F.col("at")).alias("low"), "gram", F.xxhash64(window).alias("h"), F.hash(window).alias("g"))
        .distinct()  # repeated rows bring a run twice
    )
    twice = windows.groupBy("gram", "h", "g").agg(F.count("*").alias("n")).where("n > 1").drop("n").hint("rebalance")
    return windows.join(twice, ["gram", "h", "g"], "left_semi").select("doc_id", "key", "low", (F.col("low") + length).alias("high"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, key, low, high): bytes of ``docs`` (doc_id, key, text) that repeated strings cover.

    Spans may overlap and come twice.
    """
    runs = landed(_runs(docs, length, gram))
    grams = (
        runs.groupBy("gram")
        .agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("differ"))
        .where("n > 1")
        .drop("n")
        .hint("rebalance")
    )
    met = landed(runs.join(grams, "gram"))
    end = F.col("start") + F.col("windows") - 1 + length
    same = met.where("not differ").select("doc_id", "key", F.col("start").alias("low"), end.alias("high"))
    # under the other grams, runs with equal bytes count as one, whose copies are repeated as a whole
    differ = met.where("differ")
    kinds = landed(
        differ.groupBy("gram", "content").agg(
            F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "key", "start", "windows", "place"))
        )
    )
    copied = kinds.where("n > 1").select("gram", "content").hint("rebalance")
    copies = differ.join(copied, ["gram", "content"], "left_semi").select("doc_id", "key", F.col("start").alias("low"), end.alias("high"))
    large = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).select("gram", (F.col("kinds") > group).alias("large"))
    wanted = (
        kinds.join(large.hint("rebalance"), "gram")
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("gram", "start", "windows", "place", "large")).alias("runs"))
        .hint("rebalance")
    )
    texts = docs.withColumnRenamed("doc_id", "id").withColumnRenamed("key", "k")
    match = texts["id"].eqNullSafe(wanted["doc_id"]) & (texts["k"] == wanted["key"])
    bytes_of = f"substring(cast(text as binary), int(r.start + 1), int(r.windows + {length - 1})) as bytes"
    cut = F.expr(
        "transform(runs, r -> struct(r.gram as gram, r.start as start, r.windows as windows, r.place as place, "
        f"r.large as large, {bytes_of}))"
    )
    read = landed(texts.join(wanted, match).select("doc_id", "key", F.inline(cut)))
    found = _solved(read.where("not large"), length).union(_counted(read.where("large"), length))
    return same.union(copies).union(found)


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated, removed_share and kept (bytes)
    for each row of ``docs``.

    Removed is each UTF-8 byte under a string of ``length`` bytes that also starts
    elsewhere, in the same document or another, judged on the input. Null is an
    empty text. Rows that repeat a doc_id and a text are copies of each other, so their
    long strings go. Null doc_ids are treated like others. kept may end inside a
    character. repeated says that bytes went, removed_share which part of them (0 of an empty text). Other columns are not read. An empty table gives no rows.
    """
    if length < 2 * gram:
        raise ValueError("length must be at least twice the gram")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    spans_of = (
        repeated_spans(docs, length, gram, group)
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("low", "high")).alias("spans"))
        .withColumnsRenamed({"doc_id": "id", "key": "k"})
        .hint("rebalance")
    )
    joined = docs.join(spans_of, docs["doc_id"].eqNullSafe(spans_of["id"]) & (docs["key"] == spans_of["k"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            ends = found.offsets.to_numpy() if len(found) else np.zeros(1, np.int32)
            pairs = found.values
            low, high = pairs.field("low").to_numpy(), pairs.field("high").to_numpy()
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                text = (batch.column(1)[i].as_py() or "").encode()
                spans_here = merged(low[ends[i] : ends[i + 1]], high[ends[i] : ends[i + 1]])
                kept, at = [], 0
                for a, b in spans_here:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                gone = len(text) - len(left)
                share = gone / max(1, len(text))
                rows.append((len(text), gone, len(spans_here), hashlib.sha256(left).hexdigest(), gone > 0, share, left))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated", "removed_share", "kept"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean, "
        "removed_share double, kept binary"
    )


def merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """The maximal spans of some spans, in order; touching ones are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(low.tolist(), high.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
