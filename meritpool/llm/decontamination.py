"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the words of the benchmark. A randomised SVD of all passages
gives a latent space: one Spark job counts which words stand together in a passage, and the
products of the SVD are Spark jobs over these counts. Benchmark items and
windows of all documents are compared there by cosine; what comes close is checked
word by word: by the longest common subsequence, and by the item's answer for paraphrases.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritpool.llm.frames import blocks, landed, text_key
from meritpool.llm.words import MARKS, words

#: Dimensions of the latent space, and what is drawn besides for the randomised range.
RANK, EXTRA = 256, 16
POWER = 2
#: Tasks that each make one partial product in a pass of the fit.
FIT_TASKS = 4
#: Cells of counts that a task of the fit has in memory, occurrences of words that it takes
#: together, and passages that it looks at together.
TABLE, HITS, PIECE = 1 << 24, 1 << 18, 1 << 12
#: Words that are counted with each other by products of matrices. It says how, not what is counted.
FREQUENT = 256
#: Words of a step of the windows, and of the longest part of an item that is one query.
STEP, PART = 16, 112
#: Least cosine of a candidate.
COSINE = 0.35
#: Least share of an item's words in the longest common subsequence, and for a
#: paraphrase, which has the item's answer word for word.
COMMON, PARAPHRASE = 0.8, 0.6
#: Words of the benchmark that are searched for in one pass over the documents: so few
#: items that the latent space tells them apart.
QUERY_WORDS = 10_000
#: A word as the search takes it: no ASCII sign but letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Steps whose words are added up together, and cells of cosines in memory together.
STEPS, CELLS = 1 << 10, 1 << 21
#: Bytes of text that are looked at together.
BLOCK = 1 << 18


def _hashed(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, bounds) for runs of texts, in lower case without punctuation."""
    for row, end, data, offsets in blocks(texts, BLOCK, lower=True):
        found = words(data, offsets, between=MARKS)
        yield row, end, found.hashes, found.bounds


@dataclass
class Vocabulary:
    """The word hashes of some items, sorted, and by their last 16 bits a number for each, or
    the first of several; most other words have none."""

    hashes: np.ndarray

    def __post_init__(self) -> None:
        low, first, n = np.unique(self.hashes & np.uint64(0xFFFF), return_index=True, return_counts=True)
        self.number, self.several = np.full(1 << 16, -1), np.zeros(1 << 16, bool)
        self.number[low.astype(np.int64)], self.several[low.astype(np.int64)] = first, n > 1

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) of the hashes that are in the vocabulary."""
        low = (hashes & np.uint64(0xFFFF)).astype(np.int64)
        at = self.number[low]
        place = np.flatnonzero(at >= 0)
        at, known = at[place], hashes[place]
        held = self.hashes[at] == known
        other = np.flatnonzero(~held & self.several[low[place]])
        at[other] = np.minimum(np.searchsorted(self.hashes, known[other]), len(self.hashes) - 1)
        held[other] = self.hashes[at[other]] == known[other]
        return place[held], at[held]


def _passages(bounds: np.ndarray, size: int) -> np.ndarray:
    """The bounds of runs of ``size`` words that begin anew with each text."""
    count = -(-np.diff(bounds) // size)
    first = np.repeat(bounds[:-1], count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.append(first + inner * size, bounds[-1])


def _owner(cut: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The run between neighbouring ``cut`` that each place is in; both ascend."""
    return np.repeat(np.arange(len(cut) - 1), np.diff(np.searchsorted(place, cut)))


def rarity(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Inverse passage frequencies of the words, counted over all passages of all documents."""
    size = len(vocabulary.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, _, hashes, bounds in _hashed(batch.column(0)):
                cut = _passages(bounds, 4 * STEP)
                place, number = vocabulary.find(hashes)
                key = _owner(cut, place) * size + number
                key = np.unique(key.astype(np.int32) if len(cut) * size < 1 << 31 else key)
                count += np.bincount(key % size, minlength=size)
                total += len(cut) - 1
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1)), pa.array(np.append(count[found], total))], ["word", "n"]
        )

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = rows["word"].to_numpy(), rows["n"].to_numpy()
    count = np.zeros(size)
    count[word[word >= 0]] = n[word >= 0]
    return np.log((n[word < 0].sum() + 2) / (count + 1))


def _stripes(size: int) -> list[tuple[int, int]]:
    """Runs of rows of the upper triangle of ``size`` words that have at most TABLE cells together."""
    out, first, cells = [], 0, 0
    for row in range(size):
        if row > first and cells + size - row > TABLE:
            out.append((first, row))
            first, cells = row, 0
        cells += size - row
    return [*out, (first, size)]


def _by_size(index: np.ndarray, owner: np.ndarray, place: np.ndarray, hot: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(words, counts, other) of the passages with equally many different words, for each such number.

    A column is a passage, its words in the order of ``place``, where the last ``hot`` are the frequent
    ones; counts are their occurrences, other says how many are not frequent, and falls.
    """
    size = len(place)
    word = np.argsort(place)
    key, n = np.unique(owner * size + place[index], return_counts=True)
    own, at = np.divmod(key, size)
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    sizes = np.diff(begin, append=len(own))
    other = np.add.reduceat(at < size - hot, begin, dtype=np.int64) if len(begin) else begin
    order = np.lexsort((-other, sizes))
    ends = np.cumsum(np.bincount(sizes))
    for k in range(1, len(ends)):
        some = order[ends[k - 1] : ends[k]]
        if len(some):
            rows = begin[some] + np.arange(k)[:, None]
            yield word[at[rows]], n[rows].astype(np.int32), other[some]


def _add_pairs(total: np.ndarray, place: np.ndarray, some: tuple[np.ndarray, ...], first: int, end: int) -> None:
    """Adds to rows ``first`` to ``end`` of the upper triangle, one behind the other, how often two
    words stand in one passage, unless both are frequent; a word stands with itself as often as the
    square of its occurrences."""
    words_of, counts, other = some
    for a in range(int(other[0])):
        m = np.searchsorted(-other, -a)  # passages with more than a such words
        low, high = np.minimum(words_of[a, :m], words_of[a:, :m]), np.maximum(words_of[a, :m], words_of[a:, :m])
        n = counts[a, :m] * counts[a:, :m]
        inside = (low >= first) & (low < end) if (first, end) != (0, len(place)) else slice(None)
        np.add.at(total, (place[low[inside]] + high[inside]).ravel(), n[inside].ravel())


def _add_frequent(table: np.ndarray, column: np.ndarray, index: np.ndarray, owner: np.ndarray) -> None:
    """Adds to ``table`` how often the frequent words, which have a column, stand with each other."""
    hot = column[index] >= 0
    size, at = len(table), owner[hot] - owner[0]
    passages = int(owner[-1] - owner[0]) + 1
    vectors = np.bincount(at * size + column[index[hot]], minlength=passages * size)
    vectors = vectors.reshape(passages, size).astype(np.float32)
    table += vectors.T @ vectors


def shared_counts(texts: DataFrame, vocabulary: Vocabulary, rare: np.ndarray) -> DataFrame:
    """(word, counts): how often the words of the vocabulary stand in one passage, over all passages
    of all ``texts`` (column text). That is A'A for occurrences as they are.

    Row ``word`` holds, as compressed 64-bit integers, its products with itself and each later word;
    row -1 the number of passages with a word. The FREQUENT least ``rare`` words are counted
    with each other by products of matrices, all other pairs of the different words of a passage one by
    one. A task has TABLE cells and HITS occurrences in memory, and the sums are taken word by word.
    """
    size = len(vocabulary.hashes)
    stripes = _stripes(size)
    frequent = np.sort(np.argsort(rare, kind="stable")[:FREQUENT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, emitted, held, many = 0, 0, [], 0
        total = np.zeros(max(sum(size - row for row in range(*s)) for s in stripes), np.int32)
        table, column = np.zeros((len(frequent), len(frequent))), np.full(size, -1)
        column[frequent] = np.arange(len(frequent))
        turn = np.argsort(np.argsort(column >= 0, kind="stable"))  # the frequent words come last

        def rows(first: int, end: int, place: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(first, end, 512):
                cuts = [(w, total[place[w] + w : place[w] + size]) for w in range(at, min(end, at + 512))]
                some = [(w, c) for w, c in cuts if c.any()]
                if some:
                    yield _packed([w for w, _ in some], [c for _, c in some])
            total[:] = 0

        def summed(last: bool) -> Iterator[pa.RecordBatch]:
            pieces = []
            if held:
                index, owner = (np.concatenate(part) for part in zip(*held, strict=True))
                cut = np.searchsorted(owner, np.arange(owner[0], owner[-1] + 1 + PIECE, PIECE))
                for a, b in zip(cut, cut[1:], strict=False):
                    _add_frequent(table, column, index[a:b], owner[a:b])
                pieces = list(_by_size(index, owner - owner[0], turn, len(frequent)))
            for first, end in stripes:
                place = np.zeros(size, np.int64)  # of cell (row, 0), which the triangle leaves out
                place[first:end] = np.cumsum(size - np.arange(first, end)) - size
                for some in pieces:
                    _add_pairs(total, place, some, first, end)
                if last:
                    for i, w in enumerate(frequent.tolist()):
                        if first <= w < end:
                            total[place[w] + frequent[i:]] += table[i, i:].astype(np.int32)
                if last or len(stripes) > 1:  # one stripe is kept until the end
                    yield from rows(first, end, place)
            if last:
                table[:] = 0
            held.clear()

        for batch in batches:
            for _, _, hashes, bounds in _hashed(batch.column(0)):
                found, number = vocabulary.find(hashes)
                if not len(found):
                    continue
                owner = _owner(_passages(bounds, 4 * STEP), found)
                owner = passages + np.cumsum(np.diff(owner, prepend=owner[0]) > 0)
                passages = int(owner[-1]) + 1
                held.append((number, owner))
                many += len(number)
                full = passages - emitted > 1 << 18  # a count could pass 32 bits
                if many >= HITS or full:
                    yield from summed(last=full)
                    many, emitted = 0, passages if full else emitted
        yield from summed(last=True)
        yield _packed([-1], [np.array([passages], np.int32)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for w, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = unpacked(part.as_py(), np.int32)
                if w != word:
                    if word is not None:
                        yield _packed([word], [total])
                    word, total = w, counts.astype(np.int64)
                else:
                    total += counts
        if word is not None:
            yield _packed([word], [total])

    kind = "word int, counts binary"
    return texts.select("text").mapInArrow(run, kind).repartition("word").sortWithinPartitions("word").mapInArrow(add, kind)


def _packed(words_of: list[int], counts: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of counts, most of them 0 or small: they travel compressed."""
    packed = [zlib.compress(c.tobytes(), 1) for c in counts]
    return pa.RecordBatch.from_arrays([pa.array(words_of, pa.int32()), pa.array(packed, pa.binary())], ["word", "counts"])


def unpacked(counts: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), kind)


def _times(matrix: DataFrame, right: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """A'A right over the weighted passages, from the counts of words that stand together.

    The FIT_TASKS partial products are added up on an executor; one comes to the driver. What the
    tasks need is broadcast for the pass and dropped after it.
    """
    shape = right.shape
    shared = matrix.sparkSession.sparkContext.broadcast((right * rare[:, None]).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, total = shared.value, np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                word, weight = some.column(0).to_numpy(), some.column(2).to_numpy()
                rows = np.zeros((len(word), shape[0]), np.float64)
                for i, (w, counts) in enumerate(zip(word.tolist(), some.column(1), strict=True)):
                    rows[i, w:] = unpacked(counts.as_py()) * weight[i]
                np.add.at(total, word, rows @ scaled)
                rows[np.arange(len(word)), word] = 0  # the diagonal stands in one triangle
                total += rows.T @ scaled[word]
        yield _row(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (np.frombuffer(x.as_py(), np.float32) for batch in batches for x in batch.column(0))
        yield _row(sum((p.reshape(shape).astype(np.float64) for p in parts), np.zeros(shape)))

    got = matrix.mapInArrow(run, "x binary").repartition(1).mapInArrow(add, "x binary").collect()
    shared.destroy()
    return np.frombuffer(got[0].x, np.float32).reshape(shape).astype(np.float64) * rare[:, None]


def _row(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([matrix.astype(np.float32).tobytes()], pa.binary())], ["x"])


def latent_space(docs: DataFrame, items: DataFrame, vocabulary: Vocabulary, rare: np.ndarray) -> np.ndarray:
    """A row for each word, whose sums over a text are the text's latent coordinates.

    They are those of the TF-IDF vector on the right singular vectors. Fitted on all passages
    of all ``items`` and of all ``docs``, whose weight together is that of the items.
    """
    kinds = [F.lit(False).alias("item"), F.lit(True).alias("item")]
    parts = [shared_counts(t, vocabulary, rare).select("word", "counts", kind) for t, kind in zip((docs, items), kinds, strict=True)]
    counts = landed(parts[0].union(parts[1]))
    n = {r.item: int(unpacked(r.counts)[0]) for r in counts.where("word = -1").collect()}
    share = max(1, n.get(True, 0)) / n[False] if n.get(False) else 1.0
    weight = F.when(F.col("item"), 1.0).otherwise(share).alias("weight")
    matrix = counts.where("word >= 0").select("word", "counts", weight).coalesce(FIT_TASKS)
    drawn = min(len(vocabulary.hashes), RANK + EXTRA)
    basis = np.random.default_rng(6).standard_normal((len(vocabulary.hashes), drawn))
    for _ in range(POWER + 1):
        basis = np.linalg.qr(_times(matrix, basis, rare))[0]
    values, turn = np.linalg.eigh(basis.T @ _times(matrix, basis, rare))
    best = np.argsort(-values)[:RANK]
    best = best[values[best] > 1e-6 * values.max()]
    return (basis @ turn[:, best] * rare[:, None]).astype(np.float32)


@dataclass
class Query:
    item: int
    hashes: np.ndarray
    answer: np.ndarray

    def masks(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, h in enumerate(self.hashes.tolist()):
            out[h] = out.get(h, 0) | 1 << i
        return out


def common_subsequence(masks: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence, bit by bit in whole integers."""
    full = state = (1 << size) - 1
    for word in text:
        match = masks.get(word)
        if match:
            hit = state & match
            state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def _contains(text: np.ndarray, part: np.ndarray) -> bool:
    if not len(part) or len(part) > len(text):
        return False
    at = np.flatnonzero(text[: len(text) - len(part) + 1] == part[0])
    return any(np.array_equal(text[i : i + len(part)], part) for i in at)


def verified(query: Query, masks: dict[int, int], text: np.ndarray) -> float | None:
    """The share of the query's words in the common subsequence, if that shows a leak."""
    size = len(query.hashes)
    share = common_subsequence(masks, size, text.tolist()) / size
    if share >= COMMON or share >= PARAPHRASE and _contains(text, query.answer):
        return share
    return None


def last_sentence(text: str) -> str:
    """What answers an item that has no answer of its own: its last sentence, if it has others before."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if p]
    return parts[-1] if len(parts) > 1 else ""


def _queries(items: list) -> list[Query]:
    """Items as runs of at most PART words; numbered by their place in ``items``."""
    out = []
    texts = pa.array([r.text for r in items], pa.string())
    answers = pa.array([r.answer if r.answer is not None else last_sentence(r.text) for r in items], pa.string())
    said = [h[a:b] for _, _, h, bounds in _hashed(answers) for a, b in zip(bounds, bounds[1:], strict=False)]
    asked = [h[a:b] for _, _, h, bounds in _hashed(texts) for a, b in zip(bounds, bounds[1:], strict=False)]
    for i, hashes in enumerate(asked):
        parts = max(1, -(-len(hashes) // PART))
        out += [Query(i, p, said[i]) for p in np.array_split(hashes, parts) if len(p)]
    return out


def _width(query: Query) -> int:
    """Steps of a window that holds the query wherever it begins."""
    need = -(-(len(query.hashes) + STEP) // STEP)
    return 1 << (need - 1).bit_length()


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(1e-12, np.linalg.norm(rows, axis=1, keepdims=True))


def _added(values: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Windows of twice the width: each with the one ``width`` steps on in the same text."""
    out = values.copy()
    alone = np.flatnonzero(owner[width:] != owner[:-width])
    out[:-width] += values[width:]
    out[alone] = values[alone]
    return out


def _sums(space: np.ndarray, step: np.ndarray, number: np.ndarray, steps: int) -> np.ndarray:
    """For each step the sum of the rows of its words: the first words of all steps
    are added together, then the second ones, and so on. Steps of more words come first."""
    out = np.zeros((steps, space.shape[1]), np.float32)
    first = np.flatnonzero(np.diff(step, prepend=-1))
    sizes = np.diff(first, append=len(step))
    for at in range(0, len(first), STEPS):
        order = at + np.argsort(-sizes[at : at + STEPS], kind="stable")
        begin, falling = first[order], -sizes[order]
        sums = space[number[begin]]
        for k in range(1, -int(falling[0])):
            some = np.searchsorted(falling, -k)  # steps with more than k words
            sums[:some] += space[number[begin[:some] + k]]
        out[step[begin]] = sums
    return out


def _search(docs: DataFrame, queries: list[Query], vocabulary: Vocabulary, space: np.ndarray) -> DataFrame:
    """(doc_id, key, item, share, place): verified leaks of ``queries``, a stated block of queries."""
    by_width: dict[int, list[int]] = {}
    for i, q in enumerate(queries):
        by_width.setdefault(_width(q), []).append(i)
    vectors = _unit(np.stack([space[vocabulary.find(q.hashes)[1]].sum(axis=0) for q in queries]))
    need = np.array([PARAPHRASE * len(q.hashes) for q in queries])
    times = np.zeros((len(queries), len(vocabulary.hashes)), np.int32)
    for i, q in enumerate(queries):
        np.add.at(times[i], vocabulary.find(q.hashes)[1], 1)

    def candidates(steps: np.ndarray, owner: np.ndarray, held: np.ndarray, number: np.ndarray, cut: np.ndarray) -> Iterator[tuple]:
        """(first steps, queries, width) of the windows close to a query that hold enough
        of its words: no common subsequence is longer than what both have in common."""
        sums, width = steps, 1
        for wanted in sorted(by_width):
            while width < wanted:
                sums, width = _added(sums, owner, width), 2 * width
            ask, length = np.array(by_width[wanted]), COSINE * np.linalg.norm(sums, axis=1)
            length[length == 0] = np.inf
            unit = max(1, CELLS // len(ask))
            for at in range(0, len(sums), unit):
                close = sums[at : at + unit] @ vectors[ask].T
                step, which = np.divmod(np.flatnonzero(close >= length[at : at + unit, None]), len(ask))
                step, which = step + at, ask[which]
                few = max(1, CELLS // (8 * (width + 2) * STEP))  # windows whose words are looked at together
                for k in range(0, len(step), few):
                    near, asked = step[k : k + few], which[k : k + few]
                    low = held[np.maximum(0, cut[near] - STEP)]
                    sizes = held[np.minimum(cut[-1], cut[near] + (width + 1) * STEP)] - low
                    pair = np.repeat(np.arange(len(near)), sizes)
                    word = number[np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                    key, n = np.unique(pair * len(vocabulary.hashes) + word, return_counts=True)
                    pair, word = np.divmod(key, len(vocabulary.hashes))
                    shared = np.bincount(pair, np.minimum(n, times[asked[pair], word]), len(near))
                    enough = shared >= need[asked]
                    yield near[enough], asked[enough], width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [q.masks() for q in queries]
        for batch in batches:
            for row, _, hashes, bounds in _hashed(batch.column(2)):
                cut = _passages(bounds, STEP)
                place, number = vocabulary.find(hashes)
                if not len(place):
                    continue
                owner = np.searchsorted(bounds, cut[:-1], "right") - 1
                held = np.zeros(len(hashes) + 1, np.int64)
                held[place + 1] = 1
                held = np.cumsum(held)
                steps = _sums(space, _owner(cut, place), number, len(cut) - 1)
                out: dict[tuple[int, int], tuple[float, int]] = {}
                for first, which, width in candidates(steps, owner, held, number, cut):
                    for step, q in zip(first.tolist(), which.tolist(), strict=True):
                        text = owner[step]
                        low = max(bounds[text], cut[step] - STEP)
                        high = min(bounds[text + 1], cut[step] + (width + 1) * STEP)
                        share = verified(queries[q], masks[q], hashes[low:high])
                        if share is not None and share > out.get((text, q), (0.0,))[0]:
                            out[text, q] = share, int(cut[step] - bounds[text])
                who = pa.array([t + row for t, _ in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(who),
                        batch.column(1).take(who),
                        pa.array([queries[q].item for _, q in out], pa.int32()),
                        pa.array([s for s, _ in out.values()], pa.float64()),
                        pa.array([p for _, p in out.values()], pa.int64()),
                    ],
                    ["doc_id", "key", "item", "share", "place"],
                )

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, item int, share double, place long")


def _dealt(items: DataFrame) -> DataFrame:
    """The different items with their ``block``: runs of QUERY_WORDS words, in the order of a hash.

    Words are counted as the search counts them. A block is over QUERY_WORDS by less than its
    last item. Only hashes and counts, not texts, are brought into one order.
    """
    known = items.distinct().withColumn("hash", F.xxhash64(F.lit(9), "item_id", "text", "answer"))
    sized = known.withColumn("size", F.regexp_count("text", F.lit(WORD))).where("size > 0")
    before = F.sum("size").over(Window.orderBy("hash")) - F.col("size")
    blocks_of = sized.groupBy("hash").agg(F.sum("size").alias("size")).select("hash", F.floor(before / QUERY_WORDS).alias("block"))
    return sized.drop("size").join(blocks_of, "hash").drop("hash")


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, share, place) of all leaks, some of them more than once."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    dealt = landed(_dealt(items.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))))
    found = docs.sparkSession.createDataFrame([], "doc_id long, key long, item_id long, share double, place long")
    for row in dealt.select("block").distinct().orderBy("block").collect():
        mine = dealt.where(F.col("block") == row.block).drop("block")
        block = mine.collect()  # about QUERY_WORDS words
        queries = _queries(block)
        vocabulary = Vocabulary(np.unique(np.concatenate([q.hashes for q in queries])))
        space = latent_space(docs, mine, vocabulary, rarity(docs, vocabulary))
        ids = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], "item int, item_id long")
        hits = _search(docs, queries, vocabulary, space)
        found = found.union(hits.join(F.broadcast(ids), "item").select("doc_id", "key", "item_id", "share", "place"))
    return found


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, place): documents with an item of the benchmark in them.

    ``items`` are item_id, text and, if there is one, answer; without, an item's last
    sentence is its answer. share is the best share of an item's words (of a part, for items of
    over PART words) in the longest common subsequence with a window of the document, place the
    window's first word. An item leaks if the share is COMMON, or PARAPHRASE with
    the answer word for word. Words are in lower case, without punctuation.
    Null and empty texts and items without a word match nothing; null ids are
    carried along; rows that repeat an id are one, repeated items count once. An empty table gives
    no rows. All documents are searched for all items, QUERY_WORDS words of items in a pass.
    """
    return _found(docs, items).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.min("place").alias("place"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item leaks.

    Rows are judged by id and text: a row whose id is null, or stands in other rows too,
    goes for its own text only. An empty table stays empty; without items all rows stay.
    """
    dirty = _found(docs, items).select(F.col("doc_id").alias("_dirty"), F.col("key").alias("_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(dirty["_dirty"]) & F.xxhash64(docs["text"]).eqNullSafe(dirty["_key"])
    return docs.join(dirty, same, "left_anti")
