"""Quality rules: counts of whole texts, and a classifier over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritpool.llm import linear
from meritpool.llm.frames import blocks, fold
from meritpool.llm.words import BYTE, LOWER, WHITE, lines, mix, per_text, prefix, repeated, spans, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BITS = 18
#: Labelled documents that the classifier is fitted on at most; all rows are scored.
SAMPLE = 6_000
#: Documents whose calibrated probability of good quality is below are not kept.
KEEP_FROM = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    found = words(data, offsets)
    solid = ~WHITE[data]
    text, starts, ends = lines(data, offsets)
    filled = np.concatenate(([0], np.cumsum(solid)))
    with_word = filled[ends] > filled[starts]
    text, starts, ends = text[with_word], starts[with_word], ends[with_word]
    of = mix(text.astype(np.uint64) + np.uint64(1))
    again = repeated(spans(prefix(data), starts, ends) ^ of, first=False)
    h, owner = found.hashes, found.texts()
    twice = np.zeros(len(h), bool)
    if len(h) > 2:
        window = mix(h[:-2] + mix(h[1:-1] + mix(h[2:])))
        inside = owner[:-2] == owner[2:]
        at = np.flatnonzero(inside)
        at = at[repeated(window[at] ^ mix(owner[at].astype(np.uint64) + np.uint64(1)), first=True)]
        for i in range(3):
            twice[at + i] = True
    return {
        "n_words": np.diff(found.bounds),
        "word_chars": per_text(solid & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(text[again], minlength=len(offsets) - 1),
        "n_repeat_words": per_text(twice, found.bounds),
    }


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram, (bucket of each n-gram, bounds of the texts).

    Words and pairs of words in lower case, and runs of 3 and of 5 characters as
    written. Buckets are the top bits of a hash that differs by kind.
    """
    found = words(data, offsets, lower=True)
    shift = np.uint64(64 - BITS)
    yield (mix(found.hashes + np.uint64(1)) >> shift).astype(np.int32), found.bounds
    pairs = mix(found.hashes[:-1] + mix(found.hashes[1:] + np.uint64(2)))
    yield _within(pairs >> shift, found.bounds, 2)
    lead = (data & 0xC0) != 0x80
    ends = np.cumsum(lead)
    at = np.concatenate(([0], ends))[offsets]
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(chars) != (ends[-1] if len(ends) else 0):
        raise ValueError("text is not valid UTF-8")
    h = mix(chars.astype(np.uint64) + np.uint64(3))
    three = h[:-2] + (h[1:-1] << np.uint64(1)) + h[2:] * np.uint64(5) if len(h) > 2 else h[:0]
    yield _within(mix(three) >> shift, at, 3)
    five = three[:-2] + three[2:] * np.uint64(11) if len(three) > 2 else h[:0]
    yield _within(mix(five + np.uint64(4)) >> shift, at, 5)


def _within(buckets: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves out the n-grams of ``size`` that would reach into the next text."""
    most = len(buckets)
    inside = np.ones(most, bool)
    for back in range(1, size):
        at = bounds[1:-1] - back
        inside[at[(at >= 0) & (at < most)]] = False
    kept = np.concatenate(([0], np.cumsum(inside)))
    return buckets[inside].astype(np.int32), kept[np.minimum(bounds, most)]


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text: each kind of n-gram adds up to one."""
    kinds = list(ngrams(data, offsets))
    for i in range(len(offsets) - 1):
        index, value = [], []
        for buckets, bounds in kinds:
            own, n = np.unique(buckets[bounds[i] : bounds[i + 1]], return_counts=True)
            index.append(own)
            value.append(n / max(1, n.sum()))
        yield np.concatenate(index), np.concatenate(value).astype(np.float32)


def _scores(data: np.ndarray, offsets: np.ndarray, model: linear.Linear) -> np.ndarray:
    out = np.full(len(offsets) - 1, float(model.weights[-1]))
    for buckets, bounds in ngrams(data, offsets):
        sums = np.concatenate(([0.0], np.cumsum(model.weights[buckets], dtype=np.float64)))
        out += (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(1, np.diff(bounds)) * model.scale
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> linear.Linear:
    """Logistic regression on a bounded sample of labelled rows, with Platt's calibration.

    ``labels`` are (doc_id, label). Four of five sampled rows fit the weights, the
    fifth the calibration.
    """
    chosen = linear.labelled(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = [], []
            for _, _, data, offsets in blocks(batch.column(2)):
                for i, v in _features(data, offsets):
                    index.append(i)
                    value.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
                ["part", "label", "index", "value"],
            )

    rows = chosen.mapInArrow(run, "part int, label double, index array<int>, value array<float>")
    return linear.fit(rows, 1 << BITS, linear.LOGISTIC, scale=30.0, calibrate=True)


def quality_rules(docs: DataFrame, model: linear.Linear | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The counts and the verdict for each row of ``docs``, in Arrow batches.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, probability. Null and empty texts have zero counts, fail
    the base rules and score as texts without any n-gram. Without a model (no
    labelled rows) probability is null and the base rules decide alone. Rows with
    null or repeated ids are scored like others; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(1)):
                found = counts(data, offsets)
                failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
                p = model.probability(_scores(data, offsets, model)) if model else None
                good = ~failed if p is None else ~failed & (p >= keep_from)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        *(pa.array(found[c].astype(np.int64)) for c in COUNTS),
                        pa.array(failed),
                        pa.array(good),
                        pa.nulls(end - row, pa.float64()) if p is None else pa.array(p),
                    ],
                    ["doc_id", *COUNTS, "base_failed", "kept", "probability"],
                )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, probability double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def training_labels(labels: DataFrame, name: str, modulus: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, label) of the labelled rows outside the held-out fold."""
    return labels.where(F.col(name).isNotNull() & (fold(modulus) != held)).select(
        "doc_id", F.col(name).cast("double").alias("label")
    )
