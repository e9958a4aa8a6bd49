"""Quality from positive and unlabelled texts by non-negative risk (nnPU)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritpool.llm import linear, rules
from meritpool.llm.frames import blocks, fold
from meritpool.llm.words import WHITE, per_text, words

#: Trusted positives, and as many unlabelled texts, that the model is fitted on at most.
SAMPLE = 8_000
#: Documents scored below are rejected.
KEEP_FROM = 0.7
SHARES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8])
SIZES = 2.0 ** np.arange(15)
BINS = 16


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGIT, BANG, BAR = _kind(bytes(range(65, 91))), _kind(b"0123456789"), _kind(b"!?"), _kind(b"|<>")
LETTER = _kind(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
MARK = _kind(bytes(i for i in range(33, 127) if not chr(i).isalnum()))


def measures(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, bin edges) of each dense measure of the texts."""
    base = rules.counts(data, offsets)
    found = words(data, offsets, lower=True)
    n = np.maximum(1, base["n_words"])
    chars = np.maximum(1, base["word_chars"])
    owner = found.texts()
    next_to = np.zeros(len(owner), bool)
    next_to[1:] = (found.hashes[1:] == found.hashes[:-1]) & (owner[1:] == owner[:-1])
    size = found.ends - found.starts
    last = data[found.ends - 1] if len(found.ends) else data[:0]
    total = lambda kind: per_text(kind[data], offsets)
    lines = per_text(data == 10, offsets) + 1
    caps = UPPER[data[found.starts]] & UPPER[data[np.minimum(found.starts + 1, found.ends - 1)]] if len(size) else size
    return [
        (base["n_symbols"] / chars, SHARES),
        (total(UPPER) / np.maximum(1, total(LETTER)), SHARES),
        (total(BANG) / chars, SHARES),
        (total(BAR) / chars, SHARES),
        (total(MARK) / chars, SHARES),
        (total(DIGIT) / chars, SHARES),
        (base["n_repeat_words"] / n, SHARES),
        (base["n_dup_lines"] / lines, SHARES),
        (per_text(next_to, found.bounds) / n, SHARES),
        (per_text(MARK[last], found.bounds) / n, SHARES),
        (per_text(caps, found.bounds) / n, SHARES),
        (per_text(size > 25, found.bounds) / n, SHARES),
        (base["n_words"].astype(float), SIZES),
        (base["word_chars"] / n, SIZES),
        (n / lines, SIZES),
        (per_text(~WHITE[data], offsets) / np.maximum(1, np.diff(offsets)), SHARES),
    ]


DIM = 16 * BINS


def _bins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One bin for each measure of each text: the rows of a sparse design."""
    found = [np.searchsorted(edges, values, "right") + BINS * i for i, (values, edges) in enumerate(measures(data, offsets))]
    return np.stack(found, axis=1).astype(np.int32)


def non_negative(prior: float) -> linear.Slope:
    """Slope of the non-negative unbiased risk with logistic loss.

    Label 1 is a trusted positive, 0 an unlabelled text. The risk on negatives is
    that on unlabelled texts less the prior's share of that on positives; where a
    batch makes it negative, the step goes the other way until it is not.
    """

    def slope(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        yes = y > 0.5
        p, u = max(1, yes.sum()), max(1, (~yes).sum())
        s, loss = linear.sigmoid(z), np.logaddexp(0, z)
        risk = loss[~yes].sum() / u - prior * loss[yes].sum() / p
        on_yes, on_rest = -prior * s / p, s / u
        if risk < 0:
            return np.where(yes, -on_yes, -on_rest)
        return np.where(yes, prior * (s - 1) / p + on_yes, on_rest)

    return slope


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, modulus: int = 4, held: int = 2) -> linear.Linear | None:
    """A model from documents outside the held-out fold; None without positives.

    Trusted positives are rows labelled 1. Unlabelled texts are documents whatever
    their label, which is not read. Both are bounded samples by hash of the id. The
    class prior is estimated as the share of 1 among all labelled rows outside the fold.
    """
    known = rules.training_labels(labels, "quality", modulus, held)
    prior = known.agg(F.avg("label")).first()[0]
    if not prior:
        return None
    positive = linear.labelled(docs, known.where("label = 1"), sample)
    others = docs.where(fold(modulus) != held).select("doc_id", F.lit(0.0).alias("label"))
    rows = positive.union(linear.labelled(docs, others, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_bins(data, offsets) for _, _, data, offsets in blocks(batch.column(2))]
            index = np.concatenate(found) if found else np.zeros((0, 16), np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(index), pa.list_(pa.int32())), pa.array(list(np.ones(index.shape, np.float32)), pa.list_(pa.float32()))],
                ["part", "label", "index", "value"],
            )

    design = rows.mapInArrow(run, "part int, label double, index array<int>, value array<float>")
    return linear.fit(design, DIM, non_negative(min(prior, 0.999)), epochs=30, batch=1024, decay=1e-3)


def _probability(texts: pa.Array, model: linear.Linear | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    w = model.weights.astype(np.float64)
    found = [w[_bins(data, offsets)].sum(axis=1) + w[-1] for _, _, data, offsets in blocks(texts)]
    return model.probability(np.concatenate(found)) if found else np.zeros(0)


def score(docs: DataFrame, model: linear.Linear | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, score and predicted for each row of ``docs``, from its text alone.

    Null and empty texts are scored as texts of no word. Without a model every
    score is 0.5. Rows with null or repeated ids are scored like others; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probability(batch.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= keep_from).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: linear.Linear | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_probability(batch.column(at), model) >= keep_from))

    return docs.mapInArrow(run, docs.schema)
