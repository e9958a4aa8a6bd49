"""Linear models over sparse rows, trained in shards whose weights are averaged."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritpool.llm.frames import landed, text_key

SHARDS = 6
ROUNDS = 3
EPOCHS = 8
BATCH = 128
RATE = 0.2
DECAY = 1e-5

#: Takes margins and labels of a batch, gives the derivative of its risk by margin.
Slope = Callable[[np.ndarray, np.ndarray], np.ndarray]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def LOGISTIC(z: np.ndarray, y: np.ndarray) -> np.ndarray:  # noqa: N802
    return (sigmoid(z) - y) / len(y)


@dataclass
class Linear:
    weights: np.ndarray  # float32, the intercept last
    scale: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margin + self.shift)


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(part, label, text) of at most ``sample`` labelled documents, one for an id.

    The labelled ids with the smallest hashes are chosen, so the choice does not
    depend on the order of rows; only this bounded list of ids is broadcast. Of the
    texts of a repeated id the one with the smallest hash is taken, in the map tasks first.
    part is 0 to 9 by another hash of the id.
    """
    ids = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id")
        .limit(sample)
    )
    part = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(10)).cast("int").alias("part")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(text_key().alias("key"), "text")).alias("row"))
    return one.select(part, "label", "row.text")


def _shard(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """(part, label, bounds, index, value) of the rows of a shard."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    one = pa.Table.from_batches(got).combine_chunks()
    index = one["index"].combine_chunks()
    sizes = np.diff(index.offsets.to_numpy())
    return (
        one["part"].to_numpy(), one["label"].to_numpy(), np.concatenate(([0], np.cumsum(sizes))),
        index.flatten().to_numpy(), one["value"].combine_chunks().flatten().to_numpy(),
    )


def _margins(w: np.ndarray, scale: float, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(w[index] * value, dtype=np.float64)))
    return (sums[bounds[1:]] - sums[bounds[:-1]]) * scale + w[-1]


def fit(
    rows: DataFrame,
    dim: int,
    slope: Slope,
    scale: float = 1.0,
    calibrate: bool = False,
    epochs: int = EPOCHS,
    batch: int = BATCH,
    decay: float = DECAY,
) -> Linear | None:
    """Weights for ``rows`` (part, label, index, value); None without rows.

    The rows, bounded by the caller, are written down once. In each round every
    shard starts from the average weights and runs some epochs of Adagrad over
    batches of its own rows; the averages by rows are the next start. What comes to the
    driver is one weight vector from each of SHARDS tasks. With ``calibrate``, rows
    of the parts 8 and 9 don't train but fit slope and shift of the probability.
    """
    kept = landed(rows.repartition(SHARDS)).coalesce(SHARDS)
    weights = np.zeros(dim + 1, np.float32)

    def train(start: np.ndarray, seed: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data = _shard(batches)
            if data is None:
                return
            part, label, bounds, index, value = data
            use = np.flatnonzero(part < 8) if calibrate else np.arange(len(part))
            if not len(use):
                return
            w, seen = start.astype(np.float64), np.full(dim + 1, 1e-8)
            dice = np.random.default_rng(seed)
            for _ in range(epochs):
                order = dice.permutation(use)
                for at in range(0, len(order), batch):
                    some = order[at : at + batch]
                    sizes = bounds[some + 1] - bounds[some]
                    take = np.repeat(bounds[some] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
                    i, v = index[take], value[take]
                    z = _margins(w, scale, np.concatenate(([0], np.cumsum(sizes))), i, v)
                    g = slope(z, label[some])
                    step = np.bincount(i, np.repeat(g * scale, sizes) * v, minlength=dim + 1)
                    step[-1] = g.sum()
                    step[:-1] += decay * w[:-1]
                    seen += step * step
                    w -= RATE * step / np.sqrt(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(use)], pa.int64()), pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["n", "w"]
            )

        return run

    for r in range(ROUNDS):
        got = kept.mapInArrow(train(weights, r), "n long, w binary").collect()
        if not got:
            return None
        total = sum(x.n for x in got)
        weights = sum(np.frombuffer(x.w, np.float32) * np.float32(x.n / total) for x in got)
    model = Linear(weights, scale)
    if calibrate:
        model.slope, model.shift = _platt(kept, model)
    return model


def _platt(kept: DataFrame, model: Linear) -> tuple[float, float]:
    """Slope and shift of the probability from the margins of the rows kept for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = _shard(batches)
        if data is None:
            return
        part, label, bounds, index, value = data
        z = _margins(model.weights, model.scale, bounds, index, value)[part >= 8]
        yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(label[part >= 8])], ["z", "y"])

    got = kept.mapInArrow(run, "z double, y double").collect()  # a fifth of the bounded sample
    z, y = np.array([x.z for x in got]), np.array([x.y for x in got])
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    y = np.where(y > 0.5, ((y > 0.5).sum() + 1) / ((y > 0.5).sum() + 2), 1 / ((y <= 0.5).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method with a ridge
        p = sigmoid(a * z + b)
        g = np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum()])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)
