"""Language identification by interpolated Kneser-Ney models of characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritpool.llm.words import mix

#: Bits of a character class: 0 is anything but a letter, 1 a letter outside the alphabet.
BITS = 10
CLASSES = 1 << BITS
#: Letters of each language, the most frequent ones, that have a class of their own. The letters
#: of some hundred languages fit; if they do not, those that come first by rank in a language do.
LETTERS = 64
#: Characters that are read together.
BLOCK = 1 << 20
#: Part of the learning documents, in tenths, that calibrates and is not counted.
HELD_TENTHS = 1
#: Share of a language's own documents that the rejection threshold lets through.
ACCEPT = 0.995
UNDETERMINED = "und"
SHARPNESS = tuple(float(x) for x in (0.5, 1, 2, 4, 8, 16, 32, 64, 128))

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, a line end after each, and their bounds."""
    low = [t.lower() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low], dtype=np.int64)))
    joined = "\n".join([*low, ""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def grams(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the three-character grams of the texts, and the bounds of each text.

    Runs of other characters count as one word end. A word begins after two word
    ends, so that no gram reaches from one word, or text, into the next.
    """
    chars, bounds = points(texts)
    code = classes[chars].astype(np.int32)
    kept = code > 0
    kept[1:] |= code[:-1] > 0  # the first word end after a letter
    code = code[kept]
    one, two = np.zeros_like(code), np.zeros_like(code)
    one[1:] = code[:-1]
    two[2:] = code[:-2]
    two[one == 0] = 0
    cut = np.concatenate(([0], np.cumsum(kept)))[bounds]
    return (two << (2 * BITS)) | (one << BITS) | code, cut


def _blocks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list[str]]]:
    texts = [t or "" for t in batch.column(at).to_pylist()]
    row = 0
    while row < len(texts):
        end, size = row, 0
        while end < len(texts) and (end == row or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        yield row, end, texts[row:end]
        row = end


def _sums(keys: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of some arrays and how often each comes."""
    held, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for key in keys:
        new, n = np.unique(key, return_counts=True)
        held, where = np.unique(np.concatenate((held, new)), return_inverse=True)
        times = np.bincount(where, np.concatenate((times, n)), len(held)).astype(np.int64)
    return held, times


def _counted(docs: DataFrame, names: list[str], keys: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """(key, n) of the keys of (lang, text), each with the number of its language above ``bits`` bits.

    Each task adds up its rows first.
    """
    number = {n: i for i, n in enumerate(names)}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            langs = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for row, end, texts in _blocks(batch, 1):
                key, cut = keys(texts)
                yield key | (np.repeat(langs[row:end], np.diff(cut)) << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, times = _sums(of(batches))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], ["key", "n"])

    return docs.select("lang", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def alphabet(docs: DataFrame, names: list[str]) -> np.ndarray:
    """The class of each code point: the most frequent letters of each language get their own.

    Letters are chosen by language, so that one with few documents has its own too. What
    comes to the driver is LETTERS rows for a language.
    """

    def of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chars, bounds = points(texts)
        kept = letters()[chars]
        return chars[kept].astype(np.int64), np.concatenate(([0], np.cumsum(kept)))[bounds]

    counted = _counted(docs, names, of, 21).select((F.col("key") % (1 << 21)).alias("c"), F.shiftright("key", 21).alias("lang"), "n")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "c"))
    rows = counted.withColumn("rank", rank).where(F.col("rank") <= LETTERS).groupBy("c").agg(F.min("rank").alias("rank")).collect()
    classes = letters().astype(np.uint16)
    for i, row in enumerate(sorted(rows, key=lambda r: (r["rank"], r.c))[: CLASSES - 2]):
        classes[row.c] = i + 2
    return classes


def count(docs: DataFrame, names: list[str], classes: np.ndarray) -> np.ndarray:
    """(language, key, n) of the grams of (lang, text), counted over all rows.

    What the driver gets is the different grams of each language: some ten thousand where it
    is written in an alphabet, as only LETTERS of its letters have classes of their own.
    """

    def of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return grams(texts, classes)

    rows = _counted(docs, names, of, 3 * BITS).toArrow()
    return np.stack((rows["key"].to_numpy(), rows["n"].to_numpy()), axis=1)


@dataclass
class Hashed:
    """A map from keys to numbers as a sorted array of hashes and an array of values."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Hashed:
        h = mix(keys.astype(np.uint64) + np.uint64(1))
        order = np.argsort(h)
        return cls(h[order], values[order].astype(np.float32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values) by binary search."""
        if not len(self.hashes):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        h = mix(keys.astype(np.uint64) + np.uint64(1))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[at] == h, self.values[at].astype(np.float64)


def _discount(n: np.ndarray) -> float:
    ones, twos = (n == 1).sum(), (n == 2).sum()
    return float(ones / (ones + 2 * twos)) if ones and twos else 0.5


class KneserNey:
    """Interpolated Kneser-Ney of order three for one language."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        """``keys`` and their counts; the lower orders count in how many ways a gram goes on."""
        pairs, before = np.unique(keys & (CLASSES * CLASSES - 1), return_counts=True)
        last, ways = np.unique(pairs & (CLASSES - 1), return_counts=True)
        one, d1 = np.full(CLASSES, 1 / CLASSES), _discount(ways)
        one *= d1 * len(last) / max(1, ways.sum())
        one[last] += (ways - d1) / max(1, ways.sum())
        self.one = np.log(one)
        two, rest2, self.context2 = self._order(pairs, before, np.log(one[pairs & (CLASSES - 1)]))
        self.two = Hashed.of(pairs, two)
        self.rest2 = Hashed.of(self.context2, rest2)
        lower = two[np.searchsorted(pairs, keys & (CLASSES * CLASSES - 1))]
        three, rest3, context3 = self._order(keys, n, lower)
        self.three, self.rest3 = Hashed.of(keys, three), Hashed.of(context3, rest3)

    @staticmethod
    def _order(keys: np.ndarray, n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities of the keys, log back-off weights and the contexts of these."""
        context, where, kinds = np.unique(keys >> BITS, return_inverse=True, return_counts=True)
        total = np.bincount(where, n, len(context))
        d = _discount(n)
        rest = d * kinds / total
        return np.log((n - d) / total[where] + rest[where] * np.exp(lower)), np.log(rest), context

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each gram after the others."""
        found, out = self.three.find(keys)
        miss = np.flatnonzero(~found)
        key = keys[miss]
        known, rest = self.rest3.find(key >> BITS)
        has, lower = self.two.find(key & (CLASSES * CLASSES - 1))
        seen, rest2 = self.rest2.find((key >> BITS) & (CLASSES - 1))
        lower = np.where(has, lower, np.where(seen, rest2, 0.0) + self.one[key & (CLASSES - 1)])
        out[miss] = np.where(known, rest, 0.0) + lower
        return out


@dataclass
class Identifier:
    names: list[str]
    classes: np.ndarray
    models: list[KneserNey]
    sharpness: float = 16.0
    limits: np.ndarray | None = None  # the highest cross-entropy accepted, by language

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy by character of each text under each language, and whether it has a letter."""
        key, cut = grams(texts, self.classes)
        kinds, where = np.unique(key, return_inverse=True)
        size = np.diff(cut)
        out = np.zeros((len(texts), len(self.names)))
        for i, model in enumerate(self.models):
            sums = np.concatenate(([0.0], np.cumsum(model.log_p(kinds)[where])))
            out[:, i] = -(sums[cut[1:]] - sums[cut[:-1]]) / np.maximum(1, size)
        if not np.isfinite(out).all():
            raise ValueError("a language model gives a character no probability")
        return out, size > 0

    def shares(self, entropy: np.ndarray, sharpness: float) -> np.ndarray:
        z = -sharpness * (entropy - entropy.min(axis=1, keepdims=True))
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame) -> Identifier | None:
    """Models for the non-null langs of ``docs`` (doc_id, lang, text) whose texts have a letter; None
    without any.

    Counts cover all documents but a tenth of them, chosen by hash of the id, which
    sets the sharpness of the scores and the limits of rejection. A language that has
    letters in that tenth only is counted there, and is not calibrated: it rejects nothing.
    """
    docs = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    names = sorted(r.lang for r in docs.select("lang").distinct().collect())
    if not names:
        return None
    tenth = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(10))
    classes = alphabet(docs, names)
    rows = count(docs.where(tenth >= HELD_TENTHS), names, classes)
    small = sorted(set(range(len(names))) - set((rows[:, 0] >> (3 * BITS)).tolist()))
    if small:
        rare = docs.where(F.col("lang").isin([names[i] for i in small]))
        rows = np.concatenate((rows, count(rare, names, classes)))
    models: dict[str, KneserNey] = {}
    for i, name in enumerate(names):
        own = rows[rows[:, 0] >> (3 * BITS) == i]
        if len(own):
            own = own[np.argsort(own[:, 0])]
            models[name] = KneserNey(own[:, 0] & ((1 << 3 * BITS) - 1), own[:, 1])
    if not models:
        return None
    model = Identifier(list(models), classes, list(models.values()))
    calibrating = [name for name in models if names.index(name) not in small]
    return _calibrated(model, docs.where((tenth < HELD_TENTHS) & F.col("lang").isin(calibrating)))


def _calibrated(model: Identifier, docs: DataFrame) -> Identifier:
    number = {n: i for i, n in enumerate(model.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for row, end, texts in _blocks(batch, 1):
                entropy, has = model.entropies(texts)
                own = langs[row:end]
                at = np.arange(len(own))
                losses = [-np.log(np.maximum(1e-12, model.shares(entropy, s)[at, own])) for s in SHARPNESS]
                cells = pa.ListArray.from_arrays(
                    np.arange(has.sum() + 1, dtype=np.int32) * len(SHARPNESS), pa.array(np.stack(losses, axis=1)[has].ravel())
                )
                yield pa.RecordBatch.from_arrays([pa.array(own[has].astype(np.int32)), pa.array(entropy[at, own][has]), cells], ["lang", "entropy", "losses"])

    scored = docs.select("lang", "text").mapInArrow(run, "lang int, entropy double, losses array<double>")
    rows = (
        scored.groupBy("lang")
        .agg(F.percentile_approx("entropy", ACCEPT, 10_000).alias("limit"), *(F.sum(F.col("losses")[i]).alias(f"s{i}") for i in range(len(SHARPNESS))))
        .collect()
    )
    model.limits = np.full(len(model.names), np.inf)
    if rows:
        for r in rows:
            model.limits[r.lang] = r.limit
        total = [sum(r[f"s{i}"] for r in rows) for i in range(len(SHARPNESS))]
        model.sharpness = SHARPNESS[int(np.argmin(total))]
    return model


def identify(docs: DataFrame, model: Identifier | None) -> DataFrame:
    """doc_id, lang_pred, score, entropy and rejected for each row of ``docs``, from its text alone.

    lang_pred has the lowest cross-entropy by character, the first by name where
    two are equal; score is its calibrated share. rejected says that the text is less
    likely than nearly all texts of that language. Texts that are null or have no
    letter are 'und' with score 0, entropy null and rejected; so are all texts where
    nothing was learned. Rows with null or repeated ids are treated like others; other
    columns are not read; an empty table gives no rows.
    """
    names = np.array([*model.names, UNDETERMINED] if model else [UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in _blocks(batch, 1):
                n = end - row
                best, share, low = np.full(n, len(names) - 1), np.zeros(n), np.full(n, np.nan)
                rejected = np.ones(n, bool)
                if model:
                    entropy, has = model.entropies(texts)
                    best[has] = entropy.argmin(axis=1)[has]
                    share[has] = model.shares(entropy, model.sharpness).max(axis=1)[has]
                    low[has] = entropy.min(axis=1)[has]
                    rejected[has] = low[has] > model.limits[best[has]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(names[best], pa.string()), pa.array(share), pa.array(low, from_pandas=True), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "entropy", "rejected"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean"
    )
