"""Toxicity by gradient-boosted trees over dense features, isotonically calibrated."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritpool.llm import linear
from meritpool.llm.frames import landed

#: Labelled documents that lexicon, trees and calibration are fitted on at most.
SAMPLE = 16_000
#: Learned lexicon entries at most: those that tell toxic rows best.
LEXICON = 2_000
#: A learned entry stands in this many toxic documents at least ...
LEAST_DOCS = 4
#: ... and its log odds between toxic and other documents are this much.
LEAST_ODDS = 1.2
#: Words between an insult and a second-person pronoun that count as near.
NEAR = 5
STEMS = (4, 5, 6, 7)

# Insults and second-person pronouns of some languages.
SEEDS = frozenset(
    "idiot idiots stupid moron morons dumb loser losers scum trash worthless pathetic disgusting clown hate "
    "imbecile fool garbage filth vermin ugly crétin débile abruti connard dummkopf trottel idiota estúpido imbécil basura".split()
)
YOU = frozenset("you your yours you're yourself u tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie tú ti usted ustedes vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"})

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[\W\d_]")
_RUN = re.compile(r"(.)\1{2,}")

FEATURES = (
    "strength", "log_words", "seed_density", "learned_density", "learned_weight", "stem_density", "stem_weight", "most",
    "hits", "you_density", "near_you", "capitals", "shouted_hits", "marks", "bangs", "obfuscated", "obfuscated_hits",
)


def plain(word: str) -> str:
    """Lower case without marks at the edges."""
    return _EDGES.sub("", word.lower())


def unmasked(word: str) -> str:
    """Digits and signs read as the letters they stand for, other signs and long runs dropped."""
    bare = "".join(c for c in unicodedata.normalize("NFKC", word.lower()).translate(LEET) if c.isalpha())
    return _RUN.sub(r"\1", bare)


def _terms(text: str) -> set[str]:
    """Words of a text, and their beginnings as 'stem*'."""
    found = {w for w in map(plain, set((text or "").split())) if w}
    return found | {w[:n] + "*" for w in found for n in STEMS if len(w) > n}


def lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms with their log odds, learned from (label, text) by counting documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = sorted(_terms(text))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([label] * len(terms), pa.float64())], ["term", "label"])

    total = sample.agg(F.sum("label"), F.count("*")).first()
    toxic, rest = total[0] or 0, total[1] - (total[0] or 0)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (rest + 1))
    rows = (
        sample.select("label", "text")
        .mapInArrow(run, "term string, label double")
        .groupBy("term")
        .agg(F.sum("label").alias("t"), F.count("*").alias("n"))
        .where(F.col("t") >= LEAST_DOCS)
        .select("term", odds.alias("odds"), "t")
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc(F.col("odds") * F.log1p("t")), "term")
        .limit(LEXICON)
        .collect()
    )
    return {r.term: r.odds for r in rows}


class _Marks:
    """What each different word of a batch says, as arrays over its vocabulary."""

    def __init__(self, vocabulary: list[str], learned: dict[str, float]):
        n = len(vocabulary)
        self.learned, self.stem = np.zeros(n), np.zeros(n)
        self.seed, self.you, self.shouted = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        self.masked, self.masked_hit = np.zeros(n, bool), np.zeros(n, bool)
        for i, raw in enumerate(vocabulary):
            word = plain(raw)
            if not word:
                continue
            self.seed[i] = word in SEEDS
            self.you[i] = word in YOU
            self.shouted[i] = len(word) > 1 and raw.isupper()
            self.learned[i] = learned.get(word, 0.0)
            self.stem[i] = max((learned.get(word[:k] + "*", 0.0) for k in STEMS if len(word) > k), default=0.0)
            if _INSIDE.search(word) or _RUN.search(word):
                bare = unmasked(word)
                self.masked[i] = any(c.isalpha() for c in word)
                self.masked_hit[i] = bare != word and (bare in SEEDS or bare in learned)
        self.marks = np.array([sum(not (c.isalnum() or c.isspace()) for c in w) for w in vocabulary], float)
        self.bangs = np.array([w.count("!") for w in vocabulary], float)
        self.upper = np.array([sum(c.isupper() for c in w) for w in vocabulary], float)
        self.chars = np.array([len(w) for w in vocabulary], float)


def features(texts: pa.Array, learned: dict[str, float]) -> np.ndarray:
    """A row of FEATURES for each text."""
    split = pc.utf8_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    bounds = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    code, say = coded.indices.to_numpy(), _Marks(coded.dictionary.to_pylist(), learned)
    bounds = bounds - bounds[0]

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(values[code])))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    words = total((say.chars > 0).astype(float))
    n, chars = np.maximum(1, words), np.maximum(1, total(say.chars))
    hit = say.seed | (say.learned > 0) | say.masked_hit
    strength = np.maximum(np.maximum(say.learned, say.stem), np.where(say.seed | say.masked_hit, 6.0, 0.0))
    at, you = np.flatnonzero((hit | (say.stem > 0))[code]), np.flatnonzero(say.you[code])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    near, most = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    if len(at):
        np.maximum.at(most, owner[at], strength[code[at]])
        if len(you):
            after = np.searchsorted(you, at)
            for side in (np.maximum(after - 1, 0), np.minimum(after, len(you) - 1)):
                close = (np.abs(you[side] - at) <= NEAR) & (owner[you[side]] == owner[at])
                near += np.bincount(owner[at[close]], minlength=len(near))
    columns = [
        total(strength) / n, np.log1p(words), total(say.seed) / n, total(say.learned > 0) / n, total(say.learned) / n,
        total(say.stem > 0) / n, total(say.stem) / n, most, np.log1p(total(hit)), total(say.you) / n, near / n,
        total(say.upper) / chars, total(say.shouted & hit) / n, total(say.marks) / chars, total(say.bangs) / n,
        total(say.masked) / n, total(say.masked_hit) / n,
    ]
    return np.stack(columns, axis=1)


def _measured(docs: DataFrame, learned: dict[str, float], keep: str, kinds: str) -> DataFrame:
    """The leading column of ``docs``, which ends with text, and its features as a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 1000):
                part = batch.slice(row, 1000)
                found = features(part.column(part.num_columns - 1), learned)
                cells = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], cells], [*keep.split(), "cells"])

    measured = docs.mapInArrow(run, f"{kinds}, cells array<double>")
    return measured.withColumn("features", array_to_vector("cells"))


class Toxicity:
    """Fitted lexicon, trees and calibration."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
        """Learns from at most ``sample`` rows of ``labels`` (doc_id, label).

        Four tenths of them give the lexicon and four others the trees, so that entries are no
        truer for the trees than for new texts; the last two, which neither has seen, give the
        calibration.
        """
        rows = landed(linear.labelled(docs, labels, sample).coalesce(4)).coalesce(4)
        self.learned = lexicon(rows.where("part < 4"))
        ready = landed(
            _measured(rows.select("part", "label", "text"), self.learned, "part label", "part int, label double").drop("features")
        ).coalesce(4).withColumn("features", array_to_vector("cells"))
        both = "count(distinct label)"
        self.trees = self.curve = None
        if ready.where("part >= 4 and part < 8").agg(F.expr(both)).first()[0] == 2:
            self.trees = GBTClassifier(maxIter=24, maxDepth=3, stepSize=0.3, seed=5, maxBins=64).fit(ready.where("part >= 4 and part < 8"))
        held = ready.where("part >= 8")
        if self.trees and held.agg(F.expr(both)).first()[0] == 2:
            scored = self._margin(held).select("label", "p")
            self.curve = IsotonicRegression(labelCol="label", featuresCol="p").fit(scored)

    def _margin(self, ready: DataFrame) -> DataFrame:
        return self.trees.transform(ready).withColumn("p", vector_to_array("probability")[1])

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score and predicted (score >= 0.5) for each row of ``docs``, from its text alone.

        Null and empty texts are scored as texts of no word. Where the labelled rows
        had one class or none, the score is 0. Rows with null or repeated ids are scored
        like others; other columns are not read; an empty table gives no rows.
        """
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if not self.trees:
            return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
        scored = self._margin(_measured(docs, self.learned, "doc_id", "doc_id long"))
        if self.curve:
            scored = self.curve.transform(scored.drop("prediction")).withColumn("score", F.col("prediction"))
        else:
            scored = scored.withColumn("score", F.col("p"))
        # a touch of the uncalibrated score keeps the order within the steps of the curve
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") * 0.98 + F.col("p") * 0.02))
        return scored.select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
