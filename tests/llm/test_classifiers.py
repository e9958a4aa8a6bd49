from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from meritpool.llm import linear, quality, toxicity
from meritpool.llm.frames import ship
from meritpool.llm.queries import QUERIES
from meritpool.llm.rules import training_labels
from tests.llm.helpers import ODD, docs_frame, labels_frame, sentence

SMALL = "/root/testdata/sf0.01"


def accuracy(spark, name, label):
    out = QUERIES[name](spark, SMALL).where("held_out")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = out.join(labels, "doc_id").select("predicted", "score", label).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return np.mean([r.predicted == r[label] for r in rows]), len(rows)


def test_quality_on_held_out_rows(spark):
    share, n = accuracy(spark, "op7_quality", "quality")
    assert n > 50 and share > 0.93


def test_toxicity_on_held_out_rows(spark):
    share, n = accuracy(spark, "op2_toxicity", "toxic")
    assert n > 50 and share > 0.9


def test_a_sample_is_bounded_in_rows(spark):
    rows = [(i % 20, f"text {i}") for i in range(1000)] + [(3, None), (None, "x"), (4, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 2, "doc_id long, label int")
    got = linear.labelled(docs_frame(spark, rows, extra=True), labels, 10).collect()
    assert len(got) == 10
    again = linear.labelled(docs_frame(spark, rows[::-1]), labels, 10).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_non_negative_risk_slope():
    rng = np.random.default_rng(0)
    z, y = rng.normal(size=40), (np.arange(40) < 15).astype(float)
    slope = quality.non_negative(0.6)

    def risk(z):
        loss, yes = np.logaddexp(0, z), y > 0.5
        negative = loss[~yes].mean() - 0.6 * loss[yes].mean()
        return (0.6 * np.logaddexp(0, -z[yes]).mean() + negative) if negative >= 0 else -negative

    numeric = [(risk(z + e) - risk(z - e)) / 2e-6 for e in np.eye(40) * 1e-6]
    assert np.allclose(slope(z, y), numeric, atol=1e-6)
    z[:15] += 30  # positives so likely that the estimated risk on negatives is below zero
    numeric = [(risk(z + e) - risk(z - e)) / 2e-6 for e in np.eye(40) * 1e-6]
    assert np.allclose(slope(z, y), numeric, atol=1e-6)


def test_quality_learns_from_positives_and_unlabelled_only(spark):
    ship(spark)
    rng = random.Random(1)
    rows = [(i, sentence(rng) if i % 3 else " ".join(f"{w}###" for w in sentence(rng).split())) for i in range(600)]
    labels = [(i, 1, 0) for i in range(300) if i % 3] + [(0, 0, 0)] * 2 + [(3 * i, 0, 0) for i in range(1, 100)]
    docs = docs_frame(spark, rows + ODD, extra=True)
    model = quality.fit(docs, labels_frame(spark, labels))
    out = [(r.doc_id, r.score) for r in quality.score(docs, model).collect()]
    assert len(out) == len(rows) + len(ODD) and all(0 <= s <= 1 for _, s in out)
    good = [s for i, s in out if i is not None and 300 <= i < 600 and i % 3]
    bad = [s for i, s in out if i is not None and 300 <= i < 600 and not i % 3]
    assert min(good) > max(bad) and np.mean(np.array(bad) < 0.7) > 0.95
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(s >= quality.KEEP_FROM for _, s in out)


def test_toxicity_features():
    texts = ["you are an IDIOT you", "y0u id1ot", "st*upid stuuupid", "clean words only", "", None, "MORON!!"]
    rows = toxicity.features(pa.array(texts), {"blorp": 3.0, "glib*": 2.0})
    by = [dict(zip(toxicity.FEATURES, r, strict=True)) for r in rows]
    assert by[0]["seed_density"] == 1 / 5 and by[0]["shouted_hits"] == 1 / 5 and by[0]["near_you"] > 0
    assert by[1]["obfuscated_hits"] == 1 / 2 and by[2]["obfuscated_hits"] == 1
    assert by[3]["strength"] == 0 and by[3]["hits"] == 0
    assert by[4]["log_words"] == 0 and by[5]["log_words"] == 0
    assert by[6]["bangs"] == 2
    learned = toxicity.features(pa.array(["Blorp, glibness"]), {"blorp": 3.0, "glib*": 2.0})[0]
    assert dict(zip(toxicity.FEATURES, learned, strict=True))["strength"] == 2.5


def test_without_labels_and_rows(spark):
    ship(spark)
    empty, none = docs_frame(spark, []), labels_frame(spark, [])
    odd = docs_frame(spark, ODD, extra=True)
    assert quality.fit(empty, none) is None
    assert [r.score for r in quality.score(odd, None).collect()] == [0.5] * len(ODD)
    flat = toxicity.Toxicity(empty, training_labels(none, "toxic", 5, 0))
    assert flat.trees is None and [r.score for r in flat.score(odd).collect()] == [0.0] * len(ODD)
    assert linear.fit(spark.createDataFrame([], "part int, label double, index array<int>, value array<float>"), 4, linear.LOGISTIC) is None
