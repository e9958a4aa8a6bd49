from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from meritpool.llm import rules
from meritpool.llm.frames import blocks, ship
from tests.llm.helpers import ODD, docs_frame, labels_frame, sentence


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again)


def some_rows():
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["a", "b", "é", "c\n", "\n", "$#", "日本"], k=rng.randint(0, 90)))) for i in range(150)]
    rows += [(200 + i, sentence(rng)) for i in range(150)]
    rows += [(400 + i, " ".join(f"{w}$$$" for w in sentence(rng).split())) for i in range(150)]
    return [*rows, *ODD, (999, "a\rb\x0bc d e")]


def test_counts_against_plain_version(spark):
    ship(spark)
    rows = some_rows()
    out = rules.quality_rules(docs_frame(spark, rows, extra=True), None).collect()
    got = sorted((tuple(r)[:8] for r in out), key=str)
    want = []
    for doc, text in rows:
        n, *rest, again = plain(text)
        failed = n < 50 or 100 * again > 50 * n
        want.append((doc, n, *rest, again, failed, not failed))
    assert got == sorted(want, key=str)


def test_classifier_separates_and_is_calibrated(spark):
    ship(spark)
    docs = docs_frame(spark, some_rows())
    labels = labels_frame(spark, [(200 + i, 1, 0) for i in range(150)] + [(400 + i, 0, 0) for i in range(150)])
    model = rules.fit(docs, rules.training_labels(labels, "quality"))
    out = {r.doc_id: r for r in rules.quality_rules(docs, model).collect()}
    right = [(out[i].probability > 0.5) == (i < 400) for i in [*range(200, 350), *range(400, 550)]]
    assert np.mean(right) > 0.97
    assert all(r.kept == (not r.base_failed and r.probability >= rules.KEEP_FROM) for r in out.values())


def test_scores_are_the_weights_of_plain_features():
    texts = pa.array([t for _, t in some_rows()])
    rng = np.random.default_rng(1)
    model = rules.linear.Linear(rng.normal(size=(1 << rules.BITS) + 1).astype(np.float32), 30.0)
    for _, _, data, offsets in blocks(texts):
        fast = rules._scores(data, offsets, model)
        plain_sums = [model.scale * float((model.weights[i] * v).sum()) + model.weights[-1] for i, v in rules._features(data, offsets)]
        assert np.allclose(fast, plain_sums, atol=1e-2)


def test_empty_tables(spark):
    empty = docs_frame(spark, [])
    assert rules.fit(empty, rules.training_labels(labels_frame(spark, []), "quality")) is None
    assert rules.quality_rules(empty, None).collect() == []
