from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np

from meritpool.llm import language
from meritpool.llm.frames import ship
from tests.llm.helpers import ODD, SYLLABLES, docs_frame, sentence


def plain_model(grams):
    """Interpolated Kneser-Ney over (a, b, c) counts, by its definition."""
    def discount(counts):
        n1, n2 = sum(x == 1 for x in counts), sum(x == 2 for x in counts)
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    pairs, ones = Counter((b, c) for _, b, c in grams), None
    ones = Counter(c for _, c in pairs)
    d3, d2, d1 = (discount(list(x.values())) for x in (grams, pairs, ones))
    total3, kinds3, total2, kinds2 = Counter(), Counter(), Counter(), Counter()
    for (a, b, _), n in grams.items():
        total3[a, b] += n
        kinds3[a, b] += 1
    for (b, _), n in pairs.items():
        total2[b] += n
        kinds2[b] += 1
    everything = sum(ones.values())

    def p(a, b, c):
        low = (max(ones[c] - d1, 0) + d1 * len(ones) / language.CLASSES) / everything
        mid = (max(pairs[b, c] - d2, 0) + d2 * kinds2[b] * low) / total2[b] if total2[b] else low
        return (max(grams[a, b, c] - d3, 0) + d3 * kinds3[a, b] * mid) / total3[a, b] if total3[a, b] else mid

    return p


def joined(a, b, c):
    return (a << 2 * language.BITS) | (b << language.BITS) | c


def parted(key):
    last = language.CLASSES - 1
    return key >> 2 * language.BITS, key >> language.BITS & last, key & last


def test_model_against_its_definition():
    rng = np.random.default_rng(3)
    letters = rng.integers(0, 12, size=3000)
    grams = Counter(zip(letters, letters[1:], letters[2:], strict=False))
    keys = np.array(sorted(joined(*map(int, gram)) for gram in grams))
    n = np.array([grams[parted(k)] for k in keys])
    model, p = language.KneserNey(keys, n), plain_model(grams)
    asked = rng.integers(0, 14, size=(500, 3))
    got = model.log_p(joined(*asked.T))
    assert np.allclose(got, [math.log(p(*row)) for row in asked], atol=1e-4)
    for context in ((1, 2), (13, 3), (13, 13)):
        assert abs(sum(p(*context, c) for c in range(language.CLASSES)) - 1) < 1e-9


def test_grams_do_not_cross_words_or_texts():
    classes = language.letters().astype(np.uint16)
    for c, i in (("a", 2), ("b", 3)):
        classes[ord(c)] = i
    keys, cut = language.grams(["Ab 1 b", "", "..", "a"], classes)
    first = [(0, 0, 2), (0, 2, 3), (2, 3, 0), (0, 0, 3), (0, 3, 0)]
    assert [parted(int(k)) for k in keys[: cut[1]]] == first
    assert cut.tolist() == [0, 5, 5, 5, 7]


def test_identifies_and_rejects(spark):
    ship(spark)
    rng = random.Random(6)
    rows = [(i, sentence(rng, lang, rng.randint(3, 40)), lang) for i, lang in enumerate([*SYLLABLES] * 100)]
    learn = spark.createDataFrame([*rows, (9001, "no lang", None), (9002, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(learn.where("doc_id % 4 != 2"))
    out = defaultdict(list)
    docs = docs_frame(spark, [(i, t) for i, t, _ in rows] + ODD + [(8000, "Ω ж 漢字 Ж"), (8001, "123 ..."), (8002, "zzzz qqq xxxx vvvv")], extra=True)
    for r in language.identify(docs, model).collect():
        out[r.doc_id].append(r)
    held = [i for i, _, _ in rows if i % 4 == 2]
    assert np.mean([out[i][0].lang_pred == rows[i][2] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 for rs in out.values() for r in rs)
    for i in (-1, -2, -3, 8001):
        assert (out[i][0].lang_pred, out[i][0].score, out[i][0].rejected) == ("und", 0.0, True)
    assert out[8002][0].rejected and out[8002][0].lang_pred in SYLLABLES and len(out[-5]) == 2
    assert np.mean([out[i][0].rejected for i in held]) < 0.1


LEARN = "doc_id long, text string, lang string"


def test_a_language_without_letters_is_never_predicted(spark):
    ship(spark)
    rng = random.Random(2)
    rows = [(i, sentence(rng, "en", 20), "en") for i in range(200)]
    model = language.fit(spark.createDataFrame([*rows, (900, "123 456", "xx"), (901, None, "yy")], LEARN))
    assert model.names == ["en"]
    out = language.identify(docs_frame(spark, [(i, t) for i, t, _ in rows]), model).collect()
    assert {r.lang_pred for r in out} == {"en"} and all(0 <= r.score <= 1 for r in out)


def test_small_languages_are_counted_and_keep_their_letters(spark):
    """One document each, wherever it falls, in scripts the large language does not use."""
    ship(spark)
    rng = random.Random(2)
    rows = [(i, sentence(rng, "en", 20), "en") for i in range(100)]
    scripts = {"el": "αβγδε ζηθικ λμνξο", "ru": "абвгд еёжзи йклмн", "he": "אבגדה וזחטי כלמנס"}
    for start in range(4):
        small = [(1000 + 10 * start + i, text, lang) for i, (lang, text) in enumerate(scripts.items())]
        model = language.fit(spark.createDataFrame(rows + small, LEARN))
        out = language.identify(docs_frame(spark, [(i, t) for i, t, _ in small]), model).collect()
        assert {r.doc_id: r.lang_pred for r in out} == {i: lang for i, _, lang in small}


def test_nothing_learned(spark):
    ship(spark)
    docs = docs_frame(spark, ODD)
    assert language.fit(docs) is None
    assert {(r.lang_pred, r.score) for r in language.identify(docs, None).collect()} == {("und", 0.0)}
    assert language.identify(docs_frame(spark, []), None).collect() == []
