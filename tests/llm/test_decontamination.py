from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from meritpool.llm import decontamination as dc
from meritpool.llm.frames import ship
from tests.llm.helpers import ODD, docs_frame, sentence


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = (rng.choices(range(6), k=rng.randint(1, 30)) for _ in range(2))
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert dc.common_subsequence(masks, len(a), b) == plain_lcs(a, b)


def made(rng):
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(4000)]
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(14, 60))).capitalize() + ". " + " ".join(text(5)) + ".") for i in range(20)]
    items[7] = (7, " ".join(text(300)))
    rows, planted = [], set()
    for doc in range(160):
        body = text(rng.randint(0, 120))
        if doc % 4 == 0:
            i = doc // 4 % 20
            leak = items[i][1].split()
            if doc % 8 == 0:  # a paraphrase: some words changed or dropped, the answer kept
                leak = [w if k >= len(leak) - 5 or rng.random() > 0.15 else rng.choice(words) for k, w in enumerate(leak)]
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() if rng.random() < 0.2 else w + rng.choice(["", ",", "!"]) for w in leak]
            planted.add((doc, i))
        rows.append((doc, " ".join(body)))
    return items, rows, planted


def brute(items, rows):
    """All windows of the documents against all parts of the items, with the same check."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    found = set()
    texts = [(doc, split(body)) for doc, body in rows]
    for item, text in items:
        words, answer = split(text), split(dc.last_sentence(text))
        parts = np.array_split(np.array(words, object), max(1, -(-len(words) // dc.PART)))
        for part in map(list, parts):
            width = (1 << (-(-(len(part) + dc.STEP) // dc.STEP) - 1).bit_length()) * dc.STEP + 2 * dc.STEP
            own = set(part)
            for doc, doc_words in texts:
                if sum(w in own for w in doc_words) < dc.PARAPHRASE * len(part):
                    continue
                for at in range(0, max(1, len(doc_words) - width + 9), 8):
                    window = doc_words[at : at + width]
                    if sum(w in own for w in window) < dc.PARAPHRASE * len(part):
                        continue
                    share = plain_lcs(part, window) / len(part)
                    joined, wanted = f" {' '.join(window)} ", f" {' '.join(answer)} "
                    if share >= dc.COMMON or share >= dc.PARAPHRASE and answer and wanted in joined:
                        found.add((doc, item))
                        break
    return found


def test_recall_against_brute_force(spark):
    ship(spark)
    items, rows, planted = made(random.Random(12))
    bench = spark.createDataFrame([*items, (100, None), (101, ""), (None, items[3][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs_frame(spark, rows + ODD, extra=True), bench).collect()}
    want = brute(items, rows)
    named = {g for g in got if g[1] is not None}
    assert len(want & named) >= 0.95 * len(want) and len(want) > 30
    assert planted <= named
    assert all(doc % 4 == 0 for doc, _ in named)
    clean = dc.keep_clean(docs_frame(spark, rows, extra=True), bench)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {d for d, _ in rows} - {d for d, _ in got}


def test_clean_rows_stay_beside_their_namesakes(spark):
    ship(spark)
    rng = random.Random(4)
    item = sentence(rng, n=40)
    clean = [sentence(rng, "de", 60) for _ in range(40)]
    rows = [*enumerate(clean), (None, clean[0]), (None, item), (7, item), (8, "x " + item)]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string")
    left = dc.keep_clean(docs_frame(spark, rows, extra=True), bench)
    assert sorted(((r.doc_id, r.text) for r in left.select("doc_id", "text").collect()), key=str) == sorted([*enumerate(clean), (None, clean[0])], key=str)


def test_blocks_are_bounded_by_words_however_they_are_parted(spark, monkeypatch):
    monkeypatch.setattr(dc, "QUERY_WORDS", 100)
    rng = random.Random(5)
    items = [(i, sep.join(sentence(rng, n=30).split())) for i, sep in enumerate([" ", "\n", "\t", ", ", "-"] * 8)]
    bench = spark.createDataFrame([*items, *items, (99, ""), (98, "...")], "item_id long, text string").selectExpr("*", "cast(null as string) answer")
    blocks = {}
    for r in dc._dealt(bench).collect():
        blocks.setdefault(r.block, []).append(r.item_id)
    assert sorted(i for b in blocks.values() for i in b) == list(range(40))
    assert all(30 * len(b) < 100 + 30 for b in blocks.values()) and len(blocks) >= 40 * 30 // 130


def test_rarity_counts_all_passages(spark):
    ship(spark)
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["x", "y", "z", "w"], k=rng.randint(0, 200))) for _ in range(30)]
    hashes = np.sort(next(dc._hashed(pa.array(["x y z w"])))[2])
    vocabulary = dc.Vocabulary(hashes)
    got = dc.rarity(docs_frame(spark, list(enumerate(texts))), vocabulary)
    passages = [t.split()[i : i + 64] for t in texts for i in range(0, len(t.split()), 64)]
    for word in "xyzw":
        number = vocabulary.find(next(dc._hashed(pa.array([word])))[2])[1][0]
        n = sum(word in p for p in passages)
        assert abs(got[number] - np.log((len(passages) + 2) / (n + 1))) < 1e-9


def test_the_space_is_fitted_on_all_passages(spark, monkeypatch):
    """Its counts are those of all passages of all documents, however the table of counts is cut."""
    ship(spark)
    rng = random.Random(3)
    known = [f"w{i}" for i in range(9)]
    texts = [" ".join(rng.choices([*known, "other", "more"], k=rng.randint(0, 700))) for _ in range(30)] + [None, ""]
    vocabulary = dc.Vocabulary(np.sort(next(dc._hashed(pa.array([" ".join(known)])))[2]))
    want, n = np.zeros((9, 9), np.int64), 0
    for text in texts:
        split = (text or "").split()
        for i in range(0, len(split), 64):
            number = vocabulary.find(next(dc._hashed(pa.array([" ".join(split[i : i + 64])])))[2])[1]
            vector = np.bincount(number, minlength=9)
            want += np.outer(vector, vector)
            n += vector.any()
    docs = docs_frame(spark, list(enumerate(texts)))
    rare = np.arange(9.0, 0.0, -1.0)
    for cells, hits, frequent in ((dc.TABLE, dc.HITS, 4), (dc.TABLE, dc.HITS, dc.FREQUENT), (12, 50, 0), (12, 50, 3)):
        monkeypatch.setattr(dc, "TABLE", cells)
        monkeypatch.setattr(dc, "HITS", hits)
        monkeypatch.setattr(dc, "FREQUENT", frequent)
        got = {r.word: dc.unpacked(r.counts) for r in dc.shared_counts(docs, vocabulary, rare).collect()}
        assert got.pop(-1).tolist() == [n]
        assert all((got[w] == want[w, w:]).all() for w in range(9))
    # the coordinates are the leading singular vectors of all passages
    matrix = dc.landed(dc.shared_counts(docs, vocabulary, rare)).where("word >= 0").selectExpr("word", "counts", "1.0d weight")
    right = np.random.default_rng(1).normal(size=(9, 4))
    assert np.allclose(dc._times(matrix, right, rare), (want * np.outer(rare, rare)) @ right, rtol=1e-4)


def test_sums_by_step():
    rng = np.random.default_rng(2)
    space = rng.normal(size=(50, 7)).astype(np.float32)
    step = np.sort(rng.integers(0, 9000, size=5000))
    number = rng.integers(0, 50, size=5000)
    want = np.zeros((9500, 7))
    np.add.at(want, step, space[number])
    assert np.allclose(dc._sums(space, step, number, 9500), want, atol=1e-4)


def test_empty_tables(spark):
    ship(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a few words here")], "item_id long, text string")
    assert dc.leaks(docs_frame(spark, [(1, "a b c")]), none).collect() == []
    assert dc.leaks(docs_frame(spark, []), one).collect() == []


def test_pairs_are_made_of_the_different_words_of_a_passage():
    """A word that fills a passage is one word with a count, not a pair of each two of its places."""
    index, owner = np.array([2] * 64 + [0, 2, 1, 1]), np.repeat([0, 1], [64, 4])
    sizes = {len(w): (w.T.tolist(), n.T.tolist(), other.tolist()) for w, n, other in dc._by_size(index, owner, np.arange(3), 1)}
    assert sizes == {1: ([[2]], [[64]], [0]), 3: ([[0, 1, 2]], [[1, 2, 1]], [2])}
    total, place = np.zeros(6, np.int32), np.array([0, 2, 3])
    for some in dc._by_size(index, owner, np.arange(3), 0):
        dc._add_pairs(total, place, some, 0, 3)
    assert total.tolist() == [1, 2, 1, 4, 2, 64 * 64 + 1]


def test_find_tells_hashes_apart_that_end_alike():
    rng = np.random.default_rng(5)
    known = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64) << np.uint64(12))  # 16 endings
    asked = np.concatenate([known, known + np.uint64(1 << 20), known + np.uint64(1), np.zeros(1, np.uint64), known[::-1]])
    place, number = dc.Vocabulary(known).find(asked)
    want = [(i, int(np.flatnonzero(known == h)[0])) for i, h in enumerate(asked) if (known == h).any()]
    assert list(zip(place.tolist(), number.tolist(), strict=True)) == want
    assert not len(dc.Vocabulary(known[:0]).find(asked)[0])
