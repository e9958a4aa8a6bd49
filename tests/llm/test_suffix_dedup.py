from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from meritpool.llm import deep_shallow, suffix_dedup
from meritpool.llm.frames import ship
from tests.llm.helpers import docs_frame


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abé ", k=n))
    base = [text(300) for _ in range(3)]
    out = []
    for i in range(60):
        b, low = rng.choice(base), rng.randint(0, 250)
        again = base[0][: rng.randint(0, 300)] if rng.random() < 0.3 else ""
        out.append((i, text(rng.randint(0, 60)) + b[low : rng.randint(low, 300)] + text(rng.randint(0, 60)) + again))
    out += [(100, "ab" * 100), (101, "x" * 90), (102, ""), (103, "a"), (104, None), (105, out[0][1])]
    return out + [(106, "For " * 60), (107, "For " * 61 + "x"), (5, out[5][1]), (None, out[7][1])]


@pytest.mark.parametrize("group", [10_000, 3])
def test_against_all_strings(spark, rows, group):
    ship(spark)
    found = suffix_dedup.cut_repeats(docs_frame(spark, rows, extra=True), 40, 12, group)
    got = sorted((tuple(r) for r in found.drop("kept", "repeated", "removed_share").collect()), key=str)
    assert got == plain(rows, 40)
    for r in found.collect():
        assert r.repeated == (r.n_removed > 0) and r.removed_share == r.n_removed / max(1, r.n_bytes)


def test_long_texts_are_looked_at_in_parts(spark, rows, monkeypatch):
    data = suffix_dedup.np.frombuffer(("".join(t or "" for _, t in rows)).encode(), suffix_dedup.np.uint8)
    whole = suffix_dedup.runs_of(data, suffix_dedup.np.array([0, len(data)]), 40, 12)
    starts = set()
    for cut in range(0, len(data), 500):
        part = data[cut : cut + 539]
        _, start, windows, *_ = suffix_dedup.runs_of(part, suffix_dedup.np.array([0, len(part)]), 40, 12)
        starts |= {cut + a + i for a, n in zip(start, windows, strict=True) for i in range(n)}
    assert starts == {a + i for a, n in zip(whole[1], whole[2], strict=True) for i in range(n)}


def test_empty_table(spark):
    assert suffix_dedup.cut_repeats(docs_frame(spark, [])).collect() == []


def test_sort_and_trie():
    rng = random.Random(1)
    for _ in range(200):
        base = bytes(rng.choices(b"ab", k=80))
        strings = [base[: rng.randint(0, 80)] + bytes(rng.choices(b"ab", k=rng.randint(0, 5))) for _ in range(rng.randint(0, 30))]
        assert [strings[i] for i in deep_shallow.sort(strings, rng.choice([8, 16, 32]))] == sorted(strings)
        if strings:
            assert [strings[i] for i in deep_shallow.blind_trie(strings, list(range(len(strings))))] == sorted(strings)
