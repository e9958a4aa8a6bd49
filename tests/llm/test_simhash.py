from __future__ import annotations

import random
import re

import xxhash

from meritpool.llm import simhash
from meritpool.llm.components import components
from tests.llm.helpers import docs_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if group[j] < group[i] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i], changed = group[j], True
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (least.get(g), doc) if x is not None), default=None)
    return sorted(((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True)), key=str)


def test_against_all_pairs(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeé", k=4)) for _ in range(300)]
    rows = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([2, 30, 400]))
        for copy in range(8):
            changed = list(words)
            for _ in range(copy // 2):
                changed[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((base * 8 + copy, rng.choice([" ", "\n"]).join(changed)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "ONE two"), (904, "one TWO"), (905, "É x y z"),
             (906, "wide space a b"), (903, "ONE two"), (None, "one two"), (None, None), (950, "long " * 70000)]
    got = simhash.near_duplicates(docs_frame(spark, rows, extra=True)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows)


def test_grid_finds_every_pair_within_three_bits(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(150):
        base = rng.getrandbits(64)
        prints.add(base)
        for flips in (1, 2, 3, 4):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), flips)))
    prints |= {0, 1, 2**64 - 1, 2**63}
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    for most in (0, 1, 2, 3):
        got = {tuple(sorted((r.v, r.u))) for r in simhash.links(nodes, most).collect()}
        want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= most}
        assert got == want


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_frame(spark, [])).collect() == []


def test_components_of_chains_rings_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(i, 500) for i in range(200, 260)]
    ring = [(i, 300 + (i + 1) % 20) for i in range(300, 320)]
    rows = chain + star + ring + [(7, 7), (1, -5), (1, -5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "v long, u long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 200 for i in [*range(200, 260), 500]}
    want |= {i: 300 for i in range(300, 320)} | {1: -5, -5: -5}
    assert got == want
