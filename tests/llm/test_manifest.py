from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from meritpool.llm import manifest
from meritpool.llm.frames import ship
from tests.llm.helpers import ODD, docs_frame


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc, source, lang, chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, chars, text)))


def plain_tree(nodes):
    """The root, and for each leaf the (left, right) siblings by level."""
    ways, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(i, min(i + 3, len(nodes)))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for n in run:
                beside = ("".join(nodes[m] for m in run if m < n), "".join(nodes[m] for m in run if m > n))
                for i in owners[n]:
                    ways[i].append(beside)
        nodes, owners = [sha("".join(nodes[n] for n in run)) for run in runs], [[i for n in run for i in owners[n]] for run in runs]
    return (nodes[0] if nodes else None), ways


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        own = [(r[0], leaf(*r), r) for r in rows if r[1] == source]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((own, *plain_tree([x[1] for x in own])))
    root, above = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, ways), over in zip(trees, above, strict=True):
        for (doc, digest, row), way in zip(own, ways, strict=True):
            even = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0
            text = row[4].replace("\n", "") if even and row[4] is not None else row[4]
            folded = leaf(*row[:4], text)
            for left, right in way + over:
                folded = sha(left + folded + right)
            proof = sha("".join(x for step in way + over for x in step))
            out.append((doc, digest, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def made():
    rng = random.Random(2)
    sizes = {None: 2, "": 1, "a": 1, "b": 3, "é": 4, "hot": 100, "z": 27, "y": 28, "x": 9}
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            doc += 1
            rows.append((doc, source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["a\nb", "c", None, "", "é\n\n"])))
    rng.shuffle(rows)
    odd = [(d, None if d == -5 else "odd", None, None, t) for d, t in ODD]
    return rows + odd + [(1, "hot", "en", 1, "twice"), (1, "hot", "en", 1, "other"), (1, "hot", "en", 1, "twice")]


def frame(spark, rows):
    full = [(d, s, lang, n, t, "x", 1, "y") for d, s, lang, n, t in rows]
    return spark.createDataFrame(full, "doc_id long, source string, lang string, n_chars long, text string, tree string, index int, digest string")


@pytest.mark.parametrize("height", [1, 2, 7])
def test_against_a_plain_tree(spark, height):
    ship(spark)
    rows = made()
    got = manifest.manifest(manifest.tampered(frame(spark, rows)), height).verified()
    columns = ("doc_id", "digest", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = sorted((tuple(r) for r in got.select(*columns).collect()), key=str)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


def test_the_log_is_in_postorder_and_proofs_lead_to_the_root(spark):
    ship(spark)
    rows = made()
    built = manifest.manifest(frame(spark, rows), height=2)
    log = [r for tier in built.log for r in tier.collect()]
    for tree in {r.tree for r in log}:
        own = sorted((r for r in log if r.tree == tree), key=lambda r: r.at)
        assert [r.at for r in own] == list(range(len(own)))
        # what has been written when a node is complete are its children, the nodes before it
        stack = []
        for r in own:
            if r.level:
                first = next(i for i in range(len(stack) - 1, -1, -1) if i == 0 or stack[i - 1].level != r.level - 1 or len(stack) - i == 3)
                assert manifest.sha("".join(x.digest for x in stack[first:])) == r.digest
                del stack[first:]
            stack.append(r)
        assert len(stack) == 1
    root = built.roots.first().root
    proofs = built.proofs().collect()
    assert len(proofs) == len(rows)
    assert all(manifest.fold(r.digest, [s.asDict() for s in r.proof]) == root for r in proofs)


def test_places_are_those_of_a_log_written_leaf_by_leaf():
    for size in range(1, 60):
        top, at, seen = manifest.height_of(size), 0, {}
        counts = [0] * (top + 1)
        for i in range(size):
            level = 0
            while True:
                end = min((counts[level] + 1) * 3**level, size)
                counts[level] += 1
                seen[(end, level)] = at
                at += 1
                if level == top or (end % 3 ** (level + 1) and end < size):
                    break
                level += 1
        assert all(manifest.place(end, level) == n for (end, level), n in seen.items())


def test_empty_table(spark):
    ship(spark)
    built = manifest.manifest(docs_frame(spark, []))
    assert built.verified().collect() == [] and built.proofs().collect() == [] and built.roots.collect() == []
