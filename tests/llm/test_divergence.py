from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from meritpool.llm import divergence
from meritpool.llm.frames import ship
from tests.llm.helpers import SYLLABLES, docs_frame, sentence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(rows, least_docs, top=50):
    rows = [(lang or "", source or "", terms_of(text)) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted(t for t, n in docs.items() if n >= least_docs)
        counts, whole = defaultdict(Counter), Counter()
        for _, source, terms in own:
            counts[source].update(t for t in terms if t in set(kept))
        for c in counts.values():
            whole.update(c)
        sources = sorted({s for _, s, _ in own}, key=str.encode)

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for a in sources:
            pairs = [(sum(abs(share(counts[a], t) - share(counts[b], t)) for t in kept), b) for b in sources if b != a]
            for rank, (value, b) in enumerate(sorted(pairs, key=lambda x: (-x[0], x[1].encode())), 1):
                out.append((lang, a, "pair", b, value, rank))
            over = [(share(counts[a], t) - share(whole, t), t) for t in kept if counts[a][t]]
            over = sorted((x for x in over if x[0] > 0), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, a, "term", t, value, rank) for rank, (value, t) in enumerate(over[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    full = [(i, text, lang, source, None, "x", 1, "p") for i, (text, lang, source) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, term string, n int, part string")


def made(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        lang = rng.choice(["en", "de", None])
        rows.append((sentence(rng, lang or "fr", rng.randint(0, 30)), lang, rng.choice(["s1", "s2", "é", "S3", None, "s9"])))
    rows += [(rows[0][0], "en", s) for s in ("s1", "s1", "s2")] * 5  # copies over sources
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("12 -- ?", "xx", "a"), ("The THE the ÉÉ éé", "xx", "b"), ("one", "xx", "b")]
    return rows + [("wörd " * 30_000, "de", "long")]


def test_against_plain_counts(spark):
    ship(spark)
    rows = made(3)
    got = sorted(tuple(r) for r in divergence.divergence(frame(spark, rows), least_docs=4).collect())
    assert got == plain(rows, 4)
    assert {r[2] for r in got} == {"pair", "term"}


def test_many_tiles_and_shards(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "TERMS_EACH", 3)
    rows = made(4)
    got = sorted(tuple(r) for r in divergence.divergence(frame(spark, rows), least_docs=4, top=3).collect())
    assert got == plain(rows, 4, top=3)


def test_no_kept_terms_and_empty_table(spark):
    ship(spark)
    rows = [("a b", "en", "s1"), ("c", "en", "s2"), ("d", "de", "s1")]
    got = sorted(tuple(r) for r in divergence.divergence(frame(spark, rows)).collect())
    assert got == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)]
    assert divergence.divergence(docs_frame(spark, [])).collect() == []


def test_each_different_text_is_cut_once(spark):
    rows = [("same text", "en", f"s{i % 3}") for i in range(300)] + [("same text", "de", "s0"), (None, None, None)]
    got = {(r.lang, r.text): sorted((c.source, c.n) for c in r.copies) for r in divergence.collapsed(frame(spark, rows)).collect()}
    assert got == {("en", "same text"): [("s0", 100), ("s1", 100), ("s2", 100)], ("de", "same text"): [("s0", 1)], ("", ""): [("", 1)]}


def test_terms_of_texts():
    texts = ["", "Ab,cD éÉ", "", "1 2", "x", "y" + SYLLABLES["de"][3], "…a", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    text, code, terms = divergence.term_codes(data, offsets)
    assert isinstance(terms, pa.Array)
    assert [(int(i), terms[c].as_py()) for i, c in zip(text, code.tolist(), strict=True)] == [
        (i, t) for i, x in enumerate(texts) for t in terms_of(x)]
