from __future__ import annotations

import random
from hashlib import md5

import pyarrow as pa
import pytest
import sentencepiece

from meritpool.llm import pieces
from meritpool.llm.frames import ship
from meritpool.llm.queries import PIECES
from tests.llm.helpers import docs_frame


def texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDéñç日本語。,.!? \n\t12345_-()=;<>/😀ẞ"
    parts = ["th", "e", "in", "er", "an", "tion", "s", "  ", " ", "ing", "re", "on"]
    out = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]
    out += ["".join(rng.choices(parts, k=rng.randint(1, 80))) for _ in range(1500)]
    return [*out, "", " ", "   ", "a  b", " a", "a ", "   " * 20, "x" * 5000, "word " * 3000, "def f(x):\n    return x"]


def unigram(words):
    """A unigram vocabulary with log-probabilities of few digits."""
    rng = random.Random(9)
    singles = sorted({c for w in words for c in w} | {pieces.SPACE})
    longer = sorted({w[i : i + n] for w in words for n in (2, 3, 4) for i in range(len(w) - n + 1)} - set(singles))
    rows = [("<unk>", 0.0, pieces.UNKNOWN)]
    rows += [(p, -rng.randint(4, 96) / 8, pieces.NORMAL) for p in singles + rng.sample(longer, len(longer) // 2)]
    return rows


def model_bytes(rows):
    """A model file with these pieces, of the unigram kind with the identity normaliser."""
    number = lambda n: bytes([n & 127 | 128, *number(n >> 7)]) if n > 127 else bytes([n])
    field = lambda i, value: bytes([i << 3 | 2]) + number(len(value)) + value
    out = b""
    for piece, score, kind in rows:
        out += field(1, field(1, piece.encode()) + b"\x15" + pieces.np.float32(score).tobytes() + b"\x18" + bytes([kind]))
    trainer = b"\x18\x01" + b"\x20" + number(len(rows))
    return out + field(2, trainer) + field(3, field(1, b"identity") + b"\x18\x01\x20\x00")


def test_bpe_ids_are_those_of_the_library():
    machine = pieces.Automaton(pieces.read_model(PIECES))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    some = texts()
    ids, same = machine.encode(pa.array(some))
    assert same.all()
    for text, got in zip(some, ids.to_pylist(), strict=True):
        assert got == library.encode(text, num_threads=1)
        assert pieces.decode(machine.vocabulary, got) == text


def test_unigram_viterbi_against_the_library_and_all_paths(tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(60)]
    rows = unigram([pieces.SPACE + w for w in words])
    path = tmp_path / "own.model"
    path.write_bytes(model_bytes(rows))
    machine = pieces.Automaton(pieces.read_model(str(path)))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    score = {p: s for p, s, k in rows if k == pieces.NORMAL}
    some = [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(200)] + ["abz", "zz a", "z", "", " a  b "]
    ids, _ = machine.encode(pa.array(some))
    for text, got in zip(some, ids.to_pylist(), strict=True):
        normal = machine.normal(text)
        best = [0.0] + [float("-inf")] * len(normal)
        for i in range(1, len(normal) + 1):
            best[i] = max(best[j] + score.get(normal[j:i], machine.unknown_score if i - j == 1 else float("-inf")) for j in range(i))
        if "z" not in text:
            assert sum(rows[i][1] for i in got) == pytest.approx(best[-1])
            want = library.encode(text)
            assert sum(rows[i][1] for i in want) == pytest.approx(best[-1])
        else:
            assert got == library.encode(text)


def test_edge_rows_and_decoding(spark):
    ship(spark)
    vocabulary = pieces.read_model(PIECES)
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "é😀"), (4, "tab\tline\n"), (5, "long " * 50_000)]
    out = pieces.encode(spark, docs_frame(spark, rows, extra=True), vocabulary)
    got = out.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    assert [r.n_ids for r in got if r.doc_id in (1, 2)] == [0, 0]
    back = sorted((tuple(r) for r in pieces.decode_rows(spark, out, vocabulary).collect()), key=str)
    assert back == sorted(((d, t or "") for d, t in rows), key=str)
    assert pieces.encode(spark, docs_frame(spark, []), vocabulary).collect() == []


def test_ids_are_decoded_to_the_text_they_came_from(spark):
    ship(spark)
    some = [*texts(), "<unk> </s>", "\u0000", "a\u200bb"]
    rows = [*enumerate(some), (None, None), (-1, None), (7, some[7])]
    vocabulary = pieces.read_model(PIECES)
    out = pieces.encode(spark, docs_frame(spark, rows, extra=True), vocabulary, decoded=True).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert len(out) == len(rows)
    for r in out:
        text = library.decode(list(r.ids)).encode()
        assert (r.decoded_bytes, r.decoded_md5) == (len(text), md5(text).hexdigest())
        if r.doc_id is not None and r.doc_id >= 0:
            assert text.decode() == some[r.doc_id]
    plain = pieces.encode(spark, docs_frame(spark, []), vocabulary, decoded=True)
    assert plain.collect() == [] and pieces.decode_rows(spark, plain, vocabulary).collect() == []
