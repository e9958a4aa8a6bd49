"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi pass.

One pass over the characters moves through the automaton of all pieces. At each
position its output links name every piece that ends there, longest first, and each
is relaxed against the best way to where it begins. The pass runs in numpy over many
words side by side.

For a unigram model the best way has the highest sum of piece scores. The scores of
a BPE model are ranks of merges; their sum says nothing, and the highest one is not
the model's segmentation. There a piece may follow another if merging by rank would
not join or move the seam between them; exactly one piece that ends at a position
may follow the best way to its beginning, and it is taken. That gives the ids
that merging gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Columns of the dense transition table: the characters on most edges. Others are looked up by search.
DENSE = 255
#: Below the lowest piece score, as the public library sets it for characters without a piece.
UNKNOWN_PENALTY = 10.0
#: Different words that go through the automaton side by side.
LANES = 1 << 14
#: Words whose ids a worker remembers.
REMEMBERED = 200_000
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, scores and kinds by id, and the settings of the model file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    prefix: bool = True  # a space goes in front of the text
    squeeze: bool = False  # runs of spaces become one, outer ones go
    unknown: int = 0
    merges: bool = False  # a BPE model: scores are ranks of merges

    def byte_ids(self) -> dict[int, int]:
        return {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        size = varint() if size is None else size
        yield tag >> 3, data[at : at + size]
        at += size


def read_model(path: str) -> Vocabulary:
    """The vocabulary of a model file, read on the driver; its size is that of the file."""
    pieces, scores, kinds, prefix, squeeze, unknown, model = [], [], [], True, True, 0, 1
    with open(path, "rb") as file:
        for number, value in _fields(file.read()):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                unknown, model = trainer.get(40, 0), trainer.get(3, 1)
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("this model maps characters before it splits; only identity models are read")
                prefix, squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
    if model not in (1, 2):
        raise ValueError("only unigram and BPE models are read")
    return Vocabulary(tuple(pieces), tuple(scores), tuple(kinds), prefix, squeeze, unknown, model == 2)


class Seams:
    """Which piece may follow which in the segmentation of a BPE model.

    Answers are kept in a table of fixed size; a pair that lost its place is worked out again.
    """

    def __init__(self, vocabulary: Vocabulary, own: list[tuple[str, int]]):
        self.scores, self.piece = vocabulary.scores, vocabulary.pieces
        self.by_text = dict(own)
        self.parts: dict[int, tuple[int, int]] = {}
        self.reachable = np.zeros(len(vocabulary.pieces), bool)
        for text, i in own:
            self.reachable[i] = len(text) == 1 or self._taken_apart(text, i)
        order = sorted(self.parts, key=lambda i: -self.scores[i])
        self.rank = dict.fromkeys((i for _, i in own), -1)
        last, score = -1, None
        for i in order:
            last, score = (last, score) if self.scores[i] == score else (last + 1, self.scores[i])
            self.rank[i] = last
        self.keys, self.values = np.full(1 << 22, -1, np.int64), np.zeros(1 << 22, bool)

    def _taken_apart(self, text: str, i: int) -> bool:
        """Merges the characters of a piece; its parts are those of the last merge."""
        parts = list(text)
        while len(parts) > 2:
            joined = [(self.scores[k], -at) for at, pair in enumerate(zip(parts, parts[1:], strict=False)) if (k := self.by_text.get("".join(pair))) is not None]
            if not joined:
                return False
            at = -max(joined)[1]
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        ids = [self.by_text.get(x) for x in parts]
        if None in ids:
            return False
        self.parts[i] = ids[0], ids[1]
        return True

    def _may_follow(self, a: int, b: int) -> bool:
        """Undoes the later of the last merges at the seam, again and again; at no
        time may a merge across it have come before the one just undone."""
        limit = len(self.parts)
        while True:
            across = self.by_text.get(self.piece[a] + self.piece[b])
            if across is not None and self.rank[across] < limit:
                return False
            left, right = self.rank[a], self.rank[b]
            if left < 0 and right < 0:
                return True
            if left > right:
                limit, a = left, self.parts[a][1]
            else:  # of equal merges the left one comes first
                limit, b = right + 1, self.parts[b][0]

    def allow(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        key = before.astype(np.int64) << 32 | after
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != key)
        out = self.values[slot]
        if len(missing):
            new, where = np.unique(key[missing], return_inverse=True)
            said = np.array([self._may_follow(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()])
            out[missing] = said[where]
            self.keys[slot[missing]], self.values[slot[missing]] = key[missing], out[missing]
        return out


@dataclass
class Automaton:
    """Aho-Corasick over the pieces that may be matched in text."""

    vocabulary: Vocabulary
    whole: bool = field(init=False)  # whether pieces may reach from one word into the next

    def __post_init__(self) -> None:
        v = self.vocabulary
        own = [(p, i) for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k in (NORMAL, USER) and p]
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in own)
        self.seams = Seams(v, own) if v.merges else None
        if self.seams:
            own = [(p, i) for p, i in own if self.seams.reachable[i]]
        self.known: dict[str, int] = {}
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        lowest = min((v.scores[i] for _, i in own), default=0.0)
        highest = max((v.scores[i] for _, i in own), default=0.0)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        # the trie, breadth first
        parent, letter, depth, ends, children = [0], [0], [0], [-1], [{}]
        for piece, i in own:
            state = 0
            for c in map(ord, piece):
                after = children[state].get(c)
                if after is None:
                    after = children[state][c] = len(parent)
                    parent.append(state), letter.append(c), depth.append(depth[state] + 1), ends.append(-1), children.append({})
                state = after
            ends[state] = i
        self.states = len(parent)
        self.piece = np.array(ends, np.int32)
        self.length = np.array(depth, np.int32)
        user = np.array([i >= 0 and v.kinds[i] == USER for i in ends])
        self.score = np.array([v.scores[i] if i >= 0 else 0.0 for i in ends])
        self.score[user] = self.length[user] * highest - 0.1
        letter, parent = np.array(letter, np.int64), np.array(parent, np.int64)
        used, times = np.unique(letter[1:], return_counts=True)
        common = used[np.argsort(-times, kind="stable")][:DENSE]
        self.column = np.full(max(int(used.max(initial=0)), 0x10FFFF) + 1, DENSE, np.uint8)
        self.column[common] = np.arange(len(common))
        rare = np.flatnonzero(self.column[letter] == DENSE)
        rare = rare[rare > 0]
        keys = (parent[rare] << 21) | letter[rare]
        order = np.argsort(keys)
        self.rare_keys, self.rare_to = keys[order], rare[order]
        # failure links level by level; a dense row is that of the failure state with the own edges put in
        self.fail = np.zeros(self.states, np.int32)
        self.next = np.zeros((self.states, DENSE), np.int32)
        for level in range(1, int(self.length.max()) + 1):
            new = np.flatnonzero(self.length == level)
            if level > 1:
                self.fail[new] = self.step(self.fail[parent[new]].astype(np.int64), letter[new])
            self._fill(parent, letter, level)
        # output links: the next state on the way of failures at which a piece ends
        self.out = np.zeros(self.states, np.int32)
        for level in range(1, int(self.length.max()) + 1):
            new = np.flatnonzero(self.length == level)
            fail = self.fail[new]
            self.out[new] = np.where(self.piece[fail] >= 0, fail, self.out[fail])

    def _fill(self, parent: np.ndarray, letter: np.ndarray, level: int) -> None:
        """The dense rows of the states one level up, whose failure rows are ready."""
        above = np.flatnonzero(self.length == level - 1)
        if level > 1:
            self.next[above] = self.next[self.fail[above]]
        new = np.flatnonzero(self.length == level)
        dense = new[self.column[letter[new]] < DENSE]
        self.next[parent[dense], self.column[letter[dense]]] = dense
        last = level == int(self.length.max())
        if last:
            self.next[new] = self.next[self.fail[new]]

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        column = self.column[letter]
        out = self.next[state, np.minimum(column, DENSE - 1)].astype(np.int64)
        left = np.flatnonzero(column == DENSE)
        out[left] = 0
        now = state[left]
        while len(left) and len(self.rare_keys):
            key = (now << 21) | letter[left]
            at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
            found = self.rare_keys[at] == key
            out[left[found]] = self.rare_to[at[found]]
            more = ~found & (now > 0)
            left, now = left[more], self.fail[now[more]].astype(np.int64)
        return out

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of the best segmentation of each word, end to end."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        parts: list[np.ndarray] = []
        counts = np.zeros(len(words), np.int64)
        for at in range(0, len(order), LANES):
            some = order[at : at + LANES]
            ids, n = self._lanes([words[i] for i in some], sizes[some])
            parts.append(ids)
            counts[some] = n
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        begins = np.concatenate(([0], np.cumsum(counts[order])))[:-1]
        first = np.zeros(len(words), np.int64)
        first[order] = begins
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return flat[np.repeat(first - bounds[:-1], counts) + np.arange(len(flat))], bounds

    def _lanes(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pass over words sorted by falling length, position by position."""
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        # cell begin[w] + w + i is position i of word w
        cell = begin + np.arange(len(words))
        score = np.full(len(text) + len(words), -np.inf)
        came, by = np.zeros(len(score), np.int32), np.full(len(score), -1, np.int32)
        score[cell] = 0.0
        state = np.zeros(len(words), np.int64)
        for i in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -i, "left"))
            at = cell[:live] + i + 1
            state = self.step(state[:live], text[begin[:live] + i])
            if self.seams:
                self._follow(at, cell, state, came, by)
                continue
            # a character without a piece of its own costs the unknown score
            one = self.unknown_score + score[at - 1]
            score[at], came[at] = one, 1
            lane, link = np.arange(live), np.where(self.piece[state] >= 0, state, self.out[state])
            while True:
                ends = link > 0
                lane, link = lane[ends], link[ends]
                if not len(lane):
                    break
                here, size = at[lane], self.length[link]
                reached = score[here - size] + self.score[link]
                single = (size == 1) & (by[here] < 0) & (came[here] == 1)
                better = (reached > score[here]) | (single & (reached >= score[here]))
                won = here[better]
                score[won], came[won], by[won] = reached[better], size[better], self.piece[link[better]]
                link = self.out[link]
        return self._traced(text, begin, sizes, cell, came, by)

    def _follow(self, at: np.ndarray, cell: np.ndarray, state: np.ndarray, came: np.ndarray, by: np.ndarray) -> None:
        """The one piece that ends here and may follow the best way to its beginning."""
        came[at] = 1
        lane, link = np.arange(len(at)), np.where(self.piece[state] >= 0, state, self.out[state])
        while True:
            ends = link > 0
            lane, link = lane[ends], link[ends]
            if not len(lane):
                return
            here, size, piece = at[lane], self.length[link], self.piece[link]
            start = here - size
            before = np.where(start == cell[lane], -1, by[start])
            fits = before < 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self.seams.allow(before[inner], piece[inner])
            done = here[fits]
            came[done], by[done] = size[fits], piece[fits]
            lane, link = lane[~fits], self.out[link[~fits]]

    def _traced(self, text, begin, sizes, cell, came, by) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """Follows the best ways back; characters without a piece become bytes, or the unknown id."""
        as_bytes = self.vocabulary.byte_ids()
        lane, pos = np.arange(len(sizes)), sizes.copy()
        lanes, starts, ids = [], [], []
        while True:
            more = pos > 0
            lane, pos = lane[more], pos[more]
            if not len(lane):
                break
            at = cell[lane] + pos
            lanes.append(lane), ids.append(by[at])
            pos = pos - came[at]
            starts.append(begin[lane] + pos)
        if not lanes:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        lane, start, found = np.concatenate(lanes), np.concatenate(starts), np.concatenate(ids)
        order = np.argsort(start)
        lane, start, found = lane[order], start[order], found[order]
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found.astype(np.int32), np.bincount(lane, minlength=len(sizes))
        width = np.ones(len(found), np.int64)
        spelled: list[list[int]] = []
        if as_bytes:
            spelled = [[as_bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in text[start[missing]]]
        else:  # neighbouring characters without a piece are one unknown
            joined = np.zeros(len(found), bool)
            joined[missing[1:]] = (missing[1:] == missing[:-1] + 1) & (lane[missing[1:]] == lane[missing[:-1]])
            width[joined] = 0
            spelled = [[] if joined[m] else [self.vocabulary.unknown] for m in missing]
        width[missing] = [len(s) for s in spelled]
        out = np.repeat(found, width).astype(np.int32)
        out[np.repeat(found < 0, width)] = [i for s in spelled for i in s]
        return out, np.bincount(lane, weights=width, minlength=len(sizes)).astype(np.int64)

    def normal(self, text: str) -> str:
        """The text with spaces as SPACE, as the model's settings ask."""
        if self.vocabulary.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.vocabulary.prefix else "") + text.replace(" ", SPACE)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``best`` of the words, from memory where they were met before."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear(), self.kept.clear()
            new = words
        if new:
            flat, bounds = self.best(new)
            had = len(self.kept[0][1]) - 1 if self.kept else 0
            self.known.update(zip(new, range(had, had + len(new)), strict=True))
            if self.kept:
                old, cut = self.kept[0]
                flat, bounds = np.concatenate((old, flat)), np.concatenate((cut, bounds[1:] + cut[-1]))
            self.kept = [(flat, bounds)]
        flat, bounds = self.kept[0] if self.kept else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return _gather(flat, bounds, at)

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """The ids of each text, and whether they decode to its normal form. Words are
        looked at once for all texts."""
        chunks: list[pa.Array] = []
        count = np.zeros(len(texts), np.int64)
        texts = texts.cast(pa.large_string()).fill_null("")
        # texts with single spaces inside are split by Arrow
        simple = pc.invert(pc.or_(pc.match_substring_regex(texts, "^ |  | $"), pc.equal(texts, ""))).to_numpy(zero_copy_only=False)
        if self.whole or not self.vocabulary.prefix:
            simple[:] = False
        order = np.concatenate((np.flatnonzero(simple), np.flatnonzero(~simple)))
        if simple.any():
            split = pc.split_pattern(texts.filter(pa.array(simple)), " ")
            count[simple] = np.diff(split.offsets.to_numpy())
            chunks.append(pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), split.flatten(), pa.scalar("", pa.large_string())))
        others: list[str] = []
        for i in np.flatnonzero(~simple).tolist():
            normal = self.normal(texts[i].as_py())
            found = ([normal] if normal else []) if self.whole else _CHUNK.findall(normal)
            count[i] = len(found)
            others += found
        chunks.append(pa.array(others, pa.large_string()))
        coded = pa.concat_arrays(chunks).dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ids, bounds = self.look_up(words)
        same = np.array([self._same(w, ids[a:b].tolist()) for w, a, b in zip(words, bounds, bounds[1:], strict=False)], bool)
        flat, ends = _gather(ids, bounds, code)
        # from the order of splitting to that of the texts
        cut = np.concatenate(([0], np.cumsum(count[order])))
        wrong = np.concatenate(([0], np.cumsum(~same[code]))) if len(code) else np.zeros(1, np.int64)
        right = np.empty(len(texts), bool)
        right[order] = wrong[cut[1:]] == wrong[cut[:-1]]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        flat, bounds = _gather(flat, ends[cut], place)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, pa.int32())), right

    def _same(self, word: str, ids: list[int]) -> bool:
        """Whether pieces and bytes spell the word again."""
        pieces, kinds = self.vocabulary.pieces, self.vocabulary.kinds
        spelled = "".join([pieces[i] for i in ids])
        if spelled == word:
            return True
        out = b"".join([bytes([int(pieces[i][3:5], 16)]) if kinds[i] == BYTE else pieces[i].encode() for i in ids])
        return out == word.encode("utf-8", "surrogatepass")


def _gather(flat: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` between bounds[i] and bounds[i + 1] for each i of ``at``, end to end."""
    sizes = (bounds[1:] - bounds[:-1])[at]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.repeat(bounds[:-1][at] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of some ids: pieces end to end, bytes joined, the front space dropped."""
    out = bytearray()
    for i in ids:
        kind = vocabulary.kinds[i]
        if kind == BYTE:
            out.append(int(vocabulary.pieces[i][3:5], 16))
        elif kind == UNKNOWN:
            out += " ⁇ ".encode()
        elif kind != CONTROL:
            out += vocabulary.pieces[i].replace(SPACE, " ").encode()
    text = out.decode("utf-8", "replace")
    return text[1:] if vocabulary.prefix and text.startswith(" ") else text


def spelling(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that each id stands for, end to end, and their bounds."""
    spelled = []
    for piece, kind in zip(vocabulary.pieces, vocabulary.kinds, strict=True):
        if kind == BYTE:
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif kind == UNKNOWN:
            spelled.append(" ⁇ ".encode())
        else:
            spelled.append(b"" if kind == CONTROL else piece.replace(SPACE, " ").encode("utf-8", "surrogatepass"))
    return np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([0, *map(len, spelled)])


def decode_many(vocabulary: Vocabulary, spelled: tuple[np.ndarray, np.ndarray], flat: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
    """The texts, in UTF-8, of the ids between bounds[i] and bounds[i + 1], all looked up together."""
    data, ends = _gather(*spelled, flat)
    ends = ends[bounds]
    for low, high in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        text = data[low:high].tobytes()
        yield text[1:] if vocabulary.prefix and text.startswith(b" ") else text


_built: dict[Vocabulary, Automaton] = {}


def automaton(vocabulary: Vocabulary) -> Automaton:
    """One automaton in each worker."""
    if vocabulary not in _built:
        _built.clear()
        _built[vocabulary] = Automaton(vocabulary)
    return _built[vocabulary]


def encode(
    spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, block: int = 1 << 22, decoded: bool = False
) -> DataFrame:
    """doc_id, ids, n_ids, n_byte_ids and round_trip for each row of ``docs``; with ``decoded`` the
    ids are decoded too, into decoded_bytes (how many) and decoded_md5.

    ids segment the whole text; round_trip says whether decoding them gives the
    normalised text again. Null and empty texts have no ids and round_trip true.
    Rows with null or repeated doc_ids are encoded like others; other columns are
    not read; an empty table gives no rows. What is broadcast is the vocabulary,
    as large as its file; each worker builds one automaton.
    """
    shared = spark.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "ids", "n_ids", "n_byte_ids", "round_trip"] + ["decoded_bytes", "decoded_md5"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = spelling(shared.value) if decoded else None
        machine, kinds = automaton(shared.value), np.array(shared.value.kinds)
        for batch in batches:
            size = pc.binary_length(batch.column(1)).fill_null(0).to_numpy()
            ends = np.cumsum(size)
            row = 0
            while row < len(size):
                end = max(row + 1, int(np.searchsorted(ends, ends[row] - size[row] + block, "right")))
                ids, same = machine.encode(batch.column(1).slice(row, end - row))
                bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
                byte = np.concatenate(([0], np.cumsum(kinds[flat] == BYTE)))
                columns = [
                    batch.column(0).slice(row, end - row), ids, pa.array(np.diff(bounds)),
                    pa.array((byte[bounds[1:]] - byte[bounds[:-1]]).astype(np.int32)), pa.array(same),
                ]
                if spelled:
                    texts = list(decode_many(shared.value, spelled, flat, bounds))
                    columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array([md5(t).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays(columns, names)
                row = end

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run,
        "doc_id long, ids array<int>, n_ids int, n_byte_ids int, round_trip boolean"
        + ", decoded_bytes long, decoded_md5 string" * decoded,
    )


def decode_rows(spark: SparkSession, rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give null, an empty table gives no rows."""
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if r is None else decode(shared.value, r) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
