"""Words, lines and their 64-bit hashes for many texts at once, in numpy.

All functions take the bytes of a run of texts and the offsets of the texts in
it, as ``frames.blocks`` gives them. A word is a run of bytes other than
\\x20 and \\x09-\\x0D. Strings are compared by 64-bit polynomial hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For words without punctuation: ASCII bytes other than letters and digits.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _STEP), ("down", _BACK)):
            one = np.full(size, base)
            one[0] = 1
            _powers[name] = np.cumprod(one, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums from which ``spans`` takes the hash of any substring."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end): equal strings have equal hashes."""
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Words:
    starts: np.ndarray  # of each word in the bytes
    ends: np.ndarray
    bounds: np.ndarray  # text i has the words bounds[i] to bounds[i + 1]
    hashes: np.ndarray

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = WHITE) -> Words:
    """The words of the texts; ``between`` says which bytes part them."""
    solid = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = solid.copy(), solid.copy()
    if len(data):
        opens[1:] &= ~solid[:-1] | edge[1:-1]
        closes[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = spans(prefix(LOWER[data] if lower else data), starts, ends)
    return Words(starts, ends, np.searchsorted(starts, offsets), hashes)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each line, split at \\n; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    inner = np.searchsorted(breaks, offsets)
    count = np.diff(inner)
    text = np.repeat(np.arange(len(count)), count + 1)
    first = np.concatenate(([0], np.cumsum(count + 1)[:-1])).astype(np.int64)
    last = np.cumsum(count + 1) - 1
    starts, ends = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    is_first, is_last = np.zeros(len(text), bool), np.zeros(len(text), bool)
    is_first[first], is_last[last] = True, True
    starts[is_first], ends[is_last] = offsets[:-1], offsets[1:]
    starts[~is_first], ends[~is_last] = breaks + 1, breaks
    return text, starts, ends


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between neighbouring bounds."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated(keys: np.ndarray, first: bool) -> np.ndarray:
    """Which keys occur twice or more; without ``first``, all but one of each."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return out


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
