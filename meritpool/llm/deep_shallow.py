"""Sorting of long strings: multikey quicksort to a shallow depth, then blind tries.

Quicksort compares words of eight bytes and goes on in the group of equal words.
Strings that still agree at the shallow depth have a long common prefix; they go
into a blind trie, which looks at branching bytes only on the way down and compares
each string with one other, once.
"""

from __future__ import annotations

#: Bytes that quicksort looks at before a group goes to the trie.
SHALLOW = 32
WORD = 8


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int):
        self.depth = depth
        self.kids: dict[int, _Node | list[int]] = {}  # by the byte at depth, -1 at the end of the string


def blind_trie(strings: list[bytes], items: list[int]) -> list[int]:
    """``items`` in the order of their strings."""
    top: _Node | list[int] = [items[0]]
    for item in items[1:]:
        s = strings[item]
        path: list[_Node] = []
        at = top
        while isinstance(at, _Node):
            path.append(at)
            key = s[at.depth] if at.depth < len(s) else -1
            at = at.kids.get(key) or next(iter(at.kids.values()))
        other = strings[at[0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            at.append(item)
            continue
        level = next((i for i, node in enumerate(path) if node.depth >= depth), len(path))
        mine = s[depth] if depth < len(s) else -1
        if level < len(path) and path[level].depth == depth:
            path[level].kids[mine] = [item]
            continue
        node = _Node(depth)
        node.kids[other[depth] if depth < len(other) else -1] = path[level] if level < len(path) else at
        node.kids[mine] = [item]
        if level:
            above = path[level - 1]
            above.kids[s[above.depth] if above.depth < len(s) else -1] = node
        else:
            top = node
    out: list[int] = []
    stack = [top]
    while stack:
        at = stack.pop()
        if isinstance(at, _Node):
            stack.extend(at.kids[k] for k in sorted(at.kids, reverse=True))
        else:
            out.extend(at)
    return out


def sort(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The positions of ``strings`` in their order; equal strings stand together."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2:
            out.extend(items)
            continue
        if depth >= shallow:
            out.extend(blind_trie(strings, items))
            continue
        words = [strings[i][depth : depth + WORD] for i in items]
        pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
        less = [i for i, w in zip(items, words, strict=True) if w < pivot]
        same = [i for i, w in zip(items, words, strict=True) if w == pivot]
        more = [i for i, w in zip(items, words, strict=True) if w > pivot]
        stack.append((more, depth))
        # a word cut short is the end of its string: such strings are equal
        stack.append((same, depth + WORD if len(pivot) == WORD else shallow))
        stack.append((less, depth))
    return out
