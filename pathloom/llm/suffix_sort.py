"""Deep-shallow sorting of strings, and the prefix lengths that neighbours share.

Multikey quicksort orders the strings up to a shallow depth; what still agrees there
goes into a blind trie, which looks at one byte per branching and compares whole
strings only once per insertion, however long their common prefix is.
"""

from __future__ import annotations

SHALLOW = 96
STEP = 8


def common_prefix(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class _Node:
    """A branching at ``depth``: children by the byte there, -1 where the string ends."""

    __slots__ = ("depth", "children")

    def __init__(self, depth: int):
        self.depth, self.children = depth, {}


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """``group`` (indices of strings) in string order; equal strings keep their order."""
    root = [group[0]]
    for new in group[1:]:
        s, node = strings[new], root
        while type(node) is _Node:  # blind: skipped bytes are not compared
            node = node.children.get(_byte(s, node.depth)) or next(iter(node.children.values()))
        other = strings[node[0]]
        lcp = common_prefix(s, other)
        if lcp == len(s) == len(other):
            node.append(new)
            continue
        parent, at = None, root
        while type(at) is _Node and at.depth < lcp:
            parent, at = at, at.children.get(_byte(s, at.depth))
        if type(at) is _Node and at.depth == lcp:
            at.children[_byte(s, lcp)] = [new]
            continue
        split = _Node(lcp)
        split.children = {_byte(s, lcp): [new], _byte(other, lcp): at}
        if parent is None:
            root = split
        else:
            parent.children[_byte(s, parent.depth)] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is _Node:
            stack.extend(node.children[c] for c in sorted(node.children, reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow_sort(strings: list[bytes]) -> list[int]:
    """Indices of ``strings`` in order."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out.extend(group)
        elif depth >= SHALLOW:
            out.extend(blind_trie(strings, group))
        else:
            keys = [strings[i][depth : depth + STEP] for i in group]
            pivot = keys[len(keys) // 2]
            less = [i for i, k in zip(group, keys, strict=True) if k < pivot]
            more = [i for i, k in zip(group, keys, strict=True) if k > pivot]
            same = [i for i, k in zip(group, keys, strict=True) if k == pivot]
            stack.append((more, depth))
            # A key shorter than the step ends its string: such strings are equal.
            stack.append((same, depth + STEP if len(pivot) == STEP else SHALLOW))
            stack.append((less, depth))
    return out
