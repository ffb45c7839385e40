"""Deep-shallow sorting of byte strings, and the longest common prefixes of neighbours.

A multikey quicksort, eight bytes a step, splits the strings down to a shallow depth. Groups that still agree there
have long common prefixes, which byte comparisons would walk again and again; those go into blind tries, which keep only
branching positions: a string walks down on branching bytes alone, is compared with the one leaf it reaches, and is
hung in at the depth where the two differ. A string that ends sorts before its extensions.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64
_END = -1


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int):
        self.depth, self.children = depth, {}


def blind_trie_order(strings: list[bytes], which: list[int]) -> list[int]:
    """The indices ``which`` in the order of their strings; equal strings keep the order they came in."""
    first = which[0]
    root: _Node | list[int] = [first]
    for i in which[1:]:
        s = strings[i]
        n = len(s)
        at = root
        while type(at) is _Node:
            d = at.depth
            nxt = at.children.get(s[d] if d < n else _END)
            if nxt is None:  # any leaf below shares the prefix down to here
                nxt = next(iter(at.children.values()))
            at = nxt
        leaf = strings[at[0]]
        same = common_prefix(s, leaf)
        if same == n == len(leaf):
            at.append(i)
            continue
        ours = s[same] if same < n else _END
        parent, edge, at = None, None, root
        while type(at) is _Node and at.depth < same:
            parent, edge = at, s[at.depth]
            at = at.children[edge]
        if type(at) is _Node and at.depth == same:
            at.children[ours] = [i]
            continue
        node = _Node(same)
        node.children[leaf[same] if same < len(leaf) else _END] = at
        node.children[ours] = [i]
        if parent is None:
            root = node
        else:
            parent.children[edge] = node
    out: list[int] = []
    stack = [root]
    while stack:
        at = stack.pop()
        if type(at) is _Node:
            stack += [at.children[c] for c in sorted(at.children, reverse=True)]
        else:
            out += at
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> np.ndarray:
    """Indices of ``strings`` in byte order."""
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    width = -(-shallow // 8) * 8
    heads = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").reshape(n, width // 8)
    heads = heads.astype(np.uint64)
    out: list[int] = []
    stack: list[tuple[np.ndarray, int]] = [(np.arange(n), 0)] if n else []
    while stack:
        part, step = stack.pop()
        if len(part) == 1:
            out.append(int(part[0]))
            continue
        if step == width // 8 or lengths[part].min() < 8 * step + 8:
            out += blind_trie_order(strings, part.tolist())
            continue
        key = heads[part, step]
        if len(part) <= 2048:  # the quicksort's leaves: one sort of the step's keys, then runs of equal ones go deeper
            order = np.argsort(key, kind="stable")
            part, key = part[order], key[order]
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            if len(cuts) == len(part) - 1:
                out += part.tolist()
            else:
                stack += [(p, step + 1) for p in reversed(np.split(part, cuts))]
            continue
        pivot = np.sort(key[:: max(1, len(key) // 63)])[len(key[:: max(1, len(key) // 63)]) // 2]
        below, above = key < pivot, key > pivot
        for rows, deeper in ((part[above], step), (part[~below & ~above], step + 1), (part[below], step)):
            if len(rows):
                stack.append((rows, deeper))
    return np.array(out, np.int64)


def neighbour_prefixes(strings: list[bytes], order: np.ndarray) -> np.ndarray:
    """Common prefix of each string in order with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    at = order.tolist()
    for k in range(1, len(at)):
        out[k] = common_prefix(strings[at[k - 1]], strings[at[k]])
    return out
