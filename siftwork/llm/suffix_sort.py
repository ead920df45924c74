"""Deep-shallow sorting of suffixes: multikey quicksort over the first bytes, blind tries for what still ties."""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort compares before the blind tries take over.
SHALLOW = 32


class _Node:
    """An inner node of a blind trie: strings below share their first `depth` bytes; only the next byte is kept."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int):
        self.depth, self.children = depth, {}


def _common(a: bytes, b: bytes, low: int) -> int:
    """Length of the common prefix, at least low."""
    high = min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def blind_trie_order(strings: list[bytes], shared: int = 0) -> list[list[int]]:
    """Numbers of the strings in lexical order, equal strings in one list; all share `shared` bytes.

    A string walks down by the branching bytes alone, meets one leaf, and one comparison with that leaf
    finds where it must branch off. Strings of equal length are expected, as suffixes cut at one depth are.
    """
    root: _Node | list[int] = [0]
    for i, s in enumerate(strings[1:], 1):
        node = root
        while isinstance(node, _Node):
            node = node.children.get(s[node.depth]) or next(iter(node.children.values()))
        other = strings[node[0]]
        if s == other:
            node.append(i)
            continue
        depth = _common(s, other, shared)
        above, node = None, root
        while isinstance(node, _Node) and node.depth < depth:
            above, node = node, node.children[s[node.depth]]
        if isinstance(node, _Node) and node.depth == depth:
            node.children[s[depth]] = [i]
            continue
        branch = _Node(depth)
        branch.children = {other[depth]: node, s[depth]: [i]}
        if above is None:
            root = branch
        else:
            above.children[s[above.depth]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            out.append(node)
        else:
            stack += [node.children[b] for b in sorted(node.children, reverse=True)]
    return out


def deep_shallow(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Orders the strings data[s : s + length] at the starts s, which must lie within data.

    Returns places, an order of the starts, and classes, the number of distinct strings before each of
    them in that order: neighbours of one class share all `length` bytes.
    """
    n = len(starts)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of each place: the first place of its group of ties
    open_ = np.arange(n)  # places whose groups have more than one member
    depth = 0
    while len(open_) and depth < min(shallow, length):
        width = min(8, length - depth)
        at = starts[order[open_]] + depth
        key = np.zeros(len(at), np.uint64)
        for i in range(width):
            key = (key << np.uint64(8)) | data[at + i].astype(np.uint64)
        by = np.lexsort((key, group[open_])) if depth else np.argsort(key, kind="stable")
        key, groups = key[by], group[open_][by]
        order[open_] = order[open_][by]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (groups[1:] != groups[:-1])])
        group[open_] = open_[first][np.cumsum(first) - 1]
        size = np.diff(np.append(np.flatnonzero(first), len(open_)))
        open_ = open_[np.repeat(size > 1, size)]
        depth += width
    if len(open_) and depth < length:
        first = np.flatnonzero(np.concatenate([[True], group[open_][1:] != group[open_][:-1]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(open_)], strict=True):
            places = open_[a:b]
            members = order[places]
            strings = [data[s : s + length].tobytes() for s in starts[members].tolist()]
            at = 0
            for same in blind_trie_order(strings, depth):
                order[places[at : at + len(same)]] = members[same]
                group[places[at : at + len(same)]] = places[at]
                at += len(same)
    new = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
    return order, np.cumsum(new) - 1
