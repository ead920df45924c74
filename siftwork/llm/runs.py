"""Runs of characters in many texts at once: texts as arrays of code points, and the distinct words among their slices."""

from __future__ import annotations

import numpy as np

from siftwork.llm.common import ByteHash

#: Code points that a comparison of places takes at once.
CHUNK = 1 << 20


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after another, each followed by a line end, and where each text ends."""
    units = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return units, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1


def as_text(units: np.ndarray) -> str:
    return units.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def distinct(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct word units[start:end], and the number of the word at each place.

    Places meet by a hash and are then compared, so equal numbers mean equal words.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - starts
    _, first, number = np.unique(ByteHash(units).slices(starts, ends) + size.astype(np.uint64), return_index=True, return_inverse=True)
    other = np.flatnonzero(first[number] != np.arange(len(starts)))
    model = first[number[other]]
    cuts = np.searchsorted(np.cumsum(size[other]), np.arange(CHUNK, int(size[other].sum()), CHUNK), "right").tolist()
    clash = bool((size[other] != size[model]).any())
    for a, b in zip([0, *cuts], [*cuts, len(other)], strict=True):
        n = size[other[a:b]]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        clash = clash or bool((units[np.repeat(starts[other[a:b]], n) + step] != units[np.repeat(starts[model[a:b]], n) + step]).any())
    if clash:  # two words with one hash: numbered by the words themselves
        names: dict[bytes, int] = {}
        number = np.array([names.setdefault(units[a:b].tobytes(), len(names)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(number, return_index=True)[1]
    return first, number


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[first : first + size] of each row, one after another."""
    return flat[np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)]
