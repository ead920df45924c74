"""A minimal acyclic word transducer in flat arrays, read from a memory-mapped file.

Words share prefixes and suffixes in one minimal automaton. Each transition carries how many words
come before those behind it, so a path's sum numbers its word; the number selects the word's ids.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"SIFTDAWG"


def _minimal(words: list[bytes]) -> list[dict[int, int] | tuple]:
    """States of the minimal automaton of sorted distinct words: (final, {byte: state}); state 0 is the start."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, dict[int, int]]] = [(False, {})]
    # Nodes on the path of the last word: [final, edges]; closed ones are replaced by registered states.
    path: list[list] = [[False, {}]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth:
            final, edges = path.pop()
            key = (final, tuple(edges.items()))
            if key not in register:
                register[key] = len(states)
                states.append((final, edges))
            path[-1][1][last[len(path) - 1]] = register[key]

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared + 1)
        path += [[False, {}] for _ in range(len(word) - shared)]
        path[-1][0] = True
        last = word
    close(1)
    states[0] = tuple(path[0])
    return states


def compile_words(entries: dict[str, bytes]) -> bytes:
    """The file of a lexicon: word -> ids as little-endian 32-bit numbers. The empty word is left out."""
    words = sorted(w.encode() for w in entries if w)
    states = _minimal(words)
    behind = np.zeros(len(states), np.int64)
    order: list[int] = []  # a state after all those it leads to: registered states only lead to older ones
    order = [*range(1, len(states)), 0]
    keys, targets, skips = [], [], []
    for s in order:
        final, edges = states[s]
        total = int(final)
        for byte, to in edges.items():
            keys.append(s * 256 + byte)
            targets.append(to)
            skips.append(total)
            total += int(behind[to])
        behind[s] = total
    at = np.argsort(np.array(keys, np.int64), kind="stable")
    ids = [entries[w.decode()] for w in words]
    arrays = [
        np.array(keys, np.int64)[at],
        np.array(targets, np.int32)[at],
        np.array(skips, np.int32)[at],
        np.array([s[0] for s in states], np.uint8),
        np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32),
        np.frombuffer(b"".join(ids), np.int32),
    ]
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return MAGIC + head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Transducer:
    """Looks up words in a compiled file, which stays on disk and is mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError(f"{path} is not a compiled lexicon")
        kinds = (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32)
        at = len(MAGIC) + 8 * len(kinds)
        arrays = []
        for kind, n in zip(kinds, data[len(MAGIC) : at].view(np.int64).tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            arrays.append(data[at : at + size].view(kind))
            at += size + -size % 8
        self.keys, self.targets, self.skips, self.final, self.starts, self.ids = arrays

    def __len__(self) -> int:
        return len(self.starts) - 1

    def find(self, words: list[str]) -> list[bytes | None]:
        """Ids of each word, None for those not in the lexicon; all words walk the automaton in step, byte by byte."""
        coded = [w.encode() for w in words]
        lengths = np.array([len(w) for w in coded], np.int64)
        number = np.zeros(len(coded), np.int64)
        state = np.zeros(len(coded), np.int64)
        alive = np.flatnonzero(lengths > 0)
        found = np.zeros(len(coded), bool)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(coded), np.uint8)
        depth = 0
        while len(alive) and len(self.keys):
            key = state[alive] * 256 + data[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive, at = alive[hit], at[hit]
            number[alive] += self.skips[at]
            state[alive] = self.targets[at]
            depth += 1
            ended = lengths[alive] == depth
            found[alive[ended]] = self.final[state[alive[ended]]] > 0
            alive = alive[~ended]
        return [self.ids[self.starts[k] : self.starts[k + 1]].tobytes() if ok else None for k, ok in zip(number.tolist(), found.tolist(), strict=True)]
