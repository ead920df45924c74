"""Terms of a batch of texts as one Arrow array, and run-length scans over sorted rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def letters(also: str = "") -> np.ndarray:
    """A flag for each byte: ASCII letters, the characters of `also`, and all bytes of other characters."""
    flags = np.zeros(256, bool)
    flags[128:] = True
    for a in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", also):
        flags[np.frombuffer((a + a.lower()).encode(), np.uint8)] = True
    return flags


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms(texts: pa.Array, flags: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of flagged bytes in the texts, A-Z in lower case, and of each run the number of its text.

    In UTF-8 all bytes of a character beyond ASCII are over 127, so runs of bytes are runs of characters. A null text has none.
    """
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    base = int(bounds[0]) if n else 0
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base : int(bounds[-1])] if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    if texts.null_count:  # bytes behind a null are none of its text
        sizes = np.where(np.asarray(texts.is_valid()), np.diff(bounds), 0)
        data = data[np.repeat(np.asarray(texts.is_valid()), np.diff(bounds))]
        bounds, base = np.concatenate([[0], np.cumsum(sizes)]), 0
    ends_of = bounds[1:] - base
    inside = flags[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    cuts = ends_of[:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])  # empty texts end where others do
    both = cuts[inside[cuts - 1] & inside[cuts]] if len(cuts) else cuts  # a run that goes over into the next text
    edges = np.concatenate([change, both, both, *([[0]] if len(data) and inside[0] else []), *([[len(data)]] if len(data) and inside[-1] else [])]).astype(np.int64)
    edges.sort(kind="stable")
    start, end = edges[::2], edges[1::2]
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(_LOWER[data[inside]])])
    return found, np.searchsorted(ends_of, start, "right")


def runs(*keys: np.ndarray) -> np.ndarray:
    """The first place of each run of equal rows of sorted keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
