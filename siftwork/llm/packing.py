"""Lexical retrieval packing: documents that share rare terms fill a training window together.

Documents are ordered by a MinHash of their words, weighted by rarity, and dealt in ranges of that order, each
sorted, so lexically close ones meet. Each range is cut into shards with a BM25 inverted index over token ids. A seed document opens
a window, the index returns its unused neighbours, best first, and they fill the window; the last one is cut
and its rest stays in the pool.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.bpe import encoder
from siftwork.llm.common import mix, release_memory, rows_by_bytes, stored
from siftwork.llm.word_bpe import word_bpe

WINDOW = 4096
#: Tokens of a shard, the unit of one inverted index.
SHARD = 1 << 20
#: Shards of a range, the unit of a task.
SHARDS = 4
#: BM25's saturation and length normalisation; fixed values in common use.
K1, B = 1.2, 0.75


class Bm25:
    """Inverted index of a shard: term -> (document, weight) postings in arrays."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        pairs = np.concatenate(docs).astype(np.int64) * n + np.repeat(np.arange(n), sizes)
        pairs, tf = np.unique(pairs, return_counts=True)
        term, self.doc = pairs // n, pairs % n
        self.terms, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.end = self.first + df
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean()))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        self.n = n
        by_doc = np.argsort(self.doc, kind="stable")
        self.row = np.repeat(np.arange(len(self.terms)), df)[by_doc]
        self.doc_first = np.searchsorted(self.doc[by_doc], np.arange(n + 1))

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for the terms of one."""
        rows = self.row[self.doc_first[doc] : self.doc_first[doc + 1]]
        size = self.end[rows] - self.first[rows]
        at = np.arange(size.sum()) + np.repeat(self.first[rows] - np.cumsum(size) + size, size)
        return np.bincount(self.doc[at], self.weight[at], self.n).astype(float)


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); every token is in one piece, only the last sequences are short.

    Whole windows of long documents come first. What is left at the end of the shard is cut at powers
    of two, which need no padding.
    """
    out: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(docs), np.int64)
    size = np.array([len(d) for d in docs], np.int64)
    for i, n in enumerate(size.tolist()):
        while n - start[i] >= window:
            out.append([(i, int(start[i]), window)])
            start[i] += window
    left = size - start
    rest: list[tuple[int, int, int]] = []
    unused = left > 0
    if unused.any():
        index, seed = Bm25([d[s:] if len(d) > s else d[:1] for d, s in zip(docs, start.tolist(), strict=True)]), 0
    while unused.any():
        while not unused[seed]:
            seed += 1
        pieces, room = [], window
        score = index.scores(seed) * unused
        score[seed] = np.inf
        found = np.flatnonzero(score)
        near = iter(found[np.argsort(-score[found], kind="stable")].tolist())
        more = seed
        while room and unused.any():
            i = next(near, None)
            if i is None:  # no neighbour is left: the next in order
                while more < len(docs) and not unused[more]:
                    more += 1
                i = more
            if not unused[i]:
                continue
            n = min(room, int(left[i]))
            pieces.append((i, int(start[i]), n))
            start[i] += n
            left[i] -= n
            room -= n
            unused[i] = left[i] > 0
        if room:
            rest = pieces
        else:
            out.append(pieces)
    while rest:
        room, sequence = 1 << (sum(p[2] for p in rest).bit_length() - 1), []
        while room:
            i, s, n = rest.pop(0)
            sequence.append((i, s, min(n, room)))
            if n > room:
                rest.insert(0, (i, s + room, n - room))
            room -= min(n, room)
        out.append(sequence)
    return out


def narrowest(tokenizer: str, end_id: int) -> type:
    """The smaller of two number types that holds every id."""
    return np.uint16 if max(end_id, *word_bpe(tokenizer).token) < 1 << 16 else np.uint32


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, kind: type = np.uint32) -> DataFrame:
    """doc_id, ids (little-endian numbers of that kind, end_id last); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, end = encoder(tokenizer), np.array([end_id], kind).tobytes()
        for batch in rows_by_bytes(batches, "text", 2 << 20):
            flat, sizes = words_of.encode(batch.column(1).to_pylist())
            ids = [part.tobytes() + end for part in np.split(flat.astype(kind), np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


#: Documents whose tokens are marked at once, a row of the vocabulary each.
MARKED = 64


def rarity(rows: DataFrame, kind: type = np.uint32) -> tuple[np.ndarray, int]:
    """The idf of each token id over all rows (ids), 0 for tokens of one document; as long as the vocabulary. And all tokens' number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n, tokens = np.zeros(0, np.int64), 0, 0
        for batch in rows_by_bytes(batches, "ids", 4 << 20):
            held = [np.frombuffer(row, kind)[:-1] for row in batch.column(0).to_pylist()]
            wide = max((int(h.max()) + 1 for h in held if len(h)), default=0)
            if wide > len(count):
                count = np.pad(count, (0, wide - len(count)))
            for a in range(0, len(held), MARKED):
                marks = np.zeros((MARKED, len(count)), bool)
                for row, h in zip(marks, held[a : a + MARKED], strict=False):
                    row[h] = True
                count += marks.sum(axis=0)
            n += len(held)
            tokens += sum(len(h) + 1 for h in held)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], some)), pa.array(np.append([n, tokens], count[some]))], names=["token", "n"])

    counts = {r["token"]: r["n"] for r in rows.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n, tokens = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(max(counts, default=0) + 1)
    df[list(counts)] = list(counts.values())
    return np.where(df > 1, np.log(max(n, 1) / np.maximum(df, 1)), 0.0), tokens


def ordered(rows: DataFrame, weight: np.ndarray, kind: type = np.uint32) -> DataFrame:
    """doc_id, near, ids: near is made of the two least tokens, where a token's time is exponential at the rate of its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = mix(np.arange(1, len(weight) + 1, dtype=np.uint64))
        time = np.full(len(weight), np.inf)
        np.divide(-np.log(((token >> np.uint64(12)).astype(float) + 0.5) / 2.0**52), weight, out=time, where=weight > 0)
        # Places by time, distinct for distinct tokens; tokens of no weight come last, under one name.
        place = np.empty(len(weight), np.int64)
        place[np.argsort(time, kind="stable")] = np.arange(len(weight))
        name = np.append((mix(token ^ np.uint64(1)) >> np.uint64(33)).astype(np.int64)[np.argsort(place)], 0)
        name[np.searchsorted(np.sort(time), np.inf) :] = 0
        for batch in rows_by_bytes(batches, "ids", 4 << 20):
            rows = batch.column(1).to_pylist()
            sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // np.dtype(kind).itemsize
            ends = np.cumsum(sizes)
            at = np.minimum(np.frombuffer(b"".join(rows), kind).astype(np.int64), len(weight))
            at = np.append(place, len(weight))[at]
            at[ends - 1] = len(weight)  # the end token
            first = np.minimum.reduceat(at, ends - sizes)
            at[at == np.repeat(first, sizes)] = len(weight)
            second = np.minimum.reduceat(at, ends - sizes)
            near = name[first] << 31 | name[second]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int64()), batch.column(1)], names=["doc_id", "near", "ids"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, near long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids (the piece's, little-endian 32-bit), doc_tokens, sequence_id, offset.

    Each row of docs is one document, repeated rows too; empty and null texts are the end token alone.
    Sequences have `window` tokens, apart from powers of two at the end of a shard. An empty table gives no rows.
    """
    kind = narrowest(tokenizer, end_id)
    rows = stored(tokenised(docs, tokenizer, end_id, kind), "tokens")
    weight, total = rarity(rows, kind)
    # Ranges follow from the tokens alone, so that a task's bytes stay and no setting decides which documents meet; equal documents are
    # told apart by their ids' hash.
    ranges = max(1, math.ceil(total / (SHARDS * SHARD)))
    order = ("near", "doc_id", F.xxhash64("ids"))
    dealt = ordered(rows, weight, kind).repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        for doc_ids, ids in _shards(batches, kind):
            sequences = pack_shard(ids, window)
            pieces = [(i, s, n, sequence + q, o) for q, seq in enumerate(sequences) for (i, s, n), o in zip(seq, _offsets(seq), strict=True)]
            sequence += len(sequences)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_ids[p[0]] for p in pieces], pa.int64()),
                    pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array([p[2] for p in pieces], pa.int64()),
                    pa.array([ids[p[0]][p[1] : p[1] + p[2]].astype(np.uint32).tobytes() for p in pieces], pa.binary()),
                    pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
                    pa.array([p[3] for p in pieces], pa.int64()),
                    pa.array([p[4] for p in pieces], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _offsets(sequence: list[tuple[int, int, int]]) -> list[int]:
    lengths = np.array([p[2] for p in sequence])
    return (np.cumsum(lengths) - lengths).tolist()


def _shards(batches: Iterator[pa.RecordBatch], kind: type = np.uint32) -> Iterator[tuple[list, list[np.ndarray]]]:
    doc_ids: list = []
    ids: list[np.ndarray] = []
    total = 0
    for batch in batches:
        for doc_id, row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            tokens = np.frombuffer(row, kind)
            if total and total + len(tokens) > SHARD:
                yield doc_ids, ids
                doc_ids, ids, total = [], [], 0
            doc_ids.append(doc_id)
            ids.append(tokens)
            total += len(tokens)
    if ids:
        yield doc_ids, ids
    release_memory()
