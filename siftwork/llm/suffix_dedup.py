"""Removal of long byte strings that occur more than once in a corpus.

Texts are dealt into blocks of about a megabyte, stored once by block. A string of LENGTH bytes is decided
in three levels, each an exchange in which blocks send fingerprints and learn which of them others have too:

1. Every window of LENGTH bytes has one anchor, its least hashed run of ANCHOR bytes. Windows whose anchor
   occurs only once occur only once.
2. The windows of a repeated anchor are taken STEP at a time, aligned to the anchor: where all bytes they
   cover recur together, all of them recur; where the bytes they have in common occur once, none does.
3. The few windows left, at the ends of repeated passages, are put in suffix order by deep-shallow sorting,
   which joins equal ones; one fingerprint for each distinct window is exchanged.

A block sends each fingerprint once, sorted, cut into cells by leading bits, so a string that is in every
document weighs no more in a task than its number of blocks. Answers are a byte for each fingerprint.
Equality across blocks rests on two independent 64-bit fingerprints of whole strings.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import BASES, ByteHash, fresh, mix, nullable, release_memory, shared_dir, stored
from siftwork.llm.suffix_sort import deep_shallow

LENGTH, ANCHOR, STEP = 200, 100, 16
#: Text bytes of a block, and of the text that shares a cell of fingerprints.
BLOCK, CELL = 1 << 20, 2 << 20


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    return np.minimum(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def _unique(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows in ascending order of the first key, the row of each input, and their counts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    rows = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for r in rows:
        new[1:] |= r[1:] != r[:-1]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return [r[new] for r in rows], inverse, np.bincount(inverse, minlength=int(new.sum()))


class Block:
    """The texts of one block and what is known of their windows so far. Levels go in order."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        self.length, self.sizes = length, np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        anchor = min(ANCHOR, length)
        reach = length - anchor + 1
        self.window = np.zeros(0, np.int64)
        self.hash, self.second = ByteHash(self.data), ByteHash(self.data, BASES[1])
        if len(self.data) >= length:
            valid = np.ones(len(self.data) - length + 1, bool)
            for end in self.ends[:-1].tolist():  # windows that would cross into the next text
                valid[max(0, end - length + 1) : end] = False
            self.window = np.flatnonzero(valid)
            # The least hash over a window's anchors, the leftmost of equal ones: its place is in the low bits.
            bits = np.uint64(max(1, len(self.data)).bit_length())
            order = self.hash.every(anchor)
            places = (order >> bits << bits) | np.arange(len(order), dtype=np.uint64)
            least = _sliding_min(places, reach)[self.window]
            self.owner = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            self.grams = order
        else:
            self.owner, self.grams = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        new = np.concatenate([[True], self.owner[1:] != self.owner[:-1]]) if len(self.owner) else np.zeros(0, bool)
        self.anchors, self.anchor_of = self.owner[new], np.cumsum(new) - 1
        self.repeated = np.zeros(len(self.window), bool)

    def level1(self) -> list[np.ndarray]:
        # Anchors are the least of their hashes; mixed again, they spread over all cells.
        sent, self._row, self._count = _unique(mix(self.grams[self.anchors]))
        return sent

    def learn1(self, answer: np.ndarray) -> None:
        open_ = ((answer > 0) | (self._count > 1))[self._row]
        self.open = np.flatnonzero(open_[self.anchor_of])  # windows of repeated anchors

    def level2(self) -> list[np.ndarray]:
        p, a = self.window[self.open], self.owner[self.open]
        step = (a - p) // STEP
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (step[1:] != step[:-1])]) if len(p) else np.zeros(0, bool)
        self._group = np.cumsum(new) - 1
        a, step = a[new], step[new]
        text = np.searchsorted(self.ends, p[new], "right")
        last = a - step * STEP  # the last start of the group; the first is STEP - 1 before
        low = np.maximum(last - STEP + 1, self.starts[text])
        high = np.minimum(last + self.length, self.ends[text])
        core = self.hash.slices(last, last - STEP + 1 + self.length) + step.astype(np.uint64)
        shape = ((a - low) * 1024 + (high - a)).astype(np.uint64)
        sent, self._row, self._count = _unique(mix(core), mix(self.hash.slices(low, high) ^ mix(shape)), self.second.slices(low, high))
        return sent

    def learn2(self, answer: np.ndarray) -> None:
        """Answers: 0 alone, 1 all recur, 2 core recurs otherwise, 3 as 1 and 2 and this block speaks for it, 4 as 3 but another does."""
        code = answer[self._row]
        recurs = ((code == 1) | (code >= 3)) | (self._count > 1)[self._row]
        first = np.zeros(len(code), bool)  # of equal groups in this block, one speaks
        first[np.unique(self._row, return_index=True)[1]] = True
        self.repeated[self.open[recurs[self._group]]] = True
        self.open = self.open[((code == 2) | (code == 3))[self._group] & first[self._group]]

    def level3(self) -> list[np.ndarray]:
        starts = self.window[self.open]
        order, classes = deep_shallow(self.data, starts, self.length)
        new = np.concatenate([[True], classes[1:] != classes[:-1]]) if len(classes) else np.zeros(0, bool)
        at = starts[order[new]]
        class_of = np.empty(len(starts), np.int64)
        class_of[order] = classes
        size = np.bincount(classes, minlength=len(at))
        sent, row, _ = _unique(self.hash.slices(at, at + self.length), self.second.slices(at, at + self.length))
        self._row, self._count = row[class_of], size[class_of]
        return sent

    def learn3(self, answer: np.ndarray) -> None:
        recurs = (answer[self._row] > 0) | (self._count > 1)
        self.repeated[self.open[recurs]] = True

    def removed(self) -> np.ndarray:
        """A flag for each byte covered by a repeated window."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        at = self.window[self.repeated]
        edge[at] += 1
        np.subtract.at(edge, at + self.length, 1)
        return np.cumsum(edge[:-1]) > 0


def _answer1(group: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """1 for fingerprints that more than one block sent."""
    _, row, count = _unique(*keys)
    return (count[row] > 1).astype(np.uint8)


def _answer2(group: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    (core, *_), row, count = _unique(*keys)
    _, of_core, shapes = _unique(core)
    several = (shapes[of_core] > 1)[row]
    many = (count > 1)[row]
    first = np.zeros(len(row), bool)
    first[np.unique(row, return_index=True)[1]] = True
    return np.select([many & ~several, many & first, many, several], [1, 3, 4, 2], 0).astype(np.uint8)


ANSWERS: dict[int, tuple[int, Callable]] = {1: (1, _answer1), 2: (3, _answer2), 3: (2, _answer1)}
_SENT = "cell long, block long, level int, keys binary"
_ANSWERED = "block long, level int, cell long, answer binary"


def _learned(block: Block, answers: dict[int, np.ndarray], until: int) -> list[np.ndarray]:
    """Takes the block through the levels before `until`; returns what it then sends (nothing after the last)."""
    for level in range(1, until + 1):
        sent = getattr(block, f"level{level}")() if level <= 3 else []
        if level == until:
            return sent
        getattr(block, f"learn{level}")(answers.get(level, np.zeros(0, np.uint8)))
    return []


def _read_answers(answers: pa.Table) -> dict[int, np.ndarray]:
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("level", "cell", "answer")), strict=True))
    return {k: np.frombuffer(b"".join(a for n, _, a in rows if n == k), np.uint8) for k in {r[0] for r in rows}}


def _texts(rows: pa.Table, row_: str) -> tuple[list[bytes], np.ndarray]:
    """Texts in a fixed order, and the order: by id, then text, so that every level numbers them alike."""
    texts = [(t or "").encode("utf-8", "replace") for t in rows.column("text").to_pylist()]
    ids = rows.column(row_).to_pylist()
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])), np.int64)
    return [texts[i] for i in order.tolist()], order


def _ask(level: int, bits: int, length: int, row_: str) -> tuple[Callable, Callable]:
    """What a block sends at a level: functions of its rows alone, and of its rows and answers."""

    def run(key: tuple, rows: pa.Table, answers: dict[int, np.ndarray]) -> pa.Table:
        block_id = key[0].as_py()
        sent = _learned(Block(_texts(rows, row_)[0], length), answers, level)
        if block_id % 8 == 0:
            release_memory()
        cell = (sent[0] >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(cell)) if len(cell) else first  # a block may have nothing left to ask
        keys = [b"".join(k[a:b].tobytes() for k in sent) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        return pa.table({"cell": pa.array(cell[first], pa.int64()), "block": pa.array([block_id] * len(keys), pa.int64()), "level": pa.array([level] * len(keys), pa.int32()), "keys": pa.array(keys, pa.binary())})

    def first_time(key: tuple, rows: pa.Table) -> pa.Table:
        return run(key, rows, {})

    def again(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        return run(key, rows, _read_answers(known))

    return first_time, again


def _tell(level: int) -> Callable[[pa.Table], pa.Table]:
    width, answer = ANSWERS[level]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")  # one row for each block: a fixed order, whatever the shuffle does
        parts = [np.frombuffer(k, np.uint64).reshape(width, -1) for k in rows.column("keys").to_pylist()]
        keys = [np.concatenate([p[i] for p in parts]) for i in range(width)]
        sizes = np.array([p.shape[1] for p in parts])
        told = answer(np.repeat(np.arange(len(parts)), sizes), keys)
        ends = np.cumsum(sizes)
        out = [told[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        return pa.table({"block": rows.column("block"), "level": rows.column("level"), "cell": rows.column("cell"), "answer": pa.array(out, pa.binary())})

    return run


def with_repeats(docs: DataFrame, out: Callable[[pa.Table, list[np.ndarray]], pa.Table], schema, length: int = LENGTH) -> DataFrame:
    """out(rows, removed) for the rows of each block of docs, which needs a text column; removed has a flag for each byte of a row's text.

    Matches never cross texts; a null text is empty. Rows are dealt by a hash of their contents and place, so that rows alike in
    all columns spread over the blocks like others and count as occurrences of each other, as any copies do. Places
    hold for rows read from storage; what a shuffle made should be stored first. The dealt rows are written once.
    """
    if length < ANCHOR + STEP:
        raise ValueError(f"length must be {ANCHOR + STEP} at least")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks, bits = max(1, math.ceil(total / BLOCK)), max(8, math.ceil(math.log2(max(1, total / CELL))))
    row_, block_ = fresh("__row", docs.columns), fresh("__block", docs.columns)
    own = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    dealt = docs.withColumn(row_, F.xxhash64(*own, F.monotonically_increasing_id())).withColumn(block_, F.pmod(F.xxhash64(row_), F.lit(blocks)))
    kept = _by_block(dealt, block_)
    told = None
    for level in (1, 2, 3):
        first_time, again = _ask(level, bits, length, row_)
        if told is None:
            sent = kept.groupBy(block_).applyInArrow(first_time, _SENT)
        else:
            sent = kept.groupBy(block_).cogroup(told.groupBy("block")).applyInArrow(again, _SENT)
        answers = stored(sent.groupBy("cell").applyInArrow(_tell(level), _ANSWERED), f"answers{level}")
        told = answers if told is None else told.unionByName(answers)

    def finish(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        texts, order = _texts(rows, row_)
        block = Block(texts, length)
        _learned(block, _read_answers(known), 4)
        flags = np.split(block.removed(), block.ends[:-1])
        del block
        release_memory()
        removed: list = [None] * len(texts)
        for i, f in zip(order.tolist(), flags, strict=True):
            removed[i] = f
        return out(rows.drop_columns([row_, block_]), removed)

    return kept.groupBy(block_).cogroup(told.groupBy("block")).applyInArrow(finish, schema)


def _by_block(dealt: DataFrame, block_: str) -> DataFrame:
    """The rows, written once as files bucketed by block, so that no level shuffles texts again."""
    spark = dealt.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"siftwork_blocks_{uuid.uuid4().hex}"
    writer = dealt.repartition(n, block_).write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    writer.bucketBy(n, block_).sortBy(block_).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and rows still reads them
    return rows


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""

    def out(rows: pa.Table, removed: list[np.ndarray]) -> pa.Table:
        texts = [(t or "").encode("utf-8", "replace") for t in rows.column("text").to_pylist()]
        spans = [int(f[0]) + int(np.count_nonzero(f[1:] & ~f[:-1])) if len(f) else 0 for f in removed]
        kept = [hashlib.sha256(np.frombuffer(t, np.uint8)[~f].tobytes()).hexdigest() for t, f in zip(texts, removed, strict=True)]
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array([int(f.sum()) for f in removed], pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_repeats(rows, out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated bytes cut out of text; cuts inside a character drop the whole character. Other columns stay."""

    def out(rows: pa.Table, removed: list[np.ndarray]) -> pa.Table:
        texts = []
        for t, f in zip(rows.column("text").to_pylist(), removed, strict=True):
            texts.append(t if t is None or not f.any() else np.frombuffer(t.encode("utf-8", "replace"), np.uint8)[~f].tobytes().decode("utf-8", "ignore"))
        return rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return with_repeats(docs, out, nullable(docs.schema), length)
