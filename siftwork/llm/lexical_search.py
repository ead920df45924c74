"""Ranked lexical search with block-max pruning.

A block is a range of documents as they are stored. Its row of the forward index holds the documents' terms and how often each
occurs; its row of maxima holds, for each of its terms, the documents that have it and the largest impact it
reaches in one of them. A query's bound for a block is the sum of its weights times these maxima: no document of the
block can score more.

Each query first scores the few blocks of its largest bounds, which gives a threshold, the score of its k-th document so far. Then
all blocks whose bound is not below it are scored, from the largest bound down; the threshold rises within a task, and
blocks that fall below it are passed over. Blocks that no query wants never leave the storage side of the join. Ties in score go to the
smaller id, so a block whose bound equals the threshold is still scored. Results equal a scan of all documents.

Queries come in groups of QUERIES, each held by every task; documents are never collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import fresh, release_memory, rows_by_bytes, stored
from siftwork.llm.term_runs import letters, runs, terms

#: Documents shown for a query, documents and text bytes of a block, blocks that a query scores first, and queries of a group.
TOP, BLOCK_DOCS, BLOCK_BYTES, FIRST, QUERIES = 50, 256, 8 << 20, 4, 2048
#: Blocks that a task decodes at once.
AT_ONCE = 16

_FORWARD = "block long, doc_ids array<long>, sizes array<int>, distinct array<int>, words array<binary>, word array<int>, times array<int>, filled long, total long"
_MAXIMA = "block long, words array<binary>, docs array<int>, impacts array<int>"
_FOUND = "item int, score long, doc_id long"
_WORD = letters("0123456789")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impact(times: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term that occurs so many times adds, per unit of its weight, in documents of so many terms."""
    m = 100 - 50 + _scaled(length.astype(np.int64), 50 * n, max(1, total))
    return 1_000_000_000 * times.astype(np.int64) // (1000 * times.astype(np.int64) + 20 * m)


def _scaled(a: np.ndarray, by: int, over: int) -> np.ndarray:
    """a * by div over, in Python's integers where 63 bits are too few."""
    if len(a) and int(a.max()) * by < 2**63:
        return a * by // over
    return np.array([x * by // over for x in a.tolist()], np.int64)


def _list(values: np.ndarray | pa.Array, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))


def _indexed(block_docs: int):
    """A row of the forward index for each block of so many of the task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in rows_by_bytes(batches, "text", BLOCK_BYTES):
            for at in range(0, batch.num_rows, block_docs):
                part = batch.slice(at, block_docs)
                found, doc = terms(part.column(1), _WORD)
                coded = found.dictionary_encode()
                key = doc * max(1, len(coded.dictionary)) + np.asarray(coded.indices)
                key.sort()
                first = runs(key)
                times = np.diff(np.append(first, len(key)))
                doc, word = np.divmod(key[first], max(1, len(coded.dictionary)))
                length = np.bincount(np.repeat(doc, times), minlength=part.num_rows)
                some = length > 0  # documents without terms are never found
                sizes, distinct = length[some], np.bincount(doc, minlength=part.num_rows)[some]
                ids = part.column(0).filter(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        _list(ids, [len(ids)], pa.int64()),
                        _list(sizes, [len(sizes)], pa.int32()),
                        _list(distinct, [len(distinct)], pa.int32()),
                        _list(coded.dictionary.cast(pa.binary()), [len(coded.dictionary)], pa.binary()),
                        _list(word, [len(word)], pa.int32()),
                        _list(times, [len(times)], pa.int32()),
                        pa.array([int(some.sum())], pa.int64()),
                        pa.array([int(sizes.sum())], pa.int64()),
                    ],
                    names=["block", "doc_ids", "sizes", "distinct", "words", "word", "times", "filled", "total"],
                )
                number += 1
        release_memory()

    return run


@dataclass(frozen=True)
class Index:
    """The forward index and the maxima of its blocks (tables), the documents with terms, and all their terms."""

    forward: DataFrame
    maxima: DataFrame
    n: int
    total: int


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of docs. Every row is a document of its own, also one that repeats another's id; a null text has no terms."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    forward = stored(rows.mapInArrow(_indexed(BLOCK_DOCS), _FORWARD), "forward", AT_ONCE)
    sums = forward.agg(F.sum("filled").alias("n"), F.sum("total").alias("total")).first()
    n, total = sums["n"] or 0, sums["total"] or 0

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, distinct, word, times = (_values(batch.column(k)[i]) for k in (2, 3, 5, 6))
                height = len(batch.column(4)[i].values)
                best = np.zeros(height, np.int32)
                np.maximum.at(best, word, impact(times, np.repeat(sizes, distinct), n, total).astype(np.int32))
                docs = np.bincount(word, minlength=height)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(4).slice(i, 1), _list(docs, [height], pa.int32()), _list(best, [height], pa.int32())], names=["block", "words", "docs", "impacts"])

    return Index(forward, stored(forward.mapInArrow(most, _MAXIMA), "maxima", AT_ONCE), n, total)


def _values(scalar: pa.ListScalar) -> np.ndarray:
    return np.asarray(scalar.values)


class Queries:
    """The terms of a group of queries: `words` are all of them, `of` and `starts` the ones of each query, one after another."""

    def __init__(self, found: list[list[bytes]]):
        coded = pa.array([w for q in found for w in q], pa.binary()).dictionary_encode()
        self.words, self.of = coded.dictionary, np.asarray(coded.indices, np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(q) for q in found])]).astype(np.int64)
        self.weights = np.zeros(len(self.of), np.int64)

    def weigh(self, dfs: dict[bytes, int], n: int) -> None:
        each = np.array([weight(n, dfs.get(w, 0)) if dfs.get(w, 0) else 0 for w in self.words.to_pylist()], np.int64)
        self.weights = each[self.of]

    def bounds(self, words: pa.Array, impacts: np.ndarray) -> np.ndarray:
        """Of each query for a block with these maxima."""
        at = np.asarray(pc.fill_null(pc.index_in(self.words, words), -1), np.int64)
        best = np.where(at >= 0, impacts[at], 0) if len(impacts) else np.zeros(len(at), np.int64)
        sums = np.concatenate([[0], np.cumsum(self.weights * best[self.of])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]


def _bounds(queries: Queries, most: int | None, least: np.ndarray, done: dict[int, frozenset[int]]):
    """block, item, bound: for each query its blocks of the largest bounds in the task (most), or all from its threshold on but those done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                bound = queries.bounds(batch.column(1)[i].values, _values(batch.column(3)[i]).astype(np.int64))
                item = np.flatnonzero((bound > 0) & (bound >= least))
                if block in done:
                    item = item[[x not in done[block] for x in item.tolist()]]
                held.append(np.stack([np.full(len(item), block), item, bound[item]]))
            rows = np.concatenate(held, axis=1) if held else np.zeros((3, 0), np.int64)
            held = []
            if most is None:
                yield _wanted(rows)
            else:
                held = [_leading(rows, most)]
        if held:
            yield _wanted(held[0])

    return run


def _leading(rows: np.ndarray, most: int) -> np.ndarray:
    """Of rows (block, item, bound) those of the `most` largest bounds of each item."""
    rows = rows[:, np.lexsort((rows[0], -rows[2], rows[1]))]
    first = runs(rows[1])
    rank = np.arange(rows.shape[1]) - np.repeat(first, np.diff(np.append(first, rows.shape[1])))
    return rows[:, rank < most]


def _wanted(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64())], names=["block", "item", "bound"])


def _scored(queries: Queries, least: np.ndarray, n: int, total: int, top: int):
    """item, score, doc_id: the best documents of each query among a task's blocks, which come with their largest bounds first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        threshold = least.copy()
        for batch in batches:
            for i in range(batch.num_rows):
                items, bounds = _values(batch.column(0)[i]), _values(batch.column(1)[i])
                ids = batch.column(2)[i].values
                sizes, distinct, word, times = (_values(batch.column(k)[i]) for k in (3, 4, 6, 7))
                at = np.asarray(pc.fill_null(pc.index_in(batch.column(5)[i].values, queries.words), -1), np.int64)
                asked = at[word]
                keep = np.flatnonzero(asked >= 0)  # the block's terms that some query has
                keep = keep[np.argsort(asked[keep], kind="stable")]
                doc = np.repeat(np.arange(len(sizes)), distinct)[keep]
                gain = impact(times[keep], sizes[doc], n, total)
                place = np.searchsorted(asked[keep], np.arange(len(queries.words) + 1))
                for item, bound in zip(items.tolist(), bounds.tolist(), strict=True):
                    if bound < threshold[item]:
                        continue
                    of = slice(queries.starts[item], queries.starts[item + 1])
                    low, width = place[queries.of[of]], np.diff(place)[queries.of[of]]
                    at = np.arange(width.sum()) + np.repeat(low - np.cumsum(width) + width, width)
                    adds = np.repeat(queries.weights[of], width) * gain[at]
                    if bound < 2**53:  # doubles are exact up to there, and no sum passes the bound
                        score = np.bincount(doc[at], weights=adds, minlength=len(sizes)).astype(np.int64)
                    else:
                        score = np.zeros(len(sizes), np.int64)
                        np.add.at(score, doc[at], adds)
                    some = np.flatnonzero((score > 0) & (score >= threshold[item]))
                    if not len(some):
                        continue
                    score, mine = score[some], np.asarray(pc.fill_null(ids.take(pa.array(some)), _LAST), np.int64)
                    if item in found:
                        score, mine = np.concatenate([found[item][0], score]), np.concatenate([found[item][1], mine])
                    order = np.lexsort((mine, -score))[:top]
                    found[item] = score[order], mine[order]
                    if len(order) == top:
                        threshold[item] = max(threshold[item], int(found[item][0][-1]))
        for item, (score, mine) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(score), pa.int32()), pa.array(score), pc.if_else(pc.equal(pa.array(mine), _LAST), pa.scalar(None, pa.int64()), pa.array(mine))], names=["item", "score", "doc_id"])

    return run


#: Stands for a null id while documents are ordered: the last of equal scores.
_LAST = 2**63 - 1


def _one_group(index: Index, items: DataFrame, top: int) -> DataFrame:
    """item_id, rank, doc_id, score for the queries of one group (item_id, text), which are brought to the driver."""
    asked = pa.Table.from_pylist([r.asDict() for r in items.collect()], pa.schema([("item_id", pa.int64()), ("text", pa.string())]))
    found, of = terms(asked.column("text").combine_chunks() if asked.num_rows else pa.array([], pa.string()), _WORD)
    own: list[set[bytes]] = [set() for _ in range(asked.num_rows)]
    for w, i in zip(found.to_pylist(), of.tolist(), strict=True):
        own[i].add(w)
    queries = Queries([sorted(w) for w in own])
    vocabulary, n, total, spark = queries.words, index.n, index.total, index.maxima.sparkSession

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at = np.asarray(pc.fill_null(pc.index_in(vocabulary, batch.column(0)[i].values), -1), np.int64)
                docs = _values(batch.column(1)[i])
                if len(docs):
                    sums += np.where(at >= 0, docs[at], 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums), pa.int32()), pa.array(sums[sums > 0])], names=["word", "docs"])

    # At most one number for each term of the group.
    counted = index.maxima.select("words", "docs").mapInArrow(document_counts, "word int, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    names = vocabulary.to_pylist()
    queries.weigh({names[r["word"]]: r["docs"] for r in counted}, n)
    wide = "block long, item int, bound long"
    maxima = index.maxima.select("block", "words", "docs", "impacts")
    none = np.zeros(asked.num_rows, np.int64)

    def score(wanted: DataFrame, least: np.ndarray) -> DataFrame:
        """The blocks that are wanted, each once with its queries, meet the forward index."""
        each = wanted.groupBy("block").agg(F.collect_list(F.struct("item", "bound")).alias("w")).select("block", F.col("w")["item"].alias("items"), F.col("w")["bound"].alias("bounds"), F.array_max(F.col("w")["bound"]).alias("best"))
        rows = index.forward.drop("filled", "total").join(each, "block").sortWithinPartitions(F.desc("best"))
        return stored(rows.select("items", "bounds", "doc_ids", "sizes", "distinct", "words", "word", "times").mapInArrow(_scored(queries, least, n, total, top), _FOUND), "found")

    leading = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    first = maxima.mapInArrow(_bounds(queries, FIRST, none, {}), wide)
    first = stored(first.withColumn("place", F.row_number().over(leading)).where(F.col("place") <= FIRST).drop("place"), "first_blocks")
    found = score(first, none)
    # A few numbers for each query of the group: the blocks it has scored, and the score of its last document so far.
    done: dict[int, set[int]] = {}
    for r in first.select("block", "item").collect():
        done.setdefault(r["block"], set()).add(r["item"])
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())))
    least = none.copy()
    for r in best.where(F.col("place") == top).select("item", "score").collect():
        least[r["item"]] = r["score"]
    rest = maxima.mapInArrow(_bounds(queries, None, least, {b: frozenset(i) for b, i in done.items()}), wide)
    both = found.unionByName(score(rest, least))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = both.withColumn("rank", place).where(F.col("rank") <= top)
    names_of = spark.createDataFrame(list(enumerate(asked.column("item_id").to_pylist())), "item int, item_id long")
    return ranked.join(names_of, "item").select("item_id", "rank", "doc_id", "score")


def search(index: Index, queries: DataFrame, top: int = TOP, item_id: str = "item_id", text: str = "text", at_once: int = QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each query with a score above 0, the smaller id first among equal scores.

    Null texts and queries whose terms no document has give no rows; of queries alike in id each gives its own. Null ids of
    documents come last among equal scores. An empty index or query table gives no rows.
    """
    rows = queries.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    groups = max(1, math.ceil(rows.count() / at_once))
    if groups == 1:
        return _one_group(index, rows, top)
    group = fresh("group", rows.columns)
    dealt = stored(rows.withColumn(group, F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))), "queries")
    parts = [_one_group(index, dealt.where(F.col(group) == g).drop(group), top) for g in range(groups)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
