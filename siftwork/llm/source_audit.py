"""How far the sources of a language differ in the words they use.

Terms are counted by sorting, not by hashing. A task sorts the terms of its texts by (lang, term, source, document); a scan over
the runs gives each (lang, term, source) its occurrences and documents there. These partial counts are dealt by (lang,
term) and sorted again by source, and one more scan adds up runs: it knows a term's documents in the language before it lets the
term's rows go on, so rare terms end there. Shares need the totals of each source; then chunks of terms meet the sources of their
language, and each run of a term adds to partial sums of its pairs of sources and offers itself as a term of a source.

A term that every document holds gives one row for each task and source, not one for each document. Pairs of sources are the
result itself; languages of many sources are split into tiles of two blocks of sources.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import release_memory, rows_by_bytes, stored
from siftwork.llm.term_runs import letters, runs, terms

#: Documents of a language that must hold a term; what each count is raised by; what shares are multiples of; terms a source is shown with.
LEAST_DOCS, PRIOR, UNIT, SHOWN = 30, 5, 1_000_000_000, 50
#: Bytes of text whose runs a task holds at once, rows of a chunk of terms, sources of a block, and cells of a dense part.
HELD, CHUNK, SOURCES, CELLS = 16 << 20, 200_000, 256, 2 << 20

_COUNTS = "lang string, term binary, source string, docs long, n long"
_KEPT = "lang string, term string, source string, n long, of_lang long, first int"


def _partial(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Runs of (lang, term, source) over the held rows, from runs of (lang, term, source, document)."""
    rows = pa.Table.from_batches(held).combine_chunks()
    found, doc = terms(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), letters())
    words = found.dictionary_encode()
    names = words.dictionary.cast(pa.binary())
    place = np.empty(len(names), np.int64)
    place[np.asarray(pc.sort_indices(names))] = np.arange(len(names))
    groups = pa.table({"lang": rows.column("lang"), "source": rows.column("source"), "doc": pa.array(np.arange(rows.num_rows))})
    groups = groups.sort_by([("lang", "ascending"), ("source", "ascending")])
    lang, source = groups.column("lang").combine_chunks(), groups.column("source").combine_chunks()
    new_lang = np.concatenate([[True], np.asarray(pc.not_equal(lang[1:], lang[:-1]))])
    new = new_lang | np.concatenate([[True], np.asarray(pc.not_equal(source[1:], source[:-1]))])
    # Documents are numbered by (lang, source), so that one number stands for (source, document) within a language.
    number = np.empty(rows.num_rows, np.int64)
    number[np.asarray(groups.column("doc"))] = np.arange(rows.num_rows)
    group_of, lang_of = np.cumsum(new) - 1, np.cumsum(new_lang) - 1
    doc = number[doc]
    key = (lang_of[doc] * max(1, len(names)) + place[np.asarray(words.indices)]) * max(1, rows.num_rows) + doc
    key.sort()
    at = runs(key)  # of (lang, term, source, document)
    times = np.diff(np.append(at, len(key)))
    word, doc = key[at] // max(1, rows.num_rows), key[at] % max(1, rows.num_rows)
    first = runs(word, group_of[doc])  # of (lang, term, source)
    n = np.add.reduceat(times, first) if len(first) else times
    shown = np.empty(len(names), np.int64)
    shown[place] = np.arange(len(names))
    return pa.RecordBatch.from_arrays(
        [lang.take(pa.array(doc[first])), names.take(pa.array(shown[word[first] % max(1, len(names))])), source.take(pa.array(doc[first])), pa.array(np.diff(np.append(first, len(at)))), pa.array(n)],
        names=["lang", "term", "source", "docs", "n"],
    )


def _count(most: int):
    """Partial runs of a task's rows, of about so many bytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows_by_bytes(batches, "text", most):
            if size and size + batch.nbytes > most:
                yield from _slices(_partial(held))
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from _slices(_partial(held))
        held.clear()
        release_memory()

    return run


def _slices(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _differs(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.not_equal(column[1:], column[:-1]))


def _keep(least: int):
    """A scan over rows sorted by (lang, term, source): each run becomes one row, if its term has documents enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lang, term = batch.column(0), batch.column(1)
            new = _differs(lang) | _differs(term)
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            if last == 0 and not (rest and (rest[-1].column(0)[0] != lang[0] or rest[-1].column(1)[0] != term[0])):
                rest = [_merged([*rest, batch])]  # one term goes on: its runs are added up as they come
                continue
            yield from settled([*rest, batch.slice(0, last)] if last else rest)
            rest = [batch.slice(last)]
        yield from settled(rest)

    def settled(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(p.num_rows for p in parts):
            return
        rows = _merged(parts)
        first = runs_of(rows, 2)
        width = np.diff(np.append(first, rows.num_rows))
        docs, n = (np.add.reduceat(np.asarray(rows.column(i)), first) for i in (3, 4))
        keep = np.repeat(docs >= least, width)
        head = np.zeros(rows.num_rows, np.int32)
        head[first] = 1
        out = pa.RecordBatch.from_arrays([rows.column(0), rows.column(1).cast(pa.string()), rows.column(2), rows.column(4), pa.array(np.repeat(n, width)), pa.array(head)], names=["lang", "term", "source", "n", "of_lang", "first"])
        yield from _slices(out.filter(pa.array(keep)))

    return run


def runs_of(rows: pa.RecordBatch, keys: int) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for i in range(keys):
        new[1:] |= _differs(rows.column(i))
    return np.flatnonzero(new)


def _merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Sorted rows with the counts of equal (lang, term, source) added up."""
    rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    first = runs_of(rows, 3)
    sums = [pa.array(np.add.reduceat(np.asarray(rows.column(i)), first)) for i in (3, 4)]
    at = pa.array(first)
    return pa.RecordBatch.from_arrays([*[rows.column(i).take(at) for i in range(3)], *sums], names=rows.schema.names)


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + UNIT * (count + PRIOR) div (total + PRIOR * kept), exact: three steps of long division, as the product may pass 63 bits."""
    whole = total + PRIOR * kept
    quotient, rest = np.divmod(count + PRIOR, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + digit
    return 1 + quotient


def _compare(key: tuple, rows: pa.Table, groups: pa.Table, cells: int) -> pa.Table:
    """Partial sums of the pairs of sources of a tile over a chunk of terms, and the best terms of each source there.

    Sums are of what a term's distance is over that of two sources without it; the latter, times all terms, is added once.
    """
    chunk, x, y = (k.as_py() for k in key[1:])
    groups = groups.sort_by("source")
    sources, block = groups.column("source").combine_chunks(), np.asarray(groups.column("block"))
    total = np.asarray(groups.column("total"), np.int64)
    kept, of_lang = groups.column("kept")[0].as_py(), groups.column("lang_total")[0].as_py()
    count = len(sources)
    none = share(np.zeros(count, np.int64), total, kept) if kept else np.zeros(count, np.int64)
    base = np.abs(none[:, None] - none[None, :])
    sums = base * kept if chunk == 0 else np.zeros_like(base)
    best: list[pa.Table] = []
    rows = rows.sort_by([("term", "ascending"), ("source", "ascending")]).combine_chunks()
    if rows.num_rows:
        of = np.asarray(pc.index_in(rows.column("source"), sources), np.int64)
        n, whole = np.asarray(rows.column("n"), np.int64), np.asarray(rows.column("of_lang"), np.int64)
        p = share(n, total[of], kept)
        new = np.concatenate([[True], _differs(rows.column("term").combine_chunks())])
        run = np.cumsum(new) - 1
        step = max(1, cells // count)
        bounds = np.searchsorted(run, np.arange(0, run[-1] + 1 + step, step))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            part = np.tile(none, (run[b - 1] - run[a] + 1, 1))
            part[run[a:b] - run[a], of[a:b]] = p[a:b]
            for i in range(count):
                sums[i] += np.abs(part - part[:, i : i + 1]).sum(axis=0) - base[i] * len(part)
        if x == y:
            over = p - share(whole, np.int64(of_lang), kept)
            at = np.flatnonzero((n > 0) & (over > 0))
            at = at[np.lexsort((at, -over[at], of[at]))]  # rows are in order of terms
            first = runs(of[at])
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            at = at[rank < SHOWN]
            best.append(pa.table({"source": sources.take(pa.array(of[at])), "part": pa.array(["term"] * len(at), pa.string()), "item": rows.column("term").take(pa.array(at)), "value": pa.array(over[at])}))
    i, j = np.nonzero((np.arange(count)[:, None] < np.arange(count)[None, :]) & ((x == y) | (block[:, None] != block[None, :])))
    pairs = pa.table({"source": sources.take(pa.array(i)), "part": pa.array(["pair"] * len(i), pa.string()), "item": sources.take(pa.array(j)), "value": pa.array(sums[i, j])})
    out = pa.concat_tables([t.cast(pairs.schema) for t in (pairs, *best)])
    return out.add_column(0, "lang", pa.array([key[0].as_py()] * out.num_rows, pa.string()))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: distances between the sources of a language, and the terms that mark a source.

    Each row of docs (text, lang, source; nulls are empty) is a document of its own, also one that repeats another's id or text; other
    columns do no harm. A term is kept in the languages where so many documents hold it. A language without kept terms has
    pairs of distance 0; one of a single source has no pairs. No documents, no rows. A text is held whole by its task.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    partial = rows.mapInArrow(_count(HELD), _COUNTS)
    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = stored(dealt.mapInArrow(_keep(least_docs), _KEPT), "kept_terms")
    # Groups: every source of every language, with the totals of both and the number of kept terms.
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").cast("long").alias("kept"))
    groups = rows.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "kept"])
    width = F.greatest(F.lit(1), F.ceil(F.count("*") / SOURCES)).cast("int")
    groups = stored(groups.join(groups.groupBy("lang").agg(width.alias("blocks")), "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")), "groups")
    chunks = max(1, math.ceil(kept.count() / CHUNK))

    def tiled(df: DataFrame) -> DataFrame:
        """Once for each tile of two blocks that holds the row's."""
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        return df.withColumn("other", other).withColumn("x", F.greatest("block", "other")).withColumn("y", F.least("block", "other")).drop("other", "blocks")

    everywhere = tiled(groups).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    placed = tiled(kept.drop("first").join(groups.select("lang", "source", "block", "blocks"), ["lang", "source"])).drop("block")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int"))
    keys, cells = ["lang", "chunk", "x", "y"], CELLS

    def compare(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
        return _compare(key, rows, groups, cells)

    met = placed.groupBy(*keys).cogroup(everywhere.groupBy(*keys)).applyInArrow(compare, "lang string, source string, part string, item string, value long")
    met = stored(met, "compared")
    pairs = met.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [pairs.withColumn("rank", place), met.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= SHOWN)]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")
