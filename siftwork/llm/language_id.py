"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. A word that is not in the table falls back
to its character n-grams, the longest order with any known n-gram first, down to single characters.
Words and n-grams meet their tables by hash, all those of a batch of texts at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import ByteHash, hash_threshold, nullable, release_memory, rows_by_bytes
from siftwork.llm.runs import as_text, code_points, distinct

WORD = re.compile(r"[^\W\d_]+")
#: Character n-gram orders, longest first. Words of more than the longest order weigh like it.
ORDERS = (4, 3, 2, 1)
#: Counts that a worker gathers before it sends them on.
MEMO = 100_000
#: Terms that are hashed together.
AT_ONCE = 1 << 14


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it part of words, and is it a letter."""
    every = [chr(i) for i in range(0x110000)]
    part, letter = np.zeros(0x110000, bool), np.fromiter(map(str.isalpha, every), bool, 0x110000)
    for m in WORD.finditer("".join(every)):
        part[m.start() : m.end()] = True
    return part, letter


def numbered(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of many texts, the number of each word in text order, and how many each text has.

    Words are in lower case. A text without a letter has none, as texts of superscripts or fractions.
    """
    units, ends = code_points([t.lower() if t else "" for t in texts])
    part, letter = (table[units] for table in _kinds())
    edges = np.flatnonzero(np.diff(part.astype(np.int8), prepend=0))  # a text never ends inside a word
    starts, stops = edges[::2], edges[1::2]
    sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
    some = np.diff(np.append(0, np.cumsum(letter))[ends + 1], prepend=0) > 0
    kept = np.repeat(some, sizes)
    starts, stops, sizes = starts[kept], stops[kept], np.where(some, sizes, 0)
    first, number = distinct(units, starts, stops)
    whole = as_text(units)
    return [whole[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)], number, sizes


def grams(word: str, order: int) -> list[str]:
    marked = f"^{word}$" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def term_hashes(terms: list[str]) -> np.ndarray:
    """A hash of each term, some at a time: the driver asks for those of a whole model."""
    out = np.zeros(len(terms), np.uint64)
    for a in range(0, len(terms), AT_ONCE):
        units, ends = code_points(terms[a : a + AT_ONCE])
        starts = np.append(0, ends[:-1] + 1)[: len(ends)]
        out[a : a + AT_ONCE] = ByteHash(units).slices(starts, ends)
    return out


@dataclass
class Table:
    """Log frequencies of terms: a row per term, in the order of their hashes, a column per language."""

    keys: np.ndarray
    logs: np.ndarray

    @staticmethod
    def of(terms: list[str], logs: np.ndarray) -> Table:
        keys = term_hashes(terms)
        order = np.argsort(keys)
        return Table(keys[order], logs[order].astype(np.float32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for those not in the table."""
        at = np.searchsorted(self.keys, keys)
        return np.where(np.append(self.keys, 0)[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)


@dataclass
class LanguageModel:
    languages: list[str]
    words: Table
    ngrams: dict[int, Table]

    def score(self, words: list[str]) -> np.ndarray:
        """A row of log scores for each word."""
        out = np.zeros((len(words), len(self.languages)))
        known = self.words.find(term_hashes(words))
        out[known >= 0] = self.words.logs[known[known >= 0]]
        left = np.flatnonzero(known < 0)
        units, ends = code_points([f"^{words[i]}$" for i in left.tolist()])
        hashed, begin = ByteHash(units), np.append(0, ends[:-1] + 1)[: len(left)]
        for order in ORDERS:
            first, last = (begin, ends) if order > 1 else (begin + 1, ends - 1)
            n = np.maximum(last - first - order + 1, 0)
            of = np.repeat(np.arange(len(left)), n)
            at = np.arange(len(of)) + np.repeat(first - np.cumsum(n) + n, n)
            row = self.ngrams[order].find(hashed.slices(at, at + order))
            of, row = of[row >= 0], row[row >= 0]
            hits = np.bincount(of, minlength=len(left))
            found = hits > 0
            weight = np.minimum(ORDERS[0], (ends - begin - 2)[found]) / order / hits[found]
            for k in range(len(self.languages)):
                out[left[found], k] = np.bincount(of, self.ngrams[order].logs[row, k], len(left))[found] * weight
            left, begin, ends = left[~found], begin[~found], ends[~found]
        return out


def fit(docs: DataFrame, max_docs: int = 5_000) -> LanguageModel | None:
    """Learns from doc_id, text and lang of docs; rows where text or lang is null, or text has no word, teach nothing.

    max_docs bounds the rows learned from: an equal share for each language, and more where others have fewer
    rows than that. Rows are chosen by a hash of doc_id and text, the one of the least hash always; rows alike
    in both are chosen together. All words and n-grams of these rows are in the tables, which go to every
    executor, so max_docs bounds them too. None if there is nothing to learn from.
    """
    given = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text", F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = given.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).orderBy("n", "lang").collect()
    chosen, left = F.lit(False), max_docs
    for i, r in enumerate(counted):
        taken = min(r["n"], max(1, left // (len(counted) - i)))
        near = hash_threshold(F.col("h"), taken / r["n"]) | (F.col("h") == r["least"])
        chosen, left = chosen | ((F.col("lang") == r["lang"]) & near), left - taken

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in rows_by_bytes(batches, "text", 2 << 20):
            words, number, sizes = numbered(batch.column(0).to_pylist())
            langs, lang = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            pairs, n = np.unique(np.repeat(lang, sizes) * len(words) + number, return_counts=True)
            for pair, k in zip(pairs.tolist(), n.tolist(), strict=True):
                counts[langs[pair // len(words)], words[pair % len(words)]] += k
            if len(counts) > MEMO:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, word, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for order in ORDERS:
                    for g in grams(word, order):
                        counts[lang, g] += k
            if len(counts) > MEMO:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    schema = "lang string, term string, n long"
    words = given.where(chosen).select("text", "lang").mapInArrow(count_words, schema).groupBy("lang", "term").agg(F.sum("n").alias("n")).persist()
    try:
        known = words.toArrow()
        ngrams = words.mapInArrow(count_ngrams, schema).groupBy("lang", "term").agg(F.sum("n").alias("n")).toArrow()
    finally:
        words.unpersist()
    langs = sorted(known.column("lang").unique().to_pylist())
    if not langs:
        return None

    def logs(rows: pa.Table) -> tuple[list[str], np.ndarray]:
        """Terms, and log frequencies smoothed by half an occurrence of each of them."""
        terms = rows.column("term").combine_chunks().dictionary_encode()
        counts = np.zeros((len(terms.dictionary), len(langs)))
        lang = pc.index_in(rows.column("lang"), pa.array(langs, rows.schema.field("lang").type)).to_numpy()
        counts[terms.indices.to_numpy(), lang] = rows.column("n").to_numpy()
        return terms.dictionary.to_pylist(), np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts)))

    size = pc.utf8_length(ngrams.column("term"))
    model = LanguageModel(langs, Table.of(*logs(known)), {order: Table.of(*logs(ngrams.filter(pc.equal(size, order)))) for order in ORDERS})
    del known, ngrams, size
    release_memory()
    return model


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "n"])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Adds lang_pred and score (the posterior under equal priors) to every row of docs, whole texts scored.

    Null texts, texts without a letter, and every text if the model is None: 'und' with score 0. Of languages
    that score alike the first by name. Repeated rows are scored alike; other columns pass through. Columns
    named lang_pred or score are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    text_at = kept.columns.index("text")
    schema = nullable(kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in rows_by_bytes(batches, "text", 2 << 20):
            n = batch.num_rows
            found, scores = np.full(n, "und", object), np.zeros(n)
            if model:
                words, number, sizes = numbered(batch.column(text_at).to_pylist())
                each, owner = model.score(words), np.repeat(np.arange(n), sizes)
                total = np.stack([np.bincount(owner, each[number, k], n) for k in range(len(model.languages))], axis=1)
                best = total.argmax(axis=1)
                posterior = 1 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700)).sum(axis=1)
                some = sizes > 0
                found[some], scores[some] = np.array(model.languages, object)[best[some]], posterior[some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.tolist(), pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(score, schema)
