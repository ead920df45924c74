"""BPE encoding and decoding with a compiled lexicon of frequent words.

One job counts the words of all texts. The most frequent ones and their ids become a minimal acyclic
transducer, whose file Spark hands to every executor, where it is memory-mapped. A second pass encodes:
words of the lexicon walk the automaton, all others are merged exactly.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import most_frequent, put_shared, rows_by_bytes
from siftwork.llm.runs import gathered
from siftwork.llm.transducer import Transducer, compile_words
from siftwork.llm.word_bpe import WordBpe, word_bpe

#: Words that a worker counts before it sends them on.
MEMO = 150_000


class Encoder(dict):
    """word -> its ids as little-endian 32-bit numbers; unseen words are looked up or merged once."""

    #: So many words are remembered; others are looked up or merged in each batch that has them.
    most = 150_000

    def __init__(self, bpe: WordBpe, lexicon: Transducer | None = None):
        super().__init__()
        self.bpe, self.lexicon = bpe, lexicon
        self.numbers = {i: str(i) for i in bpe.token}

    def of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, those of the lexicon by the automaton, others by merging."""
        coded = [self.get(w) for w in words]
        new = [i for i, ids in enumerate(coded) if ids is None]
        if self.lexicon is not None:
            for i, ids in zip(new, self.lexicon.find([words[i] for i in new]), strict=True):
                coded[i] = ids
            new = [i for i in new if coded[i] is None]
        for i, ids in zip(new, self.bpe.merge([words[i] for i in new]), strict=True):
            coded[i] = ids
        if len(self) < self.most:
            self.update(zip(words, coded, strict=True))
        return coded

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has; a null text has none."""
        words, number, sizes = self.bpe.numbered(texts)
        coded = self.of(words)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), np.uint32)
        ids = gathered(flat, (np.cumsum(size) - size)[number], size[number])
        ends = np.append(0, np.cumsum(size[number]))[np.append(0, np.cumsum(sizes))]
        return ids, np.diff(ends)

    def spell(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """Of each text: the number of ids, ids as text and tokens as text, both joined by one space."""
        ids, sizes = self.encode(texts)
        ends, places, out = np.append(0, np.cumsum(sizes)).tolist(), ids.tolist(), ([], [], [])
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            out[0].append(b - a)
            out[1].append(" ".join(map(self.numbers.__getitem__, places[a:b])))
            out[2].append(" ".join(map(self.bpe.token.__getitem__, places[a:b])))
        return out


def encoder(tokenizer: str, lexicon: str | None = None) -> Encoder:
    """One for a task: what it remembers is let go with the task."""
    return Encoder(word_bpe(tokenizer), Transducer(SparkFiles.get(lexicon)) if lexicon else None)


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """word, n over all texts of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counts = word_bpe(tokenizer), Counter()
        for batch in rows_by_bytes(batches, "text"):
            words, number, _ = bpe.numbered(batch.column(0).to_pylist())
            for word, n in zip(words, np.bincount(number, minlength=len(words)).tolist(), strict=True):
                counts[word] += n
            if len(counts) > MEMO:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def compile_lexicon(docs: DataFrame, tokenizer: str, max_words: int = 50_000) -> str:
    """Compiles the most frequent words of docs and gives Spark the file; returns its name for SparkFiles.

    max_words bounds what the driver gathers and the size of the file. It never changes a result, since
    words outside the lexicon are merged. Words seen once are never in it.
    """
    counts = word_counts(docs, tokenizer).where("n > 1").persist()
    try:
        top = most_frequent(counts, max_words).collect()
    finally:
        counts.unpersist()
    words = [r["word"] for r in top]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    data = compile_words(dict(zip(words, word_bpe(tokenizer).merge(words), strict=True)))
    docs.sparkSession.sparkContext.addFile(put_shared(docs.sparkSession, name, data))
    return name


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None = None) -> DataFrame:
    """Adds ids (array of int) to every row of docs; a null text counts as empty and has no ids.

    Special strings inside a text become their special ids, as the tokenizers library has them.
    """
    kept = docs.drop("ids")
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = encoder(tokenizer, lexicon)
        for batch in rows_by_bytes(batches, "text", 2 << 20):
            flat, sizes = words_of.encode(batch.column(at).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return kept.mapInArrow(run, kept.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Adds decoded: the tokens of ids joined by one space, special tokens kept; null ids give null."""
    kept = rows.drop("decoded")
    at = kept.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = word_bpe(tokenizer).token
        for batch in batches:
            texts = [None if ids is None else " ".join(map(token.__getitem__, ids)) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit(None).cast("string")).schema)


def digests(docs: DataFrame, tokenizer: str, lexicon: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 (ids as text, joined by one space) and decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = encoder(tokenizer, lexicon)
        for batch in rows_by_bytes(batches, "text", 2 << 20):
            n, *spelt = words_of.spell(batch.column(1).to_pylist())
            ids, decoded = ([hashlib.sha256(t.encode()).hexdigest() for t in texts] for texts in spelt)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
