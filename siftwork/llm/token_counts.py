"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once; each token keeps its character span. Spans are joined to the document's
sections by interval, and a token that crosses a boundary is allocated by an explicit rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import rows_by_bytes

#: first: the section of the token's first character. last: of its last one. most: the one with most of its
#: characters, the earlier of equal ones. split: each in proportion to its characters.
RULES = ("first", "last", "most", "split")
#: A worker forgets its words beyond this number; it then encodes them again.
MEMO = 200_000


class Spans(dict):
    """piece of text -> character length of each of its tokens.

    A token that ends inside a character has that character; the tokens after it in the same character
    have length 0 there and stand at its end, so lengths add up to the piece's.
    """

    def __init__(self, ranks_path: str):
        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.encoding = tiktoken.Encoding("spans", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        tokens = [self.bytes[i] for i in self.encoding.encode_ordinary(piece)]
        # Characters begun by each token: bytes that do not continue one.
        found = self[piece] = tuple(sum(b & 0xC0 != 0x80 for b in t) for t in tokens)
        return found


def by_lines(text: Column) -> Column:
    """Sections of a text: each line with its line end; an empty text has none. One name per section: its number."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0)), lambda x: x != "")


def from_fields(df: DataFrame, fields: list[str], between: str = "\n") -> DataFrame:
    """Adds text, the fields joined by `between`, and parts, their texts with what follows each; null fields are empty."""
    parts = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(between if c != fields[-1] else "")) for c in fields]
    return df.withColumn("parts", F.array(*parts)).withColumn("text", F.concat(*parts))


def attribute(docs: DataFrame, ranks_path: str, rule: str = "first") -> DataFrame:
    """doc_id, section (from 0), start, end (in characters), n_tokens (double), n_crossing for each section of docs.

    docs has doc_id, text and parts, the texts of sections that follow each other and together are the text.
    n_crossing counts tokens that reach beyond the section and have a character in it. Tokens inside one
    character count where the character is. Null texts and texts without sections give no row. Repeated
    rows are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans(ranks_path)
        pieces = _pattern()
        for batch in rows_by_bytes(batches, "text", 2 << 20):
            out: list[list[np.ndarray]] = []
            for text, sizes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lengths = np.fromiter(chain.from_iterable(map(spans.__getitem__, pieces.findall(text or ""))), np.int64)
                out.append(join_spans(lengths, np.array(sizes or [], np.int64), rule))
                if len(spans) > MEMO:
                    spans.clear()
            rows = [len(o[0]) for o in out]
            doc = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), rows)))
            section = np.concatenate([np.arange(n) for n in rows]) if rows else np.zeros(0)
            columns = [np.concatenate([o[i] for o in out]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([doc, pa.array(section, pa.int32()), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True))], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.transform("parts", lambda p: F.char_length(p)).alias("sizes"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0.0).alias("n_tokens"), F.lit(0).cast("long").alias("n_crossing")).schema)


def _pattern() -> re.Pattern:
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def join_spans(lengths: np.ndarray, sizes: np.ndarray, rule: str) -> list[np.ndarray]:
    """start, end, tokens and crossing tokens of each section; lengths and sizes are in characters and add up alike."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    high = np.cumsum(lengths)
    low = high - lengths
    inside = lengths == 0  # of a character begun before: it stands where that character is
    low, high = np.where(inside, np.maximum(low - 1, 0), low), np.where(inside, np.maximum(low, 1), high)
    n = len(sizes)
    if not n or not len(low):
        return [starts, ends, np.zeros(n), np.zeros(n, np.int64)]
    # Interval join on sorted bounds: the sections of a token's first and last characters.
    first, last = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high - 1, "right")
    crossing = np.flatnonzero(first != last)
    count = np.bincount(first[first == last], minlength=n).astype(float)
    crossed = np.zeros(n, np.int64)
    for t in crossing.tolist():  # few: a token seldom reaches over a line end
        s = np.arange(first[t], last[t] + 1)
        share = np.minimum(ends[s], high[t]) - np.maximum(starts[s], low[t])
        crossed[s[share > 0]] += 1
        if rule == "split":
            count[s] += share / share.sum()
        else:
            count[s[{"first": 0, "last": -1, "most": int(np.argmax(share))}[rule]]] += 1
    return [starts, ends, count, crossed]
