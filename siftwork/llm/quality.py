"""A quality classifier learned from trusted positives and unlabelled texts.

A small network over text statistics minimises the non-negative unbiased risk of positive-unlabelled
learning: pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)). The class prior pi is estimated from
the same two samples: no share of scores above a threshold can be smaller among the unlabelled than pi times
that among the positives, so the least ratio over thresholds is taken, on rows that a first fit has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import hash_threshold, nullable, release_memory, rows_by_bytes

WORDS = re.compile(r"\S+")
#: Features: shares of each byte value, then the measures of measures().
N_FEATURES = 256 + 20


def measures(text: str, data: np.ndarray) -> list[float]:
    """Statistics of one non-empty text beyond its bytes; all are shares, logs or bounded ratios."""
    words = text.split()
    lines = text.split("\n")
    n, k = max(1, len(text)), max(1, len(words))
    distinct = len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds = _KIND[data]
    share = np.bincount(kinds, minlength=6) / max(1, len(data))
    letters = max(1e-3, share[1] + share[2] + share[5])
    after_letter = np.count_nonzero((kinds[1:] == 4) & (kinds[:-1] != 0)) if len(kinds) > 1 else 0
    signs_in_row = np.count_nonzero((kinds[1:] == 4) & (kinds[:-1] == 4)) if len(kinds) > 1 else 0
    same = np.count_nonzero(data[1:] == data[:-1]) if len(data) > 1 else 0
    return [
        np.log1p(k) / 10,
        np.log1p(len(lines)) / 5,
        lengths.mean() / 10,
        lengths.std() / 10,
        min(5.0, lengths.max() / 40),
        share[1] / letters,
        share[3] * 5,
        share[4] * 5,
        after_letter / k,
        signs_in_row / k,
        same / n * 5,
        distinct / k,
        distinct / k**0.7 / 3,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 5,
        sum(w[-1] in ".!?" for w in words) / k,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        text.count("|") / k,
        text.count("!") / k,
        float(k < 30),
    ]


#: Kinds of a byte: 0 space, 1 upper case, 2 lower case, 3 digit, 4 other ASCII, 5 beyond ASCII.
_KIND = np.full(256, 4, np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5


def features(texts: list[str | None]) -> np.ndarray:
    """A row of N_FEATURES for each text, over its whole length; null and empty texts give zeros."""
    out = np.zeros((len(texts), N_FEATURES))
    for row, text in zip(out, texts, strict=True):
        if text:
            data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            row[:256] = np.sqrt(np.bincount(data, minlength=256) / len(data))
            row[256:] = measures(text, data)
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        inner = np.tanh((x - self.mean) / self.scale @ self.hidden + self.hidden_bias)
        return 1 / (1 + np.exp(-np.clip(inner @ self.weights + self.bias, -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, units: int = 16, decay: float = 2e-4, seed: int = 7) -> QualityModel:
    """Minimises the non-negative unbiased risk with the logistic loss by Adam on whole batches.

    Where the estimated risk of negatives falls below zero, the step ascends it instead, as the method asks.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    del both
    p, u = positive - mean, unlabelled - mean
    p /= scale
    u /= scale
    params = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], units)), np.zeros(units), rng.normal(0, 0.3, units), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]

    def gradient(x: np.ndarray, slope) -> tuple[float, list[np.ndarray]]:
        inner = np.tanh(x @ params[0] + params[1])
        z = inner @ params[2] + params[3][0]
        loss, d = slope(z)
        d = d / len(x)
        back = np.outer(d, params[2]) * (1 - inner**2)
        return float(loss.mean()), [x.T @ back, back.sum(axis=0), inner.T @ d, np.array([d.sum()])]

    as_positive = lambda z: (np.logaddexp(0, -z), -1 / (1 + np.exp(np.clip(z, -30, 30))))
    as_negative = lambda z: (np.logaddexp(0, z), 1 / (1 + np.exp(np.clip(-z, -30, 30))))
    for step in range(1, steps + 1):
        _, pos = gradient(p, as_positive)
        pos_loss, pos_neg = gradient(p, as_negative)
        all_loss, unl = gradient(u, as_negative)
        rest = [a - prior * b for a, b in zip(unl, pos_neg, strict=True)]
        if all_loss - prior * pos_loss < 0:
            total = [-r for r in rest]
        else:
            total = [prior * a + r for a, r in zip(pos, rest, strict=True)]
        for i, g in enumerate(total):
            g = g + decay * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            params[i] = params[i] - 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, by the least ratio of shares above a threshold, with its sampling error added."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    model = fit_pu(positive[::2], unlabelled[::2], 0.5, steps=200)
    p, u = np.sort(model.scores(positive[1::2])), np.sort(model.scores(unlabelled[1::2]))
    at = np.unique(np.concatenate([p, u]))
    of_p, of_u = (1 - np.searchsorted(x, at, "left") / len(x) for x in (p, u))
    error = np.sqrt(np.log(20) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)
    some = of_p > error
    best = np.argmin((of_u[some] + error) / of_p[some]) if some.any() else 0
    return float(np.clip((of_u[some] / of_p[some])[best], 0.02, 0.98)) if some.any() else 0.5


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000) -> QualityModel | None:
    """Learns from docs (doc_id, text) and labels (doc_id, quality): quality 1 are the trusted positives.

    At most max_rows positives and max_rows unlabelled texts are used, those of the least hashes of doc_id and text;
    labelled texts without their labels are part of the unlabelled ones. Labels other than 1 teach nothing, nor do
    null labels and null texts. Several labels of one document count as their largest. None if there are no positives.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_by_bytes(batches, "text", 2 << 20):
            rows = features(batch.column(1).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["h", "x"])

    def gathered(df: DataFrame, salt: int) -> np.ndarray:
        # Twice the share, so that the rows of least hashes are nearly always among them; the features of others are not computed.
        share = F.xxhash64(F.lit(salt), "doc_id", "text").alias("h")
        near = df.select(share, "text").where(hash_threshold(F.col("h"), 2 * max_rows / max(1, df.count())))
        rows = near.mapInArrow(vectors, "h long, x binary").orderBy("h").limit(max_rows).collect()
        return np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows], float).reshape(-1, N_FEATURES)

    positive, unlabelled = gathered(texts.join(good, "doc_id", "left_semi"), 1), gathered(texts, 2)
    if not len(positive) or not len(unlabelled):
        return None
    model = fit_pu(positive, unlabelled, class_prior(positive, unlabelled))
    del positive, unlabelled
    release_memory()
    return model


def score(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold) to every row of docs, whole texts scored.

    Null and empty texts are scored as a text of no features; without a model every score is 0.5.
    Columns named score or predicted are replaced, others pass through.
    """
    kept = docs.drop("score", "predicted")
    at = kept.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in rows_by_bytes(batches, "text", 2 << 20):
            texts = batch.column(at).to_pylist()
            scores = model.scores(features(texts)) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, nullable(kept.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema))
