"""Near-duplicate detection by BagMinHash over word shingles as multisets.

Texts are lower-cased and split at white space; their shingles of five words, with their counts, are a
weighted set, whose weights are discrete already. BagMinHash signs it: every (shingle, dyadic range of counts) has
a Poisson process whose points carry a time, a component and a count in the range. The method halves a range
again and again and follows the half that a point falls in; the halvings are the bits of the point's draw, so here one
number gives them all, and ranges beyond the shingle's count are never opened. A component's value is the
earliest time among the points at or below the count. Components agree with probability equal to the
weighted Jaccard similarity. Bands of components give candidates, the multisets' overlap decides.

Equal texts are one node. Buckets of few nodes are compared pair by pair. In larger ones every member is
compared with one pivot, the node that shares most buckets with others, such as the source of a group of
copies. Members that this leaves in other classes than the pivot's are then compared with all members of the
bucket, in tiles of bounded bytes that count shared shingles exactly; only links that join two classes leave a tile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.buckets import one_of_equal, stars, tiles
from siftwork.llm.common import ByteHash, fresh, mix, nullable, release_memory, rows_by_bytes, stored
from siftwork.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: 20 bands of 4: two texts of similarity 0.8 are missed with probability (1 - 0.8**4)**20 = 3e-5.
BANDS, ROWS = 20, 4
#: Buckets of at most so many nodes are compared pair by pair.
SMALL = 24
#: Text bytes of a block; a tile compares two blocks of a bucket.
BLOCK = 2 << 20


def canonical(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of so many words of canonical texts, and the text each belongs to.

    A shorter text with at least one word has one shingle, the whole of it.
    """
    coded = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(coded), np.uint8)
    sizes = np.array([len(c) for c in coded], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    real = ends > starts
    starts, ends = starts[real], ends[real]
    owner = np.searchsorted(first, starts, "right") - 1
    n = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(n) - n  # a text's first word
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    of = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + begin[of]
    last = np.minimum(at + words - 1, (begin + n - 1)[of])
    return ByteHash(data).slices(starts[at], ends[last]), of


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures (n, m) of the multisets of hashes; an owner without hashes has infinities."""
    ids = (owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
    ids.sort()
    new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(ids)))
    element, doc = ids[new] & np.uint64((1 << 44) - 1), (ids[new] >> np.uint64(44)).astype(np.int64)
    total = np.bincount(doc, count, minlength=n)
    # Dyadic ranges of counts: (0, 1], (1, 2], (2, 4], ... as far as the count reaches.
    ranges = 1 + np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))), 0).astype(np.int64)
    of = np.repeat(np.arange(len(element)), ranges)
    level = np.arange(len(of)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0))
    seed, doc, count = mix(element[of] * np.uint64(64) + level.astype(np.uint64)), doc[of], count[of]
    low = np.where(level == 0, 0, width)
    out = np.full(n * m, np.inf)
    horizon = np.zeros(n)
    np.divide(np.log(m) + 3, total, out=horizon, where=total > 0)
    todo = np.flatnonzero(total > 0)
    active = np.arange(len(doc))
    while len(todo):
        out.reshape(n, m)[todo] = np.inf
        time, k = np.zeros(len(active)), 0
        at, limit = active, horizon[doc[active]]
        while len(at):  # the k-th point of each process, as long as it comes before the horizon
            k += 1
            draw = mix(seed[at] + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
            time = time - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / (width[at] * m)
            before = time <= limit
            at, time, limit, draw = at[before], time[before], limit[before], mix(draw[before] + np.uint64(1))
            position = low[at] + 1 + (draw >> np.uint64(32)).astype(np.int64) % width[at]  # halvings of the range
            counts = position <= count[at]
            np.minimum.at(out, doc[at[counts]] * m + (draw[counts] % np.uint64(m)).astype(np.int64), time[counts])
        todo = todo[np.isinf(out.reshape(n, m)[todo]).any(axis=1)]
        if len(todo):
            again = np.zeros(n, bool)
            again[todo] = True
            horizon[todo] *= 2
            active = np.flatnonzero(again[doc])
    return out.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    values = np.ascontiguousarray(signature[:, : bands * ROWS]).view(np.uint64).reshape(len(signature), bands, ROWS)
    key = np.zeros(values.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(values.shape[2]):
        key = mix(key ^ values[:, :, i])
    return key.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the canonical text, null without words), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_by_bytes(batches, "text", 1 << 20):
            texts = [canonical(t) for t in batch.column(1).to_pylist()]
            signature = signatures(*shingles(texts), len(texts))
            keys = band_keys(signature)
            nodes = [hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest() if t else None for t in texts]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), bands], names=["doc_id", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose shingle multisets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_by_bytes(batches, "text_a", 1 << 20):
            both = [canonical(t) for c in ("text_a", "text_b") for t in batch.column(c).to_pylist()]
            hashes, owner = shingles(both)
            edges = np.searchsorted(owner, np.arange(len(both) + 1))
            keep = []
            for i in range(batch.num_rows):
                x, nx = np.unique(hashes[edges[i] : edges[i + 1]], return_counts=True)
                j = i + batch.num_rows
                y, ny = np.unique(hashes[edges[j] : edges[j + 1]], return_counts=True)
                _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                shared = int(np.minimum(nx[at], ny[to]).sum())
                keep.append(shared >= similarity * (nx.sum() + ny.sum() - shared) - 1e-9)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node, class_node, class_id for every row of docs (doc_id, text).

    class_id is the smallest doc_id of the class: the texts that links of at least the similarity connect,
    with all their copies. Texts equal up to case and white space are one node. Documents without words
    (null text included) are in no class but their own: node is null, class_id their doc_id. Rows with a
    null doc_id take part by their text; a class of such rows only has a null class_id. Repeated rows are copies.
    """
    signed = stored(_signed(docs), "signed")
    whole = _classed(docs, signed, similarity)
    names = whole.groupBy("class_node").agg(F.min("doc_id").alias("class_id"))
    classes = whole.select("node", "class_node").join(names, "class_node")
    return signed.select("doc_id", "node").join(classes, "node", "left").select("doc_id", "node", "class_node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def _classed(docs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """node, doc_id (its smallest), class_node for each distinct text of signed docs."""
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stored(spread.join(sizes, "bucket"), "buckets")
    rank = buckets.groupBy("node").agg(F.sum("n").alias("rank"))
    # Copies are dropped in each task before texts are shuffled, once, by their digests.
    named = _with_node(docs.select("text"), "node").where("node IS NOT NULL").select("node", "text", F.octet_length("text").alias("size")).dropDuplicates(["node"])
    texts = stored(named.join(rank.select("node"), "node", "left_semi"), "texts")

    few = buckets.where(F.col("n") <= SMALL).select("bucket", "node")
    pairs = few.select("bucket", F.col("node").alias("a")).join(few.select("bucket", F.col("node").alias("b")), "bucket").where("a < b").select("a", "b")
    large = stored(one_of_equal(buckets.where(F.col("n") > SMALL).select("bucket", "node")), "large")
    pivots, starred = stars(large, rank)
    links = stored(_verified(pairs.unionByName(starred).distinct(), texts, similarity), "links")
    if not large.isEmpty():
        links = links.unionByName(stored(_across(large, pivots, components(links), texts, similarity), "links"))
    groups = components(links)
    return nodes.select("node", "doc_id").join(groups, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("class_node"))


def _across(large: DataFrame, pivots: DataFrame, groups: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join different components within a bucket: no two linked members stay apart."""
    met = tiles(large, pivots, groups, texts.select("node", "size"), BLOCK, texts.select("node", "text"))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        found = _joining([canonical(t) for t in rows.column("text").to_pylist()], rows.column("component").to_pylist(), rows.column("block").to_numpy() == key[2].as_py(), key[1] == key[2], similarity)
        nodes = rows.column("node").to_pylist()
        release_memory()
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())})

    return met.groupBy("bucket", "x", "y").applyInArrow(compare, "a binary, b binary")


def _joining(texts: list[str], components: list[bytes], left: np.ndarray, within: bool, similarity: float) -> list[tuple[int, int]]:
    """Pairs of texts of the similarity that join two components; each of `left` against all if `within`, else against the others."""
    n = len(texts)
    hashes, owner = shingles(texts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    size = np.bincount(owner, minlength=n)
    # The k-th occurrence of a shingle is an element of its own: multisets become sets.
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])) if len(hashes) else np.zeros(0, np.int64)
    nth = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
    _, element, held = np.unique(mix(hashes ^ mix(nth.astype(np.uint64))), return_inverse=True, return_counts=True)
    common = held[element] > 1  # others are in one text only
    element, owner = element[common], owner[common]
    begin = np.searchsorted(owner, np.arange(n + 1))
    some = np.flatnonzero(begin[1:] > begin[:-1])
    label = np.unique(np.array(components, object), return_inverse=True)[1]
    inside, shared, found = np.zeros(len(held), bool), np.zeros(n, np.int64), []
    for i in np.flatnonzero(left).tolist():
        open_ = (label != label[i]) & (size >= similarity * size[i]) & (size[i] >= similarity * size)
        open_ &= np.arange(n) > i if within else ~left
        if not open_.any():
            continue
        own = element[begin[i] : begin[i + 1]]
        inside[own] = True
        shared[some] = np.add.reduceat(inside[element], begin[some], dtype=np.int64) if len(some) else 0
        inside[own] = False
        for j in np.flatnonzero(open_ & (shared >= similarity * (size[i] + size - shared) - 1e-9)).tolist():
            if label[j] != label[i]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: all without words, and of each class the first by doc_id (nulls last), then text."""
    # A text's smallest id stands for its copies, and a class's first text is a minimum, combined before it is shuffled.
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node")
    first = _classed(docs, stored(_signed(docs), "signed"), similarity).groupBy("class_node").agg(F.min(order).alias("first"))
    chosen = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.node").alias("kept_node"))
    node = fresh("__node", docs.columns)
    place = fresh("__place", docs.columns)
    named = _with_node(docs, node)
    kept = named.join(chosen, named["doc_id"].eqNullSafe(chosen["kept_id"]) & (named[node] == chosen["kept_node"]), "left_semi")
    single = kept.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", node).orderBy("text"))).where(F.col(place) == 1)
    return single.select(*docs.columns).unionByName(named.where(F.col(node).isNull()).select(*docs.columns))


def _with_node(docs: DataFrame, node: str) -> DataFrame:
    """Adds node, the digest of the canonical text, null without words."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_by_bytes(batches, "text", 2 << 20):
            texts = [canonical(t) for t in batch.column(at).to_pylist()]
            nodes = [hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest() if t else None for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], names=[*batch.schema.names, node])

    return docs.mapInArrow(run, nullable(docs.withColumn(node, F.lit(None).cast("binary")).schema))
