"""What several operators share: the held-out rule, the shared folder, Arrow batches and byte hashing."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text is divisible by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def nullable(schema: StructType) -> StructType:
    """The schema with nulls allowed throughout, as Arrow tables from tasks have it."""
    text = schema.json()
    for what in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{what}":false', f'"{what}":true')
    return StructType.fromJson(json.loads(text))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is configured and all run on this machine."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='siftwork-')}"
        sc.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here and a lost executor costs one task.

    For rows that are large, group_rows is the most of them that a row group holds, and with it what a task decodes at once:
    the reader decodes up to 4,096 rows of a group together, whatever their size.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if group_rows:
        out = out.option("parquet.block.row.count.limit", group_rows)
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes one file to the shared folder through Spark's own file system classes; returns its address."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    return path.toString()


def hash_threshold(hashed: Column, share: float) -> Column:
    """True for about that share of 64-bit hashes, the least ones; for all of them from a share of 1 on."""
    return hashed <= F.lit(min(2**63 - 1, int((min(1.0, share) * 2 - 1) * 2**63)))


def hash_below(col: Column, share: float) -> Column:
    """A repeatable choice of about that share of the values of col."""
    return hash_threshold(F.xxhash64(col), share)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (n, ...) with the largest n, at most so many: whole classes of like n, as long as they fit.

    Only the sizes of the classes, a few hundred, come to the driver. If already the first one is too
    large, its rows are taken by n and then by their other columns.
    """
    level = F.floor(F.log2("n") * 8)
    taken, least = 0, None
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if taken + row["n"] > most:
            break
        taken, least = taken + row["n"], row["level"]
    if least is None:
        return counts.orderBy(F.desc("n"), *[c for c in counts.columns if c != "n" and counts.schema[c].dataType.typeName() != "map"]).limit(most)
    return counts.where(level >= least)


def release_memory() -> None:
    """Gives freed memory back to the system, so that a Python worker does not hold what earlier tasks used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def rows_by_bytes(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many text bytes (or one row), which bounds a task's memory."""
    release_memory()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
    release_memory()


#: Odd multipliers of two polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for at least n + 1 places."""
    return _power_table(1 << max(12, int(n).bit_length()), base)


@lru_cache(6)
def _power_table(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


class ByteHash:
    """Hashes of any slices of one byte buffer after one pass over it; equal bytes give equal hashes in any buffer."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        self.up, self.down = _powers(len(data), base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, k: int) -> np.ndarray:
        """Of each k bytes, by start."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])
