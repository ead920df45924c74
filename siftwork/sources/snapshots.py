"""Tables in buckets of a key, changed a few buckets at a time, several tables at once.

A folder holds the files of its tables' buckets and, for each version, one small file that names them. A change writes new files
for the buckets its keys fall into, reads no others, and touches no file that is there. Nothing of it is seen until the file of the next
version appears, by one rename that fails if another change took that version: readers see all of a change or none, and
the tables of one version belong together. Old files stay for readers that began before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another change was published first; read again and repeat."""


class Snapshots:
    """The tables of a folder. Versions count from 0, the empty one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest one."""
        home = self._path(f"{self.folder}/versions")
        if not self._files.exists(home):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(home)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, version: int) -> dict:
        """By table: key, number of buckets, schema, and the folders of each bucket."""
        if version == 0:
            return {}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/versions/{version}.json", wholetext=True).collect()))

    def read(self, table: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """A table of the newest or given version; given keys (a column of the table's key), only the buckets they fall into."""
        about = self.manifest(self.version() if version is None else version)[table]
        wanted = None if keys is None else touched(keys, about["key"], about["buckets"])
        return self._rows(about, wanted)

    def _rows(self, about: dict, buckets: Iterable[int] | None) -> DataFrame:
        chosen = about["files"] if buckets is None else {str(b): about["files"].get(str(b), []) for b in buckets}
        paths = sorted(p for files in chosen.values() for p in files)
        schema = StructType.fromJson(about["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def change(self) -> Change:
        return Change(self)


def touched(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of keys, as many numbers as there are buckets at most."""
    return sorted(r[0] for r in keys.select(_bucket(key, buckets).alias("b")).distinct().collect())


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class Change:
    """What is to become the next version. Several calls for one table build on each other."""

    def __init__(self, tables: Snapshots):
        self.tables, self.base = tables, tables.version()
        self.next = tables.manifest(self.base)

    def create(self, table: str, rows: DataFrame, key: str, buckets: int) -> None:
        self.next[table] = {"key": key, "buckets": buckets, "schema": json.loads(rows.schema.json()), "files": {}}
        self._write(table, rows, None)

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows as further files of their buckets."""
        self._write(table, rows, None, keep=True)

    def update(self, table: str, keys: DataFrame, new_state: Callable[[DataFrame], DataFrame]) -> None:
        """Puts new_state(rows) in place of the rows of the buckets that keys fall into; new_state must not move rows to other keys."""
        about = self.next[table]
        buckets = touched(keys, about["key"], about["buckets"])
        if buckets:
            self._write(table, new_state(self.tables._rows(about, buckets)), buckets)

    def _write(self, table: str, rows: DataFrame, replaced: list[int] | None, keep: bool = False) -> None:
        about = self.next[table]
        columns = StructType.fromJson(about["schema"]).names
        place = f"data/{table}-{uuid.uuid4().hex}"
        # All rows of a bucket are dealt to one task, so that a bucket is one file.
        dealt = rows.select(*columns, _bucket(about["key"], about["buckets"]).alias(BUCKET)).repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.tables.folder}/{place}")
        home = self.tables._path(f"{self.tables.folder}/{place}")
        found = [s.getPath().getName() for s in self.tables._files.listStatus(home) if s.isDirectory()]
        new = {n.split("=")[1]: f"{place}/{n}" for n in found if n.startswith(BUCKET)}
        files = dict(about["files"])
        for b in replaced or []:
            files.pop(str(b), None)
        for b, path in new.items():
            files[b] = [*files.get(b, []), path] if keep or replaced is None else [path]
        self.next[table] = about | {"files": files}

    def publish(self) -> int:
        """Makes the next version visible and returns its number; raises Conflict if there is another one by now."""
        t, number = self.tables, self.base + 1
        draft = t._path(f"{t.folder}/versions/.{number}-{uuid.uuid4().hex}")
        out = t._files.create(draft)
        out.write(bytearray(json.dumps(self.next), "utf-8"))
        out.close()
        jvm, gateway = t.spark._jvm, t.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(t._files.getUri(), t.spark._jsc.hadoopConfiguration())
        how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, t._path(f"{t.folder}/versions/{number}.json"), how)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {number} was published meanwhile") from None
            raise
        return number
