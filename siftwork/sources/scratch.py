"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, for local sessions only."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='siftwork-')}"
        sc.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df from files: lineage ends here, every use sees the same rows in the same parts, and a lost executor costs one task."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Removes tables that written() made and nothing asks for any more, such as those of a finished round."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for place in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
