"""Batches that are stored whole or not at all, and tables behind JDBC."""

import pytest
from pyspark.sql import functions as F

from siftwork.operators import mutations
from siftwork.sources import tables

SCHEMA = "id long, name string"


def test_append_commits_whole_batches_only(spark, tmp_path):
    path = str(tmp_path / "names")
    tables.append(spark.createDataFrame([(1, "a", 0), (2, None, 0)], "id long, name string, extra int"), path, SCHEMA)
    half = spark.range(3, 103, numPartitions=4).withColumn("name", F.when(F.col("id") == 100, F.raise_error(F.lit("no name"))).otherwise("c"))
    with pytest.raises(Exception, match="no name"):
        tables.append(half, path, SCHEMA)
    with pytest.raises(ValueError, match="missing columns: name"):
        tables.append(spark.range(3), path, SCHEMA)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, None)]
    tables.append(spark.createDataFrame([(3, "c")], SCHEMA), path, SCHEMA)
    assert spark.read.parquet(path).count() == 3


def test_jdbc_table_has_the_schema(spark):
    url = "jdbc:derby:memory:names;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.createDataFrame([(1, "a"), (2, None)], SCHEMA).write.format("jdbc").options(url=url, dbtable="names", driver=driver).save()
    got = tables.read_jdbc(spark, url, "names", SCHEMA, driver=driver, partitionColumn="id", lowerBound="1", upperBound="2", numPartitions="2")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (2, None)]
    assert got.schema.simpleString() == "struct<id:bigint,name:string>"


def test_one_use_of_a_reset_token(spark):
    users = spark.createDataFrame([(1, False), (2, False)], "id long, is_active boolean")
    tokens = spark.createDataFrame([(7, False), (8, False)], "id long, is_used boolean")
    sessions = spark.createDataFrame([(1, 1, False), (2, 2, False)], "id long, user_id long, revoked boolean")
    asked = [(5, 7, 1, "valid", False), (3, 7, 1, "valid", True), (4, 7, 1, "valid", False), (6, 8, 2, "expired", False), (9, None, None, None, None)]
    requests = spark.createDataFrame(asked, "request_id long, token_id long, user_id long, token_state string, same_password boolean")
    decided, after, used, revoked = mutations.reset_passwords(requests, users, tokens, sessions)
    assert {r["request_id"]: r["outcome"] for r in decided.collect()} == {3: "same_password", 4: "reset", 5: "invalid_token", 6: "invalid_token", 9: "invalid_token"}
    assert [sorted(map(tuple, df.collect())) for df in (after, used, revoked)] == [[(1, True), (2, False)], [(7, True), (8, False)], [(1, 1, True), (2, 2, False)]]
