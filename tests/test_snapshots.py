"""Bucketed tables: only touched buckets are written, several tables are published at once."""

import os

import pytest
from pyspark.sql import functions as F

from siftwork.operators import mutations
from siftwork.sources.snapshots import Conflict, Snapshots


@pytest.fixture
def store(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    change = s.change()
    change.create("users", spark.range(1000).select("id", (F.col("id") % 2 == 0).alias("is_active")), "id", 16)
    change.create("tokens", spark.range(500).select("id", (F.col("id") % 1000).alias("user_id"), F.lit(False).alias("is_used")), "id", 8)
    change.create("sessions", spark.range(3000).select("id", (F.col("id") % 1000).alias("user_id"), F.lit(False).alias("revoked")), "user_id", 16)
    assert s.version() == 0
    assert change.publish() == 1
    return s


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names}


def of(s, table, version=None):
    return {r["id"]: tuple(r)[1:] for r in s.read(table, version).collect()}


def reset(s, ids, users):
    change = s.change()
    change.update("users", users, lambda rows: mutations.activated(rows, users))
    change.update("tokens", ids, lambda rows: mutations.consumed(rows, ids))
    mine = users.select(F.col("id").alias("user_id"))
    change.update("sessions", mine, lambda rows: mutations.revoked_for_users(rows, mine))
    return change


def test_only_touched_buckets_are_written(spark, store):
    before, old = files(store.folder), of(store, "sessions")
    one = spark.createDataFrame([(7,)], "user_id long")
    change = store.change()
    change.update("sessions", one, lambda rows: mutations.revoked_for_users(rows, one))
    assert files(store.folder).items() >= before.items()  # nothing there is changed or removed
    new = [f for f in files(store.folder) if f not in before and f.endswith(".parquet")]
    assert len(new) == 1
    assert of(store, "sessions") == old  # not published yet
    assert change.publish() == 2
    assert {i for i, v in of(store, "sessions").items() if v != old[i]} == {7, 1007, 2007}
    a, b = store.manifest(1)["sessions"]["files"], store.manifest(2)["sessions"]["files"]
    assert sum(a[k] != b[k] for k in a) == 1 and a.keys() == b.keys()


def test_reads_of_keys_are_pruned(spark, store):
    some = spark.createDataFrame([(3,), (5,)], "id long")
    rows = store.read("users", keys=some)
    assert rows.where("id IN (3, 5)").count() == 2
    assert 0 < len(rows.inputFiles()) <= 2 < len(store.read("users").inputFiles())
    assert store.read("users", keys=some.limit(0)).count() == 0


def test_three_tables_change_at_once(spark, store):
    users, ids = spark.createDataFrame([(3,), (501,)], "id long"), spark.createDataFrame([(3,), (4,)], "id long")
    change = reset(store, ids, users)
    assert of(store, "users")[3] == (False,) and of(store, "tokens")[3] == (3, False)
    change.publish()
    assert of(store, "users")[3] == of(store, "users")[501] == (True,)
    assert {i for i, v in of(store, "tokens").items() if v[1]} == {3, 4}
    assert {i for i, v in of(store, "sessions").items() if v[1]} == {3, 1003, 2003, 501, 1501, 2501}
    assert of(store, "users", 1)[3] == (False,)  # a reader of the old version still reads it


def test_a_failure_between_the_tables_leaves_the_old_state(spark, store):
    old = [of(store, t) for t in ("users", "tokens", "sessions")]
    users = spark.createDataFrame([(3,)], "id long")
    change = store.change()
    change.update("users", users, lambda rows: mutations.activated(rows, users))
    with pytest.raises(Exception, match="boom"):
        change.update("tokens", users, lambda rows: rows.withColumn("is_used", F.raise_error(F.lit("boom")).cast("boolean")))
    assert store.version() == 1
    assert [of(store, t) for t in ("users", "tokens", "sessions")] == old


def test_of_two_changes_the_second_is_refused(spark, store):
    users = spark.createDataFrame([(3,)], "id long")
    one, two = reset(store, users, users), reset(store, users.limit(0), users)
    assert one.publish() == 2
    with pytest.raises(Conflict):
        two.publish()
    assert store.version() == 2 and of(store, "tokens")[3] == (3, True)


def test_append_and_calls_that_build_on_each_other(spark, store):
    change = store.change()
    change.append("users", spark.createDataFrame([(5000, False)], "id long, is_active boolean"))
    new = spark.createDataFrame([(5000,)], "id long")
    change.update("users", new, lambda rows: mutations.activated(rows, new))
    change.publish()
    rows = of(store, "users")
    assert len(rows) == 1001 and rows[5000] == (True,)


def test_an_empty_change(spark, store):
    change = store.change()
    change.update("users", spark.createDataFrame([], "id long"), lambda rows: rows)
    assert change.publish() == 2 and of(store, "users") == of(store, "users", 1)
