"""Streams against the batch rules, with a restart in between."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwork.operators import rules, timeline
from siftwork.streaming import gates

START = datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REQUESTS = "user_id long, request_id long, at timestamp"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path):
    stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
    done = gates.cooldown_stream(stream, 10, "30 minutes")
    query = done.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def test_cooldown_equals_the_batch_over_a_restart(rocks, tmp_path):
    """Four files of requests, out of order by up to 25 minutes, in two runs; a late sentinel lets all others out."""
    rng = random.Random(1)
    rows = [(rng.randrange(4), i, START + timedelta(minutes=i + rng.uniform(-12, 12))) for i in range(120)]
    sentinel = [(99, 10_000, START + timedelta(days=2))]
    parts = [rows[:40], rows[40:80], rows[80:], sentinel]
    for k, run_parts in enumerate((parts[:2], parts[2:])):
        for j, part in enumerate(run_parts):
            rocks.createDataFrame(part, REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(rocks, tmp_path)
    batch = rocks.createDataFrame(rows, REQUESTS).withColumn("at", F.col("at").cast("timestamp_ntz"))
    want = {r["request_id"]: (r["limited"], r["last_issue"]) for r in timeline.cooled(batch, ["user_id"], "at", "request_id", 10).collect()}
    got = {r["request_id"]: (r["limited"], r["last_issue"]) for r in rocks.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and 0 < sum(x for x, _ in want.values()) < len(want)


def test_gates_at_each_requests_own_time(spark, tmp_path):
    sessions = spark.createDataFrame([("s", 1, START, "login", START + timedelta(minutes=10), False), ("t", 2, START, "login", START + timedelta(minutes=10), True)], "id string, user_id long, created_at timestamp_ntz, kind string, expires_at timestamp_ntz, revoked boolean")
    users = spark.createDataFrame([(1, True), (2, True)], "id long, is_active boolean")
    asked = [("s", START + timedelta(minutes=m)) for m in (0, 9, 10, 11)] + [("t", START), ("x", START), (None, START)]
    schema = "session_id string, at timestamp_ntz"
    spark.createDataFrame(asked, schema).write.parquet(str(tmp_path / "in"))
    stream = gates.gate_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), sessions, users)
    query = stream.writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    got = sorted((r["session_id"] or "", r["at"], r["gate"]) for r in spark.table("gated").collect())
    want = []
    for sid, at in asked:
        one = rules.session_gates(spark.createDataFrame([(sid,)], "session_id string"), sessions, users, F.lit(at).cast("timestamp_ntz")).collect()[0]
        want.append((sid or "", at, one["gate"]))
    assert got == sorted(want) and {g for _, _, g in got} == {"active", "unauthenticated"}
