"""Registrations of a batch against a loop over them, and the numbering of new users."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import clock
from siftwork.operators import mutations, registration
from siftwork.plans import registry

NOW = "2024-01-01 00:00:00"


def one_by_one(requests, users):
    """outcome by request_id, straight from the route: look both up, then add."""
    emails, names, out = {e for e, _ in users}, {n for _, n in users}, {}
    for i, email, name, valid in sorted(requests):
        taken = (valid and email in emails, valid and name in names)
        good = valid and email is not None and name is not None and not any(taken)
        out[i] = (good, *taken)
        if good:
            emails.add(email)
            names.add(name)
    return out


def run(spark, requests, users, first=100):
    r = spark.createDataFrame([(i, e, n, v, "h") for i, e, n, v in requests], "request_id long, email string, username string, valid boolean, password_hash string")
    u = spark.createDataFrame(users, "email string, username string")
    return registration.register(r, u, first, clock.at(NOW))


@pytest.mark.parametrize("seed", range(4))
def test_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    width = [4, 12, 40, 150][seed]
    requests = [(i, f"e{rng.randrange(width)}", f"n{rng.randrange(width)}", rng.random() < 0.9) for i in rng.sample(range(1000), 150)]
    requests += [(2000, None, "n0", True), (2001, "e0", None, True)]
    users = [(f"e{rng.randrange(width)}", f"n{rng.randrange(width)}") for _ in range(3)]
    outcome, new = run(spark, requests, users)
    want = one_by_one(requests, users)
    assert {r["request_id"]: (r["accepted"], r["email_taken"], r["username_taken"]) for r in outcome.collect()} == want
    rows = sorted(new.collect(), key=lambda r: r["request_id"])
    assert [r["request_id"] for r in rows] == sorted(i for i, w in want.items() if w[0])
    assert [r["id"] for r in rows] == list(range(100, 100 + len(rows)))


def test_a_failed_request_takes_nothing(spark):
    """3 fails on its address, so its name is free for 4."""
    requests = [(1, "a@x", "n", True), (2, "a@x", "m", True), (3, "b@x", "n", True), (4, "b@x", "k", True), (5, "c@x", "m", True)]
    outcome, _ = run(spark, requests, [])
    assert {r["request_id"] for r in outcome.where("accepted").collect()} == {1, 4, 5}


def test_a_chain_and_a_hot_address(spark):
    chain = [(i, f"e{i // 2}", f"n{(i + 1) // 2}", True) for i in range(20)]
    hot = [(100 + i, "hot", f"h{i}", True) for i in range(3000)]
    outcome, new = run(spark, chain + hot, [])
    assert {r["request_id"] for r in outcome.where("accepted").collect()} == {i for i, w in one_by_one(chain + hot, []).items() if w[0]}
    assert new.where("email = 'hot'").count() == 1


def test_empty_batches(spark):
    outcome, new = run(spark, [], [("a", "b")])
    assert outcome.count() == new.count() == 0


@pytest.mark.parametrize("n", [2, 4, 8, 200])
def test_new_ids_are_gapless(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        rows = spark.range(20_000).select(F.xxhash64("id").alias("request_id"), F.col("id").alias("x"))
        ids = [(r["request_id"], r["id"]) for r in mutations.numbered(rows, "request_id", 7).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [i for _, i in sorted(ids)] == list(range(7, 20_007))


@pytest.mark.parametrize("n", [2, 200])
def test_registered_users_on_a_second_size(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        ids = [r["id"] for r in registry.register_users(spark, "/root/testdata/sf0.01").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(ids) == list(range(5_000_000, 5_000_000 + len(ids))) and len(ids) == 1500
