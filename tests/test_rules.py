"""Boundaries of the time rules, and a row for each branch of the state rules."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwork.functions import clock
from siftwork.operators import lookup, mutations, rules

NOW = datetime(2024, 1, 1, 12)
USERS = "id long, email string, username string, is_active boolean"
TOKENS = "id long, user_id long, purpose string, is_used boolean, created_at timestamp_ntz, expires_at timestamp_ntz"
SESSIONS = "id long, user_id long, kind string, expires_at timestamp_ntz, revoked boolean"


@pytest.fixture
def now():
    return F.lit(NOW.isoformat(" ")).cast("timestamp_ntz")


def ago(**kw):
    return NOW - timedelta(**kw)


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, "a@x.org", "a", True), (2, "b@x.org", "b", False), (3, "c@x.org", "c", False)], USERS)


def test_expiry_boundaries(spark, now):
    rows = [("before", ago(seconds=1)), ("at", NOW), ("after", NOW + timedelta(seconds=1)), ("none", None)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    got = {r["k"]: (r["e"], r["l"]) for r in df.select("k", clock.is_expired(F.col("t"), now).alias("e"), clock.is_live(F.lit(False), F.col("t"), now).alias("l")).collect()}
    assert got == {"before": (True, False), "at": (False, False), "after": (False, True), "none": (None, False)}


def test_cooldown_boundaries(spark, now):
    rows = [("inside", ago(seconds=59.5)), ("at", ago(seconds=60)), ("past", ago(seconds=61)), ("none", None)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    t = F.col("t")
    got = {r["k"]: (r["limited"], r["wait"]) for r in df.select("k", clock.is_limited(t, 1, now).alias("limited"), clock.retry_after_seconds(t, 1, now).alias("wait")).collect()}
    assert got == {"inside": (True, 1), "at": (False, 1), "past": (False, 1), "none": (False, 60)}


def test_seconds_round_as_documented(spark, now):
    df = spark.createDataFrame([(NOW + timedelta(seconds=29.6),), (NOW - timedelta(seconds=5),), (None,)], "t timestamp_ntz")
    t = F.col("t")
    got = [tuple(r) for r in df.select(clock.remaining_seconds(t, now), clock.cooldown_seconds(t, now)).collect()]
    assert got == [(29, 30), (1, 0), (None, 0)]


def test_lifetimes(spark):
    df = spark.createDataFrame([("signup", None), ("password_reset", None), ("signup", 7), ("other", None)], "p string, o int")
    got = [r[0] for r in df.select(clock.by_purpose(F.col("p"), clock.LIFETIME_MINUTES, F.col("o"))).collect()]
    assert got == [1440, 20, 7, None]


def test_token_states_every_branch_and_precedence(spark, users, now):
    later, earlier = NOW + timedelta(minutes=5), ago(minutes=5)
    tokens = spark.createDataFrame(
        [
            (1, 2, "signup", False, ago(hours=1), later),  # valid although a later one follows: sign-up
            (2, 2, "signup", False, ago(minutes=1), NOW),  # expires exactly now: valid
            (3, 2, "signup", True, ago(hours=2), later),  # used
            (4, 1, "signup", False, ago(hours=1), later),  # already verified
            (5, 1, "signup", True, ago(hours=1), later),  # used before already verified
            (6, 2, "password_reset", True, ago(hours=3), later),  # superseded before used
            (7, 2, "password_reset", False, ago(hours=1), later),  # tie on time: the larger id is the latest
            (8, 2, "password_reset", False, ago(hours=1), later),
            (9, 9, "signup", False, ago(hours=1), later),  # no such user
            (10, 3, "password_reset", False, ago(hours=1), earlier),  # expired
        ],
        TOKENS,
    )
    asked = [(f"{i}.s", p, ok) for i, p, ok in [(1, "signup", True), (2, "signup", True), (3, "signup", True), (4, "signup", True), (5, "signup", True), (6, "password_reset", True), (7, "password_reset", True), (8, "password_reset", True), (9, "signup", True), (10, "password_reset", True)]]
    asked += [("10.t", "password_reset", False), ("1.t", "password_reset", True), ("12", "signup", True), ("12.", "signup", True), (".x", "signup", True), (None, "signup", True), ("1.u", "signup", None)]
    got = rules.token_states(spark.createDataFrame(asked, "public_token string, purpose string, secret_ok boolean"), tokens, users, now)
    states = {(r["public_token"], r["purpose"]): r["state"] for r in got.collect()}
    assert got.count() == len(asked)
    want = ["valid", "valid", "used", "already_verified", "used", "superseded", "superseded", "valid", "invalid", "expired"] + ["invalid"] * 7
    assert [states[a[0], a[1]] for a in asked] == want


def test_at_most_one_valid_reset_token_per_user(spark, sf):
    from siftwork.plans import registry

    valid = registry.token_state(spark, sf).where("purpose = 'password_reset' AND state = 'valid'")
    assert valid.groupBy("token_user").count().where("count > 1").count() == 0


def test_session_gates(spark, users, now):
    sessions = spark.createDataFrame([(1, 1, "login", NOW + timedelta(1), False), (2, 2, "login", NOW + timedelta(1), False), (3, 1, "login", NOW, False), (4, 1, "login", NOW + timedelta(1), True), (5, 9, "login", NOW + timedelta(1), False)], SESSIONS)
    asked = spark.createDataFrame([(i,) for i in range(1, 7)], "session_id long")
    got = {r["session_id"]: r["gate"] for r in rules.session_gates(asked, sessions, users, now).collect()}
    assert got == {1: "active", 2: "unverified", 3: "unauthenticated", 4: "unauthenticated", 5: "unauthenticated", 6: "unauthenticated"}


def test_verify_outcomes(spark, now):
    end = NOW + timedelta(seconds=90.9)
    sessions = spark.createDataFrame([(1, 1, "login", end, False), (2, 1, "signup", end, False), (3, 2, "login", end, False)], SESSIONS)
    asked = spark.createDataFrame([(1, 1, "valid"), (2, 1, "valid"), (3, 1, "valid"), (4, 1, "valid"), (1, 1, "used")], "session_id long, token_user long, token_state string")
    got = sorted((r["session_id"], r["token_state"], r["target"], r["revoke"], r["rotate"], r["max_age"]) for r in rules.verify_outcomes(asked, sessions, now).collect())
    assert got == [(1, "used", "failed", False, False, None), (1, "valid", "home", True, True, 90), (2, "valid", "login", True, False, None), (3, "valid", "login", True, False, None), (4, "valid", "login", False, False, None)]


def test_latest_by_breaks_ties_and_keeps_null_keys(spark):
    rows = [(1, 1, NOW), (1, 2, NOW), (1, 3, None), (None, 4, NOW)]
    got = {r["k"]: r["id"] for r in lookup.latest_by(spark.createDataFrame(rows, "k int, id int, t timestamp_ntz"), ["k"], "t", "id").collect()}
    assert got == {1: 2, None: 4}


def test_mutations_ignore_repeats_and_nulls(spark, users):
    ids = spark.createDataFrame([(2,), (2,), (None,), (77,)], "id long")
    assert sorted((r["id"], r["is_active"]) for r in mutations.activated(users, ids).collect()) == [(1, True), (2, True), (3, False)]


def test_new_users_have_one_winner_per_name(spark, now):
    rows = [(5, "a@x", "n", ""), (3, "a@x", "m", ""), (4, "b@x", "m", ""), (9, "c@x", "o", "")]
    got = mutations.new_users(spark.createDataFrame(rows, "request_id long, email string, username string, password_hash string"), 100, now)
    assert sorted((r["id"], r["email"], r["username"]) for r in got.collect()) == [(100, "a@x", "m"), (101, "c@x", "o")]


def test_stream_of_requests(spark, users, now, tmp_path):
    sessions = spark.createDataFrame([(1, 1, "login", NOW + timedelta(1), False)], SESSIONS)
    from siftwork.streaming.gates import gate_stream

    spark.createDataFrame([(1, NOW), (2, NOW)], "session_id long, at timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id long, at timestamp_ntz").parquet(str(tmp_path / "in"))
    q = gate_stream(stream, sessions, users).writeStream.format("memory").queryName("gates").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("SELECT session_id, gate FROM gates").collect()) == [(1, "active"), (2, "unauthenticated")]
