"""A log replayed by joins and minima against an interpreter that goes through it request by request."""

import random
from datetime import datetime, timedelta

import pytest

from siftwork.operators import replay

START = datetime(2024, 1, 1)
USERS = "id long, is_active boolean, name string"
TOKENS = "id long, user_id long, purpose string, is_used boolean, created_at timestamp_ntz, expires_at timestamp_ntz"
SESSIONS = "id string, user_id long, created_at timestamp_ntz, kind string, expires_at timestamp_ntz, revoked boolean"


def at(m):
    return START + timedelta(minutes=m)


def interpret(log, users, tokens, sessions):
    """The routes, one request after another."""
    active = {i: bool(a) for i, a, _ in users}
    token = {t[0]: list(t) for t in tokens}
    session = {s[0]: list(s) for s in sessions}
    out = {}

    def live(sid, now):
        s = session.get(sid)
        return s if s and s[2] <= now and not s[5] and s[4] > now else None

    for rid, now, op, tid, secret, same, uid, password, sid, new in sorted(log, key=lambda r: (r[1], r[0])):
        outcome = target = None
        if op in ("verify", "reset"):
            t = token.get(tid)
            purpose = "signup" if op == "verify" else "password_reset"
            if t is None or t[2] != purpose or t[1] not in active or not secret or t[4] > now:
                outcome = "invalid"
            elif t[5] < now:
                outcome = "expired"
            elif op == "reset" and max((x[4], x[0]) for x in token.values() if x[1] == t[1] and x[2] == purpose and x[4] <= now)[1] != tid:
                outcome = "superseded"
            elif t[3]:
                outcome = "used"
            elif op == "verify":
                outcome, target = ("already_verified", None) if active[t[1]] else ("valid", "login")
                if outcome == "valid":
                    t[3] = active[t[1]] = True
                    s = live(sid, now)
                    if s:
                        s[5] = True
                        if s[1] == t[1] and (s[3] or "login") != "signup":
                            target = "home"
                            session[new] = [new, t[1], now, "login", s[4], False]
            elif same:
                outcome = "same_password"
            else:
                outcome = "reset"
                t[3] = active[t[1]] = True
                for s in session.values():
                    if s[1] == t[1] and s[2] <= now:
                        s[5] = True
            if op == "verify" and outcome != "valid":
                target = "failed"
        elif op == "login":
            outcome = "bad_credentials" if uid not in active or not password else "ok" if active[uid] else "needs_verification"
            if outcome != "bad_credentials":
                session[new] = [new, uid, now, "login", now + timedelta(minutes=120), False]
        elif op == "logout":
            outcome = "ok"
            if sid in session and session[sid][2] <= now:
                session[sid][5] = True
        elif op == "gate":
            s = live(sid, now)
            outcome = "unauthenticated" if s is None or s[1] not in active else "active" if active[s[1]] else "unverified"
        out[rid] = (outcome, target)
    return out, active, {i: t[3] for i, t in token.items()}, {i: (s[1], s[4], s[5]) for i, s in session.items()}


def tables(seed, n):
    rng = random.Random(seed)
    users = [(i, rng.random() < 0.3, f"u{i}") for i in range(8)]
    tokens = []
    for i in range(40):
        made = rng.randrange(-300, 600)
        tokens.append((i, rng.randrange(9), rng.choice(["signup", "password_reset"]), rng.random() < 0.1, at(made), at(made + rng.choice([20, 300, 1440]))))
    sessions = [(f"s{i}", rng.randrange(9), at(m := rng.randrange(-300, 300)), rng.choice(["login", "login", "signup", None]), at(m + rng.randrange(50, 700)), rng.random() < 0.1) for i in range(15)]
    log = []
    for i in rng.sample(range(10 * n), n):
        op = rng.choice(["verify", "verify", "reset", "login", "logout", "gate", "gate"])
        sid = rng.choice([None, *[f"s{k}" for k in range(16)], *[f"n{r[0]}" for r in log if r[2] in ("login", "verify")][-6:]])
        log.append((i, at(rng.randrange(600)), op, rng.choice([None, *range(42)]), rng.random() < 0.9, rng.random() < 0.2, rng.choice([None, *range(9)]), rng.random() < 0.8, sid, f"n{i}"))
    return log, users, tokens, sessions


def check(spark, log, users, tokens, sessions):
    done = replay.replay(spark.createDataFrame(log, replay.LOG), spark.createDataFrame(users, USERS), spark.createDataFrame(tokens, TOKENS), spark.createDataFrame(sessions, SESSIONS))
    out, active, used, after = interpret(log, users, tokens, sessions)
    got = {r["request_id"]: (r["outcome"], r["target"]) for r in done.outcomes.collect()}
    assert {k: (got[k], v) for k, v in out.items() if got.get(k) != v} == {}
    assert len(got) == len(log)
    assert {r["id"]: r["is_active"] for r in done.users.collect()} == active
    assert {r["id"]: r["is_used"] for r in done.tokens.collect()} == used
    assert {r["id"]: (r["user_id"], r["expires_at"], r["revoked"]) for r in done.sessions.collect()} == after


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_the_interpreter(spark, seed):
    check(spark, *tables(seed, [60, 150, 300][seed]))


def test_a_token_serves_once_and_a_reset_ends_sessions(spark):
    users, tokens = [(1, False, "a")], [(1, 1, "password_reset", False, at(0), at(20)), (2, 1, "signup", False, at(0), at(99))]
    sessions = [("s", 1, at(0), "login", at(99), False)]
    log = [(1, at(1), "gate", None, None, None, None, None, "s", None), (2, at(2), "verify", 2, True, None, None, None, "s", "n2"), (3, at(3), "gate", None, None, None, None, None, "n2", None), (4, at(3), "gate", None, None, None, None, None, "s", None)]
    log += [(5, at(4), "reset", 1, True, True, None, None, None, None), (6, at(5), "reset", 1, True, False, None, None, None, None), (7, at(5), "reset", 1, True, False, None, None, None, None), (8, at(6), "gate", None, None, None, None, None, "n2", None), (9, at(7), "verify", 2, True, None, None, None, None, None)]
    check(spark, log, users, tokens, sessions)
    assert [interpret(log, users, tokens, sessions)[0][i][0] for i in range(1, 10)] == ["unverified", "valid", "active", "unauthenticated", "same_password", "reset", "used", "unauthenticated", "used"]


def test_empty_log(spark):
    check(spark, [], [(1, True, "a")], [(1, 1, "signup", False, at(0), at(1))], [("s", 1, at(0), None, at(1), False)])


def test_a_request_meets_its_session_and_its_end_by_one_join(spark):
    rng = random.Random(5)
    log = [(i, at(rng.randrange(40)), "gate", None, None, None, None, None, f"s{rng.randrange(6)}", None) for i in range(20)]
    sessions = [(f"s{i}", i % 2, at(i), "login", at(60), False) for i in range(6)]
    frames = (spark.createDataFrame(rows, kind) for rows, kind in ((log, replay.LOG), ([(0, True, "a"), (1, True, "b")], USERS), ([], TOKENS), (sessions, SESSIONS)))
    outcomes = replay.replay(*frames).outcomes
    assert "Window" not in outcomes._jdf.queryExecution().toString()
    assert outcomes.count() == 20


def test_ends_of_sessions_equal_plain_minima(spark):
    rng = random.Random(6)
    opened = [(f"s{i}", rng.choice([None, 0, 1, 2]), (at(rng.randrange(100_000)), rng.choice([-(2**63), i]))) for i in range(80)]
    ends = [(f"s{rng.randrange(90)}", (at(rng.randrange(100_000)), 1000 + i)) for i in range(60)]
    resets = [(rng.choice([0, 1, 5]), *(opened[i][2][:1] if i % 3 == 0 else (at(rng.randrange(100_000)),)), 2000 + i) for i in range(60)]
    got = replay._ended(
        spark.createDataFrame(opened, "session_id string, user_id long, opened struct<at: timestamp_ntz, request_id: long>"),
        spark.createDataFrame(ends, "session_id string, when struct<at: timestamp_ntz, request_id: long>"),
        spark.createDataFrame(resets, "user_id long, at timestamp_ntz, request_id long"),
    )
    want = {s: min([w for x, w in ends if x == s and w > o] + [(a, r) for v, a, r in resets if v == u and (a, r) > o], default=None) for s, u, o in opened}
    assert {r["session_id"]: r["ended"] and tuple(r["ended"]) for r in got.collect()} == want
    assert any(want.values()) and not all(want.values())
