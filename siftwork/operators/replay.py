"""A log of requests that change what later ones meet: tokens are used up, users become active, sessions open and end.

The log has request_id (distinct), at, op and what the op needs; requests take effect in the order of (at, request_id).

| op | needs |
| --- | --- |
| verify | token_id, secret_ok, session_id (may be null), new_session_id for a rotation |
| reset | token_id, secret_ok, same_password |
| login | user_id (null: unknown), password_ok, new_session_id |
| logout | session_id |
| gate | session_id |

What several later steps ask for, such as the settled tokens, is written once. Nothing is gone through one by one. A token is used by the first request that would succeed with it, a user is active from
the first success on, a session ends with the first request that ends it: each is a minimum over (at, request_id), combined
before it is shuffled, so a busy user is no busy task. Tokens and users do not depend on sessions, so they are settled first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import clock
from siftwork.operators.timeline import as_of
from siftwork.sources.scratch import written

LOG = "request_id long, at timestamp_ntz, op string, token_id long, secret_ok boolean, same_password boolean, user_id long, password_ok boolean, session_id string, new_session_id string"


@dataclass(frozen=True)
class Replay:
    """outcomes: request_id, at, op, outcome, target (of verify: failed, login or home); and the tables after the log."""

    outcomes: DataFrame
    users: DataFrame
    tokens: DataFrame
    sessions: DataFrame


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _when() -> Column:
    return F.struct("at", "request_id")


def _tokens(log: DataFrame, users: DataFrame, tokens: DataFrame) -> DataFrame:
    """verify and reset requests with outcome, and owner, the user of a token that was found."""
    known = tokens.select(F.col("id").alias("token_id"), F.col("purpose").alias("__purpose"), F.col("user_id").alias("owner"), "is_used", "expires_at", F.col("created_at").alias("__made"))
    owners = users.select(F.col("id").alias("owner"), F.col("is_active").alias("__active"), F.lit(True).alias("__found"))
    wanted = F.when(F.col("op") == "verify", "signup").otherwise("password_reset")
    rows = log.where("op IN ('verify', 'reset')").withColumn("__purpose", wanted).join(known, ["token_id", "__purpose"], "left").join(owners, "owner", "left")
    resets = tokens.where("purpose = 'password_reset'").select(F.col("user_id").alias("owner"), "created_at", "id")
    rows = as_of(rows, resets, ["owner"], "at", "created_at", "id", "__newest")
    reset = F.col("op") == "reset"
    early = (
        F.when(~_yes(F.col("__found")) | ~_yes(F.col("secret_ok")) | ~_yes(F.col("__made") <= F.col("at")), "invalid")
        .when(clock.is_expired(F.col("expires_at"), F.col("at")), "expired")
        .when(reset & (F.col("__newest.id") != F.col("token_id")), "superseded")
        .when(_yes(F.col("is_used")), "used")
    )
    rows = rows.withColumn("__early", early).withColumn("__when", _when())
    # Resets: the first that would succeed with a token uses it. A password that stays the same uses nothing.
    would = rows.where(F.col("__early").isNull() & reset & ~_yes(F.col("same_password")))
    first_reset = would.groupBy("token_id", "owner").agg(F.min("__when").alias("__by"))
    active_by_reset = first_reset.groupBy("owner").agg(F.min("__by").alias("__reset"))
    # Sign-ups: only the first of a user that meets an unused token succeeds, and only if no reset came before.
    first_signup = rows.where(F.col("__early").isNull() & ~reset).groupBy("owner").agg(F.min("__when").alias("__signup"))
    rows = rows.join(first_reset.select("token_id", "__by"), "token_id", "left").join(active_by_reset, "owner", "left").join(first_signup, "owner", "left")
    succeeds = ~_yes(F.col("__active")) & (F.col("__when") == F.col("__signup")) & ~_yes(F.col("__reset") < F.col("__when"))
    rows = rows.withColumn("__won", F.col("__early").isNull() & ~reset & succeeds)
    used_by = rows.where("__won").select("token_id", F.col("__when").alias("__used"))
    rows = rows.join(used_by, "token_id", "left")
    of_reset = F.when(_yes(F.col("__by") < F.col("__when")), "used").when(_yes(F.col("same_password")), "same_password").otherwise("reset")
    of_verify = F.when(F.col("__won"), "valid").when(_yes(F.col("__used") < F.col("__when")), "used").otherwise("already_verified")
    outcome = F.coalesce("__early", F.when(reset, of_reset).otherwise(of_verify))
    return rows.select(*log.columns, "owner", outcome.alias("outcome"))


def _ended(sessions: DataFrame, ends: DataFrame, resets: DataFrame) -> DataFrame:
    """Adds `ended` to sessions: the first request after they opened that ends them, by their id or as a reset of their user; null if none does.

    sessions: session_id, user_id, opened, ... ends: session_id, when. resets: user_id, at, request_id.
    """
    # The first reset after a session opened is the latest before it in time run backwards; so are ids, by their complement, which does not overflow.
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    back = lambda c: epoch + (epoch - c)
    turned = resets.select("user_id", back(F.col("at")).alias("__at"), F.bitwise_not("request_id").alias("__tie"), _when().alias("__reset"))
    opened = F.coalesce(F.col("opened.at"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    begun = sessions.withColumn("__opened", back(opened)).withColumn("__id", F.bitwise_not("opened.request_id"))
    # An equal id would be the request that opened the session, which is no reset.
    met = as_of(begun, turned, ["user_id"], "__opened", "__at", "__tie", "__first", at_tie="__id")
    over = sessions.select("session_id", "opened").join(ends, "session_id").where("when > opened").groupBy("session_id").agg(F.min("when").alias("__over"))
    return met.join(over, "session_id", "left").select(*sessions.columns, F.least("__over", "__first.__reset").alias("ended"))


def _live(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds the columns of a session that is live just before the request, as `live`, to rows of session_id; null if none is.

    sessions: session_id, user_id, kind, expires_at, revoked, opened, ended. Ends are a session's own, so a request meets them by one join.
    """
    held = F.struct("user_id", "kind", "expires_at", "revoked", "opened", "ended")
    met = rows.join(sessions.select("session_id", held.alias("held")), "session_id", "left")
    h = F.col("held")
    alive = _yes(h["opened"] < _when()) & clock.is_live(h["revoked"], h["expires_at"], F.col("at")) & ~_yes(h["ended"] < _when())
    return met.select(*rows.columns, F.when(alive, h).alias("live"))


def replay(log: DataFrame, users: DataFrame, tokens: DataFrame, sessions: DataFrame) -> Replay:
    """What each request of the log meets and the tables afterwards. Sessions made at a request's own time are older than it.

    Requests whose token, user or session is null or unknown fail as the single rules say; other ops than those above have outcome null.
    """
    decided = written(_tokens(log, users, tokens), "decided")
    success = decided.where("outcome IN ('valid', 'reset')")
    active = success.groupBy(F.col("owner").alias("user_id")).agg(F.min(_when()).alias("since"))
    state = users.select(F.col("id").alias("user_id"), F.col("is_active").alias("was_active")).join(active, "user_id", "left")

    def active_at(rows: DataFrame, by: str) -> DataFrame:
        mine = state.select(F.col("user_id").alias(by), "was_active", "since", F.lit(True).alias("is_user"))
        return rows.join(mine, by, "left").withColumn("is_active", _yes(F.col("was_active")) | _yes(F.col("since") < _when())).drop("was_active", "since")

    logins = active_at(log.where("op = 'login'"), "user_id")
    let_in = _yes(F.col("is_user")) & _yes(F.col("password_ok"))
    logins = written(logins.withColumn("outcome", F.when(~let_in, "bad_credentials").when(F.col("is_active"), "ok").otherwise("needs_verification")), "logins")
    opened = logins.where("outcome <> 'bad_credentials'")
    shape = ("session_id", "user_id", "created_at", "kind", "expires_at", "revoked", "opened")
    old = sessions.select(F.col("id").alias("session_id"), "user_id", "created_at", "kind", "expires_at", "revoked", F.struct(F.col("created_at").alias("at"), F.lit(-(2**63)).alias("request_id")).alias("opened"))
    made = opened.select(F.col("new_session_id").alias("session_id"), "user_id", F.col("at").alias("created_at"), F.lit("login").alias("kind"), clock.minutes_after(F.col("at"), clock.SESSION_MINUTES).alias("expires_at"), F.lit(False).alias("revoked"), _when().alias("opened"))

    resets = decided.where("outcome = 'reset'").select(F.col("owner").alias("user_id"), "at", "request_id")
    verified = decided.where("outcome = 'valid'")
    ends = log.where("op = 'logout'").unionByName(verified.select(*log.columns)).where("session_id IS NOT NULL").select("session_id", _when().alias("when"))
    base = written(_ended(old.select(*shape).unionByName(made.select(*shape)), ends, resets), "sessions")
    own = _yes(F.col("live.user_id") == F.col("owner")) & (F.coalesce("live.kind", F.lit("login")) != "signup")
    # A user verifies once, so a rotation never starts from another rotation's session.
    rotated = _live(verified, base).where(F.col("live").isNotNull() & own)
    turned = rotated.select(F.col("new_session_id").alias("session_id"), F.col("owner").alias("user_id"), F.col("at").alias("created_at"), F.lit("login").alias("kind"), F.col("live.expires_at").alias("expires_at"), F.lit(False).alias("revoked"), _when().alias("opened"))
    every = base.unionByName(written(_ended(turned.select(*shape), ends, resets), "turned"))

    seen = written(_live(verified, every), "seen")
    verify = seen.select("request_id", "at", "op", "outcome", F.when(F.col("live").isNotNull() & own, "home").otherwise("login").alias("target"))
    failed = decided.where("op = 'verify' AND outcome <> 'valid'").select("request_id", "at", "op", "outcome", F.lit("failed").alias("target"))
    gates = active_at(_live(log.where("op = 'gate'"), every).withColumn("gate_user", F.col("live.user_id")), "gate_user")
    gates = gates.withColumn("outcome", F.when(F.col("live").isNull() | ~_yes(F.col("is_user")), "unauthenticated").when(F.col("is_active"), "active").otherwise("unverified"))
    rest = log.where("op IS NULL OR op NOT IN ('verify', 'reset', 'login', 'gate')").withColumn("outcome", F.when(F.col("op") == "logout", "ok"))
    outcomes = verify.unionByName(failed)
    for part in (decided.where("op = 'reset'"), logins, gates, rest):
        outcomes = outcomes.unionByName(part.select("request_id", "at", "op", "outcome"), allowMissingColumns=True)

    new_users = users.join(active.select(F.col("user_id").alias("id"), F.lit(True).alias("__on")), "id", "left").withColumn("is_active", _yes(F.col("is_active")) | _yes(F.col("__on"))).select(*users.columns)
    used = success.select(F.col("token_id").alias("id")).distinct().withColumn("__on", F.lit(True))
    new_tokens = tokens.join(used, "id", "left").withColumn("is_used", _yes(F.col("is_used")) | _yes(F.col("__on"))).select(*tokens.columns)
    # A verification ends only a session that it met alive; a log-out any that was open, over or not.
    stops = log.where("op = 'logout'").select("session_id", _when().alias("when")).unionByName(seen.where(F.col("live").isNotNull()).select("session_id", _when().alias("when")))
    stopped = every.join(stops, "session_id").where("when > opened").select("session_id").distinct().withColumn("__stop", F.lit(True))
    last = resets.groupBy("user_id").agg(F.max(_when()).alias("__reset"))
    after = every.join(stopped, "session_id", "left").join(last, "user_id", "left")
    gone = _yes(F.col("revoked")) | _yes(F.col("__stop")) | _yes(F.col("__reset") > F.col("opened"))
    new_sessions = after.select(F.col("session_id").alias("id"), "user_id", "created_at", "kind", "expires_at", gone.alias("revoked"))
    return Replay(outcomes.select("request_id", "at", "op", "outcome", "target"), new_users, new_tokens, new_sessions)
