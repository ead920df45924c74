"""The state rules: what a token, a session or a request is worth at a given time.

Requests are rows. A password or secret check is an input column (secret_ok, password_ok, same_password):
hashes are never computed here. A null check counts as failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import clock, text
from siftwork.operators.lookup import latest_by
from siftwork.operators.timeline import as_of, cooled


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def token_states(presented: DataFrame, tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Adds state (and token_user, the user of a token that was found) to rows of public_token, purpose, secret_ok.

    The first that holds: invalid (unreadable token, none of that id and purpose, its user missing, wrong
    secret), expired, superseded (resets only: the user has a later one), used, already_verified (sign-ups
    only: the user is active), valid. Of tokens made at the same time the one with the larger id is later.
    """
    # Presented tokens come first, so that later joins meet no others; only resets ask for the latest one.
    known = tokens.select(F.col("id").alias("token_id"), "purpose", F.col("user_id").alias("token_user"), "is_used", "expires_at")
    resets = tokens.where("purpose = 'password_reset'").select("user_id", "created_at", "id")
    newest = latest_by(resets, ["user_id"], "created_at", "id").select(F.col("user_id").alias("token_user"), F.col("id").alias("newest_id"))
    owners = users.select(F.col("id").alias("token_user"), F.col("is_active").alias("user_active"), F.lit(True).alias("user_found"))
    rows = presented.withColumn("token_id", text.token_id(F.col("public_token"))).join(known, ["token_id", "purpose"], "left")
    rows = rows.join(newest, "token_user", "left").join(owners, "token_user", "left")
    reset, signup = F.col("purpose") == "password_reset", F.col("purpose") == "signup"
    state = (
        F.when(~_yes(F.col("user_found")) | ~_yes(F.col("secret_ok")), "invalid")
        .when(clock.is_expired(F.col("expires_at"), now), "expired")
        .when(reset & (F.col("newest_id") != F.col("token_id")), "superseded")
        .when(_yes(F.col("is_used")), "used")
        .when(signup & _yes(F.col("user_active")), "already_verified")
        .otherwise("valid")
    )
    return rows.select(*presented.columns, "token_id", "token_user", state.alias("state"))


def session_gates(requests: DataFrame, sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Adds gate to rows of session_id: unauthenticated (no live session, or its user is missing), unverified or active."""
    live = sessions.where(clock.is_live(F.col("revoked"), F.col("expires_at"), now)).select(F.col("id").alias("session_id"), F.col("user_id").alias("gate_user"))
    known = users.select(F.col("id").alias("gate_user"), F.col("is_active").alias("gate_active"), F.lit(True).alias("gate_found"))
    rows = requests.join(live, "session_id", "left").join(known, "gate_user", "left")
    gate = F.when(~_yes(F.col("gate_found")), "unauthenticated").when(~_yes(F.col("gate_active")), "unverified").otherwise("active")
    return rows.select(*requests.columns, F.when(F.col("gate_found"), F.col("gate_user")).alias("gate_user"), gate.alias("gate"))


def cookie_gates(requests: DataFrame, sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Adds session_id and its gate to rows of cookie; a cookie that is no session id is unauthenticated, as is none."""
    return session_gates(requests.withColumn("session_id", text.session_id(F.col("cookie"))), sessions, users, now)


def issue_limits(requests: DataFrame, tokens: DataFrame, users: DataFrame, purpose: str, now: Column) -> DataFrame:
    """Adds outcome and retry_after to rows of email that ask for a token of that purpose.

    invalid_email; ok without issue for unknown users (and active ones, for sign-ups); limited with the
    seconds left; issue. retry_after is the whole interval unless limited, null for an invalid address.
    """
    minutes = clock.RESEND_MINUTES[purpose]
    own = tokens.where(F.col("purpose") == purpose)
    newest = latest_by(own.select("user_id", "created_at", "id"), ["user_id"], "created_at", "id")
    known = users.select("email", F.col("id").alias("asked_user"), F.col("is_active").alias("asked_active")).join(newest.select(F.col("user_id").alias("asked_user"), F.col("created_at").alias("last_issued")), "asked_user", "left")
    rows = requests.join(known, "email", "left")
    silent = F.col("asked_user").isNull() | (_yes(F.col("asked_active")) if purpose == "signup" else F.lit(False))
    limited = clock.is_limited(F.col("last_issued"), minutes, now)
    outcome = F.when(~text.is_server_email(F.col("email")), "invalid_email").when(silent, "ok").when(limited, "limited").otherwise("issue")
    wait = F.when(F.col("outcome") == "limited", clock.retry_after_seconds(F.col("last_issued"), minutes, now)).when(F.col("outcome") != "invalid_email", F.lit(60 * minutes).cast("long"))
    return rows.withColumn("outcome", outcome).withColumn("retry_after", wait).select(*requests.columns, "asked_user", "outcome", "retry_after")


def issues_in_order(requests: DataFrame, tokens: DataFrame, users: DataFrame, purpose: str, minutes: int | None = None) -> DataFrame:
    """issue_limits() for requests (request_id, email, at) that come at their own times, each knowing what was issued before it.

    A request that issues starts an interval for later ones of the batch, one that is limited does not; tokens of the table count from
    their own time on. Adds asked_user, outcome, last_issue and retry_after. A user with very many requests is spread over tasks.
    """
    minutes = clock.RESEND_MINUTES[purpose] if minutes is None else minutes
    known = users.select("email", F.col("id").alias("asked_user"), F.col("is_active").alias("asked_active"))
    rows = requests.join(known, "email", "left")
    silent = F.col("asked_user").isNull() | (_yes(F.col("asked_active")) if purpose == "signup" else F.lit(False))
    early = F.when(~text.is_server_email(F.col("email")), "invalid_email").when(silent, "ok")
    rows = rows.select("request_id", "email", "at", "asked_user", early.alias("early"))
    own = tokens.where(F.col("purpose") == purpose).select(F.col("user_id").alias("asked_user"), F.col("created_at").alias("at"), F.lit(True).alias("issued"))
    asked = rows.where("early IS NULL").unionByName(own, allowMissingColumns=True)
    done = cooled(asked, ["asked_user"], "at", "request_id", minutes, F.col("issued")).where("issued IS NULL").drop("issued")
    limited = F.when(F.col("limited"), "limited").otherwise("issue")
    decided = done.withColumn("outcome", limited).unionByName(rows.where("early IS NOT NULL").withColumn("outcome", F.col("early")), allowMissingColumns=True)
    wait = F.when(F.col("outcome") == "limited", clock.retry_after_seconds(F.col("last_issue"), minutes, F.col("at"))).when(F.col("outcome") != "invalid_email", F.lit(60 * minutes).cast("long"))
    return decided.select("request_id", "email", "at", "asked_user", "outcome", "last_issue", wait.alias("retry_after"))


def token_states_at(presented: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """token_states() for tokens presented at their own times `at`: what came later, a newer reset token too, is not known yet.

    is_used and is_active are taken as the tables have them; operators/replay.py follows them through a log.
    """
    known = tokens.select(F.col("id").alias("token_id"), "purpose", F.col("user_id").alias("token_user"), "is_used", "expires_at", F.col("created_at").alias("token_made"))
    rows = presented.withColumn("token_id", text.token_id(F.col("public_token"))).join(known, ["token_id", "purpose"], "left")
    resets = tokens.where("purpose = 'password_reset'").select(F.col("user_id").alias("token_user"), "created_at", "id")
    rows = as_of(rows, resets, ["token_user"], "at", "created_at", "id", "newest")
    owners = users.select(F.col("id").alias("token_user"), F.col("is_active").alias("user_active"), F.lit(True).alias("user_found"))
    rows = rows.join(owners, "token_user", "left")
    made = _yes(F.col("token_made") <= F.col("at"))
    reset, signup = F.col("purpose") == "password_reset", F.col("purpose") == "signup"
    state = (
        F.when(~_yes(F.col("user_found")) | ~_yes(F.col("secret_ok")) | ~made, "invalid")
        .when(clock.is_expired(F.col("expires_at"), F.col("at")), "expired")
        .when(reset & (F.col("newest.id") != F.col("token_id")), "superseded")
        .when(_yes(F.col("is_used")), "used")
        .when(signup & _yes(F.col("user_active")), "already_verified")
        .otherwise("valid")
    )
    return rows.select(*presented.columns, "token_id", "token_user", state.alias("state"))


def newest_session_at(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds to requests (user_id, at) the user's newest session made by then, newest_id, and whether it was live at that time.

    A session that ends exactly then is over, as in session_gates(). No session: null and false.
    """
    rows = as_of(requests, sessions.select("user_id", "created_at", "id", "expires_at", "revoked"), ["user_id"], "at", "created_at", "id", "newest")
    live = clock.is_live(F.col("newest.revoked"), F.col("newest.expires_at"), F.col("at"))
    return rows.select(*requests.columns, F.col("newest.id").alias("newest_id"), live.alias("live"))


def resend_requests(requests: DataFrame, sessions: DataFrame, users: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Outcome of resend requests (request_id, email, session_id): a blank address falls back to the session's user.

    Without address and live session: ok. The rest is as in issue_limits() for sign-ups.
    """
    gated = session_gates(requests, sessions, users.select("id", "is_active"), now)
    named = gated.join(users.select(F.col("id").alias("gate_user"), F.col("email").alias("own_email")), "gate_user", "left")
    given = text.stripped_or_empty(F.col("email"))
    asked = named.select("request_id", F.when(given != "", given).otherwise(F.col("own_email")).alias("email"))
    limits = issue_limits(asked, tokens, users, "signup", now)
    blank = F.col("email").isNull()
    return limits.select("request_id", "email", F.when(blank, "ok").otherwise(F.col("outcome")).alias("outcome"), F.when(blank, F.lit(60 * clock.RESEND_MINUTES["signup"]).cast("long")).otherwise(F.col("retry_after")).alias("retry_after"))


def logins(requests: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Adds outcome, login_user and expires_at to rows of email, password_ok.

    invalid_email, bad_credentials (unknown user or wrong password alike), needs_verification or ok; the
    last two open a session that ends after the session lifetime.
    """
    rows = requests.join(users.select("email", F.col("id").alias("login_user"), F.col("is_active").alias("login_active")), "email", "left")
    known = F.col("login_user").isNotNull() & _yes(F.col("password_ok"))
    outcome = F.when(~text.is_server_email(F.col("email")), "invalid_email").when(~known, "bad_credentials").when(~_yes(F.col("login_active")), "needs_verification").otherwise("ok")
    opens = outcome.isin("needs_verification", "ok")
    return rows.select(*requests.columns, outcome.alias("outcome"), F.when(opens, F.col("login_user")).alias("login_user"), F.when(opens, clock.minutes_after(now, clock.SESSION_MINUTES)).alias("expires_at"))


def verify_outcomes(requests: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Where a verification link leads, for rows of token_state, token_user, session_id.

    target: failed, login or home; revoke: whether the session ends; rotate: whether a new one takes its
    place, with the same end and so many seconds left (max_age).
    """
    live = sessions.where(clock.is_live(F.col("revoked"), F.col("expires_at"), now)).select(F.col("id").alias("session_id"), F.col("user_id").alias("live_user"), F.col("kind").alias("live_kind"), F.col("expires_at").alias("live_until"))
    rows = requests.join(live, "session_id", "left")
    good = F.col("token_state") == "valid"
    own = _yes(F.col("live_user") == F.col("token_user")) & (F.coalesce("live_kind", F.lit("login")) != "signup")
    target = F.when(~_yes(good), "failed").when(own, "home").otherwise("login")
    rotate = _yes(good) & own
    return rows.select(*requests.columns, target.alias("target"), (_yes(good) & F.col("live_user").isNotNull()).alias("revoke"), rotate.alias("rotate"), F.when(rotate, clock.remaining_seconds(F.col("live_until"), now)).alias("max_age"))


def register_errors(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Adds email_taken and username_taken to rows of email, username; both are looked up before either fails."""
    emails = users.where("email IS NOT NULL").select("email", F.lit(True).alias("email_found"))
    names = users.where("username IS NOT NULL").select("username", F.lit(True).alias("username_found"))
    rows = requests.join(emails, "email", "left").join(names, "username", "left")
    return rows.select(*requests.columns, _yes(F.col("email_found")).alias("email_taken"), _yes(F.col("username_found")).alias("username_taken"))
