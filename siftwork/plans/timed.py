"""Queries in which rows of one batch affect each other, or each row has its own time, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import chat, clock
from siftwork.operators import registration, rules, timeline
from siftwork.plans.registry import _S, SESSION_NOW, _presented, query
from siftwork.sources import tables


@query("""
, asked AS (
    SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 50 = 0 THEN c_name || '@example.com' ELSE 'e' || (o_custkey * 31 % 997) || '@new.example' END AS email,
        'n' || (o_orderkey * 17 % 1409) AS username FROM orders JOIN customer ON c_custkey = o_custkey
), rounds AS (
    SELECT min(request_id) AS request_id, email, username, false AS won FROM asked
        WHERE email NOT IN (SELECT email FROM users) AND username NOT IN (SELECT username FROM users) GROUP BY email, username
    UNION ALL
    SELECT request_id, email, username, is_first AS won FROM (
        SELECT *, bool_or(is_first) OVER (PARTITION BY email) OR bool_or(is_first) OVER (PARTITION BY username) AS beside FROM (
            SELECT *, request_id = min(request_id) OVER (PARTITION BY email) AND request_id = min(request_id) OVER (PARTITION BY username) AS is_first FROM rounds WHERE NOT won))
    WHERE is_first OR NOT beside
), won AS (SELECT request_id, email, username FROM rounds WHERE won)
SELECT r.request_id, CASE WHEN w.request_id IS NOT NULL THEN 5000000 - 1 + row_number() OVER (PARTITION BY w.request_id IS NOT NULL ORDER BY r.request_id) END AS id, r.email, r.username,
    w.request_id IS NOT NULL AS accepted, ue.email IS NOT NULL OR coalesce(we.request_id < r.request_id, false) AS email_taken, un.username IS NOT NULL OR coalesce(wn.request_id < r.request_id, false) AS username_taken
FROM asked r LEFT JOIN won w ON w.request_id = r.request_id LEFT JOIN won we ON we.email = r.email LEFT JOIN won wn ON wn.username = r.username
LEFT JOIN users ue ON ue.email = r.email LEFT JOIN users un ON un.username = r.username""")
def register_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that clash crosswise, in addresses with some and in names with others, and with users."""
    users = tables.users(spark, sf_dir)
    o = tables.read(spark, sf_dir, "orders").join(users.select(F.col("id").alias("o_custkey"), F.col("email").alias("own")), "o_custkey")
    email = F.when(F.col("o_orderkey") % 50 == 0, F.col("own")).otherwise(F.concat(F.lit("e"), F.col("o_custkey") * 31 % 997, F.lit("@new.example")))
    asked = o.select(F.col("o_orderkey").alias("request_id"), email.alias("email"), F.concat(F.lit("n"), F.col("o_orderkey") * 17 % 1409).alias("username"), F.lit("").alias("password_hash"))
    outcome, new = registration.register(asked, users, 5_000_000, clock.at(SESSION_NOW))
    return outcome.join(new.select("request_id", "id"), "request_id", "left").select("request_id", "id", "email", "username", "accepted", "email_taken", "username_taken")


_CHAIN = """
, chain AS (
    SELECT {key}, min(moment) AS moment FROM steps GROUP BY ALL
    UNION ALL
    SELECT {own}, min(s.moment) AS moment FROM chain c JOIN steps s USING ({key}) WHERE s.moment > c.moment AND (s.forced OR s.moment >= c.moment + INTERVAL {minutes} MINUTE) GROUP BY ALL
), placed AS (
    SELECT *, NOT forced AND id = min(id) FILTER (NOT forced) OVER same AND NOT bool_or(forced) OVER same AS leads FROM steps WINDOW same AS (PARTITION BY {key}, moment)
), lasts AS (
    SELECT p.*, max(c.moment) AS last FROM placed p LEFT JOIN chain c ON {on} AND (c.moment < p.moment OR (c.moment = p.moment AND NOT p.leads)) WHERE NOT p.forced GROUP BY ALL
), told AS (SELECT *, coalesce(last + INTERVAL {minutes} MINUTE > moment, false) AS limited,
    CAST(CASE WHEN last IS NULL THEN {minutes} * 60 ELSE greatest(1, ceil(date_diff('microsecond', moment, last + INTERVAL {minutes} MINUTE) / 1000000.0)) END AS BIGINT) AS wait FROM lasts)
"""


@query(", steps AS (SELECT user_id, event_type, ts AS moment, event_id AS id, false AS forced FROM events)" + _CHAIN.format(key="user_id, event_type", own="user_id, event_type", on="c.user_id = p.user_id AND c.event_type = p.event_type", minutes=360)
       + "SELECT id AS event_id, user_id, event_type, limited, last AS last_issue, wait AS retry_after FROM told")
def cooldown_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of one kind each; only those that were let through start the six hours."""
    e = tables.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    done = timeline.cooled(e, ["user_id", "event_type"], "ts", "event_id", 360)
    return done.select("event_id", "user_id", "event_type", "limited", "last_issue", clock.retry_after_seconds(F.col("last_issue"), 360, F.col("ts")).alias("retry_after"))


@query(""", steps AS (SELECT user_id, ts AS moment, event_id AS id, false AS forced FROM events WHERE event_type NOT IN ('signup', 'purchase') AND event_id % 10 > 1
    UNION ALL SELECT user_id, created_at, id, true FROM tokens WHERE purpose = 'password_reset')""" + _CHAIN.format(key="user_id", own="user_id", on="c.user_id = p.user_id", minutes=720)
       + """SELECT id AS request_id, user_id AS asked_user, CASE WHEN limited THEN 'limited' ELSE 'issue' END AS outcome, last AS last_issue, CASE WHEN limited THEN wait ELSE 720 * 60 END AS retry_after FROM told
    UNION ALL SELECT event_id, NULL, CASE event_id % 10 WHEN 0 THEN 'invalid_email' ELSE 'ok' END, NULL, CASE event_id % 10 WHEN 1 THEN 720 * 60 END FROM events WHERE event_type NOT IN ('signup', 'purchase') AND event_id % 10 <= 1""")
def reset_issues_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of forgotten passwords against the tokens that were issued meanwhile."""
    users, tokens = tables.users(spark, sf_dir), tables.tokens(spark, sf_dir)
    k = F.col("event_id") % 10
    e = tables.read(spark, sf_dir, "events").where(~F.col("event_type").isin("signup", "purchase"))
    named = e.join(users.select(F.col("id").alias("user_id"), "email"), "user_id", "left")
    asked = named.select(F.col("event_id").alias("request_id"), F.when(k == 0, "nobody").when(k == 1, "no.one@example.com").otherwise(F.col("email")).alias("email"), F.col("ts").alias("at"))
    return rules.issues_in_order(asked, tokens, users, "password_reset", 720).select("request_id", "asked_user", "outcome", "last_issue", "retry_after")


@query(""", asked AS (SELECT *, created_at + to_minutes((id * 37) % 4000 - 200) AS at FROM tokens)
SELECT a.id AS token_id, a.purpose, a.at, a.user_id AS token_user, CASE
    WHEN u.id IS NULL OR NOT a.secret_ok OR a.created_at > a.at THEN 'invalid' WHEN a.expires_at < a.at THEN 'expired'
    WHEN a.purpose = 'password_reset' AND a.id <> (SELECT t.id FROM tokens t WHERE t.user_id = a.user_id AND t.purpose = 'password_reset' AND t.created_at <= a.at ORDER BY t.created_at DESC, t.id DESC LIMIT 1) THEN 'superseded'
    WHEN a.is_used THEN 'used' WHEN a.purpose = 'signup' AND u.is_active THEN 'already_verified' ELSE 'valid' END AS state
FROM asked a LEFT JOIN users u ON u.id = a.user_id""")
def token_state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token presented at a time of its own, some before they were made."""
    tokens = tables.tokens(spark, sf_dir)
    asked = tokens.withColumn("at", clock.minutes_after(F.col("created_at"), ((F.col("id") * 37) % 4000 - 200).cast("int")))
    presented = _presented(asked.drop("at")).columns
    shown = asked.select(F.concat_ws(".", "id", F.lit("secret")).alias("public_token"), "purpose", "secret_ok", "at")
    assert presented == shown.columns[:3]
    return rules.token_states_at(shown, tokens, tables.users(spark, sf_dir)).select("token_id", "purpose", "at", "token_user", "state")


@query(f""", asked AS (SELECT id AS request_id, user_id, created_at + to_days(CAST(id % 400 - 100 AS INTEGER)) AS at FROM sessions WHERE created_at < {_S})
SELECT a.request_id, a.user_id, a.at, s.id AS newest_id, coalesce(NOT s.revoked AND s.expires_at > a.at, false) AS live
FROM asked a LEFT JOIN LATERAL (SELECT * FROM sessions s WHERE s.user_id = a.user_id AND s.created_at <= a.at ORDER BY s.created_at DESC, s.id DESC LIMIT 1) s ON true""")
def newest_session_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each session a look at its user some days before or after."""
    sessions = tables.sessions(spark, sf_dir)
    at = clock.minutes_after(F.col("created_at"), ((F.col("id") % 400 - 100) * 1440).cast("int"))
    asked = sessions.where(F.col("created_at") < clock.at(SESSION_NOW)).select(F.col("id").alias("request_id"), "user_id", at.alias("at"))
    return rules.newest_session_at(asked, sessions)


@query(f"""SELECT conv_id, turn, '{chat.SYSTEM}' || chr(10) || chr(10) || '{chat.HISTORY}' || chr(10) || coalesce(past, '') || chr(10) || chr(10) || '{chat.MESSAGE}' || text || chr(10) || '{chat.CLOSING}' AS prompt FROM (
    SELECT *, string_agg(CASE role WHEN 'user' THEN '{chat.USER_LABEL}' ELSE '{chat.OTHER_LABEL}' END || '{chat.AFTER_LABEL}' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS past
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)) WHERE role = 'user'""")
def chat_prompt_every_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every call, not only of a conversation's last."""
    c = tables.read(spark, sf_dir, "conversations")
    role = F.coalesce(F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role")), F.lit(""))
    return chat.prompts(c.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("content")))
