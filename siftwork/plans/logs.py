"""A whole log of requests over the test tables: what each meets, and the sessions afterwards, with the SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.clock import minutes_after
from siftwork.operators.replay import LOG, Replay, replay
from siftwork.plans.registry import query
from siftwork.sources import tables

#: Clicks and views stand in for old sessions, errors for log-ins; every token is presented twice.
_LOG = """
, visits AS (SELECT * FROM events WHERE event_type IN ('click', 'view')
), old AS (
    SELECT 's' || event_id AS sid, user_id, CASE WHEN event_id % 7 = 0 THEN 'signup' ELSE 'login' END AS kind, ts AS created_at, ts + INTERVAL 3000 MINUTE AS expires_at, event_id % 11 = 0 AS revoked,
        CAST(epoch_us(ts) AS HUGEINT) * 100000000 - 1 AS opened FROM visits
), mine AS (SELECT user_id, max(event_id) AS own FROM visits GROUP BY user_id
), log AS (
    SELECT *, CAST(epoch_us(moment) AS HUGEINT) * 100000000 + request_id AS w FROM (
    SELECT t.id * 4 + use AS request_id, created_at + to_minutes((t.id * 37 + use * 911) % 4000) AS moment, CASE purpose WHEN 'signup' THEN 'verify' ELSE 'reset' END AS op, t.id AS token_id, secret_ok,
        (t.id + use) % 5 = 0 AS same_password, NULL AS user_id, NULL AS password_ok, CASE use WHEN 0 THEN 's' || own ELSE 's' || (t.id + 1) END AS session_id, 'n' || (t.id * 4 + use) AS new_session_id
        FROM tokens t LEFT JOIN mine m ON m.user_id = t.user_id, (VALUES (0), (1)) AS uses(use)
    UNION ALL SELECT event_id * 4 + 2, ts + to_minutes(event_id * 53 % 4000), 'gate', NULL, NULL, NULL, NULL, NULL, 's' || event_id, NULL FROM visits
    UNION ALL SELECT event_id * 4 + 3, ts + to_minutes(event_id * 29 % 3000), 'logout', NULL, NULL, NULL, NULL, NULL, 's' || event_id, NULL FROM visits WHERE event_id % 5 = 0
    UNION ALL SELECT event_id * 4, ts, 'login', NULL, NULL, NULL, user_id, event_id % 9 <> 0, NULL, 'n' || (event_id * 4) FROM events WHERE event_type = 'error'
    UNION ALL SELECT event_id * 4 + 1, ts + to_minutes(event_id * 17 % 200), 'gate', NULL, NULL, NULL, NULL, NULL, 'n' || (event_id * 4), NULL FROM events WHERE event_type = 'error')
), early AS (
    SELECT l.*, t.user_id AS owner, u.is_active, CASE WHEN t.id IS NULL OR u.id IS NULL OR NOT l.secret_ok OR t.created_at > l.moment THEN 'invalid' WHEN t.expires_at < l.moment THEN 'expired'
        WHEN l.op = 'reset' AND t.id <> (SELECT max_by(x.id, (x.created_at, x.id)) FROM tokens x WHERE x.user_id = t.user_id AND x.purpose = 'password_reset' AND x.created_at <= l.moment) THEN 'superseded'
        WHEN t.is_used THEN 'used' END AS early
    FROM log l LEFT JOIN tokens t ON t.id = l.token_id AND t.purpose = CASE l.op WHEN 'verify' THEN 'signup' ELSE 'password_reset' END LEFT JOIN users u ON u.id = t.user_id WHERE l.op IN ('verify', 'reset')
), resets AS (SELECT token_id, any_value(owner) AS owner, min(w) AS w FROM early WHERE early IS NULL AND op = 'reset' AND NOT same_password GROUP BY token_id
), won AS (
    SELECT e.* FROM early e JOIN (SELECT owner, min(w) AS w FROM early WHERE early IS NULL AND op = 'verify' GROUP BY owner) f USING (w)
    WHERE NOT e.is_active AND NOT EXISTS (SELECT 1 FROM resets r WHERE r.owner = e.owner AND r.w < e.w)
), since AS (SELECT owner, min(w) AS w FROM (SELECT owner, w FROM resets UNION ALL SELECT owner, w FROM won) GROUP BY owner
), decided AS (
    SELECT e.*, coalesce(e.early, CASE e.op WHEN 'reset' THEN CASE WHEN r.w < e.w THEN 'used' WHEN e.same_password THEN 'same_password' ELSE 'reset' END
        ELSE CASE WHEN v.w = e.w THEN 'valid' WHEN v.w < e.w THEN 'used' ELSE 'already_verified' END END) AS outcome
    FROM early e LEFT JOIN resets r ON r.token_id = e.token_id LEFT JOIN won v ON v.token_id = e.token_id
), logins AS (
    SELECT l.*, CASE WHEN u.id IS NULL OR NOT l.password_ok THEN 'bad_credentials' WHEN u.is_active OR coalesce(s.w < l.w, false) THEN 'ok' ELSE 'needs_verification' END AS outcome
    FROM log l LEFT JOIN users u ON u.id = l.user_id LEFT JOIN since s ON s.owner = l.user_id WHERE l.op = 'login'
), base AS (
    SELECT * FROM old UNION ALL SELECT new_session_id, user_id, 'login', moment, moment + INTERVAL 120 MINUTE, false, w FROM logins WHERE outcome <> 'bad_credentials'
), ends AS (SELECT session_id AS sid, w FROM log WHERE op = 'logout' UNION ALL SELECT session_id, w FROM won
), turned AS (
    SELECT v.new_session_id, v.owner, 'login', v.moment, b.expires_at, false, v.w FROM won v JOIN base b ON b.sid = v.session_id AND b.user_id = v.owner AND b.kind <> 'signup'
    WHERE b.opened < v.w AND NOT b.revoked AND b.expires_at > v.moment AND NOT EXISTS (SELECT 1 FROM ends x WHERE x.sid = b.sid AND x.w > b.opened AND x.w < v.w)
        AND NOT EXISTS (SELECT 1 FROM resets r WHERE r.owner = b.user_id AND r.w > b.opened AND r.w < v.w)
), every AS (SELECT * FROM base UNION ALL SELECT * FROM turned
), alive AS (
    SELECT q.request_id, b.* FROM (SELECT * FROM log WHERE op = 'gate' UNION ALL SELECT request_id, moment, op, token_id, secret_ok, same_password, user_id, password_ok, session_id, new_session_id, w FROM won) q JOIN every b ON b.sid = q.session_id
    WHERE b.opened < q.w AND NOT b.revoked AND b.expires_at > q.moment AND NOT EXISTS (SELECT 1 FROM ends x WHERE x.sid = b.sid AND x.w > b.opened AND x.w < q.w)
        AND NOT EXISTS (SELECT 1 FROM resets r WHERE r.owner = b.user_id AND r.w > b.opened AND r.w < q.w)
)
"""


def _replayed(spark: SparkSession, sf_dir: str) -> Replay:
    tokens, events = tables.tokens(spark, sf_dir), tables.read(spark, sf_dir, "events")
    visits, i = events.where(F.col("event_type").isin("click", "view")), F.col("event_id")
    later = lambda n: minutes_after(F.col("ts"), n.cast("int"))
    s, n = (lambda x: F.concat(F.lit("s"), x)), (lambda x: F.concat(F.lit("n"), x))
    sessions = visits.select(s(i).alias("id"), "user_id", F.col("ts").alias("created_at"), F.when(i % 7 == 0, "signup").otherwise("login").alias("kind"), minutes_after(F.col("ts"), 3000).alias("expires_at"), (i % 11 == 0).alias("revoked"))
    use = F.col("use")
    shown = tokens.join(visits.groupBy("user_id").agg(F.max("event_id").alias("own")), "user_id", "left").withColumn("use", F.explode(F.array(F.lit(0), F.lit(1))))
    t = F.col("id")
    presented = shown.select(
        (t * 4 + use).alias("request_id"),
        minutes_after(F.col("created_at"), ((t * 37 + use * 911) % 4000).cast("int")).alias("at"),
        F.when(F.col("purpose") == "signup", "verify").otherwise("reset").alias("op"),
        t.alias("token_id"),
        "secret_ok",
        ((t + use) % 5 == 0).alias("same_password"),
        F.when(use == 0, s(F.col("own"))).otherwise(s(t + 1)).alias("session_id"),
        n(t * 4 + use).alias("new_session_id"),
    )
    errors = events.where("event_type = 'error'")
    parts = [
        presented,
        visits.select((i * 4 + 2).alias("request_id"), later(i * 53 % 4000).alias("at"), F.lit("gate").alias("op"), s(i).alias("session_id")),
        visits.where(i % 5 == 0).select((i * 4 + 3).alias("request_id"), later(i * 29 % 3000).alias("at"), F.lit("logout").alias("op"), s(i).alias("session_id")),
        errors.select((i * 4).alias("request_id"), F.col("ts").alias("at"), F.lit("login").alias("op"), "user_id", (i % 9 != 0).alias("password_ok"), n(i * 4).alias("new_session_id")),
        errors.select((i * 4 + 1).alias("request_id"), later(i * 17 % 200).alias("at"), F.lit("gate").alias("op"), n(i * 4).alias("session_id")),
    ]
    log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, spark.createDataFrame([], LOG))
    return replay(log, tables.users(spark, sf_dir), tokens, sessions)


@query(_LOG + """
SELECT d.request_id, d.op, d.outcome, CASE WHEN d.op = 'verify' THEN CASE WHEN d.outcome <> 'valid' THEN 'failed' WHEN a.user_id = d.owner AND a.kind <> 'signup' THEN 'home' ELSE 'login' END END AS target FROM decided d LEFT JOIN alive a USING (request_id)
UNION ALL SELECT request_id, op, outcome, NULL FROM logins
UNION ALL SELECT l.request_id, l.op, CASE WHEN l.op = 'logout' THEN 'ok' WHEN u.id IS NULL THEN 'unauthenticated' WHEN u.is_active OR coalesce(s.w < l.w, false) THEN 'active' ELSE 'unverified' END, NULL
    FROM log l LEFT JOIN alive a USING (request_id) LEFT JOIN users u ON u.id = a.user_id LEFT JOIN since s ON s.owner = a.user_id WHERE l.op IN ('gate', 'logout')""")
def account_log_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).outcomes.select("request_id", "op", "outcome", "target")


@query(_LOG + """
SELECT sid AS id, user_id, expires_at, revoked OR EXISTS (SELECT 1 FROM resets r WHERE r.owner = b.user_id AND r.w > b.opened) OR EXISTS (SELECT 1 FROM log l WHERE l.op = 'logout' AND l.session_id = b.sid AND l.w > b.opened)
    OR EXISTS (SELECT 1 FROM won v JOIN alive a USING (request_id) WHERE a.sid = b.sid) AS revoked FROM every b""")
def account_log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).sessions.select("id", "user_id", "expires_at", "revoked")
