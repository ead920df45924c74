"""Key lookups as joins and the latest row of each key as a combined group maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.clock import is_live


def latest_by(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The row with the greatest (time, tie) of each key, whole; null keys form groups, null times lose.

    The maximum is combined before the shuffle, so a key with many rows sends one row from each task.
    """
    rest = [c for c in rows.columns if c not in (*keys, time, tie)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(time, tie, *rest)).alias("best"))
    return best.select(*keys, "best.*").select(*rows.columns)


def users_by(requests: DataFrame, users: DataFrame, on: str) -> DataFrame:
    """Every request with the columns of the user whose `on` is the same, nulls where there is none."""
    found = users.select(F.col(on), *[F.col(c).alias(f"user_{c}") for c in users.columns if c != on])
    return requests.join(found, on, "left")


def exists(requests: DataFrame, users: DataFrame, on: str) -> DataFrame:
    """The requests that meet a user."""
    return requests.join(users.select(on), on, "left_semi")


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Unrevoked sessions that end after now."""
    return sessions.where(is_live(F.col("revoked"), F.col("expires_at"), now))


def unrevoked_sessions(sessions: DataFrame) -> DataFrame:
    """Unrevoked sessions, over or not."""
    return sessions.where(F.coalesce(~F.col("revoked"), F.lit(False)))


def with_user(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows with their user's columns, by user_id; rows whose user is missing go."""
    found = users.select(F.col("id").alias("user_id"), *[F.col(c).alias(f"user_{c}") for c in users.columns if c != "id"])
    return rows.join(found, "user_id")
