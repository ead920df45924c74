"""Time rules. The current time is always a parameter, a timestamp column or literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lifetimes and intervals in minutes by purpose, and the lifetime of a session.
LIFETIME_MINUTES = {"signup": 1440, "password_reset": 20}
RESEND_MINUTES = {"signup": 1, "password_reset": 1}
SESSION_MINUTES = 120


def at(text: str) -> Column:
    """A timestamp without zone."""
    return F.lit(text).cast("timestamp_ntz")


def by_purpose(purpose: Column, minutes: dict[str, int], override: Column | None = None) -> Column:
    """Minutes for a purpose, null for an unknown one; an override that is not null wins."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in minutes.items() for x in kv]), purpose)
    return known if override is None else F.coalesce(override, known)


def minutes_after(start: Column, minutes: Column | int) -> Column:
    return start + F.make_dt_interval(F.lit(0), F.lit(0), minutes if isinstance(minutes, Column) else F.lit(minutes))


def microseconds(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def is_expired(expires_at: Column, now: Column) -> Column:
    """For tokens: one that expires exactly now is still good."""
    return expires_at < now


def is_live(revoked: Column, expires_at: Column, now: Column) -> Column:
    """For sessions: one that expires exactly now is over. A null flag is not live."""
    return F.coalesce(~revoked & (expires_at > now), F.lit(False))


def is_limited(created_at: Column, minutes: Column | int, now: Column) -> Column:
    """Whether the next issue is too early; at the very end of the interval it is allowed. No earlier one: allowed."""
    return F.coalesce(minutes_after(created_at, minutes) > now, F.lit(False))


def retry_after_seconds(created_at: Column, minutes: int, now: Column) -> Column:
    """Whole seconds until the interval is over, rounded up, at least 1; the whole interval if there is no earlier issue."""
    left = F.ceil(microseconds(now, minutes_after(created_at, minutes)) / 1_000_000)
    # greatest() skips nulls, so a missing time is told apart first.
    return F.when(left.isNull(), F.lit(60 * minutes)).otherwise(F.greatest(F.lit(1), left)).cast("long")


def remaining_seconds(expires_at: Column, now: Column) -> Column:
    """Whole seconds left of a session, cut off, at least 1; null for a null end."""
    left = (microseconds(now, expires_at) / 1_000_000).cast("long")
    return F.when(left.isNotNull(), F.greatest(F.lit(1).cast("long"), left))


def cooldown_seconds(until: Column, now: Column) -> Column:
    """Whole seconds of a countdown, rounded up, at least 0; 0 without an end."""
    return F.greatest(F.lit(0).cast("long"), F.ceil(microseconds(now, until) / 1_000_000))
