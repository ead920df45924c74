"""State changes as projections of the new state. A batch is written at once, or not at all.

Plain files know no update, so each function returns the whole table as it is afterwards, or rows to append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import clock


def _flagged(table: DataFrame, keys: DataFrame, key: str, column: str, to: bool, where: Column | None = None) -> DataFrame:
    """The table with column set for rows whose key is among keys; repeated and null keys do no harm."""
    hit = keys.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("__hit", F.lit(True))
    changed = F.col("__hit").isNotNull() if where is None else F.col("__hit").isNotNull() & F.coalesce(where, F.lit(False))
    return table.join(hit, key, "left").withColumn(column, F.when(changed, F.lit(to)).otherwise(F.col(column))).select(*table.columns)


def activated(users: DataFrame, ids: DataFrame) -> DataFrame:
    return _flagged(users, ids, "id", "is_active", True)


def consumed(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """Tokens with those of ids used; however often an id comes, one consumption wins."""
    return _flagged(tokens, ids, "id", "is_used", True)


def revoked(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """Sessions with those of ids revoked, whether over or not."""
    return _flagged(sessions, ids, "id", "revoked", True)


def revoked_for_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with every unrevoked one of the users (user_id) revoked."""
    return _flagged(sessions, users, "user_id", "revoked", True, ~F.col("revoked"))


def new_users(requests: DataFrame, first_id: int, now: Column, users: DataFrame | None = None) -> DataFrame:
    """Rows of users to append for requests (request_id, email, username, password_hash) that succeed one after another; inactive.

    Ids count up by request_id, through a range-partitioned sort and partition offsets, not in one task.
    """
    from siftwork.operators.registration import register

    known = requests.select("email", "username").limit(0) if users is None else users
    return register(requests, known, first_id, now)[1].drop("request_id")


def numbered(rows: DataFrame, order: str, first: int) -> DataFrame:
    """Adds id: consecutive numbers in ascending order. Counts per partition, one small row each, give the offsets.

    The dealt rows are written once, each with the number of its range: ranges are drawn from a sample, so a second
    exchange, even of the same rows, could cut them elsewhere.
    """
    from pyspark.sql import Window

    from siftwork.sources.scratch import written

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return dealt.join(F.broadcast(offsets), "__part").withColumn("id", F.lit(first - 1).cast("long") + F.col("__before") + place).drop("__part", "__before")


def new_tokens(requests: DataFrame, now: Column) -> DataFrame:
    """Rows of tokens to append for requests (id, user_id, purpose, token_hash, minutes): minutes overrides the lifetime if not null."""
    minutes = clock.by_purpose(F.col("purpose"), clock.LIFETIME_MINUTES, F.col("minutes"))
    return requests.select("id", "user_id", "token_hash", "purpose", F.lit(False).alias("is_used"), now.alias("created_at"), clock.minutes_after(now, minutes).alias("expires_at"))


def new_sessions(requests: DataFrame, now: Column, minutes: int = clock.SESSION_MINUTES) -> DataFrame:
    """Rows of sessions to append for requests (id, user_id, expires_at): a given end is kept, as in a rotation."""
    end = F.coalesce(F.col("expires_at"), clock.minutes_after(now, minutes))
    return requests.select("id", "user_id", now.alias("created_at"), F.lit("login").alias("kind"), end.alias("expires_at"), F.lit(False).alias("revoked"))


def reset_passwords(requests: DataFrame, users: DataFrame, tokens: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Requests (request_id, token_id, user_id, token_state, same_password) with outcome, and users, tokens and sessions afterwards.

    A token that is not valid, or a new password equal to the old one, changes nothing. Otherwise the
    token is used, the user active and every session of theirs revoked. Of several requests of a batch that would
    reset with one token the smallest request_id does; the token of the later ones is used by then: invalid_token.
    """
    good = F.coalesce((F.col("token_state") == "valid"), F.lit(False))
    outcome = F.when(~good, "invalid_token").when(F.coalesce(F.col("same_password"), F.lit(False)), "same_password").otherwise("reset")
    first = requests.where(outcome == "reset").groupBy("token_id").agg(F.min("request_id").alias("__first"))
    late = (outcome == "reset") & (F.col("request_id") != F.col("__first"))
    rows = requests.join(first, "token_id", "left").withColumn("outcome", F.when(F.coalesce(late, F.lit(False)), "invalid_token").otherwise(outcome))
    decided = rows.select(*requests.columns, "outcome")
    done = decided.where("outcome = 'reset'")
    return decided, activated(users, done.select(F.col("user_id").alias("id"))), consumed(tokens, done.select(F.col("token_id").alias("id"))), revoked_for_users(sessions, done.select("user_id"))
