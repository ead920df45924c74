"""A batch of registrations as if they came one after another.

A request is accepted if neither its address nor its name belongs to a user or to a request accepted before it. So a request
that fails frees nothing and takes nothing: which ones succeed is a greedy choice over two unique keys. It is made in rounds. In each,
the requests that come first both at their address and at their name are accepted, and all that share a key with one of
them go. Rounds grow with the longest chain of requests that wait for each other, not with the batch; each writes what is
left, and the smallest request of a key is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.operators.mutations import numbered
from siftwork.sources.scratch import discarded, written


def _first(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("request_id").alias("request_id"))


def accepted(requests: DataFrame, users: DataFrame) -> DataFrame:
    """request_id, email, username of the requests that succeed, in order of request_id, which must be distinct.

    Null addresses and names clash with nothing but are refused, as users need both.
    """
    keys = ["email", "username"]
    rows = requests.select("request_id", *keys).where("email IS NOT NULL AND username IS NOT NULL")
    # Of requests alike in both keys the later ones fail whatever the first does.
    rows = rows.groupBy(*keys).agg(F.min("request_id").alias("request_id"))
    for key in keys:
        rows = rows.join(users.select(key), key, "left_anti")
    left, parts = written(rows, "requests"), []
    while not left.isEmpty():
        chosen = left
        for key in keys:
            chosen = chosen.join(_first(left, key), [key, "request_id"], "left_semi")
        chosen = written(chosen.select("request_id", *keys), "accepted")
        parts.append(chosen)
        rest = left
        for key in keys:
            rest = rest.join(chosen.select(key), key, "left_anti")
        before, left = left, written(rest, "requests")
        discarded(before)
    out = parts[0] if parts else left.select("request_id", *keys)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def register(requests: DataFrame, users: DataFrame, first_id: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """Every request (request_id, email, username, password_hash, at) with its outcome, and the users to append.

    Outcome: accepted, email_taken and username_taken, both looked up when the request came: against users, and against what earlier
    requests of the batch took. An address that fails valid (a boolean column, if there is one) is looked up no further. Ids
    count up by request_id without gaps. `now` may be a column of requests, such as each request's own time.
    """
    checked = "valid" in requests.columns
    asked = requests.where("valid") if checked else requests
    won = written(accepted(asked, users), "won")
    rows = requests
    for key in ("email", "username"):
        old = users.where(F.col(key).isNotNull()).select(key).distinct().withColumn(f"__old_{key}", F.lit(True))
        by = won.select(key, F.col("request_id").alias(f"__by_{key}"))
        rows = rows.join(old, key, "left").join(by, key, "left")
    taken = {key: F.col(f"__old_{key}").isNotNull() | F.coalesce(F.col(f"__by_{key}") < F.col("request_id"), F.lit(False)) for key in ("email", "username")}
    looked = F.coalesce(F.col("valid"), F.lit(False)) if checked else F.lit(True)
    outcome = rows.select(*requests.columns, F.coalesce(F.col("__by_email") == F.col("request_id"), F.lit(False)).alias("accepted"), *[(looked & c).alias(f"{key}_taken") for key, c in taken.items()])
    new = numbered(requests.withColumn("created_at", now).join(won.select("request_id"), "request_id", "left_semi"), "request_id", first_id)
    return outcome, new.select("id", "email", "username", "password_hash", F.lit(False).alias("is_active"), F.lit(False).alias("is_admin"), "created_at", "request_id")
