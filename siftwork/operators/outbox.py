"""What leaves the engine: messages to send and answers to give, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import public_token, sender


def outbox(issued: DataFrame, users: DataFrame, name: str, address: str, base_url: str, paths: dict[str, str], subjects: dict[str, str]) -> DataFrame:
    """A message for each issued token (id, user_id, purpose, secret): sender, recipients, subject, url.

    paths and subjects are by purpose. Tokens whose user is missing give no message; sending is up to the
    caller, once the tokens are stored.
    """
    by = lambda d: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("purpose"))
    rows = issued.join(users.select(F.col("id").alias("user_id"), "email"), "user_id")
    url = F.concat(F.lit(base_url), by(paths), public_token(F.col("id"), F.col("secret")))
    return rows.select(F.col("id").alias("token_id"), sender(F.lit(name), F.lit(address)).alias("from"), F.array("email").alias("to"), by(subjects).alias("subject"), url.alias("url"))


def error_map(faults: dict[str, Column], messages: dict[str, str]) -> Column:
    """field -> message for each fault that holds; an empty map if none does, a null fault does not."""
    found = [F.when(F.coalesce(fault, F.lit(False)), F.struct(F.lit(name).alias("key"), F.lit(messages[name]).alias("value"))) for name, fault in faults.items()]
    return F.map_from_entries(F.array_compact(F.array(*found)))


def registered(users: DataFrame) -> DataFrame:
    """The four fields of a new user that a registration answers with."""
    return users.select("id", "email", "username", "created_at")
