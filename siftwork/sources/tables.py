"""Reading and writing tables, and the stand-ins that the test data offers for users, sessions and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.clock import minutes_after
from siftwork.sources.schemas import conform

#: Lifetimes of the stand-in tokens, chosen so that every state occurs.
STANDIN_MINUTES = {"signup": 1440, "password_reset": 10_080}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, schema: str, **options: str) -> DataFrame:
    """A database table; pass partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return conform(spark.read.format("jdbc").options(url=url, dbtable=name, **options).load(), schema)


def append(df: DataFrame, path: str, schema: str) -> None:
    """Adds rows to a Parquet table in one atomic write."""
    conform(df, schema).write.mode("append").parquet(path)


def health(spark: SparkSession) -> DataFrame:
    """A constant row, which shows that queries run."""
    return spark.range(1).select(F.lit(1).alias("db_ok"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"), F.col("c_name").alias("username"), (F.col("c_custkey") % 2 == 0).alias("is_active"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.lit("login").alias("kind"), minutes_after(F.col("o_orderdate"), 120 * 1440).alias("expires_at"), (F.col("o_orderstatus") == "F").alias("revoked"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    purpose = F.when(F.col("event_type") == "signup", "signup").otherwise("password_reset")
    minutes = F.when(F.col("event_type") == "signup", STANDIN_MINUTES["signup"]).otherwise(STANDIN_MINUTES["password_reset"])
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        purpose.alias("purpose"),
        (F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("is_used"),
        F.col("ts").alias("created_at"),
        minutes_after(F.col("ts"), minutes).alias("expires_at"),
        (F.col("event_id") % 97 != 0).alias("secret_ok"),
    )
