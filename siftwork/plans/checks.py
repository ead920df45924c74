"""Queries over address tables and the server's address check, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text
from siftwork.operators import networks
from siftwork.plans.registry import query
from siftwork.sources import tables


@query("""
, nets AS (
    SELECT (10 + s_suppkey % 5) || '.' || (s_suppkey * 7 % 256) || '.0.0/' || (8 + s_suppkey % 25) AS cidr, (10 + s_suppkey % 5) * 16777216 + s_suppkey * 7 % 256 * 65536 AS low, 8 + s_suppkey % 25 AS n FROM supplier
), hosts AS (
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'fd00:' || lower(to_hex(event_id % 40)) || '::' || lower(to_hex(user_id + 1)) ELSE (10 + event_id % 6) || '.' || (event_id * 13 % 256) || '.' || (event_id % 2) || '.' || (user_id % 2) END AS host,
        (10 + event_id % 6) * 16777216 + event_id * 13 % 256 * 65536 + event_id % 2 * 256 + user_id % 2 AS number FROM events
), best AS (
    SELECT event_id, cidr FROM hosts JOIN nets ON event_id % 5 <> 0 AND number // CAST(pow(2, 32 - n) AS BIGINT) = low // CAST(pow(2, 32 - n) AS BIGINT)
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, cidr) = 1
)
SELECT event_id, host, CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 40 < 25 THEN 'fd00:' || lower(to_hex(event_id % 40)) || '::/32' ELSE 'FD00::/16' END ELSE cidr END AS network FROM hosts LEFT JOIN best USING (event_id)""")
def narrowest_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both versions against networks of many lengths, nested and repeated ones among them."""
    k = F.col("s_suppkey")
    short = tables.read(spark, sf_dir, "supplier").select(F.concat(10 + k % 5, F.lit("."), k * 7 % 256, F.lit(".0.0/"), 8 + k % 25).alias("cidr"))
    long = tables.read(spark, sf_dir, "nation").select(F.concat(F.lit("fd00:"), F.lower(F.hex("n_nationkey")), F.lit("::/32")).alias("cidr"))
    wide = tables.read(spark, sf_dir, "region").select(F.lit("FD00::/16").alias("cidr"))
    e, u = F.col("event_id"), F.col("user_id")
    host = F.when(e % 5 == 0, F.concat(F.lit("fd00:"), F.lower(F.hex(e % 40)), F.lit("::"), F.lower(F.hex(u + 1)))).otherwise(F.concat_ws(".", 10 + e % 6, e * 13 % 256, e % 2, u % 2))
    rows = tables.read(spark, sf_dir, "events").select("event_id", host.alias("host"))
    return networks.narrowest(rows, short.unionByName(long).unionByName(wide), "host", "cidr", "network")


_ATOM, _LABEL = "[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+", "[a-z0-9]([a-z0-9-]*[a-z0-9])?"


@query(f"""
, given AS (SELECT c_custkey, CASE c_custkey % 16 WHEN 0 THEN '.' || c_name || '@mail.example' WHEN 1 THEN c_name || '..x@mail.example' WHEN 2 THEN c_name || '@-mail.example' WHEN 3 THEN c_name || '@mail.' || c_mktsegment WHEN 4 THEN c_name || '@mail.example' || c_custkey
    WHEN 5 THEN repeat('a', c_custkey % 120 + 1) || '@mail.example' WHEN 6 THEN 'a@' || repeat('b', c_custkey % 120 + 1) || '.example' WHEN 7 THEN c_name || '@localhost' WHEN 8 THEN c_name || '@sub.test' WHEN 9 THEN 'Some Name <' || c_name || '@mail.example>' WHEN 10 THEN '  ' || c_name || '@mail.example '
    WHEN 11 THEN c_name || '@mail.example@x' WHEN 12 THEN c_name || ' @mail.example' WHEN 13 THEN c_name || '@ab--cd.example' WHEN 14 THEN 'a@' || repeat('bcdefghij.', c_custkey % 40) || 'example' ELSE c_name || '@mail.example' END AS email FROM customer
), bare AS (SELECT c_custkey, email, trim(CASE WHEN email LIKE '%<%>' THEN regexp_extract(email, '<(.+)>', 1) ELSE email END) AS address FROM given
), parts AS (SELECT *, split_part(address, '@', 1) AS local, lower(split_part(address, '@', 2)) AS domain FROM bare)
SELECT c_custkey, email, regexp_full_match(address, '[^@]+@[^@]+') AND length(address) <= 254 AND length(local) <= 64 AND length(domain) <= 253 AND regexp_full_match(local, '{_ATOM}([.]{_ATOM})*') AND regexp_full_match(domain, '{_LABEL}([.]{_LABEL})+')
    AND len(list_filter(string_split(domain, '.'), lambda g: length(g) > 63 OR (g[3:4] = '--' AND g[1:4] <> 'xn--'))) = 0 AND regexp_matches(domain, '[a-z]$') AND NOT regexp_matches(domain, '(^|[.])(arpa|invalid|local|localhost|onion|test)$') AS valid FROM parts""")
def server_email_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [
        put(".", name, "@mail.example"),
        put(name, "..x@mail.example"),
        put(name, "@-mail.example"),
        put(name, "@mail.", F.col("c_mktsegment")),
        put(name, "@mail.example", k),
        put(F.repeat(F.lit("a"), (k % 120 + 1).cast("int")), "@mail.example"),
        put("a@", F.repeat(F.lit("b"), (k % 120 + 1).cast("int")), ".example"),
        put(name, "@localhost"),
        put(name, "@sub.test"),
        put("Some Name <", name, "@mail.example>"),
        put("  ", name, "@mail.example "),
        put(name, "@mail.example@x"),
        put(name, " @mail.example"),
        put(name, "@ab--cd.example"),
        put("a@", F.repeat(F.lit("bcdefghij."), (k % 40).cast("int")), "example"),
        put(name, "@mail.example"),
    ]
    email = forms[-1]
    for i, form in enumerate(forms[:-1]):
        email = F.when(k % 16 == i, form).otherwise(email)
    rows = tables.read(spark, sf_dir, "customer").select("c_custkey", email.alias("email"))
    return rows.select("c_custkey", "email", text.is_server_email(F.col("email")).alias("valid"))
