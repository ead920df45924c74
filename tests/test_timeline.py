"""Rows at their own times against loops over them."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import timeline

START = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def greedy(rows, minutes):
    """(limited, last issue) by id, one after another."""
    out, last = {}, {}
    for key, t, i, forced in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], not r[3], r[2])):
        before = last.get(key)
        limited = not forced and before is not None and t < before + minutes
        out[i] = (limited, at(before))
        if not limited:
            last[key] = t
    return out | {i: (False, None) for key, t, i, _ in rows if key is None or t is None}


def cool(spark, rows, minutes, seconds):
    df = spark.createDataFrame([(k, at(t), i, f, "x") for k, t, i, f in rows], "who string, at timestamp_ntz, id long, forced boolean, limit string")
    return {r["id"]: (r["limited"], r["last_issue"]) for r in timeline.cooled(df, ["who"], "at", "id", minutes, F.col("forced"), seconds).collect()}


@pytest.mark.parametrize("seconds", [600, 3600, 10**7])
@pytest.mark.parametrize("minutes", [1, 7, 60])
def test_cooldown_in_order(spark, minutes, seconds):
    rng = random.Random(minutes * seconds)
    rows = [(rng.choice("abc"), rng.randrange(900), i, rng.random() < 0.1) for i in range(500)] + [("dense", i // 9, 1000 + i, False) for i in range(600)]
    rows += [(None, 5, 2000, False), ("a", None, 2001, False), ("one", 3, 2002, False)]
    assert cool(spark, rows, minutes, seconds) == greedy(rows, minutes)


def test_a_limited_request_prolongs_nothing(spark):
    """Six, eleven and sixteen: eleven is free again although six came in between."""
    assert {i: x[0] for i, x in cool(spark, [("a", 0, 1, False), ("a", 6, 2, False), ("a", 10, 3, False), ("a", 12, 4, False)], 10, 60).items()} == {1: False, 2: True, 3: False, 4: True}


def test_one_key_of_a_million_rows(spark):
    """Slots bound what a task holds, and the chain over them is exact."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(F.lit("hot").alias("who"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 3).cast("decimal(18,6)"))).alias("at"), "id")
    done = timeline.cooled(df, ["who"], "at", "id", 1, seconds=86_400)
    assert done.where("NOT limited").count() == n // 20
    assert done.where("NOT limited AND id % 20 <> 0").isEmpty()
    sizes = [r["count"] for r in df.groupBy("who", timeline.slot_of(F.col("at"), 86_400)).count().collect()]
    assert len(sizes) > 30 and max(sizes) <= 28_800


def test_transfer_is_the_loop():
    rng = random.Random(3)
    for _ in range(300):
        t = np.array(sorted(rng.randrange(60) for _ in range(rng.randrange(1, 25))), np.int64)
        forced = np.array([rng.random() < 0.15 for _ in t])
        bounds, exits = timeline.transfer(t, forced, 7)
        for last in range(int(t[0]) - 12, int(t[0]) + 1):
            now = last
            for x, f in zip(t.tolist(), forced, strict=True):
                now = x if f or x >= now + 7 else now
            k = int(np.searchsorted(bounds, last))
            assert (exits[k] if k < len(exits) else last) == now


@pytest.mark.parametrize("seconds", [600, 10**7])
def test_as_of(spark, seconds):
    rng = random.Random(seconds)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(500)]), i) for i in range(200)]
    asked = [(rng.choice(["a", "b", "z", None]), rng.choice([None, *range(-5, 700)]), i) for i in range(200)]
    known = spark.createDataFrame([(k, at(t), i, f"row{i}") for k, t, i in rows], "who string, made timestamp_ntz, id long, text string")
    requests = spark.createDataFrame([(k, at(t), i, "t") for k, t, i in asked], "who string, at timestamp_ntz, id long, text string")
    got = {r["id"]: r["latest"] and r["latest"]["text"] for r in timeline.as_of(requests, known, ["who"], "at", "made", "id", "latest", seconds).collect()}
    for k, t, i in asked:
        before = [(m, j) for w, m, j in rows if None not in (k, t, m) and w == k and m <= t]
        assert got[i] == (f"row{max(before)[1]}" if before else None)


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_rows_before(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i) for i in range(250)]
    df = spark.createDataFrame(rows, "who string, turn long, id long")
    got = {r["id"]: [x["id"] for x in r["past"]] for r in timeline.rows_before(df, ["who"], "turn", "id", 8, "past", F.floor(F.col("turn") / width)).collect()}
    order = lambda r: (-1 if r[1] is None else r[1], r[2])
    for k, t, i in rows:
        before = sorted((r for r in rows if r[0] == k and order(r) < order((k, t, i))), key=order)
        assert got[i] == [r[2] for r in before[-8:]]
