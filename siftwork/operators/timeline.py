"""What held at a row's own time: the latest row before it, the rows just before it, and a cooldown that only issues start.

A key may hold a third of all rows. So time is cut into slots, and a task holds a key's rows of one slot: what a slot takes over
from those before it is worked out from one small row for each slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siftwork.functions.clock import microseconds

DAY = 86_400


def micros(time: Column) -> Column:
    return microseconds(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)


def slot_of(time: Column, seconds: int) -> Column:
    return F.floor(micros(time) / (seconds * 1_000_000))


def as_of(requests: DataFrame, rows: DataFrame, keys: list[str], at: str, time: str, tie: str, into: str, seconds: int = 30 * DAY, at_tie: str | None = None) -> DataFrame:
    """Adds `into` to requests: the row of the same keys with the greatest (time, tie) not after `at`, as a struct; null if there is none.

    A row exactly at that time counts; given at_tie, a column of requests, only if its tie is not greater. Rows without a key or time match nothing; requests without one get null.
    """
    rest = [c for c in rows.columns if c not in (*keys, time, tie)]
    whole = rows.where(F.greatest(*[F.col(c).isNull().cast("int") for c in (*keys, time)], F.lit(0)) == 0)
    known = whole.select(*keys, F.col(time).alias("__t"), (F.lit(0) if at_tie is None else F.col(tie)).alias("__tie"), slot_of(F.col(time), seconds).alias("__slot"), F.struct(time, tie, *rest).alias("__row"))
    asked = requests.select(*keys, F.col(at).alias("__t"), (F.lit(0) if at_tie is None else F.col(at_tie)).alias("__tie"), slot_of(F.col(at), seconds).alias("__slot"), F.struct(*requests.columns).alias("__asked"))
    # The latest row of each slot that has any, and with it of all slots before one.
    slots = known.groupBy(*keys, "__slot").agg(F.max("__row").alias("__best"))
    slots = slots.unionByName(asked.select(*keys, "__slot").distinct(), allowMissingColumns=True).groupBy(*keys, "__slot").agg(F.max("__best").alias("__best"))
    before = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(*keys, "__slot", F.max("__best").over(before).alias("__carried"))
    both = known.withColumn("__kind", F.lit(0)).unionByName(asked.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    within = Window.partitionBy(*keys, "__slot").orderBy("__t", "__tie", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__own", F.max("__row").over(within)).where("__kind = 1").join(carried, [*keys, "__slot"], "left")
    return found.select("__asked.*", F.coalesce("__own", "__carried").alias(into))


def rows_before(rows: DataFrame, keys: list[str], order: str, tie: str, most: int, into: str, slot: Column) -> DataFrame:
    """Adds `into` to rows: the up to `most` rows of the same keys just before each by (order, tie), oldest first, as structs.

    slot must not fall where order rises. A slot needs the last rows of the slots before it, of `most` such slots at most.
    """
    shown = F.struct(*rows.columns)
    placed = rows.withColumn("__slot", slot)
    by = [F.col(order).asc_nulls_first(), F.col(tie).asc_nulls_first()]
    last = placed.withColumn("__place", F.row_number().over(Window.partitionBy(*keys, "__slot").orderBy(F.col(order).desc_nulls_last(), F.col(tie).desc_nulls_last()))).where(F.col("__place") <= most)
    ends = last.groupBy(*keys, "__slot").agg(F.sort_array(F.collect_list(F.struct((-F.col("__place")).alias("p"), shown.alias("r")))).alias("__ends"))
    ends = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__slot").alias("__s"), F.transform("__ends", lambda e: e["r"]).alias("__ends"))
    named = [f"__k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*named).orderBy(F.col("__s").asc_nulls_first()).rowsBetween(-most, -1)
    carried = ends.select(*named, "__s", F.flatten(F.collect_list("__ends").over(before)).alias("__carried"))
    within = Window.partitionBy(*keys, "__slot").orderBy(*by).rowsBetween(-most, -1)
    own = placed.withColumn("__own", F.collect_list(shown).over(within))
    same = F.col("__slot").eqNullSafe(F.col("__s"))
    for name, key in zip(named, keys, strict=True):
        same &= F.col(key).eqNullSafe(F.col(name))
    all_ = F.concat("__carried", "__own")
    return own.join(carried, same).select(*rows.columns, F.slice(all_, F.greatest(F.size(all_) - (most - 1), F.lit(1)), most).alias(into))


class _Sorted:
    """The rows of a task's sorted batches, group by group, a group's columns as lists; batches may cut groups."""

    def __init__(self, batches: Iterator[pa.RecordBatch], keys: int):
        self.batches, self.keys = batches, keys

    def __iter__(self) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in self.batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(self.keys)), strict=True))
            start = 0
            for i, k in enumerate(names):
                if k != key:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield key, held
                    held, key, start = [], k, i
            if start < len(names):
                held.append(batch.slice(start))
        if held:
            yield key, held


def _times(parts: list[pa.RecordBatch], at: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([np.asarray(p.column(i)) for p in parts]) for i in (at, at + 1))


def transfer(t: np.ndarray, forced: np.ndarray, interval: int) -> tuple[list[int], list[int]]:
    """When a slot's last issue is, by when the last one before it was: exits[k] for one up to bounds[k], none if it is later than all.

    t ascends. Each row issues if forced, or if so long has passed since the last issue.
    """
    n = len(t)
    nth = np.append(np.flatnonzero(forced), n)
    later = np.minimum(np.searchsorted(t, t + interval), nth[np.searchsorted(nth, np.arange(n), "right")] if n else t).tolist()
    end = t.tolist()
    for j in range(n - 1, -1, -1):
        if later[j] < n:
            end[j] = end[later[j]]
    bounds: list[int] = []
    exits: list[int] = []
    for k in range(n):
        bound = int(t[k]) - interval if not forced[k] else 2**62
        if exits and exits[-1] == end[k]:
            bounds[-1] = bound
        else:
            bounds.append(bound)
            exits.append(end[k])
        if bound >= t[0]:
            break
    return bounds, exits


def cooled(rows: DataFrame, keys: list[str], time: str, tie: str, minutes: int, forced: Column | None = None, seconds: int = 7 * DAY) -> DataFrame:
    """Adds limited and last_issue to rows: in the order of (time, tie) of each key a row issues unless the last issue is too recent.

    Only issues start an interval, so a limited row does not prolong it; at its very end a row may issue. Rows where forced holds always
    issue, as what was issued already does. last_issue is the time of the last issue before the row, null if there is none.
    Rows without a key or a time are not limited and start nothing.

    The last issue of a slot is a step function of that before it. These functions are chained for each key; then each
    slot is gone through once, knowing where it begins.
    """
    interval = minutes * 60_000_000
    always = F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)
    bad = F.greatest(*[F.col(c).isNull().cast("int") for c in (*keys, time)], F.lit(0)) == 1
    named = [f"__k{i}" for i in range(len(keys))]
    kinds = dict(rows.dtypes)
    key_types = ", ".join(f"{n} {kinds[k]}" for n, k in zip(named, keys, strict=True))
    placed = rows.where(~bad).select(*[F.col(k).alias(n) for n, k in zip(named, keys, strict=True)], slot_of(F.col(time), seconds).alias("__slot"), micros(F.col(time)).alias("__t"), always.alias("__forced"), F.col(tie).alias("__tie"), F.struct(*rows.columns).alias("__row"))
    group, width = [*named, "__slot"], len(named) + 1

    step_ddl = f"{key_types}, __slot long, bounds array<long>, exits array<long>"
    entry_ddl = f"{key_types}, __slot long, __entry long"

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, parts in _Sorted(batches, width):
            out.append((*key, *transfer(*_times(parts, width), interval)))
            if len(out) == 1000:
                yield _batch(out, step_types)
                out = []
        if out:
            yield _batch(out, step_types)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _Sorted(batches, width - 1):
            last, out = None, []
            for p in parts:
                for slot, bounds, exits in zip(*(p.column(i).to_pylist() for i in range(width - 1, width + 2)), strict=True):
                    out.append((*key, slot, last))
                    at = 0 if last is None else int(np.searchsorted(bounds, last))
                    last = exits[at] if at < len(exits) else last
            yield _batch(out, entry_types)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            limited, before, own = [], [], []
            for i, (t, is_forced, entry) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(width, width + 3)), strict=True)):
                if t is None:  # where a slot begins
                    last = entry
                    continue
                own.append(i)
                before.append(last)
                limited.append(not is_forced and last is not None and t < last + interval)
                if not limited[-1]:
                    last = t
            yield pa.RecordBatch.from_arrays([batch.column(width + 3).take(pa.array(own, pa.int64())), pa.array(limited, pa.bool_()), pa.array(before, pa.int64())], names=["__row", "limited", "__last"])

    step_types, entry_types = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (step_ddl, entry_ddl))
    times = placed.select(*group, "__t", "__forced", "__tie").repartition(*group).sortWithinPartitions(*group, "__t", F.desc("__forced"), "__tie")
    steps = times.mapInArrow(functions, step_ddl)
    entries = steps.repartition(*named).sortWithinPartitions(*group).mapInArrow(chained, entry_ddl)
    # A slot's entry comes as a row without a time, before its others: a join would leave it to the planner how a slot's rows are dealt.
    begun = placed.unionByName(entries, allowMissingColumns=True).repartition(*group)
    ready = begun.sortWithinPartitions(*group, F.col("__t").asc_nulls_first(), F.desc("__forced"), "__tie").select(*group, "__t", "__forced", "__entry", "__row")
    # The row is null-free as a whole but its fields may be null.
    done = ready.mapInArrow(decided, f"__row {ready.schema['__row'].dataType.simpleString()}, limited boolean, __last long")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    since = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("__last") / 1_000_000).cast("decimal(18,6)"))
    free = rows.where(bad).select(*rows.columns, F.lit(False).alias("limited"), F.lit(None).cast("timestamp_ntz").alias("last_issue"))
    return done.select("__row.*", "limited", since.alias("last_issue")).unionByName(free)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
