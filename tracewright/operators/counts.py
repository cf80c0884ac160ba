"""Lossy counts of events, mergeable in any order."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.strict_json import canonical, loads

KEY = ["event_type", "key_attributes_json"]
COUNTS = "event_type string, key_attributes_json string, count bigint, first_seen string, last_seen string, first_ts timestamp, last_ts timestamp"


def with_key(events: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Append ``key_attributes_json``: the chosen attributes as canonical JSON, a missing one null.

    The key is text, so ``true``, ``1``, ``1.0`` and ``"1"`` differ.
    """
    names = sorted(set(group_by))
    if not names:
        return events.withColumn("key_attributes_json", F.lit("{}"))

    @F.arrow_udf("string")
    def chosen(attributes: pa.Array) -> pa.Array:
        return pa.array([canonical({n: (a := loads(x)).get(n) for n in names}) for x in attributes.to_pylist()], pa.string())

    return events.withColumn("key_attributes_json", chosen("attributes_json"))


def count_events(events: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """A row per event type and chosen attributes: count, first and last time seen (ISO text and instant).

    Partial aggregation runs before the shuffle, so a common event type sends one row a task.
    """
    rows = with_key(events, group_by).select(*KEY, F.col("timestamp_iso").alias("first_seen"), F.col("timestamp_iso").alias("last_seen"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"))
    return rows.groupBy(*KEY).agg(*_with_times(F.lit(1)))


def merge_counts(*partials: DataFrame) -> DataFrame:
    """Counts of partial counts; associative and commutative."""
    whole = partials[0]
    for p in partials[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*KEY).agg(*_with_times(F.col("count")))


def _with_times(n: Column) -> list[Column]:
    # Events without a time count but do not decide when something was seen.
    first = F.when(F.col("first_ts").isNotNull(), F.struct("first_ts", "first_seen"))
    last = F.when(F.col("last_ts").isNotNull(), F.struct("last_ts", "last_seen"))
    return [
        F.sum(n).cast("bigint").alias("count"), F.min(first).getField("first_seen").alias("first_seen"), F.max(last).getField("last_seen").alias("last_seen"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    ]


def ordered(counts: DataFrame) -> DataFrame:
    """In code-point order of event type and key."""
    return counts.orderBy(*KEY)


class CountAccumulator:
    """Counts that grow batch by batch on the driver's side of a stream; state is one row a group."""

    def __init__(self) -> None:
        self.counts: DataFrame | None = None

    def add(self, events: DataFrame, group_by: Sequence[str] = ()) -> None:
        more = count_events(events, group_by)
        merged = more if self.counts is None else merge_counts(self.counts, more)
        rows = merged.collect()  # one row a group
        self.counts = events.sparkSession.createDataFrame(rows, COUNTS)

    def result(self) -> DataFrame:
        if self.counts is None:
            raise ValueError("nothing was added")
        return ordered(self.counts)

