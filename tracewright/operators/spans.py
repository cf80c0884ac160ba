"""Lines against event spans, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spans and lines meet in buckets of this many bytes, so the range join is an equality join.
BUCKET = 1 << 14


def covered_lines(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Lines whose first byte lies in a span of an event of their source, once each."""
    return _by_span(lines, events, "left_semi")


def uncovered_lines(lines: DataFrame, events: DataFrame) -> DataFrame:
    """The other lines."""
    return _by_span(lines, events, "left_anti")


def _by_span(lines: DataFrame, events: DataFrame, how: str) -> DataFrame:
    spans = events.select(F.col("source_id").alias("s"), F.col("evidence.start_offset").alias("a"), F.col("evidence.end_offset").alias("b")).where("a < b")
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / BUCKET), F.floor((F.col("b") - 1) / BUCKET))))
    at = lines.withColumn("line_bucket", F.floor(F.col("start_offset") / BUCKET))
    hit = F.col("source_id").eqNullSafe(F.col("s")) & (F.col("line_bucket") == F.col("bucket")) & (F.col("start_offset") >= F.col("a")) & (F.col("start_offset") < F.col("b"))
    return at.join(spans, hit, how).drop("line_bucket")


def interleaving(facts: DataFrame, owner: str = "event_type", order: str = "line_number") -> DataFrame:
    """Per source: whether some owner's rows are interrupted by another's and resumed."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("source_id").orderBy(order, owner)
    runs = facts.withColumn("begins", F.when(F.lag(owner).over(w).eqNullSafe(F.col(owner)), 0).otherwise(1))
    per = runs.groupBy("source_id", owner).agg(F.sum("begins").alias("runs"))
    return per.groupBy("source_id").agg((F.max("runs") > 1).alias("interleaved"))
