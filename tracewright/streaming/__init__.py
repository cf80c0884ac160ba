"""Parsing and counting of streams of documents.

A document must arrive whole (one file, one row). Parsing keeps no state; counts grow by group; a
parser that needs order sees each source's lines in order through keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.functions.text import valid_source
from tracewright.operators.parsing import Parser, parse_documents
from tracewright.sources.lines import frame_lines

FILES = "path string, modificationTime timestamp, length long, content binary"


def document_stream(spark: SparkSession, path: str, *, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """Whole files as they arrive: source_id and text. The limits bound a micro-batch."""
    reader = spark.readStream.format("binaryFile").schema(FILES)
    for k, v in (("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes)):
        reader = reader.option(k, v) if v is not None else reader
    return reader.load(path).select(F.col("path").alias("source_id"), valid_source(F.col("content")).alias("text"))


def parse_stream(documents: DataFrame, parser: Parser, *, continue_on_error: bool = True) -> DataFrame:
    """Events of a stream of documents, by Catalyst where the parser has a native form."""
    native = parser.native(frame_lines(documents))
    if native is not None:
        return native
    return parse_documents(documents.withColumn("input_index", F.lit(0)), parser, continue_on_error=continue_on_error).events


def running_counts(events: DataFrame) -> DataFrame:
    """Counts by event type so far; write with output mode complete or update. State is a row a type."""
    return events.groupBy("event_type").agg(F.count("*").alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def write_batches(events: DataFrame, path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Append events to Parquet exactly once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ordered_parse(lines: DataFrame, step: Callable[[Any, str], tuple[Any, list[str]]], initial: str = "") -> DataFrame:
    """Run a stateful line parser over each source's lines (source_id, line_number, text).

    ``step`` takes the state text and a line and gives the new state and event types. Lines of a
    micro-batch are taken in order of their numbers; the state of a source is one text.
    """

    def run(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        value = state.get[0] if state.exists else initial
        rows = pd.concat(list(batches)).sort_values("line_number")
        out = []
        for number, text in zip(rows["line_number"], rows["text"], strict=True):
            value, found = step(value, text)
            out += [(key[0], int(number), e) for e in found]
        state.update((value,))
        yield pd.DataFrame(out, columns=["source_id", "line_number", "event_type"])

    return lines.groupBy("source_id").applyInPandasWithState(run, "source_id string, line_number long, event_type string", "state string", "append", GroupStateTimeout.NoTimeout)
