"""Greedy packing of whole lines into partitions that parse independently."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.errors import ConfigurationError
from tracewright.functions.text import frame
from tracewright.schema import PARTITIONS
from tracewright.sources.lines import documents


@dataclass(frozen=True)
class Part:
    number: int
    start_line: int
    start_offset: int
    text: str


def pack_records(records: Iterator[str], max_lines: int = 1000, max_bytes: int = 1 << 20, offset: int = 0) -> Iterator[Part]:
    """Parts of at most ``max_lines`` lines and ``max_bytes`` bytes; terminators become LF.

    A record may hold at most one terminator; one too large for any part is an error. Every part
    but the last ends in LF.
    """
    if max_lines < 1 or max_bytes < 1:
        raise ConfigurationError("limits must be positive")
    held: list[str] = []
    size, number, first, at, line = 0, 0, 1, offset, 0
    for line, record in enumerate(records, 1):  # noqa: B007
        framed = list(frame(record))
        if len(framed) > 1:
            raise ValueError(f"record {line} must hold exactly one line")
        body = framed[0][0] if framed else ""
        width = len(body.encode()) + 1
        if width > max_bytes:
            raise ValueError(f"line {line} has {width} bytes; a partition holds {max_bytes}")
        if held and (len(held) == max_lines or size + width > max_bytes):
            yield Part(number, first, at, "\n".join(held) + "\n")
            number, first, at, held, size = number + 1, line, at + size, [], 0
        held.append(body)
        size += width
    if held:
        yield Part(number, first, at, "\n".join(held))


class LinePartitioner:
    """Partitioner for parsers that read line by line."""

    framing = "line"

    def __init__(self, max_lines: int = 1000, max_bytes: int = 1 << 20):
        self.max_lines, self.max_bytes = max_lines, max_bytes

    def partition(self, df: DataFrame, capabilities=None) -> DataFrame:
        """A row per part: source_id, partition_id, start_line, source_offset and text."""
        if capabilities is not None:
            capabilities.require_framing(self.framing)
        most_lines, most_bytes = self.max_lines, self.max_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, Part]]:
            for batch in batches:
                for source, text, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for p in pack_records((line for line, _ in frame(text or "")), most_lines, most_bytes, offset or 0):
                        yield source, p

        return documents(df).select("source_id", "text", "source_offset").mapInArrow(lambda batches: _batched(run(batches)), PARTITIONS)


def partition_by(df: DataFrame, split: Callable[[str], Iterator[Part]]) -> DataFrame:
    """Partitions by a user's function from a document's text to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, Part]]:
        for batch in batches:
            for source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for p in split(text or ""):
                    yield source, p

    return documents(df).select("source_id", "text").mapInArrow(lambda batches: _batched(run(batches)), PARTITIONS)


def _batched(parts: Iterator[tuple[str | None, Part]], most_rows: int = 5000, most_chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of parts in record batches of bounded size."""
    held, chars = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(*((s, str(p.number), p.start_line, p.start_offset, p.text) for s, p in held), strict=True)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["source_id", "partition_id", "start_line", "source_offset", "text"])

    for source, p in parts:
        held.append((source, p))
        chars += len(p.text)
        if len(held) >= most_rows or chars >= most_chars:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def rebase(events: DataFrame, partitions: DataFrame) -> DataFrame:
    """Events of parts with document line numbers, ordered per source by part and position."""
    starts = partitions.select(F.col("source_id").alias("s"), F.col("partition_id").alias("p"), "start_line")
    joined = events.join(starts, F.col("source_id").eqNullSafe(F.col("s")) & (F.col("evidence.partition_id") == F.col("p")))
    moved = F.col("evidence").withField("line_number", F.col("evidence.line_number") + F.col("start_line") - 1)
    return joined.withColumn("evidence", moved).withColumn("seq", F.shiftleft(F.col("p").cast("bigint"), 32) + F.col("seq")).drop("s", "p", "start_line")
