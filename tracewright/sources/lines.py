"""Documents to lines with byte spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions.text import LINE_PATTERN, frame, strip_line, valid_source
from tracewright.schema import LINES

#: Lines that leave a worker in one batch.
BATCH_LINES = 20_000


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: ``source_id`` (their path) and ``text``; bytes that are not UTF-8 raise."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_id"), valid_source(F.col("content")).alias("text"))


def documents(df: DataFrame) -> DataFrame:
    """Columns source_id, text, correlation_id, partition_id and source_offset; what is missing becomes null.

    A ``content`` column stands for ``text`` and is decoded strictly.
    """
    text = F.col("text") if "text" in df.columns else valid_source(F.col("content"))
    rest = {"correlation_id": "string", "partition_id": "string", "source_offset": "bigint"}
    return df.select(F.col("source_id").cast("string").alias("source_id"), text.alias("text"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in rest.items()])


def frame_lines(df: DataFrame) -> DataFrame:
    """A row per line; offsets start at ``source_offset`` (default 0), line numbers at 1. Null texts have no lines."""
    docs = documents(df).select("source_id", "text", "source_offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["source_id", "line_number", "text", "start_offset", "end_offset"])
            for x in out:
                x.clear()
            return made

        for batch in batches:
            for source, text, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = offset or 0
                for number, (line, width) in enumerate(frame(text or ""), 1):
                    for x, v in zip(out, (source, number, line, at, at + width), strict=True):
                        x.append(v)
                    at += width
                    if len(out[0]) >= BATCH_LINES:
                        yield batch_of()
        if out[0]:
            yield batch_of()

    return docs.mapInArrow(run, LINES)


def frame_lines_native(df: DataFrame) -> DataFrame:
    """The same rows by Catalyst expressions alone. Summing widths sorts each document's lines, so this is the slower way."""
    docs = documents(df).where("text is not null").withColumn("__doc", F.monotonically_increasing_id())
    parts = F.regexp_extract_all("text", F.lit(LINE_PATTERN), F.lit(0))
    rows = docs.select("source_id", "__doc", F.coalesce("source_offset", F.lit(0)).alias("base"), F.posexplode(parts).alias("pos", "part"))
    width = F.octet_length("part").cast("bigint")
    end = F.col("base") + F.sum(width).over(Window.partitionBy("__doc").orderBy("pos"))
    rows = rows.withColumns({"end_offset": end, "width": width})
    return rows.select("source_id", (F.col("pos") + 1).cast("bigint").alias("line_number"), strip_line(F.col("part")).alias("text"), (F.col("end_offset") - F.col("width")).alias("start_offset"), "end_offset")


def line_widths(lines: DataFrame) -> DataFrame:
    """Byte width of each line, terminator included."""
    return lines.withColumn("width", F.col("end_offset") - F.col("start_offset"))
