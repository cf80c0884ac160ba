"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.sources.tables import forget, shared_dir, written

__all__ = ["bounded", "forget", "likely", "map_columns", "ragged", "release_memory", "shared_dir", "shuffle_partitions", "text_bytes", "worker_state", "written"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the bitmap of ``likely``, and of each of Spark's bitmaps that it consists of.
MEMBER_BITS, BITMAP_BITS = 1 << 24, 1 << 15


def likely(rows: DataFrame, column: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose ``column`` may be among ``members``, so that a join with these shuffles no others.

    The bitmap of hashed members has ``MEMBER_BITS`` bits whatever the input, so its broadcast is bounded
    by 2 MB; a fuller bitmap only lets more rows pass to the join that decides.
    """
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(MEMBER_BITS))
    bits = members.select(at(member).alias("bit")).groupBy(F.floor(F.col("bit") / BITMAP_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP_BITS).alias("bits"))
    place = at(column) % BITMAP_BITS
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = rows.withColumns({"bucket_of": F.floor(at(column) / BITMAP_BITS), "place": place}).join(F.broadcast(bits.withColumnRenamed("bucket", "k")), F.col("bucket_of") == F.col("k"))
    return near.where((byte / F.pow(F.lit(2), F.col("place") % 8)).cast("int") % 2 == 1).select(*rows.columns)


def map_columns(
    df: DataFrame, columns: list[str], fields: list[T.StructField], fn: Callable[..., list[pa.Array]], drop: Iterable[str] = ()
) -> DataFrame:
    """Append the Arrow arrays that ``fn`` returns for each batch of ``columns``.

    Columns of ``df`` named like a new field or listed in ``drop`` are left out of the result.
    """
    gone = {f.name for f in fields} | set(drop)
    keep = [c for c in df.columns if c not in gone]
    # Each column is sent once, though it be both read and kept: texts fill most of a worker's batch.
    sent = list(dict.fromkeys([*columns, *keep]))
    at = {c: i for i, c in enumerate(sent)}
    inner = df.select(*[F.col(f"`{c}`") for c in sent])
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, 0):
                arrays = [batch.column(at[c]) for c in keep] + fn(*[batch.column(at[c]) for c in columns])
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        release_memory()

    return inner.mapInArrow(run, schema)


_STATE: dict = {}


def worker_state(key: tuple, make: Callable):
    """What ``make`` returns, kept by this worker until it is asked for another key.

    Python workers outlive stages, so a worker keeps one such object, that of its present stage.
    """
    if _STATE.get("key") != key:
        _STATE.clear()
        release_memory()
        _STATE.update(key=key, made=make())
    return _STATE["made"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins and the last ends; a null has no bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def release_memory() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and serve later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[starts[i]:starts[i] + lengths[i]]`` for all i."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)]


def bounded(batch: pa.RecordBatch, column: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts in ``column`` take about ``max_bytes`` or are a single row."""
    col = batch.column(column)
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(upto):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + max_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end
