"""Token-id files: every id in the fewest bits that hold the vocabulary, in blocks with offsets.

A file is: magic, then blocks of ``BLOCK_IDS`` ids packed little-endian at ``bits`` a piece and
padded to a byte, then the block offsets (u64), the documents' ids (i64, with a validity byte each)
and token counts (u64), and a fixed-size footer with the places of these tables. Any id range is
read by seeking to its blocks and unpacking them with numpy.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded, shared_dir, shuffle_partitions, written
from .token_ids import encoder, tokenizer_path

MAGIC = b"TWIDS001"
FOOTER = struct.Struct("<IIQQQQ8s")  # bits, ids a block, ids, blocks, documents, place of the tables, magic
BLOCK_IDS = 8192
#: A writer begins a new file after the document that passes this many ids.
FILE_IDS = 1 << 25
#: Ids that a reader holds at once.
READ_IDS = 1 << 20
WORD_BPE = "word_bpe_49k.json"
END_ID = 2


def bits_for(vocab_size: int) -> int:
    return max(1, (max(vocab_size, 1) - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` each, lowest bit first, padded to a whole byte."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit into {bits} bits")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    wide = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a packed block."""
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4").astype(np.uint32)


class TokenFileWriter:
    def __init__(self, out, vocab_size: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits_for(vocab_size), block_ids
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.at = len(MAGIC)
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= 64 * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.waiting, np.zeros(0, np.uint32)])
        full = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for i in range(0, full, self.block_ids):
            data = pack_bits(ids[i : min(i + self.block_ids, full)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        valid = np.array([d is not None for d in self.docs], np.uint8)
        for table in (np.array(self.offsets, "<u8"), np.array([d or 0 for d in self.docs], "<i8"), valid, np.array(self.counts, "<u8")):
            self.out.write(table.tobytes())
        self.out.write(FOOTER.pack(self.bits, self.block_ids, self.n_ids, len(self.offsets), len(self.docs), self.at, MAGIC))
        self.out.close()


class TokenFile:
    """Random access to a token-id file, opened by any object with ``seek`` and ``read``."""

    def __init__(self, source, size: int):
        self.source = source
        self.bits, self.block_ids, self.n_ids, n_blocks, n_docs, self.tables, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        data, at = self._at(self.tables, size - FOOTER.size - self.tables), 0

        def table(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.offsets, docs, valid, self.counts = table("<u8", n_blocks), table("<i8", n_docs), table("u1", n_docs), table("<u8", n_docs)
        self.docs = [int(d) if v else None for d, v in zip(docs, valid, strict=True)]

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(int(place))
        return self.source.read(int(n))

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the file; reads the blocks that hold them."""
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.tables
        data = self._at(self.offsets[first], end - int(self.offsets[first]))
        base, parts = int(self.offsets[first]), []
        for k in range(first, last + 1):
            a = int(self.offsets[k]) - base
            b = (int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else self.tables) - base
            parts.append(unpack_bits(data[a:b], min(self.block_ids, self.n_ids - k * self.block_ids), self.bits))
        return np.concatenate(parts)[start - first * self.block_ids :][:count]


MANIFEST = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents in ascending ``doc_id`` order and return the manifest, a row per file.

    Null ids come first, repeated ids are ordered by their text's hash, a null text is an empty
    one. A retried task writes under another name; only files in the manifest count.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "d", "h").sortWithinPartitions("d", "h").select("d", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, fs, root = encoder(tokenizer), *pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, writer, path, done = TaskContext.get().partitionId(), None, "", []

        def close() -> None:
            writer.close()
            done.append((part, len(done), path, len(writer.docs), writer.n_ids))

        for whole in batches:
            for batch in bounded(whole, 1):
                ids, counts = enc.encode(batch.column(1), end_id)
                ends = np.cumsum(counts)
                for d, a, b in zip(batch.column(0).to_pylist(), ends - counts, ends, strict=True):
                    if writer is None:
                        path = f"{root}/part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.ids"
                        writer = TokenFileWriter(fs.open_output_stream(path), max(enc.vocab_size, end_id + 1))
                    writer.add(d, ids[a:b])
                    if writer.n_ids >= FILE_IDS:
                        close()
                        writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=MANIFEST.names)

    return written(dealt.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids before it in all files), ``n_tokens`` and ``ids_crc32``."""
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))  # a row per file
    spread = based.select("path", "base").repartition(shuffle_partitions(manifest.sparkSession), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    f = TokenFile(source, source.size())
                    yield from _summaries(f, base)

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _summaries(f: TokenFile, base: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    counts = f.counts.astype(np.int64)
    starts = np.cumsum(counts) - counts
    crc, at, held = [], 0, np.zeros(0, np.uint32)  # held: ids from at on
    for s, n in zip(starts.tolist(), counts.tolist(), strict=True):
        done, value = 0, 0
        while True:
            if s + done >= at + len(held) and done < n:
                at += len(held)
                held = f.ids(at, min(READ_IDS, f.n_ids - at))
            part = held[s + done - at : s + n - at]
            value, done = zlib.crc32(part.astype("<u4").tobytes(), value), done + len(part)
            if done == n:
                break
        crc.append(value & 0xFFFFFFFF)
    for i in range(0, len(crc), rows):
        yield pa.RecordBatch.from_arrays([pa.array(f.docs[i : i + rows], pa.int64()), pa.array(base + starts[i : i + rows], pa.int64()), pa.array(counts[i : i + rows], pa.int64()), pa.array(crc[i : i + rows], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document through the packed files and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = shared_dir(spark, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer_path(WORD_BPE)), folder)
