"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source's documents, in ``doc_id`` order, form a queue of tokens cut into quanta. A queue earns
credit at its target rate; the next slot of a window goes to the queue whose credit first reaches
half a quantum beyond what it was served (ties: first source). What a queue has earned beyond its
service is its deficit, which passes from window to window, so no queue is ever a whole quantum from
its target, and when a queue is empty the others share its slots. The schedule depends only on the
queues' lengths, so the slot of quantum k of a source is a sum over the sources, and every task
places its own documents: deficits pass between partitions without one task seeing the stream.
The remainders of the queues, each under a quantum, fill the last windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, release_memory, shuffle_partitions, written
from .token_files import END_ID, WORD_BPE
from .token_ids import encoder, tokenizer_path

SEQUENCE = 4096
QUANTUM = 512
#: Weights are scaled to at most this, so that weight times quantum number fits 64 bits.
TOP_WEIGHT = 1 << 20


def tokenize_queues(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Written table of the documents' ids in queue order (source, doc_id, text hash).

    ``part`` numbers the sorted parts and ``before`` counts the source's tokens earlier in the part.
    Ids are stored in the fewest whole bytes that hold the vocabulary.
    """
    rows = docs.select(F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "source", "doc_id", "h").sortWithinPartitions("source", "doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, upto = encoder(tokenizer), TaskContext.get().partitionId(), {}
        kind = "<u2" if max(enc.vocab_size, end_id + 1) <= 1 << 16 else "<u4"
        for whole in batches:
            for batch in bounded(whole, 2):
                ids, counts = enc.encode(batch.column(2), end_id)
                ids, ends = ids.astype(kind), np.cumsum(counts)
                before = []
                for s, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                    before.append(upto.get(s, 0))
                    upto[s] = before[-1] + n
                packed = [ids[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(packed), pa.int32()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array([ids.itemsize] * len(packed), pa.int32()), pa.array(packed, pa.binary())], names=NAMES)
        release_memory()

    return written(dealt.mapInArrow(run, "source string, doc_id long, part int, before long, n_tokens long, width int, ids binary"), "queues")


NAMES = ["source", "doc_id", "part", "before", "n_tokens", "width", "ids"]


class Schedule:
    """Places of all tokens. ``lengths``: tokens by source; ``targets``: wanted share by source (default: its share of the tokens)."""

    def __init__(self, lengths: dict, targets: dict | None = None, sequence: int = SEQUENCE, quantum: int = QUANTUM):
        if sequence % quantum:
            raise ValueError("a sequence must be a whole number of quanta")
        self.sequence, self.quantum = sequence, quantum
        self.sources = sorted(lengths, key=lambda s: (s is not None, s or ""))
        self.number = {s: i for i, s in enumerate(self.sources)}
        n = [lengths[s] for s in self.sources]
        share = [float((targets or lengths).get(s, 0)) for s in self.sources]
        top = max([*share, 1e-300])
        self.weights = np.array([max(1, round(x / top * TOP_WEIGHT)) for x in share], np.int64)
        self.quanta = np.array([x // quantum for x in n], np.int64)
        rest = np.array([x % quantum for x in n], np.int64)
        self.tails = int(self.quanta.sum()) * quantum + np.cumsum(rest) - rest

    def slots(self, source: int, k: np.ndarray) -> np.ndarray:
        """The slot of full quantum ``k`` of a source: how many quanta are served before it."""
        own, out = int(self.weights[source]), np.zeros(len(k), np.int64)
        for other, (w, n) in enumerate(zip(self.weights.tolist(), self.quanta.tolist(), strict=True)):
            if other == source:
                out += k
                continue
            x = (2 * k + 1) * w  # quantum j of the other is earlier if (2 j + 1) * own is less than this, or equal in an earlier source
            count = (x // own + 1) // 2 if other < source else -(-x // own) // 2
            out += np.minimum(count, n)
        return out

    def pieces(self, source: int, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces (document, start in it, length, place) of documents at ``starts`` of a source's queue."""
        q = self.quantum
        first, last = starts // q, (starts + lengths - 1) // q
        n = last - first + 1
        doc = np.repeat(np.arange(len(starts)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        a = np.maximum(k * q, starts[doc])
        b = np.minimum((k + 1) * q, (starts + lengths)[doc])
        tail = k >= self.quanta[source]
        place = np.where(tail, self.tails[source], 0) + (a - k * q)
        place[~tail] += self.slots(source, k[~tail]) * q
        length = b - a
        # A remainder may cross a sequence's end; quanta never do.
        over = np.maximum(place % self.sequence + length - self.sequence, 0)
        cut = over > 0
        doc, a, place, length = (np.concatenate(x) for x in ((doc, doc[cut]), (a, (b - over)[cut]), (place, (place + length - over)[cut]), (length - over, over[cut])))
        order = np.lexsort((a, doc))
        doc, a, place, length = doc[order], a[order], place[order], length[order]
        # Neighbours in both the document and the same sequence are one piece.
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + length[:-1]) | (place[1:] // self.sequence != place[:-1] // self.sequence)
        at = np.flatnonzero(new)
        total = np.add.reduceat(length, at) if len(at) else length
        return doc[at], a[at] - starts[doc[at]], total, place[at]


def pack(docs: DataFrame, tokenizer: str, *, targets: dict | None = None, sequence: int = SEQUENCE, quantum: int = QUANTUM, end_id: int = END_ID, max_sources: int = 100_000, **columns: str) -> DataFrame:
    """Pieces of all documents: doc_id, source, start, length, doc_tokens, sequence_id, offset and ids (u32, little-endian).

    Every sequence but the last is full. A null text is an empty one (its end id alone), a null
    source is a queue of its own. More sources than ``max_sources`` raise ValueError, as one total
    a source reaches the driver.
    """
    queues = tokenize_queues(docs, tokenizer, end_id=end_id, **columns)
    sums = queues.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy("source").orderBy("part")
    bases = written(sums.withColumns({"base": F.sum("n").over(w) - F.col("n"), "total": F.sum("n").over(Window.partitionBy("source"))}), "queue-bases")
    totals = bases.groupBy("source").agg(F.max("total").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    plan = Schedule({r["source"]: r["n"] for r in totals}, targets, sequence, quantum)
    bases = bases.select(F.col("source").alias("s"), F.col("part").alias("p"), "base")
    placed = queues.join(bases, (queues["part"] == bases["p"]) & queues["source"].eqNullSafe(bases["s"]), "left")
    rows = placed.select("source", "doc_id", (F.col("base") + F.col("before")).alias("at"), "n_tokens", "width", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, 5):
                sources = np.array([plan.number[s] for s in batch.column(0).to_pylist()], np.int64)
                at, n = (batch.column(i).to_numpy() for i in (2, 3))
                width, blobs = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                for s in np.unique(sources).tolist():
                    mine = np.flatnonzero(sources == s)
                    doc, start, length, place = plan.pieces(s, at[mine], n[mine])
                    row = mine[doc]
                    ids = [np.frombuffer(blobs[r], f"<u{width[r]}", m, a * width[r]).astype("<u4").tobytes() for r, a, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(0).take(take), pa.array(start), pa.array(length), pa.array(n[row]), pa.array(place // sequence), pa.array(place % sequence), pa.array(ids, pa.binary())], names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return rows.mapInArrow(run, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, each with the corpus's mixture of sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return digest(pack(docs, tokenizer_path(WORD_BPE)))
