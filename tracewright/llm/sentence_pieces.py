"""SentencePiece encoding for merge-type vocabularies, and decoding.

A text's symbols are merged by an agenda of adjacent pairs ordered by score (ties: leftmost). No
merge crosses a word mark if no piece has the mark after another character, so the agendas then run
once for each different word of an Arrow batch, all words in step. In every Arrow batch all its
words, and one whole text, are compared with the sentencepiece library; a difference raises an
error. Decoding is the library's. Nothing is kept from batch to batch but the vocabulary.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns, ragged, text_bytes, worker_state
from .pair_merges import LONGEST, PairTable
from .token_ids import tokenizer_path

MARK = "▁"
MODEL = "piece_bpe_32k.model"


class PieceEncoder:
    """Ids of whole texts; one object a worker and model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)]
        reserved = set(special)
        self.ids = {sp.id_to_piece(i): i for i in range(n) if i not in reserved}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.unused = {p for p, i in self.ids.items() if sp.is_unused(i)}
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in special if sp.is_byte(i)}
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        if sp.normalize("a  b\tc") != f"{MARK}a{MARK}{MARK}b\tc":
            raise ValueError("only models that keep texts as they are, with a word mark in front, are supported")
        self.by_word = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.n_pieces = n
        self.table = None if self.unused or not self.by_word else self._table()

    def _symbol(self, text: str) -> int | None:
        """The number of a piece, or of a character that is none."""
        return self.ids.get(text, self.n_pieces + ord(text) if len(text) == 1 else None)

    def _table(self) -> PairTable:
        """All pairs of symbols that make a piece, ranked by the piece's score."""
        rank = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        made = []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self._symbol(p[:k]), self._symbol(p[k:])
                if a is not None and b is not None:
                    made.append((a, b, rank[self.scores[p]], i))
        symbols = np.arange(0x110000, dtype=np.int32) + self.n_pieces
        for p, i in self.ids.items():
            if len(p) == 1:
                symbols[ord(p)] = i
        symbols[0x20] = symbols[ord(MARK)]
        self.symbols = symbols
        return PairTable(*np.array(made, np.int64).reshape(-1, 4).T, self.n_pieces + 0x110000)

    def _pieces(self, text: str) -> list[str]:
        """Merge the characters of normalised ``text`` by descending pair score."""
        symbols, scores = list(text), self.scores
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        parts: dict[str, tuple[str, str]] = {}
        agenda = []
        for i in range(n - 1):
            both = symbols[i] + symbols[i + 1]
            if both in scores:
                agenda.append((-scores[both], i, i + 1, both))
        heapify(agenda)
        while agenda:
            _, left, right, both = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != len(both):
                continue
            if both in self.unused:
                parts[both] = (a, b)
            symbols[left], symbols[right] = both, ""
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                pair = both + symbols[follow]
                if pair in scores:
                    heappush(agenda, (-scores[pair], left, follow, pair))
            lead = before[left]
            if lead >= 0:
                pair = symbols[lead] + both
                if pair in scores:
                    heappush(agenda, (-scores[pair], lead, left, pair))
        out: list[str] = []
        rest = [s for s in reversed(symbols) if s]
        while rest:  # an unused piece falls back to what it was merged from
            s = rest.pop()
            if s in self.unused and s in parts:
                rest += parts[s][::-1]
            else:
                out.append(s)
        return out

    def _encode_normalised(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self._pieces(text):
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unk)
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different words, each led by spaces in place of marks, and how many each has."""
        data, offsets = text_bytes(words)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        lengths = np.diff(begins)
        long = np.flatnonzero(lengths > LONGEST)
        symbols = self.symbols[points]
        if len(long):
            symbols = symbols[np.repeat(lengths <= LONGEST, lengths)]
            lengths[long] = 0
        ids, counts = self.table.merge(symbols, lengths)
        if len(ids) and int(ids.max()) >= self.n_pieces:  # characters that no piece has
            of = np.repeat(np.arange(len(counts)), counts)
            odd = np.unique(ids[ids >= self.n_pieces])
            each = [[self.bytes[b] for b in chr(i - self.n_pieces).encode()] if self.bytes else [self.unk] for i in odd.tolist()]
            sizes = np.array([len(x) for x in each], np.int64)
            where = np.minimum(np.searchsorted(odd, ids), len(odd) - 1)
            is_odd = odd[where] == ids
            pool = np.concatenate([np.arange(self.n_pieces), *each])
            sizes_of = np.where(is_odd, sizes[where], 1)
            ids = ragged(pool, np.where(is_odd, self.n_pieces + (np.cumsum(sizes) - sizes)[where], ids), sizes_of)
            counts = np.bincount(of, sizes_of, minlength=len(counts)).astype(np.int64)
        if len(long):
            each = [self._encode_normalised(w.replace(" ", MARK)) for w in words.take(pa.array(long)).to_pylist()]
            at = np.repeat((np.cumsum(counts) - counts)[long], [len(x) for x in each])
            ids = np.insert(ids, at, [i for x in each for i in x])
            counts[long] = [len(x) for x in each]
        return ids, counts

    def _check(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Compare with the library, which puts a mark in front: a word goes without its first one."""
        theirs = self.library.encode([w[1:] for w in words], num_threads=1)
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        # Without anything behind its mark a word is an empty text to the library.
        some = np.array([len(w) > 1 for w in words], bool)
        same = np.array_equal(sizes[some], counts[some])
        if not same or not np.array_equal(np.fromiter(chain.from_iterable(theirs), np.int64, int(sizes.sum())), ids[np.repeat(some, counts)]):
            raise RuntimeError("the agenda and the sentencepiece library differ on a word")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with begin and end ids, one text after another, and how many each text has."""
        if self.table:
            data, offsets = text_bytes(pa.array([" " + t.replace(MARK, " ") if t else "" for t in texts], pa.large_string()))
            blank = data == 0x20
            start = blank & ~np.concatenate([[False], blank[:-1]])
            start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
            begins = np.flatnonzero(start)
            whole = np.concatenate([begins, [len(data)]]).astype(np.int64)
            words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(whole), pa.py_buffer(np.ascontiguousarray(data)))
            coded = words.dictionary_encode()
            known, n = self._words(coded.dictionary)
            self._check(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), known, n)
            of = coded.indices.to_numpy(zero_copy_only=False)
            lengths = n[of]
            ids = ragged(known.astype(np.uint32), (np.cumsum(n) - n)[of], lengths)
            counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(begins, offsets)])
        else:
            each = [self._encode_normalised(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
            ids, counts = np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)
        ends = np.cumsum(counts)
        ids = np.insert(ids, np.stack([ends - counts, ends], 1).reshape(-1), np.tile([self.bos, self.eos], len(texts)).astype(np.uint32))
        counts = counts + 2
        if texts:
            k = min(range(len(texts)), key=lambda i: abs(len(texts[i]) - 1000))
            end = int(counts[: k + 1].sum())
            if self.library.encode(texts[k], add_bos=True, add_eos=True) != ids[end - int(counts[k]) : end].tolist():
                raise RuntimeError("the agenda and the sentencepiece library differ on a whole text")
        return ids, counts


def encoder(path: str) -> PieceEncoder:
    return worker_state(("piece-encoder", path), lambda: PieceEncoder(path))


def encode_pieces(df: DataFrame, model: str, *, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Append ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``piece_ids``.

    A null text is an empty one: begin and end id alone. Columns of ``df`` with these names are replaced.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False))] * with_ids

    def run(texts: pa.Array) -> list[pa.Array]:
        enc = encoder(model)
        ids, counts = enc.encode(texts.fill_null("").to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum(counts)
        each = [ids[a:b] for a, b in zip(ends - counts, ends, strict=True)]
        decoded = enc.library.decode([x.tolist() for x in each])
        out = [pa.array(counts, pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
        return out

    return map_columns(df, [text], fields, run, drop=["piece_ids"])


def op8_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_pieces(docs, tokenizer_path(MODEL), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
