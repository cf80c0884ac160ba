import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import packing, token_files, token_ids
from tracewright.llm.common import shared_dir
from tracewright.llm.pair_merges import PairTable

PATH = token_ids.tokenizer_path(token_files.WORD_BPE)


@pytest.fixture(scope="module")
def encoder():
    return token_ids.WordEncoder(PATH)


def reference(encoder, texts):
    return [np.array(e.ids + [2], np.uint32) for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("ab 's\n\t\x0b\x1c\x85　é<|>12.ſKΣİß\xad", max_size=30)), max_size=6))
def test_word_encoder_equals_the_library(encoder, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()), 2)
    want = reference(encoder, texts)
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [int(i) for x in want for i in x]


def test_long_pieces_and_words_go_to_the_library(encoder):
    texts = ["a" * 64 + " " + "a" * 65 + "é" * 33, "x1" * 90 + "'s y'llé", "<|endoftext|> a<|b É×÷ ß"]
    ids, _ = encoder.encode(pa.array(texts), 2)
    assert ids.tolist() == [int(i) for x in reference(encoder, texts) for i in x]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_merges_equal_a_queue_of_pairs(data):
    merges: dict[tuple[int, int], tuple[int, int]] = {}
    for _ in range(data.draw(st.integers(0, 20))):
        pair = tuple(data.draw(st.tuples(*[st.integers(0, 2 + len(merges))] * 2)))
        merges.setdefault(pair, (data.draw(st.integers(0, 9)), 3 + len(merges)))
    words = data.draw(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=12))

    def queue(word: list[int]) -> list[int]:
        while found := [(merges[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in merges]:
            i = min(found)[1]
            word = [*word[:i], merges[word[i], word[i + 1]][1], *word[i + 2 :]]
        return word

    table = PairTable(*np.array([(*p, *m) for p, m in merges.items()], np.int64).reshape(-1, 4).T, 3 + len(merges))
    ids, counts = table.merge(np.array([x for w in words for x in w], np.int64), np.array([len(w) for w in words], np.int64))
    want = [queue(w) for w in words]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, 1 << 20), max_size=70))
def test_bit_packing_round_trip(bits, values):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert token_files.unpack_bits(data, len(ids), bits).tolist() == ids.tolist()


def test_bits_are_the_minimum():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]
    with pytest.raises(ValueError):
        token_files.pack_bits(np.array([8]), 3)


def test_file_random_access():
    class Kept(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    rng, out = np.random.default_rng(0), Kept()
    writer = token_files.TokenFileWriter(out, 5000, block_ids=64)
    docs = [(k if k != 3 else None, rng.integers(0, 5000, n).astype(np.uint32)) for k, n in enumerate([5, 0, 700, 64, 1, 20_000])]
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    f = token_files.TokenFile(io.BytesIO(out.data), len(out.data))
    everything = np.concatenate([x for _, x in docs])
    assert f.bits == 13 and f.docs == [d for d, _ in docs] and f.counts.tolist() == [len(x) for _, x in docs]
    for start, count in ((0, 1), (63, 2), (0, len(everything)), (700, 5000), (len(everything), 0)):
        assert f.ids(start, count).tolist() == everything[start : start + count].tolist()


def expected_files(encoder, rows):
    out, start = [], 0
    for d, t in rows:
        ids = reference(encoder, [t])[0]
        out.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_ids", [1 << 25, 500])
def test_token_files_against_brute_force(spark, odd_docs, encoder, monkeypatch, file_ids):
    monkeypatch.setattr(token_files, "FILE_IDS", file_ids)
    folder = shared_dir(spark, "test")
    got = token_files.read_token_files(token_files.write_token_files(odd_docs, folder, PATH), folder).collect()
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_files(encoder, rows)


def test_op6_on_documents(spark, sf_dir, encoder):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(map(tuple, token_files.op6_token_files(spark, sf_dir).collect()))
    assert got == expected_files(encoder, [(r.doc_id, r.text) for r in rows])


def check_pieces(pieces, texts, encoder, sequence=packing.SEQUENCE):
    """Each id lies in one piece; sequences are gapless; all but the last are full."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids, at = reference(encoder, [t])[0].astype("<u4"), 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, parts in by_sequence.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == sequence or s == len(by_sequence) - 1


def test_op10_on_documents(spark, sf_dir, encoder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_pieces(packing.op10_packing(spark, sf_dir).collect(), texts, encoder)


def test_packing_odd_documents(spark, odd_docs, encoder):
    docs = odd_docs.dropDuplicates(["doc_id"])
    pieces = packing.digest(packing.pack(docs, PATH, sequence=64, quantum=16)).collect()
    check_pieces(pieces, {r.doc_id: r.text for r in docs.collect()}, encoder, 64)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_schedule_is_deficit_round_robin():
    lengths = {"a": 40_000, "b": 9_000, None: 777, "c": 20_100, "d": 3}
    for targets in (None, {"a": 1, "b": 1, "c": 2}):
        plan = packing.Schedule(lengths, targets, 256, 32)
        # Brute force: serve the queue whose credit first reaches half a quantum beyond its service.
        order, served = [], [0] * len(plan.sources)
        while any(served[i] < plan.quanta[i] for i in range(len(served))):
            ready = [((2 * served[i] + 1) / int(plan.weights[i]), i) for i in range(len(served)) if served[i] < plan.quanta[i]]
            _, i = min(ready)
            order.append((i, served[i]))
            served[i] += 1
        for slot, (i, k) in enumerate(order):
            assert plan.slots(i, np.array([k]))[0] == slot
    plan = packing.Schedule(lengths, None, 256, 32)
    places = np.concatenate([np.stack([p := plan.pieces(i, np.array([0]), np.array([lengths[s]]))[3], plan.pieces(i, np.array([0]), np.array([lengths[s]]))[2]]) for i, s in enumerate(plan.sources)], axis=1)
    places = places[:, np.argsort(places[0])]
    assert places[0].tolist() == (np.cumsum(places[1]) - places[1]).tolist() and places[1].sum() == sum(lengths.values())


def test_windows_hold_the_target_mixture():
    plan = packing.Schedule({"a": 500_000, "b": 250_000, "c": 250_000})
    share = np.zeros((3, 1_000_000 // 4096 + 1))
    for i, s in enumerate(plan.sources):
        _, _, length, place = plan.pieces(i, np.array([0]), np.array([{"a": 500_000, "b": 250_000, "c": 250_000}[s]]))
        np.add.at(share[i], place // 4096, length)
    assert (np.abs(np.cumsum(share, 1)[:, :-1] / np.arange(1, share.shape[1]) / 4096 - [[0.5], [0.25], [0.25]]) * np.arange(1, share.shape[1]) * 4096 <= packing.QUANTUM).all()
