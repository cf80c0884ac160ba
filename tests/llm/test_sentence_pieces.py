import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import sentence_pieces as sp
from tracewright.llm.token_ids import tokenizer_path

PATH = tokenizer_path(sp.MODEL)


@pytest.fixture(scope="module")
def encoder():
    return sp.PieceEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab theing \n\t▁é<s>0x梦ゼ🙂\x00", max_size=50)), max_size=5))
def test_agenda_equals_the_library(encoder, texts):
    want = encoder.library.encode(texts, add_bos=True, add_eos=True)
    ids, counts = encoder.encode(texts)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    table, encoder.table = encoder.table, None  # the agenda over whole texts
    try:
        whole, _ = encoder.encode(texts)
    finally:
        encoder.table = table
    assert whole.tolist() == ids.tolist()


def test_a_difference_raises(encoder, monkeypatch):
    monkeypatch.setattr(encoder.table, "merge", lambda symbols, lengths: (np.full(len(lengths), 5), np.ones(len(lengths), np.int64)))
    with pytest.raises(RuntimeError, match="a word"):
        encoder.encode(["neverseenbefore zzqqxxyy"])


def test_long_words_take_the_single_agenda(encoder):
    texts = ["x" * 65 + " " + "the" * 40 + "é🙂" * 50, " " * 200, "a" * 64 + "  " + "b" * 63, "▁" * 70 + "q"]
    ids, _ = encoder.encode(texts)
    assert ids.tolist() == [i for e in encoder.library.encode(texts, add_bos=True, add_eos=True) for i in e]


def brute(encoder, text):
    ids = encoder.library.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(encoder.library.decode(ids).encode()).hexdigest()


def test_op8_on_documents(spark, sf_dir, encoder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in sp.op8_sentence_pieces(spark, sf_dir).collect()}
    assert got == {d: brute(encoder, t) for d, t in texts.items()}


def test_odd_documents(spark, odd_docs, encoder):
    rows = sp.encode_pieces(odd_docs.withColumnRenamed("score", "n_tokens"), PATH).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == brute(encoder, r.text)
        assert r.piece_ids == encoder.library.encode(r.text or "", add_bos=True, add_eos=True)
    assert sp.encode_pieces(odd_docs.limit(0), PATH).count() == 0
