import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import ngram_join as nj
from tracewright.llm.shingles import shingle_sets


def brute_set(text, width=4):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab AB\n\t\x1c\x85é　", max_size=40), st.text(max_size=20)), max_size=6), st.integers(1, 4))
def test_shingle_sets_equal_brute_force(texts, width):
    sets, want = shingle_sets(pa.array(texts, pa.string()), width), [brute_set(t, width) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            assert len(np.intersect1d(s, t)) == len(want[i] & want[j])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), max_size=30), min_size=1, max_size=8), st.lists(st.sets(st.integers(0, 40), max_size=30), min_size=1, max_size=8))
def test_overlaps(a, b):
    arrays = lambda x: [np.array(sorted(s), np.uint64) for s in x]
    assert nj.overlaps(arrays(a), arrays(b)).tolist() == [[len(x & y) for y in b] for x in a]


def brute(rows, percent=85, width=4):
    sets = [(d, frozenset(brute_set(t, width))) for d, t in rows]
    able = [(d, s) for d, s in sets if d is not None and s]
    root = {d: d for d, _ in able}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(able):
        for b, t in able[:i]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), find(d) if d in root else d) for d, s in sets), key=str)


def got(df, **k):
    return sorted(map(tuple, nj.ngram_join(df, **k).collect()), key=str)


def near_copies(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(50))
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))] + shared.split()
        elif kind == 1:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))]
        else:
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i * 7 % 1009, " ".join(words)))
    return rows


@pytest.mark.parametrize(("short", "hot", "shingles"), [(32, 1024, 1 << 19), (4, 1024, 1 << 19), (4, 8, 1 << 19), (32, 8, 2000)])
def test_join_against_brute_force(spark, monkeypatch, short, hot, shingles):
    for name, value in (("SHORT", short), ("HOT", hot), ("BLOCK_SHINGLES", shingles), ("FREQUENT", 8)):
        monkeypatch.setattr(nj, name, value)
    rows = near_copies(240)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == brute(rows)


def test_long_columns_cross_batches(monkeypatch):
    monkeypatch.setattr(nj, "SHORT", 3)
    rows = [(1, 10, 5), (1, 11, 5)] + [(2, r, 9) for r in range(20, 31)] + [(3, 40, 9), (3, 41, 10), (3, 42, 100)] + [(4, 50, 4)]
    whole = None
    for step in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + step], strict=True)], names=["h", "rep", "n"]) for i in range(0, len(rows), step)]
        out = sorted(r for b in nj._multiply_columns(85)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        whole = whole or out
        assert out == whole
    assert (11, 10, 4) in whole and (41, 40, 4) in whole and not any(42 in r for r in whole) and sorted(r for r in whole if r[2] < 0) == [(r, 2, -4) for r in range(20, 31)]


def test_odd_documents(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = [(d, n, c if d is not None else None) for d, n, c in brute(rows)]
    assert got(odd_docs) == sorted(want, key=str)
    assert got(odd_docs.limit(0)) == []


def test_rows_of_one_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (7, b), (8, c), (9, None), (9, c), (4, ""), (None, a)]
    want = [(3, 27, 3), (5, 27, 3), (5, 27, 3), (7, 27, 3), (7, 27, 3), (8, 27, 8), (9, 0, 9), (9, 27, 8), (4, 0, 4), (None, 27, None)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(want, key=str)


def test_words_that_collide_in_polynomial_hashes():
    def thue(n, x="a", y="b"):
        return x if not n else thue(n - 1, x, y) + thue(n - 1, y, x)

    a, b = shingle_sets(pa.array([f"x y z {thue(10)}", f"x y z {thue(10, 'b', 'a')}"]))
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_a_very_long_text_is_hashed_whole_within_bounds():
    """Ten megabytes take a few hundred megabytes at most, and cuts fall between words."""
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa
from tracewright.llm.shingles import shingle_sets
text = " ".join(map(str, range(100_000, 1_600_000)))
few = shingle_sets(pa.array(["a b c d e"]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
(found,) = shingle_sets(pa.array([text]))
print(len(found), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    n, kb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split())
    assert n == 1_500_000 - 3 and kb < 300_000


def test_op3_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, nj.op3_ngram_join(spark, sf).collect()), key=str) == brute(rows)
