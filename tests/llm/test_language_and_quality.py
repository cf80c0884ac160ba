import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.llm import language_id as lid
from tracewright.llm import quality_rules as q


def test_op1_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = lid.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def brute_sizes(model, text):
    """Sizes of a whole text under each dictionary, by compressors made anew."""
    import zstandard

    sizes = []
    for d in model.dictionaries.values():
        p = zstandard.ZstdCompressionParameters.from_level(model.level, min_match=model.min_match, write_content_size=0, write_checksum=0)
        raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=p)
        c, data = zstandard.ZstdCompressor(dict_data=raw, compression_params=p), text.lower().encode()
        sizes.append(sum(len(c.compress(data[i : i + model.block_bytes])) for i in range(0, len(data), model.block_bytes)))
    return sizes


def test_op1_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lid.fit(docs.where(~lid.held_out(F.col("doc_id"), 3, 1)))
    langs = list(model.dictionaries)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in lid.op1_language_id(spark, sf_dir).collect():
        text = texts[r.doc_id]
        if text is None or not lid.LETTER.search(text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = brute_sizes(model, text)
        best = min(sizes)
        assert r.lang_pred == langs[sizes.index(best)]  # ties: the first language
        assert abs(r.score - 1 / sum(math.exp((best - x) / (4 + 0.01 * best)) for x in sizes)) < 1e-12


def test_ties_and_repeated_rows_of_two_languages(spark):
    text = "nothing tells these two apart at all " * 5
    model = lid.fit(spark.createDataFrame([(text, "zz"), (text, "aa"), (text, "aa")], "text string, lang string"))
    rows = lid.detect(spark.createDataFrame([(text, 7), (text, 7)], "text string, __in0 int"), model).collect()
    assert {(r.lang_pred, r.margin, r["__in0"]) for r in rows} == {("aa", 0.0, 7)}


def test_language_odd_documents(spark, odd_docs):
    model = lid.fit(odd_docs, texts_per_language=3)
    assert set(model.dictionaries) == {"de", "en", "fr"}
    rows = lid.detect(odd_docs, model, min_margin=0.002).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.text is None or not re.search(r"[^\W\d_]", r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    long = next(r for r in rows if r.doc_id == 5)
    assert long.lang_pred == "fr" and not long.rejected
    empty = lid.fit(odd_docs.limit(0))
    assert {r.lang_pred for r in lid.detect(odd_docs, empty).collect()} == {"und"}
    assert lid.detect(odd_docs.limit(0), model).count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\t\x0b\x1f\x85　é#|🙂", max_size=60), st.text(max_size=30)), min_size=1, max_size=20))
def test_counts_equal_brute_force(spark, texts):
    rows = q.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.doc_id: tuple(r[n] for n in NAMES) for r in rows} == {i: counts(t) for i, t in enumerate(texts)}


def test_very_long_text(spark):
    text = " ".join(f"w{i % 50_000}" for i in range(70_000))
    row = q.measure(spark.createDataFrame([(text, "x", 5)], "text string, symbol_share string, n_words int")).first()
    assert tuple(row[n] for n in NAMES) == counts(text)


def test_windows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(q, "PLACE_BITS", 62)  # two bits of the hash are left
    texts = ["a b c d e f g a b c h i a b c d", "x y z " * 3 + "p q r s t"]
    rows = q.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.doc_id: tuple(r[n] for n in NAMES) for r in rows} == {i: counts(t) for i, t in enumerate(texts)}


def test_quality_odd_documents(spark, odd_docs):
    measured = q.measure(odd_docs)
    table = q.adaptive_fences(measured)
    rows = q.judge(measured, table).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.kept is not None and r.base_failed is not None for r in rows)
    empty = q.measure(odd_docs.limit(0))
    assert q.judge(empty, q.adaptive_fences(empty)).count() == 0


def shares(spark, rows):
    """Measured texts that pass the base rules: (lang, source, symbol_share)."""
    numbered = [(i, *r, 0, 0, 100, 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, "doc_id int, lang string, source string, symbol_share long, dup_line_share long, repeat_share long, n_words long, n_repeat_words long")


def test_sketches_merge_exactly(spark):
    df = shares(spark, [("en", f"s{i % 7}", i * 31 % 1009) for i in range(3000)])
    whole = q.sketch(df, [])
    parts = q.merge(q.sketch(df, ["source"]), [])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def brute_fence(values):
    """The split of the buckets with the largest variance between its sides, by all sums anew."""
    def number(v):
        v, over = v + q.NEAR_ZERO, max((v + q.NEAR_ZERO).bit_length() - q.BUCKET_BITS, 0)
        return 32 * over + (v >> over)

    x = sorted(map(number, values))
    best = None
    for cut in sorted(set(x))[:-1]:
        low, high = [v for v in x if v <= cut], [v for v in x if v > cut]
        a, b = sum(low) / len(low), sum(high) / len(high)
        value = (b - a) * (b - a) * len(low) * len(high)
        if best is None or value > best[0]:
            best = value, a, b, len(high)
    if best is None or best[2] - best[1] < q.APART or best[3] * q.MOST_RARE < len(x) or len(x) < q.LEAST_TEXTS:
        return None
    return (best[1] + best[2]) / 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(1, 60)), max_size=8))
def test_fences_equal_brute_force(spark, counted):
    values = [v for v, n in counted for _ in range(n)]
    got = q.fences(q.sketch(shares(spark, [("en", "a", v) for v in values]), ["lang", "source"]), ["lang", "source"]).collect()
    assert (got[0].symbol_share if got else None) == brute_fence(values)


def test_fences_follow_their_corpus(spark):
    rows = [("en", "mixed", 900 if i % 8 == 0 else i % 9) for i in range(800)]
    rows += [("en", "junk", 800 + i % 90) for i in range(300)]  # one mode alone, all of it high
    rows += [("de", "calm", i % 40) for i in range(500)]
    rows += [("fr", "spread", i % 400) for i in range(500)]  # no second mode
    df = shares(spark, rows)
    table = q.adaptive_fences(df)
    assert {r.source for r in table.collect()} == {"mixed", "junk", "calm", "spread"}
    kept = {(r.source, r.symbol_share): r.kept for r in q.judge(df, table).collect()}
    assert not any(k for (s, v), k in kept.items() if s == "junk" or v == 900)
    assert all(k for (s, v), k in kept.items() if s in ("calm",) or s == "mixed" and v < 900)


def test_other_columns_stay(spark, odd_docs):
    df = odd_docs.withColumns({"__qw": F.lit(1), "__words": F.lit(2), "fence_lang": F.lit(3), "max_repeat_share": F.lit(4)})
    measured = q.measure(df)
    out = q.judge(measured, q.adaptive_fences(measured))
    assert set(df.columns) <= set(out.columns)
    assert {(r["__qw"], r["__words"], r.fence_lang, r.max_repeat_share) for r in out.collect()} == {(1, 2, 3, 4)}


def test_a_worker_that_tells_languages_keeps_no_other_stages_state():
    from tracewright.llm import common

    common.worker_state(("word-encoder", "of the packing stage"), lambda: bytearray(1000))
    compressors = lid._compressors((b"the and of to that", b"der die und das nicht"), 9, 3)
    assert common._STATE["made"] is compressors
    assert lid._compressors((b"the and of to that", b"der die und das nicht"), 9, 3) is compressors


def test_texts_are_sent_to_python_once(spark, odd_docs):
    model = lid.fit(odd_docs)
    told = lid.detect(odd_docs, model)
    sent = re.search(r"MapInArrow run\(([^)]*)\)", told._jdf.queryExecution().executedPlan().toString())[1]
    assert sorted(x.split("#")[0] for x in sent.split(", ")) == sorted(set(odd_docs.columns) - {"score"})
    key = lambda r: str(tuple(r))
    kept = [c for c in odd_docs.columns if c != "score"]
    assert sorted(told.select(*kept).collect(), key=key) == sorted(odd_docs.select(*kept).collect(), key=key)
