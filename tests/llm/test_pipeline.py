import duckdb
import zstandard

import corpus_pipeline as cp
from test_ngram_join import brute as brute_groups
from test_token_operators import PATH, check_pieces
from tracewright.llm import language_id as lid
from tracewright.llm import quality_rules, token_ids


def brute_language(model, text):
    """Whether the text is kept: one-shot sizes with freshly made compressors."""
    if text is None or not lid.LETTER.search(text):
        return False
    sizes = []
    for d in model.dictionaries.values():
        p = zstandard.ZstdCompressionParameters.from_level(model.level, min_match=model.min_match, write_content_size=0, write_checksum=0)
        raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=p)
        c, data = zstandard.ZstdCompressor(dict_data=raw, compression_params=p), text.lower().encode()
        sizes.append(sum(len(c.compress(data[i : i + model.block_bytes])) for i in range(0, len(data), model.block_bytes)))
    a, b = sorted(sizes)[:2]
    return b - a >= lid.MIN_MARGIN * a


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = lid.fit(docs.where(~lid.held_out(docs["doc_id"], 3, 1)))
    told = {d: r for d, r in rows.items() if brute_language(model, r.text)}
    con = duckdb.connect()
    documents = spark.createDataFrame(list(told.values()), docs.schema).toPandas()  # noqa: F841
    good = {d for d, kept in con.execute(f"SELECT doc_id, kept FROM ({quality_rules.ORACLE})").fetchall() if kept}
    groups = brute_groups([(d, told[d].text) for d in good], percent=80, width=5)
    final = {d: told[d].text for d, _, c in groups if d == c}
    assert 0 < len(final) < len(good) < len(told) <= len(rows)
    check_pieces(cp.run(spark, sf_dir).collect(), final, token_ids.WordEncoder(PATH))


def test_stages_take_odd_documents(spark, odd_docs, sf_dir):
    for df in (odd_docs, odd_docs.limit(0)):
        docs, left = df, []
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "packing":
                assert docs.columns == cp.COLUMNS
                docs = docs.cache()
                left.append(sorted((r.doc_id for r in docs.collect()), key=str))
        pieces = docs.collect()
        assert all(r.start + r.length <= r.doc_tokens and r.offset + r.length <= 4096 for r in pieces)
        assert {r.doc_id for r in pieces} == set(left[-1])
        # Texts without a letter, or with fewer than 50 words, or all repeats, do not stay.
        assert left == ([[1, 1, 5, 7, None], [], []] if df is odd_docs else [[], [], []])
    copies = cp.near_copies(spark, odd_docs, sf_dir)
    assert copies.where("doc_id = 1").count() == 1 and copies.where("doc_id is null").count() == 1


def test_boilerplate_in_a_fifth_of_a_source_is_dropped(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    junk = "\n".join([clean, *["same"] * 8])
    rows = [(i, junk if i % 5 == 0 else clean, "en", "hot", 1) for i in range(300)]
    kept = cp.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(300) if i % 5]
