"""Language ID by compression: the language whose dictionary makes a text smallest wins.

Each language has one zstandard raw-content dictionary made of slices of labelled texts. A text is
lower-cased and cut into blocks, every block is compressed once with each dictionary, and the sizes
are summed, so that a long text counts whole and does not become its own dictionary.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, worker_state

LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """One raw-content dictionary a language; ``dictionaries`` maps language to bytes."""

    dictionaries: dict[str, bytes]
    block_bytes: int = 2048
    level: int = 9
    min_match: int = 3


def fit(
    labelled: DataFrame, *, text: str = "text", lang: str = "lang", texts_per_language: int = 100, slice_chars: int = 1500,
    block_bytes: int = 2048, max_languages: int = 1000,
) -> LanguageModel:
    """Fit dictionaries on a bounded sample of labelled rows.

    The bound is ``texts_per_language`` different texts a language, the ones with the smallest
    hashes, each giving a slice of ``slice_chars`` characters at a hashed position. Rows with a null
    text or language are left out; copies of a text count once. More than ``max_languages``
    languages raise ValueError, so that what reaches the driver is bounded.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null and t <> ''")
    keyed = rows.select("l", "t", F.xxhash64("t").alias("h"))
    counts = {r["l"]: r["n"] for r in keyed.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return LanguageModel({}, block_bytes)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * texts_per_language / max(n, 1))))])
    picked = keyed.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("l")] * (1 << 30))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("t") - slice_chars, F.lit(0)) + 1) + 1
    slices = picked.groupBy("l", "h").agg(F.min(F.substring("t", start.cast("int"), F.lit(slice_chars))).alias("s")).collect()
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in slices:
        parts.setdefault(r["l"], []).append((r["h"] % (1 << 30), r["s"]))
    return LanguageModel({k: "\n".join(s for _, s in sorted(v)[:texts_per_language]).lower().encode() for k, v in sorted(parts.items())}, block_bytes)


def detect(df: DataFrame, model: LanguageModel, *, text: str = "text", min_margin: float = 0.0) -> DataFrame:
    """Append ``lang_pred``, ``score``, ``margin`` and ``rejected`` to every row.

    ``margin`` is the share of bytes by which the best language beats the next one and ``score`` a
    soft choice among the sizes (0 to 1). ``rejected`` is true for a margin under ``min_margin``
    and where nothing can be told: a null text or one without a letter has ``und``, score 0 and
    margin 0, as has every text under a model without languages. Ties go to the first language in
    code-point order. Columns of ``df`` with these four names are replaced.
    """
    langs, dicts, block = list(model.dictionaries), tuple(model.dictionaries.values()), model.block_bytes
    level, min_match = model.level, model.min_match
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

    def run(texts: pa.Array) -> list[pa.Array]:
        compressors = _compressors(dicts, level, min_match)
        pred, score, margin, rejected = [], [], [], []
        for value in texts:
            s = value.as_py()
            if not langs or s is None or not LETTER.search(s):
                row = (UNDETERMINED, 0.0, 0.0, True)
            else:
                data = s.lower().encode()
                blocks = [data[i : i + block] for i in range(0, len(data), block)]
                sizes = [sum(len(c(b)) for b in blocks) for c in compressors]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                scale = 4.0 + 0.01 * sizes[best]
                gap = min((x for i, x in enumerate(sizes) if i != best), default=2 * sizes[best]) - sizes[best]
                row = (langs[best], 1.0 / sum(math.exp((sizes[best] - x) / scale) for x in sizes), gap / max(sizes[best], 1), gap < min_margin * sizes[best])
            for out, x in zip((pred, score, margin, rejected), row, strict=True):
                out.append(x)
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())]

    return map_columns(df, [text], fields, run)


def _compressors(dicts: tuple[bytes, ...], level: int, min_match: int) -> list:
    import zstandard

    def make() -> list:
        made = []
        params = zstandard.ZstdCompressionParameters.from_level(level, min_match=min_match, write_content_size=0, write_checksum=0)
        for d in dicts:
            raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=params).compress)
        return made

    return worker_state(("language", dicts, level, min_match), make)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from labelled rows outside the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    out = detect(docs.select("doc_id", "text"), model, min_margin=MIN_MARGIN)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")


#: A text is rejected if the best dictionary saves less than this share over the next one.
MIN_MARGIN = 0.002
