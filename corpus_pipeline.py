"""From raw documents to packed training sequences in four stages, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import language_id, ngram_join, packing, quality_rules
from tracewright.llm.common import written
from tracewright.llm.token_ids import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose language cannot be told; a missing ``lang`` becomes the predicted one.

    A null text or one without a letter goes, as its language cannot be told; repeated rows share
    one verdict; an empty table gives an empty one; columns other than ``COLUMNS`` are left out.
    """
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"), 3, 1)))
    told = language_id.detect(docs.select(*COLUMNS), model, min_margin=language_id.MIN_MARGIN).where("not rejected")
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that fail the base rules or lie above the fences of their language and source.

    A null or empty text fails; a null language or source is a group of its own; repeated rows share
    one verdict; an empty table gives an empty one.
    """
    measured = written(quality_rules.measure(docs.select(*COLUMNS)), "measured")
    return quality_rules.judge(measured, quality_rules.adaptive_fences(measured)).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of texts that share 80% of their 5-word shingles.

    Rows repeated with id and text are one; a row with a null id, or a text without words, is alone;
    an empty table gives an empty one.
    """
    told = ngram_join.ngram_join(docs.select("doc_id", "text"), width=5, percent=80)
    kept = told.where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
    one = docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return one.dropDuplicates(["doc_id", "text"])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left, each window with the corpus's mixture of sources.

    A null text is an empty one and a null source a queue of its own; repeated rows are packed each;
    an empty table gives no piece.
    """
    return packing.digest(packing.pack(docs, tokenizer_path(packing.WORD_BPE)))


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies), ("packing", sequences)]

#: The stages use zstandard and a tokenizer, which SQL cannot express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
