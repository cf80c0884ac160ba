"""Sizes in bytes and approximate tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]


def approximate_tokens(bytes_per_token: int = 4) -> Tokenizer:
    """Bytes over a constant, rounded up."""
    if bytes_per_token < 1:
        raise ValueError("a token has at least one byte")
    return lambda text: F.ceil(F.octet_length(text) / F.lit(bytes_per_token)).cast("bigint")


def compression(source: Column, output: Column, tokenizer: Tokenizer | None = None) -> Column:
    """Signed savings of ``output`` over ``source``; percents of an empty source are null."""
    tokens = tokenizer or approximate_tokens()
    a, b = F.octet_length(source).cast("bigint"), F.octet_length(output).cast("bigint")
    c, d = tokens(source), tokens(output)
    percent = lambda x, y: F.when(x > 0, (x - y) * 100.0 / x)
    return F.struct(
        a.alias("input_bytes"), b.alias("output_bytes"), (a - b).alias("saved_bytes"), percent(a, b).alias("saved_bytes_percent"),
        c.alias("input_tokens"), d.alias("output_tokens"), (c - d).alias("saved_tokens"), percent(c, d).alias("saved_tokens_percent"),
    )
