"""Decoding and line framing with exact byte spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, besides CR LF. They are the breaks of ``str.splitlines``.
TERMINATORS = "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"
#: The white space of ``str.isspace``.
WHITESPACE = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in TERMINATORS)
#: Java pattern of one line with its terminator; no repetition of groups, so it cannot exhaust the stack.
LINE_PATTERN = f"[^{_CLASS}]*(?:\\r\\n|[{_CLASS}])|[^{_CLASS}]+"
_BREAK = re.compile(f"\r\n|[{TERMINATORS}]")


def decode_source(value: str | bytes, what: str = "parser") -> str:
    """Text as it is, bytes as strict UTF-8, anything else a TypeError."""
    if isinstance(value, str):
        return value
    if isinstance(value, bytes | bytearray | memoryview):
        return bytes(value).decode("utf-8", errors="strict")
    raise TypeError(f"{what} takes text or UTF-8 bytes, not {type(value).__name__}")


def frame(text: str) -> Iterator[tuple[str, int]]:
    """Each line without its terminator, and its UTF-8 width with it; no line after a final terminator."""
    at, plain = 0, text.isascii()
    for m in _BREAK.finditer(text):
        line, whole = text[at : m.start()], text[at : m.end()]
        yield line, len(whole) if plain else len(whole.encode())
        at = m.end()
    if at < len(text):
        rest = text[at:]
        yield rest, len(rest) if plain else len(rest.encode())


def valid_source(content: Column) -> Column:
    """Strict UTF-8 text of a binary column; invalid bytes raise when the row is read."""
    return F.validate_utf8(content.cast("string"))


def strip_line(line: Column) -> Column:
    """A framed line without its terminator."""
    return F.regexp_replace(line, f"(?:\\r\\n|[{_CLASS}])$", "")


def right_trim(column: Column) -> Column:
    """Without trailing white space, as ``str.rstrip``."""
    return F.rtrim(column, F.lit(WHITESPACE))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Source text of a byte span."""
    return F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, (end - start).cast("int")).cast("string")
