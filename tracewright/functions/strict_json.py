"""Strict RFC 8259 JSON: exact integers, no duplicate names, finite numbers, valid Unicode, bounded depth."""

from __future__ import annotations

import json
import math
from typing import Any

MAX_DEPTH = 256
#: A document may nest its records this much deeper.
DOCUMENT_DEPTH = MAX_DEPTH + 16


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        names = [k for k, _ in pairs]
        raise ValueError(f"duplicate object name: {next(k for k in names if names.count(k) > 1)!r}")
    return out


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"number out of range: {text}")
    return value


def _constant(text: str) -> float:
    raise ValueError(f"not a JSON value: {text}")


def loads(payload: str | bytes, max_depth: int = MAX_DEPTH) -> Any:
    """Decode; every breach is a ValueError."""
    if isinstance(payload, bytes):
        payload = payload.decode("utf-8", errors="strict")
    _check_nesting(payload, max_depth)
    value = json.loads(payload, object_pairs_hook=_unique, parse_float=_finite, parse_constant=_constant, parse_int=_integer)
    return checked(value, max_depth)


def _integer(text: str) -> int:
    import sys

    limit = sys.get_int_max_str_digits()
    if limit and len(text) > limit:  # exact whatever the length
        head = 0
        for i in range(0, len(digits := text.lstrip("-")), 4000):
            part = digits[i : i + 4000]
            head = head * 10 ** len(part) + int(part)
        return -head if text.startswith("-") else head
    return int(text)


def _check_nesting(text: str, most: int) -> None:
    """Refuse deep documents before the decoder recurses into them."""
    depth, inside, skip = 0, False, False
    if text.count("[") + text.count("{") <= most:
        return
    for c in text:
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
            if depth > most:
                raise ValueError(f"nested deeper than {most}")
        elif c in "]}":
            depth -= 1


def checked(value: Any, max_depth: int = MAX_DEPTH) -> Any:
    """The value itself if it is JSON: finite, valid Unicode, text names, not too deep, no cycle."""
    stack = [(value, 0)]
    while stack:
        x, depth = stack.pop()
        if depth > max_depth:
            raise ValueError(f"nested deeper than {max_depth}")
        if isinstance(x, str):
            if not x.isascii() and any("\ud800" <= c <= "\udfff" for c in x):
                raise ValueError("text holds a lone surrogate")
        elif isinstance(x, dict):
            for k, v in x.items():
                if not isinstance(k, str):
                    raise ValueError(f"an object name must be text, not {type(k).__name__}")
                stack += [(k, depth), (v, depth + 1)]
        elif isinstance(x, list | tuple):
            stack += [(v, depth + 1) for v in x]
        elif isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("numbers must be finite")
        elif x is not None and not isinstance(x, bool | int):
            raise ValueError(f"not a JSON value: {type(x).__name__}")
    return value


#: Encoders are made once; ``json.dumps`` would make one for each value.
_SORTED = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
_UNSORTED = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def canonical(value: Any) -> str:
    """Compact, names sorted at every level, non-ASCII as it is."""
    return _SORTED.encode(value)


def compact(value: Any) -> str:
    return _UNSORTED.encode(value)


def repaired(text: str) -> str:
    """Text whose lone surrogates are written as backslash escapes."""
    return text.encode("utf-8", errors="backslashreplace").decode()


def exact_fields(record: Any, fields: set[str], optional: set[str] = frozenset(), what: str = "record") -> dict[str, Any]:
    """The record if it is an object with exactly these names."""
    if not isinstance(record, dict):
        raise ValueError(f"{what} must be an object")
    if missing := sorted(fields - record.keys()):
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    if unknown := sorted(record.keys() - fields - optional):
        raise ValueError(f"{what} has unknown {', '.join(unknown)}")
    return record
