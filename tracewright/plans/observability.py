"""Lifecycle records of driver-side operations. They carry counts and names, never content."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("tracewright")


@dataclass(frozen=True)
class LifecycleEvent:
    name: str
    occurred_at: datetime
    parser_name: str | None = None
    partition_id: str | None = None
    attributes: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if any(not isinstance(v, str | int | float | bool | None) for v in self.attributes.values()):
            raise ValueError("lifecycle attributes must be scalars")


class Sink:
    """``emit``, ``flush`` and ``close``; what a sink raises is logged, never passed on."""

    def emit(self, event: LifecycleEvent) -> None:
        return None

    def flush(self) -> None:
        return None

    def close(self) -> None:
        return None


class MemorySink(Sink):
    def __init__(self) -> None:
        self.events: list[LifecycleEvent] = []

    def emit(self, event: LifecycleEvent) -> None:
        self.events.append(event)


class LoggingSink(Sink):
    def __init__(self, logger: logging.Logger = log, level: int = logging.INFO):
        self.logger, self.level = logger, level

    def emit(self, event: LifecycleEvent) -> None:
        self.logger.log(self.level, "%s parser=%s %s", event.name, event.parser_name, event.attributes)


class CompositeSink(Sink):
    """Passes on to several sinks; one that fails does not keep the others from it."""

    def __init__(self, *sinks: Sink):
        self.sinks = sinks

    def _each(self, method: str, *args: Any) -> None:
        for s in self.sinks:
            safely(s, method, *args)

    def emit(self, event: LifecycleEvent) -> None:
        self._each("emit", event)

    def flush(self) -> None:
        self._each("flush")

    def close(self) -> None:
        self._each("close")


def safely(sink: Sink, method: str, *args: Any) -> None:
    try:
        getattr(sink, method)(*args)
    except Exception:
        log.exception("sink %s failed in %s", type(sink).__name__, method)


def tell(sink: Sink, name: str, parser: str | None = None, **attributes: Any) -> None:
    safely(sink, "emit", LifecycleEvent(name, datetime.now(UTC), parser, attributes=attributes))


@contextmanager
def watched(sink: Sink, what: str, parser: str | None = None, **attributes: Any) -> Iterator[None]:
    """Started, then Completed or Failed."""
    tell(sink, f"{what}Started", parser, **attributes)
    try:
        yield
    except BaseException as error:
        tell(sink, f"{what}Failed", parser, error_type=type(error).__name__)
        raise
    tell(sink, f"{what}Completed", parser, **attributes)


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """Parse rows that count their events, results and failures as they pass; read ``Observation.get`` after an action."""
    seen = Observation(f"parse-{uuid.uuid4().hex}")
    kind = lambda k: F.sum((F.col("kind") == k).cast("bigint"))
    return rows.observe(seen, kind("event").alias("events"), kind("result").alias("results"), F.sum(F.size("result.errors").cast("bigint")).alias("errors")), seen
