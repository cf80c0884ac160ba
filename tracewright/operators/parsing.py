"""Parsers as table functions: documents to events and one result a document.

A parser has a Python face, ``parse_text``, which runs over Arrow batches on the executors, and may
have a native one, ``native``, which turns a lines table into events by Catalyst expressions.
"""

from __future__ import annotations

import traceback as tb
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.errors import ConfigurationError
from tracewright.functions.strict_json import canonical, compact, repaired
from tracewright.plans.capabilities import Capabilities
from tracewright.schema import EVENTS, EVIDENCE_FIELDS, RESULTS, VERSION


@dataclass(frozen=True)
class Context:
    source_id: str | None = None
    correlation_id: str | None = None
    partition_id: str | None = None
    source_offset: int | None = None

    @property
    def base(self) -> int:
        return self.source_offset or 0


@dataclass(frozen=True, slots=True)
class Event:
    event_type: str
    attributes: dict[str, Any] = field(default_factory=dict)
    timestamp: datetime | None = None
    severity: str | None = None
    confidence: float | None = None
    line: int | None = None
    start: int | None = None
    end: int | None = None
    pattern: str | None = None
    parser_name: str | None = None
    parser_version: str | None = None
    source_id: str | None = None
    partition_id: str | None = None
    correlation_id: str | None = None

    def __post_init__(self) -> None:
        if not self.event_type:
            raise ValueError("an event needs a type")
        if self.timestamp is not None and self.timestamp.utcoffset() is None:
            raise ValueError("a timestamp needs a time zone")
        if self.confidence is not None and (isinstance(self.confidence, bool) or not 0 <= self.confidence <= 1):
            raise ValueError("confidence must be a number from 0 to 1")
        if None not in (self.start, self.end) and self.end < self.start:
            raise ValueError("a span ends before it starts")

    def relabelled(self, **names: str | None) -> Event:
        """A copy with other names in it; names are not checked, so the checks of a new event are spared."""
        out = object.__new__(Event)
        for slot in Event.__slots__:
            object.__setattr__(out, slot, names[slot] if slot in names else getattr(self, slot))
        return out

    def evidence(self) -> dict[str, Any]:
        return {
            "source_id": self.source_id, "start_offset": self.start, "end_offset": self.end, "line_number": self.line, "parser_name": self.parser_name,
            "parser_version": self.parser_version, "pattern_name": self.pattern, "partition_id": self.partition_id, "correlation_id": self.correlation_id,
        }

    def record(self) -> dict[str, Any]:
        return {
            "schema_version": VERSION, "event_type": self.event_type, "attributes": self.attributes, "timestamp": self.timestamp.isoformat() if self.timestamp else None,
            "severity": self.severity, "confidence": self.confidence, "evidence": self.evidence(),
        }


def message_of(attributes: dict[str, Any]) -> Any:
    """An event's message: its ``message`` text, else all attributes, else null."""
    message = attributes.get("message")
    return message if isinstance(message, str) else (attributes or None)


@dataclass
class Parsed:
    events: list[Event] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    errors: list[dict[str, Any]] = field(default_factory=list)
    statistics: dict[str, int] = field(default_factory=dict)


def issue(error: BaseException | str, kind: str | None = None, context: Context | None = None, index: int | None = None) -> dict[str, Any]:
    told = "".join(tb.format_exception(error)) if isinstance(error, BaseException) and error.__traceback__ else None
    return {"error_type": kind or type(error).__name__, "message": repaired(str(error)), "source_id": context.source_id if context else None, "input_index": index, "traceback": repaired(told) if told else None}


class Parser:
    """Base of all parsers. ``parse_text`` gives the events of one document in order."""

    name = "parser"
    version = "1"
    capabilities = Capabilities()

    def parse_text(self, text: Any, context: Context) -> Parsed:
        raise NotImplementedError

    def native(self, lines: DataFrame) -> DataFrame | None:
        """Events of a lines table by Catalyst alone, or None."""
        return None

    def with_identity(self, e: Event, context: Context) -> Event:
        """Fill what the event does not say about its origin; empty text counts as missing."""
        return e.relabelled(source_id=e.source_id or context.source_id, partition_id=e.partition_id or context.partition_id, correlation_id=e.correlation_id or context.correlation_id, parser_name=e.parser_name or self.name, parser_version=e.parser_version or self.version)


def parse_documents(df: DataFrame, parser: Parser, *, continue_on_error: bool = False, event_types: set[str] | None = None) -> Parsing:
    """Parse every row (source_id, text or content, optional context columns).

    A row that fails ends the job, or with ``continue_on_error`` becomes a result with one issue.
    ``event_types`` drops other events on the workers, as Catalyst cannot push filters through them.
    """
    given = F.col("input_index").cast("bigint") if "input_index" in df.columns else F.monotonically_increasing_id()
    docs = spread(df.withColumn("__index", given).select(*_inputs(df), "__index"))
    schema = f"kind string, {EVENTS}, result struct<{_as_struct(RESULTS)}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _EventBatch()
        for batch in batches:
            for source, text, correlation, partition, offset, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                context = Context(source, correlation, partition, offset)
                try:
                    parsed = parser.parse_text(text if isinstance(text, str) else bytes(text).decode("utf-8") if text is not None else "", context)
                    for seq, e in enumerate(parsed.events):
                        if event_types is None or e.event_type in event_types:
                            out.event(source, index, seq, parser.with_identity(e, context))
                            if out.full:
                                yield out.batch()
                except Exception as error:
                    if not continue_on_error:
                        raise
                    parsed = Parsed(errors=[issue(error, context=context, index=index)])
                out.result(source, index, parser, correlation, parsed)
                if out.full:
                    yield out.batch()
        if out.rows:
            yield out.batch()

    return Parsing(docs.mapInArrow(run, schema))


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` in at least as many partitions as there are cores, if its plan is a scan alone.

    A scan cuts files by their bytes, so a file of very many short documents would be parsed by one task.
    """
    if docs.isStreaming:
        return docs
    plan = docs._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # it shuffles, and running it would tell no more
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if plan.execute().getNumPartitions() < cores else docs


def _inputs(df: DataFrame) -> list[Column]:
    text = F.col("text") if "text" in df.columns else F.col("content")
    rest = {"correlation_id": "string", "partition_id": "string", "source_offset": "bigint"}
    return [F.col("source_id").cast("string").alias("source_id"), text.alias("text"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in rest.items()]]


def _as_struct(columns: str) -> str:
    """Top-level columns of a DDL string as struct fields."""
    out, depth, field_, fields = [], 0, "", []
    for c in columns:
        depth += c in "<("
        depth -= c in ">)"
        if c == "," and not depth:
            fields.append(field_)
            field_ = ""
        else:
            field_ += c
    for f in [*fields, field_]:
        name, _, kind = f.strip().partition(" ")
        out.append(f"{name}:{kind}")
    return ",".join(out)


class _EventBatch:
    """Rows on their way out of a worker, column by column: events, and a result after its events."""

    LIMIT = 5000

    def __init__(self) -> None:
        self.columns: list[list[Any]] = [[] for _ in _ARROW.names]
        self.evidence: list[list[Any]] = [[] for _ in EVIDENCE_FIELDS]

    @property
    def rows(self) -> int:
        return len(self.columns[0])

    @property
    def full(self) -> bool:
        return self.rows >= self.LIMIT

    def _add(self, row: tuple, evidence: tuple) -> None:
        for column, x in zip(self.columns, row, strict=True):
            column.append(x)
        for column, x in zip(self.evidence, evidence, strict=True):
            column.append(x)

    def event(self, source: str | None, index: int, seq: int, e: Event) -> None:
        record = e.record()
        told = tuple(record["evidence"].values())
        at = e.timestamp.astimezone(UTC) if e.timestamp else None
        confidence = None if e.confidence is None else float(e.confidence)
        self._add(("event", source, index, seq, e.event_type, compact(e.attributes), at, record["timestamp"], e.severity, confidence, True, canonical(message_of(e.attributes)), canonical(record), None), told)

    def result(self, source: str | None, index: int, parser: Parser, correlation: str | None, p: Parsed) -> None:
        statistics = [{"pattern_name": k, "matches": v} for k, v in sorted(p.statistics.items())]
        result = {"source_id": source, "input_index": index, "parser_name": parser.name, "parser_version": parser.version, "correlation_id": correlation, "warnings": p.warnings, "errors": p.errors, "pattern_statistics": statistics, "llm_result": None}
        self._add(("result", source, index, *[None] * (len(_ARROW.names) - 4), result), (None,) * len(EVIDENCE_FIELDS))

    def batch(self) -> pa.RecordBatch:
        arrays = []
        for f, column in zip(_ARROW, self.columns, strict=True):
            if f.name == "evidence":
                parts = [pa.array(x, k.type) for x, k in zip(self.evidence, _EVIDENCE_ARROW, strict=True)]
                arrays.append(pa.StructArray.from_arrays(parts, fields=list(_EVIDENCE_ARROW), mask=pa.array([x is None for x in column])))
            else:
                arrays.append(pa.array(column, f.type))
        self.__init__()
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


_EVIDENCE_ARROW = pa.struct([(n, pa.int64() if n in ("start_offset", "end_offset", "line_number") else pa.string()) for n in EVIDENCE_FIELDS])
_ISSUE_ARROW = pa.struct([("error_type", pa.string()), ("message", pa.string()), ("source_id", pa.string()), ("input_index", pa.int64()), ("traceback", pa.string())])
_RESULT_ARROW = pa.struct([("source_id", pa.string()), ("input_index", pa.int64()), ("parser_name", pa.string()), ("parser_version", pa.string()), ("correlation_id", pa.string()), ("warnings", pa.list_(pa.string())), ("errors", pa.list_(_ISSUE_ARROW)), ("pattern_statistics", pa.list_(pa.struct([("pattern_name", pa.string()), ("matches", pa.int64())]))), ("llm_result", pa.string())])
_ARROW = pa.schema([
    ("kind", pa.string()), ("source_id", pa.string()), ("input_index", pa.int64()), ("seq", pa.int64()), ("event_type", pa.string()), ("attributes_json", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("timestamp_iso", pa.string()),
    ("severity", pa.string()), ("confidence", pa.float64()), ("evidence", _EVIDENCE_ARROW), ("message_json", pa.string()), ("canonical", pa.string()), ("result", _RESULT_ARROW),
])
EVENT_COLUMNS = [n for n in _ARROW.names if n not in ("kind", "result")]


@dataclass(frozen=True)
class Parsing:
    """The outcome of one parse; ``events`` and ``results`` read the same rows, so cache or write ``rows`` if both are used."""

    rows: DataFrame

    @property
    def events(self) -> DataFrame:
        return self.rows.where("kind = 'event'").select(*EVENT_COLUMNS)

    @property
    def results(self) -> DataFrame:
        return self.rows.where("kind = 'result'").select("result.*")


def enrich(events: DataFrame, *, parser: Parser, **context: str | None) -> DataFrame:
    """Fill missing evidence from context values and the parser's identity; empty text counts as missing."""
    filled = {"parser_name": parser.name, "parser_version": parser.version} | {k: v for k, v in context.items() if v is not None}
    if unknown := filled.keys() - set(EVIDENCE_FIELDS):
        raise ConfigurationError(f"not evidence: {sorted(unknown)}")
    evidence = F.col("evidence")
    for k, v in filled.items():
        evidence = evidence.withField(k, F.coalesce(F.nullif(F.col(f"evidence.{k}"), F.lit("")), F.lit(v)))
    return events.withColumn("evidence", evidence)


def with_evidence(events: DataFrame, **fields: Column) -> DataFrame:
    """Replace evidence fields by columns."""
    evidence = F.col("evidence")
    for k, v in fields.items():
        evidence = evidence.withField(k, v)
    return events.withColumn("evidence", evidence)


def canonicalize(events: DataFrame) -> DataFrame:
    """Recompute ``message_json`` and ``canonical`` from the other columns, in Arrow batches."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                attributes = json.loads(r["attributes_json"])
                record = {"schema_version": VERSION, "event_type": r["event_type"], "attributes": attributes, "timestamp": r["timestamp_iso"], "severity": r["severity"], "confidence": r["confidence"], "evidence": r["evidence"]}
                r["attributes_json"], r["message_json"], r["canonical"] = compact(attributes), canonical(message_of(attributes)), canonical(record)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([f for f in _ARROW if f.name in EVENT_COLUMNS]))

    return events.select(*EVENT_COLUMNS).mapInArrow(run, EVENTS)
