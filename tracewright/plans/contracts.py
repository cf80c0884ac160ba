"""Checks that an extension keeps its contract; each raises AssertionError with the reason."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.errors import CapabilityError, ConfigurationError
from tracewright.functions.strict_json import checked, loads
from tracewright.functions.text import frame
from tracewright.operators import evidence
from tracewright.operators.aggregators import Aggregator
from tracewright.operators.code_detection import CodeDetector
from tracewright.operators.parsing import Context, Parser, parse_documents
from tracewright.operators.patterns import Match, Pattern
from tracewright.plans.codecs import AggregateCodec
from tracewright.plans.observability import LifecycleEvent, Sink
from tracewright.plans.registry import ParserRegistry
from tracewright.plans.review import ChatMessage, LanguageModel


def _must(condition: Any, reason: str) -> None:
    if not condition:
        raise AssertionError(reason)


def check_parser(parser: Parser, samples: list[str]) -> None:
    _must(isinstance(parser.name, str) and parser.name, "a parser needs a name")
    for text in samples:
        a, b = parser.parse_text(text, Context("s")), parser.parse_text(text, Context("s"))
        if parser.capabilities.reproducible:
            _must([e.record() for e in a.events] == [e.record() for e in b.events], "a deterministic parser gave different events")
        size, lines = len(text.encode()), sum(1 for _ in frame(text))
        for e in a.events:
            checked(e.attributes)
            _must(e.start is None or 0 <= e.start <= e.end <= size, "an event lies outside its document")
            _must(e.line is None or 1 <= e.line <= max(lines, 1), "an event names a line that is not there")


def check_pattern(pattern: Pattern, hits: list[Any], misses: list[Any]) -> None:
    for v in hits:
        m = pattern.match(v)
        _must(isinstance(m, Match), f"{v!r} must match")
        checked(m.attributes)
        _must(pattern.to_event(m).event_type == pattern.event_type, "the event has another type")
    for v in misses:
        _must(pattern.match(v) is None, f"{v!r} must not match")


def check_aggregation(spark: SparkSession, parser: Parser, texts: list[str]) -> None:
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_id string, text string")
    events = parse_documents(df, parser).events
    kept = evidence.aggregate_evidence(events, reproducible=parser.capabilities.reproducible)
    _must(kept.agg(F.sum("count")).first()[0] == events.count(), "counts do not add up to the events")
    _must(kept.where(evidence.occurrences(F.col("groups")) != F.col("count")).count() == 0, "entries do not add up to the counts")


def check_aggregator(aggregator: Aggregator, events: DataFrame) -> None:
    """Partial aggregates merge into the whole one, whatever their order."""
    rows = lambda df: sorted(map(str, df.collect()))
    whole = rows(aggregator.aggregate(events))
    parts = [aggregator.aggregate(events.where(F.pmod(F.xxhash64("source_id"), F.lit(2)) == k)) for k in (0, 1)]
    _must(rows(aggregator.merge(parts)) == whole and rows(aggregator.merge(parts[::-1])) == whole, "merged partial aggregates are not those of all events")
    if not aggregator.lossless:
        try:
            aggregator.materialize(aggregator.aggregate(events), events)
        except CapabilityError:
            return
        raise AssertionError("a lossy aggregator materializes")
    given = events if aggregator.requires_source else None
    texts = lambda df: sorted(r.canonical for r in df.select("canonical").collect())
    _must(texts(aggregator.materialize(aggregator.aggregate(events), given)) == texts(events), "materialized events are not those aggregated")


def check_codec(codec: AggregateCodec, aggregates: DataFrame) -> None:
    rows = [r.asDict(True) for r in aggregates.collect()]
    _must(codec.decode(codec.encode(rows)) == rows, "the codec does not give back what it was given")
    for bad in ("", "{}", '{"format":"other","aggregates":[]}'):
        try:
            codec.decode(bad)
        except Exception:
            continue
        raise AssertionError(f"the codec accepts {bad!r}")


def check_json_codec(encode: Callable[[Any], str], decode: Callable[[str], Any]) -> None:
    for v in (None, True, 1, 2**100, 1.5, "é", [1], {"a": {"b": []}}):
        got = decode(encode(v))
        _must(got == v and type(got) is type(v), f"{v!r} comes back as {got!r}")
    for bad in ('{"a":1,"a":2}', "NaN", "1e400", "[1] 2", "{"):
        try:
            decode(bad)
        except ValueError:
            continue
        raise AssertionError(f"the codec accepts {bad!r}")


def check_partitioner(spark: SparkSession, partitioner: Any, text: str) -> None:
    df = spark.createDataFrame([("s", text)], "source_id string, text string")
    parts = sorted(partitioner.partition(df).collect(), key=lambda p: int(p.partition_id))
    lines = [x for x, _ in frame(text)]
    _must([x for p in parts for x, _ in frame(p.text)] == lines, "lines are lost or changed")
    line, offset = 1, 0
    for p in parts:
        _must((p.start_line, p.source_offset) == (line, offset), "a part's place is wrong")
        line += sum(1 for _ in frame(p.text))
        offset += sum(len(x.encode()) + 1 for x, _ in frame(p.text))


def check_sink(sink: Sink) -> None:
    from datetime import UTC, datetime

    sink.emit(LifecycleEvent("Check", datetime.now(UTC)))
    sink.flush()
    sink.close()


def check_model(model: LanguageModel) -> None:
    _must(isinstance(model.complete([ChatMessage("user", "hello")]), str), "a model answers with text")


def check_registry(registry: ParserRegistry, a: Parser, b: Parser) -> None:
    before = registry.names()
    registry.register(a)
    try:
        registry.register_all([b, a])
    except ConfigurationError:
        pass
    else:
        raise AssertionError("a name was registered twice")
    _must(b.name not in registry.names(), "a failed registration left something behind")
    _must(registry.get(a.name) is a and registry.names() == sorted(registry.names()), "names are not sorted or lost")
    registry.unregister(a.name)
    _must(registry.names() == before, "a parser stayed")


def check_tokenizer(spark: SparkSession, tokenizer: Callable) -> None:
    rows = spark.createDataFrame([("",), ("a",), ("é" * 50,)], "t string").select(tokenizer(F.col("t")).alias("n")).collect()
    _must(rows[0].n == 0 and all(r.n >= 0 for r in rows), "an empty text has no tokens, others not less")


def check_detector(detector: CodeDetector, code: list[tuple[str, str]], prose: list[str]) -> None:
    detector.prepare()
    for text, language in code:
        _must(detector.detect(text) == language, f"{text!r} is {language}")
    for text in prose:
        _must(detector.detect(text) is None, f"{text!r} is not code")


def check_backend(backend: Any, command: str, output: str, records: int) -> None:
    found = backend.parse(command, output)
    _must(len([found] if isinstance(found, dict) else found) == records, "another number of records")
    checked(found)


def valid_json(text: str) -> bool:
    try:
        loads(text)
    except ValueError:
        return False
    return True
