"""Patterns: a predicate on a value and a projection to an event."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.errors import ConfigurationError
from tracewright.functions.strict_json import checked, compact
from tracewright.functions.text import frame, right_trim
from tracewright.operators.parsing import Context, Event, Parsed, Parser
from tracewright.plans.capabilities import Capabilities


@dataclass(frozen=True)
class Match:
    attributes: dict[str, Any] = field(default_factory=dict)
    severity: str | None = None
    confidence: float | None = None


class Pattern:
    """``match`` tells whether a value fits; ``column`` does the same for a text column where Catalyst can."""

    deterministic = False

    def __init__(self, name: str, *, priority: int = 0, metadata: Mapping[str, Any] | None = None, event_type: str | None = None):
        if not name:
            raise ConfigurationError("a pattern needs a name")
        self.name, self.priority, self.metadata, self.event_type = name, priority, dict(metadata or {}), event_type or name

    @property
    def order(self) -> tuple[int, str]:
        return -self.priority, self.name

    def match(self, value: Any) -> Match | None:
        raise NotImplementedError

    def column(self, text: Column) -> Column | None:
        """struct(attributes_json, severity) where the text matches, else null; None if only Python can tell."""
        return None

    def to_event(self, m: Match) -> Event:
        return Event(self.event_type, m.attributes, severity=m.severity, confidence=m.confidence)


class RegexPattern(Pattern):
    """``re.search``; named groups that took part become attributes."""

    deterministic = True

    def __init__(self, name: str, expression: str | re.Pattern, flags: int = 0, *, severity: str | None = None, **options: Any):
        super().__init__(name, **options)
        try:
            self.expression = re.compile(expression, flags) if isinstance(expression, str) else expression
        except re.error as error:
            raise ConfigurationError(f"pattern {name}: {error}") from error
        self.severity = severity

    def match(self, value: Any) -> Match | None:
        found = self.expression.search(value) if isinstance(value, str) else None
        return found and Match({k: v for k, v in found.groupdict().items() if v is not None}, self.severity)

    def column(self, text: Column) -> Column | None:
        # Plain words and gaps read the same in both engines; all else runs Python's re.
        if self.expression.groupindex or self.expression.flags & ~re.UNICODE or not re.fullmatch(r"[A-Za-z0-9 _,:;='\"@#%&/<>-]+", self.expression.pattern):
            return None
        return F.when(text.contains(self.expression.pattern), F.struct(F.lit("{}").alias("attributes_json"), F.lit(self.severity).cast("string").alias("severity")))


class ExactPattern(Pattern):
    """The value equals ``expected``; fixed attributes."""

    deterministic = True

    def __init__(self, name: str, expected: Any, attributes: Mapping[str, Any] | None = None, *, severity: str | None = None, **options: Any):
        super().__init__(name, **options)
        self.expected, self.attributes, self.severity = expected, checked(dict(attributes or {})), severity

    def match(self, value: Any) -> Match | None:
        return Match(dict(self.attributes), self.severity) if type(value) is type(self.expected) and value == self.expected else None

    def column(self, text: Column) -> Column | None:
        if not isinstance(self.expected, str):
            return F.when(F.lit(False), F.struct(F.lit("{}").alias("attributes_json"), F.lit(None).cast("string").alias("severity")))
        return F.when(text.eqNullSafe(F.lit(self.expected)), F.struct(F.lit(compact(self.attributes)).alias("attributes_json"), F.lit(self.severity).cast("string").alias("severity")))


class PredicatePattern(Pattern):
    """Any function; attributes from ``extractor`` or none."""

    def __init__(self, name: str, predicate: Callable[[Any], bool], extractor: Callable[[Any], Mapping[str, Any]] | None = None, *, severity: str | None = None, **options: Any):
        super().__init__(name, **options)
        self.predicate, self.extractor, self.severity = predicate, extractor, severity

    def match(self, value: Any) -> Match | None:
        return Match(checked(dict(self.extractor(value))) if self.extractor else {}, self.severity) if self.predicate(value) else None


class StructuredPattern(PredicatePattern):
    """Mappings only; attributes default to the mapping."""

    def match(self, value: Any) -> Match | None:
        if not isinstance(value, Mapping) or not self.predicate(value):
            return None
        return Match(checked(dict(self.extractor(value) if self.extractor else value)), self.severity)


class SearchPattern(Pattern):
    """A search that Catalyst can do, with the whole line, the rest of it or a fixed text as message."""

    deterministic = True

    def __init__(self, name: str, python: str, java: str, message: Callable[[re.Match], str], native_message: Callable[[Column], Column], severity: str | None, priority: int, ignore_case: bool = True):
        super().__init__(name, priority=priority)
        self.python = re.compile(python, re.IGNORECASE if ignore_case else 0)
        self.java, self.message, self.native_message, self.severity = java, message, native_message, severity

    def match(self, value: Any) -> Match | None:
        found = self.python.search(value) if isinstance(value, str) else None
        return found and Match({"message": self.message(found)}, self.severity)

    def column(self, text: Column) -> Column | None:
        told = F.to_json(F.struct(self.native_message(text).alias("message")))
        return F.when(text.rlike(self.java), F.struct(told.alias("attributes_json"), F.lit(self.severity).cast("string").alias("severity")))


class PatternParser(Parser):
    """Every line against every pattern, by falling priority, then name; one event a match."""

    def __init__(self, patterns: list[Pattern] = (), *, name: str = "deterministic", version: str = "1", first_match_only: bool = False, capabilities: Capabilities | None = None):
        self.name, self.version, self.first_match_only = name, version, first_match_only
        self._patterns: dict[str, Pattern] = {}
        self._capabilities = capabilities
        for p in patterns:
            self.register(p)

    @property
    def capabilities(self) -> Capabilities:
        sure = all(p.deterministic for p in self.patterns)
        return self._capabilities or Capabilities(deterministic=sure, parallel_safe=True, partitionable=True, partition_framing="line", aggregatable=True)

    @property
    def patterns(self) -> list[Pattern]:
        return sorted(self._patterns.values(), key=lambda p: p.order)

    def register(self, pattern: Pattern, *, replace: bool = False) -> None:
        if pattern.name in self._patterns and not replace:
            raise ConfigurationError(f"pattern {pattern.name} is registered already")
        self._patterns[pattern.name] = pattern

    def unregister(self, name: str) -> Pattern:
        if name not in self._patterns:
            raise ConfigurationError(f"no pattern {name}")
        return self._patterns.pop(name)

    def parse_text(self, text: Any, context: Context) -> Parsed:
        out = Parsed(statistics={p.name: 0 for p in self.patterns})
        at, patterns = context.base, self.patterns
        for number, (line, width) in enumerate(frame(text), 1):
            for p in patterns:
                m = p.match(line)
                if m is not None:
                    out.statistics[p.name] += 1
                    out.events.append(replace(p.to_event(m), line=number, start=at, end=at + width, pattern=p.name))
                    if self.first_match_only:
                        break
            at += width
        return out

    def native(self, lines: DataFrame) -> DataFrame | None:
        hits = []
        for p in self.patterns:
            c = p.column(F.col("text"))
            if c is None:
                return None
            hits.append(F.when(c.isNotNull(), F.struct(F.lit(p.name).alias("pattern"), F.lit(p.event_type).alias("event_type"), c.getField("attributes_json").alias("attributes_json"), c.getField("severity").alias("severity"))))
        if not hits:
            return None
        found = F.array(F.coalesce(*hits)) if self.first_match_only else F.array(*hits)
        rows = lines.select("source_id", "line_number", "start_offset", "end_offset", F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("pos", "hit"))
        nothing = F.lit(None).cast("string")
        evidence = F.struct(
            F.col("source_id"), "start_offset", "end_offset", "line_number", F.lit(self.name).alias("parser_name"), F.lit(self.version).alias("parser_version"),
            F.col("hit.pattern").alias("pattern_name"), nothing.alias("partition_id"), nothing.alias("correlation_id"),
        )
        # Orders events within a source; gaps do not matter.
        seq = F.col("line_number") * len(hits) + F.col("pos")
        return rows.select(
            "source_id", F.lit(None).cast("bigint").alias("input_index"), seq.alias("seq"), F.col("hit.event_type").alias("event_type"), F.col("hit.attributes_json").alias("attributes_json"), F.lit(None).cast("timestamp").alias("ts"),
            nothing.alias("timestamp_iso"), F.col("hit.severity").alias("severity"), F.lit(None).cast("double").alias("confidence"), evidence.alias("evidence"), nothing.alias("message_json"), nothing.alias("canonical"),
        )


def pattern_statistics(events: DataFrame, sources: DataFrame, names: list[str]) -> DataFrame:
    """Matches of every pattern in every source, zeros included: source_id, pattern_name, matches."""
    every = sources.select("source_id").distinct().withColumn("pattern_name", F.explode(F.array(*map(F.lit, sorted(names)))))
    found = events.groupBy(F.col("source_id").alias("s"), F.col("evidence.pattern_name").alias("p")).agg(F.count("*").alias("n"))
    joined = every.join(found, F.col("source_id").eqNullSafe(F.col("s")) & (F.col("pattern_name") == F.col("p")), "left")
    return joined.select("source_id", "pattern_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("matches"))


#: Phrases of the failure signals, with priority and severity.
SIGNALS = {
    "service_down": ("service down|service stopped|unavailable", 20, "ERROR"),
    "connection_failure": ("connection refused|connection reset|connect failed", 20, "ERROR"),
    "authentication_failure": ("authentication failed|invalid credentials|login failed", 20, "ERROR"),
    "authorization_failure": ("authorization failed|permission denied|forbidden", 20, "ERROR"),
    "timeout": ("timeout|timed out", 15, "ERROR"),
    "oom": ("OOM|out of memory", 15, "CRITICAL"),
    "retry": (r"retry|retrying|attempt \d+", 10, None),
}
TRACEBACK_HEAD = "Traceback (most recent call last):"
#: Java's classes that match the same characters as Python's.
_SPACE, _DIGIT, _WORD = r"(?U:[\s\x1c-\x1f])", r"\p{Nd}", r"[\p{L}\p{N}_]"


def _java(python: str) -> str:
    body = python.replace(r"\s", _SPACE).replace(r"\d", _DIGIT)
    return f"(?iu)(?<!{_WORD})(?:{body})(?!{_WORD})"


def signal_patterns() -> list[Pattern]:
    whole = lambda m: m.string.rstrip()
    out: list[Pattern] = [SearchPattern(k, rf"\b(?:{w})\b", _java(w), whole, right_trim, severity, priority) for k, (w, priority, severity) in SIGNALS.items()]
    head = re.escape(TRACEBACK_HEAD)
    out.append(SearchPattern("stack_trace", rf"^\s*{head}", rf"^{_SPACE}*{head}", lambda m: TRACEBACK_HEAD, lambda c: F.lit(TRACEBACK_HEAD), "ERROR", 10, ignore_case=False))
    for name, word, severity in (("error", "ERROR", "ERROR"), ("warning", "WARN(?:ING)?", "WARNING")):
        java = f"(?iu)(?<!{_WORD}){word}(?!{_WORD})[: ]?{_SPACE}*"
        rest = lambda c, j=java: F.regexp_extract(c, f"{j}(.*)", 1)
        out.append(SearchPattern(name, rf"\b{word}\b[: ]?\s*(?P<message>.*)", java, lambda m: m["message"], rest, severity, 5))
    return out


class ApplicationLogParser(PatternParser):
    """Failure signals of application logs: ten patterns, all of which may match a line."""

    def __init__(self, patterns: list[Pattern] | None = None):
        super().__init__(signal_patterns() if patterns is None else patterns, name="application-log")
