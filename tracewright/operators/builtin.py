"""Built-in document parsers: timestamped logs, JSON, Python tracebacks, command output, SQL scripts."""

from __future__ import annotations

import asyncio
import csv
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.errors import ConfigurationError, ParseError
from tracewright.functions.strict_json import checked, loads
from tracewright.functions.text import decode_source, frame
from tracewright.operators.parsing import Context, Event, Parsed, Parser, issue
from tracewright.operators.patterns import Pattern, PatternParser
from tracewright.plans.capabilities import Capabilities

#: Log levels.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL")
WHOLE = Capabilities(deterministic=True, parallel_safe=True, aggregatable=True)
BY_LINE = Capabilities(deterministic=True, parallel_safe=True, partitionable=True, partition_framing="line", aggregatable=True)


def parse_timestamp(text: str) -> datetime:
    """An ISO 8601 time with an offset, as ``datetime.fromisoformat`` reads it."""
    value = datetime.fromisoformat(text)
    if value.utcoffset() is None:
        raise ValueError("no time zone")
    return value


class TimestampedLogParser(Parser):
    """``TIME LEVEL message`` on every line; the first line of another form fails the document."""

    name = "timestamped-log"
    capabilities = BY_LINE

    def __init__(self, line_pattern: str | re.Pattern | None = None):
        self.pattern = re.compile(line_pattern or rf"(?P<at>\S+)\s+(?P<level>{'|'.join(LEVELS)})\s+(?P<message>.+)")
        if missing := {"at", "level", "message"} - self.pattern.groupindex.keys():
            raise ConfigurationError(f"the line pattern lacks groups {sorted(missing)}")

    def parse_text(self, text: Any, context: Context) -> Parsed:
        out, at = Parsed(statistics={"log": 0}), context.base
        for number, (line, width) in enumerate(frame(decode_source(text, self.name)), 1):
            m = self.pattern.fullmatch(line)
            if m is None:
                raise ParseError(f"invalid timestamped log at line {number}")
            when, level, message = m["at"], m["level"], m["message"]
            if not (when and level and message):
                raise ParseError(f"incomplete timestamped log at line {number}")
            try:
                stamp = datetime.fromisoformat(when)
            except ValueError:
                raise ParseError(f"invalid log timestamp at line {number}") from None
            if stamp.utcoffset() is None:
                raise ParseError(f"log timestamp must have a timezone at line {number}")
            extra = {k: v for k, v in m.groupdict().items() if k not in ("at", "level", "message") and v is not None}
            out.events.append(Event("log", {"level": level, "message": message, **extra}, stamp, level, line=number, start=at, end=at + width, pattern="log"))
            out.statistics["log"] += 1
            at += width
        return out


def _unparsed(text: str, context: Context, pattern: str) -> Event:
    return Event("unparsed", {"text": text}, line=1, start=context.base, end=context.base + len(text.encode()), pattern=pattern)


class JSONParser(Parser):
    """A whole document as one ``json_record``; one that is not strict JSON becomes ``unparsed`` with an issue."""

    name = "json"
    capabilities = WHOLE

    def __init__(self, decode: Callable[[str], Any] = loads):
        self.decode = decode

    def parse_text(self, text: Any, context: Context) -> Parsed:
        out = Parsed(statistics={"json_record": 0})
        if not isinstance(text, str | bytes):  # decoded already: no place in a text
            out.statistics["json_record"] = 1
            out.events.append(Event("json_record", {"value": checked(text)}, pattern="json_record"))
            return out
        text = decode_source(text, self.name)
        try:
            value = checked(self.decode(text))
        except (ValueError, RecursionError) as error:
            out.events.append(_unparsed(text, context, "unparsed"))
            out.errors.append(issue(f"invalid JSON: {error}", "ParseError", context))
            return out
        out.statistics["json_record"] = 1
        out.events.append(Event("json_record", {"value": value}, line=1, start=context.base, end=context.base + len(text.encode()), pattern="json_record"))
        return out


#: The forms of a frame's place and of the line that names the exception.
FRAME = re.compile(r'^\s*File "(?P<file>.+)", line (?P<line>\d+), in (?P<function>.+)$')
RAISED = re.compile(r"^(?P<exception_type>[\w.]+)(?:: (?P<message>.*))?$")


class PythonTracebackParser(Parser):
    """One ``python_exception`` with its frames; the last line that can name an exception does."""

    name = "python-traceback"
    capabilities = WHOLE

    def parse_text(self, text: Any, context: Context) -> Parsed:
        text = decode_source(text, self.name)
        frames, raised = [], None
        for line, _ in frame(text):
            if m := FRAME.match(line):
                frames.append({"file": m["file"], "line": int(m["line"]), "function": m["function"]})
            elif not line.strip().startswith("Traceback ") and (m := RAISED.match(line.strip())):
                raised = m
        if raised is None:
            raise ParseError("no exception in the traceback")
        attributes = {"exception_type": raised["exception_type"], "message": raised["message"] or "", "frames": frames}
        end = context.base + len(text.encode())
        return Parsed([Event("python_exception", attributes, severity="ERROR", line=1, start=context.base, end=end, pattern="python_exception")], statistics={"python_exception": 1})


def traceback_frames(lines: DataFrame) -> DataFrame:
    """Per source: exception_type, message and frames in order, by Catalyst expressions over a lines table."""
    blank = r"(?U:[\s\x1c-\x1f])"
    place = rf'^{blank}*File "(.+)", line (\p{{Nd}}+), in (.+)$'
    raised = r"^([\p{L}\p{N}_.]+)(?:: (.*))?$"
    t = F.regexp_replace("text", rf"^{blank}+|{blank}+$", "")
    is_place = F.col("text").rlike(place)
    part = lambda k: F.regexp_extract("text", place, k)
    found = F.when(is_place, F.struct("line_number", part(1).alias("file"), part(2).cast("int").alias("line"), part(3).alias("function")))
    rows = lines.withColumns({"frame": found, "named": F.when(~is_place & ~t.startswith("Traceback ") & t.rlike(raised), t)})
    grouped = rows.groupBy("source_id").agg(F.array_sort(F.collect_list("frame")).alias("frames"), F.max_by("named", F.when(F.col("named").isNotNull(), F.col("line_number"))).alias("raised"))
    return grouped.where("raised is not null").select("source_id", F.regexp_extract("raised", raised, 1).alias("exception_type"), F.regexp_extract("raised", raised, 2).alias("message"), F.col("frames"))


# -- Command output --------------------------------------------------------------------------


def _table(text: str) -> list[dict[str, str]]:
    lines = [x for x, _ in frame(text) if x.strip()]
    if not lines:
        return []
    header = lines[0].split()
    return [dict(zip(header, x.split(None, len(header) - 1), strict=False)) for x in lines[1:]]


def _df(text: str) -> list[dict[str, Any]]:
    out = []
    for row in _table(text.replace("Mounted on", "Mounted_on", 1)):
        made: dict[str, Any] = {}
        for k, v in row.items():
            name = {"Filesystem": "filesystem", "Mounted_on": "mounted_on", "Use%": "use_percent", "Capacity": "use_percent", "Used": "used", "Available": "available", "Avail": "available", "Size": "size"}.get(k, k.lower().replace("-", "_"))
            digits = v.rstrip("%")
            made[name] = int(digits) if digits.isdigit() else v
        out.append(made)
    return out


def _key_values(text: str) -> list[dict[str, str]]:
    made = {}
    for line, _ in frame(text):
        key, mark, value = line.partition("=" if "=" in line else ":")
        if mark and key.strip():
            made[key.strip()] = value.strip()
        elif line.strip():
            raise ParseError(f"not a key and value: {line!r}")
    return [made] if made else []


def _separated(delimiter: str) -> Callable[[str], list[dict[str, str]]]:
    def read(text: str) -> list[dict[str, str]]:
        rows = list(csv.DictReader(io.StringIO(text), delimiter=delimiter, strict=True))
        if any(None in r or None in r.values() for r in rows):
            raise ParseError("a row does not fit the header")
        return rows

    return read


#: Parsers of whole command outputs that the engine brings along.
COMMANDS: dict[str, Callable[[str], Any]] = {"df": _df, "kv": _key_values, "csv": _separated(","), "tsv": _separated("\t"), "table": _table}


class CommandOutputBackend:
    """Turns a command's output into records: a list of objects, or one object."""

    def parse(self, command: str, text: str) -> Any:
        raise NotImplementedError

    def supports(self, command: str) -> bool:
        return True


class BuiltinBackend(CommandOutputBackend):
    def supports(self, command: str) -> bool:
        return command in COMMANDS

    def parse(self, command: str, text: str) -> Any:
        return COMMANDS[command](text)


class CLIOutputParser(Parser):
    """Command mode: a ``cli_record`` per record of the backend. Pattern mode: patterns over lines."""

    def __init__(self, patterns: list[Pattern] | None = None, *, command: str | None = None, backend: CommandOutputBackend | None = None, name: str = "cli-output"):
        if (patterns is None) == (command is None):
            raise ConfigurationError("give either patterns or a command")
        self.name, self.command, self.backend = name, command, backend or BuiltinBackend()
        if command and (command.endswith("_s") or not self.backend.supports(command)):
            raise ConfigurationError(f"no parser of whole outputs for {command}")
        self.lines = PatternParser(patterns, name=name) if patterns is not None else None
        self.capabilities = self.lines.capabilities if self.lines else WHOLE

    def parse_text(self, text: Any, context: Context) -> Parsed:
        if self.lines:
            return self.lines.parse_text(decode_source(text, self.name), context)
        text = decode_source(text, self.name)
        span = {"start": context.base, "end": context.base + len(text.encode()), "pattern": self.command}
        out = Parsed(statistics={self.command: 0})
        try:
            found = self.backend.parse(self.command, text)
            records = [found] if isinstance(found, dict) and found else list(found or [])
            if not all(isinstance(r, dict) for r in records):
                raise ParseError("a record is not an object")
            records = [checked(r) for r in records]
        except Exception as error:
            out.events.append(_unparsed(text, context, self.command))
            out.errors.append(issue(f"{self.command}: {error}", "ParseError", context))
            return out
        if not records and text.strip():
            out.warnings.append(f"{self.command} found no records in the output")
        out.events += [Event("cli_record", r, **span) for r in records]
        out.statistics[self.command] = len(records)
        return out

    def native(self, lines: DataFrame) -> DataFrame | None:
        return self.lines.native(lines) if self.lines else None


# -- SQL scripts -----------------------------------------------------------------------------

_TOKEN = re.compile(r"(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<quoted>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|(?P<word>[A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)*)|(?P<mark>.)", re.DOTALL)


def split_statements(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(first character, end, tokens) of each statement; quotes and comments hide semicolons."""
    start, tokens = None, []
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "skip":
            continue
        if m[0] == ";":
            if tokens:
                yield start, m.end(), tokens
            start, tokens = None, []
            continue
        if m.lastgroup == "mark" and m[0] in "'\"":
            raise ParseError("a quote is not closed")
        start = m.start() if start is None else start
        tokens.append(m[0])
    if tokens:
        yield start, len(text.rstrip()), tokens


def describe_statement(tokens: list[str]) -> dict[str, Any]:
    """Operation, physical tables in order of appearance, and normalised text of a statement."""
    upper = [t.upper() for t in tokens]
    named = {tokens[i - 1].lower() for i in range(1, len(tokens) - 1) if upper[i] == "AS" and tokens[i + 1] == "(" and upper[0] == "WITH"}
    operation, depth = None, 0
    for t in upper:
        depth += (t == "(") - (t == ")")
        if depth == 0 and t in ("SELECT", "INSERT", "UPDATE", "DELETE"):
            operation = t.lower()
            break
    if operation is None:
        raise ParseError(f"unsupported SQL statement: {tokens[0]}")
    tables: list[str] = []
    for i, t in enumerate(upper[:-1]):
        if t in ("FROM", "JOIN", "INTO") or (t == "UPDATE" and (i == 0 or operation == "update")):
            k = i + 1
            while k < len(tokens) and re.match(r"[A-Za-z_\"]", tokens[k]):
                if tokens[k].lower() not in named and tokens[k] not in tables:
                    tables.append(tokens[k])
                k += 1
                while k < len(tokens) and re.match(r"[A-Za-z_]", tokens[k]) and upper[k] not in _ENDS and t == "FROM":
                    k += 1  # alias
                if not (t == "FROM" and k < len(tokens) and tokens[k] == ","):
                    break
                k += 1
    return {"message": f"{operation} {','.join(tables)}".rstrip(), "operation": operation, "tables": tables, "sql": " ".join(tokens)}


_ENDS = {"WHERE", "JOIN", "LEFT", "RIGHT", "INNER", "FULL", "CROSS", "ON", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "SET", "USING", "RETURNING"}


class SQLStatementParser(Parser):
    """One ``sql_statement`` a statement; what it says is its operation and tables."""

    name = "sql-statements"
    capabilities = WHOLE

    def parse_text(self, text: Any, context: Context) -> Parsed:
        text = decode_source(text, self.name)
        out, starts, at = Parsed(statistics={"sql_statement": 0}), [], 0
        for line in text.splitlines(keepends=True):
            starts.append(at)
            at += len(line)
        from bisect import bisect_right

        for a, b, tokens in split_statements(text):
            first, last = bisect_right(starts, a), bisect_right(starts, b - 1)
            span = context.base + len(text[:a].encode()), context.base + len(text[:b].encode())
            out.events.append(Event("sql_statement", describe_statement(tokens) | {"line_span": [first, last]}, line=first, start=span[0], end=span[1], pattern="sql_statement"))
            out.statistics["sql_statement"] += 1
        return out


# -- Parsers that wait or ask a model --------------------------------------------------------


class AsyncParser(Parser):
    """A user's coroutine parser; each worker call drives it to its end. Write its output before a second use."""

    capabilities = Capabilities(aggregatable=True)

    async def parse_async(self, text: Any, context: Context) -> Parsed:
        raise NotImplementedError

    def parse_text(self, text: Any, context: Context) -> Parsed:
        return asyncio.run(self.parse_async(text, context))


class SemanticParser(AsyncParser):
    """A parser backed by a model: never deterministic, so its aggregates keep their events."""

    def __init__(self, model: Any):
        self.model = model


class FunctionParser(Parser):
    """A function from text and context to events."""

    def __init__(self, name: str, function: Callable[[str, Context], list[Event]], *, version: str = "1", capabilities: Capabilities = WHOLE):
        self.name, self.version, self.function, self.capabilities = name, version, function, capabilities

    def parse_text(self, text: Any, context: Context) -> Parsed:
        events = [replace(e, pattern=e.pattern or self.name) for e in self.function(text, context)]
        return Parsed(events)
