"""Parsers by name."""

from __future__ import annotations

from dataclasses import dataclass
from importlib import metadata

from tracewright.errors import ConfigurationError
from tracewright.operators.builtin import JSONParser, PythonTracebackParser, SQLStatementParser, TimestampedLogParser
from tracewright.operators.mixed import MixedContentParser
from tracewright.operators.parsing import Parser
from tracewright.operators.patterns import ApplicationLogParser
from tracewright.plans.capabilities import Capabilities


@dataclass(frozen=True)
class ParserMetadata:
    name: str
    version: str
    parser_type: str
    capabilities: Capabilities


class ParserRegistry:
    """Registrations are all or nothing; names are sorted."""

    def __init__(self) -> None:
        self._parsers: dict[str, Parser] = {}

    def register(self, parser: Parser, *, replace: bool = False) -> None:
        self.register_all([parser], replace=replace)

    def register_all(self, parsers: list[Parser], *, replace: bool = False) -> None:
        new: dict[str, Parser] = {}
        for p in parsers:
            if not isinstance(p, Parser) or not p.name:
                raise ConfigurationError("only named parsers can be registered")
            if p.name in new or (p.name in self._parsers and not replace):
                raise ConfigurationError(f"parser {p.name} is registered already")
            new[p.name] = p
        self._parsers |= new

    def get(self, name: str) -> Parser:
        if name not in self._parsers:
            raise ConfigurationError(f"no parser {name}")
        return self._parsers[name]

    def unregister(self, name: str) -> Parser:
        parser = self.get(name)
        del self._parsers[name]
        return parser

    def names(self) -> list[str]:
        return sorted(self._parsers)

    def metadata(self, name: str) -> ParserMetadata:
        p = self.get(name)
        return ParserMetadata(p.name, p.version, type(p).__name__, p.capabilities)

    def discover(self, group: str = "tracewright.parsers") -> list[str]:
        """Load installed entry points; if one fails, none is registered."""
        found = []
        for point in metadata.entry_points(group=group):
            try:
                made = point.load()
                found.append(made() if isinstance(made, type) else made)
            except Exception as error:
                raise ConfigurationError(f"entry point {point.name} cannot be loaded") from error
        self.register_all(found)
        return sorted(p.name for p in found)


def default_registry() -> ParserRegistry:
    out = ParserRegistry()
    out.register_all([ApplicationLogParser(), TimestampedLogParser(), JSONParser(), PythonTracebackParser(), SQLStatementParser(), MixedContentParser()])
    return out
