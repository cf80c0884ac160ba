"""One entry to parsing, aggregation, storage and verified rebuilding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tracewright.errors import CapabilityError
from tracewright.operators import counts, evidence
from tracewright.operators.parsing import Parser, Parsing, parse_documents
from tracewright.operators.patterns import PatternParser
from tracewright.plans.codecs import AggregateCodec, EvidenceCodec, decode_aggregates, encode_aggregates
from tracewright.plans.observability import Sink, tell, watched
from tracewright.plans.registry import ParserRegistry, default_registry
from tracewright.sources.lines import frame_lines
from tracewright.sources.partitions import LinePartitioner, rebase


@dataclass
class Engine:
    """Plans are lazy; only rebuilding, and what its callers collect, runs jobs."""

    spark: SparkSession
    registry: ParserRegistry = None
    sink: Sink = None
    codec: AggregateCodec = None

    def __post_init__(self) -> None:
        self.registry = self.registry or default_registry()
        self.sink, self.codec = self.sink or Sink(), self.codec or EvidenceCodec()

    def parser(self, parser: Parser | str) -> Parser:
        found = self.registry.get(parser) if isinstance(parser, str) else parser
        tell(self.sink, "ParserSelected", found.name, version=found.version)
        return found

    def parse(self, parser: Parser | str, documents: DataFrame, *, continue_on_error: bool = False, event_types: set[str] | None = None) -> Parsing:
        found = self.parser(parser)
        with watched(self.sink, "Parse", found.name):
            return parse_documents(documents, found, continue_on_error=continue_on_error, event_types=event_types)

    def parse_one(self, parser: Parser | str, text: str | bytes, *, source_id: str | None = None, **options: Any) -> Parsing:
        return self.parse(parser, self.inputs([(source_id, text)]), **options)

    def inputs(self, items: Iterable[tuple[str | None, str | bytes]]) -> DataFrame:
        """A documents table of a few driver-side inputs, in their order."""
        rows = [(i, s, t.encode() if isinstance(t, str) else t) for i, (s, t) in enumerate(items)]
        return self.spark.createDataFrame(rows, "input_index long, source_id string, content binary")

    def parse_iter(self, parser: Parser | str, items: Iterable[tuple[str | None, str | bytes]], **options: Any) -> Iterator[Any]:
        """Results of driver-side inputs in input order, fetched partition by partition."""
        return self.parse(parser, self.inputs(items), **options).results.orderBy("input_index").toLocalIterator()

    def parse_lines(self, parser: PatternParser | str, documents: DataFrame) -> DataFrame:
        """Events by Catalyst expressions where all patterns allow it, else by Python."""
        found = self.parser(parser)
        native = found.native(frame_lines(documents))
        return native if native is not None else self.parse(found, documents).events

    def parse_partitions(self, parser: Parser | str, documents: DataFrame, partitioner: LinePartitioner | None = None) -> DataFrame:
        """Events of documents split into parts that parse independently, in document terms."""
        found = self.parser(parser)
        parts = (partitioner or LinePartitioner()).partition(documents, found.capabilities)
        tell(self.sink, "PartitionCreated", found.name)
        return rebase(parse_documents(parts, found).events, parts)

    def aggregate(self, parser: Parser | str, events: DataFrame) -> DataFrame:
        found = self.parser(parser)
        found.capabilities.require("aggregatable", "aggregation")
        with watched(self.sink, "Aggregation", found.name):
            return evidence.aggregate_evidence(events, reproducible=found.capabilities.reproducible)

    def count(self, events: DataFrame, group_by: Iterable[str] = ()) -> DataFrame:
        return counts.count_events(events, list(group_by))

    def merge(self, *sets: DataFrame) -> DataFrame:
        return evidence.merge_evidence(*sets)

    def materialize(self, parser: Parser | str, aggregates: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        """The exact events of aggregates: parsed again and compared, or the retained ones."""
        found = self.parser(parser)
        with watched(self.sink, "Materialize", found.name):
            if not found.capabilities.reproducible:
                evidence.require_lossless(False, aggregates)
                return evidence.retained_events(aggregates)
            if documents is None:
                raise CapabilityError("rebuilding the events of this parser needs their documents")
            return evidence.rebuild(aggregates, parse_documents(documents, found).events)

    def serialize(self, aggregates: DataFrame, indent: int | None = None) -> DataFrame:
        return encode_aggregates(aggregates, self.codec, indent)

    def deserialize(self, documents: DataFrame) -> DataFrame:
        return decode_aggregates(documents, self.codec)
