"""Aggregators as a contract: a user's own one stands beside counts and evidence, and is routed to by parser.

An aggregator turns an events table into a table of its own shape. A routed aggregation is one such
table for each route, since their shapes differ; ``None`` names the route of all other parsers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.errors import CapabilityError, ConfigurationError
from tracewright.operators import counts, evidence


class Aggregator:
    """``aggregate`` and ``merge`` must be given; a lossless aggregator also materializes."""

    #: Whether ``materialize`` gives back every event.
    lossless = False
    #: Whether it needs the events of a fresh parse for that.
    requires_source = False

    def aggregate(self, events: DataFrame) -> DataFrame:
        raise NotImplementedError

    def merge(self, partials: Sequence[DataFrame]) -> DataFrame:
        """What ``aggregate`` gives for the events of all partials together."""
        raise NotImplementedError

    def materialize(self, aggregates: DataFrame, events: DataFrame | None = None) -> DataFrame:
        raise CapabilityError(f"{type(self).__name__} does not keep what its events were")


class CountAggregator(Aggregator):
    """Counts by event type and chosen attributes."""

    def __init__(self, group_by: Sequence[str] = ()):
        self.group_by = tuple(group_by)

    def aggregate(self, events: DataFrame) -> DataFrame:
        return counts.count_events(events, self.group_by)

    def merge(self, partials: Sequence[DataFrame]) -> DataFrame:
        return counts.merge_counts(*partials)


class EvidenceAggregator(Aggregator):
    """Evidence with checksums; without ``reproducible`` the events themselves are retained."""

    lossless = True

    def __init__(self, reproducible: bool = True):
        self.requires_source = reproducible

    def aggregate(self, events: DataFrame) -> DataFrame:
        return evidence.aggregate_evidence(events, reproducible=self.requires_source)

    def merge(self, partials: Sequence[DataFrame]) -> DataFrame:
        return evidence.merge_evidence(*partials)

    def materialize(self, aggregates: DataFrame, events: DataFrame | None = None) -> DataFrame:
        if not self.requires_source:
            evidence.require_lossless(False, aggregates)
            return evidence.retained_events(aggregates)
        if events is None:
            raise CapabilityError("these aggregates need the events of a fresh parse")
        return evidence.rebuild(aggregates, events)


class RoutingAggregator:
    """Gives the events of each named parser to its aggregator and all others to ``default``."""

    def __init__(self, default: Aggregator, routes: Mapping[str, Aggregator] | None = None):
        self.by_route: dict[str | None, Aggregator] = {None: default, **(routes or {})}
        for route, aggregator in self.by_route.items():
            if not isinstance(aggregator, Aggregator) or not (route is None or isinstance(route, str)):
                raise ConfigurationError("routes lead from parser names to aggregators")

    @property
    def lossless(self) -> bool:
        return all(a.lossless for a in self.by_route.values())

    @property
    def requires_source(self) -> bool:
        return any(a.requires_source for a in self.by_route.values())

    def _of(self, events: DataFrame, route: str | None) -> DataFrame:
        name = F.col("evidence.parser_name")
        named = [r for r in self.by_route if r is not None]
        elsewhere: Column = F.coalesce(name.isin(*named), F.lit(False)) if named else F.lit(False)
        return events.where(~elsewhere if route is None else name == route)

    def aggregate(self, events: DataFrame) -> dict[str | None, DataFrame]:
        return {route: a.aggregate(self._of(events, route)) for route, a in self.by_route.items()}

    def merge(self, partials: Sequence[Mapping[str | None, DataFrame]]) -> dict[str | None, DataFrame]:
        return {route: a.merge([p[route] for p in partials]) for route, a in self.by_route.items()}

    def materialize(self, aggregates: Mapping[str | None, DataFrame], events: DataFrame | None = None) -> DataFrame:
        """Source and canonical text of every event, each route's by its own aggregator."""
        found = []
        for route, a in self.by_route.items():
            given = self._of(events, route) if events is not None and a.requires_source else None
            found.append(a.materialize(aggregates[route], given).select("source_id", "seq", "canonical"))
        return reduce(DataFrame.unionByName, found)
