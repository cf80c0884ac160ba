"""What a parser promises; checked while plans are built."""

from __future__ import annotations

from dataclasses import dataclass

from tracewright.errors import CapabilityError, ConfigurationError


@dataclass(frozen=True)
class Capabilities:
    deterministic: bool = False
    stateful: bool = False
    requires_order: bool = False
    parallel_safe: bool = False
    partitionable: bool = False
    partition_framing: str | None = None
    aggregatable: bool = False

    def __post_init__(self) -> None:
        if self.partitionable and (self.stateful or self.requires_order):
            raise ConfigurationError("a stateful or ordered parser cannot be partitionable")
        if self.partitionable and not self.parallel_safe:
            raise ConfigurationError("a partitionable parser must be parallel safe")
        if self.partitionable != (self.partition_framing is not None):
            raise ConfigurationError("partitionable parsers, and no others, name their framing")

    @property
    def reproducible(self) -> bool:
        return self.deterministic and not self.stateful

    def require(self, name: str, operation: str) -> None:
        if not getattr(self, name):
            raise CapabilityError(f"{operation} needs a parser that is {name.replace('_', ' ')}")

    def require_framing(self, framing: str) -> None:
        self.require("partitionable", "partitioning")
        if self.partition_framing != framing:
            raise CapabilityError(f"partitioning by {framing} does not fit framing {self.partition_framing}")
