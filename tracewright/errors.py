"""Errors of the engine."""


class TracewrightError(Exception):
    """Base of all."""


class ConfigurationError(TracewrightError):
    """A parser, pattern or plan was built wrongly."""


class ParseError(TracewrightError):
    """A document does not have the form its parser reads."""


class AggregationError(TracewrightError):
    """Events cannot be aggregated, or aggregates not be rebuilt."""


class CapabilityError(TracewrightError):
    """An operation needs a capability that its parser lacks."""


class CodecError(TracewrightError):
    """A stored document is not in its format."""


class ReviewError(TracewrightError):
    """No draft passed the review."""
