"""Exceptions.  Everything the library raises on purpose is a HushframeError."""


class HushframeError(Exception):
    """Base of the library's errors."""


class PolicyError(HushframeError, ValueError):
    """Unknown profile or impossible policy."""


class DataError(HushframeError, ValueError):
    """The frame cannot be analysed: no columns, duplicate names, or a stream."""


class ModelError(HushframeError):
    """The model gave nothing usable."""


class SafetyError(HushframeError):
    """A plan, query or answer that the policy refuses."""
