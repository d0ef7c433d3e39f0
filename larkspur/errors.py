"""The one error that statements raise."""


class EngineError(Exception):
    """A statement that cannot be read, bound or run."""
