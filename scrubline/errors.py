"""Errors raised by the engine."""


class ScrublineError(Exception):
    """Base of all errors of the engine."""


class RecipeError(ScrublineError):
    """A recipe that cannot be read or compiled."""


class OpError(ScrublineError):
    """An operation that cannot be applied to its column or table."""


class SchemaError(ScrublineError):
    """A target schema that cannot be used."""


class ReadError(ScrublineError):
    """An input that cannot be read."""


class DriftError(ScrublineError):
    """An input whose columns have changed since the recipe was made."""


class ValidationFailure(ScrublineError):
    """Rules with the policy error that rows have failed; failures lists them."""

    def __init__(self, message: str, failures: list | None = None):
        super().__init__(message)
        self.failures = failures or []
