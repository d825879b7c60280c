"""Error categories and which of them may be retried."""

from __future__ import annotations

import builtins

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories written to the log.
CATEGORIES = (
    "GENERIC", "TIMEOUT", "RATE_LIMIT", "TRANSIENT", "AUTH", "CONFIG", "INVALID_OUTPUT", "MOCK",
)
PERMANENT = ("AUTH", "CONFIG")

# Categories by exception name; a subclass counts where noted.
BY_FAMILY = {"MockFailure": "MOCK", "InvalidModelOutput": "INVALID_OUTPUT", "TimeoutError": "TIMEOUT"}
BY_NAME = {
    "DeadlineExceeded": "TIMEOUT", "Aborted": "TIMEOUT",
    "ResourceExhausted": "RATE_LIMIT", "TooManyRequests": "RATE_LIMIT", "RateLimitError": "RATE_LIMIT",
}
STATUS_ERRORS = ("APIError", "ClientError", "ServerError")
BY_STATUS = {
    400: "CONFIG", 401: "AUTH", 403: "AUTH", 404: "CONFIG", 429: "RATE_LIMIT",
    500: "TRANSIENT", 502: "TRANSIENT", 503: "TRANSIENT", 504: "TRANSIENT",
}
TRANSIENT_NAMES = (
    "ServiceUnavailable", "InternalServerError", "GatewayTimeout", "BadGateway", "Unavailable",
)


class PipelineError(Exception):
    """Failure of one case that the run records and goes on from."""


class MockFailure(PipelineError):
    pass


class InvalidModelOutput(PipelineError):
    pass


class TemplateError(ValueError):
    pass


class SubmissionError(ValueError):
    pass


class DataValidationError(ValueError):
    pass


def classify_exception(exc: BaseException) -> str:
    """Category of an exception caught inside a task, by the tables that serve logged names too.

    Of the names of the exception and its bases, the family names count
    anywhere, the others for the exception itself; a system error is transient.
    """
    names = [c.__name__ for c in type(exc).__mro__]
    own, status = names[0], getattr(exc, "code", None)
    tables = [
        *(BY_FAMILY.get(n) for n in names),
        BY_NAME.get(own),
        BY_STATUS.get(status) if own in STATUS_ERRORS and isinstance(status, int) else None,
        "TRANSIENT" if own in TRANSIENT_NAMES or isinstance(exc, OSError) else None,
    ]
    return next(filter(None, tables), "GENERIC")


# Python's own errors below OSError, ConnectionError included, without TimeoutError.
OS_ERRORS = tuple(
    sorted(
        {c.__name__ for c in vars(builtins).values()
         if isinstance(c, type) and issubclass(c, OSError)} - {"TimeoutError"}
    )
)


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), key)


def classify(name: Column, status: Column) -> Column:
    """Category of a logged exception name and, if any, its HTTP status."""
    by_status = F.when(name.isin(*STATUS_ERRORS), _lookup(BY_STATUS, status.cast("int")))
    transient = F.when(name.isin(*OS_ERRORS, *TRANSIENT_NAMES), F.lit("TRANSIENT"))
    return F.coalesce(_lookup({**BY_FAMILY, **BY_NAME}, name), by_status, transient, F.lit("GENERIC"))


def is_retryable(category: Column) -> Column:
    return ~category.isin(*PERMANENT)
