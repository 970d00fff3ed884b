"""What went wrong with a request, in few classes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import WHITE, trim_white

AUTH, UNAVAILABLE, RATE_LIMIT, SCHEMA, SERVER, TIMEOUT, TRANSPORT = "auth", "dependency_unavailable", "rate_limit", "schema_mismatch", "server", "timeout", "transport"
BY_STATUS = {401: AUTH, 403: AUTH, 429: RATE_LIMIT, 408: TIMEOUT, 504: TIMEOUT}
#: In order; the first class of which a phrase stands in the message.
PHRASES = (
    (AUTH, ("api key", "apikey", "auth", "unauthorized", "forbidden")),
    (RATE_LIMIT, ("rate limit", "too many requests", "quota exceeded")),
    (TIMEOUT, ("context deadline exceeded", "client.timeout exceeded", "timeout awaiting response headers", "i/o timeout", "timed out")),
    (TRANSPORT, ("connection refused", "connection reset", "broken pipe", "couldn't connect to server", "failed to connect", "no such host", "network is unreachable", "unexpected eof")),
)


def classify(status: int = 0, error: BaseException | None = None, message: str = "") -> str:
    """The status decides first, then the message, then the error's type."""
    if status in BY_STATUS:
        return BY_STATUS[status]
    if status >= 500:
        return SERVER
    text = message.strip(WHITE).lower()
    for name, phrases in PHRASES:
        if name == TIMEOUT and isinstance(error, TimeoutError):
            return TIMEOUT
        if name == TRANSPORT and (isinstance(error, OSError) or text == "eof"):
            return TRANSPORT
        if any(p in text for p in phrases):
            return name
    return UNAVAILABLE


def classified(status: Column, message: Column) -> Column:
    """``classify`` for a table of logged failures, by status and message."""
    text = F.lower(trim_white(F.coalesce(message, F.lit(""))))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in BY_STATUS.items():
        out = out.when(status == code, F.lit(name))
    out = out.when(status >= 500, F.lit(SERVER))
    for name, phrases in PHRASES:
        some = F.lit(False)
        for p in phrases:
            some = some | text.contains(p)
        out = out.when(some | (text == "eof") if name == TRANSPORT else some, F.lit(name))
    return out.otherwise(F.lit(UNAVAILABLE))


@dataclass(frozen=True)
class Details:
    model: str = ""
    endpoint: str = ""
    failure_class: str = ""
    http_status: int = 0
    timeout_ms: int = 0
    max_retries: int = 0
    batch_size: int = 0
    input_count: int = 0

    def fields(self) -> dict:
        """What is set."""
        return {k: v for k, v in ((k, v.strip(WHITE) if isinstance(v, str) else v) for k, v in asdict(self).items()) if (v if isinstance(v, str) else v > 0)}


class ProviderError(Exception):
    def __init__(self, message: str, details: Details | None = None, status: int = 0, cause: BaseException | None = None):
        super().__init__(message)
        self.status, self.__cause__ = status, cause
        self.details = replace(details, http_status=status) if details and status else details

    @property
    def failure_class(self) -> str:
        return self.details.failure_class.strip() if self.details else ""

    def fields(self) -> dict:
        return self.details.fields() if self.details else {}


def error_value(value) -> str:
    """The message of an ``error`` value: a string, or an object's message, error or detail."""
    if isinstance(value, str):
        return value.strip(WHITE)
    if isinstance(value, dict):
        parts = [value.get(k) for k in ("message", "error", "detail")]
        if all(x is None or isinstance(x, str) for x in parts):
            return next((x.strip(WHITE) for x in parts if x and x.strip(WHITE)), "")
    return ""


def error_message(body: bytes | str) -> str:
    """The message in a JSON error body: its ``message``, else what ``error`` says."""
    try:
        payload = json.loads(body)
    except ValueError:
        return ""
    if not isinstance(payload, dict) or not isinstance(payload.get("message", ""), (str, type(None))):
        return ""
    return (payload.get("message") or "").strip(WHITE) or error_value(payload.get("error"))


def logged_message(body: Column) -> Column:
    """``error_message`` for a column of bodies."""
    got = [F.get_json_object(body, p) for p in ("$.message", "$.error.message", "$.error.error", "$.error.detail")]
    plain = F.when(~F.coalesce(F.get_json_object(body, "$.error"), F.lit("{")).startswith("{"), F.get_json_object(body, "$.error"))
    filled = lambda c: F.when(trim_white(c) != "", trim_white(c))
    return F.coalesce(filled(got[0]), filled(plain), *map(filled, got[1:]), F.lit(""))
