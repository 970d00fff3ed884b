"""Limits, modes and errors that all parts share."""

from __future__ import annotations

from enum import StrEnum

DEFAULT_KIND = "artifact"
MARKDOWN, PLAINTEXT = "markdown", "plaintext"
MAX_SECTIONS = 10_000
SEARCH_LIMIT, SEARCH_LIMIT_MOST = 10, 250
POOL_FACTOR, POOL_LEAST, POOL_MOST = 5, 25, 250
RESCORE_FACTOR = 3  #: of a coarse first stage, so many times the pool is scored again in full
FLOAT32, INT8, BINARY = "float32", "int8", "binary"
QUANTIZATIONS = (FLOAT32, INT8, BINARY)
NO_PARENT = -1
VECTOR_ARM, TEXT_ARM = "vector", "fts"
SCHEMA_VERSION = 5
SCHEMA_VERSIONS = (2, 3, 4, 5)


class ReuseStatus(StrEnum):
    DISABLED = "disabled"
    ACTIVE = "active"
    UNAVAILABLE = "unavailable"
    INCOMPATIBLE = "incompatible"
    ERROR = "error"


class TooManySections(ValueError):
    """A record has more sections than its cap."""


class UnsupportedSchemaVersion(ValueError):
    pass


class StaleUpdatePlan(RuntimeError):
    """The index changed between planning and publication of an update."""


class UpdatePlanTooLarge(ValueError):
    pass


class IntegrityError(RuntimeError):
    pass


class MissingIndex(FileNotFoundError):
    def __init__(self, path: str):
        super().__init__(f"no index at {path}")
        self.path = path


def search_limit(limit: int) -> int:
    """0 or less is the default; more than the most is an error, never clamped."""
    if limit <= 0:
        return SEARCH_LIMIT
    if limit > SEARCH_LIMIT_MOST:
        raise ValueError(f"search limit {limit} is above {SEARCH_LIMIT_MOST}")
    return limit


def pool_size(limit: int) -> int:
    """Candidates of each arm before fusion."""
    return min(POOL_MOST, max(POOL_LEAST, POOL_FACTOR * limit))


def section_cap(cap: int) -> int | None:
    """Negative: none; 0: the default."""
    return None if cap < 0 else cap or MAX_SECTIONS


def quantization(mode: str | None) -> str:
    mode = (mode or "").strip().lower() or FLOAT32
    if mode not in QUANTIZATIONS:
        raise ValueError(f"unknown quantization {mode!r}")
    return mode


def search_dimension(wanted: int, stored: int, mode: str) -> int | None:
    """The prefix on which a two-stage search starts, or None for a search in full."""
    if wanted <= 0 or wanted == stored:
        return None
    if mode != FLOAT32:
        raise ValueError(f"a search dimension needs {FLOAT32} vectors, not {mode}")
    if wanted > stored:
        raise ValueError(f"search dimension {wanted} is above the stored {stored}")
    return wanted


def listed(values) -> list[str]:
    """Trimmed values of a record or section filter, blank ones dropped; an empty list means no filter."""
    return sorted({x.strip() for x in values or () if x.strip()})


def listed_kinds(values) -> list[str] | None:
    """Trimmed kinds of a search; blank ones stay and match nothing. None: no filter."""
    return [x.strip() for x in values] if values else None
