"""Arguments of the plane: bounds, coercion and errors with codes."""

from __future__ import annotations

from datetime import datetime

#: Bounds of limits, titles, kinds and texts (fixed values).
SEARCH_LIMIT, LIST_LIMIT, FEED_LIMIT = (1, 50), (1, 100), (1, 100)
TITLE, KIND, CHUNKS, CHUNK_CHARS = 500, 200, 2_000, 100_000


class PlaneError(Exception):
    """code: 400 bad input, 403 not the owner, 404 not there, 500 not configured, 501 not supported."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def limit(value, bounds: tuple[int, int], default: int) -> int:
    """A whole number within bounds; None gives the default; strings of digits are taken."""
    if value is None or value == "":
        return default
    try:
        n = int(str(value).strip())
    except ValueError:
        raise PlaneError(400, f"limit must be a whole number, not {value!r}") from None
    if not bounds[0] <= n <= bounds[1]:
        raise PlaneError(400, f"limit must be from {bounds[0]} to {bounds[1]}")
    return n


def cursor(value) -> int:
    """A feed cursor: a whole number from 0; None is the beginning."""
    if value is None or value == "":
        return 0
    try:
        n = int(str(value).strip())
    except ValueError:
        n = -1
    if n < 0:
        raise PlaneError(400, "after must be a whole number from 0")
    return n


def non_blank(value, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise PlaneError(400, f"{name} must not be blank")
    return value.strip()


def bounded(value: str, name: str, most: int) -> str:
    if len(value) > most:
        raise PlaneError(400, f"{name} has more than {most} characters")
    return value


def one_of(value: str, allowed: tuple[str, ...], name: str) -> str:
    if value not in allowed:
        raise PlaneError(400, f"{name} must be one of {', '.join(allowed)}")
    return value


def moment(value: str | datetime | None, name: str) -> datetime | None:
    """A time from ISO notation, without zone; None stays."""
    if value is None or isinstance(value, datetime):
        return value
    try:
        t = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError:
        raise PlaneError(400, f"{name} is no time: {value!r}") from None
    return t.replace(tzinfo=None) if t.tzinfo is None else (t - t.utcoffset()).replace(tzinfo=None)
