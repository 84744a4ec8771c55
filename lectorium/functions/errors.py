"""Kinds of failure of an outside call, by one table: as an expression over columns, and of one error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. kind: least and greatest status code (None: any or none), words of the message, words of the error's name, worth another try
RULES = (
    ("bad_key", 400, 400, ("api key", "api_key"), (), False),
    ("forbidden", 401, 401, (), (), False),
    ("forbidden", 403, 403, (), (), False),
    ("not_found", 404, 404, (), (), False),
    ("rate_limited", 429, 429, (), (), True),
    ("server", 500, 1 << 30, (), (), True),
    ("network", None, None, (), ("timeout", "connect", "network"), True),
)
OTHER, BAD_JSON = "other", "bad_json"
AGAIN = frozenset(rule[0] for rule in RULES if rule[5])
FIRST_DELAY, LONGEST = 2.0, 30.0


def _some(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (text.contains(w) for w in words))


def error_class(code: Column, message: Column, name: Column) -> Column:
    said, called = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    out = F.lit(OTHER)
    for kind, low, high, message_words, name_words, _ in reversed(RULES):  # the first that holds is the outermost
        test = F.lit(True) if low is None else code.between(low, high)
        for text, words in ((said, message_words), (called, name_words)):
            test = test & _some(text, words) if words else test
        out = F.when(test, kind).otherwise(out)
    return out


def kind_of(error: Exception) -> str:
    code = getattr(error, "code", None)
    code = code if isinstance(code, int) else None
    said, called = str(error).lower(), type(error).__name__.lower()

    def holds(rule: tuple) -> bool:
        _, low, high, message_words, name_words, _ = rule
        return (low is None or code is not None and low <= code <= high) and all(not words or any(w in text for w in words) for text, words in ((said, message_words), (called, name_words)))

    return next((rule[0] for rule in RULES if holds(rule)), OTHER)


def retryable(kind: Column) -> Column:
    return kind.isin(*sorted(AGAIN))


def delay_before(attempt: int) -> float:
    """Seconds before another try after so many tries beyond the first."""
    return min(FIRST_DELAY * 2**attempt, LONGEST)


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt) * FIRST_DELAY, F.lit(LONGEST))


def spacing_seconds(per_minute: Column) -> Column:
    """Seconds between calls; a rate of zero or less is no limit."""
    return F.when(per_minute > 0, F.lit(60.0) / per_minute).otherwise(F.lit(0.0))
