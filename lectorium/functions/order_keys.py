"""Order keys: texts whose order is the rows' order, so that a row is moved or put between two others by a key of its own alone.

A key is a number of 16 hex digits, and digits behind it where rows were put between others: a fraction. Keys never end in 0
behind the number, so there is always one between two keys. Rows of a library begin with key_of(ord); a row that is appended by
an edit gets appended_key(), behind all of those, from the edit's version and place. Where many rows are put in one place, keys grow by
a digit for about four of them; spread() gives a stretch of rows short keys again, and only these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 16
DIGITS = "0123456789abcdef"
LONGEST = 48
PLACES = 1 << 20  # of a commit
APPENDED = "f"  # the first digit of the number of an appended row; no ord that isn't negative has it


def key_of(ord_: Column) -> Column:
    """The key of a row of a library; ords below 0 come first."""
    return F.lpad(F.lower(F.hex(ord_.cast("long") + F.lit(1 << 62))), WIDTH, "0")


def appended_key(version: Column, seq: Column) -> Column:
    return F.concat(F.lit(APPENDED), F.lpad(F.lower(F.hex(version.cast("long") * PLACES + seq)), WIDTH - 1, "0"))


def between(low: str | None, high: str | None) -> str:
    """A key behind low and before high (None: no bound), as short as may be."""
    low, bounded, out = low or "", high is not None, ""
    if bounded and not low.rstrip("0") < high.rstrip("0"):
        raise ValueError(f"{low} isn't before {high}")
    while True:
        i = len(out)
        a = DIGITS.index(low[i]) if i < len(low) else 0
        b = (DIGITS.index(high[i]) if i < len(high) else 0) if bounded else 16
        if b - a > 1:
            return (out + DIGITS[(a + b) // 2]).ljust(WIDTH, "0")
        out += DIGITS[a]
        bounded = bounded and a == b


def spread(low: str | None, high: str | None, n: int) -> list[str]:
    """n keys in order between two, all about equally long."""
    if not n:
        return []
    middle = between(low, high)
    return [*spread(low, middle, (n - 1) // 2), middle, *spread(middle, high, n - 1 - (n - 1) // 2)]
