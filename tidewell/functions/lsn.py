"""Log positions: text ``X/Y`` in hex, without leading zeros, ordered as 64-bit numbers.

Text order is not position order (``0/9FFFFF`` comes before ``0/1000000``), so columns are compared by
a 16-digit key: cheap, JVM-side and fit for range partitioning.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = re.compile(r"([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})")
MOST = 2**64 - 1


def parse(text: str) -> int:
    """A position as a number; ValueError where it is none."""
    found = _FORM.fullmatch(text or "")
    if not found:
        raise ValueError(f"not a log position: {text!r}")
    return int(found[1], 16) << 32 | int(found[2], 16)


def show(position: int) -> str:
    if not 0 <= position <= MOST:
        raise ValueError(f"out of range: {position}")
    return f"{position >> 32:X}/{position & 0xFFFFFFFF:X}"


def sort_key(position: Column) -> Column:
    """16 hex digits whose text order is the order of positions."""
    half = lambda n: F.lpad(F.split_part(position, F.lit("/"), F.lit(n)), 8, "0")
    return F.upper(F.concat(half(1), half(2)))


def number(position: Column) -> Column:
    """The position as decimal(20,0); it may not fit a long."""
    return F.conv(sort_key(position), 16, 10).cast("decimal(20,0)")


def from_number(value: Column) -> Column:
    """A non-negative long as a position."""
    return F.concat_ws("/", F.hex(F.shiftrightunsigned(value.cast("long"), 32)), F.hex(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
