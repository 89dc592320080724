"""Column functions that bring keys and lines to a comparable form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: the Unicode property and the four information separators.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"


def id_key(c: Column) -> Column:
    """An id without outer white space, in lower case; null if nothing is left."""
    k = F.lower(F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", ""))
    return F.when(k != "", k)


def strip(c: Column) -> Column:
    """Text without outer white space of any kind."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def line_key(c: Column) -> Column:
    """A line in lower case, white space and digit runs unified, trimmed."""
    spaced = F.regexp_replace(F.lower(c), rf"{SPACE}+", " ")
    return F.trim(F.regexp_replace(spaced, "[0-9]+", "0"))
