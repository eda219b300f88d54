"""DNA letters and their small integer codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code of a base is its place in this string; any other letter is 5.
ALPHABET = "ACTGN"
UNKNOWN_CODE = 5


def base_code(base: Column) -> Column:
    """A 0, C 1, T 2, G 3, N 4, anything else 5."""
    at = F.instr(F.lit(ALPHABET), base)
    known = (F.length(base) == 1) & (at > 0)
    return F.when(known, at - 1).otherwise(F.lit(UNKNOWN_CODE)).cast("int")


def base_char(code: Column) -> Column:
    """The letter of a code; null for a code outside 0..4."""
    inside = (code >= 0) & (code < len(ALPHABET))
    return F.when(inside, F.substring(F.lit(ALPHABET), (code + 1).cast("int"), F.lit(1)))
