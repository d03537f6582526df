"""White space as texts of filings and listings have it: not just ASCII, which is all that Spark's ``\\s`` and ``trim`` know."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, as a pattern (Spark's and DuckDB's alike) and one by one.
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WHITE_CHARACTERS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def single_spaced(c: Column) -> Column:
    """Runs of white space as one space each."""
    return F.regexp_replace(c, WHITE, " ")


def stripped(c: Column | str) -> Column:
    """The text without white space at its ends."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_CHARACTERS))
