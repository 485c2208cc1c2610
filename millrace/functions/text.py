"""Text expressions: Column forms of the scalar functions that row closures usually apply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() removes (Spark's trim() alone removes only U+0020).
WHITESPACE = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Python's str.strip(): drops every kind of white space at both ends, and looks at nothing between them."""
    return F.btrim(c, F.lit(WHITESPACE))


def or_empty(c: Column) -> Column:
    """``x or ""`` for strings."""
    return F.coalesce(c, F.lit(""))


def tokens(c: Column, pattern: str = "[a-zA-Z]+") -> Column:
    """All matches of pattern in the lower-cased text; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
