"""Column builders for text clean-up; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes, beyond the plain blank.
WHITE = " \t\n\r\x0b\x0c\u0085   　"


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    """Stripped text; null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def utc_day(c: Column) -> Column:
    """YYYY-MM-DD of a timestamp (sessions run in UTC)."""
    return F.date_format(F.to_date(c), "yyyy-MM-dd")
