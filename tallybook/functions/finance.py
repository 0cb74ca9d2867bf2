"""Column builders of money, dates, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "double"  # of sums made in decimal, so the order of rows does not matter
#: Bounds of contribution sizes by absolute amount (fixed values); zero belongs to none.
SIZE_BUCKETS = (("under_200", "0.01", "199.99"), ("200_499", "200.00", "499.99"), ("500_999", "500.00", "999.99"), ("1000_1999", "1000.00", "1999.99"), ("2000_plus", "2000.00", "999999999999.99"))


def money(c: Column) -> Column:
    """Decimal of a typed amount; null if it does not read as a number."""
    return F.regexp_replace(c, "[, $]", "").try_cast("decimal(14,2)")


def total(c: Column) -> Column:
    """Sum of money, zero for no rows."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def us_date(c: Column) -> Column:
    """Date of MM/DD/YYYY text."""
    return F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")), F.lit("MM/dd/yyyy")).cast("date")


def slug(c: Column) -> Column:
    """Lower-case words joined by '-'."""
    return F.btrim(F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]+", "-")), F.lit("-"))


def identity_safe(c: Column) -> Column:
    """Whether a name may stand in a link: no digits, not like an address, a slug that is not empty."""
    v = F.coalesce(c, F.lit(""))
    return ~v.rlike("[0-9]") & ~v.rlike(r"(?i)\b(po box|street|avenue|suite)\b") & (slug(v) != "")


def donor_key(*columns: Column) -> Column:
    """md5 over columns that tells null (N) from any text (V...)."""
    return F.md5(F.concat_ws("\x1f", *[F.when(c.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), c)) for c in columns]))


def tidy(c: Column) -> Column:
    """Trimmed text, null if empty."""
    return F.nullif(F.trim(c), F.lit(""))


def zip_digits(c: Column) -> Column:
    """First five digits wherever they stand; null if fewer."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) >= 5, F.left(d, F.lit(5)))


def zip_strict(c: Column) -> Column:
    """ZIP of the forms 5, 9 or 5-4 digits only."""
    return F.when(F.trim(c).rlike(r"^\d{5}(-?\d{4})?$"), F.left(F.trim(c), F.lit(5)))


def cycle(day: Column) -> Column:
    """Election cycle: the year, rounded up to even."""
    return (F.year(day) + F.year(day) % 2).cast("long")


def month_key(day: Column) -> Column:
    """YYYY-MM."""
    return F.date_format(day, "yyyy-MM")


def cents(c: Column) -> Column:
    """Whole cents of a sum of money."""
    return F.round(F.coalesce(F.sum(c), F.lit(0)) * 100, 0).cast("long")


def size_bucket(amount: Column) -> Column:
    """Name of the size bucket by absolute amount; null outside all."""
    out = None
    for name, low, high in SIZE_BUCKETS:
        hit = F.abs(amount).between(F.lit(low).cast("decimal(14,2)"), F.lit(high).cast("decimal(14,2)"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def employer_display(c: Column) -> Column:
    """Upper-case employer with single blanks; statuses and missing values in buckets of their own."""
    v = F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))
    return (
        F.when(v.isNull() | v.isin("", "N/A", "NA", "NONE", "UNKNOWN", "REQUESTED", "INFORMATION REQUESTED", "BEST EFFORTS", "NOT PROVIDED", "NOT AVAILABLE"), "(not given)")
        .when(v.isin("SELF", "SELF-EMPLOYED", "SELF EMPLOYED"), "SELF-EMPLOYED")
        .when(v.isin("RETIRED", "NOT EMPLOYED", "UNEMPLOYED"), "NOT EMPLOYED")
        .otherwise(v)
    )


def like_literal(text: str) -> str:
    """LIKE pattern that finds ``text`` as it stands."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def csv_cell(c: Column) -> Column:
    """Cell that a spreadsheet will not take for a formula."""
    return F.when(c.rlike(r"^\s*[=+@\-]"), F.concat(F.lit("'"), c)).otherwise(c)


def covers(start: Column, end: Column, day: Column) -> Column:
    """Half-open period [start, end) holds the day; an open bound is infinite."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (day < end))


def overlaps(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Half-open period meets the closed range [first, last]."""
    return (start.isNull() | (start < F.date_add(last, 1))) & (end.isNull() | (end > first))
