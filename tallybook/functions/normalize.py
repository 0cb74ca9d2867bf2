"""Readers of typed names, dates, addresses, employers and codes as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Name parts that are no names, generational suffixes, US state codes of the serving area.
PREFIXES = ("MR", "MRS", "MS", "MISS", "DR", "HON", "REV", "PROF")
SUFFIXES = ("JR", "SR", "II", "III", "IV", "ESQ", "MD", "PHD")
STATE_CODES = {"NORTH CAROLINA": "NC", "SOUTH CAROLINA": "SC", "VIRGINIA": "VA", "OHIO": "OH", "GEORGIA": "GA", "TENNESSEE": "TN", "PENNSYLVANIA": "PA"}
INDUSTRIES = (("(SCHOOL|UNIVERSITY|TEACH)", "education"), ("(HOSPITAL|MEDICAL|CLINIC|DENTAL)", "health"), ("(BANK|INSURANCE|FINANC)", "finance"), ("(FARM|TIMBER|NURSERY)", "agriculture"))
#: Years outside this window are taken for misread dates; two-digit years below the pivot belong to this century.
FIRST_YEAR, LAST_YEAR, PIVOT = 1970, 2050, 50


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: (w != "") & ~w.isin(*PREFIXES))


def _no_suffix(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*SUFFIXES))


def person_name(c: Column) -> Column:
    """(first, middle, last, suffix, canonical) of "LAST, FIRST M SUF" or of the natural order."""
    u = F.upper(F.replace(c, F.lit("."), F.lit("")))
    comma = F.instr(u, ",") > 0
    front = F.when(comma, _words(F.split_part(u, F.lit(","), F.lit(1))))
    rest = _words(F.replace(F.when(comma, F.substr(u, F.instr(u, ",") + 1)).otherwise(u), F.lit(","), F.lit(" ")))
    suffix = F.get(F.filter(F.concat(F.coalesce(front, F.array().cast("array<string>")), rest), lambda w: w.isin(*SUFFIXES)), F.lit(0))
    given = _no_suffix(rest)
    last = F.when(comma, F.nullif(F.array_join(_no_suffix(front), " "), F.lit(""))).otherwise(F.when(F.size(given) > 1, F.get(given, F.size(given) - 1)))
    middles = F.when(comma, F.slice(given, 2, 99)).otherwise(F.slice(given, 2, F.greatest(F.size(given) - 2, F.lit(0))))
    middle = F.nullif(F.array_join(middles, " "), F.lit(""))
    first = F.get(given, F.lit(0))
    return F.struct(first.alias("first"), middle.alias("middle"), last.alias("last"), suffix.alias("suffix"), F.nullif(F.concat_ws(" ", first, F.left(middle, F.lit(1)), last, suffix), F.lit("")).alias("canonical"))


def typed_date(c: Column) -> Column:
    """Date of MMDDYYYY, ISO or US notation with one or two digits and two- or four-digit years; null outside the reliable years."""
    t = F.trim(c)
    short = F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", 3)
    year = F.when(short != "", F.when(short.cast("int") < PIVOT, F.lit("20")).otherwise("19"))
    whole = F.when(short != "", F.concat(F.regexp_extract(t, r"^(\d{1,2}/\d{1,2}/)\d{2}$", 1), year, short)).otherwise(t)
    parsed = (
        F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("MMddyyyy")))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.left(t, F.lit(10)), F.lit("yyyy-MM-dd")))
        .when(whole.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(whole, F.lit("M/d/yyyy")))
    ).cast("date")
    return F.when(F.year(parsed).between(FIRST_YEAR, LAST_YEAR), parsed)


def address_parts(street: Column, state: Column, zip_code: Column) -> Column:
    """(number, unit, street, state, zip5, zip4); junk streets are null."""
    s = F.upper(F.regexp_replace(F.trim(street), r"\s+", " "))
    s = F.when(~s.isin("", "N/A", "NONE", "UNKNOWN", "NOT AVAILABLE"), s)
    unit = F.nullif(F.regexp_extract(s, r"(?:APT|STE|SUITE|UNIT|#)\.? ?#?([0-9]+-?[A-Z]?|[A-Z])$", 1), F.lit(""))
    bare = F.nullif(F.trim(F.regexp_replace(s, r",? ?(?:APT|STE|SUITE|UNIT|#)\.? ?#?([0-9]+-?[A-Z]?|[A-Z])$", "")), F.lit(""))
    number = F.nullif(F.regexp_extract(bare, r"^([0-9]+[A-Z]?) ", 1), F.lit(""))
    code = F.upper(F.trim(state))
    named = F.coalesce(*[F.when(code == k, v) for k, v in STATE_CODES.items()], F.when(F.length(code) == 2, code))
    z = F.regexp_replace(zip_code, "[^0-9]", "")
    return F.struct(number.alias("number"), unit.alias("unit"), F.regexp_replace(bare, r"^[0-9]+[A-Z]? ", "").alias("street"), named.alias("state"), F.when(F.length(z) >= 5, F.left(z, F.lit(5))).alias("zip5"), F.when(F.length(z) == 9, F.right(z, F.lit(4))).alias("zip4"))


def industry(employer: Column, occupation: Column) -> Column:
    """Industry of the employer, else of the occupation."""
    look = lambda c: F.coalesce(*[F.when(F.upper(c).rlike(p), name) for p, name in INDUSTRIES])
    return F.coalesce(look(employer), look(occupation))


def junk_weight(employer: Column) -> Column:
    """Weight of an employer as evidence: hardly any for a placeholder."""
    return F.when(F.upper(F.trim(employer)).isin("N/A", "NONE", "UNKNOWN", "RETIRED", "SELF", "SELF-EMPLOYED", "NOT EMPLOYED", ""), 0.01).otherwise(1.0)


def counterparty_role(kind: Column, amount: Column) -> Column:
    """What the other side of a transaction is."""
    return F.when(kind == "Individual", "donor").when(kind.isin("Party Comm", "Non-Party Comm"), "committee").when(kind == "Loan Proceeds", "lender").when(kind.isin("Operating Exp", "Coord Party Exp"), "vendor").when((kind == "Refund") & (amount > 0), "refunded").otherwise("unknown")


def election_day(year: Column) -> Column:
    """The Tuesday after the first Monday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "Mon"), 1)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th..."""
    teens = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teens, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def period_text(start: Column, end: Column) -> Column:
    """[start,end) with infinite open bounds."""
    return F.concat(F.lit("["), F.coalesce(start.cast("string"), F.lit("-infinity")), F.lit(","), F.coalesce(end.cast("string"), F.lit("infinity")), F.lit(")"))


def same_district(mine: Column, theirs: Column) -> Column:
    """At-large districts are written AL, 00 or not at all; an unknown district of mine fits any."""
    large = lambda c: F.when(c.isNull() | c.isin("AL", "00", "0"), "AL").otherwise(F.lpad(c, 2, "0"))
    return mine.isNull() | (large(mine) == large(theirs))


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Composed form of a text; pure ASCII never leaves the JVM's hands changed."""
    return F.pandas_udf(_nfc, "string")(c)


#: Legal endings of employers and what stands for none.
LEGAL_ENDINGS = ("INC", "LLC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LLP", "LP")
NO_EMPLOYER = ("", "N A", "NA", "NONE", "UNKNOWN", "REQUESTED", "INFORMATION REQUESTED", "BEST EFFORTS")


def employer(composed: Column) -> Column:
    """Employer from composed text: upper case, punctuation to blanks, one legal ending dropped, placeholders null."""
    v = F.trim(F.regexp_replace(F.regexp_replace(F.upper(composed), r"[^\p{L}\p{N}&]", " "), " +", " "))
    v = F.regexp_replace(v, r"\bL L C\b", "LLC")
    return F.when(~v.isin(*NO_EMPLOYER), F.regexp_replace(v, f" ({'|'.join(LEGAL_ENDINGS)})$", ""))


def override_threshold(given: float | None, default: float = 0.8) -> float:
    """A match threshold: the default, or a finite override above 0.8 and up to 1."""
    if given is None:
        return default
    if not 0.8 < given <= 1:
        raise ValueError(f"threshold {given} is not in (0.8, 1]")
    return float(given)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based identifier (version 5): the same name always gives the same UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
