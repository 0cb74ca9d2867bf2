"""Text similarity: trigrams in the JVM, Jaro-Winkler in Arrow batches."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text: lower case, two blanks before and one after each word."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)).cast("double"), F.lit(0.0))


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler similarity with the usual prefix weight 0.1 of up to four letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


def _jaro_winkler_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")


def jaro_winkler(a: str | Column, b: str | Column) -> Column:
    """Jaro-Winkler similarity of two text columns, in Arrow batches."""
    return F.pandas_udf(_jaro_winkler_batch, "double")(a, b)


#: Bits of the letters A to Z (so many occurrences each) and of all other characters together; what rounding may take from a bound.
REPEATS, OTHERS, ROUNDING = 4, 24, 1e-9


def letters_of(text: str) -> tuple[int, int, int, int, int]:
    """(low, high, spare, size, start): bits of a text's characters, how many of them have no bit of their own, length, first four."""
    bits, seen = 0, Counter()
    for c in text:
        k, seen[c] = seen[c], seen[c] + 1
        if "A" <= c <= "Z":
            bits |= (1 << (ord(c) - 65) * REPEATS + k) if k < REPEATS else 0
        else:
            bits |= 1 << 26 * REPEATS + (7 * ord(c) + k) % OTHERS
    start = 0
    for c in text[:4].ljust(4, "\0"):
        start = start << 16 | ord(c) & 0xFFFF
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(bits & (1 << 64) - 1), signed(bits >> 64), len(text) - bits.bit_count(), len(text), signed(start)


def _letters_batch(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([letters_of(x) if x is not None else (None,) * 5 for x in texts], columns=["low", "high", "spare", "size", "start"], dtype=object).astype("Int64")


def letters(c: str | Column) -> Column:
    """Struct of ``letters_of`` a text column, for ``jaro_winkler_bound``."""
    return F.pandas_udf(_letters_batch, "low long, high long, spare long, size long, start long")(c)


def jaro_winkler_bound(a: str, b: str) -> Column:
    """What the Jaro-Winkler similarity of two texts does not exceed, from their ``letters``, in the JVM; null where a text is.

    No more characters match than the texts share, whatever their order.
    """
    x, y = (lambda k: F.col(f"{a}.{k}")), (lambda k: F.col(f"{b}.{k}"))
    shared = F.bit_count(x("low").bitwiseAND(y("low"))) + F.bit_count(x("high").bitwiseAND(y("high"))) + F.least(x("spare"), y("spare"))
    jaro = F.when(x("size") + y("size") == 0, 1.0).otherwise(F.least((shared / F.greatest(x("size"), F.lit(1)) + shared / F.greatest(y("size"), F.lit(1)) + 1) / 3, F.lit(1.0)))
    apart = x("start").bitwiseXOR(y("start"))
    same = F.when(apart == 0, 4)
    for n in (3, 2, 1):
        same = same.when(F.shiftrightunsigned(apart, 64 - 16 * n) == 0, n)
    return F.when(apart.isNotNull(), jaro + 0.1 * same.otherwise(0) * (1 - jaro) + ROUNDING)
