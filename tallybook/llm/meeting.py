"""Where records with and without a known town may meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side without town up to which it is broadcast.
OPEN_ROWS = 100_000


def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(fa, fb): different forms of equal ``keys`` in one town, or, where a town is missing, in one state if both have one.

    Every join is an equality. Which of them can have rows is counted first, so that tables
    without gaps are joined once; a side of few rows is broadcast, a larger one shuffles.
    """
    here = ["form", *keys, "town", "state"]
    sides = {"l": left.select(*here), "r": right.select(*here)}
    gaps = {s: {(r["open"], r["bare"]): r["n"] for r in t.groupBy((F.col("town") == "").alias("open"), (F.col("state") == "").alias("bare")).agg(F.count("*").alias("n")).collect()} for s, t in sides.items()}  # at most four rows each
    pairs = []

    def join(a: set[tuple[bool, bool]], b: set[tuple[bool, bool]], *on: str) -> None:
        """The join of the given (open, bare) kinds of rows of both sides."""
        n = [sum(gaps[s].get(k, 0) for k in kinds) for s, kinds in (("l", a), ("r", b))]
        if not min(n):
            return
        kind = F.struct((F.col("town") == "").alias("open"), (F.col("state") == "").alias("bare"))
        x, y = (t.filter(reduce(lambda p, q: p | q, [kind == F.struct(F.lit(o).alias("open"), F.lit(e).alias("bare")) for o, e in kinds])).alias(s) for (s, t), kinds in zip(sides.items(), (a, b)))
        x, y = (F.broadcast(t) if size <= OPEN_ROWS and size == min(n) and "town" not in on else t for t, size in zip((x, y), n))
        same = reduce(lambda p, q: p & q, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*keys, *on)])
        pairs.append(x.join(y, same).select(F.col("l.form").alias("fa"), F.col("r.form").alias("fb")))

    known, open_ = {(False, False), (False, True)}, {(True, False), (True, True)}
    join(known, known, "town")
    for a, b in ((open_, known | open_), (known, open_)):
        stated, bare = (lambda kinds: {k for k in kinds if not k[1]}), (lambda kinds: {k for k in kinds if k[1]})
        join(stated(a), stated(b), "state")
        join(stated(a), bare(b))
        join(bare(a), b)
    none = left.limit(0).select(F.col("form").alias("fa"), F.col("form").alias("fb"))
    return reduce(lambda x, y: x.unionByName(y), pairs, none).filter("fa != fb").distinct()
