"""Rule-based and probabilistic record linkage (E4-E16): blocking, Fellegi-Sunter scores, components.

Pairs come from equality rules only; pattern counts, not pairs, go through expectation
maximisation, so the driver holds at most levels^fields rows. Components use label
propagation with pointer jumping; each round is written to the shared folder.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.plans.stage import materialize, shuffled

#: Prior of a match, turns of expectation maximisation, floor of probabilities (documented defaults).
PRIOR, TURNS, FLOOR = 0.01, 20, 1e-4
#: Rows of a part of a hot block; random pairs that show chance agreement (a documented bound of the sample).
BLOCK, SAMPLE = 250, 200_000


def blocked_pairs(rows: DataFrame, rules: dict[str, list[str]], rid: str = "id") -> DataFrame:
    """(l, r, rule, rules, stratum, a_*, b_*): pairs that agree on all columns of a rule, once, with the first rule that made them.

    ``rid`` is unique. The columns of both sides come along, so earlier rules are read
    from the pair itself and pairs are never shuffled. Blocks of more than ``BLOCK``
    rows are split over several tasks: one side into parts, the other sent to each part.
    """
    made = []
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns])
    agree = lambda columns: reduce(lambda x, y: x & y, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in columns])
    all_rules = F.array_sort(F.array_compact(F.array(*[F.when(agree(columns), name) for name, columns in rules.items()])))
    stratum = F.concat_ws(" ", *[F.when(agree(columns), name) for name, columns in sorted(rules.items())])
    earlier = F.lit(False)
    for name, columns in rules.items():
        parts = F.ceil(F.count("*").over(W.partitionBy(*columns)) / BLOCK).cast("int")
        block = rows.na.drop(subset=columns).withColumn("parts", parts)
        a = side(block.withColumn("part", F.pmod(F.xxhash64(rid), "parts").cast("int")).drop("parts"), "a")
        b = side(block.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), "b")
        # parts of a block are even: a broadcast side would leave them to few tasks and pass through the driver
        pairs = a.join(shuffled(b), agree([*columns, "part"]) & (F.col(f"a_{rid}") < F.col(f"b_{rid}"))).filter(~earlier).drop("a_part", "b_part")
        made.append(pairs.select(F.col(f"a_{rid}").alias("l"), F.col(f"b_{rid}").alias("r"), F.lit(name).alias("rule"), all_rules.alias("rules"), stratum.alias("stratum"), "*"))
        earlier = earlier | F.coalesce(agree(columns), F.lit(False))
    return reduce(lambda x, y: x.unionByName(y), made)


def block_sizes(rows: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """(rule, blocks, rows, pairs, largest): what each rule would make, without making pairs."""
    out = []
    for name, columns in rules.items():
        g = rows.na.drop(subset=columns).groupBy(*columns).agg(F.count("*").alias("n"))
        out.append(g.agg(F.lit(name).alias("rule"), F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")))
    return reduce(lambda x, y: x.unionByName(y), out)


def random_pairs(rows: DataFrame, rid: str = "id", pairs: int = SAMPLE) -> DataFrame:
    """(a_*, b_*): about ``pairs`` pairs of different rows drawn by hash, the same on every run.

    Each side draws a bucket of its own; rows of one bucket meet, so no row meets many others.
    """
    n = rows.count()
    buckets = max(1, n * n // (2 * max(pairs, 1)))
    a, b = (rows.select(F.pmod(F.xxhash64(F.col(rid), F.lit(seed)), F.lit(buckets)).alias("bucket"), *[F.col(c).alias(f"{s}_{c}") for c in rows.columns]) for seed, s in ((1, "a"), (2, "b")))
    return a.join(b, "bucket").filter(F.col(f"a_{rid}") < F.col(f"b_{rid}")).drop("bucket")


def sampled_u(compared: DataFrame, fields: list[str], levels: list[int]) -> list[list[float]]:
    """u of each field's levels from compared random pairs: how often rows agree by chance; missing values (-1) do not count."""
    counts = compared.agg(*[F.count(F.when(F.col(f) == k, 1)).alias(f"{f}_{k}") for f, n in zip(fields, levels) for k in range(n)]).first()
    out = []
    for f, n in zip(fields, levels):
        seen = [counts[f"{f}_{k}"] for k in range(n)]
        out.append([max((c + FLOOR) / (sum(seen) + n * FLOOR), FLOOR) for c in seen])
    return out


def train_strata(patterns: list[tuple[str, tuple[int, ...], int]], levels: list[int], u_known: list[list[float]] | None = None) -> tuple[dict[str, float], list[list[float]], list[list[float]]]:
    """Prior of each stratum, m and u of each field's levels by expectation maximisation over pattern counts; a known u stays."""
    priors = {s: PRIOR for s, _, _ in patterns}
    m = [[(k + 1) / sum(range(1, n + 1)) for k in range(n)] for n in levels]
    u = [list(x) for x in u_known] if u_known else [[(n - k) / sum(range(1, n + 1)) for k in range(n)] for n in levels]
    for _ in range(TURNS):
        weights = []
        for s, g, c in patterns:
            pm = priors[s] * math.prod(m[f][k] for f, k in enumerate(g) if k >= 0)
            pu = (1 - priors[s]) * math.prod(u[f][k] for f, k in enumerate(g) if k >= 0)
            weights.append((s, g, c, pm / (pm + pu)))
        for s in priors:
            matched, everything = sum(c * w for t, _, c, w in weights if t == s), sum(c for t, _, c, _ in weights if t == s)
            priors[s] = min(max(matched / max(everything, 1), FLOOR), 1 - FLOOR)
        for f, n in enumerate(levels):
            for k in range(n):
                hit = [(c, w) for _, g, c, w in weights if g[f] == k]
                seen = [(c, w) for _, g, c, w in weights if g[f] >= 0]
                m[f][k] = max(sum(c * w for c, w in hit) / max(sum(c * w for c, w in seen), FLOOR), FLOOR)
                if not u_known:
                    u[f][k] = max(sum(c * (1 - w) for c, w in hit) / max(sum(c * (1 - w) for c, w in seen), FLOOR), FLOOR)
    return priors, m, u


def train(patterns: list[tuple[tuple[int, ...], int]], levels: list[int]) -> tuple[float, list[list[float]], list[list[float]]]:
    """Prior, m and u of pairs that all come from one stratum."""
    priors, m, u = train_strata([("", g, c) for g, c in patterns], levels)
    return priors.get("", PRIOR), m, u


def pattern_probabilities(counted: list[tuple[str, tuple[int, ...], int]], levels: list[int], fixed: dict[str, list[int]], u_known: list[list[float]] | None = None) -> list[tuple[str, tuple[int, ...], float]]:
    """(stratum, pattern, probability) of counted patterns of comparison levels (-1: missing), one level per field.

    A stratum is the rules that pairs met, parted by blanks, and has a prior of its own; a
    field that one of its rules fixes (by number in ``fixed``) says nothing and counts as missing.
    """
    known = lambda s, g: tuple(-1 if any(f in fixed.get(rule, []) for rule in s.split(" ")) else k for f, k in enumerate(g))
    merged: dict[tuple[str, tuple[int, ...]], int] = {}
    for s, g, c in sorted(counted):
        merged[s, known(s, g)] = merged.get((s, known(s, g)), 0) + c
    priors, m, u = train_strata([(s, g, c) for (s, g), c in merged.items()], levels, u_known)
    out = []
    for s, g, _ in counted:
        weight = math.log(priors[s] / (1 - priors[s])) + sum(math.log(m[f][k] / u[f][k]) for f, k in enumerate(known(s, g)) if k >= 0)
        out.append((s, g, 1 / (1 + math.exp(-weight))))
    return out


def classify(p: Column) -> Column:
    """match, probable_match, possible_match or no_match (fixed thresholds)."""
    return F.when(p >= 0.95, "match").when(p >= 0.80, "probable_match").when(p >= 0.60, "possible_match").otherwise("no_match")


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): smallest id of each connected component of (l, r) pairs."""
    edges = materialize(pairs.select("l", "r").unionByName(pairs.select(F.col("r").alias("l"), F.col("l").alias("r"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("l").alias("id")).agg(F.least(F.min("r"), F.min("l")).alias("component")), "labels")
    for _ in range(rounds):
        near = edges.join(labels, F.col("r") == F.col("id")).select(F.col("l").alias("id"), "component")
        low = labels.unionByName(near).groupBy("id").agg(F.min("component").alias("component"))
        jump = low.select(F.col("id").alias("j"), F.col("component").alias("further"))
        nxt = materialize(low.join(jump, F.col("component") == F.col("j"), "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        changed = nxt.join(labels.withColumnRenamed("component", "old"), "id").filter("component != old").take(1)
        labels = nxt
        if not changed:
            return labels
    raise RuntimeError("components did not converge")


def weakest_links(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(component, members, confidence, l, r): each component with its least sure decision.

    ``pairs`` are (l, r, probability) inside the components ``found`` (id, component); the
    minimum is combined before the shuffle, so a giant component costs one row per task.
    """
    weak = pairs.join(found, F.col("l") == F.col("id")).groupBy("component").agg(F.min(F.struct("probability", "l", "r")).alias("w"))
    size = found.groupBy("component").agg(F.count("*").alias("members"))
    return size.join(weak, "component").select("component", "members", F.col("w.probability").alias("confidence"), "w.l", "w.r")
