"""Consolidating pairwise links into groups (problem 5): low-diameter decomposition.

Every vertex draws an exponential shift from a hash of its id; clusters start
growing from the vertices with the largest shifts and claim neighbours round by
round, each vertex going to the centre whose shifted distance is smallest. After
a few rounds every cluster becomes one super-vertex, inter-cluster edges are kept
once, and the decomposition recurses until no edge is left. The assignments of
all levels are composed at the end. Growth is a join and a minimum with map-side
combine; a claim always travels along an edge, so a cluster never leaves its
component, however many rounds are given. Each level's results are written to the
shared folder, so a lost executor costs at most one level.

Edge cases: ids compare in lower case and stripped; links with a null or blank
end and self links link nothing; repeated links count once; circles are ordinary
components; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import blank_to_null
from tallybook.plans.stage import materialize

#: Rate of the exponential shifts; rounds of growth per level; levels before giving up.
BETA, ROUNDS, MAX_LEVELS = 0.1, 3, 60


def _shift(v: Column, level: int) -> Column:
    """Exponential variate drawn from the hash of a vertex and the level."""
    u = (F.pmod(F.xxhash64(v, F.lit(level)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(BETA)


def _arcs(edges: DataFrame) -> DataFrame:
    """(src, dst, step): both directions of each edge, and a loop of no length at each vertex."""
    a, b = F.col("a"), F.col("b")
    rows = F.array(*[F.struct(x.alias("src"), y.alias("dst"), F.lit(1.0 if n < 2 else 0.0).alias("step")) for n, (x, y) in enumerate(((a, b), (b, a), (a, a), (b, b)))])
    return edges.select(F.explode(rows).alias("r")).select("r.*").groupBy("src", "dst").agg(F.min("step").alias("step"))


def _grow(arcs: DataFrame, level: int) -> DataFrame:
    """(v, center): clusters after some rounds of growth."""
    # a claim is (arrival time, centre); arrival = distance - shift, smallest first; loops carry a vertex's own claim on
    claims = arcs.filter("step = 0").select(F.col("src").alias("v"), F.struct((-_shift(F.col("src"), level)).alias("at"), F.col("src").alias("center")).alias("claim"))
    for _ in range(ROUNDS):
        offered = arcs.join(claims, F.col("src") == F.col("v")).select(F.col("dst").alias("v"), F.struct((F.col("claim.at") + F.col("step")).alias("at"), F.col("claim.center").alias("center")).alias("claim"))
        claims = offered.groupBy("v").agg(F.min("claim").alias("claim"))
    return claims.select("v", F.col("claim.center").alias("center"))


def links(table: DataFrame, left: str, right: str) -> DataFrame:
    """Clean undirected links, each once, as (a, b) with a < b."""
    a, b = (F.lower(blank_to_null(F.col(c).cast("string"))) for c in (left, right))
    return table.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (a != b).alias("real"), (a.isNotNull() & b.isNotNull()).alias("whole")).filter("whole and real").select("a", "b").distinct()


def groups(pairs: DataFrame) -> DataFrame:
    """(id, root) for every end of the (a, b) ``pairs``; root names the component."""
    edges = materialize(pairs.select("a", "b"), "links")
    levels: list[DataFrame] = []
    for level in range(MAX_LEVELS):
        assigned = materialize(_grow(materialize(_arcs(edges), "arcs"), level), "clusters")
        levels.append(assigned)
        ca, cb = assigned.select(F.col("v").alias("a"), F.col("center").alias("ca")), assigned.select(F.col("v").alias("b"), F.col("center").alias("cb"))
        across = edges.join(ca, "a").join(cb, "b").filter("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        edges = materialize(across, "contracted")
        if not edges.take(1):
            break
    else:
        raise RuntimeError("components did not contract")
    out = levels[0].select(F.col("v").alias("id"), F.col("center").alias("root"))
    for assigned in levels[1:]:
        up = assigned.select(F.col("v").alias("root"), F.col("center").alias("above"))
        out = out.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
    return out


def person_groups(absorption: DataFrame) -> DataFrame:
    """(person_id, group_id): each linked person with the smallest id of its group."""
    members = materialize(groups(links(absorption, "absorbed_person_id", "canonical_person_id")), "members")
    # the root of a giant group is hot: minima are combined before the shuffle, and AQE splits the join back
    least = members.groupBy("root").agg(F.min("id").alias("group_id"))
    return members.join(least, "root").select(F.col("id").alias("person_id"), "group_id")
