"""Money of candidates, independent spending, coverage and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions import finance as X
from tallybook.plans.stage import table
from tallybook.queries.registry import Catalogue
from tallybook.sources.exports import TX, transactions

C = Catalogue()
#: Cycles served, the newest by default; ceiling of plausible amounts; stances by kind of transaction (stand-ins of this data).
CYCLES, CEILING = (2022, 2024), 400
STANCES = {"Party Comm": "support", "Non-Party Comm": "oppose"}
_CYCLES = "cycles(cycle) AS (VALUES (2022), (2024))"
_STANCE = "CASE kind WHEN 'Party Comm' THEN 'support' WHEN 'Non-Party Comm' THEN 'oppose' END"
_RECEIPT = "kind = 'Individual' AND form IS DISTINCT FROM 'Draft' AND coalesce(report, '') NOT LIKE '%Third Quarter'"
_M = "DOUBLE"


def receipt(first: Column, last: Column) -> Column:
    """The canonical receipt: in the window, from an individual, no memo entry, no superseded report."""
    memo, superseded = F.col("form").eqNullSafe(F.lit("Draft")), F.coalesce("report", F.lit("")).like("%Third Quarter")
    return F.coalesce(F.col("day").between(first, last) & (F.col("kind") == "Individual") & ~memo & ~superseded, F.lit(False))


def in_cycle(t: DataFrame) -> DataFrame:
    """Transactions with their cycle, of the served cycles only: an equality instead of a range join."""
    return t.withColumn("cycle", X.cycle(F.col("day"))).filter(F.col("cycle").isin(*CYCLES))


def _stance() -> Column:
    return F.when(F.col("kind") == "Party Comm", "support").when(F.col("kind") == "Non-Party Comm", "oppose")


def _spending(spark: SparkSession, d: str) -> DataFrame:
    """Independent spending: who (committee), for or against whom (target)."""
    return transactions(spark, d).withColumn("stance", _stance()).withColumn("target", F.upper("city")).filter("stance is not null and target is not null and committee is not null")


_IE = f"ie AS (SELECT *, {_STANCE} AS stance, upper(city) AS target FROM tx WHERE {_STANCE} IS NOT NULL AND city IS NOT NULL AND committee IS NOT NULL)"


@C.add(f"""WITH {TX}, {_CYCLES} SELECT t.committee, CAST(c.cycle AS BIGINT) AS cycle, count(*) AS n, CAST(coalesce(sum(t.amount), 0) AS {_M}) AS total FROM tx t CROSS JOIN cycles c
WHERE t.day BETWEEN make_date(c.cycle - 1, 1, 1) AND make_date(c.cycle, 12, 31) AND {_RECEIPT} AND t.committee IS NOT NULL GROUP BY 1, 2""")
def canonical_receipts_by_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Receipts per committee and cycle; the bounds come from a small parameter relation, the cycle is an equality."""
    t = in_cycle(transactions(spark, d).filter("committee is not null"))
    bounds = spark.createDataFrame([(c,) for c in CYCLES], "cycle long").select("cycle", F.make_date(F.col("cycle") - 1, F.lit(1), F.lit(1)).alias("first"), F.make_date("cycle", F.lit(12), F.lit(31)).alias("last"))
    j = t.join(F.broadcast(bounds), "cycle").filter(receipt(F.col("first"), F.col("last")))
    return j.groupBy("committee", "cycle").agg(F.count("*").alias("n"), X.total(F.col("amount")).alias("total"))


@C.add(f"""WITH {TX}, s AS (SELECT committee, CAST(year(day) + year(day) % 2 AS BIGINT) AS cycle, count(DISTINCT report) AS reports FROM tx WHERE day IS NOT NULL AND committee IS NOT NULL GROUP BY 1, 2)
SELECT s.committee, s.cycle, s.reports, count(t.id) AS n, CAST(coalesce(sum(t.amount), 0) AS {_M}) AS total FROM s JOIN tx t ON t.committee = s.committee AND t.day BETWEEN make_date(CAST(s.cycle AS INT) - 1, 1, 1) AND make_date(CAST(s.cycle AS INT), 12, 31) GROUP BY 1, 2, 3""")
def summary_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Transactions within the cycle of a summary: the range join as an equality on the derived cycle."""
    t = transactions(spark, d).filter("committee is not null and day is not null").withColumn("cycle", X.cycle(F.col("day")))
    s = t.groupBy("committee", "cycle").agg(F.count_distinct("report").alias("reports"))
    live = t.groupBy("committee", "cycle").agg(F.count("*").alias("n"), X.total(F.col("amount")).alias("total"))
    return s.join(live, ["committee", "cycle"])


@C.add(f"""WITH {TX}, {_IE} SELECT target, CAST(coalesce(sum(amount) FILTER (WHERE stance = 'support' AND abs(amount) <= {CEILING}), 0) AS {_M}) AS support, CAST(coalesce(sum(amount) FILTER (WHERE stance = 'oppose' AND abs(amount) <= {CEILING}), 0) AS {_M}) AS oppose,
 count(*) FILTER (WHERE stance = 'support' AND abs(amount) <= {CEILING}) AS n_support, count(*) FILTER (WHERE stance = 'oppose' AND abs(amount) <= {CEILING}) AS n_oppose, count(*) FILTER (WHERE abs(amount) > {CEILING}) AS outliers FROM ie GROUP BY target""")
def independent_spending_summary(spark: SparkSession, d: str) -> DataFrame:
    inside = F.abs("amount") <= CEILING
    sums = [X.total(F.when(inside & (F.col("stance") == s), F.col("amount"))).alias(s) for s in ("support", "oppose")]
    counts = [F.count(F.when(inside & (F.col("stance") == s), 1)).alias(f"n_{s}") for s in ("support", "oppose")]
    return _spending(spark, d).groupBy("target").agg(*sums, *counts, F.count(F.when(F.abs("amount") > CEILING, 1)).alias("outliers"))


@C.add(f"""WITH {TX}, {_IE} SELECT committee, target, stance, CAST(coalesce(sum(amount), 0) AS {_M}) AS total, count(*) AS n, max(day) AS last_day, count(DISTINCT series) AS sources, bool_or(abs(amount) > {CEILING}) AS has_outlier FROM ie GROUP BY 1, 2, 3""")
def independent_spending_targets(spark: SparkSession, d: str) -> DataFrame:
    aggs = [X.total(F.col("amount")).alias("total"), F.count("*").alias("n"), F.max("day").alias("last_day"), F.count_distinct("series").alias("sources"), F.bool_or(F.abs("amount") > CEILING).alias("has_outlier")]
    return _spending(spark, d).groupBy("committee", "target", "stance").agg(*aggs)


@C.add(f"""WITH {TX}, {_IE}, g AS (SELECT committee, stance, sum(amount) AS a, count(*) AS n FROM ie WHERE amount IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY stance ORDER BY a DESC, committee) AS k FROM g)
SELECT stance, CAST(k AS BIGINT) AS k, committee, CAST(a AS {_M}) AS total, n FROM r WHERE k <= 10""")
def independent_top_spenders(spark: SparkSession, d: str) -> DataFrame:
    g = _spending(spark, d).filter("amount is not null").groupBy("committee", "stance").agg(F.sum("amount").alias("a"), F.count("*").alias("n"))
    r = g.withColumn("k", F.row_number().over(W.partitionBy("stance").orderBy(F.desc("a"), "committee")).cast("long")).filter("k <= 10")
    return r.select("stance", "k", "committee", F.col("a").cast(X.MONEY).alias("total"), "n")


_LINKS = "links AS (SELECT DISTINCT upper(trim(committee_city, ' ')) AS candidate, committee_sboe_id AS committee FROM real_transaction_export_adams WHERE committee_city IS NOT NULL AND committee_sboe_id IS NOT NULL)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    """(candidate, committee): which committees act for whom."""
    x = table(spark, d, "real_transaction_export_adams").filter("committee_city is not null and committee_sboe_id is not null")
    return x.select(F.upper(F.trim("committee_city")).alias("candidate"), F.col("committee_sboe_id").alias("committee")).distinct()


@C.add(f"""WITH {TX}, {_LINKS}, a AS (SELECT committee, sum(amount) AS s, count(*) AS n FROM tx WHERE committee IS NOT NULL GROUP BY 1),
cash AS (SELECT committee, cash FROM (SELECT committee, report, max(day) AS until_, sum(amount) AS cash, row_number() OVER (PARTITION BY committee ORDER BY max(day) DESC NULLS LAST, report DESC NULLS LAST) AS k FROM tx WHERE committee IS NOT NULL GROUP BY 1, 2) WHERE k = 1)
SELECT l.candidate, count(*) AS committees, coalesce(CAST(sum(a.n) AS BIGINT), 0) AS n, CAST(coalesce(sum(a.s), 0) AS {_M}) AS total, CAST(coalesce(sum(c.cash), 0) AS {_M}) AS latest_cash FROM links l LEFT JOIN a USING (committee) LEFT JOIN cash c USING (committee) GROUP BY 1""")
def candidate_money(spark: SparkSession, d: str) -> DataFrame:
    """All candidates at once: their committees, what these raised, and the cash of each one's latest report."""
    t = transactions(spark, d).filter("committee is not null")
    a = t.groupBy("committee").agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    reports = t.groupBy("committee", "report").agg(F.max("day").alias("until_"), F.sum("amount").alias("cash"))
    last = reports.withColumn("k", F.row_number().over(W.partitionBy("committee").orderBy(F.desc_nulls_last("until_"), F.desc_nulls_last("report")))).filter("k = 1").select("committee", "cash")
    j = _links(spark, d).join(a, "committee", "left").join(last, "committee", "left")
    return j.groupBy("candidate").agg(F.count("*").alias("committees"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), X.total(F.col("s")).alias("total"), X.total(F.col("cash")).alias("latest_cash"))


@C.add(f"""WITH {TX}, {_CYCLES}, who AS (SELECT DISTINCT committee FROM tx WHERE committee IS NOT NULL), official AS (SELECT committee, sum(amount) AS s, max(day) AS until_ FROM tx WHERE kind = 'Individual' AND committee IS NOT NULL GROUP BY 1),
live AS (SELECT committee, CAST(year(day) + year(day) % 2 AS BIGINT) AS cycle, sum(amount) AS s, count(*) AS n FROM tx WHERE committee IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2)
SELECT w.committee, CAST(c.cycle AS BIGINT) AS cycle, CASE WHEN o.until_ BETWEEN make_date(c.cycle - 1, 1, 1) AND make_date(c.cycle, 12, 31) THEN 'official' WHEN l.n > 0 THEN 'committees' WHEN o.s IS NOT NULL THEN 'older_official' ELSE 'none' END AS origin,
 CAST(CASE WHEN o.until_ BETWEEN make_date(c.cycle - 1, 1, 1) AND make_date(c.cycle, 12, 31) THEN o.s WHEN l.n > 0 THEN l.s ELSE o.s END AS {_M}) AS total FROM who w CROSS JOIN cycles c LEFT JOIN official o USING (committee) LEFT JOIN live l ON l.committee = w.committee AND l.cycle = c.cycle""")
def candidate_arbitration(spark: SparkSession, d: str) -> DataFrame:
    """Official total if it covers the cycle, else the cycle's own rows, else an older official total."""
    t = transactions(spark, d).filter("committee is not null")
    official = t.filter("kind = 'Individual'").groupBy("committee").agg(F.sum("amount").alias("os"), F.max("day").alias("until_"))
    live = in_cycle(t).groupBy("committee", "cycle").agg(F.sum("amount").alias("ls"), F.count("*").alias("n"))
    who = t.select("committee").distinct().withColumn("cycle", F.explode(F.array(*[F.lit(c).cast("long") for c in CYCLES])))
    j = who.join(official, "committee", "left").join(live, ["committee", "cycle"], "left")
    covered = F.coalesce(F.year("until_").between(F.col("cycle") - 1, F.col("cycle")), F.lit(False))
    live_rows = F.coalesce(F.col("n") > 0, F.lit(False))
    origin = F.when(covered, "official").when(live_rows, "committees").when(F.col("os").isNotNull(), "older_official").otherwise("none")
    return j.select("committee", "cycle", origin.alias("origin"), F.when(covered, F.col("os")).when(live_rows, F.col("ls")).otherwise(F.col("os")).cast(X.MONEY).alias("total"))


_SPINE = "spine(code) AS (VALUES ('NC'), ('VA'), ('SC'), ('OH'), ('GA'), ('TN'), ('PA'), ('WY'))"


@C.add(f"""WITH {TX}, {_SPINE}, a AS (SELECT state, count(*) AS loaded, count(*) FILTER (WHERE {_STANCE} IS NOT NULL) AS ie, sum(amount) FILTER (WHERE {_STANCE} IS NOT NULL) AS s, sum(amount) FILTER (WHERE kind = 'Individual') AS raised FROM tx GROUP BY state),
b AS (SELECT code, CASE WHEN coalesce(loaded, 0) = 0 THEN 'not_loaded' WHEN ie = 0 THEN 'loaded_zero' ELSE 'populated' END AS coverage, CASE WHEN coalesce(loaded, 0) > 0 THEN CAST(coalesce(s, 0) AS {_M}) END AS spending, CAST(coalesce(raised, 0) AS {_M}) AS raised FROM spine LEFT JOIN a ON a.state = code)
SELECT code, coverage, spending, raised, row_number() OVER (ORDER BY -raised, code) AS k FROM b""")
def state_money_board(spark: SparkSession, d: str) -> DataFrame:
    """A fixed spine of states; spending stays null where nothing proves that it was loaded."""
    spine = spark.sql("SELECT * FROM VALUES ('NC'), ('VA'), ('SC'), ('OH'), ('GA'), ('TN'), ('PA'), ('WY') AS t(code)")
    ie = _stance().isNotNull()
    a = transactions(spark, d).groupBy("state").agg(F.count("*").alias("loaded"), F.count(F.when(ie, 1)).alias("ie"), X.total(F.when(ie, F.col("amount"))).alias("s"), F.sum(F.when(F.col("kind") == "Individual", F.col("amount"))).cast(X.MONEY).alias("raised"))
    b = spine.join(a, F.col("code") == F.col("state"), "left")
    coverage = F.when(F.coalesce("loaded", F.lit(0)) == 0, "not_loaded").when(F.col("ie") == 0, "loaded_zero").otherwise("populated")
    b = b.select("code", coverage.alias("coverage"), F.when(F.col("loaded") > 0, F.col("s")).alias("spending"), F.coalesce("raised", F.lit(0.0)).alias("raised"))
    return b.withColumn("k", F.row_number().over(W.orderBy(-F.col("raised"), F.col("code"))).cast("long"))  # one row per state of the spine


@C.add(f"""WITH {TX}, proxy(county, town) AS (VALUES ('North', 'INKLERHAM'), ('North', 'SEDRAMOOR'), ('North', 'NARGIMONT'), ('South', 'BRABATON'), ('South', 'VINVAWORTH'), ('South', 'DAVMIBURY')),
t AS (SELECT p.county, tx.* FROM tx JOIN proxy p ON upper(tx.city) = p.town), g AS (SELECT county, committee, sum(amount) AS a, count(*) AS n FROM t WHERE committee IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY a DESC NULLS LAST, committee) AS k, sum(a) OVER (PARTITION BY county) AS whole FROM g) SELECT county, CAST(k AS BIGINT) AS k, committee, CAST(a AS {_M}) AS total, n, CAST(whole AS {_M}) AS county_total FROM r WHERE k <= 5""")
def county_proxy_recipients(spark: SparkSession, d: str) -> DataFrame:
    """Counties stand for lists of towns; their totals and top recipients."""
    proxy = spark.sql("SELECT * FROM VALUES ('North', 'INKLERHAM'), ('North', 'SEDRAMOOR'), ('North', 'NARGIMONT'), ('South', 'BRABATON'), ('South', 'VINVAWORTH'), ('South', 'DAVMIBURY') AS t(county, town)")
    t = transactions(spark, d).filter("committee is not null").join(F.broadcast(proxy), F.upper("city") == F.col("town"))
    g = t.groupBy("county", "committee").agg(F.sum("amount").alias("a"), F.count("*").alias("n"))
    w = W.partitionBy("county")
    r = g.select("*", F.row_number().over(w.orderBy(F.desc_nulls_last("a"), "committee")).cast("long").alias("k"), F.sum("a").over(w).alias("whole"))
    return r.filter("k <= 5").select("county", "k", "committee", F.col("a").cast(X.MONEY).alias("total"), "n", F.col("whole").cast(X.MONEY).alias("county_total"))


@C.add(f"""WITH {TX} SELECT state, CAST(coalesce(sum(abs(amount)), 0) AS {_M}) AS moved, count(DISTINCT committee) AS committees, count(DISTINCT name) FILTER (WHERE kind = 'Individual') AS people, max(day) AS last_day, arg_max(committee, (day, id)) FILTER (WHERE committee IS NOT NULL AND day IS NOT NULL) AS last_committee FROM tx WHERE state IS NOT NULL GROUP BY state""")
def regional_activity(spark: SparkSession, d: str) -> DataFrame:
    latest = F.max(F.when(F.col("committee").isNotNull() & F.col("day").isNotNull(), F.struct("day", "id", "committee")))["committee"]
    people = F.count_distinct(F.when(F.col("kind") == "Individual", F.col("name")))
    return transactions(spark, d).filter("state is not null").groupBy("state").agg(X.total(F.abs("amount")).alias("moved"), F.count_distinct("committee").alias("committees"), people.alias("people"), F.max("day").alias("last_day"), latest.alias("last_committee"))


@C.add(f"""WITH {TX}, c AS (SELECT export_row_id AS id, upper(trim(committee_city, ' ')) AS home, upper(trim(committee_state, ' ')) AS home_state FROM real_transaction_export_adams)
SELECT t.committee, CASE WHEN t.city IS NULL AND t.state IS NULL THEN 'unknown' WHEN upper(t.city) = c.home THEN 'district' WHEN t.state = c.home_state THEN 'in_state' WHEN t.state IS NULL THEN 'unknown' ELSE 'out_of_state' END AS bucket, count(*) AS n, CAST(coalesce(sum(t.amount), 0) AS {_M}) AS total
FROM tx t JOIN c USING (id) WHERE t.committee IS NOT NULL GROUP BY 1, 2""")
def geography_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Money from the district, the state, elsewhere or unknown."""
    x = table(spark, d, "real_transaction_export_adams")
    t = transactions(spark, d)
    home = x.select(F.col("export_row_id").alias("id"), F.upper(F.trim("committee_city")).alias("home"), F.upper(F.trim("committee_state")).alias("home_state"))
    bucket = F.when(F.col("city").isNull() & F.col("state").isNull(), "unknown").when(F.upper("city") == F.col("home"), "district").when(F.col("state") == F.col("home_state"), "in_state").when(F.col("state").isNull(), "unknown").otherwise("out_of_state")
    return t.join(home, "id").filter("committee is not null").groupBy("committee", bucket.alias("bucket")).agg(F.count("*").alias("n"), X.total(F.col("amount")).alias("total"))


@C.add(f"""WITH {TX}, a AS (SELECT committee, CAST(coalesce(sum(amount) FILTER (WHERE amount > 0 AND amount < 200), 0) * 100 AS HUGEINT) AS s, CAST(coalesce(sum(amount) FILTER (WHERE amount > 0), 0) * 100 AS HUGEINT) AS w FROM tx WHERE committee IS NOT NULL GROUP BY 1),
q AS (SELECT *, s * 10000 // w AS q, s * 10000 % w AS r FROM a WHERE w > 0) SELECT a.committee, CAST(CASE WHEN 2 * r > a.w OR (2 * r = a.w AND q % 2 = 1) THEN q + 1 ELSE q END AS DOUBLE) / 10000 AS share FROM a LEFT JOIN q USING (committee)""")
def small_share_half_even(spark: SparkSession, d: str) -> DataFrame:
    """Share of small sums in decimals, rounded half to even; null without a denominator."""
    small, whole = F.sum(F.when((F.col("amount") > 0) & (F.col("amount") < 200), F.col("amount"))), F.sum(F.when(F.col("amount") > 0, F.col("amount")))
    a = transactions(spark, d).filter("committee is not null").groupBy("committee").agg(F.coalesce(small, F.lit(0).cast("decimal(24,2)")).alias("s"), F.coalesce(whole, F.lit(0).cast("decimal(24,2)")).alias("w"))
    return a.select("committee", F.bround(F.col("s").cast("decimal(18,2)") / F.nullif(F.col("w"), F.lit(0)).cast("decimal(18,2)"), 4).cast("double").alias("share"))


@C.add(f"""WITH {TX}, v AS (SELECT committee, report, max(day) AS until_, sum(amount) AS total FROM tx WHERE committee IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY committee ORDER BY until_ DESC NULLS LAST, report DESC NULLS LAST) AS k FROM v)
SELECT committee, report, until_, CAST(total AS {_M}) AS total FROM r WHERE k = 1""")
def candidate_totals_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest coverage date wins; an undated version only where none is dated."""
    v = transactions(spark, d).filter("committee is not null").groupBy("committee", "report").agg(F.max("day").alias("until_"), F.sum("amount").alias("total"))
    r = v.withColumn("k", F.row_number().over(W.partitionBy("committee").orderBy(F.desc_nulls_last("until_"), F.desc_nulls_last("report"))))
    return r.filter("k = 1").select("committee", "report", "until_", F.col("total").cast(X.MONEY).alias("total"))


@C.add(f"""WITH {TX}, known AS (SELECT DISTINCT committee FROM tx WHERE kind = 'Loan Proceeds' AND committee IS NOT NULL), v AS (SELECT committee, CAST(year(day) + year(day) % 2 AS BIGINT) AS cycle, series, max(exported_on) AS seen, sum(amount) AS total FROM tx WHERE committee IN (SELECT committee FROM known) AND day IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY committee, cycle ORDER BY seen DESC, series) AS k FROM v) SELECT committee, cycle, series, CAST(total AS {_M}) AS total FROM r WHERE k = 1""")
def committee_summary_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One summary per committee and cycle, the latest export's; only committees already known."""
    t = transactions(spark, d).filter("committee is not null")
    known = t.filter("kind = 'Loan Proceeds'").select("committee").distinct()
    v = t.filter("day is not null").join(known, "committee", "left_semi").withColumn("cycle", X.cycle(F.col("day"))).groupBy("committee", "cycle", "series").agg(F.max("exported_on").alias("seen"), F.sum("amount").alias("total"))
    r = v.withColumn("k", F.row_number().over(W.partitionBy("committee", "cycle").orderBy(F.desc("seen"), "series")))
    return r.filter("k = 1").select("committee", "cycle", "series", F.col("total").cast(X.MONEY).alias("total"))


@C.add(f"""WITH {TX}, m AS (SELECT zip5, year(exported_on) AS y, upper(city) AS town, count(*) AS n FROM tx WHERE zip5 IS NOT NULL AND city IS NOT NULL GROUP BY 1, 2, 3), top AS (SELECT max(y) AS y FROM m),
dim AS (SELECT zip5, town FROM (SELECT m.*, row_number() OVER (PARTITION BY zip5 ORDER BY n DESC, town) AS k FROM m JOIN top USING (y)) WHERE k = 1) SELECT t.zip5, d.town, count(*) AS n, CAST(coalesce(sum(t.amount), 0) AS {_M}) AS total FROM tx t LEFT JOIN dim d USING (zip5) GROUP BY 1, 2""")
def zip_geography_latest_year(spark: SparkSession, d: str) -> DataFrame:
    """Places of the newest boundary year, joined left so that ZIPs without a place stay."""
    t = transactions(spark, d)
    m = t.filter("zip5 is not null and city is not null").groupBy("zip5", F.year("exported_on").alias("y"), F.upper("city").alias("town")).agg(F.count("*").alias("n"))
    top = m.agg(F.max("y").alias("y"))  # one row
    dim = m.join(F.broadcast(top), "y").withColumn("k", F.row_number().over(W.partitionBy("zip5").orderBy(F.desc("n"), "town"))).filter("k = 1").select("zip5", "town")
    money = t.groupBy("zip5").agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("a"))
    return money.join(dim, "zip5", "left").groupBy("zip5", "town").agg(F.sum("n").alias("n"), F.sum("a").cast(X.MONEY).alias("total"))


@C.add("""WITH h AS (SELECT id, upper(trim(owner_name, ' ')) AS n, upper(trim(owner_mail_city, ' ')) AS c, owner_mail_state AS s, owner_mail_zip5 AS z FROM ownership), k AS (SELECT id AS cid, canonical_name AS n, upper(trim(contributor_city, ' ')) AS c, contributor_state AS s, zip5 AS z FROM donor_er_view),
m AS (SELECT h.id, k.cid, CASE WHEN h.c = k.c AND h.s = k.s AND h.z = k.z THEN 1 WHEN h.s = k.s AND h.z = k.z THEN 2 WHEN h.s = k.s THEN 3 ELSE 4 END AS tier FROM h JOIN k ON h.n = k.n), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, cid) AS j FROM m) SELECT id AS holder_id, cid AS candidate_id, CAST(tier AS BIGINT) AS tier FROM r WHERE j = 1""")
def best_candidate_per_holder(spark: SparkSession, d: str) -> DataFrame:
    """Each holder's best candidate by tiers of agreeing geography, then by id."""
    h = table(spark, d, "ownership").select(F.col("id").alias("holder_id"), F.upper(F.trim("owner_name")).alias("n"), F.upper(F.trim("owner_mail_city")).alias("hc"), F.col("owner_mail_state").alias("hs"), F.col("owner_mail_zip5").alias("hz"))
    k = table(spark, d, "donor_er_view").select(F.col("id").alias("candidate_id"), F.col("canonical_name").alias("n"), F.upper(F.trim("contributor_city")).alias("c"), F.col("contributor_state").alias("s"), F.col("zip5").alias("z"))
    state, zip_, city = F.col("hs") == F.col("s"), F.col("hz") == F.col("z"), F.col("hc") == F.col("c")
    tier = F.when(city & state & zip_, 1).when(state & zip_, 2).when(state, 3).otherwise(4).cast("long")
    best = h.join(k, "n").groupBy("holder_id").agg(F.min(F.struct(tier.alias("tier"), "candidate_id")).alias("b"))
    return best.select("holder_id", "b.candidate_id", "b.tier")


@C.add(f"""WITH {TX}, a AS (SELECT committee, committee_name, sum(amount) AS s FROM tx WHERE committee IS NOT NULL GROUP BY 1, 2), t AS (SELECT max(s) AS top FROM a)
SELECT a.committee, a.committee_name, CAST(coalesce(a.s, 0) AS {_M}) AS total, a.s = t.top AS is_top, (SELECT count(*) FROM a b WHERE trim(lower(regexp_replace(b.committee_name, '[^a-zA-Z0-9]+', '-', 'g')), '-') = trim(lower(regexp_replace(a.committee_name, '[^a-zA-Z0-9]+', '-', 'g')), '-')) AS same_slug FROM a, t""")
def committee_scalar_subqueries(spark: SparkSession, d: str) -> DataFrame:
    """An uncorrelated maximum as a one-row join, a correlated count as a join on the slug."""
    a = transactions(spark, d).filter("committee is not null").groupBy("committee", "committee_name").agg(F.sum("amount").alias("s")).withColumn("slug", X.slug(F.col("committee_name")))
    same = a.groupBy("slug").agg(F.count("*").alias("same_slug"))
    j = a.join(F.broadcast(a.agg(F.max("s").alias("top")))).join(same, "slug", "left")
    return j.select("committee", "committee_name", F.coalesce("s", F.lit(0)).cast(X.MONEY).alias("total"), (F.col("s") == F.col("top")).alias("is_top"), F.coalesce("same_slug", F.lit(0)).alias("same_slug"))


@C.add(f"""WITH {TX}, p AS (SELECT committee, sum(amount) FILTER (WHERE kind = 'Loan Proceeds') AS loans, sum(amount) FILTER (WHERE form = 'Draft') AS in_kind, sum(amount) FILTER (WHERE kind = 'Individual') AS gifts, sum(amount) AS all_ FROM tx WHERE committee IS NOT NULL GROUP BY 1)
SELECT committee, CAST(loans AS {_M}) AS loans, CAST(in_kind AS {_M}) AS in_kind, CAST(gifts AS {_M}) AS gifts, CAST(greatest(coalesce(all_, 0) - coalesce(loans, 0) - coalesce(in_kind, 0), 0) AS {_M}) AS cash, coalesce(loans, in_kind, gifts) IS NOT NULL AS has_official_total FROM p""")
def receipts_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Loans, gifts in kind and money, the rest floored at zero; whether any of the three is known."""
    part = lambda cond: F.sum(F.when(cond, F.col("amount")))
    p = transactions(spark, d).filter("committee is not null").groupBy("committee").agg(part(F.col("kind") == "Loan Proceeds").alias("loans"), part(F.col("form") == "Draft").alias("in_kind"), part(F.col("kind") == "Individual").alias("gifts"), F.sum("amount").alias("all_"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return p.select("committee", *[F.col(c).cast(X.MONEY).alias(c) for c in ("loans", "in_kind", "gifts")], F.greatest(zero("all_") - zero("loans") - zero("in_kind"), F.lit(0)).cast(X.MONEY).alias("cash"), F.coalesce("loans", "in_kind", "gifts").isNotNull().alias("has_official_total"))


@C.add(f"""WITH {TX}, s AS (SELECT * FROM tx WHERE left(md5(id), 1) < '4') SELECT count(*) AS sampled, count(employer) AS with_employer, count(*) FILTER (WHERE regexp_matches(upper(employer), '(SCHOOL|UNIVERSITY|TEACH)')) AS education, count(*) FILTER (WHERE employer IS NOT NULL AND NOT regexp_matches(upper(employer), '(SCHOOL|UNIVERSITY|TEACH)')) AS unmapped,
 (SELECT min(e) FROM (SELECT upper(employer) AS e, rank() OVER (ORDER BY count(*) DESC) AS k FROM s WHERE employer IS NOT NULL AND NOT regexp_matches(upper(employer), '(SCHOOL|UNIVERSITY|TEACH)') GROUP BY 1) WHERE k = 1) AS top_unmapped FROM s""")
def employer_coverage_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: rows whose hash starts low, the same on every run; coverage and the commonest unmapped employer."""
    s = transactions(spark, d).filter(F.left(F.md5("id"), F.lit(1)) < "4")
    mapped = F.coalesce(F.upper("employer").rlike("(SCHOOL|UNIVERSITY|TEACH)"), F.lit(False))
    unmapped = F.col("employer").isNotNull() & ~mapped
    counts = s.agg(F.count("*").alias("sampled"), F.count("employer").alias("with_employer"), F.count(F.when(mapped, 1)).alias("education"), F.count(F.when(unmapped, 1)).alias("unmapped"))
    top = s.filter(unmapped).groupBy(F.upper("employer").alias("e")).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("k"), "e"))["e"].alias("top_unmapped"))
    return counts.join(F.broadcast(top))


@C.add("""WITH g AS (SELECT parcel_id, valid_from, count(*) AS n, count(DISTINCT owner_name) AS names, min(CASE date_precision WHEN 'day' THEN 1 WHEN 'month' THEN 2 ELSE 3 END) AS best FROM ownership WHERE parcel_id IS NOT NULL GROUP BY 1, 2),
w AS (SELECT o.parcel_id, o.valid_from, count(*) AS winners, min(o.id) AS id FROM ownership o JOIN g ON g.parcel_id = o.parcel_id AND g.valid_from IS NOT DISTINCT FROM o.valid_from AND CASE o.date_precision WHEN 'day' THEN 1 WHEN 'month' THEN 2 ELSE 3 END = g.best GROUP BY 1, 2)
SELECT g.parcel_id, g.valid_from, g.n, CASE WHEN w.winners = 1 THEN w.id END AS winner, CASE WHEN g.n = 1 THEN 'single' WHEN w.winners = 1 THEN 'precedence' ELSE 'ambiguous' END AS status FROM g JOIN w ON g.parcel_id = w.parcel_id AND g.valid_from IS NOT DISTINCT FROM w.valid_from""")
def authority_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one identity from several authorities: the only one of highest precedence wins, else the group is ambiguous."""
    o = table(spark, d, "ownership").filter("parcel_id is not null")
    p = F.when(F.col("date_precision") == "day", 1).when(F.col("date_precision") == "month", 2).otherwise(3)
    by_rank = o.groupBy("parcel_id", "valid_from", p.alias("p")).agg(F.count("*").alias("winners"), F.min("id").alias("id"))
    g = by_rank.groupBy("parcel_id", "valid_from").agg(F.sum("winners").alias("n"), F.min(F.struct("p", "winners", "id")).alias("b"))
    one = F.col("b.winners") == 1
    return g.select("parcel_id", "valid_from", "n", F.when(one, F.col("b.id")).alias("winner"), F.when(F.col("n") == 1, "single").when(one, "precedence").otherwise("ambiguous").alias("status"))


@C.add("""WITH last_ AS (SELECT parcel_id, max(coalesce(valid_to, DATE '9999-01-01')) AS until_ FROM ownership WHERE parcel_id IS NOT NULL GROUP BY 1), r AS (SELECT o.parcel_id, o.id, o.owner_name, o.valid_to, row_number() OVER (PARTITION BY o.parcel_id ORDER BY o.valid_to DESC, o.valid_from DESC NULLS LAST, o.id) AS k FROM ownership o JOIN last_ l USING (parcel_id) WHERE l.until_ < DATE '9999-01-01')
SELECT parcel_id, id, owner_name, valid_to FROM r WHERE k = 1""")
def vacancy_predecessor(spark: SparkSession, d: str) -> DataFrame:
    """The last holder of each seat whose holdings have all ended."""
    w = W.partitionBy("parcel_id")
    o = table(spark, d, "ownership").filter("parcel_id is not null").withColumn("open_", F.max(F.col("valid_to").isNull()).over(w))
    r = o.filter("not open_").withColumn("k", F.row_number().over(w.orderBy(F.desc("valid_to"), F.desc_nulls_last("valid_from"), "id")))
    return r.filter("k = 1").select("parcel_id", "id", "owner_name", "valid_to")
