"""Money queries: summaries, rollups, top lists, spines, running sums, geography (J, A, W, T, U families)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions import finance as X
from tallybook.plans.stage import table
from tallybook.queries.registry import Catalogue
from tallybook.sources.exports import TX, transactions

C = Catalogue()
SPENT = ("Operating Exp", "Coord Party Exp", "Refund")
_SPENT = "('Operating Exp', 'Coord Party Exp', 'Refund')"
_M = "DOUBLE"


def _is_spent() -> Column:
    return F.coalesce(F.col("kind").isin(*SPENT), F.lit(False))


def _raised() -> Column:
    return F.when(~_is_spent(), F.col("amount"))


def _pack() -> list[Column]:
    """Raised, spent, net and number of rows."""
    spent = F.when(_is_spent(), F.col("amount"))
    return [X.total(_raised()).alias("raised"), X.total(spent).alias("spent"), (F.coalesce(F.sum(_raised()), F.lit(0)) - F.coalesce(F.sum(spent), F.lit(0))).cast(X.MONEY).alias("net"), F.count("*").alias("n")]


_PACK = f"""CAST(coalesce(sum(amount) FILTER (WHERE NOT coalesce(kind IN {_SPENT}, false)), 0) AS {_M}) AS raised,
  CAST(coalesce(sum(amount) FILTER (WHERE kind IN {_SPENT}), 0) AS {_M}) AS spent,
  CAST(coalesce(sum(amount) FILTER (WHERE NOT coalesce(kind IN {_SPENT}, false)), 0) - coalesce(sum(amount) FILTER (WHERE kind IN {_SPENT}), 0) AS {_M}) AS net, count(*) AS n"""


@C.add(f"WITH {TX} SELECT committee, {_PACK}, CAST(coalesce(sum(amount) FILTER (WHERE kind = 'Loan Proceeds'), 0) AS {_M}) AS loans, max(exported_on) AS as_of, count(DISTINCT series) AS series FROM tx WHERE committee IS NOT NULL GROUP BY committee")
def committee_summary(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).filter("committee is not null")
    return t.groupBy("committee").agg(*_pack(), X.total(F.when(F.col("kind") == "Loan Proceeds", F.col("amount"))).alias("loans"), F.max("exported_on").alias("as_of"), F.count_distinct("series").alias("series"))


@C.add(f"""WITH {TX}, stored AS (SELECT committee, sum(amount) AS a, count(*) AS n FROM tx WHERE kind = 'Individual' GROUP BY committee HAVING count(*) >= 20),
live AS (SELECT t.committee, sum(amount) AS a, count(*) AS n FROM tx t WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.committee = t.committee) AND t.committee IS NOT NULL GROUP BY t.committee)
SELECT committee, CAST(coalesce(a, 0) AS {_M}) AS total, n, 'stored' AS origin FROM stored WHERE committee IS NOT NULL UNION ALL SELECT committee, CAST(coalesce(a, 0) AS {_M}), n, 'live' FROM live""")
def committee_summary_stored_or_live(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).filter("committee is not null")
    rolled = lambda x: x.groupBy("committee").agg(X.total(F.col("amount")).alias("total"), F.count("*").alias("n"))
    stored = rolled(t.filter("kind = 'Individual'")).filter("n >= 20")
    live = rolled(t.join(stored.select("committee"), "committee", "left_anti"))
    return stored.withColumn("origin", F.lit("stored")).unionByName(live.withColumn("origin", F.lit("live")))


@C.add(f"""WITH {TX}, g AS (SELECT committee, name, sum(amount) AS a, count(*) AS n FROM tx WHERE committee IS NOT NULL AND name IS NOT NULL AND amount IS NOT NULL AND NOT coalesce(kind IN {_SPENT}, false) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY committee ORDER BY a DESC, name) AS k FROM g) SELECT committee, CAST(k AS BIGINT) AS k, name, CAST(a AS {_M}) AS total, n FROM r WHERE k <= 5""")
def committee_top_lists(spark: SparkSession, d: str) -> DataFrame:
    g = transactions(spark, d).filter("committee is not null and name is not null and amount is not null").filter(~_is_spent()).groupBy("committee", "name").agg(F.sum("amount").alias("a"), F.count("*").alias("n"))
    r = g.withColumn("k", F.row_number().over(W.partitionBy("committee").orderBy(F.desc("a"), F.asc("name"))))
    return r.filter("k <= 5").select("committee", F.col("k").cast("long").alias("k"), "name", F.col("a").cast(X.MONEY).alias("total"), "n")


@C.add(f"""WITH {TX}, f AS (SELECT committee, report, max(day) AS until_, sum(CASE WHEN kind IN {_SPENT} THEN -amount ELSE amount END) AS net FROM tx WHERE committee IS NOT NULL AND report IS NOT NULL GROUP BY 1, 2)
SELECT committee, report, until_, CAST(coalesce(net, 0) AS {_M}) AS net, CAST(sum(coalesce(net, 0)) OVER (PARTITION BY committee ORDER BY until_ ASC NULLS LAST, report ROWS UNBOUNDED PRECEDING) AS {_M}) AS cash FROM f""")
def filing_breakdown_running_cash(spark: SparkSession, d: str) -> DataFrame:
    signed = F.when(_is_spent(), -F.col("amount")).otherwise(F.col("amount"))
    f = transactions(spark, d).filter("committee is not null and report is not null").groupBy("committee", "report").agg(F.max("day").alias("until_"), F.coalesce(F.sum(signed), F.lit(0)).alias("net"))
    w = W.partitionBy("committee").orderBy(F.asc_nulls_last("until_"), "report").rowsBetween(W.unboundedPreceding, 0)
    return f.select("committee", "report", "until_", F.col("net").cast(X.MONEY).alias("net"), F.sum("net").over(w).cast(X.MONEY).alias("cash"))


@C.add(f"WITH {TX}, r AS (SELECT *, row_number() OVER (PARTITION BY committee ORDER BY day DESC NULLS LAST, id) AS k FROM tx WHERE committee IS NOT NULL) SELECT committee, id, day, CAST(amount AS {_M}) AS amount FROM r WHERE k = 1")
def latest_transaction_per_committee(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("committee").orderBy(F.desc_nulls_last("day"), "id")
    return transactions(spark, d).filter("committee is not null").withColumn("k", F.row_number().over(w)).filter("k = 1").select("committee", "id", "day", F.col("amount").cast(X.MONEY).alias("amount"))


@C.add(f"WITH {TX} SELECT kind, count(*) AS n, CAST(coalesce(sum(amount), 0) AS {_M}) AS total FROM tx WHERE state IS DISTINCT FROM 'NC' GROUP BY kind")
def filter_null_safe_denylist(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).filter(~F.col("state").eqNullSafe(F.lit("NC"))).groupBy("kind").agg(F.count("*").alias("n"), X.total(F.col("amount")).alias("total"))


@C.add(f"""WITH {TX} SELECT committee, count(*) FILTER (WHERE abs(amount) <= 500) AS n, CAST(coalesce(sum(amount) FILTER (WHERE abs(amount) <= 500), 0) AS {_M}) AS total,
 count(*) FILTER (WHERE abs(amount) > 500) AS outliers, bool_or(abs(amount) > 500) AS has_outlier FROM tx WHERE committee IS NOT NULL GROUP BY committee""")
def summary_without_outliers(spark: SparkSession, d: str) -> DataFrame:
    inside = F.abs("amount") <= 500
    t = transactions(spark, d).filter("committee is not null")
    return t.groupBy("committee").agg(F.count(F.when(inside, 1)).alias("n"), X.total(F.when(inside, F.col("amount"))).alias("total"), F.count(F.when(F.abs("amount") > 500, 1)).alias("outliers"), F.bool_or(F.abs("amount") > 500).alias("has_outlier"))


@C.add(f"WITH {TX} SELECT committee, CAST(sum(amount) AS {_M}) AS spent, count(*) AS n FROM tx WHERE kind IN {_SPENT} AND committee IS NOT NULL AND amount IS NOT NULL GROUP BY committee ORDER BY spent DESC, committee LIMIT 20")
def top_spenders(spark: SparkSession, d: str) -> DataFrame:
    g = transactions(spark, d).filter(_is_spent()).filter("committee is not null and amount is not null").groupBy("committee").agg(F.sum("amount").cast(X.MONEY).alias("spent"), F.count("*").alias("n"))
    return g.orderBy(F.desc("spent"), "committee").limit(20)


@C.add(f"""WITH {TX}, spine(code) AS (VALUES ('NC'), ('VA'), ('SC'), ('OH'), ('GA'), ('TN'), ('IL'), ('PA'), ('WY')),
a AS (SELECT state, sum(amount) AS s, count(*) AS n, count(DISTINCT committee) AS committees FROM tx GROUP BY state)
SELECT code, CAST(s AS {_M}) AS total, coalesce(n, 0) AS n, coalesce(committees, 0) AS committees FROM spine LEFT JOIN a ON a.state = spine.code""")
def state_spine_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """States of a fixed spine; a state without rows keeps a null total (unknown, not zero)."""
    spine = spark.sql("SELECT * FROM VALUES ('NC'), ('VA'), ('SC'), ('OH'), ('GA'), ('TN'), ('IL'), ('PA'), ('WY') AS t(code)")
    a = transactions(spark, d).groupBy("state").agg(F.sum("amount").cast(X.MONEY).alias("total"), F.count("*").alias("n"), F.count_distinct("committee").alias("committees"))
    return spine.join(a, F.col("code") == F.col("state"), "left").select("code", "total", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("committees", F.lit(0)).alias("committees"))


@C.add(f"""WITH {TX}, g AS (SELECT state, committee, sum(amount) AS a FROM tx WHERE state IS NOT NULL AND committee IS NOT NULL AND amount IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY a DESC NULLS LAST, committee) AS k FROM g) SELECT state, CAST(k AS BIGINT) AS k, committee, CAST(a AS {_M}) AS total FROM r WHERE k <= 3""")
def state_top_committees(spark: SparkSession, d: str) -> DataFrame:
    g = transactions(spark, d).filter("state is not null and committee is not null and amount is not null").groupBy("state", "committee").agg(F.sum("amount").alias("a"))
    r = g.withColumn("k", F.row_number().over(W.partitionBy("state").orderBy(F.desc_nulls_last("a"), "committee")))
    return r.filter("k <= 3").select("state", F.col("k").cast("long").alias("k"), "committee", F.col("a").cast(X.MONEY).alias("total"))


@C.add(f"""WITH {TX} SELECT upper(city) AS place, CAST(round(coalesce(sum(amount), 0) * 100, 0) AS BIGINT) AS cents, count(*) AS n, count(DISTINCT committee) AS committees FROM tx WHERE city IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def place_totals_in_cents(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).filter("city is not null").groupBy(F.upper("city").alias("place")).agg(X.cents(F.col("amount")).alias("cents"), F.count("*").alias("n"), F.count_distinct("committee").alias("committees")).filter("n > 1")


@C.add(f"""WITH {TX}, m AS (SELECT committee, CAST(date_trunc('month', day) AS DATE) AS m, sum(amount) AS a, count(*) AS n FROM tx WHERE committee IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2),
b AS (SELECT committee, min(m) AS lo, max(m) AS hi FROM m GROUP BY 1), s AS (SELECT committee, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m FROM b)
SELECT s.committee, strftime(s.m, '%Y-%m') AS month, CAST(coalesce(a, 0) AS {_M}) AS total, coalesce(n, 0) AS n FROM s LEFT JOIN m ON m.committee = s.committee AND m.m = s.m""")
def monthly_spine(spark: SparkSession, d: str) -> DataFrame:
    m = transactions(spark, d).filter("committee is not null and day is not null").groupBy("committee", F.trunc("day", "month").alias("m")).agg(F.sum("amount").alias("a"), F.count("*").alias("n"))
    b = m.groupBy("committee").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    s = b.select("committee", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m"))
    return s.join(m, ["committee", "m"], "left").select("committee", X.month_key(F.col("m")).alias("month"), F.coalesce("a", F.lit(0)).cast(X.MONEY).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


_SPEC = ", ".join(f"('{n}', CAST({lo} AS DECIMAL(14,2)), CAST({hi} AS DECIMAL(14,2)))" for n, lo, hi in X.SIZE_BUCKETS)


@C.add(f"WITH {TX}, spec(bucket, lo, hi) AS (VALUES {_SPEC}) SELECT bucket, count(tx.id) AS n, CAST(coalesce(sum(amount), 0) AS {_M}) AS total FROM spec LEFT JOIN tx ON abs(tx.amount) BETWEEN lo AND hi GROUP BY bucket")
def size_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Range join to bucket bounds as a CASE ladder and a spine, so nothing is compared pairwise."""
    spine = spark.createDataFrame([(n,) for n, _, _ in X.SIZE_BUCKETS], "bucket string")
    g = transactions(spark, d).groupBy(X.size_bucket(F.col("amount")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("amount").alias("a"))
    return spine.join(g, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("a", F.lit(0)).cast(X.MONEY).alias("total"))


@C.add(f"""WITH {TX}, g AS (SELECT state, sum(amount) AS a, count(*) AS n FROM tx WHERE amount IS NOT NULL GROUP BY state), r AS (SELECT *, row_number() OVER (ORDER BY a DESC, state) AS k FROM g WHERE state IS NOT NULL)
SELECT label, CAST(sum(a) AS {_M}) AS total, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN k <= 3 THEN state ELSE '(other)' END AS label, a, n FROM r UNION ALL SELECT '(unknown)', a, n FROM g WHERE state IS NULL) GROUP BY label""")
def top_states_other_unknown(spark: SparkSession, d: str) -> DataFrame:
    g = transactions(spark, d).filter("amount is not null").groupBy("state").agg(F.sum("amount").alias("a"), F.count("*").alias("n"))
    r = g.filter("state is not null").withColumn("k", F.row_number().over(W.orderBy(F.desc("a"), "state")))  # one row per state
    top = r.select(F.when(F.col("k") <= 3, F.col("state")).otherwise("(other)").alias("label"), "a", "n")
    return top.unionByName(g.filter("state is null").select(F.lit("(unknown)").alias("label"), "a", "n")).groupBy("label").agg(F.sum("a").cast(X.MONEY).alias("total"), F.sum("n").alias("n"))


@C.add(f"""WITH {TX}, g AS (SELECT zip5, upper(city) AS town, count(*) AS n FROM tx WHERE length(zip5) = 5 AND city IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY zip5 ORDER BY n DESC, town) AS k, sum(n) OVER (PARTITION BY zip5) AS alln FROM g)
SELECT zip5, town, CAST(round(CAST(n AS DECIMAL(18,6)) / alln, 4) AS DOUBLE) AS share FROM r WHERE k = 1""")
def dominant_town_per_zip(spark: SparkSession, d: str) -> DataFrame:
    g = transactions(spark, d).filter("length(zip5) = 5 and city is not null").groupBy("zip5", F.upper("city").alias("town")).agg(F.count("*").alias("n"))
    w = W.partitionBy("zip5")
    r = g.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "town"))).withColumn("all", F.sum("n").over(w))
    return r.filter("k = 1").select("zip5", "town", F.round(F.col("n").cast("decimal(18,6)") / F.col("all"), 4).cast("double").alias("share"))


@C.add(f"WITH {TX} SELECT CAST(year(day) + year(day) % 2 AS BIGINT) AS cycle, CAST(coalesce(sum(amount), 0) AS {_M}) AS total, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM tx WHERE day IS NOT NULL GROUP BY 1")
def cycle_totals(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).filter("day is not null").groupBy(X.cycle(F.col("day")).alias("cycle")).agg(X.total(F.col("amount")).alias("total"), F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@C.add(f"""WITH {TX}, p AS (SELECT committee, report, count(*) AS n, count(amount) AS complete FROM tx WHERE committee IS NOT NULL AND report IS NOT NULL GROUP BY 1, 2)
SELECT report, count(DISTINCT committee) AS committees, count(DISTINCT committee) FILTER (WHERE n = complete) AS complete, array_to_string(list(DISTINCT committee ORDER BY committee), ',') AS members FROM p GROUP BY report""")
def summary_coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = transactions(spark, d).filter("committee is not null and report is not null").groupBy("committee", "report").agg(F.count("*").alias("n"), F.count("amount").alias("whole"))
    return p.groupBy("report").agg(F.count_distinct("committee").alias("committees"), F.count_distinct(F.when(F.col("n") == F.col("whole"), F.col("committee"))).alias("complete"), F.concat_ws(",", F.array_sort(F.collect_set("committee"))).alias("members"))


@C.add(f"WITH {TX} SELECT name, state, zip5, CAST(sum(amount) AS {_M}) AS total, count(*) AS n FROM tx WHERE name IS NOT NULL AND amount IS NOT NULL GROUP BY 1, 2, 3 ORDER BY total DESC, name, state NULLS LAST, zip5 NULLS LAST LIMIT 50")
def top_donors(spark: SparkSession, d: str) -> DataFrame:
    g = transactions(spark, d).filter("name is not null and amount is not null").groupBy("name", "state", "zip5").agg(F.sum("amount").cast(X.MONEY).alias("total"), F.count("*").alias("n"))
    return g.orderBy(F.desc("total"), "name", F.asc_nulls_last("state"), F.asc_nulls_last("zip5")).limit(50)


_EMP = """CASE WHEN v IS NULL OR v IN ('', 'N/A', 'NA', 'NONE', 'UNKNOWN', 'REQUESTED', 'INFORMATION REQUESTED', 'BEST EFFORTS', 'NOT PROVIDED', 'NOT AVAILABLE') THEN '(not given)'
 WHEN v IN ('SELF', 'SELF-EMPLOYED', 'SELF EMPLOYED') THEN 'SELF-EMPLOYED' WHEN v IN ('RETIRED', 'NOT EMPLOYED', 'UNEMPLOYED') THEN 'NOT EMPLOYED' ELSE v END"""


@C.add(f"WITH {TX}, e AS (SELECT upper(regexp_replace(trim(employer, ' '), '\\s+', ' ', 'g')) AS v, amount FROM tx) SELECT {_EMP} AS employer, CAST(coalesce(sum(amount), 0) AS {_M}) AS total, count(*) AS n FROM e GROUP BY 1")
def employers_bucketed(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).groupBy(X.employer_display(F.col("employer")).alias("employer")).agg(X.total(F.col("amount")).alias("total"), F.count("*").alias("n"))


@C.add(f"""WITH {TX}, p AS (SELECT committee, coalesce(sum(amount), 0) AS all_, coalesce(sum(amount) FILTER (WHERE kind = 'Individual'), 0) AS individual, coalesce(sum(amount) FILTER (WHERE kind = 'Loan Proceeds'), 0) AS loans,
 coalesce(sum(amount) FILTER (WHERE kind IN ('Party Comm', 'Non-Party Comm')), 0) AS committees FROM tx WHERE committee IS NOT NULL AND NOT coalesce(kind IN {_SPENT}, false) GROUP BY committee)
SELECT committee, CAST(individual AS {_M}) AS individual, CAST(loans AS {_M}) AS loans, CAST(committees AS {_M}) AS committees, CAST(all_ - individual - loans - committees AS {_M}) AS residual,
 CASE WHEN all_ - individual - loans - committees < 0 THEN 'negative' WHEN abs(all_ - individual - loans - committees) <= 0.01 THEN 'reconciled' ELSE 'residual' END AS status FROM p""")
def receipt_composition(spark: SparkSession, d: str) -> DataFrame:
    part = lambda *k: F.coalesce(F.sum(F.when(F.col("kind").isin(*k), F.col("amount"))), F.lit(0))
    p = transactions(spark, d).filter("committee is not null").filter(~_is_spent()).groupBy("committee").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("all"), part("Individual").alias("individual"), part("Loan Proceeds").alias("loans"), part("Party Comm", "Non-Party Comm").alias("committees"))
    rest = F.col("all") - F.col("individual") - F.col("loans") - F.col("committees")
    status = F.when(rest < 0, "negative").when(F.abs(rest) <= F.lit("0.01").cast("decimal(14,2)"), "reconciled").otherwise("residual")
    return p.select("committee", *[F.col(c).cast(X.MONEY).alias(c) for c in ("individual", "loans", "committees")], rest.cast(X.MONEY).alias("residual"), status.alias("status"))


@C.add(f"""WITH {TX}, p AS (SELECT committee, coalesce(sum(amount) FILTER (WHERE abs(amount) < 200), 0) AS small, coalesce(sum(amount), 0) AS all_ FROM tx WHERE committee IS NOT NULL AND kind = 'Individual' GROUP BY committee)
SELECT committee, CAST(small AS {_M}) AS small, CAST(all_ AS {_M}) AS total, CASE WHEN all_ > 0 THEN CAST(round(CAST(small AS DOUBLE) / CAST(all_ AS DOUBLE), 4) AS DOUBLE) END AS share FROM p""")
def small_dollar_share(spark: SparkSession, d: str) -> DataFrame:
    p = transactions(spark, d).filter("committee is not null and kind = 'Individual'").groupBy("committee").agg(F.coalesce(F.sum(F.when(F.abs("amount") < 200, F.col("amount"))), F.lit(0)).alias("small"), F.coalesce(F.sum("amount"), F.lit(0)).alias("all"))
    share = F.when(F.col("all") > 0, F.round(F.col("small").cast("double") / F.col("all").cast("double"), 4))
    return p.select("committee", F.col("small").cast(X.MONEY).alias("small"), F.col("all").cast(X.MONEY).alias("total"), share.alias("share"))


@C.add(f"""WITH {TX}, page AS (SELECT id, committee, day, amount FROM tx WHERE amount IS NOT NULL ORDER BY amount DESC, id LIMIT 26 OFFSET 25)
SELECT p.id, p.committee, CAST(p.amount AS {_M}) AS amount, CAST(k AS BIGINT) AS k, n > 25 AS has_next FROM (SELECT *, row_number() OVER (ORDER BY amount DESC, id) AS k, count(*) OVER () AS n FROM page) p WHERE k <= 25""")
def paged_list_has_next(spark: SparkSession, d: str) -> DataFrame:
    """A page and whether another follows: one row more than the page is read, then numbered."""
    page = transactions(spark, d).filter("amount is not null").select("id", "committee", "amount").orderBy(F.desc("amount"), "id").offset(25).limit(26)
    k = F.row_number().over(W.orderBy(F.desc("amount"), "id"))
    return page.withColumn("k", k).withColumn("n", F.count("*").over(W.partitionBy())).filter("k <= 25").select("id", "committee", F.col("amount").cast(X.MONEY).alias("amount"), F.col("k").cast("long").alias("k"), (F.col("n") > 25).alias("has_next"))


@C.add(f"""WITH {TX}, k AS (SELECT *, md5(concat_ws(chr(31), CASE WHEN name IS NULL THEN 'N' ELSE 'V' || name END, CASE WHEN employer IS NULL THEN 'N' ELSE 'V' || employer END, CASE WHEN zip5 IS NULL THEN 'N' ELSE 'V' || zip5 END)) AS donor FROM tx)
SELECT donor, name, employer, zip5, CAST(coalesce(sum(amount), 0) AS {_M}) AS total, count(*) AS n, lower(concat_ws(chr(31), name, employer, zip5)) AS search_text FROM k WHERE name IS NOT NULL GROUP BY donor, name, employer, zip5""")
def donor_key_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).filter("name is not null").withColumn("donor", X.donor_key(F.col("name"), F.col("employer"), F.col("zip5")))
    return t.groupBy("donor", "name", "employer", "zip5").agg(X.total(F.col("amount")).alias("total"), F.count("*").alias("n")).withColumn("search_text", F.lower(F.concat_ws("\x1f", "name", "employer", "zip5")))


@C.add(f"WITH {TX} SELECT DISTINCT upper(name) AS identity, name, employer, occupation, city, state, zip5 FROM tx WHERE name IS NOT NULL")
def identity_variants_distinct(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).filter("name is not null").select(F.upper("name").alias("identity"), "name", "employer", "occupation", "city", "state", "zip5").distinct()


@C.add(f"""WITH {TX}, v AS (SELECT upper(name) AS name_key, zip5, min(committee) AS one, count(DISTINCT committee) AS c FROM tx WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT name_key, CASE WHEN max(c) = 1 AND count(DISTINCT one) = 1 THEN min(one) END AS resolved, count(*) AS variants FROM v GROUP BY name_key""")
def unanimous_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Two-level aggregate: the one value all variants agree on, else null."""
    v = transactions(spark, d).filter("name is not null").groupBy(F.upper("name").alias("name_key"), "zip5").agg(F.min("committee").alias("one"), F.count_distinct("committee").alias("c"))
    return v.groupBy("name_key").agg(F.when((F.max("c") == 1) & (F.count_distinct("one") == 1), F.min("one")).alias("resolved"), F.count("*").alias("variants"))


@C.add(f"""WITH {TX}, m AS (SELECT name, zip5, committee, amount, id FROM tx WHERE lower(name) LIKE '%well%' AND amount IS NOT NULL),
page AS (SELECT name, zip5, sum(amount) AS a, count(*) AS n FROM m GROUP BY 1, 2 ORDER BY a DESC, name, zip5 NULLS LAST LIMIT 50),
r AS (SELECT m.name, m.zip5, m.committee, sum(m.amount) AS a FROM m JOIN page p ON m.name = p.name AND m.zip5 IS NOT DISTINCT FROM p.zip5 GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY name, zip5 ORDER BY a DESC, committee) AS k FROM r)
SELECT p.name, p.zip5, CAST(p.a AS {_M}) AS total, p.n, array_to_string((SELECT list(k.committee ORDER BY k.k) FROM k WHERE k.name = p.name AND k.zip5 IS NOT DISTINCT FROM p.zip5 AND k.k <= 5), '|') AS recipients FROM page p""")
def donor_search_page_nested(spark: SparkSession, d: str) -> DataFrame:
    """Donor search: the page is cut first, then enriched with nested top recipients (null-safe hash joins)."""
    m = transactions(spark, d).filter(F.lower("name").contains("well") & F.col("amount").isNotNull()).select("name", "zip5", "committee", "amount")
    page = m.groupBy("name", "zip5").agg(F.sum("amount").alias("a"), F.count("*").alias("n")).orderBy(F.desc("a"), "name", F.asc_nulls_last("zip5")).limit(50)
    p = page.select(F.col("name").alias("pn"), F.col("zip5").alias("pz"))
    r = m.join(F.broadcast(p), (F.col("name") == F.col("pn")) & F.col("zip5").eqNullSafe(F.col("pz"))).groupBy("pn", "pz", "committee").agg(F.sum("amount").alias("s"))  # a page has 50 rows
    k = r.withColumn("k", F.row_number().over(W.partitionBy("pn", "pz").orderBy(F.desc("s"), "committee"))).filter("k <= 5")
    lists = k.groupBy("pn", "pz").agg(F.array_sort(F.collect_list(F.struct("k", "committee"))).alias("l"))
    out = page.join(lists, (F.col("name") == F.col("pn")) & F.col("zip5").eqNullSafe(F.col("pz")), "left")
    return out.select("name", "zip5", F.col("a").cast(X.MONEY).alias("total"), "n", F.concat_ws("|", F.transform("l", lambda x: x["committee"])).alias("recipients"))


@C.add(f"""WITH {TX}, dd AS (SELECT DISTINCT upper(contributor_name_raw) AS k, zip5 FROM donor_er_view WHERE contributor_name_raw IS NOT NULL), o AS (SELECT upper(owner_name) AS k, owner_mail_zip5 AS zip5, parcel_id FROM ownership WHERE owner_name IS NOT NULL),
a AS (SELECT o.parcel_id, dd.k, 1 AS rank_ FROM dd JOIN o ON dd.k = o.k AND dd.zip5 = o.zip5 UNION ALL SELECT o.parcel_id, dd.k, 2 FROM dd JOIN o ON dd.k = o.k)
SELECT parcel_id, k AS owner, CAST(min(rank_) AS BIGINT) AS best FROM a GROUP BY 1, 2""")
def donors_with_property_min_rank(spark: SparkSession, d: str) -> DataFrame:
    donors = table(spark, d, "donor_er_view").filter("contributor_name_raw is not null").select(F.upper("contributor_name_raw").alias("owner"), "zip5").distinct()
    owners = table(spark, d, "ownership").filter("owner_name is not null").select(F.upper("owner_name").alias("owner"), F.col("owner_mail_zip5").alias("zip5"), "parcel_id")
    exact = owners.join(donors, ["owner", "zip5"]).select("parcel_id", "owner", F.lit(1).alias("best"))
    by_name = owners.join(donors.select("owner"), "owner").select("parcel_id", "owner", F.lit(2).alias("best"))
    return exact.unionByName(by_name).groupBy("parcel_id", "owner").agg(F.min("best").cast("long").alias("best"))
