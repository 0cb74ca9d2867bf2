"""Provenance, temporal joins, text expressions, quality, search, linkage and graph queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions import finance as X
from tallybook.functions.text import strip, utc_day
from tallybook.operators import linkage, provenance, similarity
from tallybook.plans.stage import materialize, table
from tallybook.queries.registry import Catalogue
from tallybook.sources.exports import TX, transactions

C = Catalogue()


# ------------------------------------------------------------- provenance


@C.add("""WITH s AS (SELECT id, data_source_id, source_record_key AS k, pull_date, created_at, record_hash, lag(record_hash) OVER w AS before_, row_number() OVER w AS n FROM source_record WINDOW w AS (PARTITION BY data_source_id, source_record_key ORDER BY pull_date, created_at, id)),
m AS (SELECT *, CASE WHEN k IS NOT NULL AND n > 1 AND record_hash IS NOT DISTINCT FROM before_ THEN 'skipped' ELSE 'inserted' END AS action FROM s),
x AS (SELECT *, first_value(CASE WHEN action = 'inserted' THEN id END IGNORE NULLS) OVER (PARTITION BY data_source_id, k ORDER BY pull_date, created_at, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM m)
SELECT id, action, CASE WHEN k IS NOT NULL AND action = 'inserted' THEN nxt END AS successor FROM x""")
def source_supersession(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_record").select("id", "data_source_id", "source_record_key", "pull_date", "created_at", "record_hash")
    return provenance.supersession(s, ["data_source_id", "source_record_key"], ["pull_date", "created_at", "id"], "record_hash").select("id", "action", "successor")


@C.add("""WITH s AS (SELECT data_source_id, source_record_key AS k, record_hash, lag(record_hash) OVER w AS before_, row_number() OVER w AS n FROM source_record WINDOW w AS (PARTITION BY data_source_id, source_record_key ORDER BY pull_date, created_at, id))
SELECT data_source_id, count(*) FILTER (WHERE NOT (k IS NOT NULL AND n > 1 AND record_hash IS NOT DISTINCT FROM before_)) AS inserted, count(*) FILTER (WHERE k IS NOT NULL AND n > 1 AND record_hash IS NOT DISTINCT FROM before_) AS skipped FROM s GROUP BY 1""")
def supersession_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_record").select("id", "data_source_id", "source_record_key", "pull_date", "created_at", "record_hash")
    m = provenance.supersession(s, ["data_source_id", "source_record_key"], ["pull_date", "created_at", "id"], "record_hash")
    return m.groupBy("data_source_id").agg(F.count(F.when(F.col("action") == "inserted", 1)).alias("inserted"), F.count(F.when(F.col("action") == "skipped", 1)).alias("skipped"))


@C.add("SELECT s.data_source_id, count(*) AS n FROM source_record s WHERE NOT EXISTS (SELECT 1 FROM source_record g WHERE g.superseded_by IS NOT NULL AND g.id = s.superseded_by) GROUP BY 1")
def not_superseded_anti(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_record")
    return provenance.not_superseded(s.select("data_source_id", F.col("superseded_by").alias("link")), s.select("id", "superseded_by"), "link").groupBy("data_source_id").agg(F.count("*").alias("n"))


@C.add("SELECT s.data_source_id, count(*) AS n FROM source_record s LEFT JOIN source_record a ON a.id = s.superseded_by AND a.superseded_by IS NULL WHERE s.superseded_by IS NULL OR a.id IS NOT NULL GROUP BY 1")
def active_source_left(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_record")
    return provenance.active_source(s.select("data_source_id", F.col("superseded_by").alias("link")), s.select("id", "superseded_by"), "link").groupBy("data_source_id").agg(F.count("*").alias("n"))


@C.add("""SELECT id, sha256('{' || array_to_string(list_transform(list_sort(list_transform(map_entries(raw_fields), lambda e: {'k': e.key, 'v': e.value})), lambda e: to_json(e.k) || ':' || coalesce(CAST(to_json(e.v) AS VARCHAR), 'null')), ',') || '}') AS digest FROM source_record""")
def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_record").select("id", provenance.record_hash(F.col("raw_fields")).alias("digest"))


@C.add("""SELECT parcel_id, arg_max(owner_name, (ownership_recorded_at, created_at, id)) FILTER (WHERE owner_name IS NOT NULL) AS owner_name, arg_max(owner_mail_city, (ownership_recorded_at, created_at, id)) FILTER (WHERE owner_mail_city IS NOT NULL) AS owner_mail_city
FROM ownership WHERE parcel_id IS NOT NULL AND ownership_recorded_at IS NOT NULL GROUP BY 1""")
def merge_keep_old(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ownership").filter("parcel_id is not null and ownership_recorded_at is not null")
    return provenance.merge_columns(o, ["parcel_id"], ["ownership_recorded_at", "created_at", "id"], ["owner_name", "owner_mail_city"], [])


@C.add("SELECT * EXCLUDE k FROM (SELECT parcel_id, id, owner_name, row_number() OVER (PARTITION BY parcel_id ORDER BY ownership_recorded_at DESC NULLS LAST, created_at DESC NULLS LAST, id) AS k FROM ownership WHERE parcel_id IS NOT NULL) WHERE k = 1")
def field_latest_value(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ownership").filter("parcel_id is not null")
    return provenance.latest(o, ["parcel_id"], [F.desc_nulls_last("ownership_recorded_at"), F.desc_nulls_last("created_at"), F.asc("id")]).select("parcel_id", "id", "owner_name")


@C.add("""WITH inc AS (SELECT data_source_id, id FROM source_record WHERE feed_kind = 'full') SELECT data_source_id, count(*) AS n FROM (SELECT data_source_id, id FROM source_record s WHERE data_source_id NOT IN (SELECT data_source_id FROM inc) UNION ALL SELECT * FROM inc) GROUP BY 1""")
def replace_by_partition(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_record")
    cols = ["data_source_id", "id"]
    return provenance.replace_partition(s.select(*cols), s.filter("feed_kind = 'full'").select(*cols), "data_source_id").groupBy("data_source_id").agg(F.count("*").alias("n"))


# ------------------------------------------------------------- temporal


@C.add("SELECT count(*) FILTER (WHERE (valid_from IS NULL OR valid_from <= DATE '2015-01-01') AND (valid_to IS NULL OR DATE '2015-01-01' < valid_to)) AS covering, count(*) FILTER (WHERE valid_to IS NULL) AS open_ended, date_precision FROM ownership GROUP BY date_precision")
def period_contains(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date(F.lit("2015-01-01"))
    hit = X.covers(F.col("valid_from"), F.col("valid_to"), day)
    return table(spark, d, "ownership").groupBy("date_precision").agg(F.count(F.when(hit, 1)).alias("covering"), F.count(F.when(F.col("valid_to").isNull(), 1)).alias("open_ended"))


@C.add("SELECT id, valid_from, valid_to FROM ownership WHERE (valid_from IS NULL OR valid_from < DATE '2012-12-31' + 1) AND (valid_to IS NULL OR valid_to > DATE '2010-01-01')")
def period_overlaps(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.to_date(F.lit("2010-01-01")), F.to_date(F.lit("2012-12-31"))
    return table(spark, d, "ownership").filter(X.overlaps(F.col("valid_from"), F.col("valid_to"), a, b)).select("id", "valid_from", "valid_to")


@C.add("""WITH runs AS (SELECT DISTINCT data_source_id, CAST(pull_date AT TIME ZONE 'UTC' AS DATE) AS day FROM source_record) SELECT data_source_id, max(day) AS latest, min(day) AS earliest, count(*) AS runs FROM runs WHERE day <= DATE '2024-01-01' GROUP BY 1""")
def asof_latest_run(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "source_record").select("data_source_id", F.to_date("pull_date").alias("day")).distinct()
    return runs.filter(F.col("day") <= F.to_date(F.lit("2024-01-01"))).groupBy("data_source_id").agg(F.max("day").alias("latest"), F.min("day").alias("earliest"), F.count("*").alias("runs"))


@C.add("""WITH runs AS (SELECT DISTINCT data_source_id AS s, CAST(pull_date AT TIME ZONE 'UTC' AS DATE) AS day FROM source_record), probes AS (SELECT id, data_source_id AS s, CAST(created_at AT TIME ZONE 'UTC' AS DATE) - 3 AS at FROM source_record WHERE created_at IS NOT NULL)
SELECT p.id, p.at, r.day AS run FROM probes p ASOF LEFT JOIN runs r ON p.s = r.s AND p.at >= r.day""")
def runs_asof_join(spark: SparkSession, d: str) -> DataFrame:
    """The latest run at or before each probe: both sides in one window per source and year, runs of earlier years carried in.

    A source with very many probes is split by year, so no task holds a whole source.
    """
    s = table(spark, d, "source_record")
    runs = s.select(F.col("data_source_id").alias("s"), F.to_date("pull_date").alias("day")).distinct()
    probes = s.filter("created_at is not null").select("id", F.col("data_source_id").alias("s"), F.date_sub(F.to_date("created_at"), 3).alias("at"))
    both = probes.select("id", "s", "at", F.lit(None).cast("date").alias("run")).unionByName(runs.select(F.lit(None).cast("string").alias("id"), "s", F.col("day").alias("at"), F.col("day").alias("run"))).withColumn("y", F.year("at"))
    w = W.partitionBy("s", "y").orderBy("at", F.col("run").isNull().cast("int"), "id").rowsBetween(W.unboundedPreceding, 0)
    near = both.withColumn("run", F.last("run", ignorenulls=True).over(w)).filter("id is not null")
    last = runs.groupBy("s", F.year("day").alias("y")).agg(F.max("day").alias("m"))  # a row per source and year
    earlier = near.select("s", "y").distinct().join(last.withColumnRenamed("y", "z"), "s").filter("z < y").groupBy("s", "y").agg(F.max("m").alias("carried"))
    return near.join(earlier, ["s", "y"], "left").select("id", "at", F.coalesce("run", "carried").alias("run"))


@C.add(f"""WITH {TX}, o AS (SELECT id, upper(owner_mail_city) AS town, owner_mail_state AS st, valid_from, valid_to FROM ownership), t AS (SELECT id, upper(city) AS town, state AS st, day FROM tx WHERE city IS NOT NULL AND day IS NOT NULL)
SELECT o.id AS owner_id, count(*) AS n, max(t.day) AS last_day FROM o JOIN t ON o.town = t.town AND o.st IS NOT DISTINCT FROM t.st AND (o.valid_from IS NULL OR o.valid_from <= t.day) AND (o.valid_to IS NULL OR t.day < o.valid_to) GROUP BY 1""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Equality keys (one null-safe) first, the interval as a residual; counts per town and day keep it small."""
    t = transactions(spark, d).filter("city is not null and day is not null").groupBy(F.upper("city").alias("town"), F.col("state").alias("st"), "day").agg(F.count("*").alias("c"))
    o = table(spark, d, "ownership").select(F.col("id").alias("owner_id"), F.upper("owner_mail_city").alias("t2"), F.col("owner_mail_state").alias("s2"), "valid_from", "valid_to")
    j = o.join(t, (F.col("t2") == F.col("town")) & F.col("s2").eqNullSafe(F.col("st")) & X.covers(F.col("valid_from"), F.col("valid_to"), F.col("day")))
    return j.groupBy("owner_id").agg(F.sum("c").alias("n"), F.max("day").alias("last_day"))


@C.add("SELECT DISTINCT d.id AS donor_id, o.id AS owner_id FROM donor_er_view d JOIN ownership o ON upper(d.contributor_name_raw) = upper(o.owner_name) OR (upper(d.contributor_city) = upper(o.owner_mail_city) AND d.contributor_zip = o.owner_mail_zip5 AND left(upper(d.contributor_name_raw), 6) = left(upper(o.owner_name), 6))")
def or_join_as_union(spark: SparkSession, d: str) -> DataFrame:
    """A join on either of two conditions as the union of two hash joins."""
    a = table(spark, d, "donor_er_view").select(F.col("id").alias("donor_id"), F.upper("contributor_name_raw").alias("n1"), F.upper("contributor_city").alias("c"), F.col("contributor_zip").alias("z"))
    b = table(spark, d, "ownership").select(F.col("id").alias("owner_id"), F.upper("owner_name").alias("n2"), F.upper("owner_mail_city").alias("c"), F.col("owner_mail_zip5").alias("z"))
    one = a.join(b, F.col("n1") == F.col("n2")).select("donor_id", "owner_id")
    two = a.withColumn("p", F.left("n1", F.lit(6))).join(b.withColumn("p", F.left("n2", F.lit(6))), ["c", "z", "p"]).select("donor_id", "owner_id")
    return one.unionByName(two).distinct()


# ------------------------------------------------------------- expressions


@C.add("""WITH s AS (SELECT id, trim(lower(regexp_replace(canonical_name, '[^a-zA-Z0-9]+', '-', 'g')), '-') AS slug FROM organization) SELECT id, slug, count(*) OVER (PARTITION BY slug) = 1 AS is_unique FROM s""")
def slug_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "organization").select("id", X.slug(F.col("canonical_name")).alias("slug"))
    return s.withColumn("is_unique", F.count("*").over(W.partitionBy("slug")) == 1)


@C.add(f"""WITH {TX} SELECT DISTINCT name FROM tx WHERE NOT regexp_matches(coalesce(name, ''), '[0-9]') AND NOT regexp_matches(coalesce(name, ''), '(?i)\\b(po box|street|avenue|suite)\\b') AND trim(lower(regexp_replace(coalesce(name, ''), '[^a-zA-Z0-9]+', '-', 'g')), '-') <> ''""")
def identity_safe_names(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).filter(X.identity_safe(F.col("name"))).select("name").distinct()


@C.add("""SELECT export_row_id AS id, left(zip_code, 5) AS raw5, CASE WHEN length(regexp_replace(zip_code, '[^0-9]', '', 'g')) >= 5 THEN left(regexp_replace(zip_code, '[^0-9]', '', 'g'), 5) END AS digits5,
 CASE WHEN regexp_matches(trim(zip_code), '^[0-9]{5}(-?[0-9]{4})?$') THEN left(trim(zip_code), 5) END AS strict5 FROM real_transaction_export_adams""")
def zip_derivations(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("zip_code")
    return table(spark, d, "real_transaction_export_adams").select(F.col("export_row_id").alias("id"), F.left(z, F.lit(5)).alias("raw5"), X.zip_digits(z).alias("digits5"), X.zip_strict(z).alias("strict5"))


@C.add(f"WITH {TX} SELECT id, name FROM tx WHERE name ILIKE '%o\\_b%' ESCAPE '\\' OR name ILIKE '%son%'")
def ilike_escaped(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).filter(F.col("name").ilike(X.like_literal("o_b")) | F.col("name").ilike(X.like_literal("son"))).select("id", "name")


@C.add("SELECT export_row_id AS id, CASE WHEN regexp_matches(amount, '^\\s*[=+@\\-]') THEN '''' || amount ELSE amount END AS cell FROM real_transaction_export_adams")
def csv_safe_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "real_transaction_export_adams").select(F.col("export_row_id").alias("id"), X.csv_cell(F.col("amount")).alias("cell"))


@C.add("""SELECT event_type, count(*) AS n, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) FILTER (WHERE json_extract_string(props, '$.missing') IS NULL) AS without FROM events GROUP BY 1""")
def json_access(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("k_sum"), F.count(F.when(F.get_json_object("props", "$.missing").isNull(), 1)).alias("without"))


@C.add("""SELECT o.id, e.key AS k, e.value AS v FROM organization o, (SELECT id AS i, unnest(map_entries(identifiers)) AS e FROM organization) u WHERE u.i = o.id AND trim(e.value) <> ''""")
def identifiers_unnested(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "organization").select("id", F.explode("identifiers").alias("k", "v")).filter(F.trim("v") != "")


@C.add("""WITH p AS (SELECT id, upper(trim(split_part(regexp_replace(owner_name, '(?i)\\s+(?:&|and)\\s+', '|', 'g'), '|', 1))) AS first_owner, len(string_split(regexp_replace(owner_name, '(?i)\\s+(?:&|and)\\s+', '|', 'g'), '|')) AS owners,
 regexp_matches(owner_name, '(?i)\\b(inc|llc|corp|corporation|co|company|committee|cmte|association|assn|partners|pac)\\b') AS is_org FROM ownership WHERE owner_name IS NOT NULL) SELECT id, first_owner, CAST(owners AS BIGINT) AS owners, is_org FROM p""")
def owner_split(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split(F.regexp_replace("owner_name", r"(?i)\s+(?:&|and)\s+", "|"), r"\|")
    org = F.col("owner_name").rlike(r"(?i)\b(inc|llc|corp|corporation|co|company|committee|cmte|association|assn|partners|pac)\b")
    return table(spark, d, "ownership").filter("owner_name is not null").select("id", F.upper(F.trim(F.get(parts, F.lit(0)))).alias("first_owner"), F.size(parts).cast("long").alias("owners"), org.alias("is_org"))


@C.add("""SELECT d.id, coalesce(nullif(trim(d.contributor_city), ''), o.c) AS city, CASE WHEN nullif(trim(d.contributor_city), '') IS NOT NULL THEN 'donor' WHEN o.c IS NOT NULL THEN 'owner' ELSE 'none' END AS origin
FROM donor_er_view d LEFT JOIN (SELECT upper(owner_name) AS k, min(owner_mail_city) AS c FROM ownership WHERE owner_name IS NOT NULL GROUP BY 1) o ON o.k = upper(d.contributor_name_raw)""")
def fill_missing_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """Source-priority chain: a field is taken from the first source that has it."""
    o = table(spark, d, "ownership").filter("owner_name is not null").groupBy(F.upper("owner_name").alias("k")).agg(F.min("owner_mail_city").alias("c"))
    own = F.nullif(F.trim("contributor_city"), F.lit(""))
    j = table(spark, d, "donor_er_view").join(o, F.upper("contributor_name_raw") == F.col("k"), "left")
    return j.select("id", F.coalesce(own, "c").alias("city"), F.when(own.isNotNull(), "donor").when(F.col("c").isNotNull(), "owner").otherwise("none").alias("origin"))


_DATED = ("DEED_DATE", "RcvDate", "receipt_date", "Date Occured", "Filed On", "Second Notice Date")
_DATED_SQL = ", ".join(f"'{c}'" for c in _DATED)


@C.add(f"""WITH f AS (SELECT unnest(map_keys(raw_fields)) AS k, unnest(map_values(raw_fields)) AS v FROM source_record),
p AS (SELECT k, CAST(try_strptime(trim(v, ' ' || chr(9) || chr(10) || chr(13)), ['%Y-%m-%d', '%m/%d/%Y', '%d-%b-%y']) AS DATE) AS day FROM f WHERE k IN ({_DATED_SQL}))
SELECT k AS field, count(*) AS n, count(day) AS parsed, count(*) FILTER (WHERE day BETWEEN DATE '1970-01-01' AND DATE '2050-12-31') AS reliable, min(day) AS first_day, max(day) AS last_day FROM p GROUP BY 1""")
def dates_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Date cascade over the notations of the feeds, with the window of reliable dates."""
    f = table(spark, d, "source_record").select(F.explode("raw_fields").alias("field", "v")).filter(F.col("field").isin(*_DATED))
    day = F.coalesce(*[F.try_to_timestamp(strip(F.col("v")), F.lit(x)) for x in ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yy")]).cast("date")
    p = f.select("field", day.alias("day"))
    good = F.col("day").between(F.to_date(F.lit("1970-01-01")), F.to_date(F.lit("2050-12-31")))
    return p.groupBy("field").agg(F.count("*").alias("n"), F.count("day").alias("parsed"), F.count(F.when(good, 1)).alias("reliable"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@C.add(f"""WITH {TX}, e AS (SELECT regexp_replace(trim(regexp_replace(regexp_replace(upper(employer), '[^A-Z0-9&]', ' ', 'g'), ' +', ' ', 'g'), ' '), '\\bL L C\\b', 'LLC', 'g') AS v FROM tx WHERE employer IS NOT NULL)
SELECT regexp_replace(v, ' (INC|LLC|CORP|CORPORATION|CO|COMPANY|LTD|LLP|LP)$', '') AS employer, count(*) AS n FROM e WHERE v NOT IN ('', 'N A', 'NA', 'NONE', 'UNKNOWN', 'REQUESTED', 'INFORMATION REQUESTED', 'BEST EFFORTS') GROUP BY 1""")
def employers_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Employers without punctuation and with one legal suffix dropped; placeholders are no employers."""
    v = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.upper("employer"), "[^A-Z0-9&]", " "), " +", " ")), r"\bL L C\b", "LLC")
    e = transactions(spark, d).filter("employer is not null").select(v.alias("v")).filter(~F.col("v").isin("", "N A", "NA", "NONE", "UNKNOWN", "REQUESTED", "INFORMATION REQUESTED", "BEST EFFORTS"))
    return e.groupBy(F.regexp_replace("v", " (INC|LLC|CORP|CORPORATION|CO|COMPANY|LTD|LLP|LP)$", "").alias("employer")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------- quality

_NULLS = ("name", "employer", "zip5", "amount", "day")


@C.add(f"WITH {TX} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count(*) - count({c}) AS missing, CAST(round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS DOUBLE) AS rate FROM tx" for c in _NULLS))
def null_rates(spark: SparkSession, d: str) -> DataFrame:
    """One scan for all fields, then one row each."""
    one = transactions(spark, d).agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in _NULLS])
    long = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("have")) for c in _NULLS])).alias("x"))
    return long.select("x.field", "n", (F.col("n") - F.col("x.have")).alias("missing"), F.round((F.col("n") - F.col("x.have")) / F.col("n").cast("double"), 6).alias("rate"))


@C.add("""WITH g AS (SELECT record_hash, count(*) AS n FROM source_record WHERE record_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra, CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN 'pass' WHEN sum(n - 1) < 100 THEN 'warn' ELSE 'fail' END AS status FROM g""")
def duplicate_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "source_record").filter("record_hash is not null").groupBy("record_hash").agg(F.count("*").alias("n")).filter("n > 1")
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return g.agg(F.count("*").alias("groups"), extra.alias("extra"), F.when(extra == 0, "pass").when(extra < 100, "warn").otherwise("fail").alias("status"))


@C.add(f"""WITH {TX} SELECT count(*) AS rows_, count(amount) AS readable, count(*) FILTER (WHERE abs(amount) > 1000) AS wild, CAST(min(amount) AS DOUBLE) AS lo, CAST(max(amount) AS DOUBLE) AS hi, min(day) AS first_day, max(day) AS last_day, count(DISTINCT committee) AS committees FROM tx""")
def amount_sanity(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).agg(F.count("*").alias("rows_"), F.count("amount").alias("readable"), F.count(F.when(F.abs("amount") > 1000, 1)).alias("wild"), F.min("amount").cast("double").alias("lo"), F.max("amount").cast("double").alias("hi"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("committee").alias("committees"))


@C.add("""WITH r AS (SELECT data_source_id, CAST(pull_date AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS n FROM source_record GROUP BY 1, 2), m AS (SELECT *, median(n) OVER (PARTITION BY data_source_id) AS typical FROM r)
SELECT data_source_id, strftime(day, '%Y-%m-%d') AS day, n, CAST(typical AS DOUBLE) AS typical, CASE WHEN n < 0.5 * typical THEN 'degraded' ELSE 'success' END AS status FROM m""")
def pull_status_median(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "source_record").groupBy("data_source_id", utc_day(F.col("pull_date")).alias("day")).agg(F.count("*").alias("n"))
    m = r.withColumn("typical", F.median("n").over(W.partitionBy("data_source_id")))
    return m.select("data_source_id", "day", "n", F.col("typical").cast("double").alias("typical"), F.when(F.col("n") < 0.5 * F.col("typical"), "degraded").otherwise("success").alias("status"))


@C.add("""WITH f AS (SELECT id, unnest(map_keys(raw_fields)) AS k, unnest(map_values(raw_fields)) AS v FROM source_record) SELECT k AS field, count(*) AS n, count(*) FILTER (WHERE coalesce(trim(v, ' '), '') = '') AS blank FROM f GROUP BY 1""")
def raw_field_completeness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_record").select(F.explode("raw_fields").alias("field", "v")).groupBy("field").agg(F.count("*").alias("n"), F.count(F.when(F.coalesce(F.trim("v"), F.lit("")) == "", 1)).alias("blank"))


@C.add("""WITH t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM eval_items), g AS (SELECT suite, count(*) AS n, count(*) / max(t.t) AS p, max(t.t) AS t FROM eval_items, t GROUP BY 1)
SELECT suite, n, round((p + 1.9208 / t - 1.96 * sqrt((p * (1 - p) + 0.9604 / t) / t)) / (1 + 3.8416 / t), 6) AS lo, round((p + 1.9208 / t + 1.96 * sqrt((p * (1 - p) + 0.9604 / t) / t)) / (1 + 3.8416 / t), 6) AS hi, CAST(ceil(3.8416 * p * (1 - p) / 0.0025) AS BIGINT) AS required FROM g""")
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    """95% interval of each suite's share of all items, and the sample that would fix it to five points."""
    e = table(spark, d, "eval_items")
    g = e.groupBy("suite").agg(F.count("*").alias("n")).join(F.broadcast(e.agg(F.count("*").cast("double").alias("t"))))
    p, t = F.col("n") / F.col("t"), F.col("t")
    half = 1.96 * F.sqrt((p * (1 - p) + 0.9604 / t) / t)
    return g.select("suite", "n", F.round((p + 1.9208 / t - half) / (1 + 3.8416 / t), 6).alias("lo"), F.round((p + 1.9208 / t + half) / (1 + 3.8416 / t), 6).alias("hi"), F.ceil(3.8416 * p * (1 - p) / 0.0025).cast("long").alias("required"))


# ------------------------------------------------------------- search and linkage

_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', i, 3)))))"
_Q = "bellweather printing"


@C.add(f"""WITH q AS (SELECT {_GRAMS.format(c="'" + _Q + "'")} AS g), o AS (SELECT id, canonical_name AS name, {_GRAMS.format(c="canonical_name")} AS g FROM organization)
SELECT id, name, CAST(round(len(list_intersect(o.g, q.g)) / CAST(len(list_distinct(list_concat(o.g, q.g))) AS DOUBLE), 6) AS DOUBLE) AS similarity, contains(lower(name), '{_Q}') AS contains_
FROM o, q WHERE contains(lower(name), '{_Q}') OR len(list_intersect(o.g, q.g)) / CAST(len(list_distinct(list_concat(o.g, q.g))) AS DOUBLE) >= 0.3""")
def trigram_search(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "organization").select("id", F.col("canonical_name").alias("name"))
    s = o.withColumn("s", similarity.trigram_similarity(F.col("name"), F.lit(_Q))).withColumn("contains_", F.lower("name").contains(_Q))
    return s.filter("contains_ or s >= 0.3").select("id", "name", F.round("s", 6).alias("similarity"), "contains_")


@C.add("""WITH a AS (SELECT DISTINCT upper(canonical_name) AS x, registered_state AS st, left(upper(canonical_name), 5) AS p FROM organization), b AS (SELECT DISTINCT upper(name) AS y, mailing_address_state AS st, left(upper(name), 5) AS p FROM political_organization_527)
SELECT x, y, CAST(round(jaro_winkler_similarity(x, y), 5) AS DOUBLE) AS jw FROM a JOIN b USING (st, p) WHERE round(jaro_winkler_similarity(x, y), 5) >= 0.9""")
def jaro_winkler_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "organization").select(F.upper("canonical_name").alias("x"), F.col("registered_state").alias("st")).distinct().withColumn("p", F.left("x", F.lit(5)))
    b = table(spark, d, "political_organization_527").select(F.upper("name").alias("y"), F.col("mailing_address_state").alias("st")).distinct().withColumn("p", F.left("y", F.lit(5)))
    return a.join(b, ["st", "p"]).withColumn("jw", F.round(similarity.jaro_winkler("x", "y"), 5)).filter("jw >= 0.9").select("x", "y", "jw")


_RULES = {"name_state": ["surname", "contributor_state"], "zip_prefix": ["zip5", "prefix"], "employer_zip": ["employer", "zip5"]}


def _donors(spark: SparkSession, d: str) -> DataFrame:
    n = F.upper(F.trim("contributor_name_raw"))
    return table(spark, d, "donor_er_view").select("id", F.regexp_extract(n, "([A-Z]+)$", 1).alias("surname"), F.left(n, F.lit(5)).alias("prefix"), "contributor_state", "zip5", F.upper("contributor_employer").alias("employer"), n.alias("n"))


_DON = "dn AS (SELECT id, regexp_extract(upper(trim(contributor_name_raw, ' ')), '([A-Z]+)$', 1) AS surname, left(upper(trim(contributor_name_raw, ' ')), 5) AS prefix, contributor_state, zip5, upper(contributor_employer) AS employer FROM donor_er_view)"


@C.add(f"WITH {_DON} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS blocks, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, CAST(coalesce(sum(n * (n - 1) / 2), 0) AS BIGINT) AS pairs, coalesce(max(n), 0) AS largest FROM (SELECT count(*) AS n FROM dn WHERE {' AND '.join(c + ' IS NOT NULL' for c in cs)} GROUP BY {', '.join(cs)})" for n, cs in _RULES.items()))
def blocking_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return linkage.block_sizes(_donors(spark, d), _RULES)


_LEVELS = {"name_level": 3, "employer_level": 2, "surname_level": 2}


#: Jaro-Winkler similarities from which names reach a level.
_ALIKE = {1: 0.9, 2: 0.97}


def _compared(pairs: DataFrame, near: bool) -> DataFrame:
    """Pairs of donors with comparison levels (-1: missing): those whose names may be alike, else those whose cannot, which Python never sees."""
    agree = lambda c: F.when(F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull(), -1).when(F.col(f"a_{c}") == F.col(f"b_{c}"), 1).otherwise(0)
    maybe = F.coalesce(similarity.jaro_winkler_bound("a_letters", "b_letters") >= _ALIKE[1], F.lit(False))
    name = F.when(F.col("jw") >= _ALIKE[2], 2).when(F.col("jw") >= _ALIKE[1], 1).otherwise(0) if near else F.lit(0)
    kept = pairs.filter(maybe).withColumn("jw", similarity.jaro_winkler("a_n", "b_n")) if near else pairs.filter(~maybe)
    return kept.withColumns({"name_level": name, "employer_level": agree("employer"), "surname_level": agree("surname")})


def _scored(spark: SparkSession, d: str, least: float = 0.0) -> DataFrame:
    """(l, r, rule, probability) of the blocked pairs of at least ``least`` probability.

    Every pair is compared and counted. Pairs of names that cannot be alike, nearly all, are
    made anew instead of written, and only where one of their patterns can reach ``least``.
    """
    donors = materialize(_donors(spark, d).withColumn("letters", similarity.letters("n")), "donors")
    names, levels = list(_LEVELS), list(_LEVELS.values())
    chance = linkage.random_pairs(donors)
    u = linkage.sampled_u(_compared(chance, True).select(*names).unionByName(_compared(chance, False).select(*names)), names, levels)
    pairs = linkage.blocked_pairs(donors, _RULES)
    columns = ["l", "r", "rule", "stratum", *names]
    near, far = materialize(_compared(pairs, True).select(*columns), "compared"), _compared(pairs, False).select(*columns)
    # at most the product of the levels, by stratum
    counted = near.select("stratum", *names).unionByName(far.select("stratum", *names)).groupBy("stratum", *names).agg(F.count("*").alias("c")).collect()
    fixed = {rule: [names.index(f)] for rule, f in (("name_state", "surname_level"), ("employer_zip", "employer_level"))}
    found = linkage.pattern_probabilities([(r["stratum"], tuple(r[f] for f in names), r["c"]) for r in counted], levels, fixed, u)
    rated = [(s, *g, p) for s, g, p in found if p >= least]
    known = F.broadcast(spark.createDataFrame(rated, f"stratum string, {', '.join(f'{f} int' for f in names)}, probability double"))
    whole = near.unionByName(far) if any(g[0] == 0 for _, g, p in found if p >= least) else near
    return whole.join(known, ["stratum", *names]).select("l", "r", "rule", "probability")


@C.add()
def linkage_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of donors blocked by every rule of _RULES, compared, trained (u from random pairs, m and priors by EM) and classified."""
    return _scored(spark, d).select("l", "r", "rule", F.round("probability", 6).alias("probability"), linkage.classify(F.col("probability")).alias("decision"))


@C.add()
def linkage_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Components over the matches, each with its canonical member (smallest id)."""
    return linkage.components(_scored(spark, d, least=0.95))


@C.add("""WITH RECURSIVE e AS (SELECT DISTINCT a.id AS l, b.id AS r FROM ownership a JOIN ownership b ON upper(a.owner_name) = upper(b.owner_name) AND a.owner_mail_zip5 = b.owner_mail_zip5 AND a.id <> b.id), reach(id, seen) AS (SELECT l, l FROM e UNION SELECT reach.id, e.r FROM reach JOIN e ON e.l = reach.seen) SELECT id, min(seen) AS component FROM reach GROUP BY id""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Components over owners of one name and ZIP, as links of each row to the block's first."""
    o = table(spark, d, "ownership").filter("owner_name is not null and owner_mail_zip5 is not null").select("id", F.upper("owner_name").alias("k"), F.col("owner_mail_zip5").alias("z"))
    first = o.groupBy("k", "z").agg(F.min("id").alias("l"))
    return linkage.components(o.join(first, ["k", "z"]).filter("id != l").select("l", F.col("id").alias("r")))


@C.add("""WITH RECURSIVE b AS (SELECT id, upper(owner_name) AS k, owner_mail_zip5 AS z, upper(owner_mail_city) AS town FROM ownership WHERE owner_name IS NOT NULL AND owner_mail_zip5 IS NOT NULL), f AS (SELECT k, z, min(id) AS l FROM b GROUP BY 1, 2),
p AS (SELECT f.l, b.id AS r, CASE WHEN b.town IS NOT DISTINCT FROM h.town THEN 0.97 ELSE 0.85 END AS probability FROM b JOIN f USING (k, z) JOIN b h ON h.id = f.l WHERE b.id <> f.l), e AS (SELECT l, r FROM p UNION SELECT r, l FROM p), reach(id, seen) AS (SELECT l, l FROM e UNION SELECT reach.id, e.r FROM reach JOIN e ON e.l = reach.seen),
c AS (SELECT id, min(seen) AS component FROM reach GROUP BY id), w AS (SELECT c.component, p.*, row_number() OVER (PARTITION BY c.component ORDER BY p.probability, p.l, p.r) AS k FROM p JOIN c ON c.id = p.l) SELECT w.component, (SELECT count(*) FROM c WHERE c.component = w.component) AS members, CAST(w.probability AS DOUBLE) AS confidence, w.l, w.r FROM w WHERE k = 1""")
def component_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Components with the least sure of their decisions: owners of one name and ZIP, less sure where the towns differ."""
    o = table(spark, d, "ownership").filter("owner_name is not null and owner_mail_zip5 is not null").select("id", F.upper("owner_name").alias("k"), F.col("owner_mail_zip5").alias("z"), F.upper("owner_mail_city").alias("town"))
    first = o.groupBy("k", "z").agg(F.min(F.struct("id", "town")).alias("h"))
    pairs = o.join(first, ["k", "z"]).filter("id != h.id").select(F.col("h.id").alias("l"), F.col("id").alias("r"), F.when(F.col("town").eqNullSafe(F.col("h.town")), 0.97).otherwise(0.85).alias("probability"))
    pairs = materialize(pairs, "decisions")
    return linkage.weakest_links(linkage.components(pairs.select("l", "r")), pairs)


# ------------------------------------------------------------- graph

_FAMILY = "CASE WHEN kind IN ('Operating Exp', 'Coord Party Exp', 'Refund') THEN 'SPENT_ON' ELSE 'CONTRIBUTED_TO' END"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, type, dst, source_record_id): edges merged on their four-part key; rows without an id make none."""
    t = transactions(spark, d).filter("name is not null and committee is not null and id is not null")
    money = t.select(F.upper("name").alias("src"), F.when(F.col("kind").isin("Operating Exp", "Coord Party Exp", "Refund"), "SPENT_ON").otherwise("CONTRIBUTED_TO").alias("type"), F.col("committee").alias("dst"), F.col("id").alias("source_record_id"))
    owns = table(spark, d, "ownership").filter("owner_name is not null and parcel_id is not null").select(F.upper("owner_name").alias("src"), F.lit("OWNS").alias("type"), F.col("parcel_id").alias("dst"), F.col("id").alias("source_record_id"))
    located = table(spark, d, "organization").filter("primary_address_id is not null").select(F.col("id").alias("src"), F.lit("LOCATED_IN").alias("type"), F.col("primary_address_id").alias("dst"), F.col("id").alias("source_record_id"))
    return reduce(lambda x, y: x.unionByName(y), (money, owns, located)).dropDuplicates(["src", "type", "dst", "source_record_id"])


_EDGES = f"""{TX}, ed AS (SELECT DISTINCT upper(name) AS src, {_FAMILY} AS type, committee AS dst, id AS source_record_id FROM tx WHERE name IS NOT NULL AND committee IS NOT NULL AND id IS NOT NULL
 UNION SELECT upper(owner_name), 'OWNS', parcel_id, id FROM ownership WHERE owner_name IS NOT NULL AND parcel_id IS NOT NULL UNION SELECT id, 'LOCATED_IN', primary_address_id, id FROM organization WHERE primary_address_id IS NOT NULL)"""


@C.add(f"WITH {_EDGES} SELECT type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM ed GROUP BY type")
def graph_edge_families(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("type").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@C.add(f"WITH {_EDGES} SELECT 'out' AS direction, type, dst AS node, count(*) AS n FROM ed WHERE src = 'VICTORIA LINDWELL' AND type <> 'LOCATED_IN' GROUP BY 2, 3 UNION ALL SELECT 'in', type, src, count(*) FROM ed WHERE dst = 'STA-H99334K-C-001' AND type <> 'LOCATED_IN' GROUP BY 2, 3")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors(edges(spark, d), "VICTORIA LINDWELL", "STA-H99334K-C-001")


def neighbors(e: DataFrame, source: str, target: str, hidden: tuple[str, ...] = ("LOCATED_IN",)) -> DataFrame:
    """One-hop neighbourhood: edges out of ``source`` and into ``target``, but for the hidden types."""
    e = e.filter(~F.col("type").isin(*hidden))
    out = e.filter(F.col("src") == source).select(F.lit("out").alias("direction"), "type", F.col("dst").alias("node"))
    into = e.filter(F.col("dst") == target).select(F.lit("in").alias("direction"), "type", F.col("src").alias("node"))
    return out.unionByName(into).groupBy("direction", "type", "node").agg(F.count("*").alias("n"))


@C.add(f"WITH {_EDGES} SELECT 'node' AS what, count(*) AS n FROM (SELECT src FROM ed UNION SELECT dst FROM ed)")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().agg(F.lit("node").alias("what"), F.count("*").alias("n"))
