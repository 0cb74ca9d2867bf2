"""Typed text, codes, filters and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions import finance as X
from tallybook.functions import normalize as N
from tallybook.plans.stage import table
from tallybook.queries.registry import Catalogue
from tallybook.sources import delimited
from tallybook.sources.exports import TX, transactions

C = Catalogue()
#: The day that stands for today, so that results stay the same.
TODAY = "2024-06-30"
_PRE = "['MR', 'MRS', 'MS', 'MISS', 'DR', 'HON', 'REV', 'PROF']"
_SUF = "['JR', 'SR', 'II', 'III', 'IV', 'ESQ', 'MD', 'PHD']"


@C.add(f"""WITH {TX}, b AS (SELECT DISTINCT name, upper(replace(name, '.', '')) AS u FROM tx WHERE name IS NOT NULL),
w AS (SELECT name, contains(u, ',') AS comma, CASE WHEN contains(u, ',') THEN list_filter(string_split_regex(split_part(u, ',', 1), '\\s+'), lambda x: x <> '' AND NOT list_contains({_PRE}, x)) ELSE [] END AS front,
 list_filter(string_split_regex(replace(CASE WHEN contains(u, ',') THEN substr(u, instr(u, ',') + 1) ELSE u END, ',', ' '), '\\s+'), lambda x: x <> '' AND NOT list_contains({_PRE}, x)) AS rest FROM b),
g AS (SELECT *, list_filter(rest, lambda x: NOT list_contains({_SUF}, x)) AS given, list_filter(front, lambda x: NOT list_contains({_SUF}, x)) AS fam, list_filter(list_concat(front, rest), lambda x: list_contains({_SUF}, x))[1] AS suffix FROM w),
p AS (SELECT name, given[1] AS first, nullif(array_to_string(CASE WHEN comma THEN given[2:] ELSE given[2:greatest(len(given) - 1, 1)] END, ' '), '') AS middle, CASE WHEN comma THEN nullif(array_to_string(fam, ' '), '') WHEN len(given) > 1 THEN given[len(given)] END AS last, suffix FROM g)
SELECT *, nullif(concat_ws(' ', first, left(middle, 1), last, suffix), '') AS canonical FROM p""")
def person_names_parsed(spark: SparkSession, d: str) -> DataFrame:
    names = transactions(spark, d).filter("name is not null").select("name").distinct()
    return names.select("name", N.person_name(F.col("name")).alias("p")).select("name", "p.*")


@C.add(f"WITH {TX} SELECT id, CASE WHEN year(day) BETWEEN 1970 AND 2050 THEN day END AS day FROM tx")
def dates_in_all_notations(spark: SparkSession, d: str) -> DataFrame:
    """Each date written in one of five notations and read back."""
    t = transactions(spark, d).select("id", "day", (F.ascii(F.right("id", F.lit(1))) % 5).alias("k"))
    text = F.when(F.col("k") == 0, F.date_format("day", "MMddyyyy")).when(F.col("k") == 1, F.date_format("day", "yyyy-MM-dd")).when(F.col("k") == 2, F.date_format("day", "M/d/yyyy")).when(F.col("k") == 3, F.date_format("day", "M/d/yy")).otherwise(F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.select("id", N.typed_date(text).alias("day"))


_STATES = "CASE upper(trim(state, ' ')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.STATE_CODES.items()) + " ELSE CASE WHEN length(upper(trim(state, ' '))) = 2 THEN upper(trim(state, ' ')) END END"
_UNIT = r"(?:APT|STE|SUITE|UNIT|#)\.? ?#?([0-9]+-?[A-Z]?|[A-Z])$"


@C.add(f"""WITH s AS (SELECT export_row_id AS id, upper(regexp_replace(trim(street_line_1, ' '), '\\s+', ' ', 'g')) AS s, {_STATES} AS state, regexp_replace(zip_code, '[^0-9]', '', 'g') AS z FROM real_transaction_export_adams),
j AS (SELECT id, CASE WHEN s NOT IN ('', 'N/A', 'NONE', 'UNKNOWN', 'NOT AVAILABLE') THEN s END AS s, state, z FROM s), b AS (SELECT *, nullif(regexp_extract(s, '{_UNIT}', 1), '') AS unit, nullif(trim(regexp_replace(s, ',? ?{_UNIT}', ''), ' '), '') AS bare FROM j)
SELECT id, nullif(regexp_extract(bare, '^([0-9]+[A-Z]?) ', 1), '') AS number, unit, regexp_replace(bare, '^[0-9]+[A-Z]? ', '') AS street, state, CASE WHEN length(z) >= 5 THEN left(z, 5) END AS zip5, CASE WHEN length(z) = 9 THEN right(z, 4) END AS zip4 FROM b""")
def addresses_parsed(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "real_transaction_export_adams")
    return x.select(F.col("export_row_id").alias("id"), N.address_parts(F.col("street_line_1"), F.col("state"), F.col("zip_code")).alias("p")).select("id", "p.*")


@C.add(f"""WITH {TX}, v AS (SELECT regexp_replace(trim(regexp_replace(regexp_replace(upper(nfc_normalize(employer)), '[^\\p{{L}}\\p{{N}}&]', ' ', 'g'), ' +', ' ', 'g'), ' '), '\\bL L C\\b', 'LLC', 'g') AS v FROM tx WHERE employer IS NOT NULL)
SELECT regexp_replace(v, ' (INC|LLC|CORP|CORPORATION|CO|COMPANY|LTD|LLP|LP)$', '') AS employer, count(*) AS n FROM v WHERE v NOT IN ('', 'N A', 'NA', 'NONE', 'UNKNOWN', 'REQUESTED', 'INFORMATION REQUESTED', 'BEST EFFORTS') GROUP BY 1""")
def employers_composed(spark: SparkSession, d: str) -> DataFrame:
    """Employers in composed Unicode and canonical spelling; only different texts with letters beyond ASCII pass through Python."""
    t = transactions(spark, d).filter("employer is not null").groupBy("employer").agg(F.count("*").alias("n"))
    plain = F.col("employer").rlike(r"^\p{ASCII}*$")
    both = t.filter(plain).unionByName(t.filter(~plain).select(N.nfc(F.col("employer")).alias("employer"), "n"))
    return both.groupBy(N.employer(F.col("employer")).alias("employer")).agg(F.sum("n").alias("n")).filter("employer is not null")


def _industry(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(upper({c}), '{p}') THEN '{n}'" for p, n in N.INDUSTRIES) + " END"


@C.add(f"""WITH {TX} SELECT coalesce({_industry("employer")}, {_industry("occupation")}) AS industry, CASE WHEN upper(trim(employer, ' ')) IN ('N/A', 'NONE', 'UNKNOWN', 'RETIRED', 'SELF', 'SELF-EMPLOYED', 'NOT EMPLOYED', '') THEN CAST(0.01 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS weight, count(*) AS n, count(DISTINCT employer) AS employers FROM tx GROUP BY 1, 2""")
def industries(spark: SparkSession, d: str) -> DataFrame:
    """Industry by employer with the occupation as fallback, and the weight of the evidence."""
    return transactions(spark, d).groupBy(N.industry(F.col("employer"), F.col("occupation")).alias("industry"), N.junk_weight(F.col("employer")).alias("weight")).agg(F.count("*").alias("n"), F.count_distinct("employer").alias("employers"))


@C.add(f"""WITH {TX} SELECT CASE WHEN kind = 'Individual' THEN 'donor' WHEN kind IN ('Party Comm', 'Non-Party Comm') THEN 'committee' WHEN kind = 'Loan Proceeds' THEN 'lender' WHEN kind IN ('Operating Exp', 'Coord Party Exp') THEN 'vendor' WHEN kind = 'Refund' AND amount > 0 THEN 'refunded' ELSE 'unknown' END AS role, count(*) AS n, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total FROM tx GROUP BY 1""")
def counterparty_roles(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).groupBy(N.counterparty_role(F.col("kind"), F.col("amount")).alias("role")).agg(F.count("*").alias("n"), X.total(F.col("amount")).alias("total"))


@C.add("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), n AS (SELECT y, m, make_date(y, 11, 1) AS d FROM y)
SELECT CAST(y AS BIGINT) AS y, CAST(m AS BIGINT) AS m, CAST(d + CAST((8 - isodow(d)) % 7 + 1 AS INTEGER) AS DATE) AS election_day, CASE WHEN m BETWEEN 11 AND 13 THEN m || 'th' WHEN m % 10 = 1 THEN m || 'st' WHEN m % 10 = 2 THEN m || 'nd' WHEN m % 10 = 3 THEN m || 'rd' ELSE m || 'th' END || ' District ' || y AS contest FROM n""")
def election_days(spark: SparkSession, d: str) -> DataFrame:
    """Contest names and the Tuesday after the first Monday of November."""
    y = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    return y.select(F.col("y").cast("long").alias("y"), F.col("m").cast("long").alias("m"), N.election_day(F.col("y")).alias("election_day"), F.concat(N.ordinal(F.col("m")), F.lit(" District "), F.col("y").cast("string")).alias("contest"))


@C.add(f"""WITH {TX}, p AS (SELECT id, 'person' AS what, upper(name) AS v FROM tx WHERE kind = 'Individual' AND name IS NOT NULL UNION ALL SELECT id, 'employer', upper(employer) FROM tx WHERE kind = 'Individual' AND name IS NOT NULL AND employer IS NOT NULL UNION ALL SELECT id, 'organization', committee FROM tx WHERE committee IS NOT NULL UNION ALL SELECT id, 'address', concat_ws(', ', upper(city), state) FROM tx WHERE state IS NOT NULL)
SELECT what, v, count(*) AS n FROM p GROUP BY 1, 2""")
def contribution_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each contribution yields a person with identifiers, the recipient and an address, in one pass."""
    one = lambda what, cond, v: F.when(cond, F.struct(F.lit(what).alias("what"), v.alias("v")))
    person = (F.col("kind") == "Individual") & F.col("name").isNotNull()
    made = F.array_compact(F.array(one("person", person, F.upper("name")), one("employer", person & F.col("employer").isNotNull(), F.upper("employer")), one("organization", F.col("committee").isNotNull(), F.col("committee")), one("address", F.col("state").isNotNull(), F.concat_ws(", ", F.upper("city"), F.col("state")))))
    return transactions(spark, d).select(F.explode(made).alias("e")).groupBy("e.what", "e.v").agg(F.count("*").alias("n"))


@C.add("""SELECT id, '[' || coalesce(CAST(valid_from AS VARCHAR), '-infinity') || ',' || coalesce(CAST(valid_to AS VARCHAR), 'infinity') || ')' AS period, valid_from IS NULL AS lower_inf, valid_to IS NULL AS upper_inf FROM ownership""")
def period_serialised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ownership").select("id", N.period_text(F.col("valid_from"), F.col("valid_to")).alias("period"), F.col("valid_from").isNull().alias("lower_inf"), F.col("valid_to").isNull().alias("upper_inf"))


@C.add("""WITH r AS (SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN 'AL' WHEN 1 THEN '00' WHEN 2 THEN NULL ELSE CAST(n_nationkey AS VARCHAR) END AS dist, n_regionkey AS r FROM nation), n AS (SELECT k, r, dist, CASE WHEN dist IS NULL OR dist IN ('AL', '00', '0') THEN 'AL' ELSE lpad(dist, 2, '0') END AS code FROM r)
SELECT a.k AS member, b.k AS candidate FROM n a JOIN n b ON a.r = b.r AND a.k <> b.k AND (a.dist IS NULL OR a.code = b.code)""")
def district_matches(spark: SparkSession, d: str) -> DataFrame:
    """District codes compared with their at-large spellings, within a region."""
    k = F.col("n_nationkey")
    dist = F.when(k % 5 == 0, "AL").when(k % 5 == 1, "00").when(k % 5 == 2, F.lit(None).cast("string")).otherwise(k.cast("string"))
    n = table(spark, d, "nation").select(k.alias("k"), dist.alias("dist"), F.col("n_regionkey").alias("r"))
    a, b = n.select(F.col("k").alias("member"), F.col("dist").alias("da"), "r"), n.select(F.col("k").alias("candidate"), F.col("dist").alias("db"), "r")
    return a.join(b, "r").filter((F.col("member") != F.col("candidate")) & N.same_district(F.col("da"), F.col("db"))).select("member", "candidate")


@C.add("""SELECT data_source_id, count(*) AS n, CAST(max(CASE WHEN superseded_by IS NULL THEN greatest(pull_date, created_at) ELSE pull_date END) AT TIME ZONE 'UTC' AS DATE) AS effective, count(DISTINCT CASE WHEN map_contains(raw_fields, 'zip') THEN 1 END) AS has_zip FROM source_record GROUP BY 1""")
def effective_pull_dates(spark: SparkSession, d: str) -> DataFrame:
    """A successful pull counts from its later date; key existence in a map."""
    s = table(spark, d, "source_record")
    return s.groupBy("data_source_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("superseded_by").isNull(), F.greatest("pull_date", "created_at")).otherwise(F.col("pull_date"))).cast("date").alias("effective"), F.count_distinct(F.when(F.map_contains_key("raw_fields", "zip"), 1)).alias("has_zip"))


_LABEL = "CASE WHEN p_size <= 5 THEN 'house' WHEN p_size <= 15 THEN 'senate class ' || (p_size % 3 + 1) WHEN p_type LIKE 'ECONOMY%' THEN 'state ' || lower(split_part(p_type, ' ', 1)) ELSE 'local' END"


@C.add(f"SELECT {_LABEL} AS office, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1")
def office_labels(spark: SparkSession, d: str) -> DataFrame:
    """A ladder of labels."""
    s = F.col("p_size")
    label = F.when(s <= 5, "house").when(s <= 15, F.concat(F.lit("senate class "), (s % 3 + 1).cast("string"))).when(F.col("p_type").like("ECONOMY%"), F.concat(F.lit("state "), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))))).otherwise("local")
    return table(spark, d, "part").groupBy(label.alias("office")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


@C.add("SELECT id, CAST(length(name) AS BIGINT) AS measure, CAST(NULL AS VARCHAR) AS absent FROM political_organization_527 WHERE name IS NOT NULL")
def column_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """A column that a table may lack is read through the row's JSON: null where absent."""
    t = table(spark, d, "political_organization_527").filter("name is not null")
    row = F.to_json(F.struct("id", F.length("name").alias("measure")))
    return t.select("id", F.get_json_object(row, "$.measure").try_cast("bigint").alias("measure"), F.get_json_object(row, "$.candidate_contrib").alias("absent"))


# ------------------------------------------------------------- filters and orders


@C.add(f"""SELECT id, valid_to, valid_to IS NULL AS undated, abs(date_diff('day', DATE '{TODAY}', valid_from)) AS away FROM ownership WHERE (valid_to IS NULL OR valid_to <= DATE '{TODAY}' + INTERVAL 6 YEAR) AND (ownership_recorded_at IS NULL OR ownership_recorded_at >= DATE '{TODAY}' - INTERVAL 20 YEAR) ORDER BY away NULLS LAST, id LIMIT 100""")
def publish_horizon(spark: SparkSession, d: str) -> DataFrame:
    """The hundred rows nearest to today within the horizon; undated rows are kept by both date filters."""
    today = F.to_date(F.lit(TODAY))
    o = table(spark, d, "ownership").filter((F.col("valid_to").isNull() | (F.col("valid_to") <= F.add_months(today, 72))) & (F.col("ownership_recorded_at").isNull() | (F.col("ownership_recorded_at") >= F.add_months(today, -240))))
    return o.select("id", "valid_to", F.col("valid_to").isNull().alias("undated"), F.abs(F.datediff("valid_from", today)).cast("long").alias("away")).orderBy(F.asc_nulls_last("away"), "id").limit(100)


def optional_filters(df: DataFrame, **given: object) -> DataFrame:
    """Only parameters that are given filter."""
    for name, value in given.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


#: Orders a caller may ask for.
SORTS = {"amount": (F.desc_nulls_last, "amount"), "day": (F.desc_nulls_last, "day"), "name": (F.asc_nulls_last, "name")}


@C.add(f"""WITH {TX}, f AS (SELECT id, name, CAST(amount AS DOUBLE) AS amount, day, CASE kind WHEN 'Individual' THEN 1 WHEN 'Loan Proceeds' THEN 2 ELSE 3 END AS o FROM tx WHERE state = 'NC'),
s AS (SELECT *, row_number() OVER (ORDER BY o, amount DESC NULLS LAST, id) AS k FROM f) SELECT id, name, amount, CAST(k AS BIGINT) AS k, (SELECT count(*) FROM f) > 50 AS has_next FROM s WHERE k <= 50""")
def optional_filters_sorted_page(spark: SparkSession, d: str) -> DataFrame:
    """Optional filters, a CASE order, a closed set of sorts, and a page with the question whether there is another."""
    f = optional_filters(transactions(spark, d), state="NC", committee=None, kind=None)
    way, column = SORTS["amount"]
    order = [F.when(F.col("kind") == "Individual", 1).when(F.col("kind") == "Loan Proceeds", 2).otherwise(3), way(column), F.col("id")]
    page = f.orderBy(*order).limit(51)
    ranked = page.select("id", "name", F.col("amount").cast(X.MONEY).alias("amount"), F.row_number().over(W.orderBy(*order)).cast("long").alias("k"))  # a page of 51 rows
    return _page(ranked)


def _page(rows: DataFrame, size: int = 50) -> DataFrame:
    """One row more than the page tells whether another follows."""
    more = rows.agg((F.count("*") > size).alias("has_next"))
    return rows.filter(F.col("k") <= size).join(F.broadcast(more))


@C.add("SELECT id, created_at::DATE AS day FROM (SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) AS k FROM source_record) WHERE k <= 200")
def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the first rows by time and id."""
    return table(spark, d, "source_record").select("id", "created_at").orderBy(F.asc_nulls_last("created_at"), "id").limit(200).select("id", F.to_date("created_at").alias("day"))


@C.add("""WITH o AS (SELECT id, CASE WHEN registered_state IS NULL THEN [] ELSE [registered_state] END AS scopes, upper(canonical_name) AS n FROM organization), f AS (SELECT id, CASE WHEN mailing_address_state IS NULL THEN [] ELSE [mailing_address_state, coalesce(business_address_state, mailing_address_state)] END AS scopes, upper(name) AS n FROM political_organization_527)
SELECT o.id AS organization_id, f.id AS registration_id FROM o JOIN f USING (n) WHERE len(o.scopes) = 0 OR len(f.scopes) = 0 OR list_has_any(o.scopes, f.scopes)""")
def authority_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Like names whose scopes overlap; an empty scope permits all."""
    none = F.array().cast("array<string>")
    o = table(spark, d, "organization").select(F.col("id").alias("organization_id"), F.when(F.col("registered_state").isNull(), none).otherwise(F.array("registered_state")).alias("a"), F.upper("canonical_name").alias("n"))
    f = table(spark, d, "political_organization_527").select(F.col("id").alias("registration_id"), F.when(F.col("mailing_address_state").isNull(), none).otherwise(F.array("mailing_address_state", F.coalesce("business_address_state", "mailing_address_state"))).alias("b"), F.upper("name").alias("n"))
    return o.join(f, "n").filter((F.size("a") == 0) | (F.size("b") == 0) | F.arrays_overlap("a", "b")).select("organization_id", "registration_id")


@C.add("""WITH c AS (SELECT event_id, 'C6.' || (event_id % 6) || CASE event_id % 4 WHEN 0 THEN '5' WHEN 1 THEN ' late' WHEN 2 THEN '' ELSE '-A' END AS origin FROM events) SELECT CASE WHEN regexp_matches(origin, '(?i)^C6\\.2([^0-9A-Za-z.]|$)') THEN 'spent' WHEN regexp_matches(origin, '(?i)^C6\\.3([^0-9A-Za-z.]|$)') THEN 'promised' WHEN regexp_matches(origin, '(?i)^C6\\.5([^0-9A-Za-z.]|$)') THEN 'no_transaction' ELSE 'error' END AS class, count(*) AS n, min(event_id) AS first_id, count(*) FILTER (WHERE regexp_matches(origin, '^[12]')) AS guard_violations FROM c GROUP BY 1""")
def record_classes(spark: SparkSession, d: str) -> DataFrame:
    """Routing by a token that must end there: C6.25 is no C6.2; unknown classes are errors; other types must not look federal."""
    k = F.col("event_id")
    tail = F.when(k % 4 == 0, "5").when(k % 4 == 1, " late").when(k % 4 == 2, "").otherwise("-A")
    origin = F.concat(F.lit("C6."), (k % 6).cast("string"), tail)
    route = F.when(origin.rlike(r"(?i)^C6\.2(?![0-9A-Za-z.])"), "spent").when(origin.rlike(r"(?i)^C6\.3(?![0-9A-Za-z.])"), "promised").when(origin.rlike(r"(?i)^C6\.5(?![0-9A-Za-z.])"), "no_transaction").otherwise("error")
    return table(spark, d, "events").groupBy(route.alias("class")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.count(F.when(origin.rlike("^[12]"), 1)).alias("guard_violations"))


@C.add("""WITH u AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT event_type, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events WHERE user_id IN (SELECT user_id FROM u) GROUP BY 1""")
def semi_join_scope(spark: SparkSession, d: str) -> DataFrame:
    """Rows within the scope of a distinct set of keys."""
    e = table(spark, d, "events")
    return e.join(e.filter("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value") * 100).cast("long").alias("cents"))


@C.add("""WITH o AS (SELECT id, trim(lower(regexp_replace(canonical_name, '[^a-zA-Z0-9]+', '-', 'g')), '-') AS slug FROM organization WHERE canonical_name IS NOT NULL), f AS (SELECT id, trim(lower(regexp_replace(name, '[^a-zA-Z0-9]+', '-', 'g')), '-') AS slug FROM political_organization_527 WHERE name IS NOT NULL)
SELECT o.id AS organization_id, f.id AS registration_id, slug FROM o JOIN f USING (slug) WHERE slug <> ''""")
def slug_join(spark: SparkSession, d: str) -> DataFrame:
    """A join on a computed key."""
    o = table(spark, d, "organization").select(F.col("id").alias("organization_id"), X.slug(F.col("canonical_name")).alias("slug"))
    f = table(spark, d, "political_organization_527").select(F.col("id").alias("registration_id"), X.slug(F.col("name")).alias("slug"))
    return o.join(f, "slug").filter("slug != ''").select("organization_id", "registration_id", "slug")


@C.add(f"""WITH {TX} SELECT d.id AS donor_id, count(t.id) AS n, CAST(coalesce(sum(t.amount), 0) AS DOUBLE) AS total, max(t.day) AS last_day FROM donor_er_view d LEFT JOIN tx t ON upper(t.name) = d.canonical_name AND t.zip5 = d.zip5 GROUP BY 1""")
def donor_detail_probe(spark: SparkSession, d: str) -> DataFrame:
    """Details per donor by an ordinary join on the pre-aggregated key."""
    t = transactions(spark, d).groupBy(F.upper("name").alias("m"), F.col("zip5").alias("z")).agg(F.count("*").alias("n"), F.sum("amount").alias("a"), F.max("day").alias("last_day"))
    donors = table(spark, d, "donor_er_view").select(F.col("id").alias("donor_id"), "canonical_name", "zip5")
    j = donors.join(t, (F.col("m") == F.col("canonical_name")) & (F.col("z") == F.col("zip5")), "left")
    return j.groupBy("donor_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("a"), F.lit(0)).cast(X.MONEY).alias("total"), F.max("last_day").alias("last_day"))


# ------------------------------------------------------------- sources


@C.add("""SELECT n_nationkey, trim(n_name) AS n_name, n_regionkey FROM nation""")
def bulk_lines_read(spark: SparkSession, d: str) -> DataFrame:
    """Pipe-delimited lines with a trailing delimiter, padded values and lines of the wrong width, read back."""
    n = table(spark, d, "nation")
    good = n.select(F.concat(F.col("n_nationkey").cast("string"), F.lit("| "), "n_name", F.lit(" |"), F.col("n_regionkey").cast("string"), F.lit("|")).alias("value"))
    bad = n.select(F.concat(F.lit("x|"), "n_name").alias("value"))
    read, _ = delimited.parse_lines(good.unionByName(bad), delimited.Layout(("n_nationkey", "n_name", "n_regionkey"), trailing_delimiter=True))
    return read.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@C.add("""SELECT 'C' AS kind, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer UNION ALL SELECT 'S', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier UNION ALL SELECT 'rejected', count(*), 0 FROM nation""")
def multi_record_read(spark: SparkSession, d: str) -> DataFrame:
    """One file of several record types; what fits none comes out as rejected."""
    line = lambda kind, *cols: F.concat_ws("|", F.lit(kind), *[F.col(c).cast("string") for c in cols]).alias("value")
    lines = table(spark, d, "customer").select(line("C", "c_custkey", "c_name")).unionByName(table(spark, d, "supplier").select(line("S", "s_suppkey", "s_name"))).unionByName(table(spark, d, "nation").select(line("?", "n_nationkey")))
    layout = delimited.Layout(("kind", "key", "name"))
    types, rejected = delimited.parse_records(lines, {"C": layout, "S": layout})
    out = [t.agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("keys")) for k, t in types.items()]
    return out[0].unionByName(out[1]).unionByName(rejected.agg(F.lit("rejected").alias("kind"), F.count("*").alias("n"), F.lit(0).cast("long").alias("keys")))
