"""Write operators as set-wise merges: upserts, resolution of entities, temporal repair, absorption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions import finance as X
from tallybook.plans.stage import table
from tallybook.queries.registry import Catalogue
from tallybook.sources.exports import TX, transactions

C = Catalogue()


def _first(rows: DataFrame, w: W, *order: Column | str) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(w.orderBy(*order))).filter("k = 1").drop("k")


@C.add("""WITH inc AS (SELECT DISTINCT trim(concat_ws(', ', nullif(trim(street_line_1, ' '), ''), nullif(trim(city, ' '), ''), nullif(trim(state, ' '), '')), ' ') AS raw FROM real_transaction_export_adams), i AS (SELECT raw FROM inc WHERE raw <> ''),
a AS (SELECT raw_address AS raw, min(id) AS id FROM address WHERE raw_address IS NOT NULL GROUP BY 1) SELECT i.raw, a.id, CASE WHEN a.id IS NULL THEN 'inserted' ELSE 'selected' END AS action FROM i LEFT JOIN a USING (raw)""")
def address_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Insert or select on the raw line alone."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in ("street_line_1", "city", "state")]
    inc = table(spark, d, "real_transaction_export_adams").select(F.trim(F.concat_ws(", ", *parts)).alias("raw")).filter("raw != ''").distinct()
    known = table(spark, d, "address").filter("raw_address is not null").groupBy(F.col("raw_address").alias("raw")).agg(F.min("id").alias("id"))
    return inc.join(known, "raw", "left").select("raw", "id", F.when(F.col("id").isNull(), "inserted").otherwise("selected").alias("action"))


@C.add("""WITH k AS (SELECT o.id, e.key AS scheme, upper(trim(e.value, ' ')) AS v FROM (SELECT id, unnest(map_entries(identifiers)) AS e FROM organization) o), q AS (SELECT * FROM k WHERE v <> ''), m AS (SELECT scheme, v, count(DISTINCT id) AS n, min(id) AS id FROM q GROUP BY 1, 2)
SELECT scheme, v, n, CASE WHEN n = 1 THEN id END AS id, CASE WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM m""")
def find_by_identifier(spark: SparkSession, d: str) -> DataFrame:
    """An identifier finds its entity only if no other carries it."""
    k = table(spark, d, "organization").select("id", F.explode("identifiers").alias("scheme", "v")).withColumn("v", F.upper(F.trim("v"))).filter("v != ''")
    m = k.groupBy("scheme", "v").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    one = F.col("n") == 1
    return m.select("scheme", "v", "n", F.when(one, F.col("id")).alias("id"), F.when(one, "found").otherwise("ambiguous").alias("status"))


@C.add("""WITH p AS (SELECT id, canonical_name AS n, zip5 AS z FROM donor_er_view WHERE canonical_name IS NOT NULL), q AS (SELECT id AS owner_id, upper(trim(owner_name, ' ')) AS n, owner_mail_zip5 AS z FROM ownership WHERE owner_name IS NOT NULL)
SELECT q.owner_id, min(p.id) AS donor_id FROM q JOIN p ON p.n = q.n AND (q.z IS NULL OR p.z IS NULL OR p.z = q.z) GROUP BY 1""")
def find_by_name_and_zip(spark: SparkSession, d: str) -> DataFrame:
    """Name and ZIP, set-wise: a null ZIP fits any, the smallest id wins; smallest ids per name and ZIP come before the join."""
    p = table(spark, d, "donor_er_view").filter("canonical_name is not null").groupBy(F.col("canonical_name").alias("n"), F.col("zip5").alias("z")).agg(F.min("id").alias("donor_id"))
    q = table(spark, d, "ownership").filter("owner_name is not null").select(F.col("id").alias("owner_id"), F.upper(F.trim("owner_name")).alias("n"), F.col("owner_mail_zip5").alias("y"))
    return q.join(p, "n").filter("y is null or z is null or y = z").groupBy("owner_id").agg(F.min("donor_id").alias("donor_id"))


@C.add(f"""WITH {TX}, b AS (SELECT id, upper(name) AS n, coalesce(zip5, '') AS z, exported_on FROM tx WHERE name IS NOT NULL), r AS (SELECT *, first_value(id) OVER (PARTITION BY n, z ORDER BY exported_on, id) AS maker FROM b)
SELECT maker, count(*) AS uses, count(*) - 1 AS reused, max(exported_on) AS last_used FROM r GROUP BY 1""")
def resolve_within_batch(spark: SparkSession, d: str) -> DataFrame:
    """The first row of a key creates the person, later rows reuse it."""
    b = transactions(spark, d).filter("name is not null").groupBy(F.upper("name").alias("n"), F.coalesce("zip5", F.lit("")).alias("z")).agg(F.min(F.struct("exported_on", "id"))["id"].alias("maker"), F.count("*").alias("uses"), F.max("exported_on").alias("last_used"))
    return b.select("maker", "uses", (F.col("uses") - 1).alias("reused"), "last_used")


@C.add(f"""WITH {TX}, inc AS (SELECT DISTINCT committee, upper(name) AS entity, series, kind FROM tx WHERE committee IS NOT NULL AND name IS NOT NULL), old AS (SELECT DISTINCT committee, upper(name) AS entity, series, kind FROM tx WHERE committee IS NOT NULL AND name IS NOT NULL AND left(md5(id), 1) < '8')
SELECT committee, count(*) AS linked FROM (SELECT * FROM inc EXCEPT SELECT * FROM old) GROUP BY 1""")
def entity_source_links(spark: SparkSession, d: str) -> DataFrame:
    """Links not stored yet, by their four-column key; null parts of a key are equal."""
    t = transactions(spark, d).filter("committee is not null and name is not null").select("committee", F.upper("name").alias("entity"), "series", "kind", "id")
    key = ["committee", "entity", "series", "kind"]
    # one pass: a key is stored if any of its rows is
    stored = t.groupBy(*key).agg(F.max(F.left(F.md5("id"), F.lit(1)) < "8").alias("stored"))
    return stored.filter("not stored").groupBy("committee").agg(F.count("*").alias("linked"))


@C.add("""WITH p AS (SELECT id, contact_person_name AS who, email_address AS email, created_at, form_type AS role FROM political_organization_527 WHERE email_address IS NOT NULL UNION ALL SELECT id, custodian_name, email_address, created_at, NULL FROM political_organization_527 WHERE email_address IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(email), role ORDER BY created_at DESC NULLS LAST, id, who NULLS LAST) AS k FROM p) SELECT lower(email) AS email, role, id, who FROM r WHERE k = 1""")
def contact_points(spark: SparkSession, d: str) -> DataFrame:
    """One contact point per address and role; no role is a key of its own."""
    f = table(spark, d, "political_organization_527").filter("email_address is not null")
    p = f.select("id", F.col("contact_person_name").alias("who"), F.lower("email_address").alias("email"), "created_at", F.col("form_type").alias("role")).unionByName(f.select("id", F.col("custodian_name").alias("who"), F.lower("email_address").alias("email"), "created_at", F.lit(None).cast("string").alias("role")))
    return _first(p, W.partitionBy("email", "role"), F.desc_nulls_last("created_at"), "id", F.asc_nulls_last("who")).select("email", "role", "id", "who")


_REGIME = "CASE WHEN regexp_matches(coalesce(report, ''), 'Year End') THEN 'sub:' || id WHEN report IS NOT NULL THEN 'filing:' || committee || ':' || report || ':' || coalesce(upper(name), '') ELSE 'native:' || committee || ':' || coalesce(upper(name), '') || ':' || coalesce(CAST(day AS VARCHAR), '') END"


@C.add(f"""WITH {TX}, v AS (SELECT {_REGIME} AS key, id, amount, purpose, employer, exported_on, CASE WHEN report LIKE '%Year End%' THEN 3 WHEN report LIKE '%Mid Year%' THEN 2 ELSE 1 END AS level FROM tx WHERE committee IS NOT NULL)
SELECT key, CAST(arg_max(amount, (exported_on, id)) FILTER (WHERE amount IS NOT NULL) AS DOUBLE) AS amount, arg_max(employer, (exported_on, id)) FILTER (WHERE employer IS NOT NULL) AS employer, arg_max(coalesce(purpose, chr(1)), (exported_on, id)) AS purpose_raw, max(level) AS level, CASE WHEN count(*) = 1 THEN 'inserted' WHEN count(DISTINCT (amount, purpose, employer)) = 1 THEN 'skipped' ELSE 'updated' END AS status FROM v GROUP BY key""")
def transaction_merge(spark: SparkSession, d: str) -> DataFrame:
    """Three identities; amount and employer keep old values against null, the purpose is overwritten, the amendment only rises."""
    committee, who, report = F.col("committee"), F.coalesce(F.upper("name"), F.lit("")), F.coalesce("report", F.lit(""))
    key = F.when(report.contains("Year End"), F.concat(F.lit("sub:"), "id")).when(F.col("report").isNotNull(), F.concat(F.lit("filing:"), committee, F.lit(":"), "report", F.lit(":"), who)).otherwise(F.concat(F.lit("native:"), committee, F.lit(":"), who, F.lit(":"), F.coalesce(F.col("day").cast("string"), F.lit(""))))
    level = F.when(report.contains("Year End"), 3).when(report.contains("Mid Year"), 2).otherwise(1)
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("exported_on", "id", c)))[c]
    v = transactions(spark, d).filter("committee is not null").select(key.alias("key"), "id", "amount", "purpose", "employer", "exported_on", level.alias("level"))
    g = v.groupBy("key").agg(newest("amount").cast(X.MONEY).alias("amount"), newest("employer").alias("employer"), F.max(F.struct("exported_on", "id", F.coalesce("purpose", F.lit("\x01")).alias("p")))["p"].alias("purpose_raw"), F.max("level").alias("level"), F.count("*").alias("n"), F.count_distinct(F.struct("amount", "purpose", "employer")).alias("kinds"))
    return g.select("key", "amount", "employer", "purpose_raw", "level", F.when(F.col("n") == 1, "inserted").when(F.col("kinds") == 1, "skipped").otherwise("updated").alias("status"))


@C.add(f"""WITH {TX}, c AS (SELECT t.id, count(DISTINCT d.id) AS people, count(DISTINCT o.id) AS orgs, min(d.id) AS person, min(o.id) AS org FROM tx t LEFT JOIN donor_er_view d ON d.canonical_name = upper(t.name) AND d.zip5 = t.zip5 LEFT JOIN organization o ON upper(o.canonical_name) = upper(t.name) GROUP BY 1)
SELECT id, CASE WHEN people = 1 AND orgs = 0 THEN person END AS person_id, CASE WHEN orgs = 1 AND people = 0 THEN org END AS organization_id, CASE WHEN people > 0 AND orgs > 0 THEN 'dual_match' WHEN people + orgs = 0 THEN 'unresolved' WHEN people + orgs = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM c""")
def counterparty_ids(spark: SparkSession, d: str) -> DataFrame:
    """One person xor one organisation; counts per key come before the joins, so no row multiplies."""
    t = transactions(spark, d).select("id", F.upper("name").alias("n"), "zip5")
    p = table(spark, d, "donor_er_view").groupBy(F.col("canonical_name").alias("n"), "zip5").agg(F.count_distinct("id").alias("people"), F.min("id").alias("person"))
    o = table(spark, d, "organization").groupBy(F.upper("canonical_name").alias("n")).agg(F.count_distinct("id").alias("orgs"), F.min("id").alias("org"))
    j = t.join(p, ["n", "zip5"], "left").join(o, "n", "left").na.fill(0, ["people", "orgs"])
    a, b = F.col("people"), F.col("orgs")
    status = F.when((a > 0) & (b > 0), "dual_match").when(a + b == 0, "unresolved").when(a + b == 1, "matched").otherwise("ambiguous")
    return j.select("id", F.when((a == 1) & (b == 0), F.col("person")).alias("person_id"), F.when((b == 1) & (a == 0), F.col("org")).alias("organization_id"), status.alias("status"))


@C.add("""WITH r AS (SELECT lower(trim(name, ' ')) AS n, coalesce(upper(mailing_address_state), '') AS s, coalesce(CAST(established_date AS VARCHAR), '') AS e, id, insert_datetime, amended_report_indicator AS amended, row_number() OVER (PARTITION BY lower(trim(name, ' ')), coalesce(upper(mailing_address_state), ''), coalesce(CAST(established_date AS VARCHAR), '') ORDER BY created_at DESC NULLS LAST, id) AS k, count(*) OVER (PARTITION BY lower(trim(name, ' ')), coalesce(upper(mailing_address_state), ''), coalesce(CAST(established_date AS VARCHAR), '')) AS c FROM political_organization_527 WHERE name IS NOT NULL)
SELECT n AS name, s AS state, e AS established, id, amended, c - 1 AS replaced FROM r WHERE k = 1""")
def natural_key_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A natural key with nulls made part of it; the latest row stays."""
    blank = F.lit("")
    f = table(spark, d, "political_organization_527").filter("name is not null").select("id", "created_at", F.col("amended_report_indicator").alias("amended"), F.lower(F.trim("name")).alias("name"), F.coalesce(F.upper("mailing_address_state"), blank).alias("state"), F.coalesce(F.col("established_date").cast("string"), blank).alias("established"))
    w = W.partitionBy("name", "state", "established")
    return _first(f.withColumn("replaced", F.count("*").over(w) - 1), w, F.desc_nulls_last("created_at"), "id").select("name", "state", "established", "id", "amended", "replaced")


@C.add("""WITH o AS (SELECT parcel_id, id, valid_from, valid_to, lead(valid_from) OVER (PARTITION BY parcel_id ORDER BY valid_from, id) AS nxt FROM ownership WHERE parcel_id IS NOT NULL AND valid_from IS NOT NULL)
SELECT parcel_id, id, valid_from, CASE WHEN nxt IS NOT NULL AND (valid_to IS NULL OR valid_to > nxt) THEN nxt ELSE valid_to END AS valid_to, nxt IS NOT NULL AND (valid_to IS NULL OR valid_to > nxt) AS closed FROM o""")
def holding_repair(spark: SparkSession, d: str) -> DataFrame:
    """A holding that is open, or runs on, ends where the next one of the seat begins."""
    o = table(spark, d, "ownership").filter("parcel_id is not null and valid_from is not null")
    nxt = F.lead("valid_from").over(W.partitionBy("parcel_id").orderBy("valid_from", "id"))
    o = o.select("parcel_id", "id", "valid_from", "valid_to", nxt.alias("nxt"))
    late = F.col("nxt").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("nxt")))
    return o.select("parcel_id", "id", "valid_from", F.when(late, F.col("nxt")).otherwise(F.col("valid_to")).alias("valid_to"), F.coalesce(late, F.lit(False)).alias("closed"))


@C.add("""SELECT upper(owner_mail_city) AS town, row_number() OVER w AS part, id, CAST(sum(length(owner_name)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(owner_name) AS BIGINT) AS starts_at FROM ownership WHERE owner_mail_city IS NOT NULL AND owner_name IS NOT NULL WINDOW w AS (PARTITION BY upper(owner_mail_city) ORDER BY id)""")
def multipolygon_merge(spark: SparkSession, d: str) -> DataFrame:
    """Features of one name become parts of one shape: their order and the offset where each part's points start.

    The parts stay rows, so that a name with very many features is no value of its own.
    """
    points = F.length("owner_name")
    w = W.partitionBy("town").orderBy("id")
    o = table(spark, d, "ownership").filter("owner_mail_city is not null and owner_name is not null").select(F.upper("owner_mail_city").alias("town"), "id", points.alias("points"))
    return o.select("town", F.row_number().over(w).cast("long").alias("part"), "id", (F.sum("points").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("points")).alias("starts_at"))


@C.add("""SELECT parcel_id, min(valid_from) AS first_seen, count(*) AS versions, count(DISTINCT owner_name) AS owners, arg_max(owner_name, (coalesce(valid_from, DATE '0001-01-01'), id)) FILTER (WHERE owner_name IS NOT NULL) AS owner, bool_or(valid_to IS NULL) AS has_open FROM ownership WHERE parcel_id IS NOT NULL GROUP BY 1""")
def property_load(spark: SparkSession, d: str) -> DataFrame:
    """Parcels from their ownership rows."""
    owner = F.max(F.when(F.col("owner_name").isNotNull(), F.struct(F.coalesce("valid_from", F.to_date(F.lit("0001-01-01"))).alias("f"), "id", "owner_name")))["owner_name"]
    return table(spark, d, "ownership").filter("parcel_id is not null").groupBy("parcel_id").agg(F.min("valid_from").alias("first_seen"), F.count("*").alias("versions"), F.count_distinct("owner_name").alias("owners"), owner.alias("owner"), F.bool_or(F.col("valid_to").isNull()).alias("has_open"))


# ------------------------------------------------------------- entities merged


_PEOPLE = "x AS (SELECT DISTINCT lower(trim(absorbed_person_id)) AS a, lower(trim(canonical_person_id)) AS c FROM person_absorption WHERE trim(absorbed_person_id) <> '' AND trim(canonical_person_id) <> '' AND lower(trim(absorbed_person_id)) <> lower(trim(canonical_person_id)))"


def _absorbed(spark: SparkSession, d: str) -> DataFrame:
    """(a, c): absorbed and canonical ids, clean and once."""
    a, c = F.lower(F.trim("absorbed_person_id")), F.lower(F.trim("canonical_person_id"))
    return table(spark, d, "person_absorption").select(a.alias("a"), c.alias("c")).filter("a != '' and c != '' and a != c").distinct()


_FILLED = "(CASE WHEN canonical_name IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN occupation IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN date_of_birth IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN education IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN middle_name IS NOT NULL THEN 1 ELSE 0 END)"


@C.add(f"""WITH p AS (SELECT er_cluster_id AS cluster, id, {_FILLED} AS filled FROM person WHERE er_cluster_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY filled DESC, id) AS k, count(*) OVER (PARTITION BY cluster) AS members FROM p) SELECT cluster, id AS canonical_id, CAST(filled AS BIGINT) AS filled, members FROM r WHERE k = 1""")
def canonical_pick(spark: SparkSession, d: str) -> DataFrame:
    """The member with the most fields filled, then the smallest id."""
    filled = sum((F.col(c).isNotNull().cast("long") for c in ("canonical_name", "occupation", "date_of_birth", "education", "middle_name")), F.lit(0).cast("long"))
    p = table(spark, d, "person").filter("er_cluster_id is not null").select(F.col("er_cluster_id").alias("cluster"), "id", filled.alias("filled"))
    best = p.groupBy("cluster").agg(F.min(F.struct((-F.col("filled")).alias("f"), "id")).alias("b"), F.count("*").alias("members"))
    return best.select("cluster", F.col("b.id").alias("canonical_id"), (-F.col("b.f")).alias("filled"), "members")


@C.add("""WITH p AS (SELECT er_cluster_id AS cluster, count(*) AS members, min(er_confidence) AS weakest, max(er_confidence) AS strongest FROM person WHERE er_cluster_id IS NOT NULL GROUP BY 1) SELECT cluster, members, weakest, strongest, CASE WHEN weakest >= 0.95 THEN 'auto_merge' WHEN weakest IS NULL THEN 'unscored' ELSE 'review' END AS route FROM p""")
def review_split(spark: SparkSession, d: str) -> DataFrame:
    """A cluster merges by itself only if its weakest decision is a sure one."""
    p = table(spark, d, "person").filter("er_cluster_id is not null").groupBy(F.col("er_cluster_id").alias("cluster")).agg(F.count("*").alias("members"), F.min("er_confidence").alias("weakest"), F.max("er_confidence").alias("strongest"))
    return p.select("*", F.when(F.col("weakest") >= 0.95, "auto_merge").when(F.col("weakest").isNull(), "unscored").otherwise("review").alias("route"))


@C.add("""WITH d AS (SELECT lower(trim(absorbed_person_id)) AS a, lower(trim(canonical_person_id)) AS c, merged_by, absorbed_at, cluster_id FROM person_absorption WHERE absorbed_person_id IS NOT NULL AND canonical_person_id IS NOT NULL),
p AS (SELECT least(a, c) AS l, greatest(a, c) AS r, merged_by, absorbed_at, cluster_id FROM d), q AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY absorbed_at NULLS FIRST, merged_by NULLS FIRST, cluster_id NULLS FIRST) AS version, count(*) OVER (PARTITION BY l, r) AS versions FROM p) SELECT l, r, version, versions, version = versions AS is_latest, merged_by FROM q""")
def decisions_superseded(spark: SparkSession, d: str) -> DataFrame:
    """Every decision on a pair stays; the latest supersedes the ones before."""
    a, c = F.lower(F.trim("absorbed_person_id")), F.lower(F.trim("canonical_person_id"))
    p = table(spark, d, "person_absorption").filter("absorbed_person_id is not null and canonical_person_id is not null").select(F.least(a, c).alias("l"), F.greatest(a, c).alias("r"), "merged_by", "absorbed_at", "cluster_id")
    w = W.partitionBy("l", "r")
    q = p.select("l", "r", "merged_by", F.row_number().over(w.orderBy(F.asc_nulls_first("absorbed_at"), F.asc_nulls_first("merged_by"), F.asc_nulls_first("cluster_id"))).cast("long").alias("version"), F.count("*").over(w).alias("versions"))
    return q.select("l", "r", "version", "versions", (F.col("version") == F.col("versions")).alias("is_latest"), "merged_by")


@C.add("""WITH g AS (SELECT cluster_id, max(CAST(absorbed_at AS DATE)) AS generation, count(DISTINCT lower(absorbed_person_id)) AS members FROM person_absorption WHERE cluster_id IS NOT NULL GROUP BY 1), latest AS (SELECT max(generation) AS top FROM g)
SELECT cluster_id, generation, members, CASE WHEN generation < top - INTERVAL 365 DAY THEN CAST(top AS DATE) END AS split_at FROM g, latest""")
def cluster_generations(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of an older generation are retired on the day of the newest."""
    g = table(spark, d, "person_absorption").filter("cluster_id is not null").groupBy("cluster_id").agg(F.max(F.to_date("absorbed_at")).alias("generation"), F.count_distinct(F.lower("absorbed_person_id")).alias("members"))
    j = g.join(F.broadcast(g.agg(F.max("generation").alias("top"))))  # one row
    return j.select("cluster_id", "generation", "members", F.when(F.col("generation") < F.date_sub("top", 365), F.col("top")).alias("split_at"))


@C.add(f"""WITH {_PEOPLE}, prior AS (SELECT x.c AS cluster, min(p.id) AS prior_id, min(lower(p.id)) FILTER (WHERE lower(p.id) = x.c) AS own FROM x JOIN person p ON lower(p.id) = x.a OR lower(p.id) = x.c GROUP BY 1), pick AS (SELECT x.c AS cluster, coalesce(p.own, p.prior_id) AS chosen FROM (SELECT DISTINCT c FROM x) x LEFT JOIN prior p ON p.cluster = x.c),
r AS (SELECT *, row_number() OVER (PARTITION BY chosen ORDER BY CASE WHEN cluster = chosen THEN 0 ELSE 1 END, cluster) AS k FROM pick) SELECT cluster, CASE WHEN k = 1 THEN chosen END AS person_id, CASE WHEN chosen IS NULL OR k > 1 THEN 'new' WHEN chosen = cluster THEN 'canonical_prior' ELSE 'smallest_prior' END AS origin FROM r""")
def cluster_promotion(spark: SparkSession, d: str) -> DataFrame:
    """The person a cluster lives on as: its canonical member's, else its smallest prior one not claimed by another cluster, else a new one."""
    x, people = _absorbed(spark, d), table(spark, d, "person").filter("id is not null").select(F.lower("id").alias("pid"))
    ends = x.select("c", F.col("a").alias("pid")).unionByName(x.select("c", F.col("c").alias("pid"))).distinct()
    prior = ends.join(people, "pid", "left_semi").groupBy("c").agg(F.min("pid").alias("prior_id"), F.min(F.when(F.col("pid") == F.col("c"), F.col("pid"))).alias("own"))
    pick = x.select("c").distinct().join(prior, "c", "left").select(F.col("c").alias("cluster"), F.coalesce("own", "prior_id").alias("chosen"))
    known = pick.filter("chosen is not null")
    first = known.withColumn("k", F.row_number().over(W.partitionBy("chosen").orderBy((F.col("cluster") != F.col("chosen")).cast("int"), "cluster")))
    won = F.when(F.col("k") == 1, F.col("chosen"))
    named = first.select("cluster", won.alias("person_id"), F.when(F.col("k") > 1, "new").when(F.col("chosen") == F.col("cluster"), "canonical_prior").otherwise("smallest_prior").alias("origin"))
    return named.unionByName(pick.filter("chosen is null").select("cluster", F.lit(None).cast("string").alias("person_id"), F.lit("new").alias("origin")))


@C.add("""SELECT data_source_id, feed_kind AS role, min(id) AS owner_id, count(*) AS owners, CAST(sum(CAST('0x' || left(md5(id), 8) AS BIGINT)) AS BIGINT) AS owners_print FROM source_record WHERE record_hash IS NOT NULL GROUP BY data_source_id, feed_kind, record_hash HAVING count(*) > 1""")
def provenance_relink(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one source, role and content keep one link, the smallest id; a print of the owners, whatever their order, tells whether an unwinding is complete."""
    g = table(spark, d, "source_record").filter("record_hash is not null").groupBy("data_source_id", F.col("feed_kind").alias("role"), "record_hash").agg(F.min("id").alias("owner_id"), F.count("*").alias("owners"), F.sum(F.conv(F.left(F.md5("id"), F.lit(8)), 16, 10).cast("long")).alias("owners_print"))
    return g.filter("owners > 1").select("data_source_id", "role", "owner_id", "owners", "owners_print")


@C.add(f"""WITH {_PEOPLE}, once AS (SELECT a, min(c) AS c FROM x GROUP BY 1), remap AS (SELECT o.a, coalesce(n.c, o.c) AS c FROM once o LEFT JOIN once n ON n.a = o.c),
refs AS (SELECT lower(id) AS person, 'person' AS tab FROM person UNION ALL SELECT lower(absorbed_person_id), 'absorption' FROM person_absorption WHERE absorbed_person_id IS NOT NULL) SELECT tab, count(*) AS refs, count(m.c) AS repointed, count(DISTINCT coalesce(m.c, r.person)) AS people FROM refs r LEFT JOIN remap m ON m.a = r.person GROUP BY tab""")
def absorption_repoint(spark: SparkSession, d: str) -> DataFrame:
    """References to absorbed persons point to the survivor, chains of two followed."""
    once = _absorbed(spark, d).groupBy("a").agg(F.min("c").alias("c"))
    after = once.select(F.col("a").alias("c"), F.col("c").alias("cc"))
    remap = once.join(after, "c", "left").select("a", F.coalesce("cc", "c").alias("to"))
    refs = table(spark, d, "person").select(F.lower("id").alias("person"), F.lit("person").alias("tab")).unionByName(table(spark, d, "person_absorption").filter("absorbed_person_id is not null").select(F.lower("absorbed_person_id").alias("person"), F.lit("absorption").alias("tab")))
    return refs.join(remap, refs["person"] == remap["a"], "left").groupBy("tab").agg(F.count("*").alias("refs"), F.count("to").alias("repointed"), F.count_distinct(F.coalesce("to", "person")).alias("people"))


@C.add(f"""WITH {_PEOPLE}, j AS (SELECT x.a, x.c, p.id AS pa, q.id AS pc, p.date_of_birth AS da, q.date_of_birth AS dc, lower(p.suffix) AS sa, lower(q.suffix) AS sc FROM x LEFT JOIN person p ON lower(p.id) = x.a LEFT JOIN person q ON lower(q.id) = x.c),
b AS (SELECT a, c, unnest(list_filter([CASE WHEN pc IS NULL THEN 'unknown_member' END, CASE WHEN da <> dc AND da <> DATE '1900-01-01' AND dc <> DATE '1900-01-01' THEN 'two_birth_dates' END, CASE WHEN sa <> sc THEN 'two_suffixes' END], lambda v: v IS NOT NULL)) AS reason FROM j) SELECT a, c, reason FROM b""")
def absorption_preflight(spark: SparkSession, d: str) -> DataFrame:
    """Why a merge is blocked: unknown survivor, contradicting birth dates or suffixes."""
    p = table(spark, d, "person").filter("id is not null").select(F.lower("id").alias("id"), "date_of_birth", F.lower("suffix").alias("s"))
    x = _absorbed(spark, d)
    pa, pc = (p.select(F.col("id").alias(k), F.col("date_of_birth").alias(f"d{k}"), F.col("s").alias(f"s{k}"), F.lit(True).alias(f"k{k}")) for k in ("a", "c"))
    j = x.join(pa, "a", "left").join(pc, "c", "left")
    default = F.to_date(F.lit("1900-01-01"))
    reasons = F.array_compact(F.array(F.when(F.col("kc").isNull(), "unknown_member"), F.when((F.col("da") != F.col("dc")) & (F.col("da") != default) & (F.col("dc") != default), "two_birth_dates"), F.when(F.col("sa") != F.col("sc"), "two_suffixes")))
    return j.select("a", "c", F.explode(reasons).alias("reason"))


@C.add(f"""WITH {_PEOPLE}, once AS (SELECT a, min(c) AS c FROM x GROUP BY 1) SELECT lower(q.id) AS target, lower(p.id) AS source, coalesce(q.canonical_name, p.canonical_name) AS canonical_name, coalesce(q.occupation, p.occupation) AS occupation, coalesce(q.education, p.education) AS education, coalesce(q.date_of_birth, p.date_of_birth) AS date_of_birth, greatest(q.updated_at, p.updated_at)::DATE AS updated FROM once o JOIN person p ON lower(p.id) = o.a JOIN person q ON lower(q.id) = o.c""")
def row_merge(spark: SparkSession, d: str) -> DataFrame:
    """Column by column the target's value wins unless it is null; the source row goes."""
    p = table(spark, d, "person").withColumn("id", F.lower("id"))
    once = _absorbed(spark, d).groupBy("a").agg(F.min("c").alias("c"))
    j = once.join(p.alias("p"), F.col("a") == F.col("p.id")).join(p.alias("q"), F.col("c") == F.col("q.id"))
    return j.select(F.col("q.id").alias("target"), F.col("p.id").alias("source"), *[F.coalesce(f"q.{c}", f"p.{c}").alias(c) for c in ("canonical_name", "occupation", "education", "date_of_birth")], F.to_date(F.greatest("q.updated_at", "p.updated_at")).alias("updated"))


@C.add(f"""WITH {TX}, c AS (SELECT upper(name) AS n, zip5, count(*) AS rows_, count(DISTINCT committee) AS committees FROM tx WHERE name IS NOT NULL GROUP BY 1, 2), m AS (SELECT c.*, count(d.id) AS hits FROM c LEFT JOIN donor_er_view d ON d.canonical_name = c.n AND d.zip5 IS NOT DISTINCT FROM c.zip5 GROUP BY ALL)
SELECT CASE WHEN n IS NULL OR regexp_matches(n, '[0-9]') THEN 'invalid' WHEN hits = 0 THEN 'unresolved' WHEN hits = 1 THEN 'matched' ELSE 'ambiguous' END AS status, count(*) AS identities, CAST(sum(rows_) AS BIGINT) AS rows_, max(committees) AS most_committees FROM m GROUP BY 1""")
def donor_write_back(spark: SparkSession, d: str) -> DataFrame:
    """Donor identities written back to transactions, counted by outcome."""
    c = transactions(spark, d).filter("name is not null").groupBy(F.upper("name").alias("n"), "zip5").agg(F.count("*").alias("rows_"), F.count_distinct("committee").alias("committees"))
    hits = table(spark, d, "donor_er_view").groupBy(F.col("canonical_name").alias("m"), F.col("zip5").alias("z")).agg(F.count("*").alias("hits"))
    j = c.join(hits, (F.col("n") == F.col("m")) & F.col("zip5").eqNullSafe(F.col("z")), "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    status = F.when(F.col("n").rlike("[0-9]"), "invalid").when(F.col("hits") == 0, "unresolved").when(F.col("hits") == 1, "matched").otherwise("ambiguous")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("identities"), F.sum("rows_").alias("rows_"), F.max("committees").alias("most_committees"))


@C.add("SELECT id, replace(text, chr(0), '') AS clean, coalesce(len(text) - len(replace(text, chr(0), '')), 0) AS stripped FROM (SELECT doc_id AS id, text FROM documents)")
def nul_stripped(spark: SparkSession, d: str) -> DataFrame:
    """NUL characters taken out of whole texts."""
    clean = F.replace("text", F.lit("\x00"), F.lit(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), clean.alias("clean"), F.coalesce((F.length("text") - F.length(clean)).cast("long"), F.lit(0)).alias("stripped"))
