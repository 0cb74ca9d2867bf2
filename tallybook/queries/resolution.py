"""Entity resolution, graph, search and quality queries."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions import finance as X
from tallybook.functions import normalize as N
from tallybook.plans.stage import table
from tallybook.queries.registry import Catalogue
from tallybook.queries.texts import TODAY
from tallybook.sources.exports import TX, transactions

C = Catalogue()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)


# ------------------------------------------------------------- extraction and rules


@C.add(f"""WITH {TX} SELECT name, employer, occupation, city, state, zip5, count(*) AS n, md5(concat_ws(chr(31), coalesce('V' || name, 'N'), coalesce('V' || employer, 'N'), coalesce('V' || occupation, 'N'), coalesce('V' || city, 'N'), coalesce('V' || state, 'N'), coalesce('V' || zip5, 'N'))) AS identity FROM tx WHERE name IS NOT NULL GROUP BY ALL""")
def donor_identities(spark: SparkSession, d: str) -> DataFrame:
    """Identities of six raw fields with a key that tells null from any text."""
    six = ["name", "employer", "occupation", "city", "state", "zip5"]
    return transactions(spark, d).filter("name is not null").groupBy(*six).agg(F.count("*").alias("n")).withColumn("identity", X.donor_key(*[F.col(c) for c in six]))


#: Namespace of the donors' identifiers (any fixed UUID).
_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@C.add(f"""WITH {TX}, n AS (SELECT concat_ws(chr(31), upper(name), coalesce(zip5, ''), coalesce(upper(employer), '')) AS k, count(*) AS n FROM tx WHERE name IS NOT NULL GROUP BY 1), h AS (SELECT n, sha1(from_hex('{_NAMESPACE.replace("-", "")}') || encode(k)) AS h FROM n)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS donor_id, n FROM h""")
def donor_uuids(spark: SparkSession, d: str) -> DataFrame:
    """Donors under name-based UUIDs of their normalised fields."""
    key = F.concat_ws("\x1f", F.upper("name"), F.coalesce("zip5", F.lit("")), F.coalesce(F.upper("employer"), F.lit("")))
    return transactions(spark, d).filter("name is not null").groupBy(key.alias("k")).agg(F.count("*").alias("n")).select(N.uuid5(_NAMESPACE, F.col("k")).alias("donor_id"), "n")


@C.add("""WITH p AS (SELECT id, name_variants FROM person), v AS (SELECT id, unnest(list_distinct(name_variants)) AS variant FROM p), w AS (SELECT *, count(*) OVER (PARTITION BY id) AS c, row_number() OVER (PARTITION BY id ORDER BY variant) AS k FROM v WHERE variant IS NOT NULL) SELECT CASE WHEN c > 1 THEN id || '__splink_row__' || k ELSE id END AS row_id, id, variant FROM w""")
def er_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per spelling; entities of several rows get row ids of their own."""
    v = table(spark, d, "person").select("id", F.explode(F.array_distinct("name_variants")).alias("variant")).filter("variant is not null")
    w = W.partitionBy("id")
    v = v.select("*", F.count("*").over(w).alias("c"), F.row_number().over(w.orderBy("variant")).alias("k"))
    return v.select(F.when(F.col("c") > 1, F.concat("id", F.lit("__splink_row__"), F.col("k").cast("string"))).otherwise(F.col("id")).alias("row_id"), "id", "variant")


_IDS = "i AS (SELECT id, upper(e.key) AS scheme, regexp_replace(upper(e.value), '[^0-9A-Z]', '', 'g') AS v FROM (SELECT id, unnest(map_entries(identifiers)) AS e FROM organization)), k AS (SELECT DISTINCT * FROM i WHERE v <> '')"


def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    """(id, scheme, v): clean identifiers of organisations."""
    return table(spark, d, "organization").select("id", F.explode("identifiers").alias("s", "x")).select("id", F.upper("s").alias("scheme"), F.regexp_replace(F.upper("x"), "[^0-9A-Z]", "").alias("v")).filter("v != ''").distinct()


@C.add(f"""WITH {_IDS}, g AS (SELECT scheme, v, min(id) AS hub, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) > 1), m AS (SELECT g.hub AS l, k.id AS r, k.scheme FROM k JOIN g ON g.scheme = k.scheme AND g.v = k.v WHERE k.id <> g.hub)
SELECT l, r, CASE WHEN count(DISTINCT scheme) > 1 THEN 'deterministic_multi_rule' ELSE 'same_' || lower(min(scheme)) END AS method, 1.0::DOUBLE AS confidence FROM m GROUP BY 1, 2""")
def deterministic_matches(spark: SparkSession, d: str) -> DataFrame:
    """Equal identifiers link each carrier to the smallest id: as connected as all pairs, and linear."""
    k = _identifiers(spark, d)
    g = k.groupBy("scheme", "v").agg(F.min("id").alias("l"), F.count("*").alias("n")).filter("n > 1")
    m = k.join(g, ["scheme", "v"]).filter("id != l").groupBy("l", F.col("id").alias("r")).agg(F.count_distinct("scheme").alias("rules"), F.min("scheme").alias("one"))
    return m.select("l", "r", F.when(F.col("rules") > 1, "deterministic_multi_rule").otherwise(F.concat(F.lit("same_"), F.lower("one"))).alias("method"), F.lit(1.0).alias("confidence"))


@C.add(f"""WITH {_IDS}, g AS (SELECT scheme, v FROM k GROUP BY 1, 2 HAVING count(*) > 1) SELECT id, canonical_name FROM organization WHERE id NOT IN (SELECT k.id FROM k JOIN g USING (scheme, v))""")
def probabilistic_pool(spark: SparkSession, d: str) -> DataFrame:
    """What no deterministic rule matched."""
    k = _identifiers(spark, d)
    shared = k.groupBy("scheme", "v").agg(F.count("*").alias("n")).filter("n > 1")
    return table(spark, d, "organization").select("id", "canonical_name").join(k.join(shared, ["scheme", "v"], "left_semi").select("id").distinct(), "id", "left_anti")


_ORG_KEYS = "b AS (SELECT id, registered_state AS st, upper(left(canonical_name, 5)) AS name5, upper(split_part(canonical_name, ' ', 1)) AS word, CAST(year(formation_date) AS VARCHAR) AS y, org_type FROM organization WHERE canonical_name IS NOT NULL), r AS (SELECT id, 'name5_state' AS rule, name5 || '|' || st AS key FROM b UNION ALL SELECT id, 'word_year', word || '|' || y FROM b UNION ALL SELECT id, 'name5_type', name5 || '|' || org_type FROM b)"


@C.add(f"""WITH {_ORG_KEYS}, s AS (SELECT rule, key, count(*) AS n FROM r WHERE key IS NOT NULL GROUP BY 1, 2), p AS (SELECT x.rule, x.id AS l, y.id AS r FROM r x JOIN r y ON x.rule = y.rule AND x.key = y.key AND x.id < y.id), f AS (SELECT l, r, min(rule) AS first_rule, count(*) AS fired FROM p GROUP BY 1, 2)
SELECT s.rule, count(*) AS blocks, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs, max(n) AS largest, (SELECT count(*) FROM f WHERE f.first_rule = s.rule) AS first_here, (SELECT count(*) FROM f WHERE f.first_rule = s.rule AND fired = 1) AS only_here FROM s GROUP BY s.rule""")
def organisation_blocking(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each rule, the pairs it adds to the rules before it, and those it makes alone.

    No pair is made: how many pairs agree on a set of rules follows from the sizes of the
    groups that agree on all of them, and the rest is inclusion and exclusion.
    """
    o = table(spark, d, "organization").filter("canonical_name is not null")
    word, name5 = F.upper(F.split_part("canonical_name", F.lit(" "), F.lit(1))), F.upper(F.left("canonical_name", F.lit(5)))
    keys = {"name5_state": (name5, F.col("registered_state")), "name5_type": (name5, F.col("org_type")), "word_year": (word, F.year("formation_date").cast("string"))}
    rows = o.select(*[F.concat(a, F.lit("|"), b).alias(rule) for rule, (a, b) in keys.items()])
    sets = [s for size in (1, 2, 3) for s in combinations(keys, size)]
    met = F.array(*[F.when(reduce(lambda x, y: x & y, [F.col(r).isNotNull() for r in s]), F.struct(F.lit("+".join(s)).alias("rules"), F.concat_ws("\x1f", *s).alias("key"))) for s in sets])
    groups = rows.select(F.explode(F.array_compact(met)).alias("m")).groupBy("m.rules", "m.key").agg(F.count("*").alias("n"))
    made = groups.groupBy("rules").agg(F.count("*").alias("blocks"), F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)).cast("long").alias("pairs"), F.max("n").alias("largest"))
    pairs = {s: F.coalesce(F.max(F.when(F.col("rules") == "+".join(s), F.col("pairs"))), F.lit(0)) for s in sets}
    without = lambda rule, others: sum(((-1) ** size * pairs[tuple(k for k in keys if k == rule or k in s)] for size in range(len(others) + 1) for s in combinations(others, size)), F.lit(0))
    names = list(keys)
    counts = made.agg(F.array(*[F.struct(F.lit(r).alias("rules"), without(r, names[:i]).alias("first_here"), without(r, [k for k in names if k != r]).alias("only_here")) for i, r in enumerate(names)]).alias("c")).select(F.inline("c"))
    return made.join(F.broadcast(counts), "rules").select(F.col("rules").alias("rule"), "blocks", "pairs", "largest", "first_here", "only_here")  # one row per rule


@C.add()
def soundex_blocks(spark: SparkSession, d: str) -> DataFrame:
    """(code, state, n, smallest): organisations by the sound of their first word and state; DuckDB has no SOUNDEX."""
    o = table(spark, d, "organization").filter("canonical_name is not null")
    return o.groupBy(F.soundex(F.split_part("canonical_name", F.lit(" "), F.lit(1))).alias("code"), F.col("registered_state").alias("state")).agg(F.count("*").alias("n"), F.min("id").alias("smallest"))


@C.add("""WITH c AS (SELECT er_cluster_id AS cluster, count(*) AS members, min(er_confidence) AS weakest, max(updated_at)::DATE AS changed, bool_or(date_of_birth IS NULL) AS partial FROM person WHERE er_cluster_id IS NOT NULL GROUP BY 1),
s AS (SELECT CASE WHEN weakest >= 0.95 THEN 'match' WHEN weakest >= 0.8 THEN 'probable_match' WHEN weakest >= 0.6 THEN 'possible_match' ELSE 'no_match' END AS tier, * FROM c) SELECT tier, count(*) AS clusters, CAST(sum(members) AS BIGINT) AS members, max(changed) AS changed, count(*) FILTER (WHERE partial) AS partial FROM s GROUP BY 1""")
def er_summary(spark: SparkSession, d: str) -> DataFrame:
    """Clusters and members by the tier of the weakest decision."""
    c = table(spark, d, "person").filter("er_cluster_id is not null").groupBy("er_cluster_id").agg(F.count("*").alias("m"), F.min("er_confidence").alias("w"), F.max("updated_at").cast("date").alias("changed"), F.bool_or(F.col("date_of_birth").isNull()).alias("partial"))
    tier = F.when(F.col("w") >= 0.95, "match").when(F.col("w") >= 0.8, "probable_match").when(F.col("w") >= 0.6, "possible_match").otherwise("no_match")
    return c.groupBy(tier.alias("tier")).agg(F.count("*").alias("clusters"), F.sum("m").alias("members"), F.max("changed").alias("changed"), F.count(F.when(F.col("partial"), 1)).alias("partial"))


@C.add("""WITH h AS (SELECT id, upper(owner_name) AS n, owner_mail_state AS st, valid_from, valid_to FROM ownership WHERE owner_name IS NOT NULL), t AS (SELECT upper(trim(name, ' ')) AS n, upper(nullif(trim(state, ' '), '')) AS st, CAST(try_strptime(nullif(trim(date_occured, ' '), ''), '%m/%d/%Y') AS DATE) AS day FROM real_transaction_export_adams)
SELECT h.id AS holder_id, count(*) AS n, CASE WHEN bool_or((h.valid_from IS NULL OR h.valid_from <= t.day) AND (h.valid_to IS NULL OR t.day < h.valid_to)) THEN 'in_term' ELSE 'out_of_term' END AS status FROM h JOIN t ON h.n = t.n AND h.st IS NOT DISTINCT FROM t.st GROUP BY 1""")
def roster_resolver(spark: SparkSession, d: str) -> DataFrame:
    """Holders and filers of one name: null-safe place, and whether any filing falls into the term; filings are counted per day first."""
    t = transactions(spark, d).filter("name is not null").groupBy(F.upper("name").alias("n"), F.col("state").alias("t"), "day").agg(F.count("*").alias("c"))
    h = table(spark, d, "ownership").filter("owner_name is not null").select(F.col("id").alias("holder_id"), F.upper("owner_name").alias("m"), F.col("owner_mail_state").alias("s"), "valid_from", "valid_to")
    j = h.join(t, (F.col("m") == F.col("n")) & F.col("s").eqNullSafe(F.col("t")))
    within = F.coalesce(F.bool_or(X.covers(F.col("valid_from"), F.col("valid_to"), F.col("day"))), F.lit(False))
    return j.groupBy("holder_id").agg(F.sum("c").alias("n"), F.when(within, "in_term").otherwise("out_of_term").alias("status"))


@C.add("""WITH k AS (SELECT id, map_keys(identifiers) AS ks, upper(first_name) AS f, upper(last_name) AS l FROM person), x AS (SELECT DISTINCT lower(canonical_person_id) AS id FROM person_absorption WHERE canonical_person_id IS NOT NULL)
SELECT k.id, len(ks) AS schemes, CASE WHEN len(ks) = 0 THEN 'no_identifier' WHEN x.id IS NOT NULL THEN 'blocked' WHEN len(list_filter(ks, lambda s: NOT list_contains(['fec_candidate_id', 'fec_candidate_ids', 'voter_id'], s))) = 0 THEN 'shadow' ELSE 'kept' END AS status FROM k LEFT JOIN x ON x.id = lower(k.id)""")
def shadow_persons(spark: SparkSession, d: str) -> DataFrame:
    """Persons known only by one family of identifiers, unless another relation blocks them."""
    blockers = table(spark, d, "person_absorption").filter("canonical_person_id is not null").select(F.lower("canonical_person_id").alias("b")).distinct()
    k = table(spark, d, "person").select("id", F.map_keys("identifiers").alias("ks")).join(blockers, F.lower("id") == F.col("b"), "left")
    others = F.size(F.filter("ks", lambda s: ~s.isin("fec_candidate_id", "fec_candidate_ids", "voter_id")))
    status = F.when(F.size("ks") == 0, "no_identifier").when(F.col("b").isNotNull(), "blocked").when(others == 0, "shadow").otherwise("kept")
    return k.select("id", F.size("ks").cast("long").alias("schemes"), status.alias("status"))


@C.add("""WITH a AS (SELECT id, upper(first_name) AS f, upper(last_name) AS l, upper(middle_name) AS m, date_of_birth AS b FROM person WHERE first_name IS NOT NULL AND last_name IS NOT NULL), g AS (SELECT f, l, count(*) AS n, count(DISTINCT left(m, 1)) AS initials, count(DISTINCT b) FILTER (WHERE b <> DATE '1900-01-01') AS births, min(id) AS smallest FROM a GROUP BY 1, 2)
SELECT f, l, n, smallest, CASE WHEN n = 1 THEN 'single' WHEN initials > 1 OR births > 1 THEN 'must_not_match' WHEN births = 1 THEN 'must_match' ELSE 'review' END AS verdict FROM g""")
def regression_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that must and must not match, judged per full name: middle initials and birth dates must not contradict."""
    b = F.when(F.col("date_of_birth") != F.to_date(F.lit("1900-01-01")), F.col("date_of_birth"))
    g = table(spark, d, "person").filter("first_name is not null and last_name is not null").groupBy(F.upper("first_name").alias("f"), F.upper("last_name").alias("l")).agg(F.count("*").alias("n"), F.count_distinct(F.left(F.upper("middle_name"), F.lit(1))).alias("i"), F.count_distinct(b).alias("b"), F.min("id").alias("smallest"))
    verdict = F.when(F.col("n") == 1, "single").when((F.col("i") > 1) | (F.col("b") > 1), "must_not_match").when(F.col("b") == 1, "must_match").otherwise("review")
    return g.select("f", "l", "n", "smallest", verdict.alias("verdict"))


# ------------------------------------------------------------- graph


_EDGES = """e AS (SELECT 'FILED' AS type, committee AS src, report AS dst, count(*) AS n FROM tx WHERE committee IS NOT NULL AND report IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'SUPPORTS', committee, upper(city), count(*) FROM tx WHERE kind = 'Party Comm' AND committee IS NOT NULL AND city IS NOT NULL GROUP BY 2, 3
 UNION ALL SELECT 'OPPOSES', committee, upper(city), count(*) FROM tx WHERE kind = 'Non-Party Comm' AND committee IS NOT NULL AND city IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'AFFILIATED_WITH', committee, committee_name, count(*) FROM tx WHERE committee IS NOT NULL AND committee_name IS NOT NULL GROUP BY 2, 3)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """(type, src, dst, n): edges made in one pass, each once."""
    edge = lambda kind, cond, dst: F.when(cond & F.col("committee").isNotNull() & dst.isNotNull(), F.struct(F.lit(kind).alias("type"), F.col("committee").alias("src"), dst.alias("dst")))
    made = F.array_compact(F.array(edge("FILED", F.lit(True), F.col("report")), edge("SUPPORTS", F.col("kind").eqNullSafe(F.lit("Party Comm")), F.upper("city")), edge("OPPOSES", F.col("kind").eqNullSafe(F.lit("Non-Party Comm")), F.upper("city")), edge("AFFILIATED_WITH", F.lit(True), F.col("committee_name"))))
    return transactions(spark, d).select(F.explode(made).alias("e")).groupBy("e.type", "e.src", "e.dst").agg(F.count("*").alias("n"))


@C.add(f"WITH {TX}, {_EDGES} SELECT * FROM e")
def graph_campaign_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@C.add("""WITH h AS (SELECT 'HOLDS' AS type, upper(owner_name) AS src, parcel_id AS dst FROM ownership WHERE owner_name IS NOT NULL AND parcel_id IS NOT NULL UNION ALL SELECT 'REPRESENTS', parcel_id, upper(owner_mail_city) FROM ownership WHERE parcel_id IS NOT NULL AND owner_mail_city IS NOT NULL UNION ALL SELECT 'CANDIDACY_OF', id, upper(canonical_name) FROM donor_er_view WHERE canonical_name IS NOT NULL UNION ALL SELECT 'RUNS_IN', id, upper(contributor_city) FROM donor_er_view WHERE contributor_city IS NOT NULL)
SELECT type, src, dst, count(*) AS n FROM h GROUP BY 1, 2, 3""")
def graph_civic_edges(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "ownership"), table(spark, d, "donor_er_view")
    edge = lambda df, kind, src, dst: df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst")).filter("src is not null and dst is not null")
    made = [edge(o, "HOLDS", F.upper("owner_name"), F.col("parcel_id")), edge(o, "REPRESENTS", F.col("parcel_id"), F.upper("owner_mail_city")), edge(k, "CANDIDACY_OF", F.col("id"), F.upper("canonical_name")), edge(k, "RUNS_IN", F.col("id"), F.upper("contributor_city"))]
    return _union(made).groupBy("type", "src", "dst").agg(F.count("*").alias("n"))


@C.add("""WITH p AS (SELECT er_cluster_id AS c, min(id) AS hub FROM person WHERE er_cluster_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN er_confidence >= 0.95 THEN 'SAME_AS' ELSE 'POSSIBLE_MATCH' END AS type, hub AS src, id AS dst FROM person JOIN p ON p.c = er_cluster_id WHERE id <> hub""")
def graph_identity_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the current clusters only: what an older run left is not rebuilt."""
    p = table(spark, d, "person").filter("er_cluster_id is not null").select("id", "er_cluster_id", "er_confidence")
    hub = p.groupBy("er_cluster_id").agg(F.min("id").alias("src"))
    return p.join(hub, "er_cluster_id").filter("id != src").select(F.when(F.col("er_confidence") >= 0.95, "SAME_AS").otherwise("POSSIBLE_MATCH").alias("type"), "src", F.col("id").alias("dst"))


@C.add(f"""WITH {TX}, {_EDGES}, gone AS (SELECT committee FROM tx WHERE committee IS NOT NULL GROUP BY 1 HAVING count(DISTINCT series) = 1 AND bool_and(kind IS DISTINCT FROM 'Loan Proceeds')) SELECT type, count(*) AS edges, CAST(sum(n) AS BIGINT) AS rows_, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM e WHERE src NOT IN (SELECT committee FROM gone)) AS ratio FROM e WHERE src NOT IN (SELECT committee FROM gone) GROUP BY type""")
def graph_after_deletion(spark: SparkSession, d: str) -> DataFrame:
    """Deleting nodes deletes their edges; what each family's share is afterwards."""
    gone = transactions(spark, d).filter("committee is not null").groupBy("committee").agg(F.count_distinct("series").alias("s"), F.bool_and(~F.col("kind").eqNullSafe(F.lit("Loan Proceeds"))).alias("b")).filter("s = 1 and b")
    e = _edges(spark, d).join(gone, F.col("src") == F.col("committee"), "left_anti")
    g = e.groupBy("type").agg(F.count("*").alias("edges"), F.sum("n").alias("rows_"))
    return g.join(F.broadcast(g.agg(F.sum("edges").alias("all_")))).select("type", "edges", "rows_", (F.col("edges").cast("double") / F.col("all_")).alias("ratio"))


# ------------------------------------------------------------- search


_LANES = """lanes AS (SELECT 'person' AS lane, id, canonical_name AS name, 1 AS held FROM person UNION ALL SELECT 'organization', id, canonical_name, 0 FROM organization UNION ALL SELECT 'donor', id, contributor_name_raw, 0 FROM donor_er_view
 UNION ALL SELECT 'owner', id, owner_name, 1 FROM ownership UNION ALL SELECT 'registration', id, name, 0 FROM political_organization_527 UNION ALL SELECT 'committee', committee_sboe_id, min(committee_name), 0 FROM real_transaction_export_adams WHERE committee_sboe_id IS NOT NULL GROUP BY committee_sboe_id)"""


@C.add(f"""WITH {_LANES}, m AS (SELECT lane, id, name, held, CASE WHEN lower(name) = 'lakeborn' THEN 0 WHEN starts_with(lower(name), 'lakeborn') THEN 1 ELSE 2 END AS rank FROM lanes WHERE contains(lower(name), 'lakeborn')) SELECT lane, id, name, CAST(rank AS BIGINT) AS rank FROM m ORDER BY rank, held DESC, name, id LIMIT 50""")
def search_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Six kinds of things searched at once: exact, then prefix, then contained; holders first."""
    lane = lambda t, kind, name, held, key="id": table(spark, d, t).select(F.lit(kind).alias("lane"), F.col(key).alias("id"), F.col(name).alias("name"), F.lit(held).alias("held"))
    committees = table(spark, d, "real_transaction_export_adams").filter("committee_sboe_id is not null").groupBy(F.col("committee_sboe_id").alias("id")).agg(F.min("committee_name").alias("name")).select(F.lit("committee").alias("lane"), "id", "name", F.lit(0).alias("held"))
    all_ = _union([lane("person", "person", "canonical_name", 1), lane("organization", "organization", "canonical_name", 0), lane("donor_er_view", "donor", "contributor_name_raw", 0), lane("ownership", "owner", "owner_name", 1), lane("political_organization_527", "registration", "name", 0), committees])
    low = F.lower("name")
    rank = F.when(low == "lakeborn", 0).when(low.startswith("lakeborn"), 1).otherwise(2).cast("long")
    return all_.filter(low.contains("lakeborn")).select("lane", "id", "name", rank.alias("rank"), "held").orderBy("rank", F.desc("held"), "name", "id").limit(50).drop("held")


@C.add("""SELECT id, canonical_name AS name FROM organization WHERE canonical_name LIKE 'Friends of%' OR canonical_name LIKE 'FRIENDS OF%'""")
def sentinel_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Rows by a prefix, which the scan can prune."""
    return table(spark, d, "organization").filter(F.col("canonical_name").startswith("Friends of") | F.col("canonical_name").startswith("FRIENDS OF")).select("id", F.col("canonical_name").alias("name"))


# ------------------------------------------------------------- quality


@C.add(f"""WITH s AS (SELECT data_source_id, feed_kind, count(*) AS n, count(source_record_key) AS keyed, count(DISTINCT source_record_key) AS keys, min(pull_date AT TIME ZONE 'UTC')::DATE AS first_day, max(pull_date AT TIME ZONE 'UTC')::DATE AS last_day, count(*) FILTER (WHERE len(map_keys(raw_fields)) = 0 OR raw_fields IS NULL) AS empty_rows FROM source_record GROUP BY 1, 2)
SELECT *, CASE WHEN keyed * 100 < n * 90 THEN 'fail' WHEN keyed < n THEN 'warn' ELSE 'pass' END AS key_status, date_diff('day', last_day, DATE '{TODAY}') AS age, CASE WHEN feed_kind = 'full' THEN 30 ELSE 7 END AS cadence, date_diff('day', last_day, DATE '{TODAY}') > CASE WHEN feed_kind = 'full' THEN 30 ELSE 7 END AS due FROM s""")
def source_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Counts, date range, key completeness, age and whether the next pull is due."""
    s = table(spark, d, "source_record").groupBy("data_source_id", "feed_kind").agg(F.count("*").alias("n"), F.count("source_record_key").alias("keyed"), F.count_distinct("source_record_key").alias("keys"), F.to_date(F.min("pull_date")).alias("first_day"), F.to_date(F.max("pull_date")).alias("last_day"), F.count(F.when(F.coalesce(F.size("raw_fields"), F.lit(0)) <= 0, 1)).alias("empty_rows"))
    age, cadence = F.datediff(F.to_date(F.lit(TODAY)), "last_day").cast("long"), F.when(F.col("feed_kind") == "full", 30).otherwise(7)
    status = F.when(F.col("keyed") * 100 < F.col("n") * 90, "fail").when(F.col("keyed") < F.col("n"), "warn").otherwise("pass")
    return s.select("*", status.alias("key_status"), age.alias("age"), cadence.alias("cadence"), (age > cadence).alias("due"))


@C.add("""WITH d AS (SELECT data_source_id, (pull_date AT TIME ZONE 'UTC')::DATE AS day, count(*) AS n, max(created_at AT TIME ZONE 'UTC')::DATE AS stored FROM source_record GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER (PARTITION BY data_source_id ORDER BY day) AS before_, lag(day) OVER (PARTITION BY data_source_id ORDER BY day) AS day_before FROM d)
SELECT data_source_id, day, n, CASE WHEN n = 0 THEN 'empty' WHEN before_ IS NULL THEN 'first' WHEN n * 2 < before_ THEN 'degraded' WHEN stored > day + 7 THEN 'late' ELSE 'success' END AS status, coalesce(date_diff('day', day_before, day), 0) AS gap FROM l""")
def pull_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of every delivery against the one before."""
    g = table(spark, d, "source_record").groupBy("data_source_id", F.to_date("pull_date").alias("day")).agg(F.count("*").alias("n"), F.to_date(F.max("created_at")).alias("stored"))
    w = W.partitionBy("data_source_id").orderBy("day")
    g = g.select("*", F.lag("n").over(w).alias("b"), F.lag("day").over(w).alias("p"))
    status = F.when(F.col("n") == 0, "empty").when(F.col("b").isNull(), "first").when(F.col("n") * 2 < F.col("b"), "degraded").when(F.col("stored") > F.date_add("day", 7), "late").otherwise("success")
    return g.select("data_source_id", "day", "n", status.alias("status"), F.coalesce(F.datediff("day", "p").cast("long"), F.lit(0)).alias("gap"))


@C.add(f"""WITH {TX}, f AS (SELECT 'person' AS area, count(*) AS n, 100 AS floor_ FROM person UNION ALL SELECT 'organization', count(*), 100 FROM organization UNION ALL SELECT 'ownership', count(*), 5000 FROM ownership UNION ALL SELECT 'transactions', count(*), 1000 FROM tx) SELECT area, n, floor_, n >= floor_ AS healthy FROM f""")
def content_health(spark: SparkSession, d: str) -> DataFrame:
    """Row counts against their floors."""
    area = lambda name, df, low: df.agg(F.lit(name).alias("area"), F.count("*").alias("n"), F.lit(low).alias("floor_"))
    f = _union([area("person", table(spark, d, "person"), 100), area("organization", table(spark, d, "organization"), 100), area("ownership", table(spark, d, "ownership"), 5000), area("transactions", transactions(spark, d), 1000)])
    return f.select("area", "n", "floor_", (F.col("n") >= F.col("floor_")).alias("healthy"))


@C.add(f"""WITH {TX}, a AS (SELECT committee, sum(amount) AS live, sum(amount) FILTER (WHERE kind = 'Individual') AS part, count(*) FILTER (WHERE day IS NULL) AS undated, count(*) AS n FROM tx WHERE committee IS NOT NULL GROUP BY 1)
SELECT committee, CAST(live AS DOUBLE) AS live, CAST(part AS DOUBLE) AS part, array_to_string(list_filter([CASE WHEN abs(coalesce(live, 0) - coalesce(part, 0)) > 0.01 THEN 'does_not_reconcile' END, CASE WHEN live < 0 THEN 'negative' END, CASE WHEN undated > 0 THEN 'undated_rows' END], lambda x: x IS NOT NULL), ',') AS caveats FROM a""")
def reconciliation_caveats(spark: SparkSession, d: str) -> DataFrame:
    """Why a total should be read with care."""
    a = transactions(spark, d).filter("committee is not null").groupBy("committee").agg(F.sum("amount").alias("live"), F.sum(F.when(F.col("kind") == "Individual", F.col("amount"))).alias("part"), F.count(F.when(F.col("day").isNull(), 1)).alias("undated"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    caveats = F.array_compact(F.array(F.when(F.abs(zero("live") - zero("part")) > 0.01, "does_not_reconcile"), F.when(F.col("live") < 0, "negative"), F.when(F.col("undated") > 0, "undated_rows")))
    return a.select("committee", F.col("live").cast(X.MONEY).alias("live"), F.col("part").cast(X.MONEY).alias("part"), F.array_join(caveats, ",").alias("caveats"))


@C.add("""WITH r(rule, kind, state, lim, from_, to_) AS (VALUES ('r1', 'Individual', 'NC', 300, DATE '2020-01-01', DATE '2023-01-01'), ('r2', 'Individual', 'NC', 400, DATE '2023-01-01', NULL), ('r3', 'Individual', 'VA', 350, DATE '2019-01-01', NULL)), """ + TX + """
SELECT t.committee, r.rule, count(*) AS n, count(*) FILTER (WHERE t.amount > r.lim) AS over_limit FROM tx t JOIN r ON r.kind = t.kind AND r.state = t.state AND t.day >= r.from_ AND (r.to_ IS NULL OR t.day < r.to_) WHERE t.committee IS NOT NULL GROUP BY 1, 2""")
def contribution_limits(spark: SparkSession, d: str) -> DataFrame:
    """A projected table of rules with effective ranges joined to what they govern."""
    r = spark.sql("SELECT * FROM VALUES ('r1', 'Individual', 'NC', 300, DATE'2020-01-01', DATE'2023-01-01'), ('r2', 'Individual', 'NC', 400, DATE'2023-01-01', CAST(NULL AS DATE)), ('r3', 'Individual', 'VA', 350, DATE'2019-01-01', CAST(NULL AS DATE)) AS r(rule, kind, state, lim, from_, to_)")
    j = transactions(spark, d).filter("committee is not null").join(F.broadcast(r), ["kind", "state"]).filter(X.covers(F.col("from_"), F.col("to_"), F.col("day")))
    return j.groupBy("committee", "rule").agg(F.count("*").alias("n"), F.count(F.when(F.col("amount") > F.col("lim"), 1)).alias("over_limit"))


@C.add(f"""WITH {TX}, g AS (SELECT committee, count(*) AS n, CAST(sum(CAST('0x' || left(md5(id), 8) AS BIGINT)) AS BIGINT) AS fingerprint, max(exported_on) AS built FROM tx WHERE committee IS NOT NULL GROUP BY 1) SELECT *, date_diff('day', built, DATE '{TODAY}') AS age, date_diff('day', built, DATE '{TODAY}') <= 8 AS is_current FROM g""")
def rollup_currency(spark: SparkSession, d: str) -> DataFrame:
    """A rollup serves only while its fingerprint and age hold; the fingerprint adds up, whatever the order."""
    age = F.datediff(F.to_date(F.lit(TODAY)), "built").cast("long")
    g = transactions(spark, d).filter("committee is not null").groupBy("committee").agg(F.count("*").alias("n"), F.sum(F.conv(F.left(F.md5("id"), F.lit(8)), 16, 10).cast("long")).alias("fingerprint"), F.max("exported_on").alias("built"))
    return g.select("*", age.alias("age"), (age <= 8).alias("is_current"))


@C.add("""WITH m AS (SELECT upper(trim(owner_mail_city, ' ')) AS town, owner_mail_state AS st, count(*) AS n FROM ownership WHERE owner_mail_city IS NOT NULL GROUP BY 1, 2), t AS (SELECT town, count(DISTINCT st) AS states, arg_max(st, (n, st)) AS top FROM m WHERE st IS NOT NULL GROUP BY 1), x AS (SELECT DISTINCT upper(trim(city, ' ')) AS town FROM real_transaction_export_adams WHERE trim(city, ' ') <> '')
SELECT x.town, CASE WHEN t.town IS NULL THEN 'unknown' WHEN t.states > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN t.states = 1 THEN t.top END AS state FROM x LEFT JOIN t USING (town)""")
def municipality_resolver(spark: SparkSession, d: str) -> DataFrame:
    """A town resolves only if one state has it."""
    t = table(spark, d, "ownership").filter("owner_mail_city is not null and owner_mail_state is not null").groupBy(F.upper(F.trim("owner_mail_city")).alias("town")).agg(F.count_distinct("owner_mail_state").alias("states"), F.min("owner_mail_state").alias("top"))
    x = table(spark, d, "real_transaction_export_adams").select(F.upper(F.trim("city")).alias("town")).filter("town != ''").distinct()
    return x.join(t, "town", "left").select("town", F.when(F.col("states").isNull(), "unknown").when(F.col("states") > 1, "ambiguous").otherwise("resolved").alias("status"), F.when(F.col("states") == 1, F.col("top")).alias("state"))


@C.add("""WITH r AS (SELECT data_source_id, feed_kind, count(*) AS n, count(DISTINCT (pull_date AT TIME ZONE 'UTC')::DATE) AS deliveries FROM source_record GROUP BY 1, 2) SELECT feed_kind, CASE WHEN deliveries >= 10 THEN 'tier_1' WHEN deliveries >= 5 THEN 'tier_2' ELSE 'tier_3' END AS support, count(*) AS sources, CAST(sum(n) AS BIGINT) AS rows_ FROM r GROUP BY 1, 2""")
def coverage_registry(spark: SparkSession, d: str) -> DataFrame:
    """Sources by tier of support, a projection that owns no facts."""
    r = table(spark, d, "source_record").groupBy("data_source_id", "feed_kind").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("pull_date")).alias("d"))
    return r.groupBy("feed_kind", F.when(F.col("d") >= 10, "tier_1").when(F.col("d") >= 5, "tier_2").otherwise("tier_3").alias("support")).agg(F.count("*").alias("sources"), F.sum("n").alias("rows_"))




# ------------------------------------------------------------- boards and evaluation


@C.add(f"""WITH {TX}, m AS (SELECT id AS member, upper(owner_name) AS n, owner_mail_state AS st FROM ownership WHERE owner_name IS NOT NULL AND valid_to IS NULL), k AS (SELECT upper(name) AS n, state AS st, sum(amount) AS raised, count(*) AS n_tx, count(DISTINCT series) AS sources, max(exported_on) AS as_of FROM tx WHERE name IS NOT NULL GROUP BY 1, 2),
b AS (SELECT m.member, m.n AS name, m.st AS state, coalesce(k.raised, 0) AS raised, coalesce(k.n_tx, 0) AS n_tx, coalesce(k.sources, 0) AS sources, k.as_of, k.n IS NOT NULL AS covered FROM m LEFT JOIN k ON k.n = m.n AND k.st IS NOT DISTINCT FROM m.st), r AS (SELECT *, row_number() OVER (ORDER BY raised DESC, name, member) AS k FROM b)
SELECT CAST(k AS BIGINT) AS k, member, name, state, CAST(raised AS DOUBLE) AS raised, n_tx, sources, as_of, covered FROM r WHERE k <= 100""")
def money_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Sitting members with their money and its provenance, all fetched by one join; the hundred highest."""
    k = transactions(spark, d).filter("name is not null").groupBy(F.upper("name").alias("n"), F.col("state").alias("t")).agg(F.sum("amount").alias("a"), F.count("*").alias("c"), F.count_distinct("series").alias("s"), F.max("exported_on").alias("as_of"))
    m = table(spark, d, "ownership").filter("owner_name is not null and valid_to is null").select(F.col("id").alias("member"), F.upper("owner_name").alias("name"), F.col("owner_mail_state").alias("state"))
    j = m.join(k, (F.col("name") == F.col("n")) & F.col("state").eqNullSafe(F.col("t")), "left").select("member", "name", "state", F.coalesce("a", F.lit(0)).alias("raised"), F.coalesce("c", F.lit(0)).alias("n_tx"), F.coalesce("s", F.lit(0)).alias("sources"), "as_of", F.col("n").isNotNull().alias("covered"))
    order = [F.desc("raised"), F.col("name"), F.col("member")]
    top = j.orderBy(*order).limit(100)
    return top.select(F.row_number().over(W.orderBy(*order)).cast("long").alias("k"), "member", "name", "state", F.col("raised").cast(X.MONEY).alias("raised"), "n_tx", "sources", "as_of", "covered")


@C.add("""WITH c AS (SELECT er_cluster_id AS cluster, count(*) AS members, min(er_confidence) AS weakest, min(id) AS head FROM person WHERE er_cluster_id IS NOT NULL GROUP BY 1), x AS (SELECT cluster_id, count(*) AS decisions, count(DISTINCT merged_by) AS deciders FROM person_absorption WHERE cluster_id IS NOT NULL GROUP BY 1)
SELECT c.cluster, c.members, c.weakest, p.canonical_name AS name, coalesce(x.decisions, 0) AS decisions, coalesce(x.deciders, 0) AS deciders FROM c JOIN person p ON p.id = c.head LEFT JOIN x ON x.cluster_id = c.cluster""")
def er_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with their head's name and the decisions behind them."""
    p = table(spark, d, "person").filter("er_cluster_id is not null")
    c = p.groupBy(F.col("er_cluster_id").alias("cluster")).agg(F.count("*").alias("members"), F.min("er_confidence").alias("weakest"), F.min(F.struct("id", "canonical_name"))["canonical_name"].alias("name"))
    x = table(spark, d, "person_absorption").filter("cluster_id is not null").groupBy(F.col("cluster_id").alias("cluster")).agg(F.count("*").alias("decisions"), F.count_distinct("merged_by").alias("deciders"))
    return c.join(x, "cluster", "left").select("cluster", "members", "weakest", "name", F.coalesce("decisions", F.lit(0)).alias("decisions"), F.coalesce("deciders", F.lit(0)).alias("deciders"))


@C.add("""WITH s AS (SELECT er_confidence AS p, er_cluster_id IS NOT NULL AS hit FROM person WHERE er_confidence IS NOT NULL), t(cut) AS (VALUES (0.5), (0.6), (0.7), (0.8), (0.9), (0.95)) SELECT CAST(cut AS DOUBLE) AS cut, count(*) FILTER (WHERE p >= cut AND hit) AS true_positive, count(*) FILTER (WHERE p >= cut AND NOT hit) AS false_positive, count(*) FILTER (WHERE p < cut AND hit) AS false_negative,
 round(CAST(count(*) FILTER (WHERE p >= cut AND hit) AS DOUBLE) / nullif(count(*) FILTER (WHERE p >= cut), 0), 6) AS precision_ FROM s, t GROUP BY cut""")
def threshold_tuning(spark: SparkSession, d: str) -> DataFrame:
    """Outcome at each candidate threshold, all thresholds in one pass."""
    cuts = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
    p, hit = F.col("er_confidence"), F.col("er_cluster_id").isNotNull()
    s = table(spark, d, "person").filter("er_confidence is not null")
    one = s.agg(F.array(*[F.struct(F.lit(c).alias("cut"), F.count(F.when((p >= c) & hit, 1)).alias("true_positive"), F.count(F.when((p >= c) & ~hit, 1)).alias("false_positive"), F.count(F.when((p < c) & hit, 1)).alias("false_negative")) for c in cuts]).alias("t"))
    t = one.select(F.inline("t"))
    return t.select("*", F.round(F.col("true_positive") / F.nullif(F.col("true_positive") + F.col("false_positive"), F.lit(0)), 6).alias("precision_"))


@C.add(f"""WITH {TX} SELECT id, name, state FROM tx WHERE kind = 'Individual' AND name IS NOT NULL AND NOT regexp_matches(upper(name), '^(AGGREGATED|UNITEMIZED|ANONYMOUS)') AND regexp_matches(name, '[A-Za-z].*[A-Za-z]') AND coalesce(amount, 0) > 0""")
def donors_worth_resolving(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose donor can be resolved at all."""
    t = transactions(spark, d).filter((F.col("kind") == "Individual") & (F.coalesce("amount", F.lit(0)) > 0) & F.col("name").isNotNull())
    return t.filter(~F.upper("name").rlike("^(AGGREGATED|UNITEMIZED|ANONYMOUS)") & F.col("name").rlike("[A-Za-z].*[A-Za-z]")).select("id", "name", "state")
