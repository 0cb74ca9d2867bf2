"""Matching bodies across two sources without a shared key (problem 7).

Name q-grams are encoded as fixed bit vectors. Vectors within a Hamming radius are
found exactly by multi-index hashing: cut into radius + 2 segments, two vectors within
the radius agree in at least two segments, so pairs of segments are the join keys, and
a bit count verifies. Every key also holds something a match needs besides the name:
the town where both are known, else the quarter of the founding date, else the state.
So the candidates of a body are those of its town or quarter, however often its name
occurs, and bodies only meet where they could be the same. Initials are keys alike.

Each candidate gets Dice scores of its fields (name bits, weighted words, town,
address, date, state, and how few rivals it has); their weighted mean is turned into a
confidence by a monotone calibration against EIN agreement. The EIN neither admits nor
scores a pair, and each half of the organisations is calibrated on the other half, so no
pair vouches for itself. Where a pair's own EINs are known, the confidence is then updated by how often the EINs of sure
pairs agree and how often those of chance pairs do (Bayes' rule).

Edge cases: null, blank and placeholder names match nothing; bodies with known towns
match only in one town; an equal EIN alone is no match; repeated rows match each on
their own; missing addresses and dates count as unknown; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import blank_to_null
from tallybook.llm.addresses import share_towns, shared_gazetteer
from tallybook.llm.name_matching import with_org_words
from tallybook.llm.names import Name, Weights, org_likeness, qgrams, read_name
from tallybook.llm.places import STATES, read_place
from tallybook.plans.stage import materialize, shuffled

#: Hamming radius, segments (radius + 2) of so many bits, days within which dates agree.
RADIUS, SEGMENTS, WIDTH, DAYS = 8, 10, 24, 92
BITS = SEGMENTS * WIDTH
#: Weights of the fields' Dice scores, the score of an unknown field, bins and prior strength of the calibration, least confidence of a match.
FIELD_WEIGHTS, UNKNOWN, BINS, PRIOR, LEAST = {"bits": 2.0, "words": 5.0, "town": 2.0, "address": 1.0, "date": 3.0, "state": 1.0, "rivals": 3.0}, 0.35, 20, 8.0, 0.5
#: Misfit of two names' words that leaves nothing of their score. How often two different bodies have one EIN.
MISFIT, CHANCE = 0.25, 0.01
_PAIRS = list(combinations(range(SEGMENTS), 2))


def encode(words: tuple[str, ...]) -> list[int]:
    """Segments of the bit vector of the padded bigrams of a name's words, whatever their order."""
    segments = [0] * SEGMENTS
    for w in words:
        padded = f"^{w}$"
        for i in range(len(padded) - 1):
            at = xxhash.xxh64_intdigest(padded[i : i + 2].encode()) % BITS
            segments[at // WIDTH] |= 1 << at % WIDTH
    return segments


def index_keys(segments: Column, attribute: Column) -> Column:
    """Array of the keys of a vector: every pair of segments together with an attribute."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _PAIRS])
    return F.transform(pairs, lambda p: F.xxhash64(attribute, p["i"], p["j"], F.get(segments, p["i"]), F.get(segments, p["j"])))


def _read_body(text: str, marks: frozenset[str]) -> Name:
    """The name of a body; without legal form and known words it is still no person."""
    read = read_name(text, marks)
    if read.kind != "P":
        return read
    words = (read.readings[0][0], *read.readings[0][2:], *read.readings[0][1].split())
    return Name("O", read.form, (words, ("".join(w[0] for w in words),)))


def _name_reader(vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, marks in zip(batch.column("name").to_pylist(), batch.column("marks").to_pylist()):
                read = _read_body(text, vocabulary.value or frozenset(marks))
                if read.kind:
                    spelt = read.readings[1] if len(read.readings) > 1 else ()
                    words = list(read.readings[0])
                    rows.append((text, read.kind, read.form, words, list(spelt) if read.kind == "O" else words, encode(read.readings[0]), sorted({g for w in words for g in qgrams(w)})))
            columns = list(zip(*rows)) if rows else [[]] * 7
            texts = pa.list_(pa.string())
            types = [pa.string(), pa.string(), pa.string(), texts, texts, pa.list_(pa.int32()), texts]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["name", "kind", "form", "words", "initials", "bits", "grams"])

    return run


_NAME_ROW = "name string, kind string, form string, words array<string>, initials array<string>, bits array<int>, grams array<string>"
_SIDE = ("kind", "form", "words", "initials")


def _likeness(counts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = Weights(counts.value[1], counts.value[0])
        for batch in batches:
            sides = []
            for s in "ab":
                parts = zip(*[batch.column(f"{s}_{c}").to_pylist() for c in _SIDE])
                sides.append([Name(k, f, (tuple(w), tuple(i)) if k == "O" else (tuple(w),)) for k, f, w, i in parts])
            words = [max(0.0, 1 - (1 - org_likeness(a, b, weight)) / MISFIT) for a, b in zip(*sides)]
            yield pa.record_batch([*[batch.column(c) for c in ("o", "f", "bits_dice")], pa.array(words, pa.float64())], ["o", "f", "bits", "words"])

    return run


def _place_reader(towns) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gazetteer = shared_gazetteer(towns)
        for batch in batches:
            rows = []
            for key, line, city, state, zip_code in zip(*[batch.column(c).to_pylist() for c in ("id", "line", "city", "state", "zip")]):
                p = read_place(line, gazetteer) if city == "\x00" else read_place(line or "-", gazetteer, city or "", state or "", zip_code or "")
                code = (state or "").strip().upper()
                rows.append((key, p.town, p.state or (STATES.get(code, code) if city != "\x00" else ""), f"B{p.box}" if p.box else f"{p.number} {p.street.replace(' ', '')}" if p.number else ""))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.record_batch([pa.array(c, pa.string()) for c in columns], ["id", "town", "place_state", "spot"])

    return run


def _ein(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) == 9, digits)


def bodies(organization: DataFrame, address: DataFrame, political: DataFrame, towns) -> tuple[DataFrame, DataFrame]:
    """Both tables as (id, names, town, state, spot, date, ein)."""
    none = F.lit("\x00")
    where = organization.select("id", F.col("primary_address_id").alias("k")).join(shuffled(address.select(F.col("id").alias("k"), F.col("raw_address").alias("line"))), "k").select("id", "line", none.alias("city"), none.alias("state"), none.alias("zip"))
    row = "id string, town string, place_state string, spot string"
    org_place = where.dropDuplicates(["id"]).mapInArrow(_place_reader(towns), row)
    ein = F.get(F.filter(F.map_entries("identifiers"), lambda e: F.lower(e["key"]) == "ein"), F.lit(0))["value"]
    state = F.upper(blank_to_null(F.col("registered_state")))
    orgs = organization.select("id", F.array_compact(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("name_variants", F.array().cast("array<string>"))))).alias("names"), F.col("formation_date").alias("date"), _ein(ein).alias("ein"), state.alias("own_state"))
    orgs = orgs.join(shuffled(org_place), "id", "left").select("id", "names", F.coalesce("town", F.lit("")).alias("town"), F.coalesce("own_state", F.nullif("place_state", F.lit(""))).alias("state"), F.coalesce("spot", F.lit("")).alias("spot"), "date", "ein")
    mail_line = F.concat_ws(", ", blank_to_null(F.col("mailing_address_1")), blank_to_null(F.col("mailing_address_2")))
    use_mail = blank_to_null(F.col("mailing_address_city")).isNotNull() | blank_to_null(F.col("mailing_address_zip")).isNotNull() | blank_to_null(F.col("business_address_city")).isNull()
    line = F.when(use_mail, mail_line).otherwise(F.concat_ws(", ", blank_to_null(F.col("business_address_1")), blank_to_null(F.col("business_address_2"))))
    pick = lambda c: F.when(use_mail, F.col(f"mailing_address_{c}")).otherwise(F.col(f"business_address_{c}"))
    filed = political.select("id", F.array_compact(F.array("name")).alias("names"), F.col("established_date").alias("date"), _ein(F.col("ein")).alias("ein"), line.alias("line"), F.coalesce(pick("city"), F.lit("")).alias("city"), F.coalesce(pick("state"), F.lit("")).alias("state"), pick("zip").alias("zip"))
    filed_place = filed.select("id", "line", "city", "state", "zip").dropDuplicates(["id"]).mapInArrow(_place_reader(towns), row)
    filed = filed.drop("line", "city", "state", "zip").join(shuffled(filed_place), "id").select("id", "names", "town", F.nullif("place_state", F.lit("")).alias("state"), "spot", "date", "ein")
    return orgs, filed


_BODY = ("id", "town", "state", "spot", "date", "ein")


def _keyed(side: DataFrame, attributes: list[Column], left: bool) -> DataFrame:
    """(key, row, v0..): a side's index, one row per attribute and pair of segments (even keys) or initials (odd keys).

    Initials are looked up across: a name that is itself initials meets the spelt-out names
    of the other side under role 0 (left initials) or 1 (right initials).
    """
    s = "l" if left else "r"
    one = side.select("row", "kind", "bits", "initials", F.explode(F.array_compact(F.array(*attributes))).alias("attribute"))
    roles = F.when(F.col("kind") == "A", F.array(*[F.lit(i) for i in ((0,) if left else (0, 1))])).otherwise(F.array(F.lit(1 if left else 0)))
    spelt = F.flatten(F.transform(roles, lambda r: F.transform("initials", lambda i: F.xxhash64(F.col("attribute"), F.lit("initials"), r, i))))
    packed = [(F.get("bits", F.lit(2 * i)).cast("long") + F.shiftleft(F.get("bits", F.lit(2 * i + 1)).cast("long"), WIDTH)).alias(f"{s}{i}") for i in range(SEGMENTS // 2)]
    return one.select(F.explode(F.concat(F.transform(index_keys(F.col("bits"), F.col("attribute")), lambda k: k.bitwiseAND(F.lit(-2))), F.transform(spelt, lambda k: k.bitwiseOR(F.lit(1))))).alias(f"{s}key"), F.col("row").alias(s), *packed)


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): rows of both sides, by ``row``, whose names are close or initials of each other, in one town, quarter or state.

    Rows of known town meet in the town. A row of unknown town meets the other side's rows
    of its quarter, of the next and the last; where one of the two has no date, those of its
    state. The attributes of such meetings are made only if a side has a row without town.
    """
    slot = F.floor(F.unix_date("date") / DAYS)
    town, dated = F.nullif("town", F.lit("")), F.col("date").isNotNull()
    tag = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    attributes: list[list[Column]] = [[tag("T", town)], [tag("T", town)]]
    for k, (asking, limit) in enumerate(((left, 0), (right, 1))):
        if not asking.filter("town = ''").take(1):
            continue
        lost = town.isNull()
        attributes[limit] += [F.when(lost, tag(f"D{k}", slot + i)) for i in (-1, 0, 1)] + [F.when(lost, F.when(dated, tag(f"B{k}", F.col("state"))).otherwise(tag(f"A{k}", F.col("state"))))]
        # a pair without both towns is asked for by its left row
        other = F.lit(True) if k == 0 else town.isNotNull()
        attributes[1 - limit] += [F.when(other, tag(f"D{k}", slot)), F.when(other, tag(f"A{k}", F.col("state"))), F.when(other & ~dated, tag(f"B{k}", F.col("state")))]
    x, y = _keyed(left, attributes[0], True), _keyed(right, attributes[1], False)
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"l{i}").bitwiseXOR(F.col(f"r{i}"))) for i in range(SEGMENTS // 2)])
    return x.join(shuffled(y), F.col("lkey") == F.col("rkey")).filter((apart <= RADIUS) | (F.col("lkey").bitwiseAND(F.lit(1)) == 1)).select("l", "r").distinct()


def scored_pairs(organization: DataFrame, address: DataFrame, political: DataFrame) -> DataFrame:
    """(organization_id, political_organization_527_id, score, witness) of every pair that may match."""
    spark = organization.sparkSession
    cities = [political.select(F.col(f"{p}_address_city").alias("city"), F.col(f"{p}_address_zip").alias("zip")) for p in ("mailing", "business")]
    towns = share_towns(cities[0].unionByName(cities[1]))
    orgs, filed = (materialize(t, "bodies") for t in bodies(organization, address, political, towns))
    texts = orgs.select(F.explode("names").alias("name")).unionByName(filed.select(F.explode("names").alias("name")))
    # few bytes, but each name costs Python time: partitions of names are not coalesced
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct, vocabulary = with_org_words(texts, texts.filter("name is not null").repartition(spread, "name").distinct())
    read = materialize(distinct.mapInArrow(_name_reader(vocabulary), _NAME_ROW), "names")
    counted = read.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()  # at most 38 ** 3 padded trigrams
    counts = spark.sparkContext.broadcast((read.count(), {r["gram"]: r["n"] for r in counted}, uuid.uuid4().hex))
    # rows meet under a hash of body and name; whatever shares a hash is joined back and compared in full
    sides = [materialize(t.select(*_BODY, F.explode("names").alias("name")).join(shuffled(read.drop("grams")), "name").withColumn("row", F.xxhash64("id", "name")), "body-names") for t in (orgs, filed)]
    pairs = materialize(candidates(*sides), "candidates")
    named = lambda t, s: t.select(F.col("row").alias(s), F.col("id").alias({"l": "o", "r": "f"}[s]), *[F.col(c).alias(f"{'a' if s == 'l' else 'b'}_{c}") for c in _SIDE], F.col("bits").alias(f"{s}bits"))
    both, size = (reduce(lambda x, y: x + y, [f(i) for i in range(SEGMENTS)]) for f in (lambda i: F.bit_count(F.get("lbits", F.lit(i)).bitwiseAND(F.get("rbits", F.lit(i)))), lambda i: F.bit_count(F.get("lbits", F.lit(i))) + F.bit_count(F.get("rbits", F.lit(i)))))
    met = pairs.join(shuffled(named(sides[0], "l")), "l").join(shuffled(named(sides[1], "r")), "r").withColumn("bits_dice", 2.0 * both / F.greatest(size, F.lit(1)))
    liked = met.select("o", "f", "bits_dice", *[f"{s}_{c}" for s in "ab" for c in _SIDE]).mapInArrow(_likeness(counts), "o string, f string, bits double, words double")
    best = liked.groupBy("o", "f").agg(F.max("bits").alias("bits"), F.max("words").alias("words"))
    body = lambda t, key, s: t.select(F.col("id").alias(key), *[F.col(c).alias(f"{s}_{c}") for c in _BODY[1:]]).dropDuplicates([key])
    one = materialize(best.join(shuffled(body(orgs, "o", "o")), "o").join(shuffled(body(filed, "f", "f")), "f"), "met")
    days = F.abs(F.datediff("o_date", "f_date"))
    same_town = (F.col("o_town") != "") & (F.col("o_town") == F.col("f_town"))
    clash = F.coalesce(F.col("o_state") != F.col("f_state"), F.lit(False))
    # a date far off, or another state, speaks against a pair of unknown town
    one = one.withColumn("days", days).withColumn("same_town", same_town).filter(same_town | (~clash & (F.coalesce("days", F.lit(0)) <= DAYS)))
    one = one.withColumn("placed", F.col("same_town") | F.coalesce(F.col("days") <= DAYS, F.lit(False)))
    one = _with_rivals(materialize(one, "possible"))
    dice = {
        "bits": F.col("bits"),
        "words": F.col("words"),
        "town": F.when(F.col("same_town"), F.lit(1.0)),
        "address": F.when((F.col("o_spot") != "") & (F.col("f_spot") != ""), (F.col("o_spot") == F.col("f_spot")).cast("double")),
        "date": F.when(F.col("days").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("days") / F.lit(2.0 * DAYS))),
        "state": F.when(F.col("o_state").isNotNull() & F.col("f_state").isNotNull(), (F.col("o_state") == F.col("f_state")).cast("double")),
        "rivals": F.col("rivals"),
    }
    got = reduce(lambda x, y: x + y, [F.coalesce(dice[k], F.lit(UNKNOWN)) * w for k, w in FIELD_WEIGHTS.items()])
    witness = F.when(F.col("o_ein").isNotNull() & F.col("f_ein").isNotNull(), (F.col("o_ein") == F.col("f_ein")).cast("int"))
    return one.select(F.col("o").alias("organization_id"), F.col("f").alias("political_organization_527_id"), (got / sum(FIELD_WEIGHTS.values())).alias("score"), witness.alias("witness"))


def _with_rivals(pairs: DataFrame) -> DataFrame:
    """Adds ``rivals``: 1 for pairs that town or date place, else less the more places could claim the body.

    A body whose town is unknown, but which town or date places elsewhere, stands there; the
    other registrations of its name are other bodies. A registration that has a placed
    partner is hardly the one a body of unknown place means.
    """
    good = F.col("placed") & (F.col("words") > 0.5)
    of_o = pairs.groupBy("o").agg(F.max(F.when(good, F.col("f_town"))).alias("settled"), F.count_distinct(F.when(~F.col("placed"), F.col("f_town"))).alias("places"))
    of_f = pairs.groupBy("f").agg(F.max(F.when(good, 1)).alias("partner"), F.max(F.when(good, F.col("o_town"))).alias("f_settled"))
    seen = pairs.join(shuffled(of_o), "o").join(shuffled(of_f), "f")
    elsewhere = (F.coalesce("settled", F.lit("")) != "") & (F.col("f_town") != "") & (F.col("settled") != F.col("f_town"))
    elsewhere_f = (F.coalesce("f_settled", F.lit("")) != "") & (F.col("o_town") != "") & (F.col("f_settled") != F.col("o_town"))
    at_home = F.coalesce((F.col("settled") != "") & (F.col("settled") == F.col("f_town")), F.lit(False))
    weak = F.when(elsewhere | elsewhere_f, F.lit(0.0)).when(at_home, F.lit(0.9)).when(F.col("partner").isNotNull(), F.lit(0.0)).otherwise(0.9 / F.greatest(F.col("places"), F.lit(1)))
    return seen.withColumn("rivals", F.when(F.col("placed"), F.lit(1.0)).otherwise(weak)).drop("settled", "places", "partner", "f_settled")


def calibrate(bins: list[tuple[int, int, int]]) -> tuple[list[float], float]:
    """Confidence at the middle of each score bin, and the EIN agreement of sure pairs, from (bin, pairs with both EINs, pairs with equal EINs).

    The share of equal EINs is divided by what the surest pairs reach, smoothed by a prior
    that rises with the score, and made monotone by pooling adjacent violators.
    """
    seen = {b: (n, e) for b, n, e in bins}
    top_n = sum(n for b, (n, e) in seen.items() if b >= BINS - BINS // 5)
    top_e = sum(e for b, (n, e) in seen.items() if b >= BINS - BINS // 5)
    sure = (top_e + 0.85 * PRIOR) / (top_n + PRIOR)
    blocks: list[list[float]] = []
    for b in range(BINS):
        n, e = seen.get(b, (0, 0))
        prior = max(0.01, min(0.98, ((b + 0.5) / BINS - 0.5) / 0.4))
        value = (min(1.0, e / n / sure) * n if n else 0.0) + prior * PRIOR
        blocks.append([value, n + PRIOR, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            v, w, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + w, blocks[-1][2] + k]
    return [min(0.999, v / w) for v, w, k in blocks for _ in range(int(k))], sure


def confidence(score: Column, witness: Column, levels: list[float], sure: float) -> Column:
    """Calibrated confidence, straight between the middles of the bins, updated by the pair's own EINs."""
    at = F.least(F.greatest(score * BINS - 0.5, F.lit(0.0)), F.lit(BINS - 1.0))
    low = F.floor(at).cast("int")
    level = F.array(*[F.lit(x) for x in [*levels, levels[-1]]])
    p = F.get(level, low) + (at - low) * (F.get(level, low + 1) - F.get(level, low))
    ratio = F.when(witness == 1, F.lit(sure / CHANCE)).when(witness == 0, F.lit((1 - min(sure, 0.98)) / (1 - CHANCE))).otherwise(F.lit(1.0))
    return p * ratio / (p * ratio + 1 - p)


def _fitted(pairs: DataFrame, own_ein: bool) -> tuple[DataFrame, Column]:
    """The pairs with ``p``, and the agreement of sure pairs: each half of the organisations is calibrated on the other half, so no pair vouches for itself."""
    half = F.pmod(F.xxhash64("organization_id"), F.lit(2))
    slot = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    rows = pairs.filter("witness is not null").groupBy(half.alias("half"), slot.alias("bin")).agg(F.count("*").alias("n"), F.sum("witness").alias("e")).collect()  # at most twice BINS rows
    fits = [calibrate([(r["bin"], r["n"], r["e"]) for r in rows if r["half"] != h]) for h in (0, 1)]
    witness = F.col("witness") if own_ein else F.lit(None).cast("int")
    p, sure = (F.when(half == 0, x).otherwise(y) for x, y in (tuple(confidence(F.col("score"), witness, *f) for f in fits), tuple(F.lit(f[1]) for f in fits)))
    return pairs.withColumn("p", p), sure


def all_pairs(organization: DataFrame, address: DataFrame, political: DataFrame) -> DataFrame:
    """(organization_id, political_organization_527_id, confidence) of every pair that town, date or state admits."""
    pairs, _ = _fitted(materialize(scored_pairs(organization, address, political), "scored"), own_ein=True)
    return pairs.select("organization_id", "political_organization_527_id", F.round("p", 4).alias("confidence"))


def matches(organization: DataFrame, address: DataFrame, political: DataFrame) -> DataFrame:
    """The pairs of at least ``LEAST`` confidence."""
    return all_pairs(organization, address, political).filter(F.col("confidence") >= LEAST)


def reliability(organization: DataFrame, address: DataFrame, political: DataFrame) -> DataFrame:
    """(decile, pairs, expected, agreeing): held-out check of the calibration.

    The agreement of EINs, in terms of what sure pairs reach, beside the mean confidence
    that the other half of the organisations gives the pair without its own EINs.
    """
    pairs, sure = _fitted(materialize(scored_pairs(organization, address, political), "scored"), own_ein=False)
    held = pairs.filter("witness is not null").withColumn("sure", sure)
    return held.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("decile")).agg(F.count("*").alias("pairs"), F.round(F.avg("p"), 4).alias("expected"), F.round(F.least(F.avg(F.col("witness") / F.col("sure")), F.lit(1.0)), 4).alias("agreeing"))
