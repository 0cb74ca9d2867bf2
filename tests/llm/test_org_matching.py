import datetime as dt
import random

from tallybook.llm import name_matching
from tallybook.llm import org_matching as O
from tallybook.plans.stage import materialize

ORG = "id string, canonical_name string, name_variants array<string>, identifiers map<string,string>, registered_state string, formation_date date, primary_address_id string, names string"
FILED = "id string, name string, ein string, established_date date, mailing_address_1 string, mailing_address_2 string, mailing_address_city string, mailing_address_state string, mailing_address_zip string, business_address_1 string, business_address_2 string, business_address_city string, business_address_state string, business_address_zip string, date date"


def test_index_finds_every_close_pair(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = []
    for _ in range(200):
        a = [rng.getrandbits(O.WIDTH) for _ in range(O.SEGMENTS)]
        b = list(a)
        for k in rng.sample(range(O.BITS), rng.randrange(0, O.RADIUS + 1)):
            b[k // O.WIDTH] ^= 1 << k % O.WIDTH
        rows.append((a, b))
    frame = spark.createDataFrame(rows, "a array<int>, b array<int>")
    keys = [O.index_keys(F.col(c), F.lit("Ttown")) for c in "ab"]
    assert frame.filter(F.arrays_overlap(*keys)).count() == 200
    assert frame.filter(F.arrays_overlap(keys[0], O.index_keys(F.col("a"), F.lit("Tother")))).count() == 0


def test_vectors_of_one_edit_are_close():
    a, b = O.encode(("OAK", "TIMBER")), O.encode(("TIMBRE", "OAK"))
    assert sum((x ^ y).bit_count() for x, y in zip(a, b)) <= O.RADIUS and O.encode(("OAK", "TIMBER")) == O.encode(("TIMBER", "OAK"))


def test_calibration_is_monotone():
    levels, sure = O.calibrate([(3, 50, 5), (9, 40, 30), (14, 100, 60), (19, 200, 170)])
    assert len(levels) == O.BINS and levels == sorted(levels) and 0 <= levels[0] and levels[-1] < 1 and 0.8 < sure < 0.9
    assert len(O.calibrate([])[0]) == O.BINS


def test_own_ein_updates_the_confidence(spark):
    from pyspark.sql import functions as F

    levels, sure = O.calibrate([])
    frame = spark.createDataFrame([(0.7, 1), (0.7, 0), (0.7, None), (0.71, None)], "score double, witness int")
    equal, other, unknown, higher = [r["c"] for r in frame.select(O.confidence(F.col("score"), F.col("witness"), levels, sure).alias("c")).collect()]
    assert other < unknown < higher < equal


def _tables(spark):
    day = dt.date
    orgs = [("o1", "Oak Timber Inc", ["OTI"], {"EIN": "12-3456789"}, "NC", day(2001, 1, 1), "a1", "c"), ("o2", "Oak Timber Inc", None, {}, "VA", day(2010, 1, 1), "a2", "c"), ("o3", "Elm Printing Assn", [], None, "NC", day(2005, 5, 5), None, "c"), ("o4", None, None, None, None, None, None, "c"), ("o5", "Fir Motors Co", None, {"ein": "99-9999999"}, "NC", None, None, "c")]
    address = [("a1", "1 Elm St, Inklerham, NC 64099", "c"), ("a2", "2 Elm St, Campas Mills, VA 28033", "c"), ("a9", None, "c")]
    mail = lambda town, state, z: ("1 Elm Street", None, town, state, z, None, None, None, None, None, None)
    filed = [("f1", "OAK TIMBRE INCORPORATED", "123456789", day(2001, 1, 9), *mail("INKLERHAM", "NC", "64099")), ("f2", "Association of Elm Printing", None, day(2005, 5, 20), *mail("Inklerham", "NC", None)), ("f3", "Elm Printing Assn", None, day(1999, 1, 1), *mail("Inklerham", "NC", None)), ("f4", "Fir Motors Inc", "999999999", None, *mail("Inklerham", "NC", None)), ("f5", None, None, None, *mail(None, None, None)), ("f6", "Oak Timber", None, None, *mail("INKLERHAM", "NC", "64099"))]
    return spark.createDataFrame(orgs, ORG), spark.createDataFrame(address, "id string, raw_address string, line string"), spark.createDataFrame(filed, FILED)


def test_matches(spark):
    got = {(r[0], r[1]): r[2] for r in O.matches(*_tables(spark)).collect()}
    assert set(got) == {("o1", "f1"), ("o1", "f6"), ("o3", "f2")} and all(0 <= c < 1 for c in got.values())


def test_empty(spark):
    assert O.matches(*(t.limit(0) for t in _tables(spark))).count() == 0


def test_no_table_passes_through_the_driver(spark, monkeypatch):
    """Joins of tables that grow with the input shuffle, whatever size Spark guesses from their files."""
    plans = []

    def kept(df, name="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    for module in (O, name_matching):
        monkeypatch.setattr(module, "materialize", kept)
    monkeypatch.setattr(O, "with_org_words", lambda names, rows: name_matching.with_org_words(names, rows, limit=-1))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1_000_000
    assert O.matches(*_tables(spark)).count() == 3
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
