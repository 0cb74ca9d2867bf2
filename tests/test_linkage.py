import random

from tallybook.operators import linkage, similarity
from tallybook.queries import records

DONORS = "id string, contributor_name_raw string, contributor_state string, zip5 string, contributor_employer string"


def _brute(rows, rules):
    """Pairs by comparing everything with everything, with the rules each meets."""
    out = {}
    for a in rows:
        for b in rows:
            hit = [n for n, cs in rules.items() if all(a[c] is not None and a[c] == b[c] for c in cs)]
            if a["id"] < b["id"] and hit:
                out[a["id"], b["id"]] = (hit[0], sorted(hit))
    return out


def test_every_rule_makes_pairs(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 3)  # hot blocks are split
    rng = random.Random(1)
    pick = lambda *xs: rng.choice([*xs, None])
    rows = [{"id": f"d{i:03}", "x": pick("A", "A", "B"), "y": pick("P", "Q"), "z": pick("1", "2", "3")} for i in range(60)]
    rules = {"one": ["x", "y"], "two": ["z"], "three": ["y", "z"]}
    got = linkage.blocked_pairs(spark.createDataFrame(rows, "id string, x string, y string, z string"), rules).select("l", "r", "rule", "rules").collect()
    assert len(got) == len({(r["l"], r["r"]) for r in got})
    assert {(r["l"], r["r"]): (r["rule"], r["rules"]) for r in got} == _brute(rows, rules)


def test_moved_within_the_state(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"o{i:03}", f"{rng.choice(['ANN', 'BOB', 'CARLA', 'DENNIS', 'EDITH', 'FRANK'])} {rng.choice('QRSTUV')} {rng.choice(['STONE', 'MILLER', 'OAKES'])}", "IN", f"4{i % 40:04}", f"FIRM {i % 23}") for i in range(120)]
    rows += [("p1", "GWENDOLYN HARTWELL", "IN", "46001", "ACME"), ("p2", "GWENDOLYN HARTWELL", "IN", "46999", "ACME"), ("p3", "GWENDOLYN HARTWELL", "OH", "44001", "ACME")]
    spark.createDataFrame(rows, DONORS).write.parquet(str(tmp_path / "donor_er_view.parquet"))
    got = {(r["l"], r["r"]): r for r in records.linkage_decisions(spark, str(tmp_path)).collect()}
    assert set(got) == set(_brute([r.asDict() for r in records._donors(spark, str(tmp_path)).collect()], records._RULES))
    assert got["p1", "p2"]["rule"] == "name_state" and ("p1", "p3") not in got


def test_a_fixed_field_is_no_evidence():
    """Agreement that the blocking rule itself demands leaves the other strata's fields alone."""
    patterns = [("s", (0, 0, -1), 90000), ("s", (0, 1, -1), 700), ("s", (1, 1, -1), 700), ("s", (1, 0, -1), 200), ("z", (0, 0, 0), 1600), ("z", (1, 1, 1), 580), ("e", (0, -1, 0), 4000), ("e", (1, -1, 1), 60)]
    priors, m, u = linkage.train_strata(patterns, [2, 2, 2])
    assert priors["s"] < 0.03 < priors["z"] and all(x[1] > y[1] for x, y in zip(m, u))


def test_chance_agreement_from_random_pairs(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(f"r{i:04}", i % 4, None if i % 10 == 0 else "x") for i in range(400)], "id string, color int, note string")
    pairs = linkage.random_pairs(rows, pairs=20_000)
    assert 15_000 < pairs.count() < 25_000 and pairs.select("a_id", "b_id").distinct().count() == pairs.count()
    level = lambda c: F.when(F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull(), -1).when(F.col(f"a_{c}") == F.col(f"b_{c}"), 1).otherwise(0).alias(c)
    u = linkage.sampled_u(pairs.select(level("color"), level("note")), ["color", "note"], [2, 2])
    assert abs(u[0][1] - 0.25) < 0.03 and u[1][1] > 0.99 and all(abs(sum(x) - 1) < 0.01 for x in u)
    priors, m, known = linkage.train_strata([("s", (1, 1), 50), ("s", (0, 1), 950)], [2, 2], u)
    assert known == u and 0 < priors["s"] < 1 and len(m) == 2


def test_weakest_links(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.96), ("d", "e", 0.97)], "l string, r string, probability double")
    got = {tuple(r) for r in linkage.weakest_links(linkage.components(pairs), pairs).collect()}
    assert got == {("a", 3, 0.96, "b", "c"), ("d", 2, 0.97, "d", "e")}


def test_threshold_override():
    import pytest

    from tallybook.functions.normalize import override_threshold

    assert override_threshold(None) == 0.8 and override_threshold(0.9) == 0.9 and override_threshold(1) == 1
    for bad in (0.8, 1.01, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            override_threshold(bad)


def test_names_that_cannot_be_alike_are_not_compared(spark, tmp_path, monkeypatch):
    """The bound never falls below the similarity, and of a large block only names above it are compared."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = ["ANN", "ANNA", "ÉVA-LU", "BOB", "STONE", "MISSISSIPPI", "O'NEIL", "P.A.C.", "\U0001f600", "7TH", "COMMITTEE", "", " "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    rows = [(a, b) for a in texts for b in [*texts, a[::-1], a[1:], a[:3] + "X" + a[3:], None]]
    frame = spark.createDataFrame(rows, "a string, b string").withColumn("x", similarity.letters("a")).withColumn("y", similarity.letters("b"))
    got = frame.withColumn("bound", similarity.jaro_winkler_bound("x", "y")).select("a", "b", "bound").collect()
    assert all(r["bound"] is None if r["b"] is None else r["bound"] >= similarity.jaro_winkler_of(r["a"], r["b"]) for r in got)
    assert any(r["bound"] is not None and r["bound"] < 0.9 for r in got)
    donors = [(f"o{i:03}", f"{''.join(rng.sample('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 9))} JR" if i % 20 else f"GWENDOLYN HARTWELL{i} JR", "IN", f"4{i % 40:04}", f"FIRM {i % 23}") for i in range(200)]
    spark.createDataFrame(donors, DONORS).write.parquet(str(tmp_path / "donor_er_view.parquet"))
    asked = spark.sparkContext.accumulator(0)
    one = similarity._jaro_winkler_batch

    def counting(a, b):
        asked.add(len(a))
        return one(a, b)

    monkeypatch.setattr(similarity, "jaro_winkler", lambda a, b: F.pandas_udf(lambda x, y: counting(x, y), "double")(a, b))
    made = records._scored(spark, str(tmp_path)).count()
    assert made > 19_000 and asked.value < made / 10
