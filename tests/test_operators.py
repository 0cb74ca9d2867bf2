import itertools
import random

from pyspark.sql import functions as F

from tallybook.operators import linkage, provenance, similarity
from tallybook.sources import delimited
from tallybook.streaming import latest


def test_delimited(spark, tmp_path):
    (tmp_path / "a.txt").write_text("C1|Ann|01022024|5,000.10|\nC2|B\xe9a||x|\nC3|short\n\n", encoding="latin-1")
    layout = delimited.Layout(("id", "name", "day", "amount"), trailing_delimiter=True, dates={"day": "MMddyyyy|yyyy-MM-dd"}, decimals=("amount",))
    rows, bad = delimited.read_lines(spark, str(tmp_path / "a.txt"), layout)
    assert [(r["id"], r["name"], str(r["day"]), r["amount"] and float(r["amount"])) for r in rows.collect()] == [("C1", "Ann", "2024-01-02", 5000.1), ("C2", "B\xe9a", "None", None)]
    assert [r["line"] for r in bad.collect()] == ["C3|short"]


def test_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text('id,day\n1,27-SEP-24\n2,"x, y"\n3,a,b\n')
    rows, bad = delimited.read_csv(spark, str(tmp_path / "b.csv"), delimited.Layout(("id", "day"), ",", "UTF-8", header=True, dates={"day": "dd-MMM-yy"}))
    assert {(r["id"], str(r["day"])) for r in rows.collect()} == {("1", "2024-09-27"), ("2", "None")} and bad.count() == 1


def test_records(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1|a|b\nA|x|y|z\nH|skip\nA|x\n")
    out, rejected = delimited.read_records(spark, str(tmp_path / "c.txt"), {"1": delimited.Layout(("t", "p", "q")), "A": delimited.Layout(("t", "p", "q", "r", "s"))})
    assert out["1"].count() == 1 and [r["s"] for r in out["A"].collect()] == [None]
    assert {(r["line"], r["reason"]) for r in rejected.collect()} == {("H|skip", "unknown type"), ("A|x", "short row")}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(30)]
    pairs = [(a, b) for a, b in pairs if a != b]
    group = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["id"]: r["component"] for r in linkage.components(spark.createDataFrame(pairs, "l string, r string")).collect()}
    assert got == group


def test_training_recovers_match_share():
    rng = random.Random(5)
    patterns = {}
    for _ in range(5000):
        match = rng.random() < 0.1
        g = tuple(int(rng.random() < (0.95 if match else 0.1)) for _ in range(4))
        patterns[g] = patterns.get(g, 0) + 1
    prior, m, u = linkage.train(list(patterns.items()), [2, 2, 2, 2])
    assert abs(prior - 0.1) < 0.02 and all(x[1] > 0.9 for x in m) and all(x[1] < 0.15 for x in u)


def test_similarity(spark):
    assert abs(similarity.jaro_winkler_of("MARTHA", "MARHTA") - 0.961111) < 1e-5 and similarity.jaro_winkler_of("", "A") == 0.0
    one = spark.createDataFrame([("word", "two words"), ("", "x"), (None, "x")], "a string, b string").select(similarity.trigram_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert abs(one[0]["s"] - 4 / 11) < 1e-9 and one[1]["s"] == 0.0


def test_merge_columns(spark):
    rows = spark.createDataFrame([("k", 1, "a", "p"), ("k", 2, None, None), ("q", 1, None, "z")], "k string, n int, keep string, over string")
    got = {(r["k"], r["keep"], r["over"]) for r in provenance.merge_columns(rows, ["k"], ["n"], ["keep"], ["over"]).collect()}
    assert got == {("k", "a", None), ("q", None, "z")}


def test_stream_matches_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.parquet(str(tmp_path / "in" / "one"))
    stream = latest.read_stream(spark, str(tmp_path / "in" / "*"), events.schema)
    for _ in range(2):  # the second run finds nothing new
        latest.run_to_table(latest.windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(str(r["start"]), r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(str(r["start"]), r["event_type"]): r["n"] for r in events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n").collect()}
    assert got and all(want[k] == n for k, n in itertools.islice(got.items(), 1000))


def test_intermediates_are_swept(spark, tmp_path):
    from tallybook.plans import stage

    written = stage.materialize(spark.range(3))
    assert written.count() == 3
    left = stage.shared_folder(spark).removeprefix("file://") + "/tallybook/app-long-gone/x"
    import os

    os.makedirs(left)
    assert stage.sweep(spark, -1) == 1 and not os.path.exists(left) and written.count() == 3
    assert stage.sweep(spark, 3600) == 0


def test_name_based_uuids(spark):
    import uuid

    from pyspark.sql import functions as F

    from tallybook.functions.normalize import uuid5

    space = uuid.NAMESPACE_DNS
    names = ["", "Ann Lee", "ñandú", "x" * 5000]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(str(space), F.col("n")).alias("u")).collect()
    assert {r["n"]: r["u"] for r in rows} == {n: str(uuid.uuid5(space, n)) for n in names}
