import pytest

from tallybook.plans import publish as P


def test_versions_and_pointer(spark, tmp_path):
    root = f"file://{tmp_path}/rollup"
    with pytest.raises(LookupError):
        P.current(spark, root)
    one = P.publish(spark.range(5), root)
    two = P.publish(spark.range(7).repartition(3), root)
    assert P.current(spark, root, 60).count() == 7 and P.pointer_of(spark, root) == two and one["fingerprint"] != two["fingerprint"]
    assert P.fingerprint(spark.range(7)) == two["fingerprint"] and P.fingerprint(spark.range(0)) == "0-0-0"
    with pytest.raises(LookupError):
        P.current(spark, root, -1)


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1), ('say "hi", all', None)], "a string, b int")
    P.export(df.coalesce(1), str(tmp_path / "c"))
    assert {tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()} == {("'=1+1", "1"), ('say "hi", all', None)}
    P.export(df.coalesce(1), str(tmp_path / "j"), "json")
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))


def test_loads_go_on_where_they_stopped(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    (source / "a.csv").write_text("id,day\n1,2024-01-01\n2,2019-01-01\n")
    for _ in range(2):
        P.load_batches(spark, str(source), "id int, day date", target, mark, "day >= date'2020-01-01'")
    (source / "b.csv").write_text("id,day\n3,2024-02-01\n")
    P.load_batches(spark, str(source), "id int, day date", target, mark, "day >= date'2020-01-01'")
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 3]
