import json

import pytest
from pyspark.sql import functions as F

from tallybook.sources import documents as D


def test_xml(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<l><member><name>Ann</name><state>NC</state></member><member><name>Bo</name></member></l>")
    got = {(r["name"], r["state"]) for r in D.read_xml(spark, str(tmp_path / "r.xml"), "member", "name string, state string").collect()}
    assert got == {("Ann", "NC"), ("Bo", None)}


def test_features(spark, tmp_path):
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0]]]}
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"properties": {"NAME": "A"}, "geometry": shape}, {"attributes": {"REID": "7", "Owner": None}}]}))
    got = D.read_features(spark, str(tmp_path / "f.json")).collect()
    assert [dict(r["properties"]) for r in got] == [{"name": "A"}, {"reid": "7", "owner": None}] and json.loads(got[0]["geometry"]) == shape and got[1]["geometry"] is None


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "l.yaml").write_text("- name: {first: Ann}\n  terms:\n  - {type: rep, state: DC}\n- name: {first: Bo}\n  terms:\n  - {type: rep, state: NC}\n  - {type: sen, state: NC}\n")
    (tmp_path / "empty.yaml").write_text("")
    rows = D.read_yaml(spark, str(tmp_path))
    got = {r["first"]: r["chamber"] for r in rows.select(F.col("fields")["name.first"].alias("first"), D.chamber(F.col("fields")).alias("chamber")).collect()}
    assert got == {"Ann": "delegate", "Bo": "senate"}


def test_pages(spark, tmp_path):
    for page, ids in {1: [1, 2], 3: [2, 3]}.items():
        (tmp_path / f"p{page}.json").write_text(json.dumps({"results": [{"id": i, "v": f"{page}-{i}"} for i in ids], "pagination": {"page": page, "pages": 4}}))
    rows, gaps = D.read_pages(spark, str(tmp_path), "id: bigint, v: string", ["id"])
    assert {(r["id"], r["v"]) for r in rows.collect()} == {(1, "1-1"), (2, "3-2"), (3, "3-3")} and sorted(r["page"] for r in gaps.collect()) == [2, 4]


def test_fill_missing(spark):
    rows = spark.createDataFrame([("a", "x", 1, None), ("a", "y", 2, "late"), ("a", " ", 0, ""), ("b", None, 1, None)], "k string, bio string, p int, photo string")
    assert {tuple(r) for r in D.fill_missing(rows, ["k"], ["bio", "photo"], F.col("p")).collect()} == {("a", "x", "late"), ("b", None, None)}


def test_prune(spark):
    stored = spark.createDataFrame([(1, "n"), (2, "n")], "id int, seat string")
    kept, faults = D.prune_snapshot(stored, spark.createDataFrame([(1, "n")], "id int, seat string"), ["id"], ["seat"], 1)
    assert [r["id"] for r in kept.collect()] == [1] and faults.count() == 0
    kept, faults = D.prune_snapshot(stored, spark.createDataFrame([(1, "n"), (3, "n")], "id int, seat string"), ["id"], ["seat"], 1)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2] and [r["seat"] for r in faults.collect()] == ["n"]
