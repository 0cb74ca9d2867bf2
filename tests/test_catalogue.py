import pytest

from tallybook.queries import catalogue, training
from tests.oracle import assert_same

ALL = catalogue.QUERIES | training.QUERIES
SQL = catalogue.SQL | training.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, spark, data):
    assert_same(ALL[name], SQL[name], spark, data)


def test_without_sql_are_known():
    assert set(ALL) - set(SQL) == {"linkage_clusters", "linkage_decisions", "p1_consistent_table", "p1_found", "soundex_blocks"}


def test_linkage_queries(spark, data):
    decided = ALL["linkage_decisions"](spark, data).collect()
    pairs = [(r["l"], r["r"]) for r in decided]
    assert pairs and len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs) and all(0 <= r["probability"] <= 1 for r in decided)
    level = {"match": (0.95, 1.01), "probable_match": (0.8, 0.95), "possible_match": (0.6, 0.8), "no_match": (-1, 0.6)}
    assert all(level[r["decision"]][0] - 1e-6 <= r["probability"] <= level[r["decision"]][1] + 1e-6 for r in decided)
    group = {x: x for p in pairs for x in p}
    for _ in range(50):
        for r in decided:
            if r["decision"] == "match":
                group[r["l"]] = group[r["r"]] = min(group[r["l"]], group[r["r"]])
    matched = {x for r in decided if r["decision"] == "match" for x in (r["l"], r["r"])}
    assert {r["id"]: r["component"] for r in ALL["linkage_clusters"](spark, data).collect()} == {x: group[x] for x in matched}


def test_consistent_table_keeps_every_row(spark, data):
    out = ALL["p1_consistent_table"](spark, data).collect()
    rows = {o: sum(r["rows"] for r in out if r["origin"] == o) for o in ("source_record", "real_transaction_export_adams")}
    assert rows == {t: spark.read.parquet(f"{data}/{t}.parquet").count() for t in rows} and all(r["filled"] > 0 and r["layout"] for r in out if r["feed"] and r["delivery"])


def _soundex(word):
    codes = {c: str(n) for n, cs in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in cs}
    out, last = word[0], codes.get(word[0], "")
    for c in word[1:]:
        code = codes.get(c, "")
        if code and code != last:
            out += code
        if c not in "HW":
            last = code
    return (out + "000")[:4]


def test_soundex_blocks(spark, data):
    rows = spark.read.parquet(f"{data}/organization.parquet").filter("canonical_name is not null").collect()
    want = {}
    for r in rows:
        word = r["canonical_name"].split(" ")[0].upper()
        if word.isalpha():
            k = (_soundex(word), r["registered_state"])
            want[k] = want.get(k, 0) + 1
    got = {(r["code"], r["state"]): r["n"] for r in ALL["soundex_blocks"](spark, data).collect()}
    assert want and all(got.get(k) == n for k, n in want.items() if k in got) and sum(k in got for k in want) > 0.9 * len(want)


def test_no_cartesian_products(spark, data):
    for name in ("donor_search_page_nested", "or_join_as_union", "interval_join", "size_buckets"):
        plan = ALL[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
