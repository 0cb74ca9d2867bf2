import datetime as dt

from tallybook.operators import schema_drift as S

SOURCE = "id string, data_source_id string, raw_fields map<string,string>, pull_date timestamp, field string, delivery string"
EXPORTS = "export_name string, exported_on date, transction_type string, transaction_type string, account_code string, declaration string, feed string"


def _source(spark, deliveries):
    rows = [(f"{d}-{i}", "f", raw, dt.datetime(2024, 1, d), "clash", "clash") for d, raws in deliveries.items() for i, raw in enumerate(raws)]
    return spark.createDataFrame(rows, SOURCE)


def _exports(spark, rows=()):
    return spark.createDataFrame(list(rows), EXPORTS)


def _found(df):
    return {tuple(r)[2:] for r in df.collect()}


def test_changes(spark):
    one = [{"ZIP": str(10000 + i), "Amount": f"{i}.50", "Flag": "Y", "Note": "x" if i == 0 else " ", "stray": "q"} if i == 0 else {"ZIP": str(10000 + i), "Amount": f"{i},000.50", "Flag": "no", "Note": "see"} for i in range(20)]
    two = [{"zip_code": str(20000 + i), "Amount": f"USD {i}", "Flag": "true", "Filed On": "01/02/2024"} for i in range(20)] + [None]
    got = _found(S.found(_source(spark, {1: one, 2: two}), _exports(spark)))
    assert got == {("2024-01-02", "renamed", "ZIP", "zip_code"), ("2024-01-02", "retyped", "Amount", ""), ("2024-01-02", "removed", "Note", ""), ("2024-01-02", "added", "Filed On", "")}


def test_export_columns(spark):
    d = dt.date
    rows = [("e", d(2024, 1, 1), "Individual", None, "A", " ", "c")] * 10 + [("e", d(2024, 2, 1), "", "Individual", "A", "yes", "c")] * 10 + [(None, d(2024, 2, 1), "x", None, None, None, "c"), ("e", None, "x", None, None, None, "c")]
    got = _found(S.found(_source(spark, {}), _exports(spark, rows)))
    assert got == {("2024-02-01", "renamed", "transction_type", "transaction_type"), ("2024-02-01", "added", "declaration", "")}


def test_empty(spark):
    assert S.found(_source(spark, {}), _exports(spark)).count() == 0


def test_consistent_table(spark):
    source = _source(spark, {1: [{"OWNER": "A", "Sum": "1,200"}] * 3, 2: [{"owner": "B", "Sum": "7.5"}] * 3, 3: [{"owner": "C", "Sum": "8", "New": "02/03/2024"}] * 20 + [{"OWNER": "D", "odd": "z"}]})
    out = {r["id"]: (dict(r["fields"]), dict(r["stray"])) for r in S.consistent_table(source, _exports(spark)).collect()}
    assert out["3-20"] == ({"New": None, "Sum": None, "owner": "D"}, {"odd": "z"})
    assert out["1-0"] == ({"New": None, "Sum": "1200", "owner": "A"}, {}) and out["2-1"][0]["owner"] == "B"
    assert out["3-0"][0] == {"New": "2024-02-03", "Sum": "8", "owner": "C"}


def test_consistent_table_of_exports(spark):
    d = dt.date
    rows = [("e", d(2024, 1, 1), "Individual", None, "A", " ", "c")] * 10 + [("e", d(2024, 2, 1), "", "Individual", "A", "yes", "c")] * 10
    source = _source(spark, {1: [{"OWNER": "A"}] * 3})
    out = S.consistent_table(source, _exports(spark, rows)).collect()
    assert len(out) == 23 and sum(r["origin"] == "source_record" for r in out) == 3
    got = {(r["delivery"], tuple(sorted(dict(r["fields"]).items()))) for r in out if r["origin"] != "source_record"}
    common = (("account_code", "A"), ("declaration", None), ("transaction_type", "Individual"))
    assert got == {("2024-01-01", common), ("2024-02-01", (common[0], ("declaration", "true"), common[2]))}


def test_rename_after_an_absence(spark):
    source = _source(spark, {1: [{"OWNER": "A", "Sum": "1"}] * 3, 2: [{"Sum": "2"}] * 3, 3: [{"OWNER": "C", "Sum": "3"}] * 3, 4: [{"owner": "D", "Sum": "4"}] * 3})
    out = {r["id"]: (dict(r["fields"]), dict(r["stray"])) for r in S.consistent_table(source, _exports(spark)).collect()}
    assert out["1-0"] == ({"Sum": "1", "owner": "A"}, {}) and out["2-0"] == ({"Sum": "2", "owner": None}, {}) and out["3-0"][0]["owner"] == "C"


def test_names():
    assert S.name_likeness("Account Code", "Acct Cd") > 0.9 and S.name_likeness("Employer", "Spouse Employer") < 0.5 and S.name_likeness("DEED_DATE", "deed_date") == 1.0
