import datetime as dt
import random

from tallybook.operators import snapshot_diff as S

SCHEMA = "id string, data_source_id string, source_record_key string, raw_fields map<string,string>, pull_date timestamp, created_at timestamp, feed_kind string, k string, bucket long, day string"


def _rows(spark, rows):
    full = [(str(i), f, k, raw, dt.datetime(2024, 1, day), dt.datetime(2024, 1, day, 1), kind, "clash", 1, "clash") for i, (f, day, k, raw, kind) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def _found(df):
    return {tuple(r) for r in df.collect()}


def test_changes_and_edge_cases(spark):
    rows = [
        ("s", 1, "a", {"x": "1"}, "full"), ("s", 1, "b", {"x": "1", "y": " "}, "full"), ("s", 1, "c", None, "full"), ("s", 1, None, {"x": "9"}, "full"),
        ("s", 2, " A\t", {"x": "1 "}, "full"), ("s", 2, "b", {"x": "1"}, "full"), ("s", 2, "b", {"x": "1"}, "full"), ("s", 2, "d", {"x": "1"}, "full"), ("s", 2, "", {"x": "2"}, "full"),
        ("s", 3, "a", {"x": "2"}, "full"), ("s", 3, "b", {"x": "1", "z": "n"}, "full"), ("s", 3, "d", {"x": "1"}, "full"),
        ("i", 1, "q", {"x": "1"}, "incremental"), ("i", 2, "r", {"x": "1"}, "incremental"), (None, 2, "r", {"x": "1"}, "full"), ("one", 2, "r", {"x": "1"}, "full"),
    ]
    assert _found(S.snapshot_changes(_rows(spark, rows))) == {("s", "C", "2024-01-02", "removed"), ("s", "D", "2024-01-02", "added"), ("s", "A", "2024-01-03", "changed"), ("s", "B", "2024-01-03", "changed")}


def test_empty(spark):
    assert S.snapshot_changes(_rows(spark, [])).count() == 0


def test_failed_buckets_are_enlarged(spark):
    rng = random.Random(7)
    rows = [("s", day, f"k{i}", {"x": str(i if rng.random() < 0.5 else rng.random()), "long": "y" * (20_000 if i == 0 else 1)}, "full") for day in (1, 2, 3) for i in range(300) if rng.random() < 0.9]
    frame = _rows(spark, rows)
    want = set()
    state = {day: {k.upper(): raw for f, d, k, raw, kind in rows if d == day} for day in (1, 2, 3)}
    for day in (2, 3):
        a, b = state[day - 1], state[day]
        want |= {("s", k, f"2024-01-0{day}", "added") for k in b.keys() - a.keys()} | {("s", k, f"2024-01-0{day}", "removed") for k in a.keys() - b.keys()}
        want |= {("s", k, f"2024-01-0{day}", "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    # 6 cells for 128 rows cannot be peeled: every bucket goes through the enlargements and the exact comparison
    assert _found(S.snapshot_changes(frame, cells=6)) == want
    assert _found(S.snapshot_changes(frame)) == want
