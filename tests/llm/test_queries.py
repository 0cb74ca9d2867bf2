import pytest

from tallybook.llm import queries as Q
from tallybook.llm import tokenizer
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_agrees_with_sql(name, spark, data):
    assert_same(Q.QUERIES[name], Q.SQL[name], spark, data)


def _rows(name, spark, data):
    return [tuple(r) for r in Q.QUERIES[name](spark, data).collect()]


@pytest.mark.parametrize("n", ["p2", "p4"])
def test_pairs_and_classes_tell_the_same(n, spark, data):
    pairs = _rows(f"{n}_found", spark, data)
    classes = {i: (c, links) for i, c, links in _rows(f"{n}_classes", spark, data)}
    assert pairs and len(set(pairs)) == len(pairs) and all(a < b for a, b in pairs)
    joined = {frozenset((classes[a][0], classes[b][0])) for a, b in pairs}
    across = {c for j in joined if len(j) == 2 for c in j}
    assert across == {c for c, links in classes.values() if links}
    assert all(classes[a][1] and classes[b][1] for a, b in pairs if classes[a][0] != classes[b][0])


def test_survivors_are_members(spark, data):
    group = dict(_rows("p5_found", spark, data))
    found, fused = _rows("p6_found", spark, data), _rows("p6_fused", spark, data)
    assert found and all(group[p] == g for g, _, p in found)
    assert len({(g, f) for g, f, _ in found}) == len(found) and {(g, f) for g, f, _ in found} == {(g, f) for g, f, *_ in fused}
    decided = {f: (items, contested, votes, turned) for f, items, contested, votes, turned in _rows("p6_decisions", spark, data)}
    assert all(sum(f == field for _, field, _ in found) == n[0] and n[1] == n[2] + n[3] for f, n in decided.items())


def test_matches_reach_the_confidence(spark, data):
    confidence = {(o, f): c for o, f, c in _rows("p7_matches", spark, data)}
    found = _rows("p7_found", spark, data)
    assert found and set(found) == {p for p, c in confidence.items() if c >= 0.5} and all(0 <= c < 1 for c in confidence.values())
    assert all(0 <= e <= 1 and 0 <= a <= 1 and n > 0 for _, n, e, a in _rows("p7_reliability", spark, data))


def test_ids_equal_the_public_library(spark, data):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer.VOCABULARY)
    lib.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = _rows("p8_ids", spark, data)
    assert len(got) == len(texts) and all(list(ids) == lib.encode(texts[i], add_special_tokens=False).ids for i, ids in got)


def test_leaks_are_whole(spark, data):
    found = _rows("p9_found", spark, data)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()}
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    exact = {(d, i) for d, t in texts.items() if t for i, e in items.items() if any(" ".join(words(e)[k : k + 20]) in " ".join(words(t)) for k in range(max(0, len(words(e)) - 19)))}
    assert len(set(found)) == len(found) and exact <= set(found)


def test_rates_count_the_cut(spark, data):
    found, rates = _rows("p10_found", spark, data), _rows("p10_rates", spark, data)
    texts = spark.read.parquet(f"{data}/documents.parquet").filter("text is not null").count()
    assert found and sum(r[2] for r in rates) == len(found) == len(set(found)) and sum(r[1] for r in rates) == texts and all(r[3] <= r[2] for r in rates)
