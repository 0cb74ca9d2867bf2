import random

from tallybook.llm import components

SCHEMA = "absorbed_person_id string, canonical_person_id string, cluster_id string, a string, src string"


def _run(spark, links):
    frame = spark.createDataFrame([(a, b, "x", "clash", "clash") for a, b in links], SCHEMA)
    rows = components.person_groups(frame).collect()
    assert len(rows) == len({r["person_id"] for r in rows})
    return {r["person_id"]: r["group_id"] for r in rows}


def _brute(links):
    group = {}
    clean = [(a.strip().lower(), b.strip().lower()) for a, b in links if a and b and a.strip() and b.strip() and a.strip().lower() != b.strip().lower()]
    for a, b in clean:
        group[a], group[b] = a, b
    for _ in range(len(clean) + 1):
        for a, b in clean:
            group[a] = group[b] = min(group[a], group[b])
    return group


def test_random_chains_circles_and_a_hub(spark):
    rng = random.Random(1)
    links = [(f"r{rng.randrange(80)}", f"R{rng.randrange(80)}") for _ in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("c070", "c000")] + [(f"h{i}", "HUB") for i in range(120)]
    links += [("x", "x"), (None, "y"), ("z", None), ("", "q"), (" r1 ", "R2"), ("r1", "r2")]
    assert _run(spark, links) == _brute(links)


def test_empty_and_unlinked(spark):
    assert _run(spark, []) == {} and _run(spark, [("a", "A"), (None, None)]) == {}
