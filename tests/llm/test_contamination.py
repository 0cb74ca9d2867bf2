import random

from tallybook.llm import contamination as C


def _brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        prev, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (p != t))
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        p, t = [rng.randrange(6) for _ in range(rng.randrange(1, 25))], [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        assert min(C.myers(p, t, 10), 11) == min(_brute_distance(p, t), 11)


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([19, 30, 45])))) for i in range(12)] + [(90, None), (91, ""), (92, "short one")]
    docs = []
    for d in range(80):
        words = rng.choices(vocab, k=40)
        _, text = items[rng.randrange(12)]
        run = text.split()
        start = rng.randrange(max(1, len(run) - 22))
        quote = run[start : start + rng.choice([12, 20, 24, 30])]
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(quote))
            quote = quote[:k] + (["zz"] if rng.random() < 0.5 else []) + quote[k + 1 :]
        docs.append((d, (" ".join(words[:20]) + ", " + "\n".join(quote).upper() + ". " + " ".join(words[20:])), "clash"))
    docs += [(200, None, "c"), (201, "", "c"), (202, docs[0][1], "c")]
    want = set()
    for d, text, _ in docs:
        seq = C.words(text)
        for i, t in items:
            run = C.words(t)
            if any(_brute_distance(run[s : s + 20], seq) <= C.BUDGET for s in range(len(run) - 19)):
                want.add((d, i))
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    held = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in C.leaks(frame, held).collect()} == want and want
    assert {tuple(r) for r in C.leaks(frame, held, block_words=100).collect()} == want  # several passes


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert C.leaks(docs, items).count() == 0 and C.leaks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), items).count() == 0


def test_words():
    assert C.words("Don’t pay $1,234.50 — Café-bar!") == ["dont", "pay", "123450", "cafe", "bar"] and C.words(None) == []
