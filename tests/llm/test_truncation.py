import random

from tallybook.llm import truncation as T

ENDINGS = {
    "All is well.": "closed", 'He said "yes."': "closed", "All is well.\nSincerely,\nAnn Lee": "own", "All is well.\nTotal: $1,200": "own", "All is well.\nhttps://x.example/1": "own",
    "Items\n1. Item 3: mail\n2. Item 4: rent": "own", "All is well.\nPage 3 of 9": "own", "All is\nwell.\nPage\n3 of 9": "own", "All is well.\nEND OF RECORD": "own", "All is well.\ncc: Ann Lee": "own",
    "The clerk closed the rev": "line", "Fine.\n\nThe clerk closed": "open", "The clerk…": "mark", "The clerk...": "mark", "The clerk [...]": "mark", "We paid the\nbill for the": "open", "The clerk clo\x00\x00": "line",
    "Fine.\nAnn Lee": "bare", "See loan no.": "abbreviated", "": None, " \n": None,
}


def test_endings(spark):
    frame = spark.createDataFrame([(t,) for t in [*ENDINGS, None]], "text string")
    got = {r["text"]: r["kind"] for r in T.ending(frame).collect()}
    assert got == ENDINGS | {None: None}


def _documents(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        n = rng.randrange(50, 150)
        text = f"{i:04d}" + "x" * (n - 5) + "."  # copies of one text count once
        rows.append((i, text, "free", n, "c"))
        rows.append((1000 + i, text[:100] if n > 100 else text, None, min(n, 100), "c"))
    rows += [(9000, "Fine." + " " * 0 + "\n" + "Ann Lee", None, 1, "c"), (9001, "F" * 91 + ".\nAnn Lee", None, 1, "c"), (9002, None, "free", 0, "c"), (9003, "", "free", 0, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, unit string")


def test_limits_and_found(spark):
    docs = _documents(spark)
    limits = {(r["source"], r["n"]) for r in T.significant(T.lengths(T.read_endings(docs))).collect()}
    assert limits == {(None, 100)}
    found = {r["doc_id"] for r in T.found(docs).collect()}
    want = {r["doc_id"] for r in docs.filter("length(text) = 100 and text not like '%.'").select("doc_id").collect()}
    assert found == want  # 9001 is 100 long and ends in a bare name
    assert 9001 in found and 9000 not in found
    rates = {r["source"]: (r["texts"], r["cut"], list(r["limits"])) for r in T.rates(docs).collect()}
    assert rates[None] == (602, len(want), [100]) and rates["free"] == (601, 0, [])


def test_empty(spark):
    assert T.found(_documents(spark).limit(0)).count() == 0


def test_hazards_of_known_counts(spark):
    counts = spark.createDataFrame([("s", "chars", n, c) for n, c in [(10, 4), (11, 5), (12, 60), (13, 5), (14, 4), (200, 20)]], "source string, unit string, n int, c long")
    (limit,) = T.significant(counts, neighbours=2).filter("n < 100").collect()
    # 98, 94, 29 and 24 texts are at risk at the lengths around, 18 of them end there; 89 at risk here
    assert limit["n"] == 12 and abs(limit["expected"] - 18.5 / 245) < 1e-9 and abs(limit["hazard"] - 60 / 89) < 1e-9
    assert abs(limit["share"] - (1 - (18.5 / 245) / (60 / 89))) < 1e-9


def test_copies_make_no_limit(spark):
    rows = [(i, "x" * (60 + i % 40) + ".", "s") for i in range(200)] + [(1000 + i, "Done.\n" + "y" * 70 + ".\nAnn Lee", "s") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert T.found(docs).count() == 0


def test_learning_from_the_limits():
    counts = {(20, "bare"): 90, (20, "open"): 400, (20, "closed"): 10, (0, "closed"): 3000, (0, "bare"): 400, (0, "open"): 100}
    rho, cut, whole = T.learn(counts)
    assert T.posterior(20, "bare", rho, cut, whole) > 0.5 > T.posterior(0, "bare", rho, cut, whole)
    assert T.posterior(0, "open", rho, cut, whole) > 0.5
