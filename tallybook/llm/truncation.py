"""Text cut off by field limits (problem 10): length hazards and incomplete endings.

Per source and unit (characters, bytes) the discrete hazard of ending at a length, the
texts that end there over the texts at least as long, is tested against the hazard of
the neighbouring lengths; both come from window functions over the counts of distinct
texts per length. The Benjamini-Hochberg rule keeps the lengths that end too many texts,
the field limits; what exceeds the neighbours' hazard there is the share of cut texts.

Endings are sorted into kinds by their form alone. Which kinds are incomplete, and how
surely, is learnt from the significant lengths: expectation maximisation over the counts
per (share of cut texts, kind) estimates how cut and whole texts end and how often texts
break off at other lengths (transfers end anywhere). A text is cut if its ending is not a
complete one and the posterior, from its length's hazard and its kind, is one half or more.
The counts are a table of at most ``BINS + 1`` rows for each of the kinds; the pseudo-counts
``CUT`` and ``WHOLE`` stand in where a small corpus shows nothing.

Edge cases: null, empty and blank texts are not cut; a null source is a source of its
own; of repeated texts each row comes out, but copies of one text in a source count once
in the hazards; very long texts are read whole; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.plans.stage import broadcast_if_small, materialize

#: Lengths on either side that set the expected hazard; false-discovery rate; limits broadcast at most.
NEIGHBOURS, FDR, LIMIT_ROWS = 25, 0.01, 100_000
#: Bins of the share of cut texts; turns of estimation; share of texts first taken as broken off elsewhere; strength of the pseudo-counts.
BINS, TURNS, ELSEWHERE, STRENGTH = 20, 30, 0.05, 20.0
#: How cut and whole texts end before anything is learnt (shares of the kinds).
CUT = {"open": 0.5, "line": 0.25, "mark": 0.14, "abbreviated": 0.04, "bare": 0.03, "closed": 0.02, "own": 0.02}
WHOLE = {"open": 0.004, "line": 0.004, "mark": 0.002, "abbreviated": 0.01, "bare": 0.05, "closed": 0.7, "own": 0.23}
#: Kinds that are complete whatever the length; kinds that state a cut, whose share among whole texts is not learnt.
COMPLETE, STATED = ("closed", "own"), ("mark",)
#: Characters that may stand behind a cut without meaning anything.
STRAY = " \t\n\r\x0b\x0c\x00\x01\x02\x03\x1a\x7f\u0085 ​﻿�|~^_*#\\<>"
_MARK = r"(?i)(\.\.+|…|\[[a-z .]*\]|\((cont|more|continued|continues|truncated)[^)]*\)|--+|—|–|\+\+|>>)$"
_CLOSED = r"[.!?][\"'”’»)\]]*$"
_ABBREVIATED = r"(?i)(^|[\s(])(no|nos|vs|mr|mrs|ms|dr|st|hon|núm|sr|sra|u\.s|p)\.$"
_OWN = r"(?i)^(https?://\S+|www\.\S+|\S+@\S+\.\w+|(\d+[.)]|[-*•–])\s+\S.*|(sub)?total\b.*\d.*|page \d+ of \d+|p[áa]gina \d+ de \d+|end of (record|document|file)|fin del (registro|documento)|(cc|bcc|encl?|attachments?): ?\S.*|filed by \S.*|signed by \S.*|presentado por \S.*)$"
_WRAPPED = r"(?i)^((sub)?total: ?(\$|usd )?[\d,.]+( dollars)?|page \d+ of \d+|p[áa]gina \d+ de \d+|end of record|(cc|filed by):? \S.{0,80})$"
_NAME = r"^(?U)\p{Lu}[\w.'’-]*( (\p{Lu}[\w.'’-]*|de|del|la|van|von)){0,5}$"


def ending(documents: DataFrame) -> DataFrame:
    """Adds the ``kind`` of each text's ending; null for blank texts. Only the last three lines are split off."""
    core = F.rtrim(F.col("text"), F.lit(STRAY))
    lines = F.reverse(F.transform(F.split(F.substring_index("core", "\n", -3), "\n"), lambda x: F.trim(x)))
    read = documents.select("*", core.alias("core")).select("*", lines.alias("lines"))
    read = read.select("*", *[F.get("lines", F.lit(i)).alias(c) for i, c in enumerate(("last", "before", "third"))])
    last, before, third = F.col("last"), F.col("before"), F.col("third")
    # hard-wrapped endings: an own line may itself be broken
    read = read.select("*", F.concat_ws(" ", before, last).alias("two"), F.concat_ws(" ", third, before, last).alias("three"))
    two, three = F.col("two"), F.col("three")
    own = (last.rlike(_OWN) & (F.length(last) <= 160)) | (before.isNotNull() & two.rlike(_WRAPPED)) | (third.isNotNull() & three.rlike(_WRAPPED))
    fresh = before.isNull() | (before == "") | before.rlike(r"[.!?:,;][\"'”’»)\]]*$") | before.rlike(_OWN)
    signed = (before.rlike(",$") & last.rlike(_NAME)) | (third.rlike(",$") & (two.rlike(_NAME) | last.rlike(_NAME)))
    bare = before.isNotNull() & before.rlike(_CLOSED) & last.rlike(_NAME) & (F.size(F.split(last, " ")) > 1)
    kind = (
        F.when(F.coalesce(F.col("core"), F.lit("")) == "", F.lit(None).cast("string"))
        .when(last.rlike(_MARK), "mark")
        .when(last.rlike(_ABBREVIATED), "abbreviated")
        .when(last.rlike(_CLOSED), "closed")
        .when(before.isNull() & ~last.rlike(r"(?i)^https?://\S+$"), "line")
        .when(F.coalesce(own, F.lit(False)), "own")
        .when(F.coalesce(signed, F.lit(False)), "own")
        .when(F.coalesce(bare & fresh, F.lit(False)), "bare")
        .otherwise("open")
    )
    return read.select(*documents.columns, kind.alias("kind"))


def read_endings(documents: DataFrame) -> DataFrame:
    """(doc_id, source, text_id, chars, bytes, kind) of every text that is not null, in one scan."""
    texts = documents.filter("text is not null").select("doc_id", "source", "text")
    return ending(texts).select("doc_id", "source", F.xxhash64("text").alias("text_id"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), "kind")


def lengths(endings: DataFrame) -> DataFrame:
    """(source, unit, n, c): how many different texts of a source have a length."""
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("n")) for u in ("chars", "bytes")])
    once = endings.filter("chars > 0").select("source", "text_id", "chars", "bytes").distinct()
    return once.select("source", F.explode(units).alias("u")).groupBy("source", "u.unit", "u.n").agg(F.count("*").alias("c"))


def significant(counts: DataFrame, neighbours: int = NEIGHBOURS, fdr: float = FDR) -> DataFrame:
    """(source, unit, n, c, hazard, expected, p, share): lengths whose hazard exceeds the neighbouring hazards.

    ``share`` is the part of the texts ending there that the neighbours' hazard does not explain.
    """
    by = W.partitionBy("source", "unit")
    near = by.orderBy("n").rangeBetween(-neighbours, neighbours)
    c, n = F.col("c"), F.col("n")
    # texts at risk at the lengths around, observed or not: a text longer than the window is at risk at all of them
    longer = F.coalesce(F.sum("c").over(by.orderBy("n").rangeBetween(neighbours + 1, W.unboundedFollowing)), F.lit(0))
    windowed = counts.select(
        "*",
        F.sum("c").over(by.orderBy("n").rangeBetween(0, W.unboundedFollowing)).alias("at_risk"),
        (F.sum("c").over(near) - c).alias("ends_around"),
        (longer * (2 * neighbours + 1) + F.sum(c * n).over(near) - F.sum("c").over(near) * (n - neighbours - 1)).alias("risk_window"),
    )
    around = (F.col("ends_around") + F.lit(0.5)) / F.greatest(F.col("risk_window") - F.col("at_risk"), F.lit(1))
    # where few texts are left, any length ends many of those at risk: it must end more of them than the lengths around do
    plain = (F.col("ends_around") + F.lit(0.5)) / F.lit(2.0 * neighbours) / F.col("at_risk")
    tested = windowed.select("*", F.least(F.greatest(around, plain), F.lit(0.999)).alias("around"), (c / F.col("at_risk")).alias("hazard"))
    h, e = F.col("hazard"), F.col("around")
    # Chernoff bound of the binomial tail
    gain = h * F.log(h / e) + F.when(h < 1, (1 - h) * F.log((1 - h) / (1 - e))).otherwise(F.lit(0.0))
    log_p = F.when(h > e, -F.col("at_risk") * gain).otherwise(F.lit(0.0))
    ranked = tested.select("*", log_p.alias("log_p")).select("*", F.row_number().over(by.orderBy("log_p", "n")).alias("k"), F.count("*").over(by).alias("m"))
    passing = F.max(F.when(F.col("log_p") <= F.log(F.lit(fdr) * F.col("k") / F.col("m")), F.col("k"))).over(by)
    kept = ranked.select("*", passing.alias("top")).filter("k <= top and c > 1")
    return kept.select("source", "unit", "n", "c", "hazard", e.alias("expected"), F.exp("log_p").alias("p"), (1 - e / h).alias("share"))


def learn(counts: dict[tuple[int, str], int]) -> tuple[float, dict[str, float], dict[str, float]]:
    """Share of texts broken off at other lengths, and the shares of the kinds among cut and whole texts.

    ``counts`` are texts per (bin of the share of cut texts, kind); bin 0 holds the other lengths.
    """
    rho, cut, whole = ELSEWHERE, dict(CUT), dict(WHOLE)
    for _ in range(TURNS):
        in_cut, in_whole = {k: STRENGTH * v for k, v in CUT.items()}, {k: STRENGTH * v for k, v in WHOLE.items()}
        broken, others = ELSEWHERE * STRENGTH, STRENGTH
        for (at, kind), n in counts.items():
            w = n * posterior(at, kind, rho, cut, whole)
            in_cut[kind] += w
            in_whole[kind] += n - w
            if at == 0:
                broken, others = broken + w, others + n
        rho = broken / others
        cut, whole = ({k: v / sum(t.values()) for k, v in t.items()} for t in (in_cut, in_whole))
        whole |= {k: WHOLE[k] for k in STATED}
    return rho, cut, whole


def posterior(at: int, kind: str, rho: float, cut: dict[str, float], whole: dict[str, float]) -> float:
    """Probability that a text is cut, from its length's bin and its ending's kind."""
    prior = min((at - 0.5) / BINS, 0.995) if at else rho
    return prior * cut[kind] / (prior * cut[kind] + (1 - prior) * whole[kind])


def judged(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, kind, at_limit, probability, cut) of every text that is not null, and the limits."""
    endings = materialize(read_endings(documents), "endings")
    limits = materialize(significant(lengths(endings)), "limits")
    small = broadcast_if_small(limits.select("source", "unit", "n", F.least(F.ceil(F.col("share") * BINS), F.lit(BINS)).cast("int").alias("at")), LIMIT_ROWS)
    placed = endings
    for unit in ("chars", "bytes"):
        own = small.filter(F.col("unit") == unit).select(F.col("source").alias("s"), "n", F.col("at").alias(f"at_{unit}"))
        placed = placed.join(own, placed["source"].eqNullSafe(own["s"]) & (placed[unit] == own["n"]), "left").drop("s", "n")
    placed = placed.select("doc_id", "source", "text_id", "kind", F.coalesce(F.greatest("at_chars", "at_bytes"), F.lit(0)).alias("at"))
    seen = placed.filter("kind is not null").groupBy("at", "kind").agg(F.count_distinct("source", "text_id").alias("n")).collect()  # at most (BINS + 1) x kinds
    rho, cut, whole = learn({(r["at"], r["kind"]): r["n"] for r in seen})
    level = F.create_map(*[F.lit(x) for at in range(BINS + 1) for k in CUT for x in (f"{at} {k}", posterior(at, k, rho, cut, whole))])
    probability = F.when(F.col("kind").isNotNull(), F.try_element_at(level, F.concat_ws(" ", "at", "kind")))
    open_ = F.coalesce(~F.col("kind").isin(*COMPLETE) & (F.col("probability") >= 0.5), F.lit(False))
    return placed.select("*", probability.alias("probability")).select("doc_id", "source", "kind", (F.col("at") > 0).alias("at_limit"), "probability", open_.alias("cut")), limits


def found(documents: DataFrame) -> DataFrame:
    """(doc_id) of every cut document."""
    return judged(documents)[0].filter("cut").select(F.col("doc_id").cast("long").alias("doc_id"))


def rates(documents: DataFrame) -> DataFrame:
    """(source, texts, cut, at_limit, rate, limits): how often each source truncates, how many of the cuts lie at a limit, and the limits."""
    texts, limits = judged(documents)
    hits = F.count(F.when(F.col("cut"), 1))
    t = texts.groupBy("source").agg(F.count("*").alias("texts"), hits.alias("cut"), F.count(F.when(F.col("cut") & F.col("at_limit"), 1)).alias("at_limit")).alias("t")
    n = limits.filter("unit = 'chars'").groupBy("source").agg(F.array_sort(F.collect_set("n")).alias("limits")).alias("l")
    out = t.join(n, F.expr("t.source <=> l.source"), "left")
    return out.select("t.source", "t.texts", "t.cut", "t.at_limit", (F.col("t.cut") / F.col("t.texts")).alias("rate"), F.coalesce("l.limits", F.array().cast("array<int>")).alias("limits"))
