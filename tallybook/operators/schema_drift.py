"""Schemas that drift between deliveries of a feed (problem 1).

One aggregation profiles every field of every delivery: how many rows carry it,
how its values type, a short sketch of its value set. A delivery's layout version
is the fingerprint of its (field, type) list. Consecutive layouts of a feed are
compared on these profiles alone (a few rows per delivery, whatever its size)
and give explicit migration steps: added, removed, renamed, retyped. The steps
are chained per feed, so that each row is routed from its own layout to the
newest one by rename, default and cast rules (``consistent_table``).

Edge cases: rows without feed or day take no part; a null raw_fields counts as a
row that carries no field; a blank value carries its key but has no type; a
field without any non-blank value has no type and is never retyped; an empty
table gives no steps; repeated rows count as rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import strip, utc_day
from tallybook.plans.stage import broadcast_if_small, materialize

#: Share of a delivery's rows that must carry a field; share of values that must fit a type.
PRESENT, FITS = 10, 10
#: Slots of the value-set sketch.
SLOTS = 16
#: Mapping rows up to which the routing rules are broadcast.
RULE_ROWS = 20_000
EXPORT_FIELDS = ("transction_type", "transaction_type", "account_code", "declaration")
TYPES = ("whole", "decimal", "date", "flag", "text")
_WHOLE = r"^[+-]?(\d+|\d{1,3}(,\d{3})+)$"
_DECIMAL = r"^[+-]?((\d+|\d{1,3}(,\d{3})+)(\.\d*)?|\.\d+)$"
_DATE = r"^(\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}.*)?|\d{1,2}/\d{1,2}/(\d{4}|\d{2})|\d{1,2}-[A-Za-z]{3}-(\d{4}|\d{2}))$"
_FLAG = r"^(?i)(y|n|yes|no|true|false)$"

# Fixed vocabulary of column names: spellings of one word, words that say nothing
# about what a field holds, and words that make it another thing's field.
WORDS = {
    "acct": "account", "cd": "code", "addr": "address", "street": "address", "amt": "amount", "rpt": "report", "no": "number", "num": "number",
    "nbr": "number", "yr": "year", "rcv": "receive", "rcvd": "receive", "received": "receive", "receipt": "receive", "descr": "description",
    "desc": "description", "postal": "zip", "zipcode": "zip", "town": "city", "municipality": "city", "profession": "occupation", "job": "occupation",
    "acreage": "acre", "acres": "acre", "trans": "transaction", "transction": "transaction", "occured": "occur", "occurred": "occur", "electronic": "e", "etrans": "etransaction", "tot": "total", "val": "value",
    "re": "realestate", "agg": "aggregate", "qty": "quantity", "employers": "employer", "orig": "original", "dt": "date", "contribution": "contribution",
}
GENERIC = {"code", "date", "name", "id", "number", "type", "flag", "value", "field", "specific", "form", "line", "title", "is", "of", "the", "or", "in", "s", "on", "kind", "usd", "first", "last", "only", "e", "filed", "1", "2"}
OTHER = {"spouse", "reviewer", "batch", "notice", "second", "previous", "prior", "refund", "fips", "minor", "count", "fee", "filed"}


def field_words(name: str) -> list[str]:
    """Lower-case words of a column name in canonical spelling; camel case splits."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", name.replace("'", "")))
    words = re.findall(r"[a-z]+|\d+", spaced.lower())
    if words == ["reid"]:
        words = ["re", "id"]
    joined = " ".join(words).replace("real estate", "realestate")
    return [WORDS.get(w, w) for w in joined.split()]


def name_likeness(old: str, new: str) -> float:
    """0 to 1: how surely two column names mean the same field, by their words alone."""
    flat = [re.sub(r"[^a-z0-9]", "", x.lower().replace("'", "")) for x in (old, new)]
    if flat[0] == flat[1]:
        return 1.0
    a, b = field_words(old), field_words(new)
    if "".join(a) == "".join(b):
        return 0.95
    sa, sb = set(a), set(b)
    if not sa or not sb:
        return 0.0
    if (sa ^ sb) & OTHER:
        return 0.1
    common, strong = sa & sb, (sa & sb) - GENERIC
    if sa == sb:
        return 0.9
    if common and (sa <= sb or sb <= sa):
        return 0.85 if strong else 0.75
    if strong:
        return 0.6 + 0.2 * len(common) / len(sa | sb)
    if min(len(flat[0]), len(flat[1])) >= 5 and _typo(flat[0], flat[1]):
        return 0.85
    return 0.2 if common else 0.0


def _typo(a: str, b: str) -> bool:
    """One inserted, dropped, changed or swapped letter apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


# ---------------------------------------------------------------- profiles


def _carried(source: DataFrame, exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(origin, feed, delivery, field, value) of carried fields, and rows per delivery."""
    records = source.select(F.lit("source_record").alias("origin"), F.col("data_source_id").alias("feed"), utc_day(F.col("pull_date")).alias("delivery"), "raw_fields").filter("feed is not null and delivery is not null")
    portal = exports.select(F.lit("real_transaction_export_adams").alias("origin"), F.col("export_name").alias("feed"), F.date_format("exported_on", "yyyy-MM-dd").alias("delivery"), *EXPORT_FIELDS).filter("feed is not null and delivery is not null")
    by = ["origin", "feed", "delivery"]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in EXPORT_FIELDS])
    wide = portal.select(*by, F.explode(pairs).alias("x")).select(*by, "x.field", "x.value").filter(F.coalesce(strip(F.col("value")), F.lit("")) != "")
    fields = records.select(*by, F.explode("raw_fields").alias("field", "value")).unionByName(wide)
    sizes = records.groupBy(*by).agg(F.count("*").alias("rows")).unionByName(portal.groupBy(*by).agg(F.count("*").alias("rows")))
    return fields, sizes


def profile(fields: DataFrame) -> DataFrame:
    """One row per field of a delivery: rows, values, fitting values by type, value sketch."""
    v = F.col("v")
    hit = lambda pattern: F.count(F.when(v.rlike(pattern), 1))
    return (
        fields.select("origin", "feed", "delivery", "field", F.nullif(strip(F.col("value")), F.lit("")).alias("v"))
        .groupBy("origin", "feed", "delivery", "field")
        .agg(F.count("*").alias("carried"), F.count(v).alias("valued"), hit(_WHOLE).alias("whole"), hit(_DECIMAL).alias("decimal"), hit(_DATE).alias("date"), hit(_FLAG).alias("flag"), *[F.min(F.xxhash64(F.lower(v), F.lit(j))).alias(f"s{j}") for j in range(SLOTS)])
    )


def layouts(source: DataFrame, exports: DataFrame) -> DataFrame:
    """Fields that belong to each delivery, with their type; deliveries without fields keep one null row."""
    fields, sizes = _carried(source, exports)
    by = ["origin", "feed", "delivery"]
    fits = [F.when(F.col(t) * FITS >= F.col("valued") * (FITS - 1), t) for t in TYPES[:4]]
    kind = F.when(F.col("valued") > 0, F.coalesce(*fits, F.lit("text")))
    sketch = F.array(*[F.col(f"s{j}") for j in range(SLOTS)])
    own = profile(fields).join(sizes, by).filter(F.col("carried") * PRESENT >= F.col("rows")).select(*by, "field", kind.alias("kind"), sketch.alias("sketch"))
    return sizes.select(*by).join(own, by, "left")


# ---------------------------------------------------------------- steps

_STEP = "origin string, feed string, delivery string, version string, change string, field string, new_field string, old_kind string, kind string"


def same_content(a: dict, b: dict) -> float:
    """Estimated Jaccard similarity of two fields' value sets."""
    x, y = a["sketch"], b["sketch"]
    if x is None or y is None or x[0] is None or y[0] is None or pd.isna(x[0]) or pd.isna(y[0]):
        return 0.0
    return sum(p == q for p, q in zip(x, y)) / SLOTS


def match_renames(gone: dict[str, dict], fresh: dict[str, dict]) -> dict[str, str]:
    """Old name to new name for the fields that go on under another name.

    Names decide first; where they are only akin, the type must go on or the value
    sets overlap; where they differ, the value sets must be the same and of a kind
    that tells (flags never do).
    """
    scored = []
    for old, a in gone.items():
        for new, b in fresh.items():
            name, content, same = name_likeness(old, new), same_content(a, b), a["kind"] == b["kind"] or None in (a["kind"], b["kind"])
            telling = a["kind"] not in ("flag", None) and b["kind"] not in ("flag", None)
            if name >= 0.75 or (name >= 0.55 and same):
                score = name + 0.2 * content + 0.1 * same
            elif telling and same and content >= 0.6 and name != 0.1:
                score = 0.5 + 0.2 * content
            elif name >= 0.55:
                score = name - 0.3
            else:
                continue
            scored.append((-score, old, new))
    out: dict[str, str] = {}
    for _, old, new in sorted(scored):
        if old not in out and new not in out.values():
            out[old] = new
    return out


def _steps_of_feed(frame: pd.DataFrame) -> pd.DataFrame:
    """All migration steps of one feed; 'keep' rows carry each layout's own fields."""
    origin, feed = frame["origin"].iloc[0], frame["feed"].iloc[0]
    out, before, version = [], None, 0
    for delivery, part in frame.groupby("delivery", sort=True):
        now = {r.field: {"kind": r.kind, "sketch": r.sketch} for r in part.itertuples() if r.field is not None}
        add = lambda change, field, new="", old_kind=None, kind=None: out.append((origin, feed, delivery, f"v{version}", change, field, new, old_kind, kind))  # noqa: B023, E731
        if before is not None:
            gone = {k: v for k, v in before.items() if k not in now}
            fresh = {k: v for k, v in now.items() if k not in before}
            renamed = match_renames(gone, fresh) if gone and fresh else {}
            same = {k: k for k in now if k in before} | renamed
            retyped = [(old, new) for old, new in same.items() if before[old]["kind"] and now[new]["kind"] and before[old]["kind"] != now[new]["kind"]]
            version += bool(gone or fresh or retyped)
            for k in gone:
                if k not in renamed:
                    add("removed", k)
            for k in fresh:
                if k not in renamed.values():
                    add("added", k, kind=fresh[k]["kind"])
            for old, new in renamed.items():
                add("renamed", old, new)
            for old, new in retyped:
                add("retyped", new, "", before[old]["kind"], now[new]["kind"])
        for k, v in now.items():
            add("keep", k, kind=v["kind"])
        before = now
    return pd.DataFrame(out, columns=[c.split()[0] for c in _STEP.split(", ")], dtype=object)


def _by_feed(df: DataFrame) -> DataFrame:
    """Feeds spread over all shuffle partitions: they are few rows, but each costs Python time, so they are not coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "origin", "feed")


def migration_steps(source: DataFrame, exports: DataFrame) -> DataFrame:
    """Every step with its layout version; change 'keep' lists the layout itself."""
    return _by_feed(layouts(source, exports)).groupBy("origin", "feed").applyInPandas(_steps_of_feed, _STEP)


def found(source: DataFrame, exports: DataFrame) -> DataFrame:
    """(origin, feed, delivery, change, field, new_field): the recorded changes."""
    return migration_steps(source, exports).filter("change != 'keep'").select("origin", "feed", "delivery", "change", "field", "new_field")


# ---------------------------------------------------------------- routing

_RULES = "origin string, feed string, delivery string, fingerprint string, known array<string>, sources map<string,array<string>>, kinds map<string,string>"


def _rules_of_feed(frame: pd.DataFrame) -> pd.DataFrame:
    """Routing rules of each delivery: rename to the newest name, cast to the widest type, default the absent."""
    import hashlib

    origin, feed = frame["origin"].iloc[0], frame["feed"].iloc[0]
    days = sorted(set(frame["delivery"]))
    newest: dict[str, str] = {}  # newest name of each field, by the name it has in the delivery at hand, or had when last absent
    per_day: dict[str, dict[str, str]] = {}
    known: dict[str, str] = {}
    parts = {d: p for d, p in frame.groupby("delivery")}
    for day in reversed(days):
        part = parts[day]
        own = set(part.loc[part["change"] == "keep", "field"])
        per_day[day] = {f: newest.get(f, f) for f in own}
        used = Counter(per_day[day].values())
        for f, to in sorted(per_day[day].items()):  # no two fields of a delivery share a name
            if f != to and (to in own and per_day[day][to] == to or used[to] > 1):
                per_day[day][f] = f
                used[to] -= 1
                used[f] += 1
        for f, to in per_day[day].items():
            known.setdefault(f, to)
        back = {r.new_field: r.field for r in part.itertuples() if r.change == "renamed"}
        absent = {f: to for f, to in newest.items() if f not in own}
        newest = absent | {back.get(f, f): to for f, to in per_day[day].items()}
    kinds: dict[str, set] = {}
    for day in days:
        for r in parts[day].itertuples():
            if r.change == "keep" and r.kind is not None:
                kinds.setdefault(per_day[day][r.field], set()).add(r.kind)
    widest = {}
    for f, ks in kinds.items():
        widest[f] = "decimal" if ks == {"whole", "decimal"} else next(iter(ks)) if len(ks) == 1 else "text"
    everything = sorted({t for m in per_day.values() for t in m.values()})
    out = []
    for day in days:
        names = known | per_day[day]  # rows in another layout still find their way; a field's own name goes first
        print_of = hashlib.sha256("\x1f".join(sorted(f"{r.field}:{r.kind}" for r in parts[day].itertuples() if r.change == "keep")).encode()).hexdigest()
        sources: dict[str, list[str]] = {t: [] for t in everything}  # raw names by canonical name, the delivery's own first
        for f in sorted(names, key=lambda f: (f not in per_day[day], f)):
            sources[names[f]].append(f)
        out.append((origin, feed, day, print_of, sorted(names), sources, dict(widest)))
    return pd.DataFrame(out, columns=["origin", "feed", "delivery", "fingerprint", "known", "sources", "kinds"])


def cast_value(v: Column, kind: Column) -> Column:
    """One notation per type; a value that does not fit its type stays as it is."""
    plain = F.regexp_replace(v, ",", "")
    day = F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in ("yyyy-MM-dd", "M/d/yyyy", "dd-MMM-yy")])
    flag = F.when(F.lower(v).isin("y", "yes", "true"), "true").when(F.lower(v).isin("n", "no", "false"), "false")
    return F.when(kind.isin("whole", "decimal") & v.rlike(_DECIMAL), plain).when((kind == "date") & v.rlike(_DATE), F.coalesce(F.date_format(day, "yyyy-MM-dd"), v)).when(kind == "flag", F.coalesce(flag, v)).otherwise(v)


def routing_rules(source: DataFrame, exports: DataFrame) -> DataFrame:
    """Rules per delivery of the feeds of both origins."""
    return _by_feed(migration_steps(source, exports)).groupBy("origin", "feed").applyInPandas(_rules_of_feed, _RULES)


def _raw(source: DataFrame, exports: DataFrame) -> DataFrame:
    """(origin, id, feed, delivery, raw): rows of both origins; a blank export column is not carried."""
    records = source.select(F.lit("source_record").alias("origin"), "id", F.col("data_source_id").alias("feed"), utc_day(F.col("pull_date")).alias("delivery"), F.coalesce("raw_fields", F.create_map().cast("map<string,string>")).alias("raw"))
    columns = F.create_map(*[x for c in EXPORT_FIELDS for x in (F.lit(c), F.col(c))])
    raw = F.map_filter(columns, lambda _, v: F.coalesce(strip(v), F.lit("")) != "")
    number = F.col("export_row_id") if "export_row_id" in exports.columns else F.lit(None)
    portal = exports.select(F.lit("real_transaction_export_adams").alias("origin"), number.cast("string").alias("id"), F.col("export_name").alias("feed"), F.date_format("exported_on", "yyyy-MM-dd").alias("delivery"), raw.alias("raw"))
    return records.unionByName(portal)


def consistent_table(source: DataFrame, exports: DataFrame) -> DataFrame:
    """(origin, id, feed, delivery, layout, fields, stray): every row of both inputs under the newest names and widest types.

    ``fields`` has every canonical field of the feed, null by default; each is looked up
    in the row's map under its raw names and cast once, so the work grows with the number
    of fields. Values under unknown keys go to ``stray``. The rules are broadcast only up
    to ``RULE_ROWS`` rows.
    """
    rules = broadcast_if_small(materialize(routing_rules(source, exports), "rules"), RULE_ROWS)
    r = _raw(source, exports).join(rules, ["origin", "feed", "delivery"], "left")

    def value(field: Column, raws: Column) -> Column:
        held = F.filter(F.transform(raws, lambda k: F.nullif(strip(F.try_element_at("raw", k)), F.lit(""))), lambda v: v.isNotNull())
        return F.get(F.transform(F.slice(held, 1, 1), lambda v: cast_value(v, F.try_element_at("kinds", field))), F.lit(0))

    fields = F.transform_values("sources", value)
    stray = F.map_filter("raw", lambda k, _: ~F.coalesce(F.array_contains("known", k), F.lit(False)))
    return r.select("origin", "id", "feed", "delivery", F.col("fingerprint").alias("layout"), fields.alias("fields"), stray.alias("stray"))
