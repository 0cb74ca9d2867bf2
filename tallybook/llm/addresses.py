"""Same postal address written differently (problem 2).

Address lines are read into parts and reduced to distinct forms. Forms of one house or
box number, which a place never changes, are candidates where they have one town, one ZIP
code or towns within two edits, or one state where a town is missing: a superset of what
is accepted. Candidate forms are verified by an affine-gap alignment of street words
whose substitution costs know the abbreviation dictionaries; unit, direction, street
type and town must not contradict, a part left out does not. Pairs of forms are then
expanded to pairs of records through the membership table; ``place_classes`` gives the
same links in linear size.

Edge cases: null, blank and unreadable lines (no number or box) name no place; a
care-of line is not part of the place; a missing town is compared by state, a missing
state contradicts none; repeated rows pair with each other; a record never pairs with itself; pairs without an address row are not made; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions.text import blank_to_null
from tallybook.llm.meeting import meet
from tallybook.llm.places import Gazetteer, Place, read_place, same_place, town_name
from tallybook.plans.stage import materialize

_PARTS = ("number", "box", "unit", "direction", "street", "kind", "town", "state", "zip5")
_FORM = ", ".join(f"{c} string" for c in _PARTS)
_LINES = ("line", "city", "state", "zip")


def towns(structured: DataFrame) -> DataFrame:
    """(zip5, town): the town most rows give for each ZIP code; ``structured`` has city and zip."""
    rows = structured.select(F.substring(F.regexp_replace("zip", r"\D", ""), 1, 5).alias("zip5"), F.upper(blank_to_null(F.col("city"))).alias("town")).filter("length(zip5) = 5 and town is not null")
    counted = rows.groupBy("zip5", "town").agg(F.count("*").alias("n"))
    return counted.withColumn("k", F.row_number().over(W.partitionBy("zip5").orderBy(F.desc("n"), "town"))).filter("k = 1").select("zip5", "town")


def gazetteer_rows(structured: DataFrame) -> list[tuple[str, str]]:
    """(ZIP code, town), one row per ZIP code: at most 100,000, as a ZIP code is five digits."""
    return [(r["zip5"], town_name(r["town"])) for r in towns(structured).collect()]


_GAZETTEERS: dict[str, Gazetteer] = {}


def shared_gazetteer(shared) -> Gazetteer:
    """The worker's gazetteer for a broadcast list of towns."""
    token, rows = shared.value
    if token not in _GAZETTEERS:
        _GAZETTEERS.clear()
        _GAZETTEERS[token] = Gazetteer(rows)
    return _GAZETTEERS[token]


def share_towns(structured: DataFrame):
    """Broadcast of the gazetteer, bounded by the number of ZIP codes."""
    return structured.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, gazetteer_rows(structured)))


def _reader(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gazetteer = shared_gazetteer(shared)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in _LINES]
            parsed = [read_place(line, gazetteer) if city == state == zip_code == "\x00" else read_place(line, gazetteer, city, state, zip_code) for line, city, state, zip_code in zip(*columns)]
            keep = [batch.column(c) for c in ("line_id",)]
            yield pa.record_batch([*keep, *[pa.array(c, pa.string()) for c in (zip(*parsed) if parsed else [[]] * len(_PARTS))]], ["line_id", *_PARTS])

    return run


def lines(address: DataFrame, ownership: DataFrame, exports: DataFrame) -> DataFrame:
    """(id, from_address, line, city, state, zip): raw lines; \\x00 marks tables without town columns."""
    none = F.lit("\x00")
    a = address.select("id", F.lit(True).alias("from_address"), F.col("raw_address").alias("line"), none.alias("city"), none.alias("state"), none.alias("zip"))
    o = ownership.select("id", F.lit(False).alias("from_address"), F.concat_ws(", ", *[blank_to_null(F.col(f"owner_mail_line{i}")) for i in (1, 2, 3)]).alias("line"), F.col("owner_mail_city").alias("city"), F.col("owner_mail_state").alias("state"), F.col("owner_mail_zip5").alias("zip"))
    x = exports.select(F.col("export_row_id").alias("id"), F.lit(False).alias("from_address"), F.concat_ws(", ", blank_to_null(F.col("street_line_1")), blank_to_null(F.col("street_line_2"))).alias("line"), "city", "state", F.col("zip_code").alias("zip"))
    return a.unionByName(o).unionByName(x).filter("id is not null and line is not null and line != ''").select("*", F.xxhash64(*[F.coalesce(c, F.lit("\x01")) for c in _LINES]).alias("line_id"))


def structured_towns(ownership: DataFrame, exports: DataFrame) -> DataFrame:
    """City and ZIP of the tables that have them apart."""
    return ownership.select(F.col("owner_mail_city").alias("city"), F.col("owner_mail_zip5").alias("zip")).unionByName(exports.select("city", F.col("zip_code").alias("zip")))


def read_forms(rows: DataFrame, shared) -> DataFrame:
    """(line_id, parts..., form): every distinct line read once."""
    distinct = rows.groupBy("line_id").agg(*[F.first(c, ignorenulls=False).alias(c) for c in _LINES])
    read = distinct.select("line_id", *_LINES).mapInArrow(_reader(shared), f"line_id long, {_FORM}")
    return read.filter("box != '' or (number != '' and street != '')").select("*", F.xxhash64(*_PARTS).alias("form"))


def cuts(town: str) -> set[str]:
    """A town run together, with up to two letters left out: towns within two edits or swaps share one."""
    flat = town.replace(" ", "")
    one = {flat[:i] + flat[i + 1 :] for i in range(len(flat))}
    return {flat} | one | {w[:i] + w[i + 1 :] for w in one for i in range(len(w))}


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(t, c) for t in batch.column("town").to_pylist() for c in cuts(t)]
        yield pa.record_batch([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 2)], ["town", "cut"])


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = zip(*[batch.column(f"a_{c}").to_pylist() for c in _PARTS])
        right = zip(*[batch.column(f"b_{c}").to_pylist() for c in _PARTS])
        ok = [same_place(Place(*a), Place(*b)) for a, b in zip(left, right)]
        yield pa.record_batch([batch.column("fa"), batch.column("fb")], ["fa", "fb"]).filter(pa.array(ok, pa.bool_()))


def candidates(forms: DataFrame) -> DataFrame:
    """(fa, fb): distinct forms, the first from an address row, that ``same_place`` may accept.

    They have one house or box number and one town (or state, where a town is missing), one
    ZIP code, or towns within two edits. No pair is left out: the street is compared in full.
    """
    key = F.when(F.col("box") != "", F.concat(F.lit("B"), "box")).otherwise(F.concat(F.lit("N"), "number"))
    keyed = materialize(forms.select("form", "has_address", "town", "state", "zip5", key.alias("key")), "keyed")
    met = meet(keyed.filter("has_address"), keyed, ["key"])
    named = keyed.select("town").filter("town != ''").distinct().mapInArrow(_cutter, "town string, cut string")
    near = named.join(named.withColumnRenamed("town", "other"), "cut").filter("town != other").select("town", "other").distinct()
    left = keyed.filter("has_address").select(F.col("form").alias("fa"), "key", "town", "zip5")
    right = keyed.select(F.col("form").alias("fb"), "key", F.col("town").alias("other"), "zip5")
    spelt = left.drop("zip5").join(near, "town").join(right.drop("zip5"), ["key", "other"]).select("fa", "fb")
    coded = left.filter("zip5 != ''").join(right, ["key", "zip5"]).filter("town != other").select("fa", "fb")
    return met.unionByName(spelt).unionByName(coded).filter("fa != fb").distinct()


def linked_forms(address: DataFrame, ownership: DataFrame, exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, from_address, form, ...) and links (fa, fb) between forms, fa of an address row; a form links to itself."""
    shared = share_towns(structured_towns(ownership, exports))
    rows = lines(address, ownership, exports)
    read = read_forms(rows, shared)
    members = materialize(rows.select("id", "from_address", "line_id").join(read, "line_id").select("id", "from_address", "form", *_PARTS), "members")
    forms = materialize(members.groupBy("form", *_PARTS).agg(F.max("from_address").alias("has_address")), "forms")
    pairs = candidates(forms)
    sides = [forms.select(F.col("form").alias(f"f{s}"), *[F.col(c).alias(f"{s}_{c}") for c in _PARTS]) for s in "ab"]
    checked = pairs.join(sides[0], "fa").join(sides[1], "fb").select("fa", "fb", *[f"{s}_{c}" for s in "ab" for c in _PARTS]).mapInArrow(_verifier, "fa long, fb long")
    return members, checked.unionByName(forms.filter("has_address").select(F.col("form").alias("fa"), F.col("form").alias("fb")))


def same_places(address: DataFrame, ownership: DataFrame, exports: DataFrame) -> DataFrame:
    """(left_id, right_id): pairs of records at one place, at least one of them an address row."""
    members, linked = linked_forms(address, ownership, exports)
    ours = members.filter("from_address").select(F.col("form").alias("fa"), F.col("id").alias("a"))
    theirs = members.select(F.col("form").alias("fb"), F.col("id").alias("b"))
    pair = linked.join(ours, "fa").join(theirs, "fb").filter("a != b")
    return pair.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).distinct()


def place_classes(address: DataFrame, ownership: DataFrame, exports: DataFrame) -> DataFrame:
    """(id, class, links): each record that names a place with its form and the number of other forms linked to it; no pairs of records are made."""
    members, linked = linked_forms(address, ownership, exports)
    one = linked.filter("fa != fb")
    both = one.unionByName(one.select(F.col("fb").alias("fa"), F.col("fa").alias("fb"))).distinct()
    counted = both.groupBy(F.col("fa").alias("form")).agg(F.count("*").alias("links"))
    return members.select("id", "form").join(counted, "form", "left").select("id", F.col("form").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
