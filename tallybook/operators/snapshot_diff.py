"""What changed between consecutive full snapshots of a feed (problem 3).

Each snapshot pair is cut into hash buckets of bounded size. A bucket's rows go,
with sign +1 for the later and -1 for the earlier snapshot, into an invertible
Bloom lookup table of a few cells (three cells per row; a cell keeps a signed
count and xor sums of key hash, content digest and checksum). Rows equal in both
snapshots cancel, so the table holds the difference only, and peeling pure cells
gives the differing (key, digest) items. Cells are built by hash aggregation
with map-side combine. Buckets that cannot be peeled are built again with more
cells; what still fails is compared exactly. Recovered items are checked against
the stored rows, which also gives the key text, and classified.

Edge cases: null feeds, days or keys and blank keys take no part; a null
raw_fields counts as an empty record; a key repeated within a snapshot counts
once (the row created last); a feed's first snapshot yields nothing; an empty
table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions.text import blank_to_null, strip, utc_day
from tallybook.plans.stage import broadcast_if_small, materialize

#: Rows a bucket holds on average, and the cells of its first table.
ROWS_PER_BUCKET, CELLS = 128, 96
#: Factors by which failed buckets are enlarged before the exact comparison.
ENLARGE = (4, 16)
#: Snapshots (not rows) up to which the calendar is broadcast.
CALENDAR_ROWS = 200_000
_MASK = (1 << 64) - 1
_PEEL = "data_source_id string, pair_day string, bucket long, solved boolean, kh long, dg long, sign int"


def content_digest(fields: Column) -> Column:
    """64-bit digest of a map: trimmed values, blank equals absent, any order of keys."""
    entries = F.filter(F.map_entries(fields), lambda e: F.coalesce(strip(e["value"]), F.lit("")) != "")
    return F.xxhash64(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("\x1f"), strip(e["value"])))))


def snapshot_rows(source: DataFrame) -> DataFrame:
    """One row per (feed, snapshot, key) of the full feeds with its neighbours in time."""
    full = (
        source.filter(F.col("feed_kind") == "full")
        .select("data_source_id", utc_day(F.col("pull_date")).alias("day"), F.upper(blank_to_null(F.col("source_record_key"))).alias("k"), "created_at", content_digest(F.col("raw_fields")).alias("dg0"))
        .filter("data_source_id is not null and day is not null")
    )
    # a snapshot whose rows all lack keys is still a snapshot
    calendar = full.groupBy("data_source_id", "day").agg(F.count("k").alias("n"))
    feed = W.partitionBy("data_source_id")
    calendar = materialize(
        calendar.select(
            F.col("data_source_id").alias("f"),
            F.col("day").alias("d"),
            F.lag("day").over(feed.orderBy("day")).alias("prev_day"),
            F.lead("day").over(feed.orderBy("day")).alias("next_day"),
            F.ceil(F.max("n").over(feed) / F.lit(ROWS_PER_BUCKET)).alias("buckets"),
        ),
        "calendar",
    )
    once = full.filter("k is not null").groupBy("data_source_id", "day", "k").agg(F.max(F.struct("created_at", "dg0"))["dg0"].alias("dg"))
    rows = once.join(broadcast_if_small(calendar, CALENDAR_ROWS), (F.col("data_source_id") == F.col("f")) & (F.col("day") == F.col("d"))).drop("f", "d")
    kh = F.xxhash64("k")
    return rows.select("data_source_id", "day", "prev_day", "next_day", "k", kh.alias("kh"), "dg", F.pmod(F.xxhash64(F.lit(7), "k"), F.greatest("buckets", F.lit(1))).alias("bucket"))


def _signed(rows: DataFrame) -> DataFrame:
    """Each row once per snapshot pair it belongs to."""
    later = F.when(F.col("prev_day").isNotNull(), F.struct(F.col("day").alias("pair_day"), F.lit(1).alias("sign")))
    earlier = F.when(F.col("next_day").isNotNull(), F.struct(F.col("next_day").alias("pair_day"), F.lit(-1).alias("sign")))
    return rows.select("data_source_id", "bucket", "kh", "dg", F.explode(F.filter(F.array(later, earlier), lambda x: x.isNotNull())).alias("p")).select("data_source_id", "bucket", "kh", "dg", "p.pair_day", "p.sign")


def _cells(signed: DataFrame, cells: int) -> DataFrame:
    """The subtracted tables: one row per touched cell that does not cancel."""
    third = cells // 3
    item = F.xxhash64("kh", "dg")
    at = [F.lit(j * third) + F.pmod(F.shiftrightunsigned(item, 16 * j), F.lit(third)) for j in range(3)]
    return (
        signed.select("*", F.xxhash64("dg", "kh").alias("cs"), F.explode(F.array(*at)).alias("cell"))
        .groupBy("data_source_id", "pair_day", "bucket", "cell")
        .agg(F.sum("sign").alias("n"), F.bit_xor("kh").alias("kx"), F.bit_xor("dg").alias("dx"), F.bit_xor("cs").alias("cx"))
        .filter("n != 0 or kx != 0 or dx != 0 or cx != 0")
    )


def _hash2(a: int, b: int) -> int:
    """What xxhash64(a, b) gives for two long columns, as an unsigned number."""
    return xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))


def peel(cell: list[int], n: list[int], sums: list[list[int]], third: int) -> tuple[bool, list[tuple[int, int, int]]]:
    """Items (key hash, digest, sign) of one subtracted table, and whether all were found.

    ``sums`` has the xor sums of key hash, digest and checksum of each cell. A cell is
    pure if its count is +1 or -1, its checksum fits its sums and the item belongs there.
    """
    live = {c: (m, *s) for c, m, s in zip(cell, n, sums)}
    found: list[tuple[int, int, int]] = []
    todo = list(live)
    while todo:
        c = todo.pop()
        sign, kh, dg, cs = live.get(c, (0, 0, 0, 0))
        if sign not in (1, -1) or _hash2(dg, kh) != cs & _MASK:
            continue
        item = _hash2(kh, dg)
        places = [j * third + _pmod(item >> 16 * j, third, j) for j in range(3)]
        if c not in places:
            continue
        if len(found) > 3 * len(cell):
            return False, []
        found.append((kh, dg, sign))
        for p in places:
            m, k, d, x = live.get(p, (0, 0, 0, 0))
            left = (m - sign, k ^ kh, d ^ dg, x ^ cs)
            if any(left):
                live[p] = left
                todo.append(p)
            else:
                live.pop(p, None)
    return not live, found


def _pmod(value: int, third: int, j: int) -> int:
    """pmod as Spark's: only the unshifted hash can be negative there."""
    return (value - (1 << 64) if j == 0 and value >> 63 else value) % third


def _peeler(third: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a group of rows is one bucket; partitions are sorted by bucket
        rest: pd.DataFrame | None = None

        def solve(whole: pd.DataFrame) -> pd.DataFrame:
            keys = whole[["data_source_id", "pair_day", "bucket"]]
            edge = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            values = whole[["kx", "dx", "cx"]].to_numpy(dtype=np.int64).tolist()
            cells, n = whole["cell"].tolist(), whole["n"].tolist()
            names = keys.to_numpy().tolist()
            out = []
            for a, b in zip(edge, [*edge[1:], len(whole)]):
                ok, items = peel(cells[a:b], n[a:b], values[a:b], third)
                out += [(*names[a], True, *item) for item in items] if ok else [(*names[a], False, None, None, None)]
            frame = pd.DataFrame(out, columns=["data_source_id", "pair_day", "bucket", "solved", "kh", "dg", "sign"], dtype=object)
            return frame.astype({"bucket": "int64", "kh": "Int64", "dg": "Int64", "sign": "Int32", "solved": bool})

        for batch in batches:
            if len(batch) == 0:
                continue
            whole = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = whole.iloc[-1]
            same = (whole["data_source_id"] == last["data_source_id"]) & (whole["pair_day"] == last["pair_day"]) & (whole["bucket"] == last["bucket"])
            rest = whole[same].reset_index(drop=True)
            if (~same).any():
                yield solve(whole[~same].reset_index(drop=True))
        if rest is not None and len(rest):
            yield solve(rest)

    return run


def _peeled(signed: DataFrame, cells: int) -> DataFrame:
    by = ["data_source_id", "pair_day", "bucket"]
    table = _cells(signed, cells)
    return table.repartition(*by).sortWithinPartitions(*by).mapInPandas(_peeler(cells // 3), _PEEL)


def snapshot_changes(source: DataFrame, cells: int = CELLS) -> DataFrame:
    """(data_source_id, source_record_key, snapshot_day, change) between consecutive full snapshots."""
    rows = materialize(snapshot_rows(source), "snapshot-rows")
    signed = _signed(rows)
    items: list[DataFrame] = []
    by = ["data_source_id", "pair_day", "bucket"]
    for factor in (1, *ENLARGE):
        level = materialize(_peeled(signed, cells * factor), "peeled")
        items.append(level.filter("solved").select("data_source_id", "pair_day", "kh", "dg", "sign"))
        failed = level.filter("not solved").select(*by)
        if not failed.take(1):
            break
        signed = signed.join(failed, by, "left_semi")
    else:
        exact = signed.groupBy("data_source_id", "pair_day", "kh", "dg").agg(F.sum("sign").cast("int").alias("sign")).filter("sign != 0")
        items.append(exact)
    found = items[0]
    for more in items[1:]:
        found = found.unionByName(more)
    # verification: an item must be a stored row of the side its sign says
    sides = rows.select("data_source_id", "k", "kh", "dg", "day", "next_day")
    later = found.filter("sign > 0").join(sides, [found["data_source_id"] == sides["data_source_id"], found["pair_day"] == sides["day"], found["kh"] == sides["kh"], found["dg"] == sides["dg"]]).select(found["data_source_id"], found["pair_day"], "k", found["sign"])
    earlier = found.filter("sign < 0").join(sides, [found["data_source_id"] == sides["data_source_id"], found["pair_day"] == sides["next_day"], found["kh"] == sides["kh"], found["dg"] == sides["dg"]]).select(found["data_source_id"], found["pair_day"], "k", found["sign"])
    sides_of = later.unionByName(earlier).groupBy("data_source_id", "pair_day", "k").agg(F.max("sign").alias("hi"), F.min("sign").alias("lo"))
    change = F.when(F.col("lo") > 0, "added").when(F.col("hi") < 0, "removed").otherwise("changed")
    return sides_of.select("data_source_id", F.col("k").alias("source_record_key"), F.col("pair_day").alias("snapshot_day"), change.alias("change"))
