"""Evaluation texts leaking into training text (problem 9): pigeonhole edit matching.

Texts are read as word sequences (letters and digits, case folded). A document leaks
an item if some run of ``WINDOW`` item words stands in it with at most ``BUDGET`` word
edits. Each run is split into BUDGET + 1 pieces; one piece at least must be hit
exactly, so exact hits of word pieces give all candidates, and Myers' bit-parallel
distance over words verifies the run around each hit. The held-out items are the query
set: they are broadcast in blocks of bounded size, and each block is one pass over the
documents, so documents are never shuffled or gathered.

Edge cases: null and empty documents or items leak nothing; items shorter than the
window never match; repeated documents and items each count; a word outside every
item matches nothing; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row, word edits allowed in them, words of items broadcast at once.
WINDOW, BUDGET, BLOCK_WORDS = 20, 3, 2_000_000
_WORD, _INNER = re.compile(r"[^\W_]+"), re.compile(r"(?<=\d)[.,](?=\d)|['’\u00ad]")


def words(text: str | None) -> list[str]:
    """Case-folded words; accents, apostrophes and points within numbers are dropped."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(_INNER.sub("", text).lower())


def myers(pattern: list[int], text: list[int], budget: int) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``; budget + 1 if more."""
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        score += bool(hp & high) - bool(hn & high)
        hp, hn = (hp << 1) & full, (hn << 1) & full  # the text may start anywhere: no carry into row 0
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
        best = min(best, score)
    return best if best <= budget else budget + 1


class Items:
    """The query set: words as small numbers and every piece's places."""

    def __init__(self, rows: list[tuple[int, str]], window: int, budget: int) -> None:
        self.window, self.budget, self.piece = window, budget, window // (budget + 1)
        self.number: dict[str, int] = {}
        self.seqs: dict[int, list[int]] = {}
        self.places: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for key, (item, text) in enumerate(rows):
            seq = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            self.seqs[key] = seq
            if len(seq) >= window:
                for o in range(len(seq) - self.piece + 1):
                    self.places[tuple(seq[o : o + self.piece])].append((key, o))
        self.ids = [item for item, _ in rows]

    def leaks(self, text: str | None) -> list[int]:
        """Ids of the items that ``text`` leaks."""
        seq = [self.number.get(w, -1) for w in words(text)]
        size, found, tried = self.piece, set(), set()
        if len(seq) < self.window - self.budget:
            return []
        for p in range(len(seq) - size + 1):
            for key, o in self.places.get(tuple(seq[p : p + size]), ()):
                if key in found:
                    continue
                item = self.seqs[key]
                for j in range(self.budget + 1):
                    s = o - j * size
                    if s < 0 or s + self.window > len(item) or (key, s, p - o) in tried:
                        continue
                    tried.add((key, s, p - o))
                    at = p - j * size
                    run, around = item[s : s + self.window], seq[max(0, at - self.budget) : at + self.window + self.budget]
                    # a run within the budget has all but that many of its words around the hit
                    if sum(map(set(around).__contains__, run)) >= self.window - self.budget and myers(run, around, self.budget) <= self.budget:
                        found.add(key)
                        break
        return sorted({self.ids[k] for k in found})


_CACHE: dict[str, Items] = {}


def _scanner(shared, token: str, window: int, budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _CACHE.get(token)
        if items is None:
            _CACHE.clear()
            items = _CACHE[token] = Items(shared.value, window, budget)
        for batch in batches:
            docs, leaked = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for item in items.leaks(text.as_py()):
                    docs.append(doc)
                    leaked.append(item)
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(leaked, pa.int64())], ["doc_id", "item_id"])

    return run


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, budget: int = BUDGET, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id) of every item a document leaks."""
    spark = documents.sparkSession
    queries = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = queries.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_words))
    texts = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passes = []
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()])  # at most about block_words words
        passes.append(texts.mapInArrow(_scanner(shared, uuid.uuid4().hex, window, budget), "doc_id long, item_id long"))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out.distinct() if blocks > 1 else out
