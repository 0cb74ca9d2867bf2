"""Encoding the corpus with a public byte-level BPE tokenizer (problem 8).

Each partition splits its texts into words with the tokenizer's pattern and encodes
the distinct words in DuckDB: a recursive query holds token-position rows, joins
neighbouring tokens with the merge table, contracts the pair of minimum rank of every
word, from the left, in each step and stops at the fixpoint; an ordered aggregation gives the
words' ids, which are strung together per text. Decoding joins token rows with the
vocabulary's bytes and strings them together by an ordered aggregation. Words already seen by the worker are
remembered (a bounded memory of results, so nothing is dropped). Texts are never
shuffled; the vocabulary is read from a path every worker has.

Edge cases: null and empty texts give an empty list; special tokens in a text are
ordinary text; repeated rows are encoded alike; lone surrogates are replaced; a very
long word is contracted in several rounds of bounded recursion; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary, steps per recursive query, words remembered by a worker, words per query, DuckDB's memory.
VOCABULARY, STEPS, REMEMBERED, PER_QUERY, MEMORY = "/opt/tokenizers/byte_bpe_50k.json", 48, 300_000, 20_000, "350MB"
# Fixed value: the published pre-tokenisation pattern of the vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# In a step every occurrence of the word's minimum-rank pair is contracted, from the left and without overlap: a pair with
# the new token ranks after the merge that makes it, so one occurrence after the other would give the same tokens.
_CONTRACT = """
WITH RECURSIVE step(word, pos, tok, turn) AS (
  SELECT word, pos, tok, 0 FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN best THEN merged ELSE tok END, turn + 1
  FROM (
    SELECT *, coalesce(lag(best) OVER (PARTITION BY word ORDER BY pos), false) AS eaten
    FROM (
      SELECT *, hit AND row_number() OVER (PARTITION BY word, run, hit ORDER BY pos) % 2 = 1 AS best
      FROM (
        SELECT *, coalesce(rank = least_, false) AS hit, sum(CASE WHEN coalesce(rank = least_, false) THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS run
        FROM (
          SELECT s.*, m.merged, m.rank, min(m.rank) OVER (PARTITION BY s.word) AS least_
          FROM (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS next FROM step) s
          LEFT JOIN merges m ON m.l = s.tok AND m.r = s.next
        )
        WHERE least_ IS NOT NULL AND turn < {steps}
      )
    )
  )
  WHERE NOT eaten
),
final AS (SELECT word, max(turn) AS turn FROM step GROUP BY word)
SELECT s.word, list(s.tok ORDER BY s.pos) AS ids, any_value(s.turn) = {steps} AS more
FROM step s JOIN final f ON s.word = f.word AND s.turn = f.turn GROUP BY s.word
"""
_DECODE = "SELECT t.text, unhex(string_agg(p.hex, '' ORDER BY t.pos)) AS bytes FROM tokens t JOIN pieces p ON p.id = t.id GROUP BY t.text"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary (published rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """One worker's DuckDB with the merge table, and the words it has encoded."""

    def __init__(self, path: str, steps: int = STEPS) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.first = np.array([ids[c] for _, c in sorted(byte_letters().items())], dtype=np.int32)
        self.letters, self.ids, self.steps = byte_letters(), ids, steps
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        table = pa.table({"l": pa.array([ids[a] for a, _ in merges], pa.int32()), "r": pa.array([ids[b] for _, b in merges], pa.int32()), "rank": pa.array(range(len(merges)), pa.int64()), "merged": pa.array([ids[a + b] for a, b in merges], pa.int32())})
        self.con.register("merge_rows", table)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        letter_of = {c: b for b, c in self.letters.items()}
        pieces = [(i, bytes(letter_of[c] for c in t).hex()) for t, i in ids.items() if all(c in letter_of for c in t)]
        self.con.register("piece_rows", pa.table({"id": pa.array([i for i, _ in pieces], pa.int32()), "hex": [h for _, h in pieces]}))
        self.con.execute("CREATE TABLE pieces AS SELECT * FROM piece_rows")
        self.known: dict[str, list[int]] = {}

    def learn(self, fresh: list[str]) -> None:
        """Encode words not seen yet."""
        for a in range(0, len(fresh), PER_QUERY):
            part = fresh[a : a + PER_QUERY]
            toks = [self.first[np.frombuffer(w.encode("utf-8", "replace"), dtype=np.uint8)] for w in part]
            while True:
                todo = [i for i, t in enumerate(toks) if len(t)]
                size = [len(toks[i]) for i in todo]
                rows = pa.table({"word": np.repeat(np.array(todo, dtype=np.int32), size), "pos": np.concatenate([np.arange(n, dtype=np.int64) for n in size]), "tok": np.concatenate([toks[i] for i in todo])})
                self.con.register("start", rows)
                again = []
                for word, out, more in self.con.execute(_CONTRACT.format(steps=self.steps)).fetchall():
                    toks[word] = np.array(out, dtype=np.int32) if more else toks[word][:0]
                    if more:
                        again.append(word)
                    else:
                        self.known[part[word]] = out
                self.con.unregister("start")
                if not again:
                    break

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text."""
        split = [PATTERN.findall(t) if t else [] for t in texts]
        fresh = {w for s in split for w in s if w not in self.known}
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = {w for s in split for w in s}
        if fresh:
            self.learn(sorted(fresh))
        known = self.known
        return [[i for w in s for i in known[w]] for s in split]

    def decode_all(self, texts: list[list[int] | None]) -> list[str]:
        """The text of each list of token ids; lists without ids are empty texts."""
        size = [len(t or ()) for t in texts]
        rows = pa.table({"text": np.repeat(np.arange(len(texts), dtype=np.int64), size), "pos": np.concatenate([np.arange(n, dtype=np.int64) for n in size] or [np.zeros(0, np.int64)]), "id": pa.array([i for t in texts for i in t or ()], pa.int32())})
        self.con.register("tokens", rows)
        out = [""] * len(texts)
        for text, found in self.con.execute(_DECODE).fetchall():
            out[text] = found.decode("utf-8", "replace")
        self.con.unregister("tokens")
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of token ids."""
        return self.decode_all([ids])[0]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, steps: int = STEPS) -> Encoder:
    """This worker's encoder for a vocabulary."""
    if (path, steps) not in _ENCODERS:
        _ENCODERS[path, steps] = Encoder(path, steps)
    return _ENCODERS[path, steps]


def _mapper(path: str, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a in range(0, len(batch), rows):
                part = batch.slice(a, rows)
                ids = pa.array(enc.encode(part.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.record_batch([part.column(0), ids], ["doc_id", "ids"])

    return run


def token_ids(documents: DataFrame, path: str = VOCABULARY, rows: int = 2000) -> DataFrame:
    """(doc_id, ids) of every document."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_mapper(path, rows), "doc_id long, ids array<int>")


def _decoder(path: str, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a in range(0, len(batch), rows):
                part = batch.slice(a, rows)
                yield pa.record_batch([part.column(0), pa.array(enc.decode_all(part.column(1).to_pylist()), pa.string())], ["doc_id", "text"])

    return run


def texts_of(ids: DataFrame, path: str = VOCABULARY, rows: int = 500) -> DataFrame:
    """(doc_id, text) of encoded documents."""
    return ids.select("doc_id", "ids").mapInArrow(_decoder(path, rows), "doc_id long, text string")
