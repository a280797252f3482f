"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 8).

Each Python worker splits its texts into words and looks every word up in a cache; the distinct words it does not know
yet are encoded together by one recursive DuckDB query: rows (word, position, token) join the merge table, every word's
minimum-rank pair is contracted from the left, until no word has a pair that merges; an ordered aggregate gives the
identifiers. All occurrences of the pair that do not overlap are contracted in one step: a merge makes only pairs of higher
rank, so taking them one by one from the left gives the same.

A word of more than ``BLOCK`` bytes is encoded in overlapping blocks, so time is linear in its length. A row of tokens is the encoding of its bytes exactly if
each token and the next are the encoding of the bytes of both; so where two blocks have the same token in their overlap, the first one's tokens up to it and the
second one's from it on are the encoding of the whole. If they have none, the two blocks are encoded as one.

The merge table (fixed by the tokenizer, about 50,000 rows) is broadcast, so executors need no tokenizer file. DuckDB writes nothing to disk.

Defined results
- A null or empty text gives an empty list; every row gives one row, repeated rows too. No special tokens: their names are text.
- Texts are encoded whole. ``decode_ids`` is the inverse: bytes that are no UTF-8 come out as U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain
from types import ModuleType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Memory of either cache, about.
CACHE_BYTES = 100_000_000
SLICE_BYTES = 8_000_000
BLOCK, OVERLAP = 512, 128
#: Bytes that one DuckDB query encodes: of short words, and of blocks, which take more steps.
QUERY_BYTES, QUERY_BLOCK_BYTES = 200_000, 20_000
BLANK = re.compile(r"(?<=\S) (?=\S)")
#: A blank beside other white space, in texts of ASCII letters and in others.
BESIDE = [[x for c in cs for x in (f" {c}", f"{c} ")] for cs in (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f", [chr(c) for c in range(0x3001) if chr(c).isspace()])]

ENCODE_SQL = """
WITH RECURSIVE t(w, pos, tok, step) AS (
  SELECT w, pos, tok, 0 FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN taken THEN merged ELSE tok END, step + 1 FROM (
    SELECT *, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY pos), false) AS gone FROM (
      SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, island ORDER BY pos) % 2 = 1 AS taken FROM (
        SELECT *, i - row_number() OVER (PARTITION BY w, hit ORDER BY pos) AS island FROM (
          SELECT w, pos, tok, step, merged, i, coalesce(rank = least, false) AS hit FROM (
            SELECT p.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY p.w) AS least FROM (
              SELECT w, pos, tok, step, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS following, row_number() OVER (PARTITION BY w ORDER BY pos) AS i FROM t
            ) p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.following
          ) WHERE least IS NOT NULL))))
  WHERE NOT gone)
SELECT w, list(tok ORDER BY pos) AS ids FROM (SELECT *, max(step) OVER (PARTITION BY w) AS last FROM t) WHERE step = last GROUP BY w
"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


def read_tokenizer(path: str) -> dict[str, list[int]]:
    """``bytes``: the identifier of each byte; ``l``, ``r``, ``merged``: the merges by rank."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {
        "bytes": [vocab[c] for c in byte_letters()],
        "l": [vocab[a] for a, _ in pairs],
        "r": [vocab[b] for _, b in pairs],
        "merged": [vocab[a + b] for a, b in pairs],
    }


def token_bytes(tokenizer: dict[str, list[int]]) -> dict[int, bytes]:
    """The bytes of each token."""
    out = {t: bytes([b]) for b, t in enumerate(tokenizer["bytes"])}
    for left, right, merged in zip(tokenizer["l"], tokenizer["r"], tokenizer["merged"]):
        out[merged] = out[left] + out[right]
    return out


def token_lengths(tokenizer: dict[str, list[int]]) -> dict[int, int]:
    return {t: len(b) for t, b in token_bytes(tokenizer).items()}


def pieces_of(text: str) -> list[str]:
    """The text cut at every blank that has no white space beside it."""
    if text[0] != " " and text[-1] != " " and not any(x in text for x in BESIDE[not text.isascii()]):
        return text.split(" ")
    return BLANK.split(text)


class Encoder:
    """Word cache and DuckDB connection of one worker process."""

    def __init__(self, tokenizer: dict[str, list[int]]) -> None:
        import duckdb
        import regex

        self.split = regex.compile(PATTERN).findall
        self.bytes = tokenizer["bytes"]
        self.length = token_lengths(tokenizer)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.cached = self.held = 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        n = len(tokenizer["l"])
        merges = pa.table({"l": pa.array(tokenizer["l"], pa.int32()), "r": pa.array(tokenizer["r"], pa.int32()), "rank": pa.array(range(n), pa.int32()), "merged": pa.array(tokenizer["merged"], pa.int32())})
        self.db.register("merge_rows", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")

    def learn(self, words: list[str]) -> None:
        """Encode words into the cache, which is emptied first if it is full."""
        if self.cached > CACHE_BYTES:
            self.cache.clear()
            self.cached = 0
        raw = {w: w.encode("utf-8", "surrogatepass") for w in words}
        short = [w for w in words if len(raw[w]) <= BLOCK]
        self.cache.update(zip(short, self._encode([raw[w] for w in short], QUERY_BYTES)))
        for w in words:
            if len(raw[w]) > BLOCK:
                self.cache[w] = self._long(raw[w])
            self.cached += 100 + len(raw[w]) * 9

    def _long(self, raw: bytes) -> tuple[int, ...]:
        """A long word by its blocks."""
        spans = [(s, min(len(raw), s + BLOCK)) for s in range(0, len(raw) - OVERLAP, BLOCK - OVERLAP)]
        blocks = [self._placed(a, ids) for (a, _), ids in zip(spans, self._encode([raw[a:b] for a, b in spans], QUERY_BLOCK_BYTES))]
        #: Blocks (places, tokens, how many of ``blocks`` they hold), and where each meets the one before it.
        kept: list[tuple[list[int], tuple[int, ...], int]] = []
        meets: list[int] = []
        i = 0
        while i < len(blocks):
            places, ids, held = *blocks[i], 1
            i += 1
            while kept and (meet := self._meet(kept[-1], places, ids)) is None:
                before = kept.pop()
                meets.pop()
                # Twice as many blocks as before, so that words whose blocks never meet take no more than n log n.
                held += before[2]
                more = min(len(blocks), i + held)
                held, i = held + more - i, more
                ids = self._encode([raw[before[0][0] : spans[i - 1][1]]], QUERY_BLOCK_BYTES)[0]
                places = self._placed(before[0][0], ids)[0]
            meets.append(meet if kept else 0)
            kept.append((places, ids, held))
        out: list[int] = []
        for n, (places, ids, _) in enumerate(kept):
            first = bisect_left(places, meets[n])
            last = bisect_left(places, meets[n + 1]) if n + 1 < len(kept) else len(ids)
            out += ids[first:last]
        return tuple(out)

    def _placed(self, start: int, ids: tuple[int, ...]) -> tuple[list[int], tuple[int, ...]]:
        """Where each token starts, and the tokens."""
        return list(accumulate((self.length[t] for t in ids[:-1]), initial=start)), ids

    @staticmethod
    def _meet(before: tuple[list[int], tuple[int, ...], int], places: list[int], ids: tuple[int, ...]) -> int | None:
        """Where both have the same token, as far left as possible."""
        own = dict(zip(before[0][bisect_left(before[0], places[0]) :], before[1][bisect_left(before[0], places[0]) :]))
        for at, token in zip(places, ids):
            if at > before[0][-1]:
                return None
            if own.get(at) == token:
                return at
        return None

    def _encode(self, words: list[bytes], most: int) -> list[tuple[int, ...]]:
        """The identifiers of each word by recursive queries over at most ``most`` bytes, or one word."""
        out: list[tuple[int, ...]] = [()] * len(words)
        first = 0
        while first < len(words):
            w, pos, tok, n = array("i"), array("i"), array("i"), first
            while n < len(words) and (n == first or len(w) + len(words[n]) <= most):
                w.extend([n] * len(words[n]))
                pos.extend(range(len(words[n])))
                tok.extend(map(self.bytes.__getitem__, words[n]))
                n += 1
            self.db.register("start", pa.table({"w": pa.array(w, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tok, pa.int32())}))
            for k, ids in self.db.execute(ENCODE_SQL).fetchall():
                out[k] = tuple(ids)
            self.db.unregister("start")
            first = n
        return out

    def _pieces(self, pieces: list[str], lead: str) -> list[tuple[int, ...]]:
        """The identifiers of each piece with ``lead`` before it."""
        split = [self.split(lead + p) for p in pieces]
        # ``learn`` may empty the cache, so it then gets all words.
        missing = {w for ws in split for w in ws if w not in self.cache}
        if missing:
            if self.cached > CACHE_BYTES:
                missing = {w for ws in split for w in ws}
            self.learn(sorted(missing))
        known = self.cache.__getitem__
        return [tuple(chain.from_iterable(map(known, ws))) for ws in split]

    def encode(self, texts: list[str | None]) -> list[array]:
        """The identifiers of each text.

        Texts are cut at single blanks between other characters, where no token of the pattern reaches across; pieces, which recur, are
        looked up whole.
        """
        cut = [pieces_of(t) if t else [] for t in texts]
        heads = self._pieces([ps[0] for ps in cut if ps], "")
        if self.held > CACHE_BYTES:
            self.pieces.clear()
            self.held = 0
        new = sorted({p for ps in cut for p in ps[1:] if p not in self.pieces})
        self.held += sum(100 + 9 * len(p) for p in new)
        self.pieces.update(zip(new, self._pieces(new, " ")))
        known, head = self.pieces.__getitem__, iter(heads)
        return [array("i", chain(next(head), chain.from_iterable(map(known, ps[1:])))) if ps else array("i") for ps in cut]


def _encoder(digest: str, shared) -> Encoder:
    """The encoder of this worker process for the merge table with that digest; workers outlive tasks, so their caches do."""
    kept = sys.modules.setdefault("_tessera_encoders", ModuleType("_tessera_encoders"))
    if not hasattr(kept, digest):
        setattr(kept, digest, Encoder(shared.value))
    return getattr(kept, digest)


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``key, ids`` of every row."""
    model = read_tokenizer(tokenizer)
    shared, digest = df.sparkSession.sparkContext.broadcast(model), "m" + hashlib.sha256(repr(model).encode()).hexdigest()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(digest, shared)
        for batch in batches:
            # Few large calls, as every DuckDB query costs some time of its own, but of a bounded size.
            step = max(1, int(batch.num_rows * min(1.0, SLICE_BYTES / max(1, batch.nbytes))))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids = encoder.encode(part.column(1).to_pylist())
                offsets = array("i", [0])
                for x in ids:
                    offsets.append(offsets[-1] + len(x))
                flat = pa.array(array("i", chain.from_iterable(ids)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str, ids: str, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``key, text`` of every row: the text that the identifiers stand for, null for null."""
    shared = df.sparkSession.sparkContext.broadcast(token_bytes(read_tokenizer(tokenizer)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.__getitem__
        for batch in batches:
            texts = [None if row is None else b"".join(map(known, row)).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
