"""Garbled text from wrong character encoding (problem 3).

1. Adjacent character pairs of every text are counted (locally per task, then added up). A pair's score is the logarithm
   of its share of the corpus's mutual information, p(ab) * log2(p(ab) / (p(a) p(b))).
2. Within a text the improbable runs are the maximal scoring segments (Ruzzo-Tompa) of ``mean - score``, the mean being
   that of the dataset's pairs.
3. Only inside runs that hold a character beyond ASCII, inverse mappings are tried: written as UTF-8 and misread up to
   three times in a row, or written in one byte a character and misread once. The one whose pairs score best in sum is
   taken if it gains enough over the run.

The pair model is bounded: per dataset the ``ALPHABET`` most frequent characters stand for themselves, all others share
one class, so it has at most (ALPHABET + 2)^2 entries whatever the corpus. It is counted over all rows.

Defined results
- Null, empty and pure ASCII texts are never reported.
- A text with U+FFFD has lost bytes: reported as not restorable; other runs of it are restored as far as possible.
- A text with a run whose inverse mapping is found is reported with the restored text.
- Rows with the same key and text are reported once. Very long texts are scanned whole, in linear time.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored

ALPHABET = 512
#: Bits that a mapping must gain: UTF-8 is strict and so evidence in itself, a mapping byte by byte is not.
MARGIN = {"utf-8": 0.5, "cp1252": 2.0}
#: Least pointwise information that a pair counts with, so that frequent pairs of independent characters stay probable.
LEAST_PMI = 0.25
MAX_ROUNDS = 3
OTHER, EDGE = "￿", "\x02"
#: Categories that no right text gains: accents standing alone, controls, unassigned and private characters.
NO_TEXT = ("Lm", "Sk", "Cn", "Co")
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
#: Encodings that texts were written in and misread as.
WRITTEN = ("utf-8", "cp1252")
READ_AS = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman")


def _inverse_table(codec: str) -> dict[str, int]:
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b  # decoders let undefined bytes through as control characters
    return table


def inverse_candidates(run: str, tables: dict[str, dict[str, int]], rounds: int = MAX_ROUNDS) -> list[tuple[str, str]]:
    """Texts that, misread up to ``rounds`` times, give ``run``, with the encoding they were written in."""
    seen, level = {run: ""}, [run]
    for n in range(rounds):
        following = []
        for text in level:
            for codec, table in tables.items():
                raw = bytearray()
                for ch in text:
                    if ord(ch) < 128:
                        raw.append(ord(ch))
                    elif ch in table:
                        raw.append(table[ch])
                    else:
                        break
                else:
                    for written in WRITTEN:
                        if written != "utf-8" and (n or codec in ("cp1252", "latin-1")):
                            continue
                        try:
                            fixed = raw.decode(written)
                        except UnicodeDecodeError:
                            continue
                        if fixed not in seen:
                            seen[fixed] = written
                            if written == "utf-8":
                                following.append(fixed)
        level = following
    # What is still garbled after a round may hold anything, but what is taken for right may not.
    return sorted((text, written) for text, written in seen.items() if written and not any(unicodedata.category(c) in NO_TEXT for c in text if c not in run))


def maximal_segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments [start, end), from left to right.

    Each segment links to the last one before it whose left sum is smaller, so a search passes no segment twice and time is linear.
    """
    parts: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    total = 0.0
    for i, s in enumerate(scores):
        start, before = i, total
        total += s
        if s <= 0:
            continue
        j = len(parts) - 1
        while True:
            while j >= 0 and parts[j][2] >= before:
                j = parts[j][4]
            if j < 0 or parts[j][3] >= total:
                parts.append((start, i + 1, before, total, j))
                break
            start, _, before, _, following = parts[j]
            del parts[j:]
            j = following
    return [p[:2] for p in parts]


class PairModel:
    """Scores of adjacent pairs from counts {(a, b): n}."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        n = sum(counts.values()) or 1
        self.tables = {c: _inverse_table(c) for c in READ_AS}
        self.inverse: dict[str, list[tuple[str, str]]] = {}
        left, right = Counter(), Counter()
        for (a, b), c in counts.items():
            left[a] += c
            right[b] += c
        self.known = {x for pair in counts for x in pair}
        self.floor = math.log2(0.5 * LEAST_PMI / n)
        self.score = {(a, b): math.log2(c / n * max(LEAST_PMI, math.log2(c * n / (left[a] * right[b])))) for (a, b), c in counts.items()}
        self.mean = sum(c * self.score[p] for p, c in counts.items()) / n

    def scores(self, text: str) -> list[float]:
        chars = [EDGE, *(c if c in self.known else OTHER for c in text), EDGE]
        return [self.score.get(p, self.floor) for p in zip(chars, chars[1:])]

    def candidates(self, run: str) -> list[tuple[str, str]]:
        if run not in self.inverse:
            if len(self.inverse) > 10_000:
                self.inverse.clear()
            self.inverse[run] = inverse_candidates(run, self.tables)
        return self.inverse[run]

    def restore(self, text: str) -> tuple[str, bool]:
        """The text with its runs restored, and whether a run was."""
        runs: list[list[int]] = []
        for a, b in maximal_segments([self.mean - s for s in self.scores(text)]):
            start, end = max(0, a - 1), min(len(text), b)  # pair i joins the characters i - 1 and i
            for m in BEYOND_ASCII.finditer(text, start, end):
                run = [m.start(), m.end()]
                while run[0] > 0 and ord(text[run[0] - 1]) > 127:
                    run[0] -= 1
                while run[1] < len(text) and ord(text[run[1]]) > 127:
                    run[1] += 1
                if not runs or run[0] >= runs[-1][1]:
                    runs.append(run)
        out, at, found = [], 0, False
        for start, end in runs:
            left, right = text[max(0, start - 1) : start] or EDGE, text[end : end + 1] or EDGE

            def bits(s: str) -> float:
                chars = [c if c in self.known else OTHER for c in (left, *s, right)]
                return sum(self.score.get(p, self.floor) for p in zip(chars, chars[1:]))

            own = bits(text[start:end])
            gains = [(bits(s) - own - MARGIN[written], s) for s, written in self.candidates(text[start:end])]
            if gains and max(gains)[0] >= 0:
                out += [text[at:start], max(gains)[1]]
                at, found = end, True
        return "".join(out) + text[at:], found


def pair_counts(df: DataFrame, dataset: str, text: str, alphabet: int = ALPHABET) -> DataFrame:
    """``dataset, a, b, n``: adjacent pairs of all texts, over a bounded alphabet per dataset."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(d, a, b, n) for d, c in counts.items() for (a, b), n in c.items()], columns=["dataset", "a", "b", "n"])

        for batch in batches:
            for d, group in batch.groupby("dataset"):
                c = counts.setdefault(d, Counter())
                for t in group["text"]:
                    t = EDGE + t + EDGE
                    c.update(zip(t, t[1:]))
            if sum(map(len, counts.values())) > 500_000:
                yield rows()
                counts.clear()
        yield rows()

    texts = df.select(F.col(dataset).alias("dataset"), F.col(text).alias("text")).filter("text <> ''")
    pairs = texts.mapInPandas(count, "dataset string, a string, b string, n bigint").groupBy("dataset", "a", "b").agg(F.sum("n").alias("n"))
    pairs = stored(pairs)
    per_char = pairs.groupBy("dataset", "a").agg(F.sum("n").alias("n")).groupBy("dataset").agg(F.collect_list(F.struct("n", "a")).alias("__c"))
    # Per dataset at most one entry per Unicode character enters the list.
    keep = per_char.select("dataset", F.transform(F.slice(F.reverse(F.array_sort("__c")), 1, alphabet), lambda x: x["a"]).alias("__keep"))

    def known(c: str):
        return F.when(F.array_contains("__keep", F.col(c)) | (F.col(c) == EDGE), F.col(c)).otherwise(F.lit(OTHER)).alias(c)

    return pairs.join(keep, "dataset").select("dataset", known("a"), known("b"), "n").groupBy("dataset", "a", "b").agg(F.sum("n").alias("n"))


def restore_encoding(df: DataFrame, dataset: str, key: str, text: str) -> DataFrame:
    """``dataset, key, text, restored, restorable`` of the rows whose text was decoded with a wrong encoding."""
    counts: dict[str, dict[tuple[str, str], int]] = {}
    for r in pair_counts(df, dataset, text).collect():
        counts.setdefault(r["dataset"], {})[(r["a"], r["b"])] = r["n"]
    shared = df.sparkSession.sparkContext.broadcast(counts)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {d: PairModel(c) for d, c in shared.value.items()}
        seen: dict[tuple[str, str], tuple | None] = {}
        for batch in batches:
            rows = []
            for d, k, t in zip(batch["dataset"], batch["key"], batch["text"]):
                if (d, t) not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    fixed, found = models[d].restore(t)
                    seen[d, t] = (fixed, "�" not in fixed) if found or "�" in t else None
                if got := seen[d, t]:
                    rows.append((d, k, t, *got))
            yield pd.DataFrame(rows, columns=["dataset", "key", "text", "restored", "restorable"])

    rows = df.select(F.col(dataset).alias("dataset"), F.col(key).alias("key"), F.col(text).alias("text"))
    suspects = rows.filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    found = suspects.mapInPandas(run, f"dataset string, key {kind}, text string, restored string, restorable boolean")
    return found.dropDuplicates(["dataset", "key", "text"])
