"""Evaluation texts leaking into training text (problem 9).

Test items are short, documents long, so containment is searched, not similarity. Both are cut into sets of one size: the
windows of ``RUN`` consecutive words, each the set of its five-word shingles. The sketch of a window is its MinHash, the
smallest shingle hash; two texts that share a run of ``RUN`` words share that window and so its MinHash, whatever else they
hold, hence no leak is missed. One sketch of a whole document can't do that, in whatever size class: a run of twelve words is eight shingles of
the thousands of a long document. Windows of one size take the place of the size classes.

Sketches are compared with a bitmap of the items' sketches, whose size is fixed (``BITS``), then joined with the items by
hash; hashes that many documents hold (boilerplate) are split over ``SALTS`` tasks. Each sketch carries the words around its shingle that any window with
this minimum can reach, so a candidate is verified exactly, word by word, without reading the document again. Verified stretches that overlap on one
alignment of document and item are put together, which gives the whole shared run and the exact containment.

Defined results
- Words are runs of letters and digits, compared in lower case. Items and documents of fewer than ``RUN`` words match nothing.
- Null, empty and blank texts match nothing, nor do rows with a null key. A document and an item are reported once however often they match;
  rows repeated with the same keys too. Documents are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

RUN = 12
SHINGLE = 5
BITS = 1 << 22
SALTS = 64
SLICE = 4_000_000


def normal_words(column: str):
    """Words in lower case, parted by single blanks."""
    return F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, in about log2(width) passes."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return values if span == width else pick(values[: len(values) - (width - span)], values[width - span :])


def window_sketches(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the shingles that are the MinHash of some window; ``text``: which text each word belongs to."""
    n = len(words)
    if n < RUN:
        return np.zeros(0, int), np.zeros(0, np.int64)
    codes, distinct = pd.factorize(words)
    h = pd.util.hash_array(distinct, categorize=False)[codes]
    mixed = np.zeros(n - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : n - SHINGLE + 1 + j]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    width = RUN - SHINGLE + 1
    least = _sliding(mixed, width, np.minimum)
    inside = text[: n - RUN + 1] == text[RUN - 1 :]  # windows within one text
    least[~inside] = 0
    beside = np.zeros(width - 1, np.uint64)
    reached = _sliding(np.concatenate([beside, least, beside]), width, np.maximum)
    # The shingle at a place is the minimum of a window if the largest minimum of the windows over it is its own hash.
    places = np.flatnonzero((reached == mixed) & (text[: n - SHINGLE + 1] == text[SHINGLE - 1 :]))
    return places, mixed[places].view(np.int64)


def sketch_rows(df: DataFrame, key: str, text: str, bitmap=None) -> DataFrame:
    """``key, hash, at, place, around``: sketches of all texts (``at``: number of the shingle's first word, ``place``: where it is in the
    words ``around``); ``bitmap``: keep those set in it."""
    kind = df.schema[key].dataType.simpleString()
    reach = RUN - SHINGLE
    names = ["key", "hash", "at", "place", "around"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            part = (batch["words"].str.len().cumsum() // SLICE).to_numpy()
            for p in np.unique(part):
                rows = batch[part == p]
                texts = rows["words"].tolist()
                size = np.array([t.count(" ") + 1 for t in texts])
                words = np.array(" ".join(texts).split(" "), dtype=object)
                starts = np.cumsum(size) - size
                doc = np.repeat(np.arange(len(texts)), size)
                places, hashes = window_sketches(words, doc)
                if bits is not None:
                    b = hashes & (BITS - 1)
                    hit = (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
                    places, hashes = places[hit], hashes[hit]
                owner = doc[places]
                left = np.maximum(starts[owner], places - reach)
                right = np.minimum(starts[owner] + size[owner], places + RUN)
                around = pd.Series([words[a:b] for a, b in zip(left, right)], dtype=object)
                keys = rows["key"].to_numpy()[owner]
                yield pd.DataFrame(dict(zip(names, (keys, hashes, places - starts[owner], places - left, around))))

    words = df.select(F.col(key).alias("key"), normal_words(text).alias("words")).filter("words <> '' and key is not null")
    return words.mapInPandas(run, f"key {kind}, hash bigint, at bigint, place int, around array<string>")


def shared_runs(documents: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``doc_key, item_key, doc_word, item_word, run_words``: every shared run of ``RUN`` words or more, as long as it is."""
    item_rows = cut(sketch_rows(items.dropDuplicates([item_key, item_text]), item_key, item_text))
    bit = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    # At most BITS / 64 rows reach the driver.
    set_bits = item_rows.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")).collect()
    bitmap = np.zeros(BITS // 64, np.int64)
    for r in set_bits:
        bitmap[r["at"]] = r["bits"]
    shared = documents.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    found = cut(sketch_rows(documents, doc_key, doc_text, shared))
    # At most SALTS * 100 hashes are held by more than that share of all sketches.
    total = found.count()
    hot = F.broadcast(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1000, total // (SALTS * 100))).select("hash", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    d = found.join(hot, "hash", "left").withColumn("salt", salt).drop("hot").alias("d")
    i = item_rows.join(hot, "hash", "left").withColumn("salt", F.explode(salts)).drop("hot").alias("i")
    pairs = d.join(i, (F.col("d.hash") == F.col("i.hash")) & (F.col("d.salt") == F.col("i.salt")))
    dw, iw = F.col("d.around"), F.col("i.around")
    dp, ip = F.col("d.place"), F.col("i.place")
    same = F.transform(F.sequence(F.lit(-(RUN - SHINGLE)), F.lit(RUN - 1)), lambda o: F.when((dp + o >= 0) & (ip + o >= 0) & (F.get(dw, dp + o) == F.get(iw, ip + o)), F.lit("1")).otherwise(F.lit("0")))
    # The verified stretch holds the shingle itself, so it starts behind the last unequal word before it.
    flags = F.array_join(same, "")
    before = F.length(F.regexp_extract(F.substring(flags, 1, RUN - SHINGLE), "(1*)$", 1))
    after = F.length(F.regexp_extract(F.substring(flags, RUN - SHINGLE + 1, RUN), "^(1*)", 1))
    stretches = pairs.select(
        F.col("d.key").alias("__d"), F.col("i.key").alias("__i"), (F.col("d.at") - F.col("i.at")).alias("shift"),
        (F.col("d.at") - before).alias("start"), (F.col("d.at") + after).alias("end"), after.alias("after"),
    ).filter(F.col("after") >= SHINGLE)
    line = Window.partitionBy("__d", "__i", "shift").orderBy("start", "end")
    reached = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = stretches.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn("island", F.sum("new").over(line))
    runs = islands.groupBy("__d", "__i", "shift", "island").agg(F.min("start").alias("doc_word"), F.max("end").alias("end"))
    return runs.filter(F.col("end") - F.col("doc_word") >= RUN).select(
        F.col("__d").alias(doc_key), F.col("__i").alias(item_key), "doc_word", (F.col("doc_word") - F.col("shift")).alias("item_word"), (F.col("end") - F.col("doc_word")).alias("run_words")
    ).distinct()


def leaks(documents: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``doc_key, item_key, run_words, shared_shingles``: pairs that share a run of ``RUN`` words, the longest run, and how many places of the
    item hold a five-word shingle of a shared run (its containment, times its number of shingles)."""
    runs = shared_runs(documents, doc_key, doc_text, items, item_key, item_text)
    longest = runs.groupBy(doc_key, item_key, "item_word").agg(F.max("run_words").alias("run_words"))
    places = longest.select(doc_key, item_key, "run_words", F.explode(F.sequence("item_word", F.col("item_word") + F.col("run_words") - SHINGLE)).alias("__p"))
    by_place = places.groupBy(doc_key, item_key, "__p").agg(F.max("run_words").alias("run_words"))
    return by_place.groupBy(doc_key, item_key).agg(F.max("run_words").alias("run_words"), F.count(F.lit(1)).alias("shared_shingles"))
