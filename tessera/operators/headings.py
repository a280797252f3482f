"""Heading, spatial and nearest joins with ambiguity rules (J5, J7, J9, J27, J31), and captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import heading_keys, norm, plural_forms
from tessera.operators.folds import fold_sorted

PREFIX = 6


def heading_matches(lines: DataFrame, line: str, line_key: str, names: DataFrame, name: str, name_key: str, group: str, page: str, margin: int = 8, words: int = 6) -> DataFrame:
    """``line_key, name_key, kind`` (full, tail or prefix): lines of at most ``words`` words against the names of their group at most
    ``margin`` pages away, by a full variant key, else by the last two words, else names whose key starts with the line's (of six letters or more).
    The best kind that hits counts; if it hits several different names the line is refused.

    Prefixes meet by their first six letters, never name by name.
    """
    text = F.trim(line)
    short = lines.filter((F.size(F.split(text, r"\s+")) <= words) & (norm(text) != ""))
    said = short.select(F.col(line_key).alias("lk"), F.col(group).alias("g"), F.col(page).alias("lp"), norm(text).alias("k"))
    known = names.select(F.col(name_key).alias("nk"), F.col(group).alias("g"), F.col(page).alias("np"), F.col(name).alias("n"), norm(F.col(name)).alias("full"))
    tail = norm(F.regexp_extract("n", r"(\S+\s+\S+)\s*$", 1))
    keys = known.select("nk", "g", "np", "full", F.explode(F.array_distinct(F.concat(F.transform(heading_keys(F.col("n")), lambda k: F.struct(F.lit(1).alias("r"), k.alias("k"))), F.array(F.struct(F.lit(2).alias("r"), tail.alias("k")))))).alias("e"))
    keys = keys.select("nk", "g", "np", "full", "e.r", "e.k").filter("k <> ''")
    equal = said.join(keys, ["g", "k"]).select("lk", "lp", "nk", "np", "full", "r")
    long = said.filter(F.length("k") >= PREFIX).withColumn("h", F.left("k", F.lit(PREFIX)))
    starts = long.join(known.filter(F.length("full") > PREFIX).withColumn("h", F.left("full", F.lit(PREFIX))).drop("n"), ["g", "h"]).filter(F.col("full").startswith(F.col("k"))).select("lk", "lp", "nk", "np", "full", F.lit(3).alias("r"))
    near = equal.unionByName(starts).filter(F.abs(F.col("lp") - F.col("np")) <= margin)
    best = near.groupBy("lk").agg(F.min("r").alias("best"))
    hits = near.join(best, "lk").filter("r = best").groupBy("lk", "best").agg(F.min("full").alias("lo"), F.max("full").alias("hi"), F.min("nk").alias("nk")).filter("lo = hi")
    kind = F.when(F.col("best") == 1, "full").when(F.col("best") == 2, "tail").otherwise("prefix")
    return hits.select(F.col("lk").alias(line_key), F.col("nk").alias(name_key), kind.alias("kind"))


def nearest_free(points: DataFrame, targets: DataFrame, keys: Sequence[str], at: str, point: str, target: str, most: float) -> DataFrame:
    """In order of their place every point takes the nearest target of its keys that is still free and closer than ``most``: ``keys, point, target``.
    Ties: the target that comes first. Greedy, so an ordered fold; only targets that a later point can still reach are kept."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema} | {f.name: f.dataType.simpleString() for f in targets.schema}
    null = F.lit(None)
    # A target enters as soon as a point can reach it, a point acts when all targets it can reach have entered.
    rows = targets.select(*keys, (F.col(at).cast("double") - most).alias("__when"), F.lit(0).alias("__kind"), F.col(at).cast("double").alias("__at"), null.cast(kinds[point]).alias("__p"), F.col(target).alias("__t"))
    rows = rows.unionByName(points.select(*keys, F.col(at).cast("double").alias("__when"), F.lit(1).alias("__kind"), F.col(at).cast("double").alias("__at"), F.col(point).alias("__p"), null.cast(kinds[target]).alias("__t")))
    n = len(keys)

    def start():
        free: list[tuple[float, object]] = []

        def step(row):
            kind, place, p, t = row[n + 1 :]
            if kind == 0:
                free.append((place, t))
                return []
            free[:] = [f for f in free if f[0] > place - most]
            near = [f for f in free if abs(f[0] - place) < most]
            if not near:
                return []
            hit = min(near, key=lambda f: (abs(f[0] - place), f[0]))
            free.remove(hit)
            return [(*row[:n], p, hit[1])]

        return step, list

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{point} {kinds[point]}", f"{target} {kinds[target]}"])
    return fold_sorted(rows, keys, ["__when", "__kind", "__at", "__p", "__t"], start, schema)


def evidence_pairs(images: DataFrame, lines: DataFrame, keys: Sequence[str], page: str, reach: int, score: Column, image: str, item: str) -> DataFrame:
    """Per item the image with most evidence among those at most ``reach`` pages from a line that names it. ``score`` may use the columns of both
    sides (the line's page is ``line_page``); ties: smallest image. Pages meet by equality after the lines are spread over the pages in reach."""
    spread = lines.withColumn("line_page", F.col(page)).withColumn(page, F.explode(F.sequence(F.col(page) - reach, F.col(page) + reach)))
    pairs = images.join(spread, [*keys, page]).withColumn("score", score)
    best = pairs.groupBy(item).agg(F.max("score").alias("score"))
    tied = pairs.select(item, image, "score").join(best, [item, "score"])
    return tied.groupBy(item, "score").agg(F.min(image).alias(image))


def anchored_rows(items: DataFrame, item: str, price: str, lines: DataFrame, line: str, order: str, group: str) -> DataFrame:
    """The first line of the item's group that shows its price, in any of its formats: ``item, name``, the leading words of that line. Lines meet
    items by the numbers in them, thousands separators dropped."""
    shown = F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace(line, r"(?<=\d)[, \x{A0}.](?=\d{3}(?!\d))", ""), F.lit(r"(\d+)"), 1)))
    numbers = lines.select(group, order, line, shown.alias("__n"))
    hit = items.select(item, group, F.col(price).cast("string").alias("__n")).join(numbers, [group, "__n"])
    first = hit.groupBy(item).agg(F.min(F.struct(order, line)).alias("b"))
    return first.select(item, F.trim(F.regexp_extract(F.col(f"b.{line}"), r"^\s*((?:\p{L}[\p{L}\p{N}_'’.-]*\s*)+)", 1)).alias("name"))


def caption_parts(text: Column, vocabulary: Sequence[str]) -> Column:
    """A caption split into known words, longest first, all or nothing (null)."""
    words = sorted(vocabulary, key=lambda w: (-len(w), w))
    pattern = "|".join(words)
    return F.when(text.rlike(f"^(?:{pattern})+$"), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))


def two_columns(words: DataFrame, keys: Sequence[str], x: str, width: float, share: float = 0.15) -> DataFrame:
    """``keys, columns``: 2 if the smaller half of the page has that share of its words at least."""
    left = F.count(F.when(F.col(x) < width / 2, 1))
    n = F.count(F.lit(1))
    return words.groupBy(*keys).agg(F.when(F.least(left, n - left) >= share * n, 2).otherwise(1).alias("columns"))


def heading_targets(lines: DataFrame, line: str, line_key: str, names: DataFrame, name: str, name_key: str, group: str, page: str, subtype: str, margin: int = 8, words: int = 6) -> DataFrame:
    """``line_key, name_key, kind``: all names that a line of at most ``words`` words may head, within its ``group`` and, if it has a page, ``margin`` pages.

    A line's key is its own if that is a heading key of some name, else that of its last two words, else of its last, else its own. Names of the key are met ('name'), and those whose
    whole key goes on behind it, if it has ``PREFIX`` letters ('family'). If neither is there, names of a subtype of that key are ('subtype'). Where several names are left of a
    key that is nobody's whole key, they must be one family: equal but for a remark in parentheses and a number at the end."""
    text = F.trim(line)
    parts = F.split(text, r"\s+")
    said = lines.filter((F.size(parts) <= words) & (norm(text) != "")).select(F.col(line_key).alias("lk"), F.col(group).alias("g"), F.col(page).alias("lp"), parts.alias("ws"), norm(text).alias("k0"))
    last = lambda k: F.when(F.size("ws") > k, norm(F.array_join(F.slice("ws", F.size("ws") - k + 1, F.lit(k)), " ")))
    known = names.filter(F.col(name).isNotNull()).select(F.col(name_key).alias("nk"), F.col(group).alias("g"), F.col(page).alias("np"), F.col(name).alias("n"), F.col(subtype).alias("sub"))
    keys = known.select("nk", "g", "np", "n", F.explode(heading_keys(F.col("n"))).alias("k"))
    full = known.select("nk", "g", "np", "n", F.explode(plural_forms(norm(F.col("n")))).alias("k")).filter("k <> ''")
    subs = known.filter("sub <> ''").select("nk", "g", "np", "n", F.explode(plural_forms(norm(F.replace("sub", F.lit("_"), F.lit(" "))))).alias("k"))
    tried = F.array(F.struct(F.lit(0).alias("r"), F.col("k0").alias("k")), F.struct(F.lit(1).alias("r"), last(2).alias("k")), F.struct(F.lit(2).alias("r"), last(1).alias("k")))
    found = said.select("lk", "g", F.explode(tried).alias("t")).select("lk", "g", "t.r", "t.k").filter("k <> ''").join(keys.select("g", "k").distinct(), ["g", "k"])
    chosen = found.groupBy("lk").agg(F.min(F.struct("r", "k")).alias("c"))
    keyed = said.join(chosen, "lk", "left").select("lk", "g", "lp", F.coalesce("c.k", "k0").alias("k"))
    columns = ["lk", "lp", "k", "nk", "np", "n", "g"]
    met = keyed.join(keys, ["g", "k"]).select(*columns, F.lit("name").alias("kind"))
    heads = full.filter(F.length("k") > PREFIX).withColumnRenamed("k", "whole").withColumn("h", F.left("whole", F.lit(PREFIX)))
    behind = keyed.filter(F.length("k") >= PREFIX).withColumn("h", F.left("k", F.lit(PREFIX))).join(heads, ["g", "h"]).filter(F.col("whole").startswith(F.col("k")) & (F.col("whole") != F.col("k")))
    met = met.unionByName(behind.select(*columns, F.lit("family").alias("kind")))
    near = F.col("lp").isNull() | (F.abs(F.col("lp") - F.col("np")) <= margin)
    of_kind = keyed.join(met.select("lk").distinct(), "lk", "left_anti").join(subs, ["g", "k"]).filter(near).select("lk", "nk", F.lit("subtype").alias("kind"))
    met = met.filter(near)
    base = F.regexp_replace(F.trim(F.lower(F.regexp_replace("n", r"\s*\(.*?\)$", ""))), r"\s+\d+$", "")
    whole = full.select("g", "k", F.lit(True).alias("whole")).distinct()
    judged = met.join(whole, ["g", "k"], "left").groupBy("lk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min(base).alias("blo"), F.max(base).alias("bhi"), F.max("whole").alias("whole"))
    sure = judged.filter((F.col("lo") == F.col("hi")) | F.coalesce("whole", F.lit(False)) | (F.col("blo") == F.col("bhi"))).select("lk")
    out = met.join(sure, "lk").groupBy("lk", "nk").agg(F.max("kind").alias("kind")).unionByName(of_kind.distinct())
    return out.select(F.col("lk").alias(line_key), F.col("nk").alias(name_key), "kind")
