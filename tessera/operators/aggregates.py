"""Aggregations (A*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_first(df: DataFrame, group: Sequence[str], value: str, order: Column) -> DataFrame:
    """The most frequent value; ties: the one seen first in ``order``. ``group, value, n``."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    best = F.max(F.struct(F.col("n"), (-F.col("__first")).alias("f"), F.col(value).alias("v")))
    return counts.groupBy(*group).agg(best.alias("b")).select(*group, F.col("b.v").alias(value), "b.n")


def quorum(df: DataFrame, group: Sequence[str], value: str, least: int = 3, factor: int = 2) -> DataFrame:
    """A10: the winner if it has ``least`` votes and ``factor`` times all others together, else null. Ties: smallest value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*group).agg(F.sum("n").alias("votes"), F.max("n").alias("top"))
    first = counts.join(top, list(group)).filter("n = top").groupBy(*group, "votes", "top").agg(F.min(value).alias("__v"))
    won = (F.col("top") >= least) & (F.col("top") >= factor * (F.col("votes") - F.col("top")))
    return first.select(*group, "votes", "top", F.when(won, F.col("__v")).alias("winner"))


def longest(df: DataFrame, group: Sequence[str], text: str, order: str) -> DataFrame:
    """The longest text; ties: the first in order."""
    rows = df.filter(F.col(text).isNotNull())
    best = F.max(F.struct(F.length(text).alias("l"), (-F.col(order)).alias("o")))
    return rows.groupBy(*group).agg(best.alias("b")).select(*group, F.col("b.l").alias("length"), (-F.col("b.o")).alias(order))


def field_union_fill(df: DataFrame, group: Sequence[str], fields: str, base: Sequence[str] = ()) -> DataFrame:
    """The map ``fields`` of each row with every key its group or ``base`` knows, missing ones ''."""
    keys = df.select(*group, F.explode(F.map_keys(fields)).alias("__k")).distinct().groupBy(*group).agg(F.collect_set("__k").alias("__ks"))
    # A group's template has each field name once, however many rows the group has.
    template = F.array_sort(F.array_union(F.coalesce("__ks", F.array().cast("array<string>")), F.array(*map(F.lit, base)).cast("array<string>")))
    out = df.join(keys, list(group), "left").withColumn("__t", template)
    filled = F.map_from_arrays("__t", F.transform("__t", lambda k: F.coalesce(F.try_element_at(F.col(fields), k), F.lit(""))))
    return out.withColumn(fields, filled).drop("__t", "__ks")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Words of small letters and their counts over all texts."""
    return df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A4: keys of several rows with the number of redundant ones."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("redundant", F.col("n") - 1)


def repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A5: every row after the first of its keys; only keys of several rows are numbered."""
    several = duplicates(df, keys).select(*keys)
    hits = df.join(several, list(keys), "left_semi")
    return hits.withColumn("hit", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("hit > 1")


def coverage(df: DataFrame, parts: Mapping[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """Rows and, per part, the share in per mille that fulfils it, rounded down."""
    n = F.count(F.lit(1))
    return df.groupBy(*group).agg(n.alias("n"), *(F.floor(F.count(F.when(c, 1)) * 1000 / n).alias(name) for name, c in parts.items()))


def high_water(current: DataFrame, floor: DataFrame, keys: Sequence[str], measures: Sequence[str], tolerance: float = 0.98) -> DataFrame:
    """Ok where every measure reaches ``tolerance`` times its floor; the new floor is the larger of both."""
    low = floor.select(*keys, *(F.col(m).alias(f"__f_{m}") for m in measures))
    out = current.join(low, list(keys), "left")
    ok = F.lit(True)
    for m in measures:
        ok = ok & F.coalesce(F.col(m) >= tolerance * F.col(f"__f_{m}"), F.lit(True))
    return out.select(*keys, *measures, ok.alias("ok"), *(F.greatest(m, f"__f_{m}").alias(f"floor_{m}") for m in measures))


def mentions(lines: DataFrame, text: str, where: Sequence[str], terms: DataFrame, term: str) -> DataFrame:
    """Hits and distinct places of each single-word term among the words of the lines."""
    words = lines.select(*where, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))).alias("__w"))
    t = terms.select(F.lower(term).alias("__w")).distinct()
    return words.join(t, "__w").groupBy(F.col("__w").alias(term)).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct(F.struct(*where)).alias("places"))


def agreement(df: DataFrame, group: Sequence[str], text: str, confidence: str) -> DataFrame:
    """The most confident text; its confidence rises by 0.05 for every further reading that agrees, 1 at most."""
    best = df.groupBy(*group).agg(F.max(F.struct(F.col(confidence).alias("c"), F.col(text).alias("t"))).alias("b"))
    agree = df.join(best, list(group)).groupBy(*group, "b").agg(F.count(F.when(F.col(text) == F.col("b.t"), 1)).alias("agree"))
    return agree.select(*group, F.col("b.t").alias(text), "agree", F.round(F.least(F.lit(1.0), F.col("b.c") + 0.05 * (F.col("agree") - 1)), 3).alias(confidence))
