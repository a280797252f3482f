"""Reading tables and words out of page text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words_from_glyphs(glyphs: DataFrame, line: Sequence[str], x0: str, x1: str, height: str, glyph: str, share: float = 0.22, least: float = 1.2) -> DataFrame:
    """``line..., word_no, word``: glyphs of a line parted where the gap exceeds ``share`` of their median height, ``least`` at least."""
    w = Window.partitionBy(*line).orderBy(x0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.greatest(F.lit(least), F.percentile(height, F.lit(0.5)).over(whole) * share)  # over the sorted line: as a join, lines may be broadcast
    marked = glyphs.withColumn("__new", F.when(F.col(x0) - F.lag(x1).over(w) > limit, 1).otherwise(0))
    numbered = marked.withColumn("word_no", F.sum("__new").over(w) + 1)
    letters = F.array_sort(F.collect_list(F.struct(F.col(x0).alias("x"), F.col(glyph).alias("g"))))
    return numbered.groupBy(*line, "word_no").agg(F.array_join(F.transform(letters, lambda c: c["g"]), "").alias("word"))


def header_columns(header: Column, phrases: Mapping[str, str], needed: str, least: int = 2) -> Column:
    """the column keys of a header line, longest phrase first, repeated neighbours once; null unless ``needed`` is among ``least`` or more."""
    ordered = sorted(phrases, key=lambda p: (-len(p), p))
    found = F.regexp_extract_all(F.upper(header), F.lit(r"\b(" + "|".join(map(re.escape, ordered)) + r")\b"), 1)
    table = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv])
    keys = F.transform(found, lambda p: table[p])
    once = F.filter(keys, lambda k, i: (i == 0) | (F.get(keys, i - 1) != k))
    return F.when((F.size(once) >= least) & F.array_contains(once, needed), once)


def row_pattern(columns: Mapping[str, str], tail: bool = False) -> str:
    """One pattern of a table row: a name, then a typed group per column (int, money, dice, text, dash), then an optional tail."""
    kinds = {"int": r"(-?\d+|[-–—])", "money": r"([\d,]+\s?[¥$€]|[-–—])", "dice": r"(\d+[dD]\d*(?:[+-]\d+)?)", "text": r"(\S+)", "dash": r"([-–—])"}
    return r"^\s*(\S.*?)\s+" + r"\s+".join(kinds[k] for k in columns.values()) + (r"(?:\s+(.*?))?" if tail else "") + r"\s*$"


def parse_rows(lines: DataFrame, line: str, columns: Mapping[str, str], tail: bool = False) -> DataFrame:
    """Rows of ``lines`` that fit the pattern, with ``name`` and one text per column (and ``rest``)."""
    pattern = row_pattern(columns, tail)
    names = ["name", *columns, *(["rest"] if tail else [])]
    return lines.filter(F.col(line).rlike(pattern)).select("*", *(F.trim(F.regexp_extract(line, pattern, i + 1)).alias(n) for i, n in enumerate(names)))


def rows_after(lines: DataFrame, keys: Sequence[str], order: str, header: Column) -> DataFrame:
    """The one line that follows each header."""
    w = Window.partitionBy(*keys).orderBy(order)
    return lines.withColumn("__h", F.lag(header, 1, False).over(w)).filter(F.col("__h") & ~header).drop("__h")


def table_rows(lines: DataFrame, keys: Sequence[str], order: str, line: str, header: Column, numeric: int, cells: int) -> DataFrame:
    """Lines of ``numeric`` or more numeric cells under the last header, as ``header_at, cells`` padded with '' or cut to ``cells``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = F.filter(F.split(F.trim(line), r"\s+"), lambda c: c != "")
    marked = lines.withColumn("header_at", F.last(F.when(header, F.col(order)), True).over(w)).withColumn("cells", parts)
    counted = F.size(F.filter("cells", lambda c: c.rlike(r"^[+-]?[\d.,]+[¥$€%]?$")))
    kept = marked.filter(F.col("header_at").isNotNull() & ~header & (counted >= numeric))
    return kept.withColumn("cells", F.slice(F.concat("cells", F.array_repeat(F.lit(""), cells)), 1, cells))


def trailing_stats(line: Column, least: int) -> Column:
    """A row split before its last run of ``least`` or more stat tokens: (name, stats); null if there is none."""
    token = r"(?:[+-]?\d[\d.,/+-]*[¥$€%]?|[-–—])"
    pattern = rf"^\s*(.*?)\s*((?:{token}\s+){{{least - 1},}}{token})\s*$"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("name"), F.split(F.trim(F.regexp_extract(line, pattern, 2)), r"\s+").alias("stats")))


def display_rows(rows: DataFrame, page: Sequence[str], size: str, order: str, least: float) -> DataFrame:
    """The largest text of each page, ``least`` at least; ties: the first."""
    big = rows.filter(F.col(size) >= least)
    best = big.groupBy(*page).agg(F.max(F.struct(F.col(size).alias("s"), (-F.col(order)).alias("o"))).alias("__b"))
    return big.join(best, list(page)).filter((F.col(size) == F.col("__b.s")) & (-F.col(order) == F.col("__b.o"))).drop("__b")
