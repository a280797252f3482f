"""Predicates and blankness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_empty(df: DataFrame, column: str) -> Column:
    """F54, reconciliation: null, '', [] or {}."""
    kind = df.select(column).schema[0].dataType
    c = F.col(column)
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def is_falsy(df: DataFrame, column: str) -> Column:
    """F54, merge: as is_empty, and 0 and false."""
    kind = df.select(column).schema[0].dataType
    c = F.col(column)
    if isinstance(kind, T.BooleanType):
        return c.isNull() | ~c
    if isinstance(kind, T.NumericType):
        return c.isNull() | (c == 0)
    return is_empty(df, column)


def is_unfilled(df: DataFrame, column: str) -> Column:
    """F54, authority: as is_empty, and blank text; 0 and false are values."""
    kind = df.select(column).schema[0].dataType
    return F.col(column).isNull() | (F.trim(F.col(column)) == "") if isinstance(kind, T.StringType) else is_empty(df, column)


def visible(hidden: Column) -> Column:
    """P1."""
    return ~F.coalesce(hidden, F.lit(False))


def missing_required(df: DataFrame, fields: Sequence[str]) -> Column:
    """Names of the required fields that are null or ''."""
    return F.array_compact(F.array(*(F.when(is_empty(df, f), F.lit(f)) for f in fields)))


def token_prefixes(text: Column, terms: Sequence[str]) -> Column:
    """P5: every term is a prefix of some token."""
    tokens = F.split(F.lower(text), "[^a-z0-9]+")
    out = F.lit(True)
    for term in terms:
        out = out & F.exists(tokens, _starts(term.lower()))
    return out


def _starts(term: str):
    return lambda t: t.startswith(term)


def mangled_name(name: Column, particles: Sequence[str] = ("of", "the", "and", "de", "von", "for")) -> Column:
    """A word starts with a small letter and is no particle, or has a capital after a small letter."""
    return F.exists(F.split(name, r"\s+"), lambda t: (t.rlike("^[a-z]") & ~t.isin(list(particles))) | t.rlike("[a-z][A-Z]"))


def valid_name(name: Column) -> Column:
    """Three characters or more, at most eight words, starts with a capital or digit, no '.' or ':', balanced parentheses,
    three letters or more, not mangled."""
    opened = F.length(F.regexp_replace(name, r"[^(]", ""))
    closed = F.length(F.regexp_replace(name, r"[^)]", ""))
    return (
        (F.length(name) >= 3) & (F.size(F.split(F.trim(name), r"\s+")) <= 8) & name.rlike("^[A-Z0-9]") & ~name.rlike("[.:]")
        & (opened == closed) & (F.length(F.regexp_replace(name, "[^A-Za-z]", "")) >= 3) & ~mangled_name(name)
    )


def plausible_row_name(name: Column) -> Column:
    """At most eight words, no sentence marks, no price or dash left over."""
    return (F.size(F.split(F.trim(name), r"\s+")) <= 8) & ~name.rlike(r"[.!?;¥$]|[-–—]\s*$")


def stat_line(line: Column) -> Column:
    """Blank, with a price sign, a heading in capitals, a number, a row of numbers, or a dice code."""
    return (F.trim(line) == "") | line.rlike(r"[¥$€]") | line.rlike(r"^[^a-z]*[A-Z][^a-z]*$") | line.rlike(r"^\s*\d+\s*$") | line.rlike(r"^[\s\d/+\-–—.,()]+$") | line.rlike(r"\b\d+[dD]\d*\b")


def stat_ratio(line: Column) -> Column:
    """Share of tokens that hold a digit; 1 if there are three tokens or fewer."""
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")
    share = F.size(F.filter(tokens, lambda t: t.rlike(r"\d"))) / F.size(tokens)
    return F.when(F.size(tokens) <= 3, F.lit(1.0)).otherwise(share)


def stat_like(line: Column) -> Column:
    return stat_ratio(line) > 0.4


def table_row(text: Column) -> Column:
    """At most fourteen tokens, four stat tokens or more, which are half of all at least."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    stats = F.size(F.filter(tokens, lambda t: t.rlike(r"^[\d+\-–—/(\[].*|^\d")))
    return (F.size(tokens) <= 14) & (stats >= 4) & (stats * 2 >= F.size(tokens))


def out_of_range(bounds: Mapping[str, tuple[float, float]]) -> Column:
    """Names of the columns outside their inclusive bounds; nulls are inside."""
    return F.array_compact(F.array(*(F.when(~F.col(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in bounds.items())))


def compatible(kind: Column, subtype: Column, table: Mapping[str, Sequence[str]], generic: Sequence[str] = ()) -> Column:
    """The subtype is listed for its kind, or the kind takes all."""
    lists = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(kind.isin(list(generic) or [""]) | F.array_contains(F.try_element_at(lists, kind), subtype), F.lit(False))


def placeholder_art(img: Column) -> Column:
    """P22."""
    return F.coalesce(img.startswith("generic/") | img.startswith("iconsets/") | img.contains("/lib/"), F.lit(False))


def prose_leak(text: Column, words: int = 12, length: int = 80) -> Column:
    """A run of twelve words or more, longer than eighty characters."""
    return F.coalesce((F.length(text) > length) & text.rlike(rf"(?:[A-Za-z'’,;]+\s+){{{words - 1}}}[A-Za-z'’]+"), F.lit(False))


def malformed(text: Column, share: float = 0.4) -> Column:
    """A text that a table bled into: more than ``share`` of its tokens hold digits, or a run of three words in capitals follows its first word."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    digits = F.size(F.filter(tokens, lambda t: t.rlike(r"\d"))) / F.size(tokens)
    return F.coalesce((digits > share) | text.rlike(r"\S\s+[A-Z]{2,}\s+[A-Z]{2,}\s+[A-Z]{2,}\b"), F.lit(False))
