"""Data-quality rules (Q*): rules are data, their violations one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule is violated by the rows where ``when`` holds."""

    name: str
    when: Column
    message: Column | str


def row_issues(df: DataFrame, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """Q1, Q2, Q12: ``key, rule, message``: one row per violation; all rules are read off in one scan."""
    found = F.array_compact(F.array(*(F.when(r.when, F.struct(F.lit(r.name).alias("rule"), (F.lit(r.message) if isinstance(r.message, str) else r.message).alias("message"))) for r in rules)))
    return df.select(*key, F.explode(found).alias("i")).select(*key, "i.*")


def schema_rules(df: DataFrame, types: Mapping[str, str], required: Sequence[str] = ()) -> list[Rule]:
    """Q1: text columns that do not read as their declared type, '' counting as not set, and required columns that are not set."""
    rules = []
    for column, kind in types.items():
        value = F.nullif(F.col(column).cast("string"), F.lit(""))
        rules.append(Rule(f"type:{column}", value.isNotNull() & value.try_cast(kind).isNull(), F.concat(F.lit(f"{column} is no {kind}: "), value)))
    for column in required:
        rules.append(Rule(f"required:{column}", F.col(column).isNull() | (F.col(column).cast("string") == ""), f"{column} is not set"))
    return rules


def foreign_key_issues(df: DataFrame, key: Sequence[str], column: str, target: DataFrame, target_column: str, name: str) -> DataFrame:
    """References that do not resolve; null and '' are no references."""
    rows = df.filter(F.col(column).isNotNull() & (F.col(column).cast("string") != ""))
    ids = target.select(F.col(target_column).alias(column)).distinct()
    return rows.join(ids, column, "left_anti").select(*key, F.lit(name).alias("rule"), F.concat(F.lit("unresolved: "), F.col(column).cast("string")).alias("message"))


def still_there(rows: DataFrame, tombstones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that a tombstone says are deleted; must be empty."""
    return rows.join(tombstones.select(*keys).distinct(), list(keys), "left_semi")


def path_issues(df: DataFrame, path: str, parts: Sequence[str]) -> DataFrame:
    """Q3: rows whose last path parts differ from the columns ``parts`` (the last without its extension)."""
    pieces = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    bad = F.lit(False)
    for i, p in enumerate(reversed(parts)):
        bad = bad | ~F.col(p).eqNullSafe(F.try_element_at(pieces, F.lit(-1 - i)))
    return df.filter(bad)


def tolerance(unknown: DataFrame, total: DataFrame, least: int = 10, share: int = 20) -> DataFrame:
    """Q9: ``unknown, total, ok``: ok while the unknown are at most the larger of ``least`` and a ``share``-th of all."""
    a, b = unknown.agg(F.count(F.lit(1)).alias("unknown")), total.agg(F.count(F.lit(1)).alias("total"))
    return a.crossJoin(b).withColumn("ok", F.col("unknown") <= F.greatest(F.lit(least), F.floor(F.col("total") / share)))


def report(issues: DataFrame, rules: Sequence[str], shown: int = 8) -> DataFrame:
    """``rule, ok, n, offenders``: each rule with its number of violations and the ``shown`` smallest messages."""
    names = issues.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    counts = issues.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    # Messages are thinned per rule before they meet, so that a rule violated everywhere is no burden.
    few = issues.select("rule", "message").distinct().withColumn("__s", F.pmod(F.xxhash64("message"), F.lit(64)))
    rank = F.row_number().over(Window.partitionBy("rule", "__s").orderBy("message"))
    few = few.withColumn("__r", rank).filter(F.col("__r") <= shown).groupBy("rule").agg(F.slice(F.array_sort(F.collect_list("message")), 1, shown).alias("offenders"))
    out = names.join(counts, "rule", "left").join(few, "rule", "left")
    return out.select("rule", F.coalesce("n", F.lit(0)).eqNullSafe(0).alias("ok"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("offenders", F.array().cast("array<string>")).alias("offenders"))
