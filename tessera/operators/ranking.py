"""Ordering, survivors, identifiers and first-match rules (O*, K2, N7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import fold_sorted
from tessera.operators.joins import as_of
from tessera.operators.ordered import numbered


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by a total order (the order must not tie). Combined map-side, so a hot key is no burden."""
    ranked = F.min(F.struct(*(F.expr(o) if isinstance(o, str) else o for o in order), F.struct(*df.columns).alias("__row")))
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(ranked.alias("__b")).select("__b.__row.*")


def running_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str = "n") -> DataFrame:
    """Row numbers per key in order, for keys that may have a third of all rows: ``bucket`` is a column over the first order column that does not
    decrease with it. Rows are numbered within (keys, bucket); what earlier buckets hold is added from one row per bucket."""
    rows = df.withColumn("__b", bucket)
    local = rows.withColumn("__l", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    counts = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb")).agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__kb").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__o", F.coalesce(before, F.lit(0)))
    on = [local[k].eqNullSafe(offsets[f"__k{i}"]) for i, k in enumerate(keys)] + [local["__b"].eqNullSafe(offsets["__kb"])]
    return local.join(offsets, on).select(*df.columns, (F.col("__l") + F.col("__o")).alias(name))


def suffixed_ids(df: DataFrame, base: str, order: Sequence[Column | str], scope: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """``base`` for its first row, ``base_2``, ``base_3`` for the next ones, in order. ``bucket``: as in running_number, for hot bases."""
    if bucket is None:
        numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(*scope, base).orderBy(*order)))
    else:
        numbered = running_number(df, [*scope, base], order, bucket, "__n")
    n = F.col("__n")
    return numbered.withColumn("new_id", F.when(n > 1, F.concat_ws("_", base, n.cast("string"))).otherwise(F.col(base))).drop("__n")


def free_ids(df: DataFrame, base: str, order: Sequence[str], taken: DataFrame, taken_id: str) -> DataFrame:
    """As suffixed_ids, but no id of ``taken``: per base the n-th row gets the n-th free one of base, base_2, base_3, ...

    The n-th free number is n plus the count of used ones below it: the j-th used number u is below it if u - j < n. So rows meet the used numbers by an as-of join
    over n, and neither the rows nor the numbers of a base are ever put together."""
    ids = taken.select(F.col(taken_id).alias("__id")).distinct()
    used = ids.select(F.col("__id").alias(base), F.lit(1).cast("bigint").alias("__u")).unionByName(
        ids.select(F.regexp_extract("__id", r"^(.*)_(\d+)$", 1).alias(base), F.regexp_extract("__id", r"^(.*)_(\d+)$", 2).try_cast("bigint").alias("__u")).filter(f"`{base}` <> '' and __u >= 2")
    ).distinct()
    counted = numbered(used.join(df.select(base).distinct(), base, "left_semi"), [base], ["__u"], "__j")
    below = counted.groupBy(base, (F.col("__u") - F.col("__j") + 1).alias("__n")).agg(F.max("__j").alias("__j"))
    out = as_of(numbered(df, [base], order, "__n"), below, [base], "__n", ["__j"], F.floor(F.col("__n") / 100_000))
    free = F.col("__n") + F.coalesce("__j", F.lit(0))
    return out.withColumn("new_id", F.when(free > 1, F.concat_ws("_", base, free.cast("string"))).otherwise(F.col(base))).drop("__n", "__j")


def better_text_fold(df: DataFrame, group: str, order: str, text: str, date: str, ratio: float = 0.85) -> DataFrame:
    """Per group, in order: a text replaces the current one if it is longer; if the shorter has ``ratio`` of the longer's length
    at least, the one of the later or equal date wins instead. The rule is not transitive, so it is a fold; only lengths and dates enter it."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    narrow = df.filter(F.col(text).isNotNull()).select(group, order, F.length(text).alias("__l"), F.coalesce(F.col(date).cast("string"), F.lit("")).alias("__d"))

    def start():
        best: list = [None]

        def step(row):
            current = best[0]
            if current is None:
                best[0] = row
                return []
            near = min(current[2], row[2]) >= ratio * max(current[2], row[2])
            if row[3] >= current[3] if near else row[2] > current[2]:
                best[0] = row
            return []

        return step, lambda: [best[0][:3]]

    return fold_sorted(narrow, [group], [order], start, f"{group} {kinds[group]}, {order} {kinds[order]}, length int")


def natural_key(text: Column, digits: int = 12) -> Column:
    """O1: text with every number padded, so that it sorts by value."""
    padded = F.regexp_replace(text, r"(\d+)", "0" * digits + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{digits}}})(?!\d)", "$1")


def first_match(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = None
    for condition, label in rules:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def rename_plan(df: DataFrame, current: str, wanted: str) -> DataFrame:
    """Rows whose name differs from the wanted one, with ``exists`` (a row has that name now) and ``contested`` (several want it)."""
    names = df.select(F.col(current).alias("__c")).distinct().withColumn("exists", F.lit(True))
    wants = df.filter(F.col(current) != F.col(wanted)).groupBy(F.col(wanted).alias("__w")).agg((F.count(F.lit(1)) > 1).alias("contested"))
    out = df.filter(F.col(current) != F.col(wanted)).join(names, F.col(wanted) == F.col("__c"), "left").join(wants, F.col(wanted) == F.col("__w"))
    return out.withColumn("exists", F.coalesce("exists", F.lit(False))).drop("__c", "__w")


def penalised(df: DataFrame, item: str, name: str, score: str) -> DataFrame:
    """22 off for each further name an item has, 20 off for every row but the item's best; ``score`` changed."""
    names = df.groupBy(item).agg(F.count_distinct(name).alias("__names"), F.max(F.struct(F.col(score).alias("s"), F.col(name).alias("n"))).alias("__best"))
    out = df.join(names, item)
    best = (F.col(score) == F.col("__best.s")) & F.col(name).eqNullSafe(F.col("__best.n"))
    return out.withColumn(score, F.col(score) - 22 * (F.col("__names") - 1) - F.when(best, 0).otherwise(20)).drop("__names", "__best")


def resolve_pictures(df: DataFrame, picture: str, item: str, name: str, kind: str, score: str, order: str) -> DataFrame:
    """Rows (a picture may show an item) with ``rivals`` and ``score`` changed: where a picture has captions its headings are dropped; 22 off for each further name
    that a picture may show, 20 off for every row of an item but its best (ties: smallest ``order``)."""
    per_picture = df.groupBy(picture).agg(
        F.max(F.col(kind) == "caption").alias("__captions"), F.count_distinct(F.when(F.col(kind) == "caption", F.col(name))).alias("__named"), F.count_distinct(name).alias("__all")
    )
    kept = df.join(per_picture, picture).filter(~F.col("__captions") | (F.col(kind) == "caption"))
    rivals = F.when(F.col("__captions"), F.col("__named")).otherwise(F.col("__all"))
    scored = kept.withColumn("rivals", rivals).withColumn(score, F.col(score) - 22 * (rivals - 1)).drop("__captions", "__named", "__all")
    best = scored.groupBy(item).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"))).alias("__best"))
    return scored.join(best, item).withColumn(score, F.col(score) - F.when(F.col(order) == F.col("__best.o"), 0).otherwise(20)).drop("__best")
