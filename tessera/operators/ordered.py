"""Scans along an order, for keys of any size.

Where a key has more than ``LARGE`` rows, rows are cut into ranges of (keys, order), so that it lies in many. A scan runs within each (keys, range) and hands one row over to
the ranges after it; these rows are few, at most one for each key and range it lies in. Ranges are written down, so a lost executor cannot cut them anew. Where no key is
large a scan is a window over the key. Either way the rows are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored

RANGE = "__range"
#: Rows of a key that one task may sort.
LARGE = 2_000_000
MOST_RANGES = 20_000


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with the number of its range, if any key is large; rows of equal keys and order share one."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    if (sizes["largest"] or 0) <= LARGE:
        return df
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sizes["rows"] // max(1, LARGE))
    return stored(df.repartitionByRange(min(ranges, MOST_RANGES), *keys, *order).withColumn(RANGE, F.spark_partition_id()))


def _part(rows: DataFrame, keys: Sequence[str]) -> list[str]:
    return [*keys, RANGE] if RANGE in rows.columns else list(keys)


def _with_carried(rows: DataFrame, keys: Sequence[str], per: dict[str, Column], carried: dict[str, tuple[str, str]], forward: bool) -> DataFrame:
    """``rows`` with columns made of what the ranges before (or behind) theirs hand over: ``per`` range an aggregate, of these 'last', 'sum' or 'min'."""
    if RANGE not in rows.columns:
        return rows.select("*", *(F.lit(None).alias(n) for n in carried))
    names = [f"__k{i}" for i in range(len(keys))]
    handed = rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(RANGE).alias("__kr")).agg(*(c.alias(n) for n, c in per.items()))
    w = Window.partitionBy(*names).orderBy(F.col("__kr").asc() if forward else F.col("__kr").desc()).rowsBetween(Window.unboundedPreceding, -1)
    how = {"last": lambda c: F.last(c, True).over(w), "sum": lambda c: F.sum(c).over(w), "min": lambda c: F.min(c).over(w)}
    found = handed.select(*names, "__kr", *(how[kind](c).alias(n) for n, (c, kind) in carried.items()))
    on = [rows[k].eqNullSafe(found[n]) for k, n in zip(keys, names)] + [rows[RANGE] == found["__kr"]]
    return rows.join(found, on).drop(*names, "__kr")


def last_known(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], forward: bool = True, current: bool = True) -> DataFrame:
    """``rows`` (in ranges) with, for each of ``columns`` (new name to column), the last value that is not null along the order, of rows up to this one or before it;
    backwards: the next one."""
    by = [F.col(c).asc() if forward else F.col(c).desc() for c in order]
    w = Window.partitionBy(*_part(rows, keys)).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    at = F.struct(*order)
    pick = F.max_by if forward else F.min_by
    per = {f"__h{i}": pick(c, F.when(F.col(c).isNotNull(), at)) for i, c in enumerate(columns.values())}
    out = _with_carried(rows, keys, per, {f"__c{i}": (f"__h{i}", "last") for i in range(len(columns))}, forward)
    kinds = [rows.select(c).schema[0].dataType for c in columns.values()]
    return out.select(*rows.columns, *(F.coalesce(F.last(c, True).over(w), F.col(f"__c{i}").cast(kinds[i])).alias(n) for i, (n, c) in enumerate(columns.items())))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, kind: str = "sum", forward: bool = True, current: bool = True) -> DataFrame:
    """``rows`` (in ranges) with the sum or minimum ('min') of ``value`` along the order, up to this row or before it (null if there is none); backwards: from it on."""
    by = [F.col(c).asc() if forward else F.col(c).desc() for c in order]
    w = Window.partitionBy(*_part(rows, keys)).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    add = F.sum if kind == "sum" else F.min
    out = _with_carried(rows, keys, {"__h": add(value)}, {"__c": ("__h", kind)}, forward)
    local = add(value).over(w)
    if RANGE not in rows.columns:
        both = local
    else:
        both = F.coalesce(local + F.col("__c"), local, F.col("__c")) if kind == "sum" else F.least(local, F.col("__c"))
    return out.select(*rows.columns, both.alias(name))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the number of each row of its key in order, from 1; the order must not tie."""
    return running(in_ranges(df, keys, order), keys, order, F.lit(1), name).drop(RANGE)


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` written down between two scans over ranges, each of which reads them twice."""
    return stored(rows) if RANGE in rows.columns else rows
