"""Differences between two copies of a dataset (problem 1).

Pass 1 builds a checksum matrix: keys fall into buckets and every (bucket, column) cell adds up a 64-bit hash of each
(key, value) in two 32-bit lanes, the first copy with sign +, the second with sign -. Sums are combined map-side, so
only one row per bucket leaves a task. Cells that are not zero name the unequal buckets and columns. Pass 2 reads both
copies again, keeps only rows of unequal buckets and only values of unequal columns, and joins those.

Defined results
- A null and an empty string are equal, a null and an empty array too, the order within an array does not count, and a
  null boolean equals false.
- Rows repeated with equal values count once. If one side holds different rows under one key, the smallest and
  the largest value of each field are compared.
- Rows with a null key form one key of their own, null.
- An empty table on one side makes every key of the other 'only_first' or 'only_second'; two empty ones give no rows.
- Columns that are not named as key or field are never read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Upper bound of the bucket count. The broadcast list of unequal buckets has two integers a bucket: at most 2 MB.
MAX_BUCKETS = 1 << 18
ROWS_PER_BUCKET = 8


def canonical(df: DataFrame, path: str) -> Column:
    """The compared form of a field as text: 'n' for nothing, else 'v' and the value."""
    kind = df.select(path).schema[0].dataType
    value = F.col(path)
    if isinstance(kind, T.BooleanType):
        return F.when(F.coalesce(value, F.lit(False)), F.lit("vtrue")).otherwise(F.lit("n"))
    if isinstance(kind, T.ArrayType):
        value = F.when(F.size(value) > 0, F.to_json(F.sort_array(value), {"ignoreNullFields": "false"}))
    elif isinstance(kind, (T.StructType, T.MapType)):
        value = F.to_json(value)
    else:
        value = F.nullif(value.cast("string"), F.lit(""))
    return F.coalesce(F.concat(F.lit("v"), value), F.lit("n"))


def bucket_count(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """A power of two that follows the row count up to MAX_BUCKETS."""
    return min(MAX_BUCKETS, 1 << max(6, (max(1, rows // rows_per_bucket) - 1).bit_length()))


def _canonical_rows(df: DataFrame, key: str, fields: Sequence[str], buckets: int) -> DataFrame:
    cols = [F.col(key).alias("row_key"), *(canonical(df, f).alias(f"f{i}") for i, f in enumerate(fields))]
    return df.select(*cols).withColumn("bucket", F.pmod(F.xxhash64("row_key"), F.lit(buckets)).cast("int"))


def checksum_matrix(first: DataFrame, second: DataFrame, key: str, fields: Sequence[str], buckets: int) -> DataFrame:
    """One row per bucket: ``bucket`` and, for each field and for the keys, two lanes that are 0 where the copies agree."""

    def signed(df: DataFrame, sign: int) -> DataFrame:
        rows = _canonical_rows(df, key, fields, buckets)
        hashes = {"k": F.xxhash64(F.lit("key"), "row_key")} | {f"c{i}": F.xxhash64(F.lit(i), "row_key", f"f{i}") for i in range(len(fields))}
        lanes = []
        for name, h in hashes.items():
            lanes += [(F.lit(sign) * h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_lo"), (F.lit(sign) * F.shiftrightunsigned(h, 32)).alias(f"{name}_hi")]
        return rows.select("bucket", *lanes)

    both = signed(first, 1).unionByName(signed(second, -1))
    return both.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in both.columns if c != "bucket"))


def unequal_cells(matrix: DataFrame, n_fields: int) -> DataFrame:
    """``bucket``, ``mask``: bit i stands for field i, bit n for the keys; a bucket whose cells are all zero has no row."""
    mask = F.lit(0)
    for bit, name in enumerate([*(f"c{i}" for i in range(n_fields)), "k"]):
        mask = mask + F.when((F.col(f"{name}_lo") != 0) | (F.col(f"{name}_hi") != 0), F.lit(1 << bit)).otherwise(F.lit(0))
    return matrix.select("bucket", mask.alias("mask")).filter("mask <> 0")


def diff_copies(first: DataFrame, second: DataFrame, key: str, fields: Sequence[str] | Mapping[str, str], rows: int | None = None) -> DataFrame:
    """``row_key``, ``diff``, ``first_value``, ``second_value``: one row per missing key or differing field.

    ``fields``: paths, or a mapping from path to the name to report. ``rows``: about how many rows the copies have;
    it sets the number of buckets and is counted if not given.
    """
    names = dict(fields) if isinstance(fields, Mapping) else {f: f for f in fields}
    paths, n = list(names), len(names)
    buckets = bucket_count(first.count() if rows is None else rows)
    cells = F.broadcast(unequal_cells(checksum_matrix(first, second, key, paths, buckets), n))

    def side(df: DataFrame, tag: str) -> DataFrame:
        kept = _canonical_rows(df, key, paths, buckets).join(cells, "bucket")
        values = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"f{i}")).alias(f"f{i}") for i in range(n)]
        kept = kept.select("row_key", *values)
        aggs = [a for i in range(n) for a in (F.min(f"f{i}").alias(f"{tag}min{i}"), F.max(f"f{i}").alias(f"{tag}max{i}"))]
        return kept.groupBy("row_key").agg(F.lit(True).alias(f"{tag}there"), *aggs).withColumnRenamed("row_key", f"{tag}key")

    a, b = side(first, "a_"), side(second, "b_")
    joined = a.join(b, F.col("a_key").eqNullSafe(F.col("b_key")), "full_outer")

    def shown(c: str) -> Column:
        return F.when(F.col(c).startswith("v"), F.substring(F.col(c), 2, 1 << 30))

    differs = [
        F.when(
            ~(F.col(f"a_min{i}").eqNullSafe(F.col(f"b_min{i}")) & F.col(f"a_max{i}").eqNullSafe(F.col(f"b_max{i}"))),
            F.struct(F.lit(names[p]).alias("diff"), shown(f"a_max{i}").alias("first_value"), shown(f"b_max{i}").alias("second_value")),
        )
        for i, p in enumerate(paths)
    ]
    missing = "struct('{}' as diff, cast(null as string) as first_value, cast(null as string) as second_value)"
    diffs = (
        F.when(F.col("b_there").isNull(), F.array(F.expr(missing.format("only_first"))))
        .when(F.col("a_there").isNull(), F.array(F.expr(missing.format("only_second"))))
        .otherwise(F.array_compact(F.array(*differs)))
    )
    return joined.select(F.coalesce("a_key", "b_key").alias("row_key"), F.explode(diffs).alias("d")).select("row_key", "d.*")
