from pyspark.sql import Row

from tessera.operators.copies import bucket_count, checksum_matrix, diff_copies, unequal_cells

SCHEMA = "k bigint, s struct<p: bigint, q: string>, tags array<string>, flag boolean, diff string, bucket int"


def rows(df):
    return sorted((r.row_key if r.row_key is not None else -1, r["diff"]) for r in df.collect())


def diff(spark, a, b):
    return rows(diff_copies(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "k", ["s.p", "s.q", "tags", "flag"]))


def test_nulls_empties_and_order_are_equal(spark):
    a = [(1, (None, ""), [], None, "x", 9), (2, (5, "v"), ["b", "a"], True, "y", 9), (3, None, None, False, None, None)]
    b = [(1, (None, None), None, False, "z", 1), (2, (5, "v"), ["a", "b"], True, None, 2), (3, (None, ""), [], None, None, None)]
    assert diff(spark, a, b) == []


def test_each_kind_of_difference(spark):
    a = [(1, (1, "a"), ["x"], True, "", 0), (2, (1, "a"), [], None, "", 0), (None, (1, "a"), [], None, "", 0)]
    b = [(1, (2, "A"), ["x", "x"], None, "", 0), (3, (1, "a"), [], None, "", 0), (None, (1, "b"), [], None, "", 0)]
    assert diff(spark, a, b) == [(-1, "s.q"), (1, "flag"), (1, "s.p"), (1, "s.q"), (1, "tags"), (2, "only_first"), (3, "only_second")]


def test_redelivered_rows_count_once_even_if_hot(spark):
    row = (7, (1, "a"), ["t"], True, "", 0)
    assert diff(spark, [row] * 500 + [(8, (1, "a"), [], None, "", 0)], [row, (8, (1, "b"), [], None, "", 0)]) == [(8, "s.q")]


def test_empty_sides(spark):
    row = (7, (1, "a"), ["t"], True, "", 0)
    assert diff(spark, [row], []) == [(7, "only_first")]
    assert diff(spark, [], [row]) == [(7, "only_second")]
    assert diff(spark, [], []) == []


def test_matrix_is_zero_but_for_the_unequal_cell(spark):
    a = spark.range(1000).selectExpr("id as k", "id * 2 as v", "'same' as w")
    b = a.selectExpr("k", "if(k = 77, 0, v) as v", "w")
    cells = unequal_cells(checksum_matrix(a, b, "k", ["v", "w"], bucket_count(1000)), 2).collect()
    assert [r["mask"] for r in cells] == [1]
    assert bucket_count(0) == 64 and bucket_count(10**12) == 1 << 18


def test_values_are_reported(spark):
    a = spark.createDataFrame([Row(k=1, v="old", first_value="n")])
    b = spark.createDataFrame([Row(k=1, v="new", first_value="m")])
    assert [tuple(r) for r in diff_copies(a, b, "k", {"v": "value"}).collect()] == [(1, "value", "old", "new")]
