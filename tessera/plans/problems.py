"""Queries of the general data problems: differences between copies (1) and nested records (6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.copies import diff_copies
from tessera.operators.nested import flat_tables, node_attribute_rows
from tessera.session import table

ITEM_FIELDS = ["system.price", "system.avail", "meta.qa_status", "meta.conflicts"]
CORRECTION_FIELDS = ["system.price", "system.avail", "deleted"]


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1 with the values: ``dataset, row_key, diff, first_value, second_value``."""
    parts = []
    for name, key, fields in (("item", "row_id", ITEM_FIELDS), ("correction", "correction_id", CORRECTION_FIELDS)):
        d = diff_copies(table(spark, sf_dir, name), table(spark, sf_dir, f"{name}_copy"), key, fields)
        parts.append(d.select(F.lit(name).alias("dataset"), "row_key", "diff", "first_value", "second_value"))
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: keys one copy lacks and fields that differ."""
    return p1_values(spark, sf_dir).select("dataset", "row_key", "diff")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: node and attribute rows with links from child to parent."""
    return node_attribute_rows(table(spark, sf_dir, "deep_tree"), "tree_id", "tree")


def p6_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: the node table."""
    return flat_tables(table(spark, sf_dir, "deep_tree"), "tree_id", "tree").select("tree_id", "node_no", "parent_no", "tag", "text")


def p6_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: the attribute table, which keeps the values."""
    flat = flat_tables(table(spark, sf_dir, "deep_tree"), "tree_id", "tree")
    return flat.select("tree_id", "node_no", F.explode("attrs").alias("attr", "value"))


def p6_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: the fields of nodes that are neither tag, text, attrs nor children."""
    flat = flat_tables(table(spark, sf_dir, "deep_tree"), "tree_id", "tree")
    return flat.select("tree_id", "node_no", F.explode("others").alias("field", "value"))


P1_SQL = """
WITH a AS (SELECT DISTINCT 'item' AS dataset, row_id AS row_key, CAST(system.price AS VARCHAR) AS f1, CAST(system.avail AS VARCHAR) AS f2,
    nullif(meta.qa_status, '') AS f3, CASE WHEN len(meta.conflicts) > 0 THEN CAST(list_sort(meta.conflicts) AS VARCHAR) END AS f4 FROM item
  UNION SELECT 'correction', correction_id, nullif(system.price, ''), nullif(system.avail, ''), CASE WHEN deleted THEN 'true' END, NULL FROM correction),
b AS (SELECT DISTINCT 'item' AS dataset, row_id AS row_key, CAST(system.price AS VARCHAR) AS f1, CAST(system.avail AS VARCHAR) AS f2,
    nullif(meta.qa_status, '') AS f3, CASE WHEN len(meta.conflicts) > 0 THEN CAST(list_sort(meta.conflicts) AS VARCHAR) END AS f4 FROM item_copy
  UNION SELECT 'correction', correction_id, nullif(system.price, ''), nullif(system.avail, ''), CASE WHEN deleted THEN 'true' END, NULL FROM correction_copy),
j AS (SELECT a.dataset AS ad, b.dataset AS bd, coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.row_key, b.row_key) AS row_key,
    a.f1 AS a1, a.f2 AS a2, a.f3 AS a3, a.f4 AS a4, b.f1 AS b1, b.f2 AS b2, b.f3 AS b3, b.f4 AS b4
  FROM a FULL JOIN b ON a.dataset = b.dataset AND a.row_key = b.row_key)
"""
P1_SIDES = P1_SQL.replace("CAST(list_sort(meta.conflicts) AS VARCHAR)", "CAST(to_json(list_sort(meta.conflicts)) AS VARCHAR)")
P1_VALUES_SQL = P1_SIDES + """
SELECT dataset, row_key, 'only_first' AS diff, NULL AS first_value, NULL AS second_value FROM j WHERE bd IS NULL
UNION ALL SELECT dataset, row_key, 'only_second', NULL, NULL FROM j WHERE ad IS NULL
UNION ALL SELECT dataset, row_key, 'system.price', a1, b1 FROM j WHERE ad = bd AND a1 IS DISTINCT FROM b1
UNION ALL SELECT dataset, row_key, 'system.avail', a2, b2 FROM j WHERE ad = bd AND a2 IS DISTINCT FROM b2
UNION ALL SELECT dataset, row_key, CASE dataset WHEN 'item' THEN 'meta.qa_status' ELSE 'deleted' END, a3, b3 FROM j WHERE ad = bd AND a3 IS DISTINCT FROM b3
UNION ALL SELECT dataset, row_key, 'meta.conflicts', a4, b4 FROM j WHERE ad = bd AND a4 IS DISTINCT FROM b4
"""
P1_SQL += """SELECT dataset, row_key, 'only_first' AS diff FROM j WHERE bd IS NULL
UNION ALL SELECT dataset, row_key, 'only_second' FROM j WHERE ad IS NULL
UNION ALL SELECT dataset, row_key, 'system.price' FROM j WHERE ad = bd AND a1 IS DISTINCT FROM b1
UNION ALL SELECT dataset, row_key, 'system.avail' FROM j WHERE ad = bd AND a2 IS DISTINCT FROM b2
UNION ALL SELECT dataset, row_key, CASE dataset WHEN 'item' THEN 'meta.qa_status' ELSE 'deleted' END FROM j WHERE ad = bd AND a3 IS DISTINCT FROM b3
UNION ALL SELECT dataset, row_key, 'meta.conflicts' FROM j WHERE ad = bd AND a4 IS DISTINCT FROM b4
"""

_TREES = """
WITH RECURSIVE t AS (SELECT tree_id, min(tree) AS tree FROM deep_tree WHERE tree IS NOT NULL GROUP BY tree_id),
n AS (
  SELECT tree_id, CAST(tree AS JSON) AS node, CAST([] AS INTEGER[]) AS path FROM t WHERE json_valid(tree) AND json_type(tree) = 'OBJECT'
  UNION ALL
  SELECT tree_id, c.node, list_append(path, c.k) FROM (
    SELECT tree_id, path, unnest(CASE json_type(node, '$.children')
        WHEN 'ARRAY' THEN list_zip(CAST(node->'$.children' AS JSON[]), range(CAST(json_array_length(node, '$.children') AS BIGINT)))
        WHEN 'OBJECT' THEN list_zip([node->'$.children'], CAST([0] AS BIGINT[])) END) AS e FROM n) s,
    LATERAL (SELECT e[1] AS node, CAST(e[2] AS INTEGER) AS k) c
  WHERE json_type(c.node) = 'OBJECT'),
d AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS node_no FROM n),
l AS (SELECT d.tree_id, d.node_no, coalesce(p.node_no, -1) AS parent_no, d.node->>'$.tag' AS tag, d.node
  FROM d LEFT JOIN d p ON p.tree_id = d.tree_id AND len(d.path) > 0 AND p.path = d.path[:len(d.path) - 1])
"""
P6_SQL = _TREES + """
SELECT tree_id, node_no, parent_no, tag, '' AS attr FROM l
UNION ALL SELECT tree_id, node_no, parent_no, tag, unnest(list_distinct(json_keys(node, '$.attrs'))) FROM l WHERE json_type(node, '$.attrs') = 'OBJECT'
"""
P6_ATTRIBUTES_SQL = _TREES + """
SELECT tree_id, node_no, attr, json_extract_string(node, '$.attrs."' || attr || '"') AS value
FROM (SELECT tree_id, node_no, node, unnest(list_distinct(json_keys(node, '$.attrs'))) AS attr FROM l WHERE json_type(node, '$.attrs') = 'OBJECT')
"""
P6_OTHERS_SQL = _TREES + """
SELECT tree_id, node_no, field, json_extract_string(node, '$."' || field || '"') AS value
FROM (SELECT tree_id, node_no, node, unnest(list_distinct(json_keys(node))) AS field FROM l) WHERE field NOT IN ('tag', 'text', 'attrs', 'children')
UNION ALL SELECT tree_id, node_no, 'attrs', json_extract_string(node, '$.attrs') FROM l WHERE list_contains(json_keys(node), 'attrs') AND json_type(node, '$.attrs') <> 'OBJECT'
UNION ALL SELECT tree_id, node_no, 'children', NULL FROM l WHERE list_contains(json_keys(node), 'children') AND json_type(node, '$.children') = 'NULL'
"""
P6_NODES_SQL = _TREES + "SELECT tree_id, node_no, parent_no, tag, node->>'$.text' AS text FROM l"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_values": p1_values,
    "p6_found": p6_found,
    "p6_nodes": p6_nodes,
    "p6_attributes": p6_attributes,
    "p6_others": p6_others,
}
SQL = {"p1_found": P1_SQL, "p1_values": P1_VALUES_SQL, "p6_found": P6_SQL, "p6_nodes": P6_NODES_SQL, "p6_attributes": P6_ATTRIBUTES_SQL, "p6_others": P6_OTHERS_SQL}
