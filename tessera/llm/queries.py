"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.encoding import restore_encoding
from tessera.llm.entities import match_entities
from tessera.llm.formatting import same_but_for_format
from tessera.llm.leaks import leaks, shared_runs
from tessera.llm.representative import merged_records, survivors
from tessera.llm.scans import repair_scans
from tessera.llm.spam import spam_pages
from tessera.llm.tokens import encode_corpus
from tessera.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: rows whose payload equals that of another but for its format."""
    _, members = same_but_for_format(table(spark, sf_dir, "raw_item"), "raw_id", "payload")
    return members.select(F.col("first").alias("first_raw_id"), F.col("key").alias("raw_id"))


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: one record of each group of equal ones, with its number of copies."""
    groups, _ = same_but_for_format(table(spark, sf_dir, "raw_item"), "raw_id", "payload", alone=True)
    return groups.select(F.col("first").alias("raw_id"), "copies")


P2_SQL = r"""
WITH f AS (SELECT raw_id, unnest(json_keys(payload)) AS k, payload FROM raw_item WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
v AS (SELECT raw_id, k, json_type(json_extract(payload, '$."' || k || '"')) AS t, json_extract_string(payload, '$."' || k || '"') AS v FROM f),
c AS (SELECT raw_id, list_sort(list(k || '=' || CASE WHEN t = 'VARCHAR' THEN 's' || lower(regexp_replace(v, '[^\p{L}\p{N}]+', '', 'g'))
    WHEN t IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'n' || CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE 'x' || coalesce(v, 'null') END)) AS rec FROM v GROUP BY raw_id),
g AS (SELECT raw_id, min(raw_id) OVER (PARTITION BY rec) AS first_raw_id, count(*) OVER (PARTITION BY rec) AS copies FROM c)
"""


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: fields with traces of a scan, the kinds of traces, and the running text."""
    item = table(spark, sf_dir, "item").select("row_id", "name", F.col("system.description").alias("description"))
    return repair_scans(item, "row_id", {"name": "name", "description": "description"}).withColumnRenamed("key", "row_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: fields with traces of a scan."""
    return p4_repaired(spark, sf_dir).select("row_id", "field")


#: The order of trust in problem 5, and what placeholder art looks like.
TRUST = ["extracted", "review", "reviewed", "approved"]
PLACEHOLDER = r"^generic/|^iconsets/|/lib/"


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: the rows that give an entry's description and img, and all its sources."""
    item = table(spark, sf_dir, "item")
    stripped = F.trim(F.regexp_replace("system.description", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    rows = item.select(
        "domain", "id", "row_id", F.length(stripped).cast("bigint").alias("filled"), F.col("meta.extracted_at").alias("at"),
        F.coalesce(F.array_position(F.array(*map(F.lit, TRUST)), F.col("meta.qa_status")), F.lit(0)).alias("trust"),
        (F.coalesce(F.col("img"), F.lit("")) != "").alias("has_img"), F.col("img").rlike(PLACEHOLDER).alias("placeholder"), "meta.sources",
    )
    paged = F.filter("sources", lambda s: s["page"].isNotNull())
    return survivors(
        rows, ["domain", "id"], "row_id",
        {"description": (F.col("filled") > 0, F.col("filled"), F.col("at")), "img": (F.col("has_img") & ~F.col("placeholder"), F.col("trust"), F.col("at"))},
        {"sources": F.transform(paged, lambda s: F.concat(F.coalesce(s["book"], F.lit("")), F.lit(":"), s["page"].cast("string")))},
    )


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: one surviving record per entry listed several times, each field from the first dominance layer that fills it."""
    item = table(spark, sf_dir, "item")
    text = lambda c: F.when(F.trim(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")) != "", F.col(c))
    fields = {c: text(c) for c in ("book", "category", "name")}
    fields |= {c: text(f"system.{c}") for c in ("type", "subtype", "description")}
    fields |= {"price": F.col("system.price"), "avail": F.col("system.avail"), "page": F.col("meta.page"), "img": F.when(~F.col("img").rlike(PLACEHOLDER), text("img"))}
    trust = F.coalesce(F.array_position(F.array(*map(F.lit, TRUST)), F.col("meta.qa_status")), F.lit(0))
    return merged_records(item, ["domain", "id"], "row_id", fields, trust, F.col("meta.extracted_at"))


P5_FIELDS = ["book", "category", "name", "type", "subtype", "description", "price", "avail", "page", "img"]
P5_SURVIVORS_SQL = r"""
WITH RECURSIVE i AS (SELECT domain, id, row_id, %s, coalesce(list_position(['extracted', 'review', 'reviewed', 'approved'], meta.qa_status), 0) AS t,
    meta.extracted_at AS ts, coalesce(CAST(meta.extracted_at AS DATE), DATE '0001-01-01') AS d, count(*) OVER (PARTITION BY domain, id) AS copies FROM item),
r AS (SELECT *, %s AS c FROM i WHERE copies > 1),
p AS (SELECT DISTINCT domain, id, c, d, t FROM r),
chain AS (SELECT *, 1 AS layer FROM p UNION SELECT b.domain, b.id, b.c, b.d, b.t, chain.layer + 1 FROM chain JOIN p b
    ON b.domain IS NOT DISTINCT FROM chain.domain AND b.id IS NOT DISTINCT FROM chain.id AND b.c <= chain.c AND b.d <= chain.d AND b.t <= chain.t
    AND (b.c < chain.c OR b.d < chain.d OR b.t < chain.t)),
l AS (SELECT domain, id, c, d, t, max(layer) AS layer FROM chain GROUP BY domain, id, c, d, t),
o AS (SELECT r.*, l.layer FROM r JOIN l ON r.domain IS NOT DISTINCT FROM l.domain AND r.id IS NOT DISTINCT FROM l.id AND r.c = l.c AND r.d = l.d AND r.t = l.t)
SELECT domain, id, max(copies) AS copies, max(layer) AS layers, %s FROM o GROUP BY domain, id
""" % (
    ", ".join(
        f"CASE WHEN regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') <> ''{extra} THEN {c} END AS v_{c.split('.')[-1]}"
        for c, extra in [("book", ""), ("category", ""), ("name", ""), ("system.type", ""), ("system.subtype", ""), ("system.description", ""),
                         ("img", " AND NOT starts_with(img, 'generic/') AND NOT starts_with(img, 'iconsets/') AND NOT contains(img, '/lib/')")]
    ) + ", system.price AS v_price, system.avail AS v_avail, meta.page AS v_page",
    " + ".join(f"CAST(v_{f} IS NOT NULL AS INTEGER)" for f in P5_FIELDS),
    ", ".join(
        f"first(v_{f} ORDER BY layer, t DESC, c DESC, ts DESC NULLS LAST, row_id) FILTER (v_{f} IS NOT NULL) AS {f}, "
        f"first(row_id ORDER BY layer, t DESC, c DESC, ts DESC NULLS LAST, row_id) FILTER (v_{f} IS NOT NULL) AS {f}_row" for f in P5_FIELDS
    ),
)


P5_SQL = r"""
WITH i AS (SELECT *, count(*) OVER (PARTITION BY domain, id) AS n,
    length(regexp_replace(system.description, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS filled,
    coalesce(list_position(['extracted', 'review', 'reviewed', 'approved'], meta.qa_status), 0) AS trust FROM item),
r AS (SELECT domain, id, 'description' AS field, CAST(row_id AS VARCHAR) AS pick,
    row_number() OVER (PARTITION BY domain, id ORDER BY filled DESC, meta.extracted_at DESC NULLS LAST, row_id) AS k FROM i WHERE n > 1 AND filled > 0
  UNION ALL SELECT domain, id, 'img', CAST(row_id AS VARCHAR),
    row_number() OVER (PARTITION BY domain, id ORDER BY trust DESC, meta.extracted_at DESC NULLS LAST, row_id)
  FROM i WHERE n > 1 AND img <> '' AND NOT starts_with(img, 'generic/') AND NOT starts_with(img, 'iconsets/') AND NOT contains(img, '/lib/'))
SELECT domain, id, field, pick FROM r WHERE k = 1
UNION ALL SELECT DISTINCT domain, id, 'sources', coalesce(s.book, '') || ':' || s.page
FROM (SELECT domain, id, unnest(meta.sources) AS s FROM i WHERE n > 1) WHERE s.page IS NOT NULL
"""


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: garbled texts with what they said, where it can be restored."""
    items = table(spark, sf_dir, "item").select(F.lit("item").alias("dataset"), F.col("row_id").alias("row_key"), F.col("name").alias("text"))
    fixes = table(spark, sf_dir, "correction").select(F.lit("correction"), "correction_id", "system.price")
    found = restore_encoding(items.union(fixes), "dataset", "row_key", "text")
    return found.withColumnRenamed("key", "row_key")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: rows with text decoded with a wrong encoding."""
    return p3_restored(spark, sf_dir).select("dataset", "row_key").distinct()


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: the item that each correction speaks of, with a confidence."""
    found = match_entities(
        table(spark, sf_dir, "correction"), {"id": "correction_id", "category": "category", "name": "ref.name", "book": "ref.book", "page": "ref.page"},
        table(spark, sf_dir, "item"), {"id": "row_id", "category": "category", "name": "name", "book": "book", "page": "meta.page"},
        table(spark, sf_dir, "registry"), "slug", "title",
    )
    return found.select(F.col("mention").alias("correction_id"), F.col("record").alias("row_id"), "confidence")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: the item that each correction speaks of."""
    return p7_matches(spark, sf_dir).select("correction_id", "row_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: the token identifiers of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9 with the longest shared run and the number of the item's shingles in shared runs."""
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: documents and the test items leaked in them."""
    return shared_runs(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text").select("doc_id", "item_id").distinct()


P9_SQL = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
g AS (SELECT DISTINCT side, id, array_to_string(ws[k:k + 11], ' ') AS run FROM (SELECT *, unnest(range(1, len(ws) - 10)) AS k FROM w))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.run = i.run AND d.side = 'd' AND i.side = 'i'
"""

P9_LEAKS_SQL = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
g AS (SELECT side, id, k, array_to_string(ws[k:k + 11], ' ') AS run FROM (SELECT *, unnest(range(1, len(ws) - 10)) AS k FROM w)),
m AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.k AS dk, i.k AS ik FROM g d JOIN g i ON d.run = i.run AND d.side = 'd' AND i.side = 'i'),
r AS (SELECT *, dk - row_number() OVER (PARTITION BY doc_id, item_id, dk - ik ORDER BY dk) AS island FROM m),
l AS (SELECT doc_id, item_id, max(n) AS run_words FROM (SELECT doc_id, item_id, count(*) + 11 AS n FROM r GROUP BY doc_id, item_id, dk - ik, island) GROUP BY doc_id, item_id),
s AS (SELECT doc_id, item_id, count(DISTINCT ik + o) AS shared_shingles FROM (SELECT *, unnest(range(0, 8)) AS o FROM m) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, run_words, shared_shingles FROM l JOIN s USING (doc_id, item_id)
"""


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 10: spam documents with their robust distance."""
    return spam_pages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumnRenamed("key", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 10: documents made of keywords, links, tags or product entries."""
    return p10_scores(spark, sf_dir).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_collapsed": p2_collapsed,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p5_found": p5_found,
    "p5_survivors": p5_survivors,
    "p7_found": p7_found,
    "p7_matches": p7_matches,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
}
SQL: dict[str, str] = {
    "p2_found": P2_SQL + "SELECT first_raw_id, raw_id FROM g WHERE copies > 1",
    "p2_collapsed": P2_SQL + "SELECT raw_id, copies FROM g WHERE raw_id = first_raw_id",
    "p5_found": P5_SQL,
    "p5_survivors": P5_SURVIVORS_SQL,
    "p9_found": P9_SQL,
    "p9_leaks": P9_LEAKS_SQL,
}
