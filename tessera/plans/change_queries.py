"""Queries of set operations, change data and quality rules on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import predicates, text
from tessera.operators import changes, quality, ranking
from tessera.plans.registry import registry
from tessera.session import table
from tessera.sources.library import dataset_parts

QUERIES, SQL, query = registry()


@query("""
WITH b AS (SELECT l_returnflag, l_linestatus, l_suppkey FROM lineitem), n AS (SELECT l_returnflag, l_linestatus, l_suppkey FROM lineitem WHERE l_linenumber <= 3)
SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS missing FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM n) GROUP BY 1, 2, 3""")
def multiset_restore(spark, sf_dir):
    """How many rows of each key are gone."""
    li = table(spark, sf_dir, "lineitem")
    keys = ["l_returnflag", "l_linestatus", "l_suppkey"]
    return changes.multiset_difference(li.select(*keys), li.filter("l_linenumber <= 3").select(*keys), keys)


@query("""
WITH b AS (SELECT domain, id, row_id, row_number() OVER (PARTITION BY domain, id ORDER BY row_id) AS r, count(*) OVER (PARTITION BY domain, id) AS n FROM item WHERE id IS NOT NULL AND domain IS NOT NULL),
k AS (SELECT domain, id, count(*) AS n FROM item WHERE meta.qa_status = 'approved' GROUP BY 1, 2)
SELECT domain, id, row_id FROM b LEFT JOIN k USING (domain, id) WHERE r <= b.n - coalesce(k.n, 0)""")
def resurrected_rows(spark, sf_dir):
    """The first missing rows of each key after all but approved rows were lost."""
    i = table(spark, sf_dir, "item").filter("id is not null and domain is not null").select("domain", "id", "row_id", "meta.qa_status")
    return changes.resurrect(i.select("domain", "id", "row_id"), i.filter("qa_status = 'approved'").select("domain", "id"), ["domain", "id"], ["row_id"])


@query("SELECT p_brand FROM part WHERE p_size < 5 UNION SELECT p_brand FROM part WHERE p_type = 'SMALL' EXCEPT SELECT p_brand FROM part WHERE p_size > 49")
def stale_keys(spark, sf_dir):
    """U3."""
    p = table(spark, sf_dir, "part")
    return p.filter("p_size < 5").select("p_brand").union(p.filter("p_type = 'SMALL'").select("p_brand")).distinct().subtract(p.filter("p_size > 49").select("p_brand"))


@query("""
WITH c AS (SELECT DISTINCT row_id, name, system.price AS price, system.avail AS avail FROM item_copy),
d AS (SELECT c.row_id, CASE WHEN c.name IS NOT NULL AND c.name IS DISTINCT FROM i.name THEN 'name=' || c.name END AS a, CASE WHEN c.price IS NOT NULL AND c.price IS DISTINCT FROM i.system.price THEN 'price=' || c.price END AS b,
  CASE WHEN c.avail IS NOT NULL AND c.avail IS DISTINCT FROM i.system.avail THEN 'avail=' || c.avail END AS e FROM c JOIN item i USING (row_id))
SELECT row_id, concat_ws('|', a, b, e) AS changed FROM d WHERE coalesce(a, b, e) IS NOT NULL""")
def field_delta(spark, sf_dir):
    """The fields that differ from the library in its copy; removed ones are not recorded."""
    flat = lambda name: table(spark, sf_dir, name).select("row_id", "name", F.col("system.price").alias("price"), F.col("system.avail").alias("avail")).distinct()
    d = changes.delta(flat("item"), flat("item_copy"), "row_id", ["name", "price", "avail"])
    return d.select("row_id", F.array_join(F.transform(F.map_entries("changed"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("changed"))


@query("""
WITH c AS (SELECT DISTINCT row_id, name, system.price AS price FROM item_copy)
SELECT i.row_id, coalesce(c.name, i.name) AS name, coalesce(c.price, i.system.price) AS price FROM item i LEFT JOIN c USING (row_id)""")
def applied_delta(spark, sf_dir):
    """The deltas laid over the library give the copy's values."""
    flat = lambda name: table(spark, sf_dir, name).select("row_id", "name", F.col("system.price").alias("price")).distinct()
    return changes.apply_delta(flat("item"), changes.delta(flat("item"), flat("item_copy"), "row_id", ["name", "price"]), "row_id", {"name": "string", "price": "bigint"})


@query("""
SELECT row_id FROM item EXCEPT SELECT min(i.row_id) FROM item i WHERE EXISTS (SELECT 1 FROM correction c WHERE c.deleted AND c.ref.name = i.name AND c.category = i.category) GROUP BY i.name, i.category""")
def tombstone_one_row(spark, sf_dir):
    """Each deletion takes exactly one of the rows it names."""
    i = table(spark, sf_dir, "item").select("row_id", "name", "category")
    dead = table(spark, sf_dir, "correction").filter("deleted").select("ref.name", "category")
    return changes.remove_one(i, dead, ["name", "category"], ["row_id"], "row_id").select("row_id")


@query("""
WITH m AS (SELECT domain, category, ref.name AS name, min(moved_to.domain) AS d, min(moved_to.category) AS c FROM correction WHERE moved_to.domain IS NOT NULL GROUP BY 1, 2, 3),
i AS (SELECT row_id, domain, category, name FROM item)
SELECT i.row_id, CASE WHEN m.d IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i t WHERE t.domain = m.d AND t.category = m.c AND t.name = i.name) THEN m.d ELSE i.domain END AS domain,
  CASE WHEN m.d IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i t WHERE t.domain = m.d AND t.category = m.c AND t.name = i.name) THEN m.c ELSE i.category END AS category FROM i LEFT JOIN m USING (domain, category, name)""")
def moved_rows(spark, sf_dir):
    """C4: rows moved between domains unless their name is there already."""
    moves = table(spark, sf_dir, "correction").filter("moved_to.domain is not null").groupBy("domain", "category", F.col("ref.name").alias("name")).agg(F.min("moved_to.domain").alias("d"), F.min("moved_to.category").alias("c"))
    i = table(spark, sf_dir, "item").select("row_id", "domain", "category", "name")
    return changes.move(i, moves, ["domain", "category", "name"], {"domain": "d", "category": "c"}, ["name"]).select("row_id", "domain", "category")


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_custkey < 10 AND o_orderkey % 2 = 0)
UNION ALL SELECT o_orderkey, 'X', o_totalprice FROM orders WHERE o_custkey < 10 AND o_orderkey % 2 = 0""")
def idempotent_reload(spark, sf_dir):
    """Partitions by priority replaced by a fresh delivery; loaded twice, as loading again changes nothing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    fresh = o.filter("o_custkey < 10 and o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("X"))
    once = changes.reload(o, fresh, ["o_orderpriority"])
    return changes.reload(once, fresh, ["o_orderpriority"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1999-01-01')
UNION ALL SELECT o_orderkey, 'X', o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1999-01-01'""")
def reloaded_priorities(spark, sf_dir):
    """Two priorities replaced by a delivery of all their orders from 1999 on, loaded twice; the other priorities stay."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    fresh = o.filter("o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderdate >= timestamp '1999-01-01'").withColumn("o_orderstatus", F.lit("X"))
    once = changes.reload(o, fresh, ["o_orderpriority"])
    return changes.reload(once, fresh, ["o_orderpriority"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""
SELECT row_id, name, false AS added FROM item UNION ALL SELECT DISTINCT row_id, name, true FROM item_copy c WHERE NOT EXISTS (SELECT 1 FROM item i WHERE i.row_id = c.row_id)""")
def seeded_rows(spark, sf_dir):
    """Only rows of the copy that are absent are added."""
    i = table(spark, sf_dir, "item").select("row_id", "name", F.lit(False).alias("added"))
    return changes.seed_absent(i, table(spark, sf_dir, "item_copy").select("row_id", "name", F.lit(True).alias("added")).distinct(), ["row_id"])


@query("""
SELECT i.row_id, CASE WHEN c.row_id IS NOT NULL THEN 'patched' ELSE i.meta.qa_status END AS qa_status, c.row_id IS NOT NULL AS hit FROM item i LEFT JOIN (SELECT DISTINCT row_id FROM item_copy WHERE system.price > 5000) c USING (row_id)
UNION ALL SELECT DISTINCT row_id, 'failed', false FROM item_copy WHERE system.price > 5000 AND row_id NOT IN (SELECT row_id FROM item)""")
def bulk_patch(spark, sf_dir):
    """The same change to many targets; targets that name no row are reported."""
    i = table(spark, sf_dir, "item").select("row_id", "meta.qa_status", F.lit(False).alias("hit"))
    targets = table(spark, sf_dir, "item_copy").filter("system.price > 5000").select("row_id").distinct()
    changed, failed = changes.patch(targets, i, ["row_id"], {"qa_status": F.lit("patched"), "hit": F.lit(True)})
    return changed.unionByName(failed.select("row_id", F.lit("failed").alias("qa_status"), F.lit(False).alias("hit")))


@query("""
WITH e AS (SELECT user_id, event_id, ts, value, event_type = 'error' AS undo, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS raw FROM events),
d AS (SELECT *, raw - least(0, min(raw) OVER (PARTITION BY user_id ORDER BY event_id)) AS depth FROM e),
s AS (SELECT *, NOT undo AND coalesce(min(depth) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), depth) >= depth AS stands FROM d)
SELECT user_id, count(CASE WHEN stands THEN 1 END) AS standing, round(sum(CASE WHEN stands THEN coalesce(value, 0.0) ELSE 0.0 END), 4) AS balance FROM s GROUP BY 1""")
def ledger_fold(spark, sf_dir):
    """An error takes back the last entry of its user that still stands."""
    return changes.ledger_balance(table(spark, sf_dir, "events"), "user_id", "event_id", "value", "event_type", undo="error")


@query("""
WITH l AS (SELECT row_id, name, 0 AS layer FROM item UNION ALL SELECT DISTINCT row_id, name, 1 FROM item_copy) SELECT row_id, arg_max(name, layer) FILTER (WHERE true) AS name FROM (SELECT row_id, coalesce(name, '') AS name, layer FROM l) GROUP BY 1""")
def layered_rows(spark, sf_dir):
    """The last layer that has a row wins."""
    own = table(spark, sf_dir, "item").select("row_id", F.coalesce("name", F.lit("")).alias("name"))
    return changes.last_wins([own, table(spark, sf_dir, "item_copy").select("row_id", F.coalesce("name", F.lit("")).alias("name")).distinct()], ["row_id"])


@query("""
WITH s AS (SELECT row_id, unnest(meta.sources) AS s FROM item), a AS (SELECT row_id, coalesce(s.book, '') || ':' || coalesce(CAST(s.page AS VARCHAR), '') AS r FROM s UNION SELECT row_id, coalesce(book, '') || ':' || coalesce(CAST(meta.page AS VARCHAR), '') FROM item)
SELECT row_id, string_agg(r, '|' ORDER BY r) AS sources FROM a GROUP BY 1""")
def appended_references(spark, sf_dir):
    """The own (book, page) added to the sources unless present."""
    ref = lambda b, p: F.concat(F.coalesce(b, F.lit("")), F.lit(":"), F.coalesce(p.cast("string"), F.lit("")))
    i = table(spark, sf_dir, "item").select("row_id", F.transform("meta.sources", lambda s: ref(s["book"], s["page"])).alias("sources"), ref(F.col("book"), F.col("meta.page")).alias("own"))
    out = changes.append_reference(i.select("row_id", "sources"), "sources", i.select("row_id", "own"), "row_id", "own")
    return out.select("row_id", F.array_join(F.array_sort("sources"), "|").alias("sources"))


@query("""
SELECT correction_id, rule, message FROM (SELECT DISTINCT correction_id, system.price AS price, system.avail AS avail, domain, ref.book AS book FROM correction),
  LATERAL (SELECT unnest(['type:price', 'type:avail', 'required:book']) AS rule, unnest([CASE WHEN price <> '' AND TRY_CAST(price AS BIGINT) IS NULL THEN 'price is no bigint: ' || price END,
    CASE WHEN avail <> '' AND TRY_CAST(avail AS INTEGER) IS NULL THEN 'avail is no int: ' || avail END, CASE WHEN coalesce(book, '') = '' THEN 'book is not set' END]) AS message) WHERE message IS NOT NULL""")
def schema_issues(spark, sf_dir):
    """Q1: free text that does not read as its declared type, '' counting as not set."""
    c = table(spark, sf_dir, "correction").select("correction_id", "system.price", "system.avail", "domain", "ref.book").distinct()
    return quality.row_issues(c, ["correction_id"], quality.schema_rules(c, {"price": "bigint", "avail": "int"}, ["book"]))


@query("""
WITH i AS (SELECT row_id, 'avail' AS rule, 'avail over 30: ' || system.avail AS message FROM item WHERE system.avail > 12 UNION ALL SELECT row_id, 'price', 'price over 10M' FROM item WHERE system.price > 50000
  UNION ALL SELECT row_id, 'page', 'page over 1500' FROM item WHERE meta.page > 1500 UNION ALL SELECT row_id, 'art', 'guessed portrait' FROM item WHERE system.type = 'CRITTER' AND (starts_with(img, 'generic/') OR starts_with(img, 'iconsets/') OR contains(img, '/lib/'))
  UNION ALL SELECT row_id, 'variant', 'unresolved: ' || meta.variant_of FROM item WHERE meta.variant_of <> '' AND meta.variant_of NOT IN (SELECT id FROM item WHERE id IS NOT NULL)
  UNION ALL SELECT row_id, 'book', 'unresolved: ' || book FROM item WHERE book <> '' AND book NOT IN (SELECT slug FROM registry WHERE slug <> 'gridline_core'))
SELECT row_id, rule, message FROM i""")
def quality_issues(spark, sf_dir):
    """Rules as data, row rules in one scan, foreign keys by anti join."""
    item = table(spark, sf_dir, "item").select("row_id", "book", "id", "img", "system", "meta")
    rules = [
        quality.Rule("avail", F.col("system.avail") > 12, F.concat(F.lit("avail over 30: "), F.col("system.avail").cast("string"))), quality.Rule("price", F.col("system.price") > 50000, "price over 10M"),
        quality.Rule("page", F.col("meta.page") > 1500, "page over 1500"), quality.Rule("art", (F.col("system.type") == "CRITTER") & predicates.placeholder_art(F.col("img")), "guessed portrait"),
    ]
    out = quality.row_issues(item, ["row_id"], rules)
    out = out.unionByName(quality.foreign_key_issues(item.withColumn("v", F.col("meta.variant_of")), ["row_id"], "v", item, "id", "variant"))
    return out.unionByName(quality.foreign_key_issues(item, ["row_id"], "book", table(spark, sf_dir, "registry").filter("slug <> 'gridline_core'"), "slug", "book"))


@query("SELECT row_id FROM item WHERE regexp_replace(coalesce(img, ''), '\\.[^./]*$', '') NOT LIKE '%/' || book || '/' || id OR book IS NULL OR id IS NULL OR img IS NULL")
def path_issues(spark, sf_dir):
    """Q3, Q7: pictures that do not lie at .../book/id."""
    return quality.path_issues(table(spark, sf_dir, "item").select("row_id", F.concat(F.lit("x/"), F.coalesce("img", F.lit(""))).alias("img"), "book", "id"), "img", ["book", "id"]).select("row_id")


@query("""
WITH c AS (SELECT count(*) AS n FROM item WHERE coalesce(img, '') = ''), t AS (SELECT count(*) AS n FROM item) SELECT c.n AS unknown, t.n AS total, c.n <= greatest(10, t.n // 20) AS ok FROM c, t""")
def coverage_tolerance(spark, sf_dir):
    """Q9."""
    item = table(spark, sf_dir, "item")
    return quality.tolerance(item.filter("coalesce(img, '') = ''"), item)


@query("""
WITH i AS (SELECT 'price' AS rule, 'price ' || system.price AS message FROM item WHERE system.price > 20000 UNION ALL SELECT 'avail', 'avail ' || system.avail FROM item WHERE system.avail > 10), r AS (SELECT unnest(['price', 'avail', 'page']) AS rule)
SELECT r.rule, count(i.rule) = 0 AS ok, count(i.rule) AS n, coalesce(array_to_string(list_sort(list_distinct(list(message) FILTER (WHERE message IS NOT NULL)))[:8], ', '), '') AS offenders FROM r LEFT JOIN i USING (rule) GROUP BY 1""")
def rule_report(spark, sf_dir):
    """Every rule with its violations and the eight smallest messages."""
    item = table(spark, sf_dir, "item")
    rules = [quality.Rule("price", F.col("system.price") > 20000, F.concat(F.lit("price "), F.col("system.price").cast("string"))), quality.Rule("avail", F.col("system.avail") > 10, F.concat(F.lit("avail "), F.col("system.avail").cast("string"))), quality.Rule("page", F.col("meta.page") > 5000, "page")]
    out = quality.report(quality.row_issues(item, ["row_id"], rules), [r.name for r in rules])
    return out.withColumn("offenders", F.array_join("offenders", ", "))


@query("""
WITH v AS (SELECT * FROM item WHERE NOT coalesce(meta.hidden, false) AND meta.qa_status IN ('reviewed', 'approved') AND id IS NOT NULL)
SELECT book, domain, id, row_id, row_number() OVER (PARTITION BY book, domain, id ORDER BY row_id) = 1 AS kept, coalesce(meta.page, 0) AS page, coalesce(system.description, '') AS description FROM v""")
def export_docs(spark, sf_dir):
    """Visible rows of the wanted state, the first of an id kept, null (not blank) fields defaulted."""
    from pyspark.sql import Window

    v = table(spark, sf_dir, "item").filter("not coalesce(meta.hidden, false) and meta.qa_status in ('reviewed', 'approved') and id is not null")
    first = F.row_number().over(Window.partitionBy("book", "domain", "id").orderBy("row_id")) == 1
    return v.select("book", "domain", "id", "row_id", first.alias("kept"), F.coalesce("meta.page", F.lit(0)).alias("page"), F.coalesce("system.description", F.lit("")).alias("description"))


@query("""
WITH c AS (SELECT DISTINCT row_id, name, system.price AS price FROM item_copy)
SELECT i.row_id, false AS deleted, concat_ws('|', CASE WHEN c.name IS NOT NULL AND c.name IS DISTINCT FROM i.name THEN 'name=' || c.name END, CASE WHEN c.price IS NOT NULL AND c.price IS DISTINCT FROM i.system.price THEN 'price=' || c.price END) AS changed
FROM item i JOIN c USING (row_id) WHERE (c.name IS NOT NULL AND c.name IS DISTINCT FROM i.name) OR (c.price IS NOT NULL AND c.price IS DISTINCT FROM i.system.price)
UNION ALL SELECT row_id, true, '' FROM item WHERE row_id NOT IN (SELECT row_id FROM c)""")
def recorded_changes(spark, sf_dir):
    """Deltas and tombstones that lead from the library to its copy."""
    flat = lambda name: table(spark, sf_dir, name).select("row_id", "name", F.col("system.price").alias("price")).distinct()
    out = changes.recorded_changes(flat("item"), flat("item_copy"), "row_id", ["name", "price"])
    return out.select("row_id", "deleted", F.array_join(F.transform(F.map_entries("changed"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("changed"))


@query("""
SELECT row_id, (len(list_filter(ts, lambda t: regexp_matches(t, '\\d'))) / len(ts) > 0.1 OR regexp_matches(d, '\\S\\s+[A-Z]{2,}\\s+[A-Z]{2,}\\s+[A-Z]{2,}\\b')) IS TRUE AS malformed FROM (SELECT row_id, d, list_filter(string_split_regex(trim(d, ' '), '\\s+'), lambda t: t <> '') AS ts
  FROM (SELECT row_id, system.description AS d FROM item)) WHERE d IS NULL OR len(ts) > 0""")
def malformed_texts(spark, sf_dir):
    """Descriptions that a table or heading bled into."""
    d = F.col("system.description")
    rows = table(spark, sf_dir, "item").filter(d.isNull() | d.rlike(r"\S"))
    return rows.select("row_id", predicates.malformed(d, 0.1).alias("malformed"))


@query("""
SELECT 'registry' AS part, count(*) AS n, count(*) FILTER (WHERE published IS NULL) AS undated FROM registry UNION ALL SELECT 'region', count(*), 0 FROM region UNION ALL SELECT 'nation', count(*), 0 FROM nation""")
def rules_dataset(spark, sf_dir):
    """K9: three dimension tables as one dataset of JSON records."""
    parts = {n: table(spark, sf_dir, n) for n in ("registry", "region", "nation")}
    undated = F.count(F.when((F.col("part") == "registry") & F.get_json_object("record", "$.published").isNull(), 1))
    return dataset_parts(parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"), undated.alias("undated"))


@query(r"""
WITH r AS (SELECT raw_id, book, json_extract_string(payload, '$.name') AS name, json_extract_string(payload, '$.category') AS category, TRY_CAST(json_extract_string(payload, '$.page') AS INTEGER) AS page, TRY_CAST(json_extract_string(payload, '$.price') AS BIGINT) AS price FROM raw_item),
k AS (SELECT *, regexp_replace(lower(replace(regexp_replace(name, '(?i)\s*\([^()]*variant[^()]*\)\s*$', ''), 'ß', 'ss')), '[^a-z0-9]+', '', 'g') AS base FROM r),
f AS (SELECT * FROM k WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book, base, page ORDER BY raw_id) = 1),
s AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY book, slug ORDER BY raw_id) AS n FROM s)
SELECT raw_id, book, name, page, price, CASE WHEN n > 1 THEN slug || '_' || n ELSE slug END AS id, concat_ws(',', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN page > 300 THEN 'page' END) AS issues FROM n""")
def one_pass_ingest(spark, sf_dir):
    """Incoming records read, keyed, deduplicated, given ids and checked, as one plan."""
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    raw = table(spark, sf_dir, "raw_item").select("raw_id", "book", get("name").alias("name"), get("page").try_cast("int").alias("page"), get("price").try_cast("bigint").alias("price"))
    keyed = raw.filter("name is not null").withColumn("base", text.norm_base(F.col("name")))
    first = ranking.first_per(keyed, ["book", "base", "page"], ["raw_id"]).withColumn("slug", text.slugify(F.col("name")))
    named = ranking.suffixed_ids(first, "slug", ["raw_id"], scope=["book"])
    issues = F.concat_ws(",", F.when(F.col("price").isNull(), "price"), F.when(F.col("page") > 300, "page"))
    return named.select("raw_id", "book", "name", "page", "price", F.col("new_id").alias("id"), issues.alias("issues"))
