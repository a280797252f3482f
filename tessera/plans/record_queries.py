"""Queries of the heading, spatial and record operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import headings, records
from tessera.operators.nested import flat_tables
from tessera.operators.sequence import lines_of
from tessera.plans.problems import _TREES
from tessera.plans.registry import registry
from tessera.session import table

QUERIES, SQL, query = registry()

_NORM = "regexp_replace(lower(replace({}, 'ß', 'ss')), '[^a-z0-9]+', '', 'g')"


@query(rf"""
WITH l AS (SELECT correction_id AS lk, ref.book AS g, coalesce(ref.page, 150) AS lp, {_NORM.format("trim(ref.name, ' ')")} AS k FROM correction WHERE len(string_split_regex(trim(ref.name, ' '), '\s+')) <= 6 AND {_NORM.format("trim(ref.name, ' ')")} <> ''),
n AS (SELECT row_id AS nk, book AS g, meta.page AS np, name AS n, {_NORM.format("name")} AS full, regexp_replace(name, '\s*\([^)]*\)', '', 'g') AS bare FROM item WHERE name IS NOT NULL),
v AS (SELECT nk, g, np, "full", unnest([n, bare, split_part(bare, '/', 1), regexp_replace(bare, '^([^,]+),\s*(.+)$', '\2 \1'), regexp_replace(bare, '\s+(?:\S*\d\S*|[IVX]+)$', '')]) AS v FROM n),
p AS (SELECT nk, g, np, "full", {_NORM.format("v")} AS k FROM v), f AS (SELECT nk, g, np, "full", 1 AS r, unnest([k, CASE WHEN k LIKE '%s' THEN left(k, length(k) - 1) ELSE k || 's' END]) AS k FROM p),
a AS (SELECT DISTINCT * FROM f UNION SELECT nk, g, np, "full", 2, {_NORM.format(r"regexp_extract(n, '(\S+\s+\S+)\s*$', 1)")} FROM n),
m AS (SELECT lk, lp, nk, np, "full", r FROM l JOIN a USING (g, k) WHERE k <> '' UNION ALL SELECT lk, lp, nk, np, "full", 3 FROM l JOIN n ON l.g = n.g AND length(k) >= 6 AND length("full") > 6 AND starts_with("full", k)),
c AS (SELECT *, min(r) OVER (PARTITION BY lk) AS best FROM m WHERE abs(lp - np) <= 8)
SELECT lk AS correction_id, min(nk) AS row_id, CASE best WHEN 1 THEN 'full' WHEN 2 THEN 'tail' ELSE 'prefix' END AS kind FROM c WHERE r = best GROUP BY lk, best HAVING min("full") = max("full")""")
def heading_join(spark, sf_dir):
    """Cited names against the names of their book within eight pages; ambiguous ones are refused."""
    said = table(spark, sf_dir, "correction").select("correction_id", "ref.name", "ref.book", F.coalesce("ref.page", F.lit(150)).alias("page"))
    known = table(spark, sf_dir, "item").filter("name is not null").select("row_id", "name", "book", "meta.page")
    return headings.heading_matches(said, "name", "correction_id", known, "name", "row_id", "book", "page")


@query()
def nearest_free_place(spark, sf_dir):
    """Every purchase of a user takes the nearest free view within six hours. Greedy in order, so it has no SQL """
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").cast("double").alias("at"))
    side = lambda kind, name: e.filter(F.col("event_type") == kind).select("user_id", "at", F.col("event_id").alias(name))
    return headings.nearest_free(side("purchase", "purchase_id"), side("view", "view_id"), ["user_id"], "at", "purchase_id", "view_id", 21600.0)


@query("""
WITH i AS (SELECT row_id, book, meta.page AS page FROM item WHERE meta.page IS NOT NULL), l AS (SELECT DISTINCT correction_id, g.slug AS book, ref.page AS line_page FROM correction JOIN registry g ON lower(ref.book) = g.slug WHERE ref.page IS NOT NULL),
p AS (SELECT correction_id, row_id, 60 - 10 * abs(page - line_page) - row_id % 7 AS score FROM l JOIN i ON i.book = l.book AND abs(page - line_page) <= 2)
SELECT correction_id, max(score) AS score, arg_min(row_id, (-score, row_id)) AS row_id FROM p GROUP BY 1""")
def page_evidence(spark, sf_dir):
    """The row with most evidence within two pages of a citation."""
    images = table(spark, sf_dir, "item").filter("meta.page is not null").select("row_id", "book", "meta.page")
    cited = table(spark, sf_dir, "correction").filter("ref.page is not null").select("correction_id", F.lower("ref.book").alias("slug"), "ref.page").distinct()
    lines = cited.join(table(spark, sf_dir, "registry").select("slug"), "slug").select("correction_id", F.col("slug").alias("book"), "page")
    score = 60 - 10 * F.abs(F.col("page") - F.col("line_page")) - F.col("row_id") % 7
    return headings.evidence_pairs(images, lines, ["book"], "page", 2, score, "row_id", "correction_id")


@query(r"""
WITH n AS (SELECT DISTINCT book, correction_id, line, unnest(regexp_extract_all(regexp_replace(line, '(\d)[, \x{A0}.](\d{3})(\D|$)', '\1\2\3', 'g'), '(\d+)', 1)) AS n FROM (SELECT DISTINCT lower(ref.book) AS book, correction_id, ref.name || ' ' || system.price AS line FROM correction WHERE ref.name IS NOT NULL AND system.price IS NOT NULL)),
h AS (SELECT row_id, min((correction_id, line)) AS b FROM item JOIN n ON n.book = item.book AND n.n = CAST(item.system.price AS VARCHAR) GROUP BY 1)
SELECT row_id, trim(regexp_extract(b[2], '^\s*((?:[\p{L}][\p{L}\p{N}_''’.-]*\s*)+)', 1)) <> '' AS named FROM h""")
def price_anchors(spark, sf_dir):
    """Items found again by their price in the citations of their book."""
    lines = table(spark, sf_dir, "correction").filter("ref.name is not null and system.price is not null").select(F.lower("ref.book").alias("book"), "correction_id", F.concat_ws(" ", "ref.name", "system.price").alias("line")).distinct()
    items = table(spark, sf_dir, "item").filter("system.price is not null").select("row_id", "book", "system.price")
    return headings.anchored_rows(items, "row_id", "price", lines, "line", "correction_id", "book").select("row_id", (F.col("name") != "").alias("named"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'body|armor' WHEN p_size % 3 = 1 THEN 'bodyarmor|speed' END AS parts FROM part""")
def caption_parts(spark, sf_dir):
    """Captions run together, longest known word first, all or nothing."""
    size = F.col("p_size") % 3
    text = F.when(size == 0, "bodyarmor").when(size == 1, "bodyarmorspeed").otherwise("bodyx")
    known = ["body", "armor", "speed"]
    parts = F.when(size == 1, headings.caption_parts(text, [*known, "bodyarmor"])).otherwise(headings.caption_parts(text, known))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parts, "|").alias("parts"))


@query("""
WITH w AS (SELECT doc_id, length(line) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)))
SELECT doc_id, CASE WHEN least(count(CASE WHEN x < 100 THEN 1 END), count(*) - count(CASE WHEN x < 100 THEN 1 END)) >= 0.15 * count(*) THEN 2 ELSE 1 END AS columns FROM w GROUP BY 1""")
def column_layout(spark, sf_dir):
    """Documents whose lines fall on both sides of the middle."""
    lines = lines_of(table(spark, sf_dir, "documents").select("doc_id", "text").distinct(), "doc_id", "text")
    return headings.two_columns(lines.select("doc_id", F.length("line").alias("x")), ["doc_id"], "x", 200.0)


@query(r"""
WITH v AS (SELECT raw_id, CASE raw_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN json_extract_string(payload, '$.page') WHEN 2 THEN json_extract_string(payload, '$.essence') ELSE json_extract_string(payload, '$.name') END AS v FROM raw_item)
SELECT raw_id, CASE WHEN lower(trim(v, ' ')) IN ('true', 'false') THEN lower(trim(v, ' ')) = 'true' END AS bool, CASE WHEN regexp_matches(trim(v, ' '), '^[+-]?\d+$') THEN TRY_CAST(v AS BIGINT) END AS int, CASE WHEN regexp_matches(trim(v, ' '), '^[+-]?\d*\.\d+$') THEN TRY_CAST(v AS DOUBLE) END AS number,
  CASE WHEN NOT (lower(trim(v, ' ')) IN ('true', 'false') OR regexp_matches(trim(v, ' '), '^[+-]?\d+$') OR regexp_matches(trim(v, ' '), '^[+-]?\d*\.\d+$')) THEN v END AS text FROM v""")
def tagged_values(spark, sf_dir):
    """texts as what they read as."""
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    n = F.col("raw_id") % 4
    v = F.when(n == 0, "True").when(n == 1, get("page")).when(n == 2, get("essence")).otherwise(get("name"))
    return table(spark, sf_dir, "raw_item").select("raw_id", records.tagged(v).alias("t")).select("raw_id", "t.*")


@query("""
SELECT book, min(CASE WHEN domain = 'gear' THEN row_id END) AS gear, min(CASE WHEN domain = 'spells' THEN row_id END) AS spells, min(CASE WHEN domain = 'vehicles' THEN row_id END) AS vehicles FROM item GROUP BY 1""")
def pivoted_domains(spark, sf_dir):
    """one row per book, one column per stated domain."""
    return records.pivot_rows(table(spark, sf_dir, "item").select("book", "domain", "row_id"), "book", "domain", "row_id", ["gear", "spells", "vehicles"])


@query(r"""
WITH m AS (SELECT raw_id, payload, json_keys(payload) AS ks FROM raw_item WHERE json_valid(payload)), o AS (SELECT raw_id, payload, unnest(list_distinct(list_concat(ks, ['page', 'origin']))) AS k FROM m)
SELECT raw_id, string_agg(k || '=' || CASE k WHEN 'page' THEN '0' WHEN 'origin' THEN 'raw' ELSE coalesce(json_extract_string(payload, '$."' || k || '"'), '') END, '|' ORDER BY k) AS fields FROM o WHERE k NOT IN ('note', 'skill') GROUP BY 1""")
def overlaid_fields(spark, sf_dir):
    """Prose fields pruned, a page and an origin laid over the rest."""
    over = F.create_map(F.lit("page"), F.lit("0"), F.lit("origin"), F.lit("raw"))
    fields = records.overlay(records.pruned_json(F.col("payload"), ["note", "skill"]), over)
    pairs = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return table(spark, sf_dir, "raw_item").filter("try_parse_json(payload) is not null").select("raw_id", F.array_join(pairs, "|").alias("fields"))


@query("""
WITH i AS (SELECT row_id, [lower(coalesce(system.type, '')), lower(coalesce(system.subtype, ''))] AS k, CASE WHEN system.type = 'CRITTER' THEN 'beings' WHEN system.type = 'ARMOR' THEN 'worn' ELSE domain END AS domain, CASE WHEN system.type = 'CRITTER' THEN 'animals' WHEN system.type = 'ARMOR' THEN 'body' ELSE category END AS category,
  len(coalesce(list_filter(meta.sources, lambda s: s.book IS NOT NULL), [])) > 0 AND len(list_filter(meta.sources, lambda s: s.book IS NOT NULL AND s.book NOT IN ('gridline_core', 'amber_ledger', 'heron_street'))) = 0 AS owned FROM item)
SELECT row_id, CASE WHEN list_has_any(k, ['vest', 'helmet']) AND list_has_any(k, ['lantern', 'winch', 'tools']) THEN 'mixed' WHEN list_has_any(k, ['vest', 'helmet']) THEN 'worn' WHEN list_has_any(k, ['lantern', 'winch', 'tools']) THEN 'carried' END AS kind, domain, category, owned IS TRUE AS owned FROM i""")
def routed_items(spark, sf_dir):
    """Rows routed by kind, typed by their options, owned only by a set of books."""
    options = F.array(F.lower(F.coalesce("system.type", F.lit(""))), F.lower(F.coalesce("system.subtype", F.lit(""))))
    to = records.routed(F.col("system.type"), {"CRITTER": ("beings", "animals"), "ARMOR": ("worn", "body")}, F.col("domain"), F.col("category"))
    books = F.filter(F.transform("meta.sources", lambda s: s["book"]), lambda b: b.isNotNull())
    kinds = {"worn": ["vest", "helmet"], "carried": ["lantern", "winch", "tools"]}
    out = table(spark, sf_dir, "item").select("row_id", records.typed_list(options, kinds).alias("kind"), to.alias("t"), records.owned_only_by(books, ["gridline_core", "amber_ledger", "heron_street"]).alias("owned"))
    return out.select("row_id", "kind", "t.domain", "t.category", "owned")


@query("""
WITH m AS (SELECT event_id, user_id, event_type AS t, round(value) AS v, event_id % 5 = 0 AS choice FROM events WHERE value IS NOT NULL)
SELECT user_id, CASE WHEN choice THEN 'choice' ELSE 'fixed' END AS effect, string_agg(DISTINCT t || '=' || CAST(CAST(floor(v / 20) AS BIGINT) AS VARCHAR), '|' ORDER BY t || '=' || CAST(CAST(floor(v / 20) AS BIGINT) AS VARCHAR)) AS changes FROM m GROUP BY 1, 2""")
def grouped_effects(spark, sf_dir):
    """Modifiers grouped to at most two effects each."""
    e = table(spark, sf_dir, "events").filter("value is not null").withColumn("level", F.floor(F.round("value") / 20))
    return records.grouped_effects(e, "user_id", "event_type", "level", F.col("event_id") % 5 == 0).withColumn("changes", F.array_join("changes", "|"))


@query(_TREES + """, b AS (SELECT tree_id, node_no, tag IN ('choices', 'alternates') AS dead FROM l WHERE parent_no = -1 UNION ALL
  SELECT l.tree_id, l.node_no, b.dead OR coalesce(l.tag IN ('choices', 'alternates'), false) FROM b JOIN l ON l.tree_id = b.tree_id AND l.parent_no = b.node_no)
SELECT tree_id, tag AS pool, CAST(sum(TRY_CAST(json_extract_string(node, '$.attrs.count') AS BIGINT)) AS DOUBLE) AS total FROM l JOIN b USING (tree_id, node_no)
WHERE NOT coalesce(b.dead, false) AND tag IS NOT NULL AND TRY_CAST(json_extract_string(node, '$.attrs.count') AS BIGINT) IS NOT NULL GROUP BY 1, 2""")
def tree_sums(spark, sf_dir):
    """Numbers of the attribute 'count' summed by tag, without what lies under a choice """
    nodes = flat_tables(table(spark, sf_dir, "deep_tree"), "tree_id", "tree")
    return records.ancestor_sums(nodes, "tree_id", F.try_element_at("attrs", F.lit("count")).try_cast("bigint"), F.col("tag"), ["choices", "alternates"])


@query("""
SELECT c.correction_id, c.d AS domain, coalesce(c.title, r.title) AS title, r.published FROM (SELECT DISTINCT correction_id, domain AS d, lower(ref.book) AS slug, CASE WHEN correction_id % 3 = 0 THEN 'own' END AS title FROM correction) c LEFT JOIN registry r ON c.slug = r.slug""")
def inherited_fields(spark, sf_dir):
    """Citations take title and date from their book."""
    c = table(spark, sf_dir, "correction").select("correction_id", "domain", F.lower("ref.book").alias("slug"), F.when(F.col("correction_id") % 3 == 0, "own").alias("title"), F.lit(None).cast("string").alias("published")).distinct()
    return records.inherit(c, table(spark, sf_dir, "registry"), ["slug"], ["title", "published"]).select("correction_id", "domain", "title", "published")


@query(r"""
SELECT raw_id, CAST(json_extract_string(payload, '$.page') AS BIGINT) AS page, CASE WHEN json_extract(payload, '$.price') IS NULL THEN true ELSE false END AS failed FROM raw_item""")
def mapped_rows(spark, sf_dir):
    """A Python function over all rows in parallel; what raises becomes an error, not an end."""
    import json

    def price(row: dict) -> dict:
        record = json.loads(row["payload"])
        return {"raw_id": row["raw_id"], "price": record["price"]}

    def page(row: dict) -> dict:
        return {"raw_id": row["raw_id"], "page": json.loads(row["payload"])["page"]}

    raw = table(spark, sf_dir, "raw_item").select("raw_id", "payload")
    good = records.mapped(raw, price, "raw_id bigint, price bigint").filter("error is null").select("raw_id", F.lit(False).alias("ok"))
    pages = records.mapped(raw, page, "raw_id bigint, page bigint")
    return pages.join(good, "raw_id", "left").select("raw_id", "page", F.col("ok").isNull().alias("failed"))
