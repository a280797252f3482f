"""Queries of the page-table operators and of resolution tiers on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import parse
from tessera.operators import headings, joins, layout, ranking, readers
from tessera.operators.sequence import lines_of
from tessera.plans.registry import registry
from tessera.plans.text_queries import JOINED
from tessera.session import table

QUERIES, SQL, query = registry()


def _lines(spark, sf_dir):
    return lines_of(table(spark, sf_dir, "documents").select("doc_id", "text").distinct(), "doc_id", "text")


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))"


@query("""
WITH g AS (SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS i, p_name, p_size FROM part), v AS (SELECT p_partkey, i, substr(p_name, i, 1) AS c, p_name, p_size FROM g)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY n) AS word_no, w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS n FROM part) WHERE w <> ''""")
def glyph_words(spark, sf_dir):
    """Names laid out as glyphs without blanks become words again."""
    glyphs = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.posexplode(F.split("p_name", "")).alias("i", "c")).filter("c not in (' ', '')")
    height = 8.0 + F.col("p_size") % 3
    placed = glyphs.select("p_partkey", (F.col("i") * 5.0).alias("x0"), (F.col("i") * 5.0 + 4.8).alias("x1"), height.alias("h"), "c")
    return layout.words_from_glyphs(placed, ["p_partkey"], "x0", "x1", "h", "c")


@query(rf"""
WITH {_LINES} SELECT doc_id, line_no, trim(regexp_extract(line, '^\s*(\S.*?)\s+([\d,]+\s?[¥$€]|[-–—])(?:\s+(.*?))?\s*$', 1)) AS name, trim(regexp_extract(line, '^\s*(\S.*?)\s+([\d,]+\s?[¥$€]|[-–—])(?:\s+(.*?))?\s*$', 2)) AS cost,
  trim(regexp_extract(line, '^\s*(\S.*?)\s+([\d,]+\s?[¥$€]|[-–—])(?:\s+(.*?))?\s*$', 3)) AS rest FROM l WHERE regexp_matches(line, '^\s*(\S.*?)\s+([\d,]+\s?[¥$€]|[-–—])(?:\s+(.*?))?\s*$')""")
def priced_rows(spark, sf_dir):
    """Lines of all documents that read as a name with a price and a tail."""
    return layout.parse_rows(_lines(spark, sf_dir), "line", {"cost": "money"}, tail=True).select("doc_id", "line_no", "name", "cost", "rest")


@query(rf"""
WITH {_LINES}, m AS (SELECT *, coalesce(lag(regexp_matches(line, '^Avail: ')) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS h FROM l)
SELECT doc_id, line_no, line FROM m WHERE h AND NOT regexp_matches(line, '^Avail: ')""")
def rows_after_header(spark, sf_dir):
    """The line after each 'Avail:' line."""
    return layout.rows_after(_lines(spark, sf_dir), ["doc_id"], "line_no", F.col("line").rlike("^Avail: ")).select("doc_id", "line_no", "line")


@query(rf"""
WITH {_LINES}, m AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^Avail: ') THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS header_at, list_filter(string_split_regex(trim(line, ' '), '\s+'), lambda c: c <> '') AS cs FROM l)
SELECT doc_id, line_no, header_at, array_to_string(list_concat(cs, ['', '', ''])[:3], '|') AS cells FROM m
WHERE header_at IS NOT NULL AND NOT regexp_matches(line, '^Avail: ') AND len(list_filter(cs, lambda c: regexp_matches(c, '^[+-]?[\d.,]+[¥$€%]?$'))) >= 1""")
def stat_table(spark, sf_dir):
    """Rows with a number under the last header, padded to three cells."""
    out = layout.table_rows(_lines(spark, sf_dir), ["doc_id"], "line_no", "line", F.col("line").rlike("^Avail: "), 1, 3)
    return out.select("doc_id", "line_no", "header_at", F.array_join("cells", "|").alias("cells"))


@query("""
SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_name AS name, CAST(l_quantity AS INTEGER) || '|' || l_linenumber || '|5¥|-' AS stats, CASE WHEN l_linenumber % 2 = 0 THEN 'name|cost' END AS keys FROM lineitem JOIN part ON p_partkey = l_partkey""")
def trailing_stats(spark, sf_dir):
    """Rows of names and numbers split before the numbers; header lines to column keys."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat_ws(" ", "p_name", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), F.lit("5¥ -"))
    header = F.when(F.col("l_linenumber") % 2 == 0, "Item Name  Name Cost").otherwise("Item Name Rating")
    keys = layout.header_columns(header, {"ITEM NAME": "name", "NAME": "name", "COST": "cost", "RATING": "rating"}, "cost")
    out = rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", layout.trailing_stats(line, 4).alias("t"), F.array_join(keys, "|").alias("keys"))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "t.name", F.array_join("t.stats", "|").alias("stats"), "keys").distinct()


@query("""
SELECT user_id, event_id, value FROM events WHERE value >= 20 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""")
def display_rows(spark, sf_dir):
    """The largest row of every group, from a size on."""
    return layout.display_rows(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 20.0)


@query("""
WITH m AS (SELECT book, meta.page AS page, min(system.subtype) AS section FROM item WHERE system.subtype IS NOT NULL AND meta.page IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT system.subtype) = 1),
e AS (SELECT lower(name) AS n, min(system.subtype) AS s FROM item WHERE system.subtype IS NOT NULL AND name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT system.subtype) = 1),
i AS (SELECT row_id, book, meta.page AS page, lower(name) AS n, system.subtype AS own FROM item WHERE meta.page IS NOT NULL AND book IS NOT NULL)
SELECT row_id, coalesce(e.s, own, m.section, CASE WHEN contains(i.n, 'lamp') OR contains(i.n, 'lantern') THEN 'LIGHT' END) AS subtype,
  CASE WHEN e.s IS NOT NULL THEN 1 WHEN own IS NOT NULL THEN 0 WHEN m.section IS NOT NULL THEN 2 WHEN contains(i.n, 'lamp') OR contains(i.n, 'lantern') THEN 3 END AS tier
FROM i ASOF LEFT JOIN m ON i.book = m.book AND i.page >= m.page LEFT JOIN e ON e.n = i.n""")
def subtype_tiers(spark, sf_dir):
    """An exact name may overwrite; the section at or before the page, then keywords, only fill."""
    item = table(spark, sf_dir, "item").select("row_id", "book", F.col("meta.page").alias("page"), F.lower("name").alias("n"), F.col("system.subtype").alias("own"))
    single = lambda *k: item.filter("own is not null and " + " and ".join(f"{c} is not null" for c in k)).groupBy(*k).agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo = hi").drop("hi")
    marks = single("book", "page").withColumnRenamed("lo", "section")
    rows = item.filter("page is not null and book is not null")
    placed = joins.as_of(rows, marks, ["book"], "page", ["section"], F.floor(F.col("page") / 50))
    out = placed.join(single("n").withColumnRenamed("lo", "exact"), "n", "left")
    keyword = ranking.first_match([(F.col("n").contains("lamp") | F.col("n").contains("lantern"), "LIGHT")])
    tier = F.when(F.col("exact").isNotNull(), 1).when(F.col("own").isNotNull(), 0).when(F.col("section").isNotNull(), 2).when(keyword.isNotNull(), 3)
    return out.select("row_id", F.coalesce("exact", "own", "section", keyword).alias("subtype"), tier.alias("tier"))


@query("""
WITH d AS (SELECT lower(name) AS n, system.description AS d, book, row_id FROM item WHERE trim(system.description, ' ') <> '' AND name IS NOT NULL AND book IS NOT NULL),
f AS (SELECT n, arg_min(row_id, (book, row_id)) AS source FROM d GROUP BY 1)
SELECT i.row_id, f.source FROM item i JOIN f ON lower(i.name) = f.n WHERE coalesce(trim(i.system.description, ' '), '') = ''""")
def description_fill(spark, sf_dir):
    """Blank descriptions filled from the first book that describes the name."""
    item = table(spark, sf_dir, "item").select("row_id", "book", F.lower("name").alias("n"), (F.coalesce(F.trim("system.description"), F.lit("")) != "").alias("described"))
    sources = item.filter("described and n is not null and book is not null").groupBy("n").agg(F.min(F.struct("book", "row_id")).alias("b")).select("n", F.col("b.row_id").alias("source"))
    return item.filter("not described").join(sources, "n").select("row_id", "source")


@query("""
WITH i AS (SELECT domain, lower(name) AS n, system.subtype AS s FROM item WHERE name IS NOT NULL), c AS (SELECT DISTINCT correction_id, domain, lower(ref.name) AS n, system.subtype AS s FROM correction),
m AS (SELECT domain, n, min(s) AS s, count(*) AS k FROM i GROUP BY 1, 2)
SELECT c.domain, count(*) AS cited, count(m.k) AS matched, count(CASE WHEN m.k > 1 THEN 1 END) AS several, count(CASE WHEN c.s IS NOT NULL AND m.s IS NOT NULL AND c.s <> m.s THEN 1 END) AS differing FROM c LEFT JOIN m ON c.domain = m.domain AND c.n = m.n GROUP BY 1""")
def match_report(spark, sf_dir):
    """How many citations of a domain are matched, by several rows, and differ."""
    i = table(spark, sf_dir, "item").filter("name is not null").select("domain", F.lower("name").alias("n"), F.col("system.subtype").alias("s")).groupBy("domain", "n").agg(F.min("s").alias("ms"), F.count(F.lit(1)).alias("k"))
    c = table(spark, sf_dir, "correction").select("correction_id", "domain", F.lower("ref.name").alias("n"), F.col("system.subtype").alias("s")).distinct()
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return c.join(i, ["domain", "n"], "left").groupBy("domain").agg(F.count(F.lit(1)).alias("cited"), F.count("k").alias("matched"), n(F.col("k") > 1, "several"), n(F.col("s") != F.col("ms"), "differing"))


@query("SELECT img, min(row_id) AS first_row, count(*) AS n FROM item WHERE img <> '' AND NOT starts_with(img, 'generic/') AND NOT starts_with(img, 'iconsets/') GROUP BY 1")
def first_definitions(spark, sf_dir):
    """The first row that uses each picture of a book, icons left out."""
    book_art = ~(F.col("img").startswith("generic/") | F.col("img").startswith("iconsets/"))
    return table(spark, sf_dir, "item").filter((F.col("img") != "") & book_art).groupBy("img").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def last_events(spark, sf_dir):
    """The last 500 events (a top-k feature)."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "user_id", "event_type")


@query("""
WITH t AS (SELECT slug, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: w NOT IN ('the', 'of'))) AS w FROM registry WHERE title IS NOT NULL), d AS (SELECT DISTINCT correction_id, regexp_extract_all(lower(ref.book), '[a-z]+') AS w FROM correction WHERE ref.book IS NOT NULL)
SELECT correction_id, min(slug) AS slug FROM d JOIN t ON list_has_all(d.w, t.w) GROUP BY 1 HAVING count(*) = 1""")
def title_subset(spark, sf_dir):
    """Citations that hold all words of exactly one title. Titles meet citations by their first word only."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1), lambda w: ~w.isin("the", "of")))
    t = table(spark, sf_dir, "registry").filter("title is not null").select("slug", words("title").alias("tw")).withColumn("k", F.get("tw", 0))
    d = table(spark, sf_dir, "correction").filter("ref.book is not null").select("correction_id", "ref.book").distinct().select("correction_id", words("book").alias("dw"))
    hits = d.select("correction_id", "dw", F.explode("dw").alias("k")).join(t, "k").filter(F.size(F.array_except("tw", "dw")) == 0)
    return hits.groupBy("correction_id").agg(F.min("slug").alias("slug"), F.count_distinct("slug").alias("n")).filter("n = 1").drop("n")


@query("""
SELECT row_id, name, CAST(value AS DOUBLE) AS base FROM (SELECT row_id, unnest([('avail', system.avail), ('essence', system.dmg), ('mag', system.ammocap)]) AS e FROM item) x(row_id, e), LATERAL (SELECT e[1] AS name, e[2] AS value) WHERE value IS NOT NULL""")
def nested_attributes(spark, sf_dir):
    """flat attributes as a map of structs, two of them under other names, those not set left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"system.{n}").cast("string").alias("v")) for k, n in (("avail", "avail"), ("ess", "dmg"), ("magres", "ammocap"))))
    m = parse.nest_attributes(F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())))
    return table(spark, sf_dir, "item").select("row_id", F.explode(m).alias("name", "v")).select("row_id", "name", "v.base")


_TEXT_LINES = r"""t AS (SELECT doc_id, k, regexp_replace(l, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL)),
  x AS (SELECT * FROM t WHERE l <> '')"""


@query(rf"""
WITH {_TEXT_LINES}, h AS (SELECT doc_id, l AS name FROM x WHERE k = 0 AND regexp_matches(l, '^\p{{Lu}}') AND len(string_split_regex(l, '\s+')) <= 5 AND NOT regexp_matches(l, '^(Avail|Body|Speed|Links):')),
m AS (SELECT x.doc_id, k, l, CASE WHEN regexp_matches(l, '^Avail:') THEN 'avail' WHEN regexp_matches(l, '^Body:') THEN 'body' WHEN regexp_matches(l, '^Speed:') THEN 'speed' END AS f FROM x JOIN h USING (doc_id) WHERE k > 0),
n AS (SELECT *, CASE WHEN f IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, f ORDER BY k) = 1 THEN f END AS label FROM m),
g AS (SELECT doc_id, max(CASE label WHEN 'avail' THEN trim(regexp_extract(l, '^Avail:\s*(.*)$', 1), ' ') END) AS avail, max(CASE label WHEN 'body' THEN trim(regexp_extract(l, '^Body:\s*(.*)$', 1), ' ') END) AS body,
  max(CASE label WHEN 'speed' THEN trim(regexp_extract(l, '^Speed:\s*(.*)$', 1), ' ') END) AS speed, string_agg(CASE WHEN label IS NULL THEN l END, chr(10) ORDER BY k) AS txt FROM n GROUP BY doc_id)
SELECT doc_id, name, nullif(avail, '') AS avail, nullif(body, '') AS body, nullif(speed, '') AS speed, CASE WHEN length(d) >= 30 THEN d END AS description
FROM (SELECT *, regexp_replace({JOINED.format("txt")}, ' \S*-$', '') AS d FROM g JOIN h USING (doc_id)) WHERE avail <> '' OR body <> '' OR speed <> ''""")
def read_entries(spark, sf_dir):
    """The reader of entries on whole documents: the first line is set large, so it is a name if it looks like one; values stand behind labels."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    lines = d.select("doc", F.lit(1).alias("page"), F.lit(0).alias("col"), "line_no", F.when(F.col("line_no") == 0, 13.0).otherwise(10.0).alias("size"), "text")
    labels = {k.lower(): rf"^{k}:\s*(.*)$" for k in ("Avail", "Body", "Speed")}
    reader = readers.Reader((12.4, 13.6), refused="^Links:", labels=labels, needed=(("avail", "body", "speed"),))
    e = readers.read_entries(lines, reader)
    return e.select(F.col("doc").alias("doc_id"), "name", *(F.try_element_at("fields", F.lit(k)).alias(k) for k in labels), "description")


@query(r"""
WITH i AS (SELECT row_id AS nk, book AS g, meta.page AS np, name AS n, system.subtype AS sub FROM item WHERE name IS NOT NULL),
l AS (SELECT DISTINCT correction_id AS lk, ref.book AS g, ref.page AS lp, string_split_regex(trim(ref.name, ' '), '\s+') AS ws, regexp_replace(lower(replace(trim(ref.name, ' '), 'ß', 'ss')), '[^a-z0-9]+', '', 'g') AS k0 FROM correction WHERE ref.name IS NOT NULL),
s AS (SELECT *, CASE WHEN len(ws) > 2 THEN regexp_replace(lower(replace(array_to_string(ws[len(ws) - 1:], ' '), 'ß', 'ss')), '[^a-z0-9]+', '', 'g') END AS k2,
  CASE WHEN len(ws) > 1 THEN regexp_replace(lower(replace(ws[len(ws)], 'ß', 'ss')), '[^a-z0-9]+', '', 'g') END AS k1 FROM l WHERE len(ws) <= 6 AND k0 <> ''),
b AS (SELECT *, regexp_replace(n, '\s*\(.*?\)$', '') AS bare FROM i), h AS (SELECT *, CASE WHEN contains(bare, '/') THEN regexp_replace(split_part(bare, '/', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END AS head FROM b),
v AS (SELECT *, unnest([n, bare, head, regexp_replace(head, '\s+\S+$', ''), CASE WHEN contains(bare, ',') THEN substr(bare, instr(bare, ',') + 1) || ' ' || split_part(bare, ',', 1) END, CASE WHEN contains(bare, ',') THEN split_part(bare, ',', 1) END]) AS f FROM h),
k AS (SELECT DISTINCT nk, g, np, n, unnest([k, CASE WHEN k LIKE '%s' THEN left(k, length(k) - 1) ELSE k || 's' END]) AS k FROM (SELECT *, regexp_replace(lower(replace(f, 'ß', 'ss')), '[^a-z0-9]+', '', 'g') AS k FROM v) WHERE k <> ''),
f AS (SELECT nk, g, np, n, unnest([k, CASE WHEN k LIKE '%s' THEN left(k, length(k) - 1) ELSE k || 's' END]) AS k FROM (SELECT *, regexp_replace(lower(replace(n, 'ß', 'ss')), '[^a-z0-9]+', '', 'g') AS k FROM i) WHERE k <> ''),
u AS (SELECT nk, g, np, n, unnest([k, CASE WHEN k LIKE '%s' THEN left(k, length(k) - 1) ELSE k || 's' END]) AS k FROM (SELECT *, regexp_replace(lower(replace(replace(sub, '_', ' '), 'ß', 'ss')), '[^a-z0-9]+', '', 'g') AS k FROM i WHERE sub <> '')),
d AS (SELECT DISTINCT g, k FROM k WHERE k <> ''),
c AS (SELECT s.lk, s.g, s.lp, CASE WHEN d0.k IS NOT NULL THEN k0 WHEN d2.k IS NOT NULL THEN k2 WHEN d1.k IS NOT NULL THEN k1 ELSE k0 END AS k FROM s
  LEFT JOIN d d0 ON d0.g = s.g AND d0.k = k0 LEFT JOIN d d2 ON d2.g = s.g AND d2.k = k2 LEFT JOIN d d1 ON d1.g = s.g AND d1.k = k1),
m AS (SELECT c.*, k.nk, k.np, k.n, 'name' AS kind FROM c JOIN k USING (g, k) UNION ALL SELECT c.*, f.nk, f.np, f.n, 'family' FROM c JOIN f ON f.g = c.g AND starts_with(f.k, c.k) AND f.k <> c.k WHERE length(c.k) >= 6),
t AS (SELECT DISTINCT c.lk, u.nk, 'subtype' AS kind FROM c JOIN u USING (g, k) WHERE c.lk NOT IN (SELECT lk FROM m) AND (lp IS NULL OR abs(lp - np) <= 8)),
w AS (SELECT * FROM m WHERE lp IS NULL OR abs(lp - np) <= 8),
j AS (SELECT w.lk FROM w LEFT JOIN (SELECT DISTINCT g, k, true AS whole FROM f) x USING (g, k) GROUP BY w.lk HAVING min(n) = max(n) OR bool_or(whole)
  OR min(regexp_replace(trim(lower(regexp_replace(n, '\s*\(.*?\)$', '')), ' '), '\s+\d+$', '')) = max(regexp_replace(trim(lower(regexp_replace(n, '\s*\(.*?\)$', '')), ' '), '\s+\d+$', '')))
SELECT lk AS correction_id, nk AS row_id, max(kind) AS kind FROM w JOIN j USING (lk) GROUP BY 1, 2 UNION ALL SELECT * FROM t""")
def heading_targets(spark, sf_dir):
    """The items that the name a correction cites may head, in the book it cites, near its page."""
    lines = table(spark, sf_dir, "correction").filter("ref.name is not null").select("correction_id", F.col("ref.book").alias("book"), F.col("ref.page").alias("page"), F.col("ref.name").alias("line")).distinct()
    names = table(spark, sf_dir, "item").select("row_id", "book", F.col("meta.page").alias("page"), "name", F.col("system.subtype").alias("subtype"))
    return headings.heading_targets(lines, "line", "correction_id", names, "name", "row_id", "book", "page", "subtype")
