"""Queries of the scalar functions and predicates on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ident, parse, predicates, text
from tessera.operators.sequence import lines_of, labelled_spans, only_known
from tessera.plans.registry import registry
from tessera.session import table

QUERIES, SQL, query = registry()


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "item")


@query(r"""
SELECT row_id, regexp_replace(lower(replace(name, 'ß', 'ss')), '[^a-z0-9]+', '', 'g') AS norm,
  regexp_replace(lower(replace(regexp_replace(name, '(?i)\s*\([^()]*variant[^()]*\)\s*$', ''), 'ß', 'ss')), '[^a-z0-9]+', '', 'g') AS base,
  trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
  coalesce(nullif(trim(regexp_replace(lower(regexp_replace(name, '[''’]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed') AS identity
FROM item""")
def text_keys(spark, sf_dir):
    """F3, F4, F5, F6."""
    n = F.col("name")
    return _items(spark, sf_dir).select("row_id", text.norm(n).alias("norm"), text.norm_base(n).alias("base"), text.slugify(n).alias("slug"), text.slugify_identity(n).alias("identity"))


_PLAIN = "translate(name, '{}', '{}')".format(text.TYPOGRAPHIC, text.PLAIN.replace("'", "''"))
for _ligature, _letters in text.LIGATURES.items():
    _PLAIN = f"replace({_PLAIN}, '{_ligature}', '{_letters}')"


@query(rf"""
WITH d AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN regexp_replace(name, '([^\n])', '\1\1', 'g') ELSE name END AS name FROM item),
t AS (SELECT row_id, replace({_PLAIN}, chr(173), '') AS t FROM d), p AS (SELECT *, regexp_extract_all(regexp_replace(t, '\s+', '', 'g'), '(?s)..') AS pairs FROM t)
SELECT row_id, CASE WHEN len(pairs) >= 3 AND 4 * len(list_filter(pairs, lambda x: left(x, 1) = right(x, 1))) >= 3 * len(pairs)
  THEN replace(regexp_replace(regexp_replace(t, '(\S)\S', '\1' || chr(1), 'g'), '([^\s\x01])(\s|$)', '\1\1\2', 'g'), chr(1), '') ELSE t END AS plain FROM p""")
def normalized_names(spark, sf_dir):
    """a third of the names has its glyphs doubled first."""
    doubled = F.when(F.col("row_id") % 3 == 0, F.regexp_replace("name", r"([^\n])", "$1$1")).otherwise(F.col("name"))
    return _items(spark, sf_dir).select("row_id", text.normalize_text(doubled).alias("plain"))


@query(r"""
WITH n AS (SELECT row_id, name, regexp_replace(name, '\s*\(.*?\)$', '') AS bare FROM item WHERE name IS NOT NULL),
h AS (SELECT *, CASE WHEN contains(bare, '/') THEN regexp_replace(split_part(bare, '/', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END AS head FROM n),
k AS (SELECT row_id, unnest([name, bare, head, regexp_replace(head, '\s+\S+$', ''), CASE WHEN contains(bare, ',') THEN substr(bare, instr(bare, ',') + 1) || ' ' || split_part(bare, ',', 1) END,
  CASE WHEN contains(bare, ',') THEN split_part(bare, ',', 1) END]) AS k FROM h),
m AS (SELECT row_id, regexp_replace(lower(replace(k, 'ß', 'ss')), '[^a-z0-9]+', '', 'g') AS k FROM k),
p AS (SELECT row_id, unnest([k, CASE WHEN k LIKE '%s' THEN left(k, length(k) - 1) ELSE k || 's' END]) AS k FROM m WHERE k <> '')
SELECT row_id, string_agg(DISTINCT k, '|' ORDER BY k) AS keys FROM p WHERE k <> '' GROUP BY row_id""")
def heading_keys(spark, sf_dir):
    """F7, F8."""
    rows = _items(spark, sf_dir).filter("name is not null").select("row_id", F.array_sort(text.heading_keys(F.col("name"))).alias("k"))
    return rows.filter(F.size("k") > 0).select("row_id", F.array_join("k", "|").alias("keys"))


@query(r"""
WITH n AS (SELECT row_id, name, contains(name, '/') AS two, regexp_replace(split_part(name, '/', 1), '[\s\p{Z}]+$', '') AS head, regexp_replace(substr(name, instr(name, '/') + 1), '^[\s\p{Z}]+', '') AS tail
  FROM (SELECT correction_id AS row_id, regexp_replace(ref.name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS name FROM correction)),
v AS (SELECT row_id, unnest([name, CASE WHEN two AND head <> '' AND tail <> '' THEN head || '/' || tail END, CASE WHEN two THEN head END, CASE WHEN two THEN tail END,
  CASE WHEN two AND tail <> '' AND regexp_matches(head, '\S\s+\S') THEN regexp_extract(head, '^(\S+)', 1) || ' ' || tail END]) AS v FROM n)
SELECT row_id, string_agg(DISTINCT v, '|' ORDER BY v) AS variants FROM v WHERE v <> '' GROUP BY row_id""")
def name_variants(spark, sf_dir):
    """F9."""
    rows = table(spark, sf_dir, "correction").select(F.col("correction_id").alias("row_id"), "ref.name").distinct()
    return rows.select("row_id", F.array_join(F.array_sort(text.name_variants(F.col("name"))), "|").alias("variants")).filter("variants <> ''")


#: SQL of lines joined to running text; {0} is the text.
JOINED = r"""regexp_replace(regexp_replace(replace(array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> ''), chr(10)), '-' || chr(10), ''),
  '[\s\p{{Z}}]+', ' ', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"""


@query("SELECT row_id, regexp_replace(" + JOINED.format("system.description") + r", ' \S*-$', '') AS running FROM item WHERE system.description IS NOT NULL")
def dehyphenated(spark, sf_dir):
    """F10."""
    return _items(spark, sf_dir).filter("system.description is not null").select("row_id", text.dehyphenate(F.split("system.description", "\n")).alias("running"))


@query(r"""
WITH p AS (SELECT DISTINCT correction_id, system.price AS p, system.avail AS a FROM correction),
f AS (SELECT *, coalesce(regexp_matches(p, '^\s*(?:Rating|Force|Capacity)'), false) AS formula, coalesce(trim(a, ' ') = 'Rating', false) AS rated, coalesce(regexp_matches(a, '^\s*Rating'), false) AS per FROM p)
SELECT correction_id,
  CASE WHEN formula THEN 0 ELSE coalesce(TRY_CAST(regexp_extract(regexp_replace(regexp_replace(p, '(\d)[ \x{A0}](\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g'), '(\d+)', 1) AS BIGINT), 0) END AS price,
  CASE WHEN formula THEN trim(p, ' ') END AS price_def, formula AS needs_rating,
  CASE WHEN rated THEN 0 ELSE coalesce(TRY_CAST(regexp_extract(a, '^\s*(\d+)', 1) AS INTEGER), 0) END AS avail,
  TRY_CAST(CASE WHEN per OR a IS NULL OR regexp_matches(a, '^\s*[-–—]?\s*$') THEN '0' ELSE trim(a, ' ') END AS DOUBLE) AS essence
FROM f""")
def parsed_prices(spark, sf_dir):
    """Free text to numbers, formulas kept as text."""
    rows = table(spark, sf_dir, "correction").select("correction_id", "system.price", "system.avail").distinct()
    c = rows.select("correction_id", parse.cost(F.col("price")).alias("c"), parse.availability(F.col("avail")).alias("a"), parse.essence(F.col("avail")).alias("e"))
    return c.select("correction_id", "c.price", "c.price_def", "c.needs_rating", F.col("a.avail").alias("avail"), F.col("e.essence").cast("double").alias("essence"))


@query(r"""
WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS f FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q AS dmg, f = 'R' AS stun, f = 'A' AS ss, f = 'N' AS fa, q AS ar1, 0 AS ar3, l_linenumber AS cap, CASE WHEN f = 'N' THEN 0 ELSE q END AS capacity, f = 'N' AS span, CASE WHEN f <> 'N' THEN q END AS rating,
  l_linenumber AS defense, CASE WHEN f = 'N' THEN NULL ELSE f END AS mount, CAST(q * 1000 AS BIGINT) AS price, l_linenumber AS price_capacity, l_linenumber AS seats, f AS seat_note, q AS onroad, q + 1 AS offroad,
  q AS value, f AS flag FROM r""")
def parsed_codes(spark, sf_dir):
    """F12-F15, F19-F25, F31, F36 on texts formatted from all lineitem rows."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("f"))
    # Texts recur, so each is parsed once.
    texts = r.select("q", "l_linenumber", "f").distinct()
    q, n, f = F.col("q").cast("string"), F.col("l_linenumber").cast("string"), F.col("f")
    columns = {key: parse.resolve_column(key)[1] for key in parse.COLUMNS}
    out = texts.select(
        "q", "l_linenumber", "f",
        columns["dv"](F.concat(q, F.when(f == "R", "S").otherwise("P"))).alias("d"), columns["modes"](F.when(f == "A", "SS/BF").when(f == "N", "sa,FA").otherwise("-")).alias("m"),
        columns["ar"](F.concat(q, F.lit("*/5/–"))).alias("ar"), columns["ammo"](F.concat(n, F.lit("(c)"))).alias("am"), columns["capacity"](F.when(f == "N", F.concat(q, F.lit("—"), (F.col("q") + 2).cast("string"))).otherwise(F.concat(F.lit("["), q, F.lit("]")))).alias("cap"),
        columns["ratingspan"](F.when(f == "N", F.concat(F.lit("1—"), q)).otherwise(q)).alias("rs"),
        columns["defense"](F.concat(F.lit("+"), n)).alias("defense"), columns["mount"](F.when(f == "N", "—").otherwise(F.concat(F.lit(" "), f))).alias("mount"),
        columns["pricecap"](F.concat(q, F.lit(",000¥("), n, F.lit(")"))).alias("pc"), columns["seat"](F.concat(n, F.lit("/"), f)).alias("s"),
        parse.KINDS["onoff"](F.concat(q, F.lit("/"), (F.col("q") + 1).cast("string"))).alias("oo"), parse.flags_of(F.concat(q, F.lit("P("), f, F.lit(")"))).alias("fl"),
    )
    return r.join(out, ["q", "l_linenumber", "f"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "d.dmg", "d.stun", "m.ss", "m.fa", F.col("ar")[0].alias("ar1"), F.col("ar")[2].alias("ar3"), "am.cap", "cap.capacity", F.col("cap.needs_rating").alias("span"), "rs.rating", "defense", "mount", "pc.price", F.col("pc.capacity").alias("price_capacity"), "s.seats", F.col("s.note").alias("seat_note"), F.col("oo.on").alias("onroad"), F.col("oo.off").alias("offroad"), "fl.value", F.col("fl.flags")[0].alias("flag"))


@query(r"""
SELECT p_partkey, p_size AS points, CASE WHEN p_size % 2 = 0 THEN lower(p_brand) END AS specialization, p_size AS walk, p_size * 2 AS run, 3 AS sprint,
  CAST(p_size AS DOUBLE) AS per_rating, CAST(p_size AS BIGINT) * 3 AS hooks, CAST(floor(7.0 / p_size) AS BIGINT) AS shared, CAST(-p_size AS DOUBLE) - 0.5 AS number, 1 AS known FROM part""")
def parsed_specs(spark, sf_dir):
    """skill lists, movement and rating formulas, the last of a repeated skill counts, unknown ones drop out."""
    size, brand = F.col("p_size").cast("string"), F.lower("p_brand")
    skills = F.concat(F.lit("Stealth 1, Juggling 9, stealth "), size, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ("), brand, F.lit(" +2)"))).otherwise(""))
    r = table(spark, sf_dir, "part").select(
        "p_partkey", parse.skill_map(skills, {"stealth": "stealth", "biotech": "bio"}).alias("m"), parse.movement(F.concat(size, F.lit("/"), (F.col("p_size") * 2).cast("string"), F.lit("/+3"))).alias("v"),
        parse.scaled_value(F.concat(F.lit("$RATING*"), size)).alias("s"), parse.hook_count(F.concat(F.lit("$RATING*"), size), F.lit(3)).alias("hooks"), parse.hook_count(F.concat(F.lit("$RATING/"), size), F.lit(7)).alias("shared"),
        parse.js_number(F.concat(F.lit("about -"), size, F.lit(".5 or so"))).alias("number"),
    )
    return r.select("p_partkey", F.col("m")["stealth"]["points"].alias("points"), F.col("m")["stealth"]["specialization"].alias("specialization"), "v.walk", "v.run", "v.sprint", "s.per_rating", "hooks", "shared", "number", F.size("m").alias("known"))


@query(r"""
SELECT row_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ('the', 'and')))), ' '), '') AS tokens,
  nullif(upper(replace(regexp_extract('Kind: ' || domain || ' ' || category || '; x', '(?i)\bkind:\s*([A-Za-z]+(?: [A-Za-z]+)?)', 1), ' ', '_')), '') AS stated,
  array_to_string(list_filter(list_transform(string_split_regex(name || ', 1,000 or ' || domain, ',\s|\bor\b'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS options,
  trim(regexp_replace(regexp_replace('p. 5 "' || name || ' and then some more words" - see there', '"[^"]{20,}"', '', 'g'), '\s[–—-]\s.*$', '', 'g')) AS citation,
  CASE WHEN name LIKE '%-' OR name LIKE '%/' THEN name || domain ELSE name || ' ' || domain END AS glued
FROM item WHERE name IS NOT NULL AND domain IS NOT NULL""")
def text_parts(spark, sf_dir):
    """F49, F52, F53, F56, F70."""
    n, d = F.col("name"), F.col("domain")
    return _items(spark, sf_dir).filter("name is not null and domain is not null").select(
        "row_id", F.array_join(F.array_sort(text.word_tokens(n, ["the", "and"])), " ").alias("tokens"), text.stated_label(F.concat(F.lit("Kind: "), d, F.lit(" "), F.col("category"), F.lit("; x")), "kind").alias("stated"),
        F.array_join(text.thousands_safe_split(F.concat(n, F.lit(", 1,000 or "), d)), "|").alias("options"), text.citation_only(F.concat(F.lit('p. 5 "'), n, F.lit(' and then some more words" - see there'))).alias("citation"), text.glue(n, d).alias("glued"),
    )


@query(r"""
SELECT row_id, '<img class="render" src="' || coalesce(img, 'none') || '">' || regexp_replace('<img class="render" src="old">' || system.description, '<img class="render"[^>]*>', '', 'g') AS rendered,
  concat_ws(chr(10), CASE WHEN trim(system.type, ' ') <> '' THEN 'Type: ' || system.type END, CASE WHEN trim(system.subtype, ' ') <> '' THEN 'Subtype: ' || system.subtype END, system.description) AS composed,
  CASE WHEN domain = 'gear' THEN 'equipment' ELSE regexp_replace(domain, 's$', '', 'g') END AS fixed
FROM item WHERE system.description IS NOT NULL AND domain IS NOT NULL""")
def composed_texts(spark, sf_dir):
    """F35, F40, F67."""
    body = F.col("system.description")
    return _items(spark, sf_dir).filter("system.description is not null and domain is not null").select(
        "row_id", text.render_tag(F.concat(F.lit('<img class="render" src="old">'), body), F.coalesce("img", F.lit("none"))).alias("rendered"),
        text.labelled([("Type", F.col("system.type")), ("Subtype", F.col("system.subtype"))], body).alias("composed"), text.fix_name(F.col("domain"), {"gear": "equipment"}, [("s$", "")]).alias("fixed"),
    )


@query(r"""
WITH b AS (SELECT doc_id, regexp_replace(text, '\{\{(?:[^{}]|\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\})*\}\}', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?s:<ref(?:\s[^>]*[^/>])?>.*?</ref>)|<[^>]+>|''''''?|__[A-Z]+__', '', 'g'), '\[\[(?:[^\]|]*\|)?([^\]]+)\]\]', '\1', 'g') AS plain FROM b),
l AS (SELECT doc_id, plain, unnest(list_transform(regexp_split_to_array(plain, '[\r\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))) AS line,
  generate_subscripts(regexp_split_to_array(plain, '[\r\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), 1) AS k FROM s)
SELECT s.doc_id, s.plain, left(regexp_replace(f.line, '[\s\p{Z}]+', ' ', 'g'), 1200) AS lead FROM s LEFT JOIN
  (SELECT doc_id, first(line ORDER BY k) AS line FROM l WHERE length(line) >= 60 AND NOT regexp_matches(line, '^[{|!=\[*#:;]|^(?i:file:|image:|category:|redirect)') GROUP BY doc_id) f ON f.doc_id = s.doc_id""")
def stripped_markup(spark, sf_dir):
    """F68, F69."""
    s = table(spark, sf_dir, "documents").select("doc_id", text.strip_markup(F.col("text")).alias("plain"))
    return s.select("doc_id", "plain", text.lead_prose(F.col("plain")).alias("lead"))


@query(r"""
SELECT row_id, array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
  CAST((instr('0123456789abcdef', substr(h, CAST(2 * i + 1 AS BIGINT), 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, CAST(2 * i + 2 AS BIGINT), 1)) - 1 AS BIGINT) % 62 + 1, 1)), '') AS doc_id,
  coalesce(nullif(trim(v, ' '), ''), id) AS catalog_id
FROM (SELECT row_id, id, meta.variant_of AS v, sha1(concat_ws('/', book, domain, id)) AS h FROM item)""")
def document_ids(spark, sf_dir):
    """F34, N8."""
    return _items(spark, sf_dir).select("row_id", ident.document_id(F.col("book"), F.col("domain"), F.col("id")).alias("doc_id"), ident.catalog_id(F.col("meta.variant_of"), F.col("id"), F.col("id")).alias("catalog_id"))


@query(r"""
WITH m AS (SELECT name, len(list_filter(string_split_regex(name, '\s+'), lambda t: (regexp_matches(t, '^[a-z]') AND t NOT IN ('of', 'the', 'and', 'de', 'von', 'for')) OR regexp_matches(t, '[a-z][A-Z]'))) > 0 AS mangled FROM item WHERE name IS NOT NULL),
g AS (SELECT mangled, length(name) >= 3 AND len(string_split_regex(trim(name, ' '), '\s+')) <= 8 AND regexp_matches(name, '^[A-Z0-9]') AND NOT regexp_matches(name, '[.:]')
    AND length(regexp_replace(name, '[^(]', '', 'g')) = length(regexp_replace(name, '[^)]', '', 'g')) AND length(regexp_replace(name, '[^A-Za-z]', '', 'g')) >= 3 AND NOT mangled AS valid,
  len(string_split_regex(trim(name, ' '), '\s+')) <= 8 AND NOT regexp_matches(name, '[.!?;¥$]|[-–—]\s*$') AS plausible FROM m)
SELECT mangled, valid, plausible, count(*) AS n FROM g GROUP BY ALL""")
def name_gate(spark, sf_dir):
    """P8, P9, P11."""
    n = F.col("name")
    return _items(spark, sf_dir).filter("name is not null").groupBy(predicates.mangled_name(n).alias("mangled"), predicates.valid_name(n).alias("valid"), predicates.plausible_row_name(n).alias("plausible")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
t AS (SELECT line, list_filter(string_split_regex(trim(line, ' '), '\s+'), lambda t: t <> '') AS ts FROM l),
s AS (SELECT line, ts, len(list_filter(ts, lambda t: regexp_matches(t, '\d'))) AS digits, len(list_filter(ts, lambda t: regexp_matches(t, '^[\d+\-–—/(\[]'))) AS stats FROM t)
SELECT trim(line, ' ') = '' OR regexp_matches(line, '[¥$€]') OR regexp_matches(line, '^[^a-z]*[A-Z][^a-z]*$') OR regexp_matches(line, '^\s*\d+\s*$') OR regexp_matches(line, '^[\s\d/+\-–—.,()]+$') OR regexp_matches(line, '\b\d+[dD]\d*\b') AS stat,
  CASE WHEN len(ts) <= 3 THEN true ELSE digits / len(ts) > 0.4 END AS stat_like, len(ts) <= 14 AND stats >= 4 AND stats * 2 >= len(ts) AS table_row, count(*) AS n FROM s GROUP BY ALL""")
def stat_lines(spark, sf_dir):
    """P12, P13, P14 on every line of every document."""
    lines, c = lines_of(table(spark, sf_dir, "documents"), "doc_id", "text"), F.col("line")
    return lines.groupBy(predicates.stat_line(c).alias("stat"), predicates.stat_like(c).alias("stat_like"), predicates.table_row(c).alias("table_row")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, reason, count(*) AS n FROM (SELECT *, unnest(list_filter([CASE WHEN NOT l_quantity BETWEEN 2 AND 45 THEN 'l_quantity' END,
  CASE WHEN NOT l_discount BETWEEN 0.01 AND 0.09 THEN 'l_discount' END, CASE WHEN NOT l_extendedprice BETWEEN 1000 AND 90000 THEN 'l_extendedprice' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY ALL""")
def range_plausibility(spark, sf_dir):
    """P10, P15."""
    bad = predicates.out_of_range({"l_quantity": (2, 45), "l_discount": (0.01, 0.09), "l_extendedprice": (1000, 90000)})
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").select(*keys, F.explode(bad).alias("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT row_id, (length(d) > 80 AND regexp_matches(d, '(?:[A-Za-z''’,;]+\s+){11}[A-Za-z''’]+')) IS TRUE AS prose, (starts_with(img, 'generic/') OR starts_with(img, 'iconsets/') OR contains(img, '/lib/')) IS TRUE AS placeholder,
  (system.type = 'ELECTRONICS' OR (system.type = 'ARMOR' AND system.subtype IN ('VEST', 'HELMET')) OR (system.type = 'TOOLS' AND system.subtype = 'WINCH')) IS TRUE AS compatible FROM (SELECT *, system.description AS d FROM item)""")
def item_predicates(spark, sf_dir):
    """P16, P19, P22."""
    table_ = {"ARMOR": ["VEST", "HELMET"], "TOOLS": ["WINCH"]}
    return _items(spark, sf_dir).select("row_id", predicates.prose_leak(F.col("system.description")).alias("prose"), predicates.placeholder_art(F.col("img")).alias("placeholder"), predicates.compatible(F.col("system.type"), F.col("system.subtype"), table_, ["ELECTRONICS"]).alias("compatible"))


@query("""
SELECT row_id, book, domain, category, coalesce(nullif(system.type, ''), 'UNTYPED') AS type FROM item WHERE NOT coalesce(meta.hidden, false) AND domain = 'gear' AND coalesce(nullif(system.type, ''), 'UNTYPED') = 'ARMOR' AND coalesce(system.subtype, '') = ''""")
def items_by_type(spark, sf_dir):
    """Pruned point selection with the blank bucket."""
    kind = F.coalesce(F.nullif("system.type", F.lit("")), F.lit("UNTYPED"))
    return _items(spark, sf_dir).filter(predicates.visible(F.col("meta.hidden")) & (F.col("domain") == "gear") & (kind == "ARMOR") & (F.coalesce("system.subtype", F.lit("")) == "")).select("row_id", "book", "domain", "category", kind.alias("type"))


@query("SELECT row_id, book, domain, category, name FROM item WHERE NOT coalesce(meta.hidden, false) AND contains(lower(name), 'lantern') ORDER BY book, domain, category, row_id LIMIT 60")
def name_search(spark, sf_dir):
    """The first 60 hits in tree order (a top-k feature)."""
    hits = _items(spark, sf_dir).filter(predicates.visible(F.col("meta.hidden")) & F.lower("name").contains("lantern"))
    return hits.select("row_id", "book", "domain", "category", "name").orderBy("book", "domain", "category", "row_id").limit(60)


@query("SELECT row_id, img FROM item WHERE len(list_filter(string_split_regex(lower(img), '[^a-z0-9]+'), lambda t: starts_with(t, 'lan'))) > 0 AND len(list_filter(string_split_regex(lower(img), '[^a-z0-9]+'), lambda t: starts_with(t, 'art'))) > 0")
def token_prefix_search(spark, sf_dir):
    """P5."""
    return _items(spark, sf_dir).filter(predicates.token_prefixes(F.col("img"), ["lan", "Art"])).select("row_id", "img")


@query("""
WITH i AS (SELECT row_id, name, count(*) OVER (PARTITION BY book, id) AS hits, list_filter([CASE WHEN coalesce(name, '') = '' THEN 'name' END, CASE WHEN coalesce(img, '') = '' THEN 'img' END, CASE WHEN coalesce(category, '') = '' THEN 'category' END], lambda x: x IS NOT NULL) AS missing, len(coalesce(meta.conflicts, [])) > 0 AS flagged FROM item)
SELECT row_id, array_to_string(missing, ',') AS missing, hits > 1 AS issue, flagged FROM i WHERE len(missing) > 0 OR hits > 1 OR flagged""")
def needs_attention(spark, sf_dir):
    """Rows with a missing required field, a duplicate id in their book, or a conflict."""
    item = _items(spark, sf_dir)
    rows = item.select("row_id", "book", "id", F.array_join(predicates.missing_required(item, ["name", "img", "category"]), ",").alias("missing"), (F.coalesce(F.size("meta.conflicts"), F.lit(0)) > 0).alias("flagged"))
    issues = rows.groupBy("book", "id").agg((F.count(F.lit(1)) > 1).alias("issue"))
    on = [rows["book"].eqNullSafe(issues["book"]), rows["id"].eqNullSafe(issues["id"])]
    return rows.join(issues, on).select("row_id", "missing", "issue", "flagged").filter("missing <> '' or issue or flagged")


@query("""
SELECT count(CASE WHEN coalesce(name, '') = '' THEN 1 END) AS empty_name, count(CASE WHEN len(coalesce(meta.conflicts, [])) = 0 THEN 1 END) AS empty_conflicts, count(CASE WHEN coalesce(system.price, 0) = 0 THEN 1 END) AS falsy_price,
  count(CASE WHEN NOT coalesce(meta.hidden, false) THEN 1 END) AS falsy_hidden, count(CASE WHEN coalesce(trim(system.description, ' '), '') = '' THEN 1 END) AS unfilled_description, count(CASE WHEN system.price IS NULL THEN 1 END) AS unfilled_price FROM item""")
def blank_kinds(spark, sf_dir):
    """three meanings of blank."""
    item = _items(spark, sf_dir)
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return item.agg(n(predicates.is_empty(item, "name"), "empty_name"), n(predicates.is_empty(item, "meta.conflicts"), "empty_conflicts"), n(predicates.is_falsy(item, "system.price"), "falsy_price"), n(predicates.is_falsy(item, "meta.hidden"), "falsy_hidden"), n(predicates.is_unfilled(item, "system.description"), "unfilled_description"), n(predicates.is_unfilled(item, "system.price"), "unfilled_price"))


@query(r"""
SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) || ' cm' AS size, CASE WHEN p_size % 2 = 0 THEN 'brass' END AS metal FROM part""")
def labelled_values(spark, sf_dir):
    """L38, L39."""
    said = F.concat(F.lit("x Size: "), F.col("p_size").cast("string"), F.lit(" cm Brand: "), F.col("p_brand"))
    spans = labelled_spans(said, ["Brand", "Size"])
    return table(spark, sf_dir, "part").select("p_partkey", spans["Brand"].alias("brand"), spans["Size"].alias("size"), only_known(F.when(F.col("p_size") % 2 == 0, "a Brass lamp").otherwise("brass and iron"), ["brass", "iron"]).alias("metal"))
