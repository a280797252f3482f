"""Queries of the aggregations and rankings on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import predicates, text
from tessera.operators import aggregates, ranking
from tessera.operators.kernels import demangle, demangle_names
from tessera.operators.ordered import numbered
from tessera.plans.registry import registry
from tessera.session import table

QUERIES, SQL, query = registry()


@query("""
SELECT coalesce(nullif(p_type, ''), 'UNTYPED') AS type, coalesce(nullif(p_brand, ''), '') AS subtype, count(*) AS n,
  count(CASE WHEN p_size <= 15 THEN 1 END) AS small, count(CASE WHEN p_size > 15 AND p_size <= 35 THEN 1 END) AS medium, count(CASE WHEN p_size > 35 THEN 1 END) AS large,
  CAST(grouping(coalesce(nullif(p_type, ''), 'UNTYPED'), coalesce(nullif(p_brand, ''), '')) AS BIGINT) AS level
FROM part GROUP BY ROLLUP (coalesce(nullif(p_type, ''), 'UNTYPED'), coalesce(nullif(p_brand, ''), ''))""")
def type_tree(spark, sf_dir):
    """Two-level roll-up of part by type and brand with conditional counts."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.coalesce(F.nullif("p_type", F.lit("")), F.lit("UNTYPED")).alias("type"), F.coalesce(F.nullif("p_brand", F.lit("")), F.lit("")).alias("subtype"), "p_size")
    counts = [F.count(F.when(size <= 15, 1)).alias("small"), F.count(F.when((size > 15) & (size <= 35), 1)).alias("medium"), F.count(F.when(size > 35, 1)).alias("large")]
    return rows.rollup("type", "subtype").agg(F.count(F.lit(1)).alias("n"), *counts, F.grouping_id().alias("level")).orderBy("type", "subtype", "level")


@query("""
SELECT book, domain, category, count(*) AS n, count(CASE WHEN meta.qa_status = 'extracted' THEN 1 END) AS extracted, count(CASE WHEN meta.qa_status = 'reviewed' THEN 1 END) AS reviewed,
  count(CASE WHEN meta.qa_status = 'approved' THEN 1 END) AS approved FROM item WHERE NOT coalesce(meta.hidden, false) GROUP BY ALL""")
def qa_rollup(spark, sf_dir):
    """Visible rows per file with the three counted states; other states only count in the total."""
    state = F.col("meta.qa_status")
    rows = table(spark, sf_dir, "item").filter(~F.coalesce(F.col("meta.hidden"), F.lit(False)))
    return rows.groupBy("book", "domain", "category").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(state == s, 1)).alias(s) for s in ("extracted", "reviewed", "approved"))).orderBy("book", "domain", "category")


@query("""
SELECT domain, coalesce(nullif(system.type, ''), 'UNTYPED') AS type, coalesce(system.subtype, '') AS subtype, count(*) AS n, coalesce(system.subtype, '') IN ('VEST', 'HELMET', 'LANTERN') AS in_vocabulary, arg_min(id, row_id) AS first_id FROM item GROUP BY 1, 2, 3""")
def vocab_map(spark, sf_dir):
    """A3."""
    sub = F.coalesce("system.subtype", F.lit("")).alias("subtype")
    g = table(spark, sf_dir, "item").groupBy("domain", F.coalesce(F.nullif("system.type", F.lit("")), F.lit("UNTYPED")).alias("type"), sub).agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "row_id").alias("first_id"))
    return g.withColumn("in_vocabulary", F.col("subtype").isin("VEST", "HELMET", "LANTERN"))


@query("SELECT domain, id, count(*) AS n, count(*) - 1 AS redundant FROM item GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    """A4."""
    return aggregates.duplicates(table(spark, sf_dir, "item"), ["domain", "id"])


@query("SELECT row_id, book, id, hit FROM (SELECT row_id, book, id, row_number() OVER (PARTITION BY book, id ORDER BY row_id) AS hit FROM item) WHERE hit > 1")
def repeated_ids(spark, sf_dir):
    """A5, K7: every hit of an id within its book after the first."""
    return aggregates.repeats(table(spark, sf_dir, "item").select("row_id", "book", "id"), ["book", "id"], ["row_id"])


@query(r"""
WITH f AS (SELECT raw_id, book, json_keys(payload) AS ks, payload FROM raw_item), u AS (SELECT DISTINCT book, unnest(ks) AS k FROM f UNION SELECT DISTINCT book, 'extra' FROM raw_item)
SELECT raw_id, string_agg(u.k || '=' || coalesce(json_extract_string(payload, '$."' || u.k || '"'), ''), '|' ORDER BY u.k) AS fields FROM f JOIN u ON f.book IS NOT DISTINCT FROM u.book GROUP BY raw_id""")
def field_union_fill(spark, sf_dir):
    """Every record of a book gets all fields its book knows."""
    rows = table(spark, sf_dir, "raw_item").select("raw_id", "book", F.from_json("payload", "map<string,string>").alias("fields"))
    out = aggregates.field_union_fill(rows, ["book"], "fields", ["extra"])
    pairs = F.transform(F.map_keys("fields"), lambda k: F.concat_ws("=", k, F.col("fields")[k]))
    return out.select("raw_id", F.array_join(pairs, "|").alias("fields"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1")
def unigram_vocab(spark, sf_dir):
    """Over all words of all documents."""
    return aggregates.word_counts(table(spark, sf_dir, "documents"), "text")


@query("""
WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_quantity, n FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f, l_quantity DESC) = 1""")
def mode_tie_break(spark, sf_dir):
    """A8, A9."""
    return aggregates.mode_first(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", F.col("l_orderkey"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), t AS (SELECT source, CAST(sum(n) AS BIGINT) AS votes, max(n) AS top FROM c GROUP BY 1)
SELECT t.source, votes, top, CASE WHEN top >= 3 AND top >= 2 * (votes - top) THEN min(lang) END AS winner FROM t JOIN c ON c.source = t.source AND n = top GROUP BY 1, 2, 3""")
def quorum_vote(spark, sf_dir):
    """A10: the language of a source if it is that of three documents and of twice as many as all others."""
    return aggregates.quorum(table(spark, sf_dir, "documents").filter("source is not null"), ["source"], "lang")


@query("""
WITH h AS (SELECT book, count(*) AS n, CAST(floor(count(CASE WHEN trim(system.description, ' ') <> '' THEN 1 END) * 1000 / count(*)) AS BIGINT) AS described, CAST(floor(count(CASE WHEN img <> '' THEN 1 END) * 1000 / count(*)) AS BIGINT) AS pictured FROM item GROUP BY 1),
f AS (SELECT book, count(*) AS n FROM item_copy GROUP BY 1)
SELECT h.book, h.n, described, pictured, coalesce(h.n >= 0.98 * f.n, true) AS ok, greatest(h.n, coalesce(f.n, h.n)) AS floor_n FROM h LEFT JOIN f USING (book)""")
def coverage_high_water(spark, sf_dir):
    """Coverage per mille, and the counts against a floor taken from the copy."""
    health = aggregates.coverage(table(spark, sf_dir, "item"), {"described": F.trim("system.description") != "", "pictured": F.col("img") != ""}, ["book"])
    floor = table(spark, sf_dir, "item_copy").groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    return health.join(aggregates.high_water(health.select("book", "n"), floor, ["book"], ["n"]).drop("n"), "book")


@query("""
SELECT field, count(*) AS n FROM (SELECT domain || '.' || unnest(list_filter([CASE WHEN system.price IS NOT NULL THEN 'price' END, CASE WHEN system.avail IS NOT NULL THEN 'avail' END, CASE WHEN system.type IS NOT NULL THEN 'type' END,
  CASE WHEN changed.name IS NOT NULL THEN 'name' END, CASE WHEN changed.qa_status IS NOT NULL THEN 'qa_status' END], lambda x: x IS NOT NULL)) AS field FROM correction) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
def top_fields(spark, sf_dir):
    """The twelve most corrected fields (a top-k report)."""
    names = {"price": "system.price", "avail": "system.avail", "type": "system.type", "name": "changed.name", "qa_status": "changed.qa_status"}
    fields = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in names.items())))
    rows = table(spark, sf_dir, "correction").select("domain", F.explode(fields).alias("f")).select(F.concat_ws(".", "domain", "f").alias("field"))
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field").limit(12)


@query("SELECT domain, category, length(d) AS length, row_id FROM (SELECT *, system.description AS d FROM item) WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain, category ORDER BY length(d) DESC, row_id) = 1")
def longest_text(spark, sf_dir):
    """A16."""
    i = table(spark, sf_dir, "item").select("row_id", "domain", "category", F.col("system.description").alias("d"))
    return aggregates.longest(i, ["domain", "category"], "d", "row_id")


@query("""
WITH w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(line), '[^a-z0-9]+'))) AS w, line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL))
SELECT w AS term, count(*) AS hits, count(DISTINCT doc_id) AS places FROM w WHERE w IN (SELECT DISTINCT lower(system.subtype) FROM item WHERE system.subtype IS NOT NULL) GROUP BY 1""")
def mention_counts(spark, sf_dir):
    """Lines and documents that mention each subtype."""
    lines = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    terms = table(spark, sf_dir, "item").select(F.col("system.subtype").alias("term")).filter("term is not null").distinct()
    return aggregates.mentions(lines, "line", ["doc_id"], terms, "term")


@query("""
WITH r AS (SELECT user_id, event_type AS t, least(1.0, abs(value) / 40) AS c FROM events WHERE value IS NOT NULL), b AS (SELECT user_id, max(c) AS c FROM r GROUP BY 1), w AS (SELECT r.user_id, b.c, max(t) AS t FROM r JOIN b ON r.user_id = b.user_id AND r.c = b.c GROUP BY 1, 2)
SELECT w.user_id, w.t, count(*) AS agree, round(least(1.0, w.c + 0.05 * (count(*) - 1)), 3) AS c FROM w JOIN r ON r.user_id = w.user_id AND r.t = w.t GROUP BY w.user_id, w.t, w.c""")
def reading_agreement(spark, sf_dir):
    """The most confident reading, raised by those that agree."""
    r = table(spark, sf_dir, "events").filter("value is not null").select("user_id", F.col("event_type").alias("t"), F.least(F.lit(1.0), F.abs("value") / 40).alias("c"))
    return aggregates.agreement(r, ["user_id"], "t", "c")


@query(r"""
WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, slug, CASE WHEN n > 1 THEN slug || '_' || n ELSE slug END AS new_id FROM n""")
def suffix_ids(spark, sf_dir):
    """K2, O7."""
    return ranking.suffixed_ids(table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.col("p_name")).alias("slug")), "slug", ["p_partkey"], bucket=F.floor(F.col("p_partkey") / 100_000))


@query()
def free_suffix_ids(spark, sf_dir):
    """Ids that avoid all ids of the library; probing in order, so it has no SQL (tested against brute force)."""
    rows = table(spark, sf_dir, "raw_item").select("raw_id", text.slugify(F.get_json_object("payload", "$.category")).alias("slug"))
    taken = table(spark, sf_dir, "raw_item").select(F.concat_ws("_", text.slugify(F.get_json_object("payload", "$.category")), F.get_json_object("payload", "$.page")).alias("id"))
    return ranking.free_ids(rows, "slug", ["raw_id"], taken, "id").select("raw_id", "new_id")


@query()
def better_text_fold(spark, sf_dir):
    """The rule is not transitive, an ordered fold, so it has no SQL (tested against brute force)."""
    i = table(spark, sf_dir, "item").select("id", "row_id", F.col("system.description").alias("d"), F.col("meta.extracted_at").alias("at")).filter("id is not null")
    return ranking.better_text_fold(i, "id", "row_id", "d", "at")


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_discount, l_tax) = 1""")
def survivor_rank(spark, sf_dir):
    """The first row of every part by a total order, combined map-side."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = ranking.first_per(li, ["l_partkey"], ["-l_quantity", "-l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_tax"])
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")


@query(r"""
SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'jewel' WHEN regexp_matches(p_name, 'bolt|nut|gear') THEN 'hardware' WHEN p_size > 40 THEN 'large' ELSE 'other' END AS kind,
  CASE WHEN p_type IN ('SMALL', 'ECONOMY') AND p_size <= 10 THEN 'compact' WHEN p_type = 'LARGE' THEN 'bulk' END AS signature FROM part""")
def rule_first_match(spark, sf_dir):
    """Rules as data, the first that holds counts."""
    n, size, kind = F.col("p_name"), F.col("p_size"), F.col("p_type")
    rules = [(n.contains("ring"), "jewel"), (n.rlike("bolt|nut|gear"), "hardware"), (size > 40, "large")]
    return table(spark, sf_dir, "part").select("p_partkey", ranking.first_match(rules, "other").alias("kind"), ranking.first_match([(kind.isin("SMALL", "ECONOMY") & (size <= 10), "compact"), (kind == "LARGE", "bulk")]).alias("signature"))


@query(r"""
WITH p AS (SELECT row_id, name, id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS wanted FROM item WHERE name IS NOT NULL AND id IS NOT NULL), d AS (SELECT * FROM p WHERE id <> wanted)
SELECT row_id, id, wanted, EXISTS (SELECT 1 FROM p x WHERE x.id = d.wanted) AS "exists", count(*) OVER (PARTITION BY wanted) > 1 AS contested FROM d""")
def rename_plan(spark, sf_dir):
    """O12."""
    rows = table(spark, sf_dir, "item").filter("name is not null and id is not null").select("row_id", "id", text.slugify(F.col("name")).alias("wanted"))
    return ranking.rename_plan(rows, "id", "wanted")


@query("""
WITH r AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS score, source FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL),
b AS (SELECT source, count(DISTINCT lang) AS k, max((score, lang)) AS m FROM r GROUP BY 1)
SELECT doc_id, r.source, lang, score - 22 * (k - 1) - CASE WHEN score = m[1] AND lang = m[2] THEN 0 ELSE 20 END AS score FROM r JOIN b ON r.source = b.source""")
def penalised_scores(spark, sf_dir):
    """O8."""
    r = table(spark, sf_dir, "documents").filter("source is not null and lang is not null and n_chars is not null").select("doc_id", "source", "lang", F.col("n_chars").cast("double").alias("score"))
    return ranking.penalised(r, "source", "lang", "score")


@query("""
WITH r AS (SELECT row_id, img, domain || '/' || id AS entry, lower(name) AS name, CASE WHEN meta.page % 3 = 0 THEN 'caption' ELSE 'heading' END AS kind, CAST(meta.page AS DOUBLE) AS score FROM item WHERE img <> '' AND domain IS NOT NULL AND id IS NOT NULL AND name IS NOT NULL AND meta.page IS NOT NULL),
p AS (SELECT img, bool_or(kind = 'caption') AS c FROM r GROUP BY img), k AS (SELECT r.* FROM r JOIN p USING (img) WHERE NOT c OR kind = 'caption'),
d AS (SELECT img, count(DISTINCT name) AS rivals FROM k GROUP BY img), s AS (SELECT k.* REPLACE (score - 22 * (rivals - 1) AS score), rivals FROM k JOIN d USING (img))
SELECT row_id, img, entry, rivals, score - CASE WHEN row_number() OVER (PARTITION BY entry ORDER BY score DESC, row_id) = 1 THEN 0 ELSE 20 END AS score FROM s""")
def resolved_pictures(spark, sf_dir):
    """Which entry a picture shows; every third page counts as a caption."""
    item = table(spark, sf_dir, "item").filter("img <> '' and domain is not null and id is not null and name is not null and meta.page is not null")
    kind = F.when(F.col("meta.page") % 3 == 0, "caption").otherwise("heading")
    r = item.select("row_id", "img", F.concat_ws("/", "domain", "id").alias("entry"), F.lower("name").alias("name"), kind.alias("kind"), F.col("meta.page").cast("double").alias("score"))
    return ranking.resolve_pictures(r, "img", "entry", "name", "kind", "score", "row_id").select("row_id", "img", "entry", "rivals", "score")


@query(r"""
SELECT row_id, name, row_number() OVER (PARTITION BY book ORDER BY array_to_string(list_transform(list_zip(string_split_regex(name, '\d+'), list_append(list_transform(regexp_extract_all(name, '\d+'), lambda d: lpad(ltrim(d, '0'), 12, '0')), '')), lambda p: p[1] || coalesce(p[2], '')), ''), row_id) AS place
FROM item WHERE name IS NOT NULL""")
def natural_order(spark, sf_dir):
    """Names in natural order within their book."""
    rows = table(spark, sf_dir, "item").filter("name is not null").select("row_id", "book", "name", ranking.natural_key(F.col("name")).alias("k"))
    return numbered(rows, ["book"], ["k", "row_id"], "place").select("row_id", "name", "place")


@query()
def word_segment(spark, sf_dir):
    """Benchmark texts without their blanks segmented again with the corpus vocabulary; tested on held-out accuracy."""
    vocabulary = aggregates.word_counts(table(spark, sf_dir, "documents"), "text")
    squeezed = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit(" "), F.lit("")).alias("text"))
    return demangle(squeezed, "item_id", "text", vocabulary)


@query()
def demangled_names(spark, sf_dir):
    """Names that look mangled (P9) mended with the words of names, descriptions and documents, all others as they are. Tested on the reference's cases."""
    i = table(spark, sf_dir, "item").filter("name is not null").select("row_id", "name", F.col("system.description").alias("text"))
    texts = i.select(F.col("name").alias("text")).unionByName(i.select("text")).unionByName(table(spark, sf_dir, "documents").select("text"))
    mangled = predicates.mangled_name(F.col("name"), ("of", "the", "and", "or", "a", "x", "de", "la", "von", "van", "el"))
    mended = demangle_names(i.filter(mangled), "row_id", "name", aggregates.word_counts(texts, "text"))
    return mended.unionByName(i.filter(~mangled).select("row_id", F.col("name").alias("text")))
