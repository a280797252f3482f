"""Queries of the join operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import joins
from tessera.operators.kernels import connected_components, expand_nested, geometric_score, spatial_relation
from tessera.plans.registry import registry
from tessera.session import table

QUERIES, SQL, query = registry()


@query("""
SELECT p.event_id, p.user_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def as_of_section(spark, sf_dir):
    """The latest signup at or before each purchase of a user."""
    e = table(spark, sf_dir, "events")
    signups = e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    week = F.floor(F.unix_timestamp("ts") / (7 * 86400))
    return joins.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), signups, ["user_id"], "ts", ["signup_id"], week).select("event_id", "user_id", "signup_id")


@query("""
SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) BETWEEN datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) - 30 AND datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 60 GROUP BY ALL""")
def range_join_window(spark, sf_dir):
    """Line items shipped from 30 days before to 60 days after their order's date."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", day("o_orderdate").alias("ordered"))
    out = joins.range_join(li, o, ["o_orderkey"], "shipped", F.col("ordered") - 30, F.col("ordered") + 60, 91)
    return out.groupBy("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS key, r.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM q JOIN r ON q.vec_id <> r.vec_id)
SELECT key, arg_min(neighbour, d) AS neighbour, round(min(d), 4) AS distance FROM d GROUP BY key""")
def nearest_vector(spark, sf_dir):
    """The nearest other vector of every one whose id is divisible by 50, against all rows, in blocks."""
    e = table(spark, sf_dir, "embeddings")
    return joins.nearest_vectors(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding").withColumn("distance", F.round("distance", 4))


@query("""
WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2 HAVING count(*) = 1),
p AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT user_id, CAST(day AS VARCHAR) AS day, view_id, purchase_id FROM v JOIN p USING (user_id, day)""")
def unique_match(spark, sf_dir):
    """Days on which a user has exactly one view and exactly one purchase."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", "event_type")
    side = lambda kind, name: e.filter(F.col("event_type") == kind).select("user_id", "day", F.col("event_id").alias(name))
    return joins.unique_match(side("view", "view_id"), side("purchase", "purchase_id"), ["user_id", "day"])


@query("""
WITH n AS (SELECT DISTINCT c_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_nationkey = 3))
SELECT s.suffix, min(c_name) AS name FROM (SELECT DISTINCT right(s_name, 9) AS suffix FROM supplier) s JOIN n ON suffix(c_name, s.suffix) AND c_name <> s.suffix GROUP BY 1 HAVING count(*) = 1""")
def unique_suffix(spark, sf_dir):
    """Names that end in a supplier's number; the customers of one nation are claimed before."""
    tails = table(spark, sf_dir, "supplier").select(F.right("s_name", F.lit(9)).alias("suffix"))
    customers = table(spark, sf_dir, "customer")
    return joins.unique_suffix(customers, "c_name", tails, "suffix", 9, customers.filter("c_nationkey = 3").select(F.col("c_name").alias("name")))


@query("""
WITH s AS (SELECT right(s_name, 9) AS key, CAST(s_nationkey AS VARCHAR) AS nation, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 's' || s_suppkey % 5 END AS tag FROM supplier),
c AS (SELECT right(c_name, 9) AS key, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 's' || c_custkey % 5 END AS tag FROM customer WHERE c_custkey >= 5),
j AS (SELECT coalesce(s.key, c.key) AS key, s.key AS sk, c.key AS ck, nullif(s.nation, '') AS sn, nullif(c.nation, '') AS cn, nullif(s.tag, '') AS st, nullif(c.tag, '') AS ct FROM s FULL JOIN c ON s.key = c.key)
SELECT key, coalesce(sn, cn) AS nation, coalesce(ct, st) AS tag, CASE WHEN ck IS NULL THEN 'left' WHEN sk IS NULL THEN 'right' ELSE 'both' END AS source,
  concat_ws('; ', CASE WHEN sn <> cn THEN 'nation: left=' || sn || ' right=' || cn || ' -> left' END, CASE WHEN st <> ct THEN 'tag: left=' || st || ' right=' || ct || ' -> right' END) AS conflicts FROM j""")
def reconcile_full_outer(spark, sf_dir):
    """Two readings of entries keyed by the number in their name."""
    s = table(spark, sf_dir, "supplier").select(F.right("s_name", F.lit(9)).alias("key"), F.col("s_nationkey").cast("string").alias("nation"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("s"), (F.col("s_suppkey") % 5).cast("string"))).alias("tag"))
    c = table(spark, sf_dir, "customer").filter("c_custkey >= 5").select(F.right("c_name", F.lit(9)).alias("key"), F.col("c_nationkey").cast("string").alias("nation"), F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("c_custkey") % 5).cast("string"))).alias("tag"))
    out = joins.reconcile(s, c, "key", ["nation", "tag"], right_wins=["tag"])
    return out.withColumn("conflicts", F.array_join("conflicts", "; "))


@query("""
WITH b AS (SELECT DISTINCT row_id, nullif(id, '') AS id, nullif(name, '') AS name FROM item_copy)
SELECT coalesce(i.row_id, b.row_id) AS row_id, coalesce(nullif(i.id, ''), b.id) AS id, coalesce(nullif(i.name, ''), b.name) AS name, CASE WHEN b.row_id IS NULL THEN 'left' WHEN i.row_id IS NULL THEN 'right' ELSE 'both' END AS source
FROM (SELECT row_id, id, CASE WHEN row_id % 7 = 0 THEN '' ELSE name END AS name FROM item) i FULL JOIN b ON i.row_id = b.row_id""")
def authority_fold(spark, sf_dir):
    """Blanks of the authority filled, rows of both sides kept."""
    own = table(spark, sf_dir, "item").select("row_id", "id", F.when(F.col("row_id") % 7 == 0, "").otherwise(F.col("name")).alias("name"))
    return joins.authority_fold(own, table(spark, sf_dir, "item_copy").select("row_id", "id", "name").distinct(), "row_id", ["id", "name"])


@query("""
WITH c AS (SELECT DISTINCT correction_id, domain, category, id, lower(ref.name) AS name, ref.book AS book FROM correction),
i AS (SELECT row_id, domain, id, lower(name) AS name, book FROM item),
a AS (SELECT domain, id, min(row_id) AS t FROM i GROUP BY 1, 2 HAVING min(row_id) = max(row_id)), b AS (SELECT name, book, min(row_id) AS t FROM i GROUP BY 1, 2 HAVING min(row_id) = max(row_id)), n AS (SELECT name, min(row_id) AS t FROM i GROUP BY 1 HAVING min(row_id) = max(row_id))
SELECT correction_id, coalesce(a.t, b.t, n.t) AS target, CASE WHEN a.t IS NOT NULL THEN 1 WHEN b.t IS NOT NULL THEN 2 WHEN n.t IS NOT NULL THEN 3 END AS tier
FROM c LEFT JOIN a USING (domain, id) LEFT JOIN b ON c.name = b.name AND c.book = b.book LEFT JOIN n ON c.name = n.name""")
def cascade_resolve(spark, sf_dir):
    """By id in the stated domain, else by the only (name, book), else by the only name."""
    c = table(spark, sf_dir, "correction").select("correction_id", "domain", "category", "id", F.lower("ref.name").alias("name"), F.col("ref.book").alias("book")).distinct()
    i = table(spark, sf_dir, "item").select("row_id", "domain", "id", F.lower("name").alias("name"), "book")
    out = joins.cascade(c, [(i, ["domain", "id"], "row_id"), (i, ["name", "book"], "row_id"), (i, ["name"], "row_id")])
    return out.select("correction_id", "target", "tier")


@query("""
WITH c AS (SELECT DISTINCT correction_id, coalesce(moved_to.domain, domain) AS domain, CASE WHEN correction_id % 2 = 0 THEN (SELECT min(id) FROM item WHERE item.name = ref.name) ELSE id END AS id, ref.name AS name, ref.book AS book FROM correction),
i AS (SELECT row_id, domain, id, name, book FROM item),
a AS (SELECT domain, id, min(row_id) AS t FROM i WHERE id IS NOT NULL GROUP BY 1, 2), b AS (SELECT id, min(row_id) AS t FROM i WHERE id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT domain) = 1),
n AS (SELECT lower(trim(name, ' ')) AS name, book, min(row_id) AS t FROM i GROUP BY 1, 2 HAVING count(*) = 1)
SELECT correction_id, coalesce(a.t, b.t, n.t) AS target, CASE WHEN a.t IS NOT NULL THEN 1 WHEN b.t IS NOT NULL THEN 2 WHEN n.t IS NOT NULL THEN 3 END AS tier
FROM c LEFT JOIN a USING (domain, id) LEFT JOIN b USING (id) LEFT JOIN n ON lower(trim(c.name, ' ')) = n.name AND c.book = n.book""")
def correction_targets(spark, sf_dir):
    """The stated domain, else the only other one that holds the id, else name and book. Half of the corrections get an id of the library first, as their own are from
    before a re-keying."""
    i = table(spark, sf_dir, "item").select("row_id", "domain", "id", "name", "book")
    ids = i.groupBy("name").agg(F.min("id").alias("new_id"))
    c = table(spark, sf_dir, "correction").select("correction_id", F.coalesce("moved_to.domain", "domain").alias("domain"), "id", F.col("ref.name").alias("name"), F.col("ref.book").alias("book")).distinct()
    c = c.join(ids, "name", "left").withColumn("id", F.when(F.col("correction_id") % 2 == 0, F.col("new_id")).otherwise(F.col("id"))).drop("new_id")
    return joins.correction_targets(c, i, "row_id").select("correction_id", "target", "tier")


@query("""
WITH p AS (SELECT event_id, user_id, event_type, CAST(value AS DOUBLE) AS x, CAST(extract(hour FROM ts) * 10 + extract(minute FROM ts) / 6.0 AS DOUBLE) AS y FROM events WHERE value IS NOT NULL),
d AS (SELECT l.event_id, r.event_id AS other, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS d FROM p l JOIN p r ON l.user_id = r.user_id AND l.event_type = 'view' AND r.event_type <> 'view')
SELECT event_id, other, round(d, 6) AS distance FROM d WHERE d < 40 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, other) = 1""")
def nearest_in_reach(spark, sf_dir):
    """For each view of a user the nearest other event, in value and time of day, within 40."""
    y = F.hour("ts") * 10 + F.minute("ts") / F.lit(6.0)
    p = table(spark, sf_dir, "events").filter("value is not null").select("event_id", "user_id", "event_type", F.col("value").cast("double").alias("x"), y.cast("double").alias("y"))
    other = p.filter("event_type <> 'view'").withColumnRenamed("event_id", "other")
    out = joins.nearest_in_reach(p.filter("event_type = 'view'"), other, ["user_id"], "event_id", "other", "x", "y")
    return out.withColumn("distance", F.round("distance", 6))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_unshipped(spark, sf_dir):
    """J14, U4."""
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT row_id FROM item i WHERE EXISTS (SELECT 1 FROM correction c WHERE c.deleted AND c.domain = i.domain AND lower(c.ref.name) = lower(i.name))")
def semi_tombstones(spark, sf_dir):
    """Q4, U5, P17."""
    dead = table(spark, sf_dir, "correction").filter("deleted").select("domain", F.lower("ref.name").alias("n"))
    i = table(spark, sf_dir, "item").select("row_id", "domain", F.lower("name").alias("n"))
    return i.join(dead, ["domain", "n"], "left_semi").select("row_id")


@query("""
WITH n AS (SELECT DISTINCT name, string_split(name, ' ') AS w FROM item WHERE name IS NOT NULL), p AS (SELECT DISTINCT array_to_string(w[:k], ' ') AS name FROM (SELECT w, unnest(range(1, len(w))) AS k FROM n))
SELECT name FROM n WHERE name NOT IN (SELECT name FROM p)""")
def prefix_anti(spark, sf_dir):
    """J30."""
    return joins.prefix_anti(table(spark, sf_dir, "item").filter("name is not null"), "name")


@query("""
WITH b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM benchmark), p AS (SELECT DISTINCT p_name AS entry, unnest(string_split(p_name, ' ')) AS t FROM part),
r AS (SELECT DISTINCT title AS entry, unnest(regexp_extract_all(lower(title), '[a-z]+')) AS t FROM registry WHERE title IS NOT NULL), l AS (SELECT * FROM p UNION ALL SELECT * FROM r),
s AS (SELECT item_id AS key, entry, count(*) AS score FROM b JOIN l USING (t) GROUP BY 1, 2)
SELECT key, entry, score FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, length(entry), entry) = 1""")
def token_overlap_best(spark, sf_dir):
    """J25, J26."""
    words = F.col("words")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1).alias("words"))
    library = table(spark, sf_dir, "part").select(F.col("p_name").alias("entry"), F.split("p_name", " ").alias("words")).unionByName(
        table(spark, sf_dir, "registry").filter("title is not null").select(F.col("title").alias("entry"), F.regexp_extract_all(F.lower("title"), F.lit("([a-z]+)"), 1).alias("words"))
    )
    return joins.token_overlap(b, "item_id", words, library.distinct(), "entry", words, 1)


_SAID = "list_filter(list_distinct(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9]+')), lambda w: length(w) > 1 AND w NOT IN ({}))"
_STOP = ", ".join(f"'{w}'" for w in joins.TITLE_STOPWORDS)


@query(f"""
WITH b AS (SELECT slug, row_number() OVER (ORDER BY slug) AS o, {_SAID.format("title", _STOP)} AS tw, coalesce(nullif(regexp_replace(trim(replace(upper(cat), 'CAT', ''), ' '), '^0+', ''), ''), trim(replace(upper(cat), 'CAT', ''), ' ')) AS cat FROM registry),
f AS (SELECT doc_id, {_SAID.format("split_part(text, chr(10), 1)", _STOP)} AS meta, {_SAID.format("left(text, 300)", _STOP)} AS cover, {_SAID.format("text", _STOP)} AS body FROM documents),
g AS (SELECT doc_id, r.cat AS code, 3 AS w, 3 AS top FROM documents d JOIN registry r ON d.book = r.slug WHERE doc_id % 5 = 0 UNION ALL
  SELECT doc_id, n.cat, 1, 3 FROM documents d JOIN registry r ON d.book = r.slug JOIN registry n ON n.slug = coalesce(r.reprint_of, 'gridline_core') WHERE doc_id % 5 = 0 AND n.cat <> r.cat),
c AS (SELECT doc_id, slug, CASE WHEN w = top THEN 0.9 ELSE 0.25 END AS weight FROM (SELECT *, coalesce(nullif(regexp_replace(trim(replace(upper(code), 'CAT', ''), ' '), '^0+', ''), ''), trim(replace(upper(code), 'CAT', ''), ' ')) AS k FROM g)
  JOIN (SELECT cat, first(slug ORDER BY o) AS slug FROM b WHERE cat <> '' GROUP BY cat) x ON x.cat = k),
t AS (SELECT * FROM b WHERE len(tw) > 0),
m AS (SELECT doc_id, slug, o, list_has_all(meta, tw) AS in_meta, list_has_all(cover, tw) AS in_cover FROM f JOIN t ON list_has_all(body, tw)),
s AS (SELECT * FROM c UNION ALL SELECT doc_id, first(slug ORDER BY o), 0.6 FROM m WHERE in_meta GROUP BY doc_id UNION ALL SELECT doc_id, first(slug ORDER BY o), 0.35 FROM m WHERE in_cover GROUP BY doc_id),
a AS (SELECT * FROM s UNION ALL SELECT doc_id, min(slug), 0.45 FROM m WHERE doc_id NOT IN (SELECT doc_id FROM s) GROUP BY doc_id HAVING count(*) = 1)
SELECT doc_id, slug, CAST(round(least(1.0, sum(weight)), 2) AS DOUBLE) AS score FROM a GROUP BY doc_id, slug""")
def weighted_identify(spark, sf_dir):
    """Which book each document is: its code, a title in its first line, on its cover (the first 300 letters), or alone in its text."""
    reg = table(spark, sf_dir, "registry").withColumn("o", F.row_number().over(Window.orderBy("slug")))  # the fixed table of books
    d = table(spark, sf_dir, "documents")
    own = reg.select(F.col("slug").alias("book"), F.col("cat").alias("own"), F.coalesce("reprint_of", F.lit("gridline_core")).alias("of"))
    of = reg.select(F.col("slug").alias("of"), F.col("cat").alias("other"))
    codes = d.filter("doc_id % 5 = 0").select("doc_id", "book").join(own, "book").join(of, "of", "left")
    pairs = F.filter(F.array(F.struct(F.col("own").alias("k"), F.lit(3).alias("v")), F.struct(F.col("other").alias("k"), F.lit(1).alias("v"))), lambda e: e["k"].isNotNull() & ((e["v"] == 3) | (e["k"] != F.col("own"))))
    codes = codes.select("doc_id", F.map_from_entries(pairs).alias("codes"))
    signals = d.select("doc_id", F.split("text", "\n", 2)[0].alias("title"), F.left("text", F.lit(300)).alias("cover"), "text").join(codes, "doc_id", "left")
    return joins.identify(signals, "doc_id", reg, "slug", "o")


@query("""
SELECT DISTINCT book, CAST(unnest(range(greatest(1, meta.page - 1), meta.page + 2)) AS INTEGER) AS page FROM item WHERE contains(lower(name), 'helmet') AND meta.page IS NOT NULL""")
def signature_margin(spark, sf_dir):
    """Pages with a matching name and the pages around them."""
    hits = table(spark, sf_dir, "item").filter(F.lower("name").contains("helmet") & F.col("meta.page").isNotNull()).select("book", F.col("meta.page").alias("page"))
    return joins.margin_pages(hits, ["book"], "page")


@query()
def merge_across_books(spark, sf_dir):
    """Items in order of row_id against all before them of the same name; books that are reprints add nothing. An ordered fold, so it has no SQL."""
    again = table(spark, sf_dir, "registry").filter("reprint_of is not null").select(F.col("slug").alias("book"), F.lit(True).alias("reprint"))
    items = table(spark, sf_dir, "item").filter("name is not null").join(again, "book", "left")
    i = items.select("row_id", "reprint", text.norm_base(F.col("name")).alias("base"), F.col("system.price").alias("price"), F.col("system.avail").alias("avail"), F.col("system.type").alias("type"))
    return joins.merge_ordered(i, "base", "row_id", ["avail", "type"], ["price"], "reprint").select("row_id", "outcome", "matched")


@query("""
WITH c AS (SELECT row_id, s.book AS want, s.page AS page FROM (SELECT row_id, unnest(meta.sources) AS s FROM item) WHERE s.book IS NOT NULL AND s.page IS NOT NULL),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY page, want) = 1)
SELECT row_id, want, page, CASE WHEN row_number() OVER (PARTITION BY want ORDER BY page, row_id) = 1 THEN 'matched' ELSE 'duplicate' END AS outcome FROM b""")
def claim_once(spark, sf_dir):
    """Every item claims the book of its earliest source, each book goes to one of them."""
    c = table(spark, sf_dir, "item").select("row_id", F.explode("meta.sources").alias("s")).select("row_id", F.col("s.book").alias("want"), "s.page").filter("want is not null and page is not null")
    return joins.claim_once(c, "row_id", "want", [F.col("page")])


@query("""
WITH l AS (SELECT slug AS k, 1 AS rank, slug AS v FROM registry UNION ALL SELECT lower(title), 2, slug FROM registry UNION ALL SELECT replace(slug, '_', '-'), 3, slug FROM registry),
g AS (SELECT k, rank, min(v) AS lo, max(v) AS hi FROM l WHERE k IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY rank) = 1)
SELECT DISTINCT correction_id, lower(ref.book) AS book, CASE WHEN lo = hi THEN lo END AS found FROM correction LEFT JOIN g ON lower(ref.book) = k""")
def ranked_lookup(spark, sf_dir):
    """The book by slug, else by title, else by a dashed slug."""
    rows = table(spark, sf_dir, "correction").select("correction_id", F.lower("ref.book").alias("book")).distinct()
    tiers = {1: F.col("slug"), 2: F.lower("title"), 3: F.replace("slug", F.lit("_"), F.lit("-"))}
    return joins.ranked_lookup(rows, F.col("book"), table(spark, sf_dir, "registry"), tiers, "slug").select("correction_id", "book", "found")


@query("""
SELECT i.img, min(i.row_id) AS first_row, count(*) AS n FROM item i WHERE i.img IS NOT NULL AND i.img <> '' AND NOT EXISTS (SELECT 1 FROM item j WHERE j.img = i.img AND j.meta.qa_status = 'approved') GROUP BY 1""")
def missing_references(spark, sf_dir):
    """Pictures that no approved item uses, with the first row that names them."""
    i = table(spark, sf_dir, "item").filter("img <> ''").select("row_id", "img", "meta.qa_status")
    used = i.filter("qa_status = 'approved'").select("img").distinct()
    return i.join(used, "img", "left_anti").groupBy("img").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'r' || r_regionkey AS p, 'n' || n_nationkey AS c FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS member, 0 AS depth FROM region UNION ALL SELECT root, c, depth + 1 FROM t JOIN e ON p = member WHERE depth < 4)
SELECT DISTINCT root, member, depth FROM t WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM e WHERE p = member)""")
def recursive_pack(spark, sf_dir):
    """What regions contain in the end, over nations, down to suppliers."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("p"), name("n", "n_nationkey").alias("c")).unionByName(table(spark, sf_dir, "supplier").select(name("n", "s_nationkey").alias("p"), name("s", "s_suppkey").alias("c")))
    return expand_nested(table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("root")), "root", edges, "p", "c")


@query("""
WITH RECURSIVE i AS (SELECT row_id, domain, id, book, lower(name) AS name FROM item),
h AS (SELECT row_id, min(row_id) OVER (PARTITION BY domain, id) AS hub FROM i WHERE domain IS NOT NULL AND id IS NOT NULL UNION SELECT row_id, min(row_id) OVER (PARTITION BY book, name) FROM i WHERE book IS NOT NULL AND name IS NOT NULL),
e AS (SELECT row_id AS a, hub AS b FROM h UNION SELECT hub, row_id FROM h),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT node AS row_id, min(seen) AS component FROM r GROUP BY node""")
def entry_components(spark, sf_dir):
    """Items linked by a shared (domain, id) or a shared (book, name), as components."""
    i = table(spark, sf_dir, "item").select("row_id", "domain", "id", "book", F.lower("name").alias("name"))
    star = lambda *keys: i.filter(" and ".join(f"{k} is not null" for k in keys)).join(i.groupBy(*keys).agg(F.min("row_id").alias("hub")), list(keys)).select("row_id", "hub")
    return connected_components(star("domain", "id").unionByName(star("book", "name")), "row_id", "hub").select(F.col("node").alias("row_id"), "component")


@query("""
WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS lx, l_discount * 500 AS ly FROM lineitem GROUP BY ALL),
s AS (SELECT *, CASE WHEN lx + 5 BETWEEN 10 AND 40 AND ly + 1 BETWEEN 10 AND 30 THEN 'in' WHEN (least(40, lx + 10) - greatest(10, lx)) / greatest(1e-9, least(30, 10)) > 0.2 AND ly + 1 > 30 THEN 'below'
  WHEN (least(40, lx + 10) - greatest(10, lx)) / greatest(1e-9, least(30, 10)) > 0.2 AND ly + 1 < 10 THEN 'above' ELSE 'side' END AS relation FROM r)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ly, relation, round(greatest(-25.0, CASE relation WHEN 'in' THEN 60.0 WHEN 'below' THEN 60 - 0.3 * ly WHEN 'side' THEN 40 - 0.25 * ly ELSE 25 - 0.2 * ly END), 4) AS score FROM s""")
def geometric_scores(spark, sf_dir):
    """Boxes placed by quantity and discount against one picture."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("lx"), (F.col("l_discount") * 500).alias("ly")).distinct()
    lit = F.lit
    rel = spatial_relation((lit(10.0), lit(10.0), lit(40.0), lit(30.0)), (F.col("lx"), F.col("ly"), F.col("lx") + 10, F.col("ly") + 2))
    out = r.withColumn("relation", rel)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "ly", "relation", F.round(geometric_score(F.col("relation"), F.col("ly")), 4).alias("score"))
