"""Queries of the ordered-data operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import sequence
from tessera.plans.registry import registry
from tessera.plans.text_queries import JOINED
from tessera.session import table

QUERIES, SQL, query = registry()


def _lines(spark, sf_dir):
    return sequence.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text").distinct(), "doc_id", "text")


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))"


@query("""
WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 21600 THEN 1 ELSE 0 END AS n FROM events)
SELECT event_id, user_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts) + 1 AS BIGINT) AS session FROM g""")
def gap_sessions(spark, sf_dir):
    """L2: sessions of a user, parted by gaps over six hours."""
    return sequence.gap_sessions(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", F.lit(21600.0)).select("event_id", "user_id", "session")


@query("""
WITH RECURSIVE o AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT event_id, user_id, t, r, t AS start, 1 AS g FROM o WHERE r = 1 UNION ALL
  SELECT o.event_id, o.user_id, o.t, o.r, CASE WHEN o.t - s.start > 43200 THEN o.t ELSE s.start END, CASE WHEN o.t - s.start > 43200 THEN s.g + 1 ELSE s.g END FROM s JOIN o ON o.user_id = s.user_id AND o.r = s.r + 1)
SELECT event_id, user_id, CAST(g AS BIGINT) AS "group" FROM s""")
def anchor_sessions(spark, sf_dir):
    """L1: groups that end twelve hours after their FIRST event."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return sequence.anchor_groups(e, ["user_id"], "ts", 43200.0, "event_id").select("event_id", "user_id", "group")


@query("""
WITH b AS (SELECT user_id, CASE WHEN abs(value / 3 - floor(value / 3) - 0.5) < 1e-12 THEN 2 * round(value / 6) ELSE round(value / 3) END AS line, event_id, event_type FROM events WHERE value IS NOT NULL)
SELECT user_id, CAST(line AS BIGINT) AS line, string_agg(event_type, ' ' ORDER BY event_id) AS text FROM b GROUP BY 1, 2""")
def bucket_lines(spark, sf_dir):
    """L3: events of one bucket of their value, rounded half to even, in order."""
    return sequence.bucket_lines(table(spark, sf_dir, "events").filter("value is not null"), ["user_id"], "value", "event_id", "event_type")


@query("""
WITH b AS (SELECT DISTINCT CAST(p_size * 1000 AS DOUBLE) AS s FROM part), o AS (SELECT list_sort(list(s)) AS bs FROM b), r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, greatest(len(list_filter(bs, lambda x: x - 1 <= l_extendedprice)) - 1, 0) AS band FROM r, o""")
def interval_bands(spark, sf_dir):
    """L4: the band of every price among fifty starts."""
    bands = table(spark, sf_dir, "part").select((F.col("p_size") * 1000).cast("double").alias("s")).distinct()
    return sequence.assign_bands(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_extendedprice", bands, "s")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS section FROM events""")
def forward_fill(spark, sf_dir):
    """L5, L10, L11, L20, L22."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("section"))
    return sequence.fill_forward(e, ["user_id"], ["ts"], ["section"]).drop("ts")


@query("""
SELECT event_id, user_id, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS prose FROM events""")
def backward_fill(spark, sf_dir):
    """Entries share the value of the next purchase."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("prose"))
    return sequence.fill_backward(e, ["user_id"], ["ts"], ["prose"]).drop("ts")


@query(f"""
WITH {_LINES}, m AS (SELECT *, max(CASE WHEN trim(line, ' ') = '' THEN line_no END) OVER w AS stop, max(CASE WHEN line LIKE '%:' THEN line_no END) OVER w AS anchor FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, anchor, line_no, line FROM m WHERE anchor IS NOT NULL AND line_no > anchor AND (stop IS NULL OR stop <= anchor) AND line_no - anchor <= 23""")
def bounded_capture(spark, sf_dir):
    """Up to 23 lines after a line that ends with a colon, up to a blank one."""
    return sequence.capture(_lines(spark, sf_dir), "doc_id", "line_no", F.col("line").endswith(":"), F.trim("line") == "", 23).select("doc_id", "anchor", "line_no", "line")


@query(rf"""
WITH {_LINES}, r AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+: ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS record FROM l)
SELECT doc_id, CAST(record AS BIGINT) AS record, string_agg(trim(line, ' '), ' ' ORDER BY line_no) AS text FROM r GROUP BY 1, 2""")
def wrapped_records(spark, sf_dir):
    """Lines that open no record are glued to the one before."""
    return sequence.merge_wrapped(_lines(spark, sf_dir), "doc_id", "line_no", "line", F.col("line").rlike("^[A-Z][a-z]+: "))


@query(rf"""
WITH {_LINES}, a AS (SELECT *, nullif(regexp_extract(line, '^([A-Z][A-Za-z ]{{0,30}}):', 1), '') AS label, regexp_matches(line, '^[a-z]') AS low FROM l),
b AS (SELECT *, sum(CASE WHEN label IS NOT NULL OR NOT low THEN 1 ELSE 0 END) OVER w AS part, sum(CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END) OVER w AS field_no FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, CAST(field_no AS BIGINT) AS field_no, max(label) AS label, string_agg(CASE WHEN label IS NOT NULL THEN trim(regexp_replace(line, '^[A-Z][A-Za-z ]{{0,30}}:', '')) ELSE trim(line, ' ') END, ' ' ORDER BY line_no) AS text
FROM b GROUP BY doc_id, part, field_no HAVING max(label) IS NOT NULL""")
def labelled_fields(spark, sf_dir):
    """Labelled fields with their small-letter continuations."""
    return sequence.labelled_fields(_lines(spark, sf_dir), "doc_id", "line_no", "line")


@query(r"""
WITH e AS (SELECT p_type, p_partkey, p_name, p_size FROM part) SELECT p_type, p_name AS title, arg_min(p_size, p_partkey) AS page FROM e GROUP BY 1, 2""")
def contents(spark, sf_dir):
    """Entries 'Title ..... 12', the first of a title wins."""
    lines = table(spark, sf_dir, "part").select("p_type", "p_partkey", F.concat("p_name", F.lit(" ..... "), F.col("p_size").cast("string")).alias("line"))
    return sequence.contents(lines, "p_type", "p_partkey", "line")


@query("""
WITH v AS (SELECT user_id, event_id AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS row_no FROM events WHERE event_type = 'view'), c AS (SELECT user_id, event_id AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS row_no FROM events WHERE event_type = 'click')
SELECT coalesce(v.user_id, c.user_id) AS user_id, coalesce(v.row_no, c.row_no) AS row_no, a, b FROM v FULL JOIN c ON v.user_id = c.user_id AND v.row_no = c.row_no""")
def zipped_halves(spark, sf_dir):
    """The n-th view and the n-th click of a user side by side."""
    e = table(spark, sf_dir, "events")
    half = lambda kind, name: e.filter(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    return sequence.zip_halves(half("view", "a"), half("click", "b"), ["user_id"], "ts")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, unnest(range(1, CAST(l_quantity AS BIGINT) + 1)) AS piece FROM lineitem""")
def qty_split(spark, sf_dir):
    """A row for each piece of a quantity."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("l_quantity").cast("bigint"))).alias("piece"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity * 5 * (l_quantity + 1) / 2 AS BIGINT) AS closed, CAST(l_quantity * 5 * (l_quantity + 1) / 2 AS BIGINT) AS summed, [10, 20, 30][CAST(least(greatest(l_quantity, 1), 3) AS INTEGER)] AS rated FROM lineitem""")
def triangular_cost(spark, sf_dir):
    """Rank costs in closed form and summed; a clamped lookup."""
    q = F.col("l_quantity").cast("int")
    summed = F.aggregate(F.sequence(F.lit(1), q), F.lit(0), lambda a, x: a + x * 5)
    rated = F.element_at(F.array(F.lit(10), F.lit(20), F.lit(30)), F.least(F.greatest(q, F.lit(1)), F.lit(3)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (q * 5 * (q + 1) / 2).cast("bigint").alias("closed"), summed.cast("bigint").alias("summed"), rated.alias("rated"))


_CLEAN = r"""
WITH d AS (SELECT doc_id, {joined} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, t, regexp_extract(t, '(?s)[^\p{{L}}\p{{N}}_]([A-Z].*)$', 1) AS c FROM d),
s AS (SELECT doc_id, CASE WHEN regexp_matches(t, '^\p{{Ll}}') AND c <> '' THEN c ELSE t END AS t FROM c),
h AS (SELECT doc_id, t, regexp_extract(left(t, 3500), '(?s)^(.+\.) ', 1) AS h FROM s),
b AS (SELECT doc_id, t AS whole, CASE WHEN length(t) > 3500 AND h <> '' THEN h ELSE t END AS block FROM h),
x AS (SELECT *, regexp_extract(whole || ' ', '(?s)^(.*[.!?]["''”’)]?)\s', 1) AS we, regexp_extract(block || ' ', '(?s)^(.*[.!?]["''”’)]?)\s', 1) AS be FROM b)
SELECT doc_id, CASE WHEN NOT regexp_matches(whole, '[.!?"''”’)]$') AND we <> '' THEN we ELSE whole END AS whole,
  CASE WHEN NOT regexp_matches(block, '[.!?"''”’)]$') AND be <> '' THEN be ELSE block END AS block FROM x""".format(joined=JOINED.format("text"))


@query(f"SELECT doc_id, block FROM ({_CLEAN})")
def clean_blocks(spark, sf_dir):
    """running text that starts and ends with a sentence, of at most 3,500 letters."""
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.clean_block(F.split("text", "\n")).alias("block"))


@query(_CLEAN)
def whole_clean_blocks(spark, sf_dir):
    """clean running text without a bound, and ended at the last sentence end within 3,500 letters."""
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.clean_block(lines, None).alias("whole"), text.clean_block(lines).alias("block"))
