"""Queries of the page readers, on pages set from every supplier, and of the sources that need no files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import readers
from tessera.plans.registry import registry
from tessera.session import table
from tessera.sources import library

QUERIES, SQL, query = registry()

PROSE = "The quiet lantern throws a wide and steady light over the harbor."


def _pages(spark: SparkSession, sf_dir: str, *lines: tuple) -> DataFrame:
    """One page for each supplier; a line is (size, text or column[, condition][, column of the page])."""
    rows = []
    for n, (size, text, *rest) in enumerate(lines):
        when = next((x for x in rest if isinstance(x, Column)), None)
        side = next((x for x in rest if isinstance(x, int)), 0)
        text = F.lit(text) if isinstance(text, str) else text
        rows.append(F.struct(F.lit(side).alias("col"), F.lit(n).alias("line_no"), F.lit(float(size)).alias("size"), (text if when is None else F.when(when, text)).alias("text"), F.lit("plain" if size < 12 else "display").alias("font")))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc"), F.lit(1).alias("page"), F.explode(F.array(*rows)).alias("l")).select("doc", "page", "l.*").filter("text is not null")


def _shown(e: DataFrame, *more: str) -> DataFrame:
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda x: F.concat_ws("=", x["key"], x["value"]))), "|")
    return e.select("doc", "name", fields.alias("fields"), "description", *more)


def _nation() -> Column:
    return F.col("s_nationkey").cast("string")


def _key(divisor: int) -> Column:
    return F.col("s_suppkey") % divisor


@query(f"""
SELECT 's' || s_suppkey AS doc, 'Bright Bolt' AS name, 'damage=' || s_nationkey || '|drain=' || s_suppkey % 9 || '|duration=S|range=LOS(A)|spellType=M' AS fields, '{PROSE}' AS description, CASE s_suppkey % 2 WHEN 0 THEN 'COMBAT' ELSE 'HEALTH' END AS category, true AS shared FROM supplier
UNION ALL SELECT 's' || s_suppkey, 'Dark Bolt', 'descriptor=Direct', '{PROSE}', CASE s_suppkey % 2 WHEN 0 THEN 'COMBAT' ELSE 'HEALTH' END, false FROM supplier""")
def page_spells(spark, sf_dir):
    """The section is set at the page's head; the prose stands behind the second spell."""
    heading = F.when(_key(2) == 0, "Combat Spells").otherwise("Health Spells")
    values = F.concat(F.lit("LOS (A) M S "), (F.col("s_suppkey") % 9).cast("string"), F.lit(" "), _nation())
    lines = _pages(spark, sf_dir, (16, heading), (13, "Bright Bolt"), (10, "RANGE TYPE DURATION DV"), (10, values), (13, "Dark Bolt", 1), (10, "(Direct)", 1), (10, PROSE, 1))
    return _shown(readers.read_spells(lines), "category", "shared")


def _plain(kind: str, sql: str, doc: str, lines: Callable[[], tuple]):
    def run(spark, sf_dir):
        return _shown(readers.read_entries(_pages(spark, sf_dir, *lines()), readers.READERS[kind]))

    run.__name__ = "page_" + kind.replace(" ", "_")
    run.__doc__ = doc
    return query(sql)(run)


_plain(
    "ritual", f"""
SELECT 's' || s_suppkey AS doc, 'Ward' AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'keywords=Anchored|' ELSE '' END || 'threshold=' || s_nationkey AS fields, 'Threshold: 99 {PROSE}' AS description FROM supplier WHERE s_suppkey % 2 = 0
""", "L30: the first threshold counts; without one, or keywords, there is no entry.",
    lambda: ((15, "Rituals"), (13, "Ward"), (10, "(Anchored)", (_key(3) == 0) & (_key(2) == 0)), (10, F.concat(F.lit("Threshold: "), _nation()), _key(2) == 0), (10, "Threshold: 99", _key(2) == 0), (10, PROSE),),
)
_plain(
    "adept power", f"SELECT 's' || s_suppkey AS doc, 'Iron Lungs' AS name, 'activation=Minor Action|cost=' || s_nationkey || ' PP' AS fields, '{PROSE}' AS description FROM supplier",
    "L31: the number behind an activation is dropped; a heading without cost or activation is no power.",
    lambda: ((13, "Iron Lungs"), (10, F.concat(F.lit("Cost: "), _nation(), F.lit(" PP"))), (10, "Activation: Minor Action 12"), (10, PROSE), (13, "Plain Heading"), (10, PROSE),),
)
_plain(
    "quality", f"SELECT 's' || s_suppkey AS doc, 'Quick Eye' AS name, 'cost=' || s_nationkey || '|effect=Tests are easy.' AS fields, '{PROSE}' AS description FROM supplier WHERE s_suppkey % 3 > 0",
    "L32: the phases description, cost, effect; without a cost there is no entry.",
    lambda: ((15, "Positive Qualities"), (13, "Quick Eye"), (10, PROSE), (10, F.concat(F.lit("Cost: "), _nation()), _key(3) > 0), (10, "dropped", _key(3) > 0), (10, "Game Effect: Tests are"), (10, "easy."),),
)
_plain(
    "lifestyle", f"SELECT 's' || s_suppkey AS doc, CASE s_suppkey % 2 WHEN 0 THEN 'Low' ELSE 'High' END AS name, 'cost=' || s_nationkey || '¥' AS fields, '{PROSE}' AS description FROM supplier WHERE s_suppkey % 3 > 0",
    "L34: only the known names are entries.", lambda: ((15, F.when(_key(3) == 0, "Castle").when(_key(2) == 0, "Low").otherwise("High")), (10, F.concat(F.lit("Cost: "), _nation(), F.lit("¥"))), (10, PROSE),),
)
_plain(
    "toxin or drug", f"SELECT 's' || s_suppkey AS doc, 'Night Dust' AS name, 'effect=Sleep|vector=Inhalation, Contact' AS fields, '{PROSE}' AS description FROM supplier WHERE s_suppkey % 4 > 0",
    "L35: lines continue the open field up to the effect; without a vector there is no entry.",
    lambda: ((13, "Night Dust"), (10, "Vector: Inhalation,", _key(4) > 0), (10, "Contact", _key(4) > 0), (10, "Effect: Sleep"), (10, PROSE),),
)
_plain(
    "contact", f"SELECT 's' || s_suppkey AS doc, 'Dock Clerk' AS name, 'connection=3|loyalty=' || s_nationkey AS fields, '{PROSE}' AS description FROM supplier",
    "L41: the last loyalty counts.", lambda: ((13, "Dock Clerk"), (10, PROSE), (10, "Connection Rating: 3, Loyalty 9"), (10, F.concat(F.lit("Loyalty: "), _nation())), (13, "Nobody Here"),),
)
_plain(
    "martial style", f"SELECT 's' || s_suppkey AS doc, 'Crane Style' AS name, 'techniques=Sweep ' || s_nationkey || ', and throw' AS fields, '{PROSE}' AS description FROM supplier WHERE s_suppkey % 2 = 0",
    "L42: a style needs its list of techniques.", lambda: ((13, "Crane Style"), (10, F.concat(F.lit("Techniques: Sweep "), _nation(), F.lit(",")), _key(2) == 0), (10, "and throw", _key(2) == 0), (10, PROSE),),
)
_plain(
    "martial technique", f"SELECT 's' || s_suppkey AS doc, 'Low Sweep' AS name, '' AS fields, '{PROSE}' AS description FROM supplier WHERE s_suppkey % 5 > 0",
    "L43: a heading in the display font with prose; the first of a name counts.", lambda: ((13, "Low Sweep", _key(5) > 0), (10, PROSE), (13, "Any Attack"), (10, PROSE + " More of it."), (13, "low sweep"), (13, "Low Sweep", _key(5) > 0), (10, "Another text that is long enough to be one."),),
)


@query(f"SELECT 's' || s_suppkey AS doc, 'Stealth' AS name, 'specializations=Hiding ' || s_nationkey AS fields, '{PROSE}' AS description, 'Agility' AS attribute FROM supplier WHERE s_suppkey % 3 > 0")
def page_skills(spark, sf_dir):
    """The attribute comes from the table of skills."""
    return _shown(readers.read_skills(_pages(spark, sf_dir, (15, "Stealth"), (10, F.concat(F.lit("Specializations: Hiding "), _nation()), _key(3) > 0), (10, PROSE))), "attribute")


@query(f"SELECT 's' || s_suppkey AS doc, 'Spirits of Salt' AS name, 'powers=Guard, hide' AS fields, '{PROSE}' AS description, 'F+' || s_nationkey AS bod, 'F' AS ess, 10 AS n FROM supplier WHERE s_suppkey % 2 = 0")
def page_spirits(spark, sf_dir):
    """Ten formulas behind the header, zipped to their keys."""
    values = F.concat(F.lit("F+"), _nation(), F.lit(" F F F F F F F F F"))
    e = readers.read_entries(_pages(spark, sf_dir, (12, "Spirits of Salt"), (10, "B A R S W L I C M ESS", _key(2) == 0), (10, values, _key(2) == 0), (10, "Powers: Guard,"), (10, "hide"), (10, PROSE)), readers.READERS["spirit"])
    return _shown(e.withColumns({"bod": F.try_element_at("attributes", F.lit("bod")), "ess": F.try_element_at("attributes", F.lit("ess")), "n": F.size("attributes")}), "bod", "ess", "n")


@query(f"SELECT 's' || s_suppkey AS doc, 'Marsh Hound' AS name, 'movement=10/20|powers=Scent' AS fields, '{PROSE}' AS description, CAST(s_nationkey AS VARCHAR) AS bod, CASE WHEN s_suppkey % 2 = 0 THEN '5' END AS mag, '6.0' AS ess FROM supplier WHERE s_suppkey % 3 > 0")
def page_critters(spark, sf_dir):
    """Magic is there if the header has it; attributes and powers are needed."""
    header = F.when(_key(2) == 0, "B A R S W L I C M ESS").otherwise("B A R S W L I C ESS")
    values = F.concat(_nation(), F.lit(" 4 4 5 3 2 4 2 "), F.when(_key(2) == 0, "5 6.0").otherwise("6.0"))
    e = readers.read_entries(_pages(spark, sf_dir, (13, "Marsh Hound"), (10, header), (10, values), (10, "Powers: Scent", _key(3) > 0), (10, "Movement: 10/20"), (10, PROSE)), readers.READERS["critter"])
    return _shown(e.withColumns({k: F.try_element_at("attributes", F.lit(k)) for k in ("bod", "mag", "ess")}), "bod", "mag", "ess")


@query(f"SELECT 's' || s_suppkey AS doc, 'Echo Shield' AS name, 'duration=sustained|fading=-' || s_nationkey AS fields, '{PROSE}' AS description FROM supplier WHERE s_suppkey % 3 > 0")
def page_complex_forms(spark, sf_dir):
    """Exactly the line behind the header has the values."""
    values = F.when(_key(3) == 0, F.lit("none")).otherwise(F.concat(F.lit("–"), _nation(), F.lit(" S")))
    return _shown(readers.read_complex_forms(_pages(spark, sf_dir, (13, "Echo Shield (minor)"), (10, "FADE VALUE DURATION"), (10, values), (10, PROSE))))


@query(f"SELECT 's' || s_suppkey AS doc, 'Gift of' AS name, 'action=Major|duration=Sustained|range=LOS (A)|type=' || CASE s_suppkey % 2 WHEN 0 THEN 'physical' ELSE 'mana' END AS fields, '{PROSE}' AS description FROM supplier WHERE s_suppkey % 3 > 0")
def page_critter_powers(spark, sf_dir):
    """A dangling small word is cut off the name; without a type there is no entry."""
    values = F.concat(F.when(_key(2) == 0, "P").otherwise("M"), F.lit(" Major LOS (A) Sustained"))
    return _shown(readers.read_critter_powers(_pages(spark, sf_dir, (13, "Gift of the"), (10, "TYPE ACTION RANGE DURATION", _key(3) > 0), (10, values), (10, PROSE))))


@query(f"""
SELECT 's' || s_suppkey AS doc, 'Harbor Guard' AS name, 'gear=Lamp ' || s_nationkey || ', rope' || CASE WHEN s_suppkey % 2 = 0 THEN '|metatype=Ork' ELSE '' END AS fields, '{PROSE}' AS description, CAST(s_nationkey AS VARCHAR) AS bod, '5.8' AS ess, 10 AS n FROM supplier""")
def page_person_blocks(spark, sf_dir):
    """A block begins at the metatype, or at the attribute header where there is none; the last title before it is the name."""
    lines = _pages(
        spark, sf_dir, (10, "Another Title"), (10, "a line in lower case"), (10, "Harbor Guard"), (10, "Metatype: Ork (male)", _key(2) == 0), (10, "B A R S W L I C EDG ESS"),
        (10, F.concat(_nation(), F.lit("(9) 3 3 4 2 2 3 2 1 5.8"))), (10, F.concat(F.lit("Gear: Lamp "), _nation(), F.lit(","))), (10, "rope"), (10, PROSE),
    )
    e = readers.read_blocks(lines, {"gear": "Gear:"})
    return _shown(e.withColumns({"bod": F.try_element_at("attributes", F.lit("bod")), "ess": F.try_element_at("attributes", F.lit("ess")), "n": F.size("attributes")}), "bod", "ess", "n")


@query(f"SELECT 's' || s_suppkey AS doc, 'Mara Voss' AS name, 'Gear=Lamp|Metatype=Human ' || s_nationkey AS fields, '{PROSE}' AS description FROM supplier WHERE s_suppkey % 3 > 0")
def page_actors(spark, sf_dir):
    """The largest text of a page is the name if the page speaks of a metatype."""
    lines = _pages(spark, sf_dir, (20, "Mara"), (20, "Voss"), (10, PROSE), (10, F.concat(F.lit("Metatype: Human "), _nation()), _key(3) > 0), (10, "Gear: Lamp"))
    return _shown(readers.read_actors(lines, ["Gear"]))


@query("""
WITH l AS (SELECT regexp_replace(id, '[^A-Za-z0-9_-]', '', 'g') AS id, row_id, name, meta.page AS page FROM item WHERE name IS NOT NULL AND name NOT LIKE '%' || chr(10) || '%' AND name NOT LIKE '%' || chr(13) || '%' AND id IS NOT NULL),
k AS (SELECT * FROM l WHERE id <> '' AND trim(regexp_replace(name, '^\\s+|\\s+$', '', 'g'), ' ') <> '')
SELECT id, regexp_replace(first(name ORDER BY row_id), '^\\s+|\\s+$', '', 'g') AS name, CAST(last(page ORDER BY row_id) FILTER (page IS NOT NULL) AS VARCHAR) AS page FROM k GROUP BY id""")
def property_rows(spark, sf_dir):
    """S12: 'item.id = name' and 'item.id.page = n' lines of every item; the first name and the last page count."""
    i = table(spark, sf_dir, "item").filter(r"name is not null and id is not null and not name rlike '[\r\n]'").withColumn("k", F.regexp_replace("id", "[^A-Za-z0-9_-]", "")).filter(r"k <> '' and regexp_replace(name, '^\\s+|\\s+$', '') <> ''")
    name = F.struct((F.col("row_id") * 2).alias("n"), F.concat(F.lit("item."), "k", F.lit(" = "), "name").alias("line"))
    page = F.struct((F.col("row_id") * 2 + 1).alias("n"), F.concat(F.lit("item."), "k", F.lit(".page = "), F.col("meta.page").cast("string")).alias("line"))
    lines = i.select(F.explode(F.array(name, page)).alias("l")).select("l.*").filter("line is not null")
    return library.properties(lines, "line", "n").select("id", "name", F.try_element_at("fields", F.lit("page")).alias("page"))


@query("""
SELECT 'u' || p_size AS uuid, first(CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type ELSE 'TEXT' END ORDER BY lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS kind FROM part GROUP BY 1""")
def choice_kinds(spark, sf_dir):
    """the first definition of each choice, over one XML text per part."""
    rest = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(' ref="'), "p_brand", F.lit('" type="x"'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(' type="'), "p_type", F.lit('"'))).otherwise("")
    text = F.concat(F.lit('<a><choice uuid="u'), F.col("p_size").cast("string"), F.lit('"'), rest, F.lit("/></a>"))
    members = table(spark, sf_dir, "part").select(F.lit("a").alias("archive"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("member"), text.alias("text"))
    return library.choice_kinds(members, "archive", "member", "text")


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, p_brand AS name, p_size AS size FROM part")
def xml_rows(spark, sf_dir):
    """Attributes and elements of one XML text per part."""
    text = F.concat(F.lit('<part id="'), F.col("p_partkey").cast("string"), F.lit('"><name>'), "p_brand", F.lit("</name><size>"), F.col("p_size").cast("string"), F.lit("</size></part>"))
    rows = library.xml_records(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text", "_id string, name string, size int")
    return rows.select("p_partkey", F.col("record._id").alias("id"), "record.name", "record.size")


@query("SELECT row_id FROM item i WHERE NOT EXISTS (SELECT 1 FROM item_copy c WHERE c.name = i.name AND c.system.price = i.system.price AND c.system.avail = i.system.avail)")
def stale_files(spark, sf_dir):
    """What the cache does not hold with the same name and two marks."""
    view = lambda name: table(spark, sf_dir, name).select("row_id", F.col("name").alias("path"), F.col("system.price").alias("length"), F.col("system.avail").alias("modified"))
    return library.stale(view("item"), view("item_copy").drop("row_id")).select("row_id")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' END AS kind FROM part")
def picture_kinds(spark, sf_dir):
    """pictures by their first bytes."""
    heads = {0: "89504E470D0A1A0A", 1: "FFD8FFE0", 2: "474946383961", 3: "524946460000000057454250"}
    content = F.lit(b"plain text")
    for k, h in heads.items():
        content = F.when(F.col("p_partkey") % 5 == k, F.concat(F.unhex(F.lit(h)), F.col("p_name").cast("binary"))).otherwise(content)
    return table(spark, sf_dir, "part").select("p_partkey", library.sniff(content).alias("kind"))


@query("""
SELECT 's' || s_suppkey AS doc, 'Hill Cat ' || s_nationkey AS name, CASE s_suppkey % 2 WHEN 0 THEN 'BIKE' ELSE 'CAR' END AS section, '1 2 3 4 5 6 7 8 ' || s_nationkey || '  ' AS stats FROM supplier WHERE s_suppkey % 3 > 0""")
def page_ruled_rows(spark, sf_dir):
    """A header row opens the section; rows with too few numbers are none; cells are padded."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("12 Hill Cat "), _nation())
    numbers = [F.lit(str(i)) for i in range(1, 9)]
    header = F.array(F.when(_key(2) == 0, "Bikes").otherwise("Cars"), F.lit("HAND"))
    row = F.when(_key(3) > 0, F.array(name, *numbers, _nation())).otherwise(F.array(name, *numbers[:5]))
    rows = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc"), F.lit(1).alias("page"), F.posexplode(F.array(F.array(F.lit("Early"), *numbers), header, row)).alias("row_no", "cells"))
    out = readers.ruled_rows(rows, {"BIKES": "BIKE", "CARS": "CAR"})
    return out.select("doc", "name", "section", F.array_join("stats", " ").alias("stats"))


@query("""
SELECT 's' || s_suppkey AS doc, 'Harbor Cat' AS name, CASE s_suppkey % 2 WHEN 0 THEN 'heavy bike' ELSE 'patrol boat' END AS subtype, CAST(s_nationkey AS VARCHAR) AS second FROM supplier WHERE s_suppkey % 3 > 0""")
def page_spread_rows(spark, sf_dir):
    """The label is in one line or in two above the header, the row at most three lines below it."""
    row = F.concat(F.lit("4/3 "), _nation(), F.lit(" 20 30 4 5 6 7 2 3 12,000¥"))
    lines = _pages(
        spark, sf_dir, (10, "Harbor Cat (Heavy Bike)", _key(2) == 0), (10, "Harbor Cat", _key(2) == 1), (10, "(patrol boat)", _key(2) == 1), (10, "HAND ACC BODY ARM"), (10, "a line"), (10, "another", _key(3) == 0), (10, "a third", _key(3) == 0), (10, row),
    )
    out = readers.spread_rows(lines, F.col("text").startswith("HAND ACC"), r"^\d+/\d+(?:\s+[\d,]+¥?){8,}")
    return out.select("doc", "name", "subtype", F.get("stats", 1).alias("second"))


@query("""
SELECT 's' || s_suppkey AS doc, 'Office Manager' AS name, 'Long days ' || s_nationkey AS description, 'Choose one=+1 to Logic|=+2 to Edge' AS grants FROM supplier""")
def page_modules(spark, sf_dir):
    """Sizes tell names and labels, the glyph opens a grant, the module goes on over the page's end."""
    spans = [(1, 17.8, "Office"), (1, 17.6, "Manager"), (1, 9.0, F.concat(F.lit("Long days "), _nation())), (1, 9.0, "•"), (1, 13.0, "Choose one:"), (2, 9.0, "+1 to Logic"), (2, 9.0, "•"), (2, 9.0, "+2 to Edge")]
    rows = F.array(*(F.struct(F.lit(p).alias("page"), F.lit(n).alias("span_no"), F.lit(z).alias("size"), (F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit("Serif").alias("font")) for n, (p, z, t) in enumerate(spans)))
    lines = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc"), F.explode(rows).alias("l")).select("doc", "l.*")
    return readers.read_modules(lines).select("doc", "name", "description", F.array_join(F.transform("grants", lambda g: F.concat_ws("=", g["label"], g["value"])), "|").alias("grants"))


@query("""
SELECT 's' || s_suppkey AS doc, CASE s_suppkey % 3 WHEN 0 THEN 'Marlow-' WHEN 1 THEN 'Harbor ' ELSE '' END || 'Car' || CASE s_suppkey % 2 WHEN 0 THEN ' Regent' ELSE '' END AS name FROM supplier""")
def page_unwrapped_names(spark, sf_dir):
    """Parts of a name before its row, a price skipped, and behind it."""
    head = F.when(_key(3) == 0, "Marlow-").when(_key(3) == 1, "Harbor").otherwise("a line of far too many words")
    lines = _pages(spark, sf_dir, (10, head), (10, "350,000/"), (10, "Car 1 2 3"), (10, F.when(_key(2) == 0, "Regent").otherwise("Next-")))
    return readers.unwrapped_names(lines.withColumn("own", F.when(F.col("line_no") == 2, "Car")), "own").select("doc", "name")


@query("""
SELECT 's' || s_suppkey AS doc, CASE s_suppkey % 2 WHEN 0 THEN 'Hansen Rider ' || s_nationkey ELSE 'Tamura ' || s_nationkey END AS name, CASE s_suppkey % 2 WHEN 0 THEN 'heavy bike' END AS subtype FROM supplier""")
def page_display_names(spark, sf_dir):
    """Above the block where its lines are set apart, else below."""
    above, below = _key(2) == 0, F.lit(True)
    lines = [("above", 1, F.lit("(heavy bike)"), F.lit(False), above), ("above", 2, F.concat(F.lit("Rider "), _nation()), F.lit(True), above), ("above", 3, F.lit("Hansen"), F.lit(True), above), ("above", 1, F.lit("prose"), F.lit(False), _key(2) == 1), ("below", 1, F.concat(F.lit("Tamura "), _nation()), F.lit(True), below)]
    rows = F.array(*(F.when(c, F.struct(F.lit(1).alias("page"), F.lit(0).alias("band"), F.lit(side).alias("side"), F.lit(place).alias("place"), t.alias("text"), s.alias("strict"), s.alias("relaxed"))) for side, place, t, s, c in lines))
    df = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc"), F.explode(F.array_compact(rows)).alias("l")).select("doc", "l.*")
    return readers.display_names(df).select("doc", "name", "subtype")


@query("""
SELECT 's' || s_suppkey AS doc, 1 AS line_no, 'Badger' AS name, CAST(s_nationkey AS VARCHAR) AS f0 FROM supplier
UNION ALL SELECT 's' || s_suppkey, 3, 'Corven- Beetle', '4' FROM supplier WHERE s_suppkey % 2 = 0""")
def page_rows_under_band(spark, sf_dir):
    """A name around its row, a gap that ends the block."""
    def values(*xs: Column) -> Column:
        return F.create_map(*[y for i, x in enumerate(xs) for y in (F.lit(f"f{i}"), x)])

    n, none = [F.lit(str(i)) for i in range(4, 9)], F.create_map().cast("map<string,string>")
    shift = F.when(_key(2) == 0, 0.0).otherwise(30.0)
    lines = [(104.0, F.lit("notes"), none), (114.0, F.lit("Badger"), values(_nation(), *n[:4])), (F.lit(124.0) + shift, F.lit("Corven-"), none), (F.lit(134.0) + shift, F.lit(""), values(*n)), (F.lit(144.0) + shift, F.lit("Beetle"), none), (260.0, F.lit("Far"), values(*n))]
    rows = F.array(*(F.struct(F.lit(i).alias("line_no"), (F.lit(t) if isinstance(t, float) else t).alias("top"), ((F.lit(t) if isinstance(t, float) else t) + 8.0).alias("bottom"), lead.alias("lead"), v.alias("vals")) for i, (t, lead, v) in enumerate(lines)))
    df = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("band"), F.lit(100.0).alias("band_top"), F.explode(rows).alias("l")).select("doc", "page", "band", "band_top", "l.*")
    return readers.rows_under_band(df, 6).select("doc", "line_no", "name", F.try_element_at("vals", F.lit("f0")).alias("f0"))
