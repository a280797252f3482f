"""Readers of page text on invented pages."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import readers
from tessera.operators.readers import READERS, read_entries

PROSE = "The quiet lantern throws a wide and steady light over the harbor."


def page(spark, *columns, number=1, size=10.0):
    """Lines of the columns of one page: a text, or (size, text), or (size, text, font)."""
    rows = []
    for c, lines in enumerate(columns):
        for n, line in enumerate(lines):
            s, t, f = (size, line, "plain") if isinstance(line, str) else (*line, "plain")[:3]
            rows.append(("book", number, c, n, float(s), t, f))
    return spark.createDataFrame(rows, "doc string, page int, col int, line_no int, size double, text string, font string")


def got(df):
    rows = df.orderBy("page", "col", "line_no").collect()
    return {r["name"]: (r["fields"], r["description"]) for r in rows}


def test_spells(spark):
    one = page(spark, [(16, "Combat Spells"), (13, "Bright Bolt"), "(Direct Combat)", "RANGE TYPE DURATION DV DAMAGE", "LOS (A) p i 5 Stun.", (13, "Dark Bolt"), "RANGE TYPE DURATION DV", "Touch M S 3", PROSE, "It is cut wor-"], [(13, "No Category Ends Here (x)")])
    two = page(spark, [(13, "Third Bolt"), PROSE], [(16, "Health Spells"), (13, "Warm Hand"), (13, "A Rather Long Name Of Many Words"), PROSE], number=2)
    e = readers.read_spells(one.unionByName(two))
    assert got(e) == {
        "Bright Bolt": ({"descriptor": "Direct Combat", "range": "LOS(A)", "spellType": "P", "duration": "I", "drain": "5", "damage": "Stun"}, f"{PROSE} It is cut"),
        "Dark Bolt": ({"range": "TOUCH", "spellType": "M", "duration": "S", "drain": "3"}, f"{PROSE} It is cut"), "Third Bolt": ({}, PROSE), "Warm Hand": ({}, f"A Rather Long Name Of Many Words {PROSE}"),
    }
    assert {r["name"]: (r["category"], r["shared"]) for r in e.collect()} == {"Bright Bolt": ("COMBAT", True), "Dark Bolt": ("COMBAT", False), "Third Bolt": ("COMBAT", False), "Warm Hand": ("HEALTH", False)}


def test_sections_need_an_entry_of_their_own_group_to_share(spark):
    lines = page(spark, [(16, "Combat Spells"), (13, "Bright Bolt"), (16, "Health Spells"), (13, "Warm Hand"), PROSE])
    assert got(readers.read_spells(lines)) == {"Bright Bolt": ({}, None), "Warm Hand": ({}, PROSE)}


def test_rituals_and_powers(spark):
    lines = page(spark, [(15, "Rituals"), (13, "Ward Of Salt"), "(Anchored, Minion)", "Threshold: 5", "Threshold: 9", PROSE, (13, "Ritual Team"), "no entry", (13, "First Step")], [(13, "Only Prose"), PROSE, (13, "Watcher"), "(Minion)"])
    assert got(read_entries(lines, READERS["ritual"])) == {"Ward Of Salt": ({"keywords": "Anchored, Minion", "threshold": "5"}, f"Threshold: 9 {PROSE} Ritual Team no entry First Step"), "Watcher": ({"keywords": "Minion"}, None)}
    lines = page(spark, [(13, "Iron Lungs"), "Cost: 0.5 PP per level", "Activation: Minor Action 12", PROSE, (13, "Cost matters"), (13, "Spells"), (13, "Plain Heading"), PROSE])
    found = got(read_entries(lines, READERS["adept power"]))
    assert found["Iron Lungs"][0] == {"cost": "0.5 PP per level", "activation": "Minor Action"} and set(found) == {"Iron Lungs"}


def test_qualities_by_phase(spark):
    lines = page(spark, [(15, "Negative Qualities"), (13, "Slow Reader"), PROSE, "• Cost: 12 Karma", "a line that is dropped", "• Game Effect: Tests take", "twice as long.", "Game Effect: Always."], [(13, "No Cost"), PROSE], [(15, "Positive qualities again"), (13, "Quick Eye"), "Bonus: 3"])
    e = read_entries(lines, READERS["quality"])
    assert got(e) == {"Slow Reader": ({"cost": "12 Karma", "effect": "Tests take twice as long. Always."}, PROSE), "Quick Eye": ({"cost": "3"}, None)}
    assert {r["name"]: r["section"] for r in e.collect()} == {"Slow Reader": "NEGATIVE", "Quick Eye": "POSITIVE"}


def test_skills_and_lifestyles(spark):
    lines = page(spark, [(15, "Stealth"), "Specializations: Hiding, Sneaking", PROSE, (15, "Juggling"), "Specialization: Clubs"], [(15, "Astral"), PROSE])
    assert {r["name"]: (r["attribute"], r["fields"]["specializations"]) for r in readers.read_skills(lines).collect()} == {"Stealth": ("Agility", "Hiding, Sneaking"), "Juggling": (None, "Clubs")}
    lines = page(spark, [(15, "Low"), "Cost: 2,000¥ a month", PROSE, (15, "Castle"), "Cost: 9"], [(15, "High"), PROSE])
    assert got(read_entries(lines, READERS["lifestyle"])) == {"Low": ({"cost": "2,000¥ a month"}, f"{PROSE} Castle Cost: 9")}


def test_toxins_and_drugs(spark):
    lines = page(spark, [(15, "Drugs"), (13, "Night Dust"), "• Vector: Inhalation,", "Contact", "• Speed: 1 minute", "• Effect: Sleep", PROSE], [(13, "From the street"), (13, "No Vector"), "Speed: 3"])
    e = read_entries(lines, READERS["toxin or drug"])
    assert got(e) == {"Night Dust": ({"vector": "Inhalation, Contact", "speed": "1 minute", "effect": "Sleep"}, PROSE)} and e.first()["section"] == "DRUG"


def test_spirits_and_critters(spark):
    lines = page(spark, [(12, "Spirits of Salt"), "B A R S W L I C M ESS", "F F+1 F F-1 F F F F F F", "Powers: Guard,", "hide", PROSE], [(12, "Just a Heading"), "Attacks: Claw 5P"])
    e = read_entries(lines, READERS["spirit"])
    row = e.first()
    assert e.count() == 1 and row["fields"] == {"powers": "Guard, hide", "attacks": "Claw 5P"} and (row["attributes"]["bod"], row["attributes"]["agi"], row["attributes"]["ess"]) == ("F", "F+1", "F")
    lines = page(
        spark, [(13, "Marsh Hound"), "B A R S W L I C ESS", "5 4 4 5 3 2 4 2 6.0", "Powers: Scent", "tracking", "Movement: 10/20", PROSE, (13, "Ember Cat"), "3 6 5 2 4 2 4 3 5 6.0", "Powers: Fire", (13, "No Powers"), "3 6 5 2 4 2 4 3 5 6.0"],
        [(13, "CAPS NAME"), "Skills: x"],
    )
    e = read_entries(lines, READERS["critter"])
    rows = {r["name"]: r for r in e.collect()}
    assert set(rows) == {"Marsh Hound", "Ember Cat"} and rows["Marsh Hound"]["fields"] == {"powers": "Scent tracking", "movement": "10/20"}
    assert "mag" not in rows["Marsh Hound"]["attributes"] and rows["Marsh Hound"]["attributes"]["ess"] == "6.0" and rows["Ember Cat"]["attributes"]["mag"] == "5"


def test_entries_end_with_their_page_or_column(spark):
    first, second = page(spark, [(13, "Marsh Hound"), "Powers: Scent"], ["3 6 5 2 4 2 4 3 5 6.0"]), page(spark, [(13, "Ember Cat"), "Powers: x"], number=2)
    third = page(spark, ["3 6 5 2 4 2 4 3 5 6.0", "filler text"], number=3)
    assert set(got(read_entries(first.unionByName(second).unionByName(third), READERS["critter"]))) == {"Marsh Hound"}
    assert got(read_entries(page(spark, [(13, "Ward Of Salt")], ["Threshold: 5"]), READERS["ritual"])) == {}


def test_stat_tables(spark):
    lines = page(spark, [(13, "Echo Shield (minor)"), "FADE VALUE DURATION", "–2 s", PROSE, (13, "Bare Form"), "FADE VALUE DURATION", "no values here", PROSE])
    assert got(readers.read_complex_forms(lines)) == {"Echo Shield": ({"fading": "-2", "duration": "sustained"}, PROSE)}
    lines = page(spark, [(13, "Gift of the"), "TYPE ACTION RANGE DURATION", "M Major LOS (A) Sustained", PROSE], [(13, "Powers"), "TYPE ACTION RANGE DURATION", "P Minor Self Always"])
    assert got(readers.read_critter_powers(lines))["Gift of"][0] == {"type": "mana", "action": "Major", "range": "LOS (A)", "duration": "Sustained"}


def test_contacts_and_martial_arts(spark):
    lines = page(spark, [(13, "Dock Clerk"), "She knows the harbor and its people.", "Connection Rating: 3, Loyalty 2", "Loyalty: 4", (13, "Nobody Here"), PROSE, (13, "Bar Keeper"), "Connection 5 / Loyalty 1"])
    assert got(read_entries(lines, READERS["contact"])) == {"Bar Keeper": ({"connection": "5", "loyalty": "1"}, None), "Dock Clerk": ({"connection": "3", "loyalty": "4"}, "She knows the harbor and its people.")}
    lines = page(spark, [(13, "Crane Style"), "Techniques: Sweep, Push,", "and throw", PROSE, (13, "The Basics"), (13, "Prose Only"), PROSE])
    assert got(read_entries(lines, READERS["martial style"])) == {"Crane Style": ({"techniques": "Sweep, Push, and throw"}, f"{PROSE} The Basics")}
    shown = [(13, "Low Sweep", "display"), PROSE, (13, "in another font", "display"), (13, "Any Attack", "display"), PROSE, (13, "low sweep", "display"), (13, "Low Sweep", "display"), PROSE, (13, "Plain Font"), PROSE, (13, "When To Run", "display"), PROSE]
    assert list(got(read_entries(page(spark, shown), READERS["martial technique"]))) == ["Low Sweep"]


def test_blocks_of_persons(spark):
    labels = {"skills": "Active Skills:", "gear": "Gear:"}
    lines = page(
        spark, ["Harbor Guard", "Metatype: Ork (male)", "B A R S W L I C EDG ESS", "4(5) 3 3 4 2 2 3 2 1 5.8", "Active Skills: Close Combat 3,", "perception 2", "Gear: Lamp", PROSE, "Night Clerk", "B A R S W L I C EDG M ESS", "2 2 3 2 3 4 3 4 2 5 6.0", "Gear: Pen", "Metatype: Elf", "Gear: No numbers"],
        ["a line in lower case", "B A R S W L I C EDG ESS", "1 1 1 1 1 1 1 1 1 6.0"],
    )
    rows = {r["name"]: r for r in readers.read_blocks(lines, labels).collect()}
    assert set(rows) == {"Harbor Guard", "Night Clerk", "NPC"}
    guard, clerk = rows["Harbor Guard"], rows["Night Clerk"]
    assert guard["fields"] == {"metatype": "Ork", "skills": "Close Combat 3, perception 2", "gear": "Lamp"} and guard["attributes"]["bod"] == "4" and "magres" not in guard["attributes"]
    assert clerk["fields"] == {"gear": "Pen"} and clerk["attributes"]["magres"] == "5" and guard["description"].startswith(PROSE)


def test_actors(spark):
    lines = page(spark, [(20, "Mara"), (20, "Voss"), PROSE, "Metatype: Human", "Gear: Lamp, rope", "Weapons: none"]).unionByName(page(spark, [(20, "No Actor"), PROSE], number=2)).unionByName(page(spark, [(16, "Small"), "Metatype: Elf"], number=3))
    rows = readers.read_actors(lines, ["Gear", "Weapons"]).collect()
    assert [(r["name"], r["fields"], r["description"]) for r in rows] == [("Mara Voss", {"Metatype": "Human", "Gear": "Lamp, rope", "Weapons": "none"}, PROSE)]


@pytest.mark.parametrize("kind", list(READERS))
def test_empty_and_null_lines(spark, kind):
    schema = "doc string, page int, col int, line_no int, size double, text string, font string"
    assert read_entries(spark.createDataFrame([], schema), READERS[kind]).count() == 0
    assert read_entries(spark.createDataFrame([("a", 1, 0, 0, None, None, None), ("a", 1, 0, 1, 13.0, " ", None)], schema), READERS[kind]).count() == 0


def test_ruled_rows(spark):
    stats = [str(i) for i in range(1, 10)]
    rows = [("b", 1, 0, ["Early", *stats]), ("b", 1, 1, ["bikes\n", "HAND", "ACC"]), ("b", 1, 2, ["12 Street  Cat", *stats]), ("b", 1, 3, ["Prose row", "a", "1"]), ("b", 1, 4, ["unknown", "Handling"]), ("b", 1, 5, ["Hill Cat", *stats, "10", "11", "12", None]), ("b", 1, 6, ["Cars", "HAND"]), ("b", 1, 7, ["X", *stats]), ("b", 1, 8, [None, "1"]), ("b", 2, 0, ["Next Page", *stats])]
    df = spark.createDataFrame(rows, "doc string, page int, row_no int, cells array<string>")
    got_rows = readers.ruled_rows(df, {"BIKES": "BIKE", "CARS": "CAR"}).collect()
    assert sorted((r["section"], r["name"], r["stats"]) for r in got_rows) == [("BIKE", "Hill Cat", [*stats, "10", "11"]), ("BIKE", "Street Cat", [*stats, "", ""])]


def test_spread_rows(spark):
    row = "4/3 10 20 30 4 5 6 7 2 3 12,000¥ more"
    lines = page(spark, ["River Runner (Patrol Boat)", "some text", "HAND ACC BODY ARM", "a line", row, "Harbor Cat", "(heavy bike)", "HAND ACC BODY ARM", row, "no name here: x", "HAND ACC BODY ARM", row], ["Lone (car)", "HAND ACC BODY ARM", "1", "2", "3", row])
    got_rows = readers.spread_rows(lines, F.col("text").startswith("HAND ACC"), r"^\d+/\d+(?:\s+[\d,]+¥?){8,}").orderBy("line_no").collect()
    assert [(r["name"], r["subtype"], r["stats"][-1]) for r in got_rows] == [("River Runner", "patrol boat", "12,000¥"), ("Harbor Cat", "heavy bike", "12,000¥"), ("Harbor Cat", "heavy bike", "12,000¥")]


def test_modules(spark):
    spans = [
        (1, 0, 9.0, "before the first", "Serif"), (1, 1, 17.8, "Office", "Sans"), (1, 2, 17.6, "Manager", "Sans"), (1, 3, 9.0, "Long days", "Serif"), (1, 4, 8.0, "folio 7", "OpenSans"), (1, 5, 9.0, "and nights.", "Serif"), (1, 6, 9.0, "•", "Sans"), (1, 7, 13.0, "Choose one:", "Serif"),
        (2, 0, 9.0, "+1 to Logic", "Serif"), (2, 1, 9.0, "or Charisma", "Serif"), (2, 2, 9.0, "•", "Sans"), (2, 3, 9.0, "+2 to Edge", "Serif"), (2, 4, 17.8, "Training", "Sans"), (2, 5, 9.0, " ", "Serif"), (2, 6, 9.0, "text", "Serif"), (2, 7, 17.8, "(Adepts only)", "Sans"), (2, 8, 9.0, "•", "Sans"), (2, 9, 9.0, "x", "Serif"),
    ]
    df = spark.createDataFrame([("b", *s) for s in spans], "doc string, page int, span_no int, size double, text string, font string")
    got_rows = readers.read_modules(df).orderBy("page", "name").collect()
    assert [(r["page"], r["name"], r["description"], [tuple(g) for g in r["grants"]]) for r in got_rows] == [
        (1, "Office Manager", "Long days and nights.", [("Choose one", "+1 to Logic or Charisma"), ("", "+2 to Edge")]), (2, "Training (Adepts only)", "", [("", "x")]),
    ]


def test_unwrapped_names(spark):
    lines = [
        ("Marlow-", None), ("Brandt Car 1 2 3", "Brandt Car"), ("Regent", None), ("Plain Boat 1 2", "Plain Boat"), ("a line with too many words in it", None), ("Commuter", None), ("350,000/", None), ("Air 4 5", "Air"), ("Wing-", None), ("Tip 7 8", "Tip"), ("", None),
    ]
    df = spark.createDataFrame([("b", 1, i, t, n) for i, (t, n) in enumerate(lines)] + [("b", 2, 0, "Alone 1", "Alone")], "doc string, page int, line_no int, text string, own string")
    got_rows = readers.unwrapped_names(df, "own").orderBy("page", "line_no").collect()
    assert [r["name"] for r in got_rows] == ["Marlow-Brandt Car Regent", "Plain Boat", "Commuter Air", "Wing-Tip", "Alone"]


def test_lines_before_the_first_section(spark):
    lines = page(spark, [(13, "Early Bolt"), "(Health)", PROSE, (16, "Combat Spells"), (13, "Late Bolt"), PROSE])
    assert {r["name"]: r["category"] for r in readers.read_spells(lines).collect()} == {"Early Bolt": "HEALTH", "Late Bolt": "COMBAT"}


def test_display_names(spark):
    lines = [
        (1, "above", 1, "(heavy ATV)", False, False), (1, "above", 2, "Field Rider (p. 12 x)", True, True), (1, "above", 3, "Hansen", True, True), (1, "below", 1, "Wrong", True, True),
        (2, "above", 1, "prose first", False, False), (2, "above", 2, "Behind Prose", True, True), (2, "below", 1, "stats", True, True), (2, "below", 2, "Tamura", True, True), (2, "below", 3, "Kestrel", True, True),
        (3, "above", 1, "Bold Name", False, True), (3, "above", 2, "(boat, dc 4)", False, False), (4, "below", 1, "12", True, True), (4, "above", 1, "prose", False, False),
    ]
    df = spark.createDataFrame([("b", 1, *x) for x in lines], "doc string, page int, band int, side string, place int, text string, strict boolean, relaxed boolean")
    got_rows = sorted((r["band"], r["name"], r["subtype"]) for r in readers.display_names(df).collect())
    assert got_rows == [(1, "Hansen Field Rider", "heavy ATV"), (2, "Tamura Kestrel", None), (3, "Bold Name", "boat")]


def test_rows_under_band(spark):
    v = lambda *xs: {f"f{i}": x for i, x in enumerate(xs)}
    lines = [
        (1, 100.0, 0, 104.0, 112.0, "table notes", {}), (1, 100.0, 1, 114.0, 122.0, "Badger", v("3/3", "10", "4", "2", "text")), (1, 100.0, 2, 124.0, 130.0, "Corven-", {}), (1, 100.0, 3, 134.0, 142.0, "", v("4", "5", "6", "7", "8")), (1, 100.0, 4, 144.0, 150.0, "Beetle", {}),
        (1, 100.0, 5, 190.0, 198.0, "Far Away", v("4", "5", "6", "7", "8")), (2, 100.0, 0, 104.0, 112.0, "One", v("1", "2", "3", "4", "5")), (2, 100.0, 1, 114.0, 122.0, "a line", v("prose")), (2, 100.0, 2, 124.0, 132.0, "Two", v("1", "2", "3", "4", "5")), (3, 50.0, 0, 90.0, 98.0, "Late", v("1", "2", "3", "4", "5")),
    ]
    df = spark.createDataFrame([("b", 1, *x) for x in lines], "doc string, page int, band int, band_top double, line_no int, top double, bottom double, lead string, vals map<string,string>")
    got_rows = sorted((r["band"], r["line_no"], r["name"], len(r["vals"])) for r in readers.rows_under_band(df, 6).collect())
    assert got_rows == [(1, 1, "Badger", 5), (1, 3, "Corven- Beetle", 5), (2, 0, "One", 5)]
