from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import ident, parse, predicates, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


def V():  # noqa: N802
    return F.col("v")



@pytest.mark.parametrize(
    ("builder", "value", "want"),
    [
        (text.dedouble, "FFiirree BBaallll", "Fire Ball"), (text.dedouble, "book keeper", "book keeper"), (text.dedouble, "FFiirree ooff", "Fire of"), (text.dedouble, "oo ff", "oo ff"), (text.dedouble, "TThhiiss iiss", "This is"),
        (text.normalize_text, "Zapgun’s 8/2*/—/–/− caf\u00e9\u202f500¥ ﬁre", "Zapgun's 8/2*/—/—/— café 500¥ fire"), (text.normalize_text, "com\u00adbat", "combat"), (text.normalize_text, "a\u00a0b", "a b"),
        (text.norm, "Straße 9!", "strasse9"), (text.norm_base, "Lamp (Variant B)", "lamp"), (text.norm_base, "Lamp (Compact)", "lampcompact"), (text.slugify, "--A b/C--", "a_b_c"), (text.slugify_identity, "O'Brien's", "obriens"), (text.slugify_identity, "¿?", "unnamed"),
        (text.citation_only, 'p. 3 "a long quotation of words" - more', "p. 3"), (text.strip_markup, "'''A''' {{x {{y}}}}[[b|c]] <ref>d</ref>__TOC__", "A c "), (text.strip_markup, "{{a {{b {{c}} d}} e}}x [[File:p|q|r]] [[s]] {{open [[t", "x q|r s {{open [[t"), (text.strip_markup, "no 'marks' [at] {all}", "no 'marks' [at] {all}"),
        (text.strip_markup, '<ref name="a" />b<ref name="c">d</ref> <br>e [[f|]] g}}', "b e [[f|]] g}}"), (text.lead_prose, "File: " + "x" * 80 + "\n* list" + "y" * 80 + "\n short\n  The lamp  " + "is bright " * 6, "The lamp " + ("is bright " * 6).strip()),
        (text.stripped, "\u00a0 a b\u2003", "a b"), (text.norm, None, None),
        (parse.defense, "+ 4", 4), (parse.mount, "—", None), (parse.mount, " top ", "top"), (parse.js_number, "x -3.5y", -3.5), (parse.js_number, "none", 0.0), (parse.attack_rating, "10*/8/–", [10, 8, 0, 0, 0]), (parse.attack_rating, None, [0] * 5),
        (predicates.valid_name, "Iron Lamp", True), (predicates.valid_name, "iron Lamp", False), (predicates.valid_name, "Ir", False), (predicates.valid_name, "Lamp (x", False), (predicates.mangled_name, "Lamp of Iron", False), (predicates.mangled_name, "LaMp", True),
        (predicates.stat_line, "", True), (predicates.stat_line, "HEADER LINE", True), (predicates.stat_line, "a quiet line", False), (predicates.stat_line, "roll 3d6 now", True), (predicates.placeholder_art, "x/lib/y", True), (predicates.placeholder_art, None, False),
        (predicates.table_row, "Lamp 3 4 5 6 [7]", True), (predicates.table_row, "A lamp with 3 lights", False), (predicates.plausible_row_name, "Iron Lamp", True), (predicates.plausible_row_name, "It shines. Well", False),
    ],
)
def test_scalar(spark, builder, value, want):
    assert one(spark, builder(V()), value) == want


def test_structs(spark):
    assert tuple(one(spark, parse.damage(V()), "5S")) == (5, True, "5S") and tuple(one(spark, parse.damage(V()), "Special")) == (0, False, "Special") and one(spark, parse.damage(V()), "roll 5S")["dmg"] is None
    assert tuple(one(spark, parse.cost(V()), "1,250¥")) == (1250, None, False) and tuple(one(spark, parse.cost(V()), "Rating x 250¥")) == (0, "Rating x 250¥", True) and one(spark, parse.cost(V()), "6\xa0500 ¥")["price"] == 6500
    assert tuple(one(spark, parse.cost(V()), "+500¥")) == (500, None, False) and tuple(one(spark, parse.cost(V()), "Force x 1,000¥")) == (0, "Force x 1,000¥", True)
    assert tuple(one(spark, parse.availability(V()), "4 (R)")) == (4, "4 (R)", False) and tuple(one(spark, parse.availability(V()), "—")) == (0, "—", False) and tuple(one(spark, parse.availability(V()), "Rating")) == (0, "Rating", True)
    assert one(spark, parse.essence(V()), "0.25")["essence"] == Decimal("0.25") and tuple(one(spark, parse.essence(V()), "Rating x 0.75")) == (0, "Rating x 0.75", True) and one(spark, parse.essence(V()), "—")["essence"] == 0
    assert [tuple(one(spark, parse.capacity(V()), x)) for x in ("[3]", "8", "—", "[Rating]", "Rating", "1—6")] == [(3, False), (8, False), (0, False), (0, True), (0, True), (0, True)]
    assert [tuple(one(spark, parse.rating_span(V()), x)) for x in ("n/a", "1—4", "3")] == [(None, False), (None, True), (3, False)]
    assert tuple(one(spark, parse.price_with_capacity(V()), "15,000¥(15)")) == (15000, 15)
    assert tuple(one(spark, parse.fire_modes(V()), "SA/bf")) == (False, True, True, False)
    assert tuple(one(spark, parse.seats(V()), "2/cargo")) == (2, "cargo") and tuple(one(spark, parse.on_off(V()), "7")) == (7, 7) and tuple(one(spark, parse.on_off(V()), "7/3")) == (7, 3)
    assert tuple(one(spark, parse.movement(V()), "10/20/+2")) == (10, 20, 2) and one(spark, parse.movement(V()), "fast") is None
    assert tuple(one(spark, parse.scaled_value(V()), "2.5*$RATING")) == (2.5, None) and tuple(one(spark, parse.scaled_value(V()), "4")) == (None, 4.0) and one(spark, parse.scaled_value(V()), "?") is None
    assert one(spark, parse.hook_count(V(), F.lit(7)), "$RATING/2") == 3 and one(spark, parse.hook_count(V(), F.lit(7)), "junk") == 0
    skills = one(spark, parse.skill_map(V(), {"con": "con", "first aid": "aid"}), "Con 3 (Fast Talk +2), Juggling 4, First Aid 1, con 5")
    assert {k: tuple(v) for k, v in skills.items()} == {"con": (5, None), "aid": (1, None)}
    with pytest.raises(KeyError):
        parse.resolve_column("nosuch:thing")
    assert parse.resolve_column("int:armor")[0] == "armor" and parse.resolve_column("seat")[0] == "seat"
    assert one(spark, parse.resolve_column("int:armor")[1](V()), "—") == 0


@pytest.mark.parametrize(
    ("line", "keys", "want"),
    [
        ("Fictional Jacket +4 8 2 1,000¥", ["defense", "capacity", "avail", "cost"], ["Fictional Jacket", "+4", "8", "2", "1,000¥"]), ("w/helmet +2 6 — 500¥", ["defense", "capacity", "avail", "cost"], ["w/helmet", "+2", "6", "—", "500¥"]),
        ("Fictional Protection [Rating] 3 Rating x 250¥", ["capacity", "avail", "cost"], ["Fictional Protection", "[Rating]", "3", "Rating x 250¥"]), ("Fictional Sight Top or Under 1 125¥", ["mount", "avail", "cost"], ["Fictional Sight", "Top or Under", "1", "125¥"]),
        ("Fictional Arm 1 4 20,000¥(8) 15,000¥(15)", ["essence", "avail", "pricecapnote:Synthetic", "pricecap"], ["Fictional Arm", "1", "4", "20,000¥(8)", "15,000¥(15)"]),
        ("Fictional Pump 1—3 Rating x 0.75 5(I) Rating x 55,000¥", ["ratingspan", "essence", "avail", "cost"], ["Fictional Pump", "1—3", "Rating x 0.75", "5(I)", "Rating x 55,000¥"]), ("A sentence, no row.", ["avail", "cost"], None),
    ],
)
def test_rows_by_column_patterns(spark, line, keys, want):
    assert one(spark, parse.row_cells(V(), keys), line) == want


def test_arrays(spark):
    keys = lambda name: set(one(spark, text.heading_keys(V()), name))
    assert keys("Lamp, Iron Mk2") == {"lampironmk2", "lampironmk2s", "ironmk2lamp", "ironmk2lamps", "lamp", "lamps"} and keys("Smartlink (cyberware)") == {"smartlinkcyberware", "smartlinkcyberwares", "smartlink", "smartlinks"}
    assert keys("Pulsar I/II") == {"pulsariii", "pulsariiis", "pulsari", "pulsaris", "pulsar", "pulsars"} and keys("Lamps") == {"lamps", "lamp"} and keys("?") == set()
    assert one(spark, text.name_variants(V()), "Acme Lamp / Torch") == ["Acme Lamp / Torch", "Acme Lamp/Torch", "Acme Lamp", "Torch", "Acme Torch"]
    assert one(spark, text.name_variants(V()), "Lamp/Torch") == ["Lamp/Torch", "Lamp", "Torch"] and one(spark, text.name_variants(V()), "Lamp, Big") == ["Lamp, Big"] and one(spark, text.name_variants(V()), " ") == []
    assert one(spark, text.thousands_safe_split(V()), "1,000 lamps, oil or wax") == ["1,000 lamps", "oil", "wax"]
    assert one(spark, text.dehyphenate(V()), ["a lan-", "tern  is", "on "], "array<string>") == "a lantern is on"
    assert one(spark, text.dehyphenate(V()), ["a lan-", "-", "", "tern is cut wor-"], "array<string>") == "a lantern is cut"
    assert one(spark, text.clean_block(V()), ["tail. The lamp", "shines. It al"], "array<string>") == "The lamp shines."
    assert one(spark, text.clean_block(V()), ["all in lower case"], "array<string>") == "all in lower case" and one(spark, text.clean_block(V()), ["He said “go.” And th"], "array<string>") == "He said “go.”"


def test_clean_block_ends_at_a_sentence(spark):
    long = "The lamp shines. " * 300
    assert one(spark, text.clean_block(V()), [long], "array<string>") == ("The lamp shines. " * 205).strip()
    assert one(spark, text.clean_block(V(), None), [long], "array<string>") == long.strip()
    assert one(spark, text.clean_block(V()), ["lamp " * 900 + "end"], "array<string>") == "lamp " * 900 + "end"


def test_ids(spark):
    import hashlib

    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    want = "".join(letters[b % 62] for b in hashlib.sha1(b"a/b/c").digest()[:16])
    assert one(spark, ident.document_id(F.lit("a"), F.lit("b"), V()), "c") == want
    assert one(spark, ident.catalog_id(F.lit(" "), V(), F.lit("m")), "up_x") == "up_x" and one(spark, ident.catalog_id(F.lit(None), V(), F.lit("m")), "y") == "m"


def test_blank_kinds(spark):
    df = spark.createDataFrame([(None, None, None, None), ("", 0, False, []), (" ", 1, True, ["a"])], "s string, n int, b boolean, a array<string>")
    flags = lambda f: [[r[0] for r in df.select(f(df, c)).collect()] for c in df.columns]
    assert flags(predicates.is_empty) == [[True, True, False], [True, False, False], [True, False, False], [True, True, False]]
    assert flags(predicates.is_falsy) == [[True, True, False], [True, True, False], [True, True, False], [True, True, False]]
    assert flags(predicates.is_unfilled) == [[True, True, True], [True, False, False], [True, False, False], [True, True, False]]
