"""Parsers of formatted values to structs (F12-F31, F36, F42, F55) and the registry that resolves column keys.

What a value does not match gives null; a value that depends on a rating gives 0 and ``needs_rating``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = r"^\s*[-–—]?\s*$"


def first_int(v: Column) -> Column:
    """The first whole number, thousands separators dropped; null if there is none."""
    return F.regexp_extract(F.regexp_replace(v, r"(?<=\d),(?=\d)", ""), r"(\d+)", 1).try_cast("bigint")


def damage(v: Column) -> Column:
    """one or two digits with P or S at the start to amount, stun flag and text; 'Special' has amount 0."""
    n, kind = F.regexp_extract(v, r"^(\d{1,2})[PS]", 1).try_cast("int"), F.regexp_extract(v, r"^\d{1,2}([PS])", 1)
    return F.struct(F.when(F.trim(v) == "Special", F.lit(0)).otherwise(n).alias("dmg"), F.coalesce(kind == "S", F.lit(False)).alias("stun"), F.trim(v).alias("dmg_def"))


def fire_modes(v: Column, names: tuple[str, ...] = ("SS", "SA", "BF", "FA")) -> Column:
    """a list of modes to one flag each."""
    parts = F.split(F.upper(F.coalesce(v, F.lit(""))), r"[^A-Z]+")
    return F.struct(*(F.array_contains(parts, m).alias(m.lower()) for m in names))


def attack_rating(v: Column, size: int = 5) -> Column:
    """slash-separated numbers, stars dropped, a dash is 0, padded or cut to ``size``."""
    parts = F.transform(F.split(F.replace(F.coalesce(v, F.lit("")), F.lit("*"), F.lit("")), "/"), lambda x: F.coalesce(F.trim(x).try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), size)), 1, size)


def ammo(v: Column) -> Column:
    """the leading number, and whether an alternative follows."""
    return F.struct(F.coalesce(F.regexp_extract(v, r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)).alias("cap"), F.coalesce(v.rlike(r"/|\bor\b"), F.lit(False)).alias("alternative"))


def availability(v: Column) -> Column:
    """F16: leading number, text and rating flag; a dash and the word Rating are 0."""
    rated = F.coalesce(F.trim(v) == "Rating", F.lit(False))
    number = F.coalesce(F.regexp_extract(v, r"^\s*(\d+)", 1).try_cast("int"), F.lit(0))
    return F.struct(F.when(rated, F.lit(0)).otherwise(number).alias("avail"), F.trim(v).alias("avail_def"), rated.alias("needs_rating"))


def cost(v: Column) -> Column:
    """money, with or without a plus sign, to a whole number; a formula (it starts with Rating, Force or Capacity) gives 0, its text and the rating flag."""
    formula = F.coalesce(v.rlike(r"^\s*(?:Rating|Force|Capacity)"), F.lit(False))
    price = F.coalesce(first_int(F.regexp_replace(v, "(?<=\\d)[ \u00a0](?=\\d)", "")), F.lit(0))
    return F.struct(F.when(formula, F.lit(0)).otherwise(price).cast("bigint").alias("price"), F.when(formula, F.trim(v)).alias("price_def"), formula.alias("needs_rating"))


def essence(v: Column) -> Column:
    """decimal, 0 for a dash; 0, text and rating flag for what starts with Rating."""
    rated = F.coalesce(v.rlike(r"^\s*Rating"), F.lit(False))
    number = F.when(rated | v.isNull() | v.rlike(DASH), F.lit("0")).otherwise(F.trim(v)).try_cast("decimal(6,2)")
    return F.struct(number.alias("essence"), F.when(rated, F.trim(v)).alias("essence_def"), rated.alias("needs_rating"))


def capacity(v: Column) -> Column:
    """a number, in brackets or not; a dash is 0, the word Rating and a span give 0 and the rating flag."""
    rated = F.coalesce(v.rlike(r"^\s*\[?Rating\]?\s*$") | (v.rlike("[-–—]") & ~v.rlike(DASH)), F.lit(False))
    number = F.when(rated | v.rlike(DASH), F.lit(0)).otherwise(F.regexp_extract(v, r"^\s*\[?(\d+)\]?\s*$", 1).try_cast("int"))
    return F.struct(number.alias("capacity"), rated.alias("needs_rating"))


def defense(v: Column) -> Column:
    """'+n' to n."""
    return F.regexp_replace(v, r"[+\s]", "").try_cast("int")


def mount(v: Column) -> Column:
    """a note unless a dash."""
    return F.when(~v.rlike(DASH), F.trim(v))


def rating_span(v: Column) -> Column:
    """'n/a' nothing, a span the rating flag, else the number."""
    span = F.coalesce(v.rlike("[-–—]"), F.lit(False))
    return F.struct(F.when(~span, F.regexp_extract(v, r"^\s*(\d+)\s*$", 1).try_cast("int")).alias("rating"), span.alias("needs_rating"))


def price_with_capacity(v: Column) -> Column:
    """'N¥(C)' to price and capacity."""
    return F.struct(first_int(F.regexp_extract(v, r"^([^(]*)", 1)).alias("price"), F.regexp_extract(v, r"\((\d+)\)", 1).try_cast("int").alias("capacity"))


def seats(v: Column) -> Column:
    """number of seats; 'a/b' keeps the second as a note; a dash is 0."""
    return F.struct(F.coalesce(F.regexp_extract(v, r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)).alias("seats"), F.nullif(F.regexp_extract(v, r"/\s*(\S+)", 1), F.lit("")).alias("note"))


def on_off(v: Column) -> Column:
    """'on/off' to two numbers; a single one counts for both."""
    on = F.regexp_extract(v, r"^\s*(\d+)", 1).try_cast("int")
    return F.struct(on.alias("on"), F.coalesce(F.regexp_extract(v, r"/\s*(\d+)", 1).try_cast("int"), on).alias("off"))


def js_number(v: Column) -> Column:
    """the first signed decimal number, else 0."""
    return F.coalesce(F.regexp_extract(v.cast("string"), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def skill_map(v: Column, codes: Mapping[str, str]) -> Column:
    """'Name N (Speciality +2), ...' to code -> (points, specialization); unknown names dropped, the last of a repeated one counts."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    parts = F.split(F.coalesce(v, F.lit("")), r",\s*(?![^()]*\))")
    entries = F.transform(parts, lambda p: F.struct(
        F.try_element_at(table, F.lower(F.trim(F.regexp_extract(p, r"^([^0-9(]+)", 1)))).alias("k"),
        F.struct(F.coalesce(F.regexp_extract(p, r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("points"), F.nullif(F.trim(F.regexp_extract(p, r"\(([^+)]*)", 1)), F.lit("")).alias("specialization")).alias("v"),
    ))
    known = F.filter(entries, lambda e: e["k"].isNotNull())
    last = F.filter(known, lambda e, i: ~F.exists(F.slice(known, i + 2, F.greatest(F.size(known), F.lit(1))), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def movement(v: Column) -> Column:
    """'a/b/+c' to three numbers, null if it is none."""
    pattern = r"^\s*(\d+)\s*/\s*(\d+)\s*/\s*\+?(\d+)\s*$"
    return F.when(v.rlike(pattern), F.struct(*(F.regexp_extract(v, pattern, i + 1).cast("int").alias(n) for i, n in enumerate(("walk", "run", "sprint")))))


def flags_of(v: Column) -> Column:
    """number, stun flag and the '(x)' flags of a value."""
    return F.struct(F.regexp_extract(v, r"^\s*(\d+)", 1).try_cast("int").alias("value"), F.coalesce(v.rlike(r"^\s*\d+S"), F.lit(False)).alias("stun"), F.regexp_extract_all(v, F.lit(r"\((\w+)\)"), 1).alias("flags"))


def scaled_value(v: Column) -> Column:
    """'$RATING*n', 'n*$RATING' and '$RATING' per rating, a number flat, else null."""
    per = F.coalesce(F.nullif(F.regexp_extract(v, r"^\$RATING\s*\*\s*(\d+(?:\.\d+)?)$", 1), F.lit("")), F.nullif(F.regexp_extract(v, r"^(\d+(?:\.\d+)?)\s*\*\s*\$RATING$", 1), F.lit("")), F.when(v == "$RATING", F.lit("1")))
    flat = v.try_cast("double")
    return F.when(per.isNotNull() | flat.isNotNull(), F.struct(per.try_cast("double").alias("per_rating"), flat.alias("flat")))


def hook_count(v: Column, rating: Column) -> Column:
    """number, '$RATING', '$RATING*n' or '$RATING/n', rounded down; anything else is 0."""
    n = F.regexp_extract(v, r"^\$RATING\s*[*/]\s*(\d+)$", 1).try_cast("double")
    out = F.when(v.rlike(r"^\d+(\.\d+)?$"), v.try_cast("double")).when(v == "$RATING", rating.cast("double"))
    out = out.when(v.rlike(r"^\$RATING\s*\*"), rating * n).when(v.rlike(r"^\$RATING\s*/") & (n > 0), rating / n)
    return F.coalesce(F.floor(out), F.lit(0)).cast("bigint")


#: Attributes that go by another name where they are nested.
NESTED_NAMES = {"ess": "essence", "magres": "mag"}


def nest_attributes(attributes: Column) -> Column:
    """a flat map (name to number or text) to a map of structs {base}; what is no number is 0, two names change (the last of both counts)."""
    table = F.create_map(*[F.lit(x) for kv in NESTED_NAMES.items() for x in kv])
    entries = F.transform(F.map_entries(attributes), lambda e: F.struct(F.coalesce(F.try_element_at(table, e["key"]), e["key"]).alias("k"), F.struct(js_number(e["value"]).alias("base")).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


#: Named columns.
COLUMNS: dict[str, Callable[[Column], Column]] = {
    "dv": damage, "modes": fire_modes, "ar": attack_rating, "ammo": ammo, "avail": availability, "cost": cost, "essence": essence, "capacity": capacity,
    "defense": defense, "mount": mount, "ratingspan": rating_span, "pricecap": price_with_capacity, "seat": seats,
}
#: Kinds of columns, named 'kind:name' ('onoff:name:name').
KINDS: dict[str, Callable[[Column], Column]] = {
    "int": lambda v: F.when(v.rlike(DASH), F.lit(0)).otherwise(first_int(v)), "plusint": defense, "onoff": on_off, "text": lambda v: F.trim(v),
    "note": lambda v: F.trim(v), "pricecapnote": lambda v: F.trim(v),
}
#: What a whole cell of a column looks like.
PATTERNS = {
    "dv": r"(?:\d{1,2}[PS](?:\([a-z]+\))?(?: \+ special)?|Special)",
    "modes": r"(?:SS|SA|BF|FA)(?:/(?:SS|SA|BF|FA))*",
    "ar": r"[0-9*—]+(?:/[0-9*—]+){4}",
    "ammo": r"\d+(?:\([a-z]+\))?(?: or \d+\([a-z]+\))?",
    "avail": r"(?:—|Rating|\d{1,2}L|\d{1,2}(?:\([A-Z]\))?)",
    "cost": r"(?:(?:Rating(?:\^2)?|Force|Capacity) x [\d,]+¥|[+]?[\d,]+¥)",
    "essence": r"(?:—|Rating x \d+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)",
    "capacity": r"(?:\[Rating\]|Rating|\[\d\]|[\d—]+)",
    "defense": r"[+]?\d+",
    "mount": r"(?:—|Top or Under|Top|Under|Barrel|Stock|Internal)",
    "ratingspan": r"(?:n/a|\d{1,2}—\d{1,2}|\d{1,2})",
    "pricecap": r"[\d,]+¥\(\d+\)",
    "seat": r"(?:—|\d+(?:/\d+)?)",
    "int": r"[\d—]+",
    "plusint": r"[+]?\d+",
    "onoff": r"\d+(?:/\d+)?",
    "text": r"\S+",
    "note": r"\S+",
    "pricecapnote": r"[\d,]+¥\(\d+\)",
}


def resolve_column(key: str) -> tuple[str, Callable[[Column], Column]]:
    """(name, builder) of a column key; KeyError if it is unknown."""
    if key in COLUMNS:
        return key, COLUMNS[key]
    kind, _, name = key.partition(":")
    if not name or kind not in KINDS:
        raise KeyError(key)
    return name, KINDS[kind]


def column_pattern(key: str) -> str:
    """what a whole cell of the column with that key looks like; KeyError if it is unknown."""
    resolve_column(key)
    return PATTERNS[key.partition(":")[0]]


def row_cells(line: Column, keys: Sequence[str]) -> Column:
    """The name and the cells of a table row whose columns have these keys, from the right; null if the line is no such row."""
    pattern = "^(.+?)" + "".join(rf"\s+({column_pattern(k)})" for k in keys) + r"\s*$"
    return F.when(line.rlike(pattern), F.array(*(F.regexp_extract(line, pattern, i + 1) for i in range(len(keys) + 1))))
