"""Duplicates hidden by formatting differences (problem 2).

Records are JSON objects. Every (field, kind, value) is dictionary-encoded: each distinct value is canonicalised once,
each distinct canonical value gets an integer, records become sorted integer tuples, and the tuples are grouped.
The dictionary is written to the shared checkpoint folder, so an identifier stays what it is if an executor is lost. Texts of more than
``LONG`` characters count by their SHA-256, and values meet their identifiers by 128 bits of hash, so neither the broadcast of hot values nor a shuffle of records carries texts.
Values and groups that hold much of all rows are looked up in a bounded broadcast (``lookup_with_heavy``), the rest by
a shuffle join, so no hot value or group meets one task.

Defined results
- Texts compare without case, whitespace, punctuation and symbols: only letters and digits (Unicode L and N) count;
  ß equals ss.
- Numbers compare by value (2, 2.0 and 2e0 are equal, so are 1e20 and its integer) as exact decimals of any size; those with an exponent or more
  than 38 digits are first read as doubles. A text never equals a number; true, false and null equal themselves; a nested array or object compares as its text. A field with null differs from an absent field.
- A null payload, or one that is no JSON object (or repeats a key), belongs to no group. ``{}`` equals ``{}``.
- Rows repeated with the same key and payload count once. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import lookup_with_heavy, stored


LONG = 256


def short(text: Column) -> Column:
    """A text itself, or its digest if it is long; the two can't be mistaken for each other."""
    return F.when(F.length(text) > LONG, F.concat(F.lit("\x00"), F.sha2(text, 256))).otherwise(text)


def canonical_value(kind: Column, value: Column) -> Column:
    """Canonical text of a value; ``kind``: s(tring), n(umber), x (anything else)."""
    text = F.translate(F.replace(F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]+", "")), F.lit("ß"), F.lit("ss")), "ς", "σ")
    return F.when(kind == "s", text).when(kind == "n", canonical_number(value)).otherwise(value)


def canonical_number(value: Column) -> Column:
    """Sign, digits without zeros at either end, and the exponent of the last one; of a number in JSON's form."""
    fraction = F.regexp_extract(value, r"\.(\d+)", 1)
    exponent = F.coalesce(F.regexp_extract(value, r"[eE]\+?(-?\d+)$", 1).try_cast("bigint"), F.lit(0))
    digits = F.ltrim(F.concat(F.regexp_extract(value, r"^-?(\d+)", 1), fraction), F.lit("0"))
    shown = F.rtrim(digits, F.lit("0"))
    last = exponent - F.length(fraction) + F.length(digits) - F.length(shown)
    return F.when(shown == "", F.lit("0")).otherwise(F.concat(F.when(value.startswith("-"), F.lit("-")).otherwise(F.lit("")), shown, F.lit("e"), last.cast("string")))


def named(*columns: Column | str) -> list[Column]:
    """``h1, h2``: 128 bits of hash that stand for the columns in joins, so that texts are neither shuffled nor sorted."""
    return [F.xxhash64(F.lit(i), *columns).alias(f"h{i}") for i in (1, 2)]


def record_fields(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key, digest, field, kind, value``: one row per field of each record, and one of kind r per record; ``digest`` stands for the payload."""
    parsed = df.select(F.col(key).alias("key"), F.xxhash64(payload).alias("digest"), F.try_parse_json(F.col(payload)).alias("v"))
    one = parsed.filter(F.schema_of_variant("v").startswith("OBJECT"))
    fields = F.col("v").cast("map<string,variant>")
    entries = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value"))), F.map_entries(fields)
    )
    exploded = one.select("key", "digest", F.explode(entries).alias("e")).select("key", "digest", F.col("e.key").alias("field"), F.col("e.value").alias("v"))
    kind = F.schema_of_variant("v")
    code = F.when(kind == "STRING", F.lit("s")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit("n")).otherwise(F.lit("x"))
    text = F.when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json("v")).otherwise(F.col("v").try_cast("string"))
    return exploded.select("key", "digest", F.coalesce("field", F.lit("")).alias("field"), F.when(F.col("field").isNull(), F.lit("r")).otherwise(code).alias("kind"), F.coalesce(text, F.lit("null")).alias("value"))


def dictionary(entries: DataFrame) -> DataFrame:
    """``h1, h2, n, id``: the identifier of each distinct value (field, kind, short form); equal canonical values share it."""
    long = F.when(F.length("value") > LONG, F.col("value"))
    values = entries.select("field", "kind", short(F.col("value")).alias("look"), long.alias("long")).groupBy("field", "kind", "look", "long").agg(F.count(F.lit(1)).alias("n"))
    canon = short(canonical_value(F.col("kind"), F.coalesce("long", "look"))).alias("canon")
    coded = stored(values.select(*named("field", "kind", "look"), "n", "field", "kind", canon).select("h1", "h2", "n", *(c.alias(f"c{i}") for i, c in enumerate(named("field", "kind", "canon"), 1))))
    ids = stored(coded.select("c1", "c2").distinct().withColumn("id", F.monotonically_increasing_id()))
    return stored(coded.join(ids, ["c1", "c2"]).select("h1", "h2", "n", "id"))


def encoded_records(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key, tuple``: each record as the sorted identifiers of its fields; a row repeated with the same key and payload counts once."""
    entries = record_fields(df, key, payload)
    coded = dictionary(entries)
    total = coded.agg(F.sum("n")).first()[0] or 0
    looked = entries.select("key", "digest", *named("field", "kind", short(F.col("value"))))
    rows = lookup_with_heavy(looked, coded, ["h1", "h2"], ["id"], "n", total, F.xxhash64("key"))
    return rows.groupBy("key", "digest").agg(F.array_sort(F.collect_set("id")).alias("tuple")).select("key", "tuple")


def same_but_for_format(df: DataFrame, key: str, payload: str, alone: bool = False) -> tuple[DataFrame, DataFrame]:
    """(groups: ``first, copies``; members: ``first, key``) of the records equal but for their format.

    ``alone``: also records that have no equal.
    """
    records = stored(encoded_records(df, key, payload))
    groups = records.groupBy("tuple").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    if not alone:
        groups = groups.filter("copies > 1")
    members = lookup_with_heavy(records, groups, ["tuple"], ["first"], "copies", records.count(), F.xxhash64("key"))
    return groups.select("first", "copies"), members.select("first", "key")
