"""Ordered-data operators (L*): sessions, fills, captures, bands, state carried along lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import fold_sorted
from tessera.operators.ordered import RANGE, in_ranges, kept, last_known, numbered, running


def _measure(df: DataFrame, order: str) -> Column:
    """The order column as a number: seconds for timestamps."""
    kind = df.schema[order].dataType.simpleString()
    return F.col(order).cast("timestamp").cast("double") if kind.startswith("timestamp") else F.col(order).cast("double")


def gap_sessions(df: DataFrame, keys: Sequence[str], order: str, gap: Column) -> DataFrame:
    """L2: ``session`` counts from 1; a new one starts where the distance to the previous row, in seconds for timestamps, exceeds ``gap``."""
    rows = last_known(in_ranges(df.withColumn("__at", _measure(df, order)), keys, [order]), keys, [order], {"__before": "__at"}, current=False)
    return running(kept(rows), keys, [order], F.when(F.col("__at") - F.col("__before") > gap, 1).otherwise(0), "__new").select(*df.columns, (F.col("__new") + 1).alias("session"))


def anchor_groups(df: DataFrame, keys: Sequence[str], order: str, limit: float, key_column: str) -> DataFrame:
    """L1: ``group`` counts from 1; a new one starts where the distance to the FIRST row of the current one exceeds ``limit``.

    Only (keys, order, row key) are carried through the sequential pass. A gap above the limit always starts a group, so
    the pass runs per stretch between such gaps, not per key; stretches are found along ranges of the key. A key without such gaps is one stretch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    measured = df.select(*keys, key_column, _measure(df, order).alias("__at"))
    along = ["__at", key_column]
    before = last_known(in_ranges(measured, keys, along), keys, along, {"__before": "__at"}, current=False)
    stretches = running(kept(before), keys, along, F.when(F.col("__at") - F.col("__before") > limit, 1).otherwise(0), "__stretch").drop("__before", RANGE)

    def start():
        state = {"group": 0, "start": None}

        def step(row):
            at_ = row[-1]
            if state["start"] is None or at_ - state["start"] > limit:
                state["group"], state["start"] = state["group"] + 1, at_
            return [(*row[: len(keys) + 2], state["group"])]

        return step, list

    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + f", __stretch bigint, {key_column} {kinds[key_column]}, __g int"
    local = fold_sorted(stretches.select(*keys, "__stretch", key_column, "__at"), [*keys, "__stretch"], ["__at", key_column], start, schema)
    per = local.groupBy(*keys, "__stretch").agg(F.max("__g").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = per.select(*keys, "__stretch", before.alias("__o"))
    numbered = local.join(offset, [*keys, "__stretch"]).select(*keys, key_column, (F.col("__g") + F.col("__o")).cast("bigint").alias("group"))
    return df.join(numbered, [*keys, key_column])


def bucket_lines(df: DataFrame, keys: Sequence[str], y: str, x: str, text: str, height: float = 3.0) -> DataFrame:
    """L3: words of one bucket of y (rounded half to even) joined in order of x: ``keys, line, text``."""
    line = F.bround(F.col(y) / height).cast("bigint").alias("line")
    words = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).alias("t"))))
    return df.groupBy(*keys, line).agg(F.array_join(F.transform(words, lambda w: w["t"]), " ").alias("text"))


def assign_bands(rows: DataFrame, x: str, bands: DataFrame, start: str, keys: Sequence[str] = (), slack: float = 1.0) -> DataFrame:
    """L4: the band [start - slack, next start - slack) that holds x, the first band if x lies before it. Bands of a key are few (columns of a table)."""
    ordered = bands.groupBy(*keys).agg(F.array_sort(F.collect_set(start)).alias("__bands"))
    out = rows.join(ordered, list(keys)) if keys else rows.crossJoin(ordered)
    within = F.filter("__bands", lambda b: b - slack <= F.col(x))
    return out.withColumn("band", F.greatest(F.size(within) - 1, F.lit(0))).drop("__bands")


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Null values take the last one before them."""
    new = {f"__f{i}": c for i, c in enumerate(values)}
    filled = last_known(in_ranges(df, keys, order), keys, order, new)
    return filled.select(*(F.col(f"__f{values.index(c)}").alias(c) if c in values else F.col(c) for c in df.columns))


def fill_backward(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Null values take the first one after them."""
    new = {f"__f{i}": c for i, c in enumerate(values)}
    filled = last_known(in_ranges(df, keys, order), keys, order, new, forward=False)
    return filled.select(*(F.col(f"__f{values.index(c)}").alias(c) if c in values else F.col(c) for c in df.columns))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line`` of every text, from 0."""
    return df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def capture(lines: DataFrame, key: str, order: str, starts: Column, stops: Column, most: int | None = None) -> DataFrame:
    """Lines after each start up to the next stop or start, ``most`` of them at most: ``key, anchor, `` and the line's columns."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("__start", F.when(starts, F.col(order))).withColumn("__stop", F.when(stops, F.col(order)))
    marked = marked.withColumn("anchor", F.last("__start", True).over(upto)).withColumn("__last_stop", F.last("__stop", True).over(upto))
    inside = F.col("anchor").isNotNull() & (F.col(order) > F.col("anchor")) & (F.col("__last_stop").isNull() | (F.col("__last_stop") <= F.col("anchor")))
    out = marked.filter(inside).drop("__start", "__stop", "__last_stop")
    return out if most is None else out.filter(F.col(order) - F.col("anchor") <= most)


def merge_wrapped(lines: DataFrame, key: str, order: str, text: str, opens: Column) -> DataFrame:
    """A line that opens no record is glued to the record before it: ``key, record, text``. Lines before the first are record 0."""
    n = F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(text).alias("t")))), lambda x: x["t"]), " ")
    return lines.withColumn("record", n).groupBy(key, "record").agg(joined.alias("text"))


def labelled_fields(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """L18, L35, L40: 'Label: text' opens a field, lines that start small continue it, any other line ends it: ``key, field_no, label, text``."""
    label = F.nullif(F.regexp_extract(line, r"^([A-Z][A-Za-z ]{0,30}):", 1), F.lit(""))
    w = Window.partitionBy(key).orderBy(order)
    marked = lines.withColumn("__label", label).withColumn("__low", F.coalesce(F.col(line).rlike("^[a-z]"), F.lit(False)))
    marked = marked.withColumn("__breaks", F.when(F.col("__label").isNull() & ~F.col("__low"), 1).otherwise(0))
    marked = marked.withColumn("__part", F.sum(F.when(F.col("__label").isNotNull() | (F.col("__breaks") == 1), 1).otherwise(0)).over(w)).withColumn("field_no", F.sum(F.when(F.col("__label").isNotNull(), 1).otherwise(0)).over(w))
    body = F.trim(F.regexp_replace(F.col(line), r"^[A-Z][A-Za-z ]{0,30}:", ""))
    grouped = marked.groupBy(key, "__part", "field_no").agg(F.max("__label").alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.when(F.col("__label").isNotNull(), body).otherwise(F.trim(line)).alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return grouped.filter("label is not null").select(key, "field_no", "label", "text")


def labelled_spans(text: Column, labels: Sequence[str]) -> Column:
    """Each label located once; the value runs to the next label: map from label to text."""
    found = F.filter(F.array(*(F.struct(F.locate(f"{x}:", text).alias("at"), F.lit(x).alias("label")) for x in labels)), lambda f: f["at"] > 0)
    ordered = F.array_sort(found)
    ends = F.transform(ordered, lambda f, i: F.coalesce(F.get(ordered, i + 1)["at"], F.length(text) + 1))
    return F.map_from_entries(F.zip_with(ordered, ends, lambda f, e: F.struct(f["label"], F.trim(F.substr(text, f["at"] + F.length(f["label"]) + 1, e - f["at"] - F.length(f["label"]) - 1)))))


def only_known(text: Column, known: Sequence[str]) -> Column:
    """The only known word of a text of five words at most, else null."""
    words = F.split(F.lower(F.trim(text)), r"\s+")
    hits = F.array_distinct(F.filter(words, lambda w: w.isin([k.lower() for k in known])))
    return F.when((F.size(words) <= 5) & (F.size(hits) == 1), F.get(hits, 0))


def contents(lines: DataFrame, key: str, order: str, line: str, most: int = 2000) -> DataFrame:
    """L21: 'Title ..... 12' entries: ``key, title, page``; the first of a title wins."""
    pattern = r"^\s*(.+?)\s*(?:\.{2,}|\s{3,})\s*(\d+)\s*$"
    entries = lines.select(key, order, F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).alias("title"), F.regexp_extract(line, pattern, 2).try_cast("int").alias("page"))
    kept = entries.filter(F.col("title").isNotNull() & F.col("page").between(1, most))
    return kept.groupBy(key, "title").agg(F.min_by("page", order).alias("page"))


def zip_halves(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of both halves joined by their position within the keys; the longer half's rest is kept."""
    a = numbered(left, keys, [order], "row_no").drop(order)
    b = numbered(right, keys, [order], "row_no").drop(order)
    return a.join(b, [*keys, "row_no"], "full_outer")
