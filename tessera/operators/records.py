"""Operators on nested and semi-structured records: overlays, coercion, pruning, inheritance, sums along trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.folds import fold_sorted


def overlay(base: Column, over: Column) -> Column:
    """A map with the entries of another laid over it; null maps are empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    kept = F.map_filter(F.coalesce(base, empty), lambda k, v: ~F.map_contains_key(F.coalesce(over, empty), k))
    return F.map_concat(kept, F.coalesce(over, empty))


def tagged(value: Column) -> Column:
    """a text as the one of (bool, int, number, text) that it reads as."""
    v = F.trim(value)
    boolean = F.when(F.lower(v).isin("true", "false"), F.lower(v) == "true")
    whole = F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("bigint"))
    number = F.when(whole.isNull() & v.rlike(r"^[+-]?\d*\.\d+$"), v.try_cast("double"))
    text = F.when(boolean.isNull() & whole.isNull() & number.isNull(), value)
    return F.struct(boolean.alias("bool"), whole.alias("int"), number.alias("number"), text.alias("text"))


def pivot_rows(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """one row per ``row`` with one column per stated kind; the smallest value where several meet. Stated kinds need no pass to find them."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.min(value))


def typed_list(items: Column, kinds: Mapping[str, Sequence[str]]) -> Column:
    """'attribute', 'skill', ... if all options are of one kind, 'mixed' if of several; unknown ones don't count; null if none is known."""
    found = F.array_compact(F.array(*(F.when(F.arrays_overlap(items, F.array(*map(F.lit, names))), F.lit(kind)) for kind, names in kinds.items())))
    return F.when(F.size(found) == 1, F.get(found, 0)).when(F.size(found) > 1, F.lit("mixed"))


def routed(kind: Column, table: Mapping[str, tuple[str, str]], domain: Column, category: Column) -> Column:
    """(domain, category) by a table of kinds, else what they are."""
    domains = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v[0]))])
    categories = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v[1]))])
    return F.struct(F.coalesce(F.try_element_at(domains, kind), domain).alias("domain"), F.coalesce(F.try_element_at(categories, kind), category).alias("category"))


def grouped_effects(df: DataFrame, key: str, target: str, value: str, choice: Column) -> DataFrame:
    """Modifiers to at most two effects per key, those that leave a choice apart: ``key, effect, changes`` (target=value, sorted)."""
    rows = df.withColumn("effect", F.when(choice, "choice").otherwise("fixed")).withColumn("__c", F.concat_ws("=", target, F.col(value).cast("string")))
    return rows.groupBy(key, "effect").agg(F.array_sort(F.collect_set("__c")).alias("changes"))


def ancestor_sums(nodes: DataFrame, key: str, amount: Column, pool: Column, skip: Sequence[str]) -> DataFrame:
    """``key, pool, total``: amounts of the nodes of each tree by pool; what lies under a node with a tag in ``skip``, or is one, does not count.

    ``nodes`` is a node table (key, node_no, parent_no, tag, ...). Parents come before their children in document order, so one ordered pass
    knows the skipped nodes; it keeps their numbers for the tree at hand only.
    """
    kind = nodes.schema[key].dataType.simpleString()
    skipped = frozenset(skip)
    rows = nodes.select(key, "node_no", "parent_no", "tag", pool.cast("string").alias("pool"), amount.cast("double").alias("__a"))

    def start():
        dead: set = set()

        def step(row):
            _, number, parent, tag, name, value = row
            if tag in skipped or parent in dead:
                dead.add(number)
                return []
            return [(row[0], name, value)] if name is not None and value is not None else []

        return step, list

    kept = fold_sorted(rows, [key], ["node_no"], start, f"{key} {kind}, pool string, __a double")
    return kept.groupBy(key, "pool").agg(F.sum("__a").alias("total"))


def inherit(children: DataFrame, parents: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """every child takes its parent's fields where its own are null. ``parents`` is unique on ``on``."""
    p = parents.select(*on, *(F.col(f).alias(f"__p_{f}") for f in fields))
    out = children.join(p, list(on), "left")
    return out.select(*(F.coalesce(F.col(c), F.col(f"__p_{c}")).alias(c) if c in fields else F.col(c) for c in children.columns))


def pruned_json(value: Column, keys: Sequence[str]) -> Column:
    """A flat JSON object without the stated keys, in its order."""
    parsed = F.from_json(value, "map<string,string>")
    return F.map_filter(parsed, lambda k, v: ~k.isin(list(keys)))


def owned_only_by(books: Column, others: Sequence[str]) -> Column:
    """P20: some book is named, and all of them are among ``others``."""
    return F.coalesce((F.size(books) > 0) & (F.size(F.array_except(books, F.array(*map(F.lit, others)))) == 0), F.lit(False))


def mapped(df: DataFrame, f: Callable[[dict], dict], schema: str) -> DataFrame:
    """``f`` on every row as a dict, in parallel, with the row's columns kept out: the schema's columns and ``error``, which holds the message where it raised."""
    names = [p.strip().split(" ")[0] for p in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    got = f(row)
                    out.append((*(got.get(n) for n in names), None))
                except Exception as e:  # noqa: BLE001 - one bad row must not end the run
                    out.append((*(None for _ in names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[*names, "error"])

    return df.mapInPandas(run, f"{schema}, error string")
