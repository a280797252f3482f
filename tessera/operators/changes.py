"""Set operations and change data (U*, C*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import in_ranges, kept, running


def multiset_difference(before: DataFrame, now: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key how many rows are missing now: ``keys, missing``."""
    counts = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("__b"))
    left = now.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    on = [counts[k].eqNullSafe(left[k]) for k in keys]
    gone = counts["__b"] - F.coalesce(left["__n"], F.lit(0))
    return counts.join(left, on, "left").select(*(counts[k] for k in keys), gone.alias("missing")).filter("missing > 0")


def resurrect(before: DataFrame, now: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first missing rows of each key, in order, to be appended again."""
    missing = multiset_difference(before, now, keys)
    hit = before.join(missing, list(keys))
    return hit.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r <= missing").drop("__r", "missing")


def delta(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, changed``: the fields of ``new`` that differ, as text by name; removed (null) ones are not recorded."""
    o = old.select(F.col(key).alias("__k"), *(F.col(f).alias(f"__o_{f}") for f in fields))
    pairs = [F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"__o_{f}")), F.struct(F.lit(f).alias("k"), F.col(f).cast("string").alias("v"))) for f in fields]
    changed = F.map_from_entries(F.array_compact(F.array(*pairs)))
    return new.join(o, F.col(key) == F.col("__k")).select(key, changed.alias("changed")).filter(F.size("changed") > 0)


def apply_delta(rows: DataFrame, changes: DataFrame, key: str, fields: Mapping[str, str], gaps_only: bool = False) -> DataFrame:
    """Changed fields laid over the rows; ``gaps_only`` fills only what is null or ''. ``fields``: name to type. One change per key."""
    c = changes.select(F.col(key).alias("__k"), "changed")
    out = rows.join(c, F.col(key) == F.col("__k"), "left")
    columns = []
    for name in rows.columns:
        if name not in fields:
            columns.append(F.col(name))
            continue
        new = F.try_element_at("changed", F.lit(name)).try_cast(fields[name])
        own = F.when(F.col(name).cast("string") != "", F.col(name))
        columns.append((F.coalesce(own, new, F.col(name)) if gaps_only else F.coalesce(new, F.col(name))).alias(name))
    return out.select(*columns)


def remove_one(rows: DataFrame, tombstones: DataFrame, keys: Sequence[str], order: Sequence[Column | str], row_id: str) -> DataFrame:
    """Each tombstone removes exactly one row, the first of its keys; repeated tombstones remove no more. ``row_id`` is unique,
    so running it again with the removed ids' tombstones marked as applied changes nothing."""
    dead = tombstones.select(*keys).distinct()
    hit = rows.join(dead, list(keys), "left_semi")
    first = hit.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").select(row_id)
    return rows.join(first, row_id, "left_anti").select(*rows.columns)


def move(rows: DataFrame, moves: DataFrame, keys: Sequence[str], target: Mapping[str, str], unique: Sequence[str]) -> DataFrame:
    """C4: rows whose keys are in ``moves`` get new partition values; a row is not moved where its ``unique`` columns are taken there,
    and none is created. ``target``: column to the column of ``moves`` that holds its new value."""
    m = moves.select(*keys, *(F.col(v).alias(f"__to_{c}") for c, v in target.items())).dropDuplicates(list(keys))
    there = rows.select(*(F.col(c).alias(f"__at_{c}") for c in target), *(F.col(u).alias(f"__u_{u}") for u in unique)).distinct().withColumn("__taken", F.lit(True))
    out = rows.join(m, list(keys), "left")
    on = [F.col(f"__to_{c}") == F.col(f"__at_{c}") for c in target] + [F.col(u) == F.col(f"__u_{u}") for u in unique]
    out = out.join(there, on, "left")
    goes = F.col("__taken").isNull()
    return out.select(*(F.coalesce(F.when(goes, F.col(f"__to_{c}")), F.col(c)).alias(c) if c in target else out[c] for c in rows.columns))


def reload(rows: DataFrame, fresh: DataFrame, partition: Sequence[str]) -> DataFrame:
    """The partitions that ``fresh`` has are replaced by it; loading it again changes nothing."""
    return rows.join(fresh.select(*partition).distinct(), list(partition), "left_anti").select(*rows.columns).unionByName(fresh)


def seed_absent(rows: DataFrame, bundled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the bundled rows whose keys are absent are added."""
    return rows.unionByName(bundled.join(rows.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns))


def patch(targets: DataFrame, rows: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with the values set where a target names them, targets that name no row)."""
    t = targets.select(*keys).distinct().withColumn("__hit", F.lit(True))
    out = rows.join(t, list(keys), "left")
    changed = out.select(*(F.when(F.col("__hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))
    return changed, targets.join(rows.select(*keys).distinct(), list(keys), "left_anti")


def ledger_balance(entries: DataFrame, group: str, order: str, amount: str, kind: str, undo: str = "undo") -> DataFrame:
    """What remains of a ledger whose entries of ``kind`` ``undo`` take back the last entry that still stands: ``group, standing, balance``.

    Matching undos to entries is matching brackets: an entry is taken back if, after it, the depth falls below its own. With the
    running depth as a sum it needs three scans along the order, each over ranges of the group, and no per-row state. An undo with nothing to take back has no effect.
    """
    along = [order]
    rows = in_ranges(entries.select(group, order, amount, kind), [group], along)
    rows = kept(running(rows, [group], along, F.when(F.col(kind) == undo, -1).otherwise(1), "__raw"))
    rows = running(rows, [group], along, F.col("__raw"), "__low", "min")
    rows = kept(rows.withColumn("__depth", F.col("__raw") - F.least(F.lit(0), F.col("__low"))))
    rows = running(rows, [group], along, F.col("__depth"), "__later", "min", forward=False, current=False)
    stands = (F.col(kind) != undo) & (F.coalesce(F.col("__later"), F.col("__depth")) >= F.col("__depth"))
    return rows.withColumn("__stands", stands).groupBy(group).agg(F.count(F.when(F.col("__stands"), 1)).alias("standing"), F.round(F.sum(F.when(F.col("__stands"), F.coalesce(F.col(amount), F.lit(0.0))).otherwise(0.0)), 4).alias("balance"))


def last_wins(layers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Of rows with the same keys the one of the last layer; one row per key within a layer."""
    union = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("__layer", F.lit(i))
        union = part if union is None else union.unionByName(part)
    columns = layers[0].columns
    return union.groupBy(*keys).agg(F.max_by(F.struct(*columns), "__layer").alias("__r")).select("__r.*")


def append_reference(rows: DataFrame, references: str, added: DataFrame, key: str, reference: str) -> DataFrame:
    """References of ``added`` (distinct) appended to each row's list unless present."""
    new = added.select(F.col(key).alias("__k"), F.col(reference).alias("__r")).distinct().groupBy("__k").agg(F.array_sort(F.collect_list("__r")).alias("__new"))
    out = rows.join(new, F.col(key) == F.col("__k"), "left")
    own = F.coalesce(F.col(references), F.array().cast(rows.schema[references].dataType))
    return out.withColumn(references, F.array_union(own, F.coalesce("__new", own))).drop("__k", "__new")


def recorded_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, deleted, changed``: a delta for every row that changed and a tombstone for every one that is gone, to be appended to a change table."""
    gone = old.join(new.select(key), key, "left_anti").select(key, F.lit(True).alias("deleted"), F.create_map().cast("map<string,string>").alias("changed"))
    return delta(old, new, key, fields).select(key, F.lit(False).alias("deleted"), "changed").unionByName(gone)


def append_changes(changes: DataFrame, path: str) -> None:
    """The change table is only ever appended to."""
    changes.write.mode("append").parquet(path)
