"""Best representative of each duplicate group (problem 5).

Records are points in three dimensions, larger being better: completeness (how many fields are filled), recency (the day) and trust. The Pareto-undominated
ones of a group form its first layer, those undominated without it the second, and so on (``dominance_layers``). The surviving record takes
each field from the first layer that has a value; within a layer the policy orders lexicographically: trust, completeness, exact time, smallest row key
(``merged_records``).

Fields with a policy of their own (``survivors``: the longest description, the most trusted picture) are the skyline over the field's own
dimensions, ordered lexicographically by the policy. A lexicographic maximum is never dominated, so for these the skyline only leaves fewer candidates.

Hot groups: ``survivors`` first reduces points by a map-side combined aggregate that keeps, per group, field and first
dimension, the best rest of the point; the skyline is then found by one ordered pass with a running maximum. ``merged_records``
reduces records map-side to their distinct points, of which a group has at most (fields + 1) x (levels of trust) x (days in the calendar), however many
rows it has; layers are found by one ordered fold over these that keeps one number for each completeness and trust.

Defined results
- Groups of one row give nothing. Null group keys are a group as any other.
- A null dimension is the smallest. Ties on all dimensions go to the smallest row key.
- A row repeated with the same key counts as another row of its group, but cannot be picked twice.
- Sets (sources) are united over the group; each distinct element gives one row.
- A field that no record of the group fills is null, and so is the row it came from. Empty and blank texts count as not filled if ``fields`` maps them to null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import fold_sorted


def skyline(points: DataFrame, group: Sequence[str], first: str, second: str) -> DataFrame:
    """``points`` without those that another of the group dominates in (first, second).

    The points of a group are passed once, ordered by ``first`` and ``second`` descending; what has been seen before has no
    smaller ``first``, so a point is dominated exactly if it is below the running maximum of ``second``, or equals it
    while that came with a larger ``first``.
    """
    order = Window.partitionBy(*group).orderBy(F.col(first).desc_nulls_last(), F.col(second).desc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct(F.col(second).alias("s"), F.col(first).alias("f"))).over(before)
    out = points.withColumn("__best", best)
    tie = F.col("__best.s").eqNullSafe(F.col(second))
    above = F.col("__best.s").isNull() | (F.col(second) > F.col("__best.s"))
    dominated = F.col("__best").isNotNull() & ~F.coalesce(above & F.col(second).isNotNull(), F.lit(False)) & ~(tie & F.col("__best.f").eqNullSafe(F.col(first)))
    return out.filter(~dominated).drop("__best")


def survivors(
    df: DataFrame, group: Sequence[str], row_key: str, fields: Mapping[str, tuple[Column, Column, Column]], sets: Mapping[str, Column]
) -> DataFrame:
    """``group..., field, pick``: for each group of two or more rows the row key picked for each field, or each set element.

    ``fields``: name to (eligible, first dimension, second dimension), the policy being that order and then the
    smallest row key; the first dimension must be a bigint. ``sets``: name to an array of texts to unite.
    """
    no_text = F.lit(None).cast("string")

    def entry(field: str, d1: Column, d2: Column, key: Column, element: Column) -> Column:
        return F.struct(
            F.lit(field).alias("field"), d1.cast("bigint").alias("d1"), d2.cast("timestamp").alias("d2"), key.alias("key"), element.alias("element")
        )

    nothing = F.lit(None)

    def elements_of(name: str) -> Callable[[Column], Column]:
        return lambda x: entry(name, nothing, nothing, F.col(row_key), x)

    entries = [F.array(entry("", nothing, nothing, F.col(row_key), no_text))]
    for name, (eligible, d1, d2) in fields.items():
        entries.append(F.when(eligible, F.array(entry(name, d1, d2, F.col(row_key), no_text))))
    for name, values in sets.items():
        entries.append(F.transform(F.array_distinct(values), elements_of(name)))
    empty = F.filter(entries[0], lambda x: F.lit(False))
    candidates = df.select(*group, F.explode(F.concat(*(F.coalesce(e, empty) for e in entries))).alias("e")).select(*group, "e.*")
    # The best rest of a point for each first dimension: latest second, then smallest key, in flat columns that combine map-side.
    reduced = candidates.groupBy(*group, "field", "d1", "element").agg(
        F.max(F.struct(F.col("d2"), (-F.col("key")).alias("minus_key"))).alias("rest"), F.count(F.lit(1)).alias("n")
    )
    rows = F.sum(F.when(F.col("field") == "", F.col("n"))).over(Window.partitionBy(*group))
    counted = reduced.withColumn("__rows", rows).filter((F.col("__rows") > 1) & (F.col("field") != "")).select(*group, "field", "d1", "element", F.col("rest.d2").alias("d2"), (-F.col("rest.minus_key")).alias("key"))
    part = [*group, "field", "element"]
    policy = Window.partitionBy(*part).orderBy(F.col("d1").desc_nulls_last(), F.col("d2").desc_nulls_last(), "key")
    picked = skyline(counted, part, "d1", "d2").withColumn("__rank", F.row_number().over(policy)).filter("__rank = 1")
    return picked.select(*group, "field", F.coalesce("element", F.col("key").cast("string")).alias("pick"))


def dominance_layers(points: DataFrame, group: str, completeness: str, day: str, trust: str) -> DataFrame:
    """``group, completeness, day, trust, layer`` of distinct points (bigint, not null): 1 for the undominated ones, else one more than the largest layer of
    those that dominate the point."""
    kind = points.schema[group].dataType.simpleString()

    def start():
        best: dict[tuple[int, int], int] = {}  # (completeness, trust) to the largest layer so far

        def step(row: tuple) -> list[tuple]:
            # Rows come by day, completeness and trust descending: what dominates a point has passed before it.
            g, c, d, t = row
            layer = 1 + max((n for (c2, t2), n in best.items() if c2 >= c and t2 >= t), default=0)
            best[c, t] = layer
            return [(g, c, d, t, layer)]

        return step, list

    rows = points.select(group, completeness, day, trust)
    order = [F.col(day).desc(), F.col(completeness).desc(), F.col(trust).desc()]
    return fold_sorted(rows, [group], order, start, f"{group} {kind}, {completeness} bigint, {day} bigint, {trust} bigint, layer bigint")


def merged_records(df: DataFrame, group: Sequence[str], row_key: str, fields: Mapping[str, Column], trust: Column, at: Column) -> DataFrame:
    """``group..., copies, layers`` and for each field its value and ``<field>_row``, the row it comes from: one record for each group of two or more.

    ``fields``: name to value, null if not filled; ``trust``: larger is better; ``at``: a timestamp. ``row_key`` must be a bigint.
    """
    filled = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in fields.values()), F.lit(0))
    rows = df.select(
        F.to_json(F.struct(*(F.col(g) for g in group)), {"ignoreNullFields": "false"}).alias("__g"), *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)),
        F.col(row_key).alias("__row"), filled.cast("bigint").alias("__c"), F.coalesce(F.unix_date(F.to_date(at)).cast("bigint"), F.lit(-(1 << 40))).alias("__d"),
        F.coalesce(trust.cast("bigint"), F.lit(-1)).alias("__t"), F.unix_micros(at).alias("__at"), *(v.alias(f"__v{i}") for i, v in enumerate(fields.values())),
    )
    keys = [f"__g{i}" for i in range(len(group))]
    late = F.struct((-F.coalesce(F.col("__at"), F.lit(-(1 << 60)))).alias("a"), F.col("__row").alias("r"))
    by_point = rows.groupBy("__g", *keys, "__c", "__d", "__t").agg(
        F.count(F.lit(1)).alias("__n"), *(F.min(F.when(F.col(f"__v{i}").isNotNull(), F.struct(late.alias("o"), F.col(f"__v{i}").alias("v")))).alias(f"__b{i}") for i in range(len(fields)))
    )
    copies = F.sum("__n").over(Window.partitionBy("__g"))
    points = by_point.withColumn("copies", copies).filter("copies > 1")
    layers = dominance_layers(points, "__g", "__c", "__d", "__t")
    ranked = points.join(layers, ["__g", "__c", "__d", "__t"])
    order = F.struct(F.col("layer").alias("l"), (-F.col("__t")).alias("t"), (-F.col("__c")).alias("c"))
    picks = [F.min(F.when(F.col(f"__b{i}").isNotNull(), F.struct(order.alias("p"), F.col(f"__b{i}.o").alias("o"), F.col(f"__b{i}.v").alias("v")))).alias(f"__b{i}") for i in range(len(fields))]
    out = ranked.groupBy("__g", *keys).agg(F.max("copies").alias("copies"), F.max("layer").alias("layers"), *picks)
    values = [x for i, f in enumerate(fields) for x in (F.col(f"__b{i}.v").alias(f), F.col(f"__b{i}.o.r").alias(f"{f}_row"))]
    return out.select(*(F.col(k).alias(g) for k, g in zip(keys, group)), "copies", "layers", *values)
