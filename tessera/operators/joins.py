"""Joins (J*): as-of, range, nearest, unique match, reconciliation, cascades, prefix and token joins."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import fold_sorted
from tessera.session import lookup_with_heavy, stored


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], bucket: Column) -> DataFrame:
    """``left`` with the ``values`` of the latest ``right`` row of the same keys at or before ``at``; nulls if there is none, or
    a key is null.

    Both sides have a column ``at``; ``bucket`` is a column over it that does not decrease with it. Rows are ordered
    within (keys, bucket) only; what earlier buckets hand over is found on one row per bucket. So a key that has a
    third of all rows is spread over its buckets.
    """
    value = F.struct(F.col(at).alias("__at"), *values)
    marks = right.dropna(subset=list(keys)).select(*keys, at, value.alias("__v")).withColumn("__b", bucket)
    rows = left.withColumn("__b", bucket).withColumn("__row", F.struct(*left.columns))
    both = marks.select(*keys, "__b", at, "__v", F.lit(None).cast(rows.schema["__row"].dataType).alias("__row")).unionByName(
        rows.select(*keys, "__b", at, F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"), "__row")
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(at, F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__v", F.last("__v", True).over(inside)).filter("__row is not null")
    per_bucket = both.groupBy(*keys, "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(at))).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(*keys, "__b", F.last("__last", True).over(earlier).alias("__carried"))
    out = seen.join(carried, [*keys, "__b"], "left")
    got = F.coalesce("__v", "__carried")
    return out.select("__row.*", *(got[v].alias(v) for v in values))


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], point: str, low: Column, high: Column, width: int) -> DataFrame:
    """Pairs of equal keys where low <= point <= high; ``point`` is a whole number of ``left``, low and high are of ``right``.

    Ranges are cut into cells of ``width`` and joined by cell, so no key's rows are all paired.
    """
    a = left.withColumn("__cell", F.floor(F.col(point) / width))
    b = right.withColumn("__low", low).withColumn("__high", high).withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))))
    return a.join(b, [*keys, "__cell"]).filter(F.col(point).between(F.col("__low"), F.col("__high"))).drop("__cell", "__low", "__high")


def unique_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of the keys that exactly one row of either side has."""

    def only(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*rest)).alias("__r")).filter("__n = 1").select(*keys, "__r.*")

    return only(left).join(only(right), list(keys))


def unique_suffix(names: DataFrame, name: str, suffixes: DataFrame, suffix: str, least: int, claimed: DataFrame | None = None) -> DataFrame:
    """Suffixes of at least ``least`` characters that end exactly one other distinct name that is not ``claimed`` (a column ``name``): ``suffix``, ``name``.

    Each name meets only the suffixes that end in its last ``least`` characters.
    """
    a = names.select(F.col(name).alias("name")).distinct().withColumn("__k", F.right("name", F.lit(least)))
    a = a if claimed is None else a.join(claimed.select("name"), "name", "left_anti")
    b = suffixes.select(F.col(suffix).alias("suffix")).filter(F.length(suffix) >= least).distinct().withColumn("__k", F.right("suffix", F.lit(least)))
    hits = a.join(b, "__k").filter(F.col("name").endswith(F.col("suffix")) & (F.col("name") != F.col("suffix")))
    return hits.groupBy("suffix").agg(F.count(F.lit(1)).alias("__n"), F.min("name").alias("name")).filter("__n = 1").drop("__n")


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], right_wins: Sequence[str] = ()) -> DataFrame:
    """Full outer join; a blank side yields, equal values stay, differing ones take the left unless named in
    ``right_wins`` and are listed in ``conflicts``. ``source``: both, left or right. One row per key on either side."""
    a = left.select(F.col(key).alias("__lk"), *(F.col(f).alias(f"__l_{f}") for f in fields))
    b = right.select(F.col(key).alias("__rk"), *(F.col(f).alias(f"__r_{f}") for f in fields))
    out = a.join(b, F.col("__lk") == F.col("__rk"), "full_outer")
    merged, conflicts = [], []
    for f in fields:
        x, y = (F.when(F.col(c).cast("string") != "", F.col(c)) for c in (f"__l_{f}", f"__r_{f}"))
        merged.append((F.coalesce(y, x) if f in right_wins else F.coalesce(x, y)).alias(f))
        side = "right" if f in right_wins else "left"
        conflicts.append(F.when(x != y, F.concat(F.lit(f"{f}: left="), x.cast("string"), F.lit(" right="), y.cast("string"), F.lit(f" -> {side}"))))
    source = F.when(F.col("__rk").isNull(), "left").when(F.col("__lk").isNull(), "right").otherwise("both")
    return out.select(F.coalesce("__lk", "__rk").alias(key), *merged, source.alias("source"), F.array_compact(F.array(*conflicts)).alias("conflicts"))


def authority_fold(authority: DataFrame, other: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Only blanks of the authority are filled; unmatched rows of both sides survive."""
    out = reconcile(authority, other, key, fields)
    return out.select(key, *fields, "source")


def cascade(rows: DataFrame, tiers: Sequence[tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    """``rows`` with ``target`` and ``tier`` of the first tier that names exactly one target for its keys; each tier is
    (candidates, key columns, target column). A key with several different targets is no match in its tier."""
    out = rows
    for i, (candidates, keys, target) in enumerate(tiers):
        unique = candidates.groupBy(*keys).agg(F.min(target).alias(f"__t{i}"), F.max(target).alias("__x")).filter(F.col(f"__t{i}") == F.col("__x")).drop("__x")
        out = out.join(unique, list(keys), "left")
    hits = [F.col(f"__t{i}") for i in range(len(tiers))]
    tier = F.coalesce(*(F.when(h.isNotNull(), F.lit(i + 1)) for i, h in enumerate(hits)))
    return out.select(*rows.columns, F.coalesce(*hits).alias("target"), tier.alias("tier"))


def correction_targets(corrections: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """``corrections`` (domain, id, name, book) with ``target`` (the ``item`` key) and ``tier``: the first item of the id in the stated domain, else of the only
    other domain that holds the id, else the only one of the name, in any case, and book. ``items``: domain, id, name, book."""
    named = items.filter("id is not null")
    stated = named.groupBy("domain", "id").agg(F.min(item).alias("target"))
    elsewhere = named.groupBy("id").agg(F.count_distinct("domain").alias("n"), F.min(item).alias("target")).filter("n = 1").drop("n")
    folded = F.lower(F.trim("name"))
    called = items.withColumn("__n", folded).groupBy("__n", "book").agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("target")).filter("n = 1").drop("n")
    rows = corrections.withColumn("__n", folded)
    return cascade(rows, [(stated, ["domain", "id"], "target"), (elsewhere, ["id"], "target"), (called, ["__n", "book"], "target")]).drop("__n")


def prefix_anti(names: DataFrame, name: str) -> DataFrame:
    """Distinct names whose words are no proper prefix of another's words."""
    words = names.select(F.col(name).alias("name")).distinct().withColumn("__w", F.split("name", " "))
    prefixes = words.filter(F.size("__w") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("__w") - 1), lambda n: F.array_join(F.slice("__w", 1, n), " "))).alias("name"))
    return words.select("name").join(prefixes.distinct(), "name", "left_anti")


def token_overlap(
    rows: DataFrame, key: str, tokens: Column, library: DataFrame, entry: str, entry_tokens: Column, least: int, context: Column | None = None, hot: int = 1000
) -> DataFrame:
    """The entry that shares most with each row: a token counts 1, with ``context`` tokens beside it 2, and those 1; a token must be shared and the score be
    ``least`` at least; ties: shorter, then smaller entry.

    A token that more than a ``hot``-th of the entries have pairs nothing by itself: rows and entries that share another token too, or a context one, meet by both; of the
    entries that share no more than it only the shortest can win, and that is known beforehand."""
    a = rows.select(F.col(key).alias("key"), F.array_distinct(tokens).alias("__a"), (F.array() if context is None else F.array_distinct(context)).cast("array<string>").alias("__x"))
    b = library.select(F.col(entry).alias("entry"), F.array_distinct(entry_tokens).alias("__b"))
    words = b.select("entry", F.explode("__b").alias("__t"))
    counted = words.groupBy("__t").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(F.length("entry").alias("l"), F.col("entry").alias("e"))).alias("__s"))
    common = counted.filter(F.col("__n") > max(100, b.count() // hot)).select("__t", F.col("__s.e").alias("__hot"))

    def blocks(df: DataFrame, beside: Column) -> DataFrame:
        each = df.withColumn("__t", F.explode(df.columns[1])).join(common, "__t", "left")
        pairs = F.transform(F.filter(beside, lambda t: t != F.col("__t")), lambda t: F.concat_ws("\0", F.array_sort(F.array(t, F.col("__t")))))
        return each.withColumn("__k", F.when(F.col("__hot").isNull(), F.array("__t")).otherwise(pairs))

    said = blocks(a, F.array_union("__a", "__x"))
    known = blocks(b, F.col("__b")).select("entry", F.explode("__k").alias("__k")).distinct()
    met = said.select("key", F.explode("__k").alias("__k")).join(known, "__k").select("key", "entry")
    met = met.unionByName(said.filter("__hot is not null").select("key", F.col("__hot").alias("entry"))).distinct()
    shared = lambda c: F.size(F.array_intersect(c, "__b"))
    weight = 1 if context is None else 2
    score = met.join(a, "key").join(b, "entry").withColumn("score", (shared("__a") * weight + shared("__x")).cast("bigint")).filter((shared("__a") > 0) & (F.col("score") >= least))
    return score.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.length("entry").alias("l"), F.col("entry").alias("e"))).alias("b")).select("key", F.col("b.e").alias("entry"), (-F.col("b.s")).alias("score"))


def margin_pages(hits: DataFrame, group: Sequence[str], page: str, margin: int = 1) -> DataFrame:
    """The pages of all hits and those around them, distinct, none under 1."""
    around = F.explode(F.sequence(F.greatest(F.lit(1), F.col(page) - margin), F.col(page) + margin))
    return hits.select(*group, around.alias(page)).distinct()


def merge_ordered(rows: DataFrame, key: str, order: str, stats: Sequence[str], exact: Sequence[str] = (), reprint: str | None = None) -> DataFrame:
    """Rows in order against what was accepted before: 'new' for the first of a key, 'reference' if they are the same as
    an accepted row (the first that is), else 'variant', which is accepted too. ``rows``, ``outcome``, ``matched``. Rows whose ``reprint`` is true are 'skipped': they are
    neither accepted nor matched.

    Two rows are the same if their ``exact`` columns (the price) are equal or both null and no two ``stats`` differ where both have one; that is no equivalence, so the fold
    is in order. Rows of equal stats share an outcome but for the first, so the fold sees each set of stats once, and compares it with those of its price only; keys never meet.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    again = F.coalesce(F.col(reprint), F.lit(False)) if reprint else F.lit(False)
    tagged = rows.withColumn("__sig", F.xxhash64(*map(shown, [*stats, *exact]))).withColumn("__again", again)
    price = F.to_json(F.struct(*(F.col(c).cast("string") for c in exact)), {"ignoreNullFields": "false"}) if exact else F.lit("")
    distinct = tagged.filter(~F.col("__again")).groupBy(key, "__sig").agg(F.min(order).alias("__first"), F.any_value(price).alias("__price"), *(F.any_value(F.col(s).cast("string")).alias(f"__s{i}") for i, s in enumerate(stats)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def start():
        accepted: dict[str, list[tuple]] = {}

        def step(row):
            own = row[4:]
            same = accepted.setdefault(row[3], [])
            hit = next((f for f, s in same if all(a is None or b is None or a == b for a, b in zip(own, s))), None)
            outcome = "reference" if hit is not None else "variant" if len(accepted) > 1 or same else "new"
            if hit is None:
                same.append((row[2], own))
            return [(*row[:3], outcome, hit if hit is not None else row[2])]

        return step, list

    folded = fold_sorted(distinct, [key], ["__first"], start, f"{key} {kinds[key]}, __sig bigint, __first {kinds[order]}, outcome string, matched {kinds[order]}")
    out = tagged.join(folded, [key, "__sig"], "left")
    outcome = F.when(F.col("__again"), F.lit("skipped")).when(F.col(order) == F.col("__first"), F.col("outcome")).otherwise(F.lit("reference"))
    return out.select(*rows.columns, outcome.alias("outcome"), F.when(~F.col("__again"), F.col("matched")).alias("matched"))


def nearest_in_reach(left: DataFrame, right: DataFrame, keys: Sequence[str], left_key: str, right_key: str, x: str, y: str, reach: float = 40.0) -> DataFrame:
    """``left_key, right_key, distance``: the nearest point of the right for each of the left with the same keys, closer than ``reach``; ties: smallest right key.

    Points meet by square cells of that size, the right ones put into the nine cells around theirs, so no page's points are all paired.
    """
    cell = lambda c, d=0: (F.floor(F.col(c) / reach) + d).cast("bigint")
    around = F.array(*(F.struct(cell(x, i).alias("cx"), cell(y, j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.select(*keys, F.col(left_key).alias("__l"), F.col(x).alias("__x"), F.col(y).alias("__y"), cell(x).alias("cx"), cell(y).alias("cy"))
    b = right.select(*keys, F.col(right_key).alias("__r"), F.col(x).alias("__u"), F.col(y).alias("__v"), F.explode(around).alias("c")).select(*keys, "__r", "__u", "__v", "c.*")
    distance = F.sqrt((F.col("__x") - F.col("__u")) * (F.col("__x") - F.col("__u")) + (F.col("__y") - F.col("__v")) * (F.col("__y") - F.col("__v")))
    near = a.join(b, [*keys, "cx", "cy"]).withColumn("d", distance).filter(F.col("d") < reach)
    return near.groupBy("__l").agg(F.min(F.struct("d", "__r")).alias("b")).select(F.col("__l").alias(left_key), F.col("b.__r").alias(right_key), F.col("b.d").alias("distance"))


def nearest_vectors(queries: DataFrame, rows: DataFrame, key: str, vector: str, block: int = 2048) -> DataFrame:
    """The row nearest to each query (not itself) by Euclidean distance; ties: smallest key. The stated queries meet all rows in blocks."""
    kind = rows.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), block):
                part = batch.iloc[s : s + block]
                yield pd.DataFrame({"ks": [part["k"].tolist()], "vs": [np.concatenate([np.asarray(v, "float64") for v in part["v"]])]})

    def packed(df: DataFrame, ks: str, vs: str) -> DataFrame:
        rows_ = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter("v is not null and size(v) > 0")
        return rows_.mapInPandas(pack, f"ks array<{kind}>, vs array<double>").toDF(ks, vs)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qk, qv, rk, rv in batch.itertuples(index=False):
                q, r = np.asarray(qv).reshape(len(qk), -1), np.asarray(rv).reshape(len(rk), -1)
                d = (q * q).sum(1)[:, None] + (r * r).sum(1)[None] - 2 * q @ r.T
                d[np.asarray(qk)[:, None] == np.asarray(rk)[None]] = np.inf
                at = d.argmin(1)
                exact = np.sqrt(((q - r[at]) ** 2).sum(1))
                found = np.isfinite(d[np.arange(len(at)), at])
                yield pd.DataFrame({"key": np.asarray(qk)[found], "distance": exact[found], "neighbour": np.asarray(rk)[at][found]})

    pairs = packed(queries, "qk", "qv").crossJoin(packed(rows, "rk", "rv"))
    near = pairs.mapInPandas(best, f"key {kind}, distance double, neighbour {kind}")
    return near.groupBy("key").agg(F.min(F.struct("distance", "neighbour")).alias("b")).select("key", "b.neighbour", "b.distance")


def weighted_evidence(branches: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """``keys, score``: the weights of all branches (keys, weight) added up, 1 at most."""
    union = branches[0]
    for b in branches[1:]:
        union = union.unionByName(b)
    return union.groupBy(*keys).agg(F.least(F.lit(1.0), F.round(F.sum("weight"), 6)).alias("score"))


#: Words that tell no title (the names of the series come as a parameter), and what each kind of evidence weighs.
TITLE_STOPWORDS = ("sixth", "world", "the", "of", "a", "an", "and", "core", "rulebook", "sourcebook", "book", "edition", "printing", "current", "6e", "pdf", "v1", "v2")
WEIGHTS = {"code": 0.90, "weaker code": 0.25, "metadata": 0.60, "cover": 0.35, "front": 0.45}


def title_words(text: Column, stopwords: Sequence[str] = TITLE_STOPWORDS) -> Column:
    """The distinct words of two letters or more that tell a title."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")), lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))


def identify(signals: DataFrame, file: str, registry: DataFrame, slug: str, order: str, series: Sequence[str] = ()) -> DataFrame:
    """``file, slug, score`` of the books each file may be, 1 at most. ``signals``: codes (map from code to weight), title, cover, text; ``registry``: title, cat and the
    ``order`` in which books are tried.

    The code of largest weight counts most, others little; the first title whose words are all in the file's metadata or on its cover counts; only where all that finds
    nothing does a title in the front matter, if no other is there. Titles meet files by their words, without those of the ``series``.
    """
    silent = (*TITLE_STOPWORDS, *series)
    plain = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.trim(F.replace(F.upper(c), F.lit("CAT"), F.lit(""))), "^0+", ""), F.lit("")), F.trim(F.replace(F.upper(c), F.lit("CAT"), F.lit(""))))
    books = registry.select(F.col(slug).alias("slug"), F.col(order).alias("o"), title_words(F.col("title"), silent).alias("tw"), plain(F.col("cat")).alias("cat"))
    by_code = books.filter("cat <> ''").groupBy("cat").agg(F.min_by("slug", "o").alias("slug"))
    codes = signals.select(F.col(file).alias("file"), F.array_max(F.map_values("codes")).alias("top"), F.explode("codes").alias("code", "w")).withColumn("cat", plain(F.col("code")))
    found = codes.join(by_code, "cat").select("file", "slug", F.when(F.col("w") == F.col("top"), WEIGHTS["code"]).otherwise(WEIGHTS["weaker code"]).alias("weight"))
    titles = books.filter(F.size("tw") > 0)
    words = titles.select("slug", "o", F.size("tw").alias("n"), F.explode("tw").alias("word"))

    def holding(column: str) -> DataFrame:
        said = signals.select(F.col(file).alias("file"), F.explode(title_words(F.col(column), silent)).alias("word"))
        return said.join(words, "word").groupBy("file", "slug", "o", "n").agg(F.count(F.lit(1)).alias("hits")).filter("hits = n")

    for column, kind in (("title", "metadata"), ("cover", "cover")):
        found = found.unionByName(holding(column).groupBy("file").agg(F.min_by("slug", "o").alias("slug")).select("file", "slug", F.lit(WEIGHTS[kind]).alias("weight")))
    front = holding("text").groupBy("file").agg(F.min("slug").alias("slug"), F.count(F.lit(1)).alias("n")).filter("n = 1").join(found.select("file").distinct(), "file", "left_anti")
    found = found.unionByName(front.select("file", "slug", F.lit(WEIGHTS["front"]).alias("weight")))
    return weighted_evidence([found], ["file", "slug"]).select(F.col("file").alias(file), F.col("slug").alias(slug), F.round("score", 2).alias("score"))


def claim_once(candidates: DataFrame, claimant: str, claimed: str, rank: Sequence[Column]) -> DataFrame:
    """Each claimant's best candidate; of those that want the same, the first by rank gets it, the others are duplicates. A null claims nothing."""
    candidates = candidates.filter(F.col(claimed).isNotNull())
    ranked = F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)), F.col(claimed).alias("c"))
    best = candidates.groupBy(claimant).agg(F.min(F.struct(ranked.alias("o"), F.struct(*candidates.columns).alias("row"))).alias("b")).select("b.o", "b.row.*")
    best = stored(best)
    place = F.struct(F.col("o"), F.col(claimant).alias("c"))
    first = best.groupBy(claimed).agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n"))
    # A thing that much of all rows claim meets no single task.
    out = lookup_with_heavy(best, first, [claimed], ["__first"], "__n", best.count(), F.xxhash64(claimant))
    return out.withColumn("outcome", F.when(F.col("__first") == place, "matched").otherwise("duplicate")).select(*candidates.columns, "outcome")


def ranked_lookup(rows: DataFrame, key: Column, library: DataFrame, tiers: Mapping[int, Column], value: str) -> DataFrame:
    """``rows`` with ``found``: of the library rows whose key equals in the best tier, the only ``value``; null if there
    are several. ``tiers``: rank to library key."""
    union = None
    for rank, k in tiers.items():
        part = library.select(k.alias("__k"), F.lit(rank).alias("__rank"), F.col(value).alias("__value"))
        union = part if union is None else union.unionByName(part)
    keyed = union.groupBy("__k", "__rank").agg(F.min("__value").alias("__lo"), F.max("__value").alias("__hi"))
    best = keyed.groupBy("__k").agg(F.min(F.struct("__rank", "__lo", "__hi")).alias("__b"))
    out = rows.withColumn("__k", key).join(best, "__k", "left")
    return out.withColumn("found", F.when(F.col("__b.__lo") == F.col("__b.__hi"), F.col("__b.__lo"))).drop("__k", "__b")
