import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.llm import representative
from tessera.llm.representative import merged_records, skyline, survivors

SCHEMA = "g string, id bigint, size bigint, at timestamp, trust int, tags array<string>, field string, pick string"


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def run(spark, rows):
    df = spark.createDataFrame([(g, i, s, day(a), t, tags, "f", "p") for g, i, s, a, t, tags in rows], SCHEMA)
    out = survivors(df, ["g"], "id", {"size": (F.col("size") > 0, F.col("size"), F.col("at")), "trust": (F.col("trust").isNotNull(), F.col("trust"), F.col("at"))}, {"tags": F.col("tags")})
    return sorted(((r["g"] or "", r["field"], r["pick"]) for r in out.collect()))


def brute(rows):
    out, groups = set(), {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for g, rs in groups.items():
        if len(rs) < 2:
            continue
        key = lambda v: lambda r: (-v(r), -(r[3] if r[3] is not None else -1), r[1])
        if c := [r for r in rs if r[2] and r[2] > 0]:
            out.add((g or "", "size", str(min(c, key=key(lambda r: r[2]))[1])))
        if c := [r for r in rs if r[4] is not None]:
            out.add((g or "", "trust", str(min(c, key=key(lambda r: r[4]))[1])))
        out |= {(g or "", "tags", t) for r in rs for t in r[5] or []}
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None, "lone" + str(i)]), i, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, 0, 1, 2]), rng.choice([None, 0, 1]), rng.choice([None, [], ["x"], ["x", "y", "x"]])) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_hot_group_and_empty(spark):
    rows = [("hot", i, i % 7, i % 5, i % 3, ["t"]) for i in range(4000)] + [(f"g{i // 2}", i, 1, 0, 0, None) for i in range(4000, 4100)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_skyline_keeps_exactly_the_undominated(spark):
    rng = random.Random(4)
    points = [("g", i, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, 0, 1, 2, 3])) for i in range(60)]
    v = lambda x: -1 if x is None else x
    want = {p[1] for p in points if not any((v(q[2]) >= v(p[2]) and v(q[3]) >= v(p[3])) and (v(q[2]) > v(p[2]) or v(q[3]) > v(p[3])) for q in points)}
    df = spark.createDataFrame(points, "g string, id int, a int, b int")
    assert {r["id"] for r in skyline(df, ["g"], "a", "b").collect()} == want


REC = "g string, id bigint, a string, b string, c bigint, trust int, at timestamp, layers int, copies string"


def records(rng, n, groups="ab"):
    pick = lambda *v: rng.choice(v)
    return [(pick(*groups, None), i, pick(None, "x", "y"), pick(None, "z"), pick(None, 2**60 + i), pick(None, 0, 1, 2), day(pick(None, 0, 1, 2, 3)), 0, "k") for i in range(n)]


def merge(spark, rows):
    df = spark.createDataFrame(rows, REC)
    out = merged_records(df, ["g"], "id", {c: F.col(c) for c in "abc"}, F.col("trust"), F.col("at"))
    return {r["g"]: (r["copies"], r["layers"], *((r[c], r[f"{c}_row"]) for c in "abc")) for r in out.collect()}


def merge_brute(rows):
    v = lambda x: -1 if x is None else x
    out = {}
    for g in {r[0] for r in rows}:
        rs = [r for r in rows if r[0] == g]
        point = {r[1]: (sum(x is not None for x in r[2:5]), -1 if r[6] is None else (r[6] - dt.datetime(2000, 1, 1)).days, v(r[5])) for r in rs}
        left, layer, n = dict(point), {}, 0
        while left:  # onion peeling
            n += 1
            first = [i for i, p in left.items() if not any(q != p and all(a >= b for a, b in zip(q, p)) for q in left.values())]
            layer |= dict.fromkeys(first, n)
            for i in first:
                del left[i]
        rank = lambda r: (layer[r[1]], -v(r[5]), -point[r[1]][0], -(r[6].timestamp() if r[6] else -1e18), r[1])  # noqa: B023, E731
        if len(rs) > 1:
            out[g] = (len(rs), n, *((best[k], best[1]) if (best := min((r for r in rs if r[k] is not None), key=rank, default=None)) else (None, None) for k in (2, 3, 4)))
    return out


def test_merged_records_match_peeling(spark):
    rng = random.Random(11)
    for n in (1, 2, 7, 60):
        rows = records(rng, n)
        assert merge(spark, rows) == merge_brute(rows)
    assert merge(spark, []) == {}


def test_layers_decide(spark, monkeypatch):
    """The trusted record that another dominates gives way to a less trusted one of the first layer, which without layers it would not."""
    rows = [
        ("g", 1, "x", None, None, 2, day(5), 0, ""), ("g", 2, None, "of the first layer", 7, 1, day(3), 0, ""), ("g", 3, None, "of a later layer", None, 2, day(4), 0, ""),
    ]
    assert merge(spark, rows) == merge_brute(rows) and merge(spark, rows)["g"][3] == ("of the first layer", 2)
    layers = representative.dominance_layers
    monkeypatch.setattr(representative, "dominance_layers", lambda *a: layers(*a).withColumn("layer", F.lit(1).cast("bigint")))
    assert merge(spark, rows)["g"][3] == ("of a later layer", 3)


def test_hot_group_is_merged_by_points(spark):
    rng = random.Random(12)
    rows = records(rng, 6000, "a")
    got, want = merge(spark, rows), merge_brute(rows[:0])
    points = {(sum(x is not None for x in r[2:5]), r[6], r[5]) for r in rows if r[0] == "a"}
    assert set(got) == {"a", None} and want == {} and got["a"][0] == sum(r[0] == "a" for r in rows) and got["a"][1] <= len(points)
    assert got["a"][2:] == tuple((r[k], r[1]) for k in (2, 3, 4) for r in [min((x for x in rows if x[0] == "a" and None not in x[2:5] and x[5] == 2 and x[6] == day(3)), key=lambda x: x[1])])
