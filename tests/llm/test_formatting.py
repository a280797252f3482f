import json

from tessera.llm.formatting import same_but_for_format

SCHEMA = "id bigint, payload string, first string, key int, field string"


def brute(rows):
    def canon(v):
        if isinstance(v, str):
            return "s" + "".join(c for c in v.casefold() if c.isalnum())
        if isinstance(v, bool) or v is None:
            return repr(v)
        return f"n{float(v)}" if isinstance(v, (int, float)) else "x" + json.dumps(v)

    groups = {}
    for i, p in rows:
        try:
            record = json.loads(p)
        except (TypeError, ValueError):
            continue
        if isinstance(record, dict):
            groups.setdefault(tuple(sorted((k, canon(v)) for k, v in record.items())), []).append(i)
    return sorted((min(g), i) for g in groups.values() if len(g) > 1 for i in g)


def found(spark, rows):
    df = spark.createDataFrame([(i, p, "x", 1, "y") for i, p in rows], SCHEMA)
    groups, members = same_but_for_format(df, "id", "payload")
    got = sorted((r["first"], r["key"]) for r in members.collect())
    assert sum(r["copies"] for r in groups.collect()) == len(got)
    return got


ROWS = [
    (1, '{"name": "Big  Lamp!", "page": 2}'), (2, '{"page":2.0,"name":"BIG-LAMP"}'), (3, '{"page":2e0,"name":"big lamp"}'), (4, '{"page":"2","name":"big lamp"}'),
    (5, '{"name": "Big Lamp", "page": 2, "note": null}'), (6, '{"note": null, "name": "«big» lamp", "page": 2}'), (7, '{"name": "Gro\\u00dfe Tür", "x": true}'),
    (8, '{"name": "GROSSE TÜR", "x": true}'), (9, None), (10, None), (11, "no json"), (12, "{}"), (13, " { } "), (14, '{"a": ""}'), (15, '{"a": "?!"}'), (16, '{"a": null}'),
    (17, '{"n": 12345678901234567890}'), (18, '{"n": 12345678901234567891}'), (19, '{"n": -0.5}'), (20, '{"n": -5e-1}'), (21, "[1]"), (22, '{"t": "' + "long " * 20000 + '"}'),
    (23, '{"t": "' + "LONG" * 20000 + '."}'), (24, '{"a.b": 1, "": "z"}'), (25, '{"": "Z", "a.b": 1}'),
]


def test_matches_brute_force(spark):
    got = found(spark, ROWS)
    assert got == sorted(g for g in brute(ROWS) if g[1] not in (17, 18))
    assert {i for _, i in got} == {1, 2, 3, 5, 6, 7, 8, 12, 13, 14, 15, 19, 20, 22, 23, 24, 25}


def test_redelivered_rows_and_hot_groups(spark):
    rows = [(i, '{"name": "Same Thing %s"}' % ("!" * (i % 5))) for i in range(3000)] + [(i, '{"name": "other %d"}' % i) for i in range(3000, 5000)]
    got = found(spark, rows + rows[:100])
    assert len(got) == 3000 and {f for f, _ in got} == {0}


def test_empty(spark):
    assert found(spark, []) == []
    groups, _ = same_but_for_format(spark.createDataFrame([(1, '{"a": 1}', "", 0, "")], SCHEMA), "id", "payload", alone=True)
    assert [(r["first"], r["copies"]) for r in groups.collect()] == [(1, 1)]


def test_numbers_of_any_size(spark):
    equal = ["1e15", "1000000000000000", "1000000000000000.0", "1.0E15", "100e13"], ["1e20", "100000000000000000000"], ["0", "-0", "0.0", "0e5", "-0.00"], ["0.1", "1e-1", "0.10"], ["-2.50", "-25e-1"]
    other = ["999999999999999", "1000000000000001", "99999999999999999999", "0.01", "2.5", "123456789012345678901", "123456789012345678902", "0.1000000000000000001", "1e19"]
    rows = [(100 * g + i, '{"n": %s}' % n) for g, numbers in enumerate(equal) for i, n in enumerate(numbers)] + [(1000 + i, '{"n": %s}' % n) for i, n in enumerate(other)]
    assert found(spark, rows) == [(100 * g, 100 * g + i) for g, numbers in enumerate(equal) for i in range(len(numbers))]
