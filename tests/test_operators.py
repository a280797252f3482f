import itertools
import random

from pyspark.sql import functions as F

from tessera.functions import parse
from tessera.operators import aggregates, changes, headings, joins, kernels, quality, ranking, sequence
from tessera.plans import catalogue


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def test_as_of_before_on_and_after(spark):
    left = spark.createDataFrame([("a", 0), ("a", 5), ("a", 7), ("a", 25), ("b", 9), (None, 3)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 6, "y"), ("c", 1, "z")], "k string, t int, v string")
    out = joins.as_of(left, right, ["k"], "t", ["v"], F.floor(F.col("t") / 10))
    assert rows(out) == [("a", 0, None), ("a", 25, "y"), ("a", 5, "x"), ("a", 7, "y"), ("b", 9, None), (None, 3, None)]
    assert joins.as_of(left.limit(0), right, ["k"], "t", ["v"], F.floor(F.col("t") / 10)).count() == 0


def test_range_join_bounds_are_inclusive(spark):
    left = spark.createDataFrame([("a", x) for x in (-11, 9, 10, 20, 21)], "k string, p int")
    right = spark.createDataFrame([("a", 10, 20, "r"), ("b", 0, 99, "s")], "k string, lo int, hi int, name string")
    assert rows(joins.range_join(left, right, ["k"], "p", F.col("lo"), F.col("hi"), 7), "p", "name") == [(10, "r"), (20, "r")]


def test_unique_matches_refuse_ambiguity(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3), ("z", 4)], "k string, a int")
    b = spark.createDataFrame([("x", 10), ("y", 20), ("z", 30), ("z", 31)], "k string, b int")
    assert rows(joins.unique_match(a, b, ["k"])) == [("x", 1, 10)]
    names = spark.createDataFrame([("red lamp",), ("blue lamp",), ("iron torch",)], "n string")
    ends = spark.createDataFrame([("lamp",), ("torch",), ("ron torch",), ("ch",)], "s string")
    assert rows(joins.unique_suffix(names, "n", ends, "s", 4)) == [("ron torch", "iron torch"), ("torch", "iron torch")]


def test_reconcile_and_cascade(spark):
    left = spark.createDataFrame([(1, "a", ""), (2, "b", "x"), (3, None, "q")], "k int, f string, g string")
    right = spark.createDataFrame([(1, "c", "y"), (2, "b", "z"), (4, "d", None)], "k int, f string, g string")
    out = joins.reconcile(left, right, "k", ["f", "g"], right_wins=["g"])
    assert rows(out) == [(1, "a", "y", "both", ["f: left=a right=c -> left"]), (2, "b", "z", "both", ["g: left=x right=z -> right"]), (3, None, "q", "left", []), (4, "d", None, "right", [])]
    base = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "a string, b string")
    t1 = spark.createDataFrame([("p", 10), ("q", 20), ("q", 21)], "a string, id int")
    t2 = spark.createDataFrame([("2", 30), ("1", 31)], "b string, id int")
    assert rows(joins.cascade(base, [(t1, ["a"], "id"), (t2, ["b"], "id")])) == [("p", "1", 10, 1), ("q", "2", 30, 2), ("r", "3", None, None)]


def test_merge_is_an_ordered_fold(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("ab"), rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for i in range(80)]
    accepted, want = {}, []
    for i, k, p, t in data:
        hit = next((j for j, s in accepted.setdefault(k, []) if all(u is None or v is None or u == v for u, v in zip(s, (p, t)))), None)
        want.append((i, "reference" if hit is not None else "variant" if accepted[k] else "new", hit if hit is not None else i))
        if hit is None:
            accepted[k].append((i, (p, t)))
    df = spark.createDataFrame(data, "i int, k string, p int, t string")
    assert sorted(map(tuple, joins.merge_ordered(df, "k", "i", ["p", "t"]).select("i", "outcome", "matched").collect())) == want


def test_nearest_vectors_match_brute_force(spark):
    rng = random.Random(5)
    data = [(i, [rng.random() for _ in range(4)]) for i in range(60)] + [(60, None), (61, [])]
    df = spark.createDataFrame(data, "id int, v array<double>")
    got = {r["key"]: r["neighbour"] for r in joins.nearest_vectors(df.filter("id % 10 = 0"), df, "id", "v", block=7).collect()}
    real = data[:60]
    want = {i: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in real if j != i)[1] for i, v in real if i % 10 == 0}
    assert got == want


def test_token_overlap_prefix_claims(spark):
    a = spark.createDataFrame([(1, "red iron lamp"), (2, "none")], "id int, t string")
    b = spark.createDataFrame([("iron lamp",), ("red lamp",), ("lamp iron oil",)], "e string")
    assert rows(joins.token_overlap(a, "id", F.split("t", " "), b, "e", F.split("e", " "), 1)) == [(1, "red lamp", 2)]
    assert rows(joins.prefix_anti(spark.createDataFrame([("a",), ("a b",), ("ab",), ("a b c",), ("a b",)], "n string"), "n")) == [("a b c",), ("ab",)]
    c = spark.createDataFrame([("f1", "x", 2), ("f2", "x", 1), ("f1", "y", 9)], "f string, b string, r int")
    assert rows(joins.claim_once(c, "f", "b", [F.col("r")]), "f", "b", "outcome") == [("f1", "x", "duplicate"), ("f2", "x", "matched")]


def test_modes_votes_and_fills(spark):
    v = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("a", "y", 5), ("a", "x", 4), ("b", "z", 0)], "g string, v string, o int")
    assert rows(aggregates.mode_first(v, ["g"], "v", F.col("o"))) == [("a", "y", 2), ("b", "z", 1)]
    q = spark.createDataFrame([("a", "x")] * 4 + [("a", "y")] * 2 + [("b", "x")] * 4 + [("b", "y")] * 3 + [("c", "x")] * 2 + [("d", None)], "g string, v string")
    assert rows(aggregates.quorum(q, ["g"], "v")) == [("a", 6, 4, "x"), ("b", 7, 4, None), ("c", 2, 2, None)]
    m = spark.createDataFrame([("g", {"a": "1"}), ("g", {"b": "2"}), ("h", None)], "g string, f map<string,string>")
    assert rows(aggregates.field_union_fill(m, ["g"], "f", ["z"])) == [("g", {"a": "", "b": "2", "z": ""}), ("g", {"a": "1", "b": "", "z": ""}), ("h", {"z": ""})]
    floor = spark.createDataFrame([("a", 100)], "g string, n int")
    assert rows(aggregates.high_water(spark.createDataFrame([("a", 97), ("b", 1)], "g string, n int"), floor, ["g"], ["n"])) == [("a", 97, False, 100), ("b", 1, True, 1)]


def test_free_ids_match_probing(spark):
    rng = random.Random(3)
    taken = {f"{b}{s}" for b in "abc" for s in ("", "_2", "_3", "_5", "_x", "_1") if rng.random() < 0.6}
    data = [(i, rng.choice("abcd")) for i in range(40)]
    used, want = set(taken), []
    for i, b in data:
        new = next(n for n in itertools.chain([b], (f"{b}_{k}" for k in itertools.count(2))) if n not in used)
        used.add(new)
        want.append((i, new))
    got = ranking.free_ids(spark.createDataFrame(data, "i int, b string"), "b", ["i"], spark.createDataFrame([(t,) for t in sorted(taken)] or [("q",)], "t string"), "t")
    assert sorted(map(tuple, got.select("i", "new_id").collect())) == want


def test_better_text_is_a_fold(spark):
    data = [("g", 1, "x" * 100, "2020-01"), ("g", 2, "x" * 90, "2021-01"), ("g", 3, "x" * 80, "2022-01"), ("h", 4, None, "2020"), ("h", 5, "a", None), (None, 6, "b", "1")]
    out = ranking.better_text_fold(spark.createDataFrame(data, "g string, o int, t string, d string"), "g", "o", "t", "d")
    assert rows(out) == [("g", 3, 80), ("h", 5, 1), (None, 6, 1)]


def test_natural_order_and_rules(spark):
    names = ["Lamp 10", "Lamp 9", "Lamp 2b", "Lamp 2a"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.orderBy(ranking.natural_key(F.col("n"))).collect()] == ["Lamp 2a", "Lamp 2b", "Lamp 9", "Lamp 10"]
    assert rows(df.select(ranking.first_match([(F.col("n").contains("1"), "one"), (F.col("n").contains("2"), "two")]).alias("k"))) == [("one",), ("two",), ("two",), (None,)]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, n string, v int")
    new = spark.createDataFrame([(1, "a", 6), (2, None, 7), (3, "c", 1)], "k int, n string, v int")
    d = changes.delta(old, new, "k", ["n", "v"])
    assert rows(d) == [(1, {"v": "6"}), (2, {"v": "7"})]
    assert rows(changes.apply_delta(old, d, "k", {"n": "string", "v": "int"})) == [(1, "a", 6), (2, "b", 7)]
    assert rows(changes.apply_delta(old, d, "k", {"n": "string", "v": "int"}, gaps_only=True)) == [(1, "a", 5), (2, "b", 7)]
    r = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, k string")
    dead = spark.createDataFrame([("x",), ("x",), ("q",)], "k string")
    assert rows(changes.remove_one(r, dead, ["k"], ["id"], "id")) == [(2, "x"), (3, "y")]
    assert rows(changes.multiset_difference(r, spark.createDataFrame([("x",)], "k string"), ["k"])) == [("x", 1), ("y", 1)]
    assert rows(changes.resurrect(r, spark.createDataFrame([("x",)], "k string"), ["k"], ["id"]), "id") == [(1,), (3,)]
    fresh = spark.createDataFrame([(9, "x")], "id int, k string")
    once = changes.reload(r, fresh, ["k"])
    assert rows(changes.reload(once, fresh, ["k"])) == rows(once) == [(3, "y"), (9, "x")]
    moves = spark.createDataFrame([("x", "z")], "k string, to string")
    assert rows(changes.move(spark.createDataFrame([(1, "x"), (2, "x"), (2, "z")], "id int, k string"), moves, ["k"], {"k": "to"}, ["id"])) == [(1, "z"), (2, "x"), (2, "z")]


def test_ledger_matches_a_stack(spark):
    rng = random.Random(8)
    data = [(rng.choice("ab"), i, float(rng.randint(1, 9)), rng.choice(["add", "add", "undo"])) for i in range(200)]
    want = {}
    for g, _, v, kind in data:
        stack = want.setdefault(g, [])
        if kind == "undo":
            if stack:
                stack.pop()
        else:
            stack.append(v)
    got = changes.ledger_balance(spark.createDataFrame(data, "g string, i int, v double, k string"), "g", "i", "v", "k")
    assert rows(got) == sorted((g, len(s), round(sum(s), 4)) for g, s in want.items())


def test_anchors_differ_from_gaps(spark):
    data = [("a", i, float(t)) for i, t in enumerate([0, 2, 4, 6, 20, 22])] + [("b", 9, 0.0)]
    df = spark.createDataFrame(data, "k string, id int, t double")
    assert rows(sequence.gap_sessions(df, ["k"], "t", F.lit(3.0)), "id", "session") == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (9, 1)]
    assert rows(sequence.anchor_groups(df, ["k"], "t", 3.0, "id"), "id", "group") == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (9, 1)]


def test_segmenter_and_components(spark):
    split = kernels.segmenter({"the": 50, "iron": 5, "lamp": 5, "a": 9})
    assert split("theironlamp") == ["the", "iron", "lamp"]
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = kernels.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b")
    assert rows(got) == sorted(((n, find(n)) for n in parent), key=repr)


def test_segments_with_the_whole_vocabulary(spark):
    def spelt(i):
        return "".join(chr(97 + i // 26**p % 26) for p in range(4))

    long = "pneumonoultramicroscopicsilico"
    rare = [("zzyxo", 1), ("wqkvu", 1), (long, 3), ("t", 40)]
    words = [("the", 1_000_000)] + [(f"{spelt(i)}q", 2) for i in range(50_000)] + rare
    vocabulary = spark.createDataFrame(words, "word string, n long")
    texts = [(1, "Thezzyxowqkvu"), (2, f"the{long}the, THEZZYXO"), (3, None), (4, "..."), (5, "Thezzyxowqkvu"), (6, "thet"), (7, "")]
    got = rows(kernels.demangle(spark.createDataFrame(texts, "id int, name string"), "id", "name", vocabulary), "id", "text")
    assert got == [(1, "The zzyxo wqkvu"), (2, f"the {long} the, THE ZZYXO"), (3, None), (4, "..."), (5, "The zzyxo wqkvu"), (6, "the t"), (7, "")]
    split = kernels.segmenter(dict(words))
    assert [" ".join(split(t)) for t in ("thezzyxowqkvu", f"the{long}the", "thet")] == ["the zzyxo wqkvu", f"the {long} the", "the t"]
    none = spark.createDataFrame([], "word string, n long")
    assert rows(kernels.demangle(spark.createDataFrame([(1, "Iron lamp")], "id int, name string"), "id", "name", none), "id", "text") == [(1, "Iron lamp")]


def test_mangled_names_are_mended(spark):
    said = """prosthetic cyberlimb crude generic custom clean metabolism adapsin therapy radiation tolerance neurochemical regulator high altitude adaptation
    matrix defense suite aluminum titanium exoframe exhalation spray strength increase enhanced movement good times chill btl toxin resistance specific"""
    cases = {
        "Cleanm etabolism": "Clean Metabolism", "AdapsinTh erapy": "Adapsin Therapy", "RadiationTo lerance": "Radiation Tolerance", "EnhancedMo vement": "Enhanced Movement",
        "ProstheticCy berlimb,Cr ude": "Prosthetic Cyberlimb, Crude", "ToxinRe sistance(s pecific)": "Toxin Resistance (Specific)", "ChillB TL": "Chill BTL",
        "StrengthIn crease": "Strength Increase", "Matrix Defense Suite": "Matrix Defense Suite", "MatrixDe fense - Su ite 2/Cr ude [cl ean]": "Matrix Defense - Suite 2 / Crude [Clean]",
        "4x Cl ean": "4x Cl ean", "": "", " - ": "-",
    }
    vocabulary = spark.createDataFrame([(w, 3) for w in said.split()], "word string, n long")
    names = spark.createDataFrame([*cases.items(), (None, None)], "raw string, wanted string").withColumn("id", F.col("wanted"))
    assert [r for r in rows(kernels.demangle_names(names, "id", "raw", vocabulary)) if r[0] != r[1]] == []


def test_held_out_texts_are_segmented(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    texts = [" ".join(words[min(int(rng.expovariate(0.01)), 399)] for _ in range(12)) for _ in range(300)]
    known = spark.createDataFrame([(t,) for t in texts[:250]], "text string")
    held = spark.createDataFrame([(i, t.replace(" ", "")) for i, t in enumerate(texts[250:])], "id int, text string")
    got = dict(rows(kernels.demangle(held, "id", "text", aggregates.word_counts(known, "text"))))
    assert sum(got[i] == t for i, t in enumerate(texts[250:])) >= 45


def test_reload_keeps_and_replaces_partitions(spark, tmp_path):
    data = [(1, "O", 5.0, "1-URGENT", "2000-01-01"), (2, "O", 6.0, "1-URGENT", "1994-01-01"), (3, "F", 7.0, "5-LOW", "2000-01-01"), (4, "F", 8.0, "2-HIGH", "1993-01-01"), (5, "P", 9.0, None, "2000-01-01")]
    orders = spark.createDataFrame(data, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string, o_orderdate string")
    orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).write.parquet(str(tmp_path / "orders.parquet"))
    got = rows(catalogue.QUERIES["reloaded_priorities"](spark, str(tmp_path)))
    assert got == [(1, "X", 5.0), (3, "F", 7.0), (4, "F", 8.0), (5, "P", 9.0)]


def test_nested_packs_end_at_cycles(spark):
    e = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("r", "x"), ("x", "y")], "p string, c string")
    assert rows(kernels.expand_nested(spark.createDataFrame([("r",)], "root string"), "root", e, "p", "c"), "member") == [("b",), ("y",)]


def test_quality_report(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, "")], "id int, n string")
    issues = quality.row_issues(df, ["id"], quality.schema_rules(df, {"n": "int"}, ["n"]))
    assert rows(issues, "id", "rule") == [(2, "type:n"), (3, "required:n")]
    assert rows(quality.report(issues, ["type:n", "required:n", "other"]), "rule", "ok", "n") == [("other", True, 0), ("required:n", False, 1), ("type:n", False, 1)]


def test_sequences(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["Kind: lamp", "of iron", "Price: 5", "Prose here", "more"])], "k string, i int, line string")
    assert rows(sequence.labelled_fields(lines, "k", "i", "line")) == [("d", 1, "Kind", "lamp of iron"), ("d", 2, "Price", "5")]
    assert rows(sequence.merge_wrapped(lines, "k", "i", "line", F.col("line").contains(":")), "record", "text") == [(1, "Kind: lamp of iron"), (2, "Price: 5 Prose here more")]
    assert rows(sequence.capture(lines, "k", "i", F.col("line").startswith("Kind"), F.col("line").startswith("Prose"), 3), "line") == [("Price: 5",), ("of iron",)]
    assert rows(sequence.contents(spark.createDataFrame([("d", 1, "Lamps ..... 12"), ("d", 2, "Lamps .... 99"), ("d", 3, "no entry")], "k string, i int, line string"), "k", "i", "line")) == [("d", "Lamps", 12)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, id int, t double")
    assert sequence.gap_sessions(e, ["k"], "t", F.lit(1.0)).count() == sequence.anchor_groups(e, ["k"], "t", 1.0, "id").count() == 0
    assert kernels.connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
    assert joins.merge_ordered(e, "k", "id", ["t"]).count() == 0 and ranking.better_text_fold(e, "k", "id", "k", "k").count() == 0


def test_headings_refuse_ambiguity(spark):
    from tessera.operators.headings import anchored_rows, heading_matches

    names = spark.createDataFrame([(1, "Iron Lamp", "b", 10), (2, "Iron Lamp Stand", "b", 11), (3, "Old Oil Torch", "b", 12), (4, "New Oil Torch", "b", 13), (5, "Silver Lantern", "b", 90), (6, "Acme Copper Kettle", "b", 10)], "id int, name string, g string, p int")
    lines = spark.createDataFrame([(1, "IRON LAMPS", "b", 12), (2, "oil torch", "b", 12), (3, "Silver Lantern", "b", 12), (4, "Iron Lamp St", "b", 11), (5, "Copper Kettle", "b", 10), (6, "Iron Lamp", "c", 10), (7, "", "b", 1), (8, None, "b", 1)], "lid int, line string, g string, p int")
    out = heading_matches(lines, "line", "lid", names, "name", "id", "g", "p")
    assert rows(out) == [(1, 1, "full"), (4, 2, "prefix"), (5, 6, "tail")]
    shown = spark.createDataFrame([("g", 1, "Iron Lamp 1,250¥"), ("g", 2, "Oil 1250"), ("g", 3, "9")], "g string, o int, line string")
    assert rows(anchored_rows(spark.createDataFrame([(7, "g", 1250), (8, "g", 77)], "id int, g string, price int"), "id", "price", shown, "line", "o", "g")) == [(7, "Iron Lamp")]


def test_nearest_free_matches_brute_force(spark):
    from tessera.operators.headings import nearest_free

    rng = random.Random(6)
    points = [(rng.choice("ab"), rng.randint(0, 300) + i / 1000, i) for i in range(60)]
    targets = [(rng.choice("ab"), rng.randint(0, 300) + i / 1000 + 0.0005, i) for i in range(60)]
    free, want = list(targets), []
    for g, at, p in sorted(points, key=lambda x: (x[0], x[1])):
        near = [t for t in free if t[0] == g and abs(t[1] - at) < 15]
        if near:
            hit = min(near, key=lambda t: (abs(t[1] - at), t[1]))
            free.remove(hit)
            want.append((g, p, hit[2]))
    got = nearest_free(spark.createDataFrame(points, "k string, at double, p int"), spark.createDataFrame(targets, "k string, at double, t int"), ["k"], "at", "p", "t", 15.0)
    assert rows(got) == sorted(want, key=repr)


def test_records(spark):
    from tessera.operators import records

    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}), (None, {"x": "y"}), ({"k": "v"}, None)], "b map<string,string>, o map<string,string>")
    assert [r[0] for r in df.select(records.overlay(F.col("b"), F.col("o"))).collect()] == [{"a": "1", "b": "3", "c": None}, {"x": "y"}, {"k": "v"}]
    t = spark.createDataFrame([("TRUE",), (" 7",), ("-2.5",), ("x1",), (None,)], "v string")
    assert [tuple(r[0]) for r in t.select(records.tagged(F.col("v"))).collect()] == [(True, None, None, None), (None, 7, None, None), (None, None, -2.5, None), (None, None, None, "x1"), (None, None, None, None)]
    bad = records.mapped(t.filter("v is not null"), lambda r: {"n": int(r["v"])}, "n bigint")
    assert sorted((r["n"] is None, r["error"] is None) for r in bad.collect()) == [(False, True), (True, False), (True, False), (True, False)]
    nodes = spark.createDataFrame([(1, 0, -1, "a", 5), (1, 1, 0, "choice", 7), (1, 2, 1, "b", 9), (1, 3, 2, "b", 9), (1, 4, 0, "b", 2), (2, 0, -1, "b", 1)], "t int, node_no bigint, parent_no bigint, tag string, n int")
    assert rows(records.ancestor_sums(nodes, "t", F.col("n"), F.col("tag"), ["choice"])) == [(1, "a", 5.0), (1, "b", 2.0), (2, "b", 1.0)]
    c = spark.createDataFrame([("x", None), ("x", "own"), ("q", None)], "p string, f string")
    assert rows(records.inherit(c, spark.createDataFrame([("x", "up")], "p string, f string"), ["p"], ["f"])) == [("q", None), ("x", "own"), ("x", "up")]


def test_glyph_lines_meet_no_join(spark):
    """The median is taken on the line itself: nothing to broadcast, however many lines, and glyphs of a line without a key stay."""
    from tessera.operators import layout

    data = [(k, i * 5.0, i * 5.0 + 4.5, h, c) for k in (1, 2, None) for h in (10.0 if k else 60.0,) for i, c in enumerate("iron lamp") if c != " "]
    got = layout.words_from_glyphs(spark.createDataFrame(data, "l int, a double, b double, h double, c string"), ["l"], "a", "b", "h", "c")
    assert rows(got) == [(1, 1, "iron"), (1, 2, "lamp"), (2, 1, "iron"), (2, 2, "lamp"), (None, 1, "ironlamp")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_layout(spark):
    from tessera.operators import layout

    glyphs = spark.createDataFrame([(1, i * 5.0, i * 5.0 + 4.5, 10.0, c) for i, c in enumerate("iron lamp") if c != " "] + [(2, 0.0, 1.0, 10.0, "x")], "l int, a double, b double, h double, c string")
    assert rows(layout.words_from_glyphs(glyphs, ["l"], "a", "b", "h", "c")) == [(1, 1, "iron"), (1, 2, "lamp"), (2, 1, "x")]
    lines = spark.createDataFrame([(1, "Lamp 2d6 1,000¥ bright"), (2, "prose only"), (3, "Big Lamp 3D6+1 –")], "i int, t string")
    assert rows(layout.parse_rows(lines, "t", {"dmg": "dice", "cost": "money"}, tail=True), "name", "dmg", "cost", "rest") == [("Big Lamp", "3D6+1", "–", ""), ("Lamp", "2d6", "1,000¥", "bright")]
    t = spark.createDataFrame([("p", i, x) for i, x in enumerate(["7 8 before", "HEAD", "Lamp 5 6", "no numbers", "HEAD", "Torch 9 1 2"])], "k string, i int, t string")
    out = layout.table_rows(t, ["k"], "i", "t", F.col("t") == "HEAD", 2, 3)
    assert rows(out, "header_at", "cells") == [(1, ["Lamp", "5", "6"]), (4, ["Torch", "9", "1"])]
    assert rows(layout.rows_after(t, ["k"], "i", F.col("t") == "HEAD"), "t") == [("Lamp 5 6",), ("Torch 9 1 2",)]
    s = t.select(layout.trailing_stats(F.col("t"), 2).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in s] == [None, None, ("Lamp", ["5", "6"]), None, None, ("Torch", ["9", "1", "2"])]


def test_running_numbers_over_buckets(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "b", None]), i) for i in range(200)]
    want, seen = [], {}
    for k, i in data:
        seen[k] = seen.get(k, 0) + 1
        want.append((k, i, seen[k]))
    df = spark.createDataFrame(data, "k string, i int")
    assert rows(ranking.running_number(df, ["k"], ["i"], F.floor(F.col("i") / 17))) == sorted(want, key=repr)
    got = ranking.suffixed_ids(df.filter("k is not null"), "k", ["i"], bucket=F.floor(F.col("i") / 17))
    assert rows(got) == rows(ranking.suffixed_ids(df.filter("k is not null"), "k", ["i"]))


def test_folds_keep_large_integers(spark):
    """Integers above 2^53 pass beside nulls as they are."""
    from tessera.operators.folds import fold_sorted

    rows = [("a", 9007199254740993), ("a", None), ("a", 9007199254740995), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    out = fold_sorted(df, ["k"], ["v"], lambda: ((lambda row: [(row[0], row[1])]), list), "k string, v bigint")
    assert sorted((r["k"], r["v"] or 0) for r in out.collect()) == sorted((k, v or 0) for k, v in rows)


def test_unique_suffix_with_claims(spark):
    names = spark.createDataFrame([("nolan bistro chrome",), ("nolan big bistro chrome",), ("river comet ex",), ("lindner river comet ex",)], "n string")
    ends = spark.createDataFrame([("bistro chrome",), ("river comet ex",), ("x",)], "s string")
    claimed = spark.createDataFrame([("nolan big bistro chrome",)], "name string")
    assert rows(joins.unique_suffix(names, "n", ends, "s", 8)) == [("river comet ex", "lindner river comet ex")]
    assert rows(joins.unique_suffix(names, "n", ends, "s", 8, claimed)) == [("bistro chrome", "nolan bistro chrome"), ("river comet ex", "lindner river comet ex")]


def test_correction_targets(spark):
    items = spark.createDataFrame([(1, "gear", "a", "Lamp", "b1"), (2, "gear", "a", "Lamp II", "b1"), (3, "spells", "b", "Torch", "b1"), (4, "gear", "c", "X", "b1"), (5, "spells", "c", "Y", "b1"), (6, "gear", "d", "Rope", "b1"), (7, "gear", "e", "Rope", "b1"), (8, "gear", None, "Hook", None)], "row bigint, domain string, id string, name string, book string")
    fixes = spark.createDataFrame([(1, "gear", "a", None, None), (2, "gear", "b", None, None), (3, "cars", "c", " x", "b1"), (4, "cars", "zz", "rope", "b1"), (5, "gear", None, "TORCH ", "b1"), (6, "gear", "q", "Torch", "b2")], "fix int, domain string, id string, name string, book string")
    got = {r["fix"]: (r["target"], r["tier"]) for r in joins.correction_targets(fixes, items, "row").collect()}
    assert got == {1: (1, 1), 2: (3, 2), 3: (4, 3), 4: (None, None), 5: (3, 3), 6: (None, None)}


def test_merge_rules(spark):
    """Prices must be equal, null too; other stats only where both have one; reprints add nothing."""
    data = [(1, "k", 5, 2, False), (2, "k", 5, None, False), (3, "k", None, 2, False), (4, "k", 7, 2, True), (5, "k", 5, 2, True), (6, "k", 5, 3, False), (7, "z", 1, 1, True), (8, "z", 1, 1, False), (9, "k", None, 2, False)]
    df = spark.createDataFrame(data, "i int, k string, price int, dmg int, again boolean")
    got = {r["i"]: (r["outcome"], r["matched"]) for r in joins.merge_ordered(df, "k", "i", ["dmg"], ["price"], "again").collect()}
    assert got == {1: ("new", 1), 2: ("reference", 1), 3: ("variant", 3), 4: ("skipped", None), 5: ("skipped", None), 6: ("variant", 6), 7: ("skipped", None), 8: ("new", 8), 9: ("reference", 3)}


def test_nearest_in_reach_matches_brute_force(spark):
    rng = random.Random(3)
    left = [("p" + str(i % 3), i, rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(120)]
    right = [("p" + str(i % 3), 1000 + i, rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(90)]
    want = {}
    for p, i, x, y in left:
        near = [(((x - u) ** 2 + (y - v) ** 2) ** 0.5, k) for q, k, u, v in right if q == p]
        d, k = min(near)
        if d < 40:
            want[i] = k
    schema = "page string, {} int, x double, y double"
    got = joins.nearest_in_reach(spark.createDataFrame(left, schema.format("l")), spark.createDataFrame(right, schema.format("r")), ["page"], "l", "r", "x", "y")
    assert {r["l"]: r["r"] for r in got.collect()} == want and 10 < len(want) < 120


def test_identify(spark):
    registry = spark.createDataFrame([(1, "core", "The Iron Book", "CAT0101"), (2, "salt", "Salt Codex", "202"), (3, "more", "Iron Book of Salt", None), (4, "none", None, "101")], "n int, slug string, title string, cat string")
    signals = spark.createDataFrame(
        [("a", {"101": 3, "CAT202": 1}, "my iron book scan", "IRON BOOK", ""), ("b", {}, None, None, "buy the salt codex today"), ("c", {}, "", "", "salt codex and iron book"), ("d", {"9": 1}, "iron book salt", "", "salt codex")],
        "file string, codes map<string,int>, title string, cover string, text string",
    )
    assert rows(joins.identify(signals, "file", registry, "slug", "n")) == [("a", "core", 1.0), ("a", "salt", 0.25), ("b", "salt", 0.45), ("d", "core", 0.6)]


def test_token_overlap_with_context_and_hot_tokens(spark):
    a = spark.createDataFrame([(1, ["iron", "lamp"], ["tool"]), (2, ["lamp"], []), (3, ["rope"], ["tool"]), (4, [], ["tool"])], "id int, t array<string>, x array<string>")
    entries = [("lamp " + w,) for w in "alpha beta gamma delta".split()] + [("iron lamp",), ("lamp tool",), ("tool",)]
    b = spark.createDataFrame(entries, "e string")
    got = joins.token_overlap(a, "id", F.col("t"), b, "e", F.split("e", " "), 2, F.col("x"))
    assert rows(got) == [(1, "iron lamp", 4), (2, "iron lamp", 2)]
    many = spark.createDataFrame([(f"lamp w{i}",) for i in range(300)] + [("iron lamp x",)], "e string")
    plain = joins.token_overlap(a, "id", F.col("t"), many, "e", F.split("e", " "), 1)
    assert rows(plain) == [(1, "iron lamp x", 2), (2, "lamp w0", 1)]  # 'lamp' is in all entries
    beside = spark.createDataFrame([(5, ["lamp"], ["w299", "w7"]), (6, ["lamp", "w12"], ["w13"])], "id int, t array<string>, x array<string>")
    assert rows(joins.token_overlap(beside, "id", F.col("t"), many, "e", F.split("e", " "), 1, F.col("x"))) == [(5, "lamp w7", 3), (6, "lamp w12", 4)]


def test_resolve_pictures(spark):
    data = [(1, "p1", "a", "A", "heading", 50.0), (2, "p1", "b", "B", "caption", 40.0), (3, "p2", "a", "A", "heading", 30.0), (4, "p2", "c", "C", "heading", 60.0), (5, "p3", "d", "A", "heading", 9.0), (6, "p3", "e", "A", "heading", 8.0), (7, "p4", "c", "C", "heading", 70.0)]
    df = spark.createDataFrame(data, "n int, pic string, item string, name string, kind string, score double")
    got = {r["n"]: (r["rivals"], r["score"]) for r in ranking.resolve_pictures(df, "pic", "item", "name", "kind", "score", "n").collect()}
    assert got == {2: (1, 40.0), 3: (2, 8.0), 4: (2, 18.0), 5: (1, 9.0), 6: (1, 8.0), 7: (1, 70.0)}


def test_caption_bands(spark):
    words = [("p", 1, 0.0, 20.0, 100.0), ("p", 2, 50.0, 70.0, 104.0), ("p", 3, 110.0, 130.0, 100.0), ("p", 4, 10.0, 30.0, 108.9), ("p", 5, 10.0, 30.0, 120.0), ("q", 6, 0.0, 20.0, 100.0), ("p", 7, 140.0, 150.0, 108.0)]
    df = spark.createDataFrame(words, "page string, w int, x0 double, x1 double, top double")
    got = dict(rows(kernels.caption_bands(df, ["page"], "w", "x0", "x1", "top")))
    assert got == {1: 1, 2: 1, 4: 1, 3: 3, 7: 3, 5: 5, 6: 6}


def test_components_with_a_hub(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(200)]
    got = kernels.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b")
    sizes = {r["component"]: r["count"] for r in got.groupBy("component").count().collect()}
    assert sizes == {0: 3000, 5000: 201}


def test_nested_attributes(spark):
    got = spark.createDataFrame([({"bod": "4", "ess": "5.5", "magres": "x"},)], "m map<string,string>").select(parse.nest_attributes(F.col("m")).alias("n")).first()["n"]
    assert {k: v["base"] for k, v in got.items()} == {"bod": 4.0, "essence": 5.5, "mag": 0.0}


def test_heading_targets(spark):
    names = spark.createDataFrame(
        [(1, "b", 10, "Iron Lamp", "LIGHT"), (2, "b", 11, "Cyberjack (Rating 1)", None), (3, "b", 12, "Cyberjack (Rating 2)", ""), (4, "b", 50, "Iron Lamp", "LIGHT"), (5, "c", 10, "Iron Lamp", None), (6, "b", 10, "Torch, Oil", "HAND_LIGHT"), (7, "b", 10, "Torch, Wax", "HAND_LIGHT"), (8, "b", 10, None, None)],
        "nk int, g string, p int, n string, sub string",
    )
    said = [(1, "Iron Lamps", 9), (2, "New Iron Lamp", None), (3, "Cyberjacks", 10), (4, "Cyberjack", 10), (5, "Torch", 10), (6, "Hand Lights", 12), (7, "Light", 90), (8, "a line of far too many words here", 10), (9, "The Old Lamp", 10), (10, "cyberj", 11), (11, "?", 1)]
    lines = spark.createDataFrame([(k, "b", p, t) for k, t, p in said], "lk int, g string, p int, t string")
    got = {}
    for r in headings.heading_targets(lines, "t", "lk", names, "n", "nk", "g", "p", "sub").collect():
        got.setdefault(r["lk"], set()).add((r["nk"], r["kind"]))
    assert got == {
        1: {(1, "name")}, 2: {(1, "name"), (4, "name")}, 3: {(2, "name"), (3, "name")}, 4: {(2, "name"), (3, "name")}, 6: {(6, "subtype"), (7, "subtype")}, 10: {(2, "family"), (3, "family")},
    }


def test_scans_over_ranges_equal_windows(spark, monkeypatch):
    """Every scan gives the same where each key is cut into ranges."""
    from tessera.operators import ordered

    rng = random.Random(6)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 2, 5]), float(rng.randint(0, 40)), rng.choice(["add", "add", "undo"])) for i in range(500)]
    df = spark.createDataFrame(data, "k string, i int, v int, x double, kind string")
    gaps = df.withColumn("at", (F.col("i") * F.col("i")).cast("double"))

    def scans():
        return [
            rows(sequence.fill_forward(df, ["k"], ["i"], ["v"])), rows(sequence.fill_backward(df, ["k"], ["i"], ["v"])), rows(sequence.gap_sessions(gaps, ["k"], "at", F.lit(300.0))), rows(changes.ledger_balance(df, "k", "i", "x", "kind")),
            rows(sequence.anchor_groups(gaps.filter("k is not null"), ["k"], "at", 900.0, "i")), rows(ordered.numbered(df, ["k"], ["i"], "n")), rows(sequence.zip_halves(df.filter("i % 2 = 0").select("k", "i", "v"), df.filter("i % 2 = 1").select("k", "i", "x"), ["k"], "i")),
        ]

    plain = scans()
    monkeypatch.setattr(ordered, "LARGE", 0)
    monkeypatch.setattr(ordered, "MOST_RANGES", 12)
    assert ordered.in_ranges(df, ["k"], ["i"]).select(ordered.RANGE).distinct().count() > 3
    assert scans() == plain
