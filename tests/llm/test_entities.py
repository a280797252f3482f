import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import entities
from tessera.llm.entities import belief_propagation, book_variants, candidate_odds, candidate_pairs, edits, likeness_keys, log_odds, match_entities, parse_name, word_likeness

BOOKS = [("iron_book", "Iron Book Handbook"), ("salt_codex", "Salt Engineering Codex"), (None, "x")]
ITEMS = [
    (1, "tools", "Nordhall Kestupan Drill", "iron_book", 10), (2, "tools", "Nordhall Kestupan Drill II", "iron_book", 11), (3, "tools", "Säkvind & Co Molvarik", "salt_codex", 50),
    (4, "armor", "Nordhall Kestupan Drill", "iron_book", 10), (5, "tools", "Nordhall Kestupan Drill", "salt_codex", 70), (6, "tools", None, "salt_codex", 70),
    (7, "tools", "Nordhall Kestupan Drill", "iron_book", 10), (8, None, "Nordhall Ruvlimpo", "iron_book", None), (9, "tools", "", "iron_book", 10), (10, "tools", "Twin Ferzudok", "iron_book", 5), (11, "tools", "Twin Ferzudok", "iron_book", 6),
]


def run(spark, mentions, items=ITEMS):
    m = spark.createDataFrame([(i, c, {"name": n, "book": b, "page": p}, "z") for i, c, n, b, p in mentions], "cid bigint, category string, ref struct<name:string,book:string,page:int>, id string")
    r = spark.createDataFrame([(*x, "y", 1) for x in items], "rid bigint, category string, name string, book string, page int, words string, n int")
    b = spark.createDataFrame(BOOKS, "slug string, title string")
    cols = {"category": "category", "name": "name", "book": "book", "page": "page"}
    out = match_entities(m, {"id": "cid", "category": "category", "name": "ref.name", "book": "ref.book", "page": "ref.page"}, r, {"id": "rid"} | cols, b, "slug", "title")
    got = {x["mention"]: (x["record"], x["confidence"]) for x in out.collect()}
    assert all(0.5 <= c <= 1 for _, c in got.values())
    return {k: v[0] for k, v in got.items()}


def test_noisy_mentions(spark):
    mentions = [
        (1, "tools", "kestupan drill, nordh.", "IRON-BOOK", None), (2, "tools", "NordhallKestupanDrillII (errata)", "Iron Book Handb.", 12), (3, "tools", "Sakvind & Co Mlovarik *", None, 51),
        (4, "tools", "Nordhall Kestupan Drill III", "iron_book", 10), (5, "armor", "Nordhall Kestupan Drills", "IBOHA", 9), (6, "tools", "Nordhall Kestupan", "salt_codex_v2", 71),
        (7, "tools", "Nordhall Kestupan Drill", None, None), (8, "tools", "Nordhall Ruvlimpo", "iron_book", 3), (9, "tools", None, "iron_book", 3), (10, None, "Nordhall Kestupan Drill", "iron_book", 3),
        (11, "tools", "Twin Ferzudok", "iron_book", None), (12, "tools", "Twin Ferzudok", "iron_book", 90), (1, "tools", "kestupan drill, nordh.", "IRON-BOOK", None), (13, "tools", "Zordhall Kestupan Drill", "iron_book", 10),
    ]
    assert run(spark, mentions) == {1: 1, 2: 2, 3: 3, 5: 4, 6: 5, 13: 1}


def test_hot_mentions_and_empty_tables(spark):
    hot = [(i, "tools", "Nordhall Kestupan Drill II", "iron_book", 11) for i in range(2000)]
    assert run(spark, hot, ITEMS + [(100 + i, "tools", "Nordhall Kestupan Drill II", "iron_book", 11) for i in range(2000)]) == {i: 2 for i in range(2000)}
    assert run(spark, []) == {} and run(spark, hot[:1], []) == {}
    assert run(spark, [(1, "tools", "Nordhall " * 3000 + "Kestupan Drill II", "iron_book", 11)]) == {1: 2}


def test_marginals_match_enumeration(spark):
    edges = [(1, 1, 3.0), (1, 2, 1.0), (2, 1, 2.0), (3, 2, 0.5)]
    share = 0.3
    total, marginal = 0.0, dict.fromkeys([(m, e) for m, e, _ in edges], 0.0)
    for mask in range(1 << len(edges)):
        on = [edges[i] for i in range(len(edges)) if mask >> i & 1]
        if len({m for m, _, _ in on}) < len(on):
            continue
        weight = 1.0
        for m, e, w in on:
            weight *= w
        for e in {e for _, e, _ in on}:
            weight *= share ** (sum(x[1] == e for x in on) - 1)
        total += weight
        for m, e, _ in on:
            marginal[m, e] += weight
    df = spark.createDataFrame(edges, "m bigint, e bigint, w double")
    for r in belief_propagation(df, share, rounds=30).collect():
        assert r["p"] == pytest.approx(marginal[r["m"], r["e"]] / total, abs=5e-3)


def test_parts():
    assert parse_name("Kestupan Drill No. 9, Säk.") == (["sak.", "kestupan", "drill"], "no9")
    assert parse_name("SäkvindKestupan(Compact)") == (["sakvind", "kestupan"], "compact")
    assert parse_name("R-7 Drill Mk2") == (["drill"], "mk2 r7")
    assert edits("abcd", "abdc") == 1 and edits("abcd", "abcde") == 1 and edits("abcd", "wxyz") == 3
    assert {"ironbook", "ironbookhandbook", "ibohan"[:5], "ironbookhandb"} <= set(book_variants(*BOOKS[0]))


def test_messages_decide(spark, monkeypatch):
    """Mention 1 fits two records equally; since mention 2 surely speaks of one of them, it gets the other. Without messages it is a tie, so no match."""
    mentions = [(1, "tools", "Twin Ferzudok", "iron_book", None), (2, "tools", "Twin Ferzudok", "iron_book", 5)]
    items = [(10, "tools", "Twin Ferzudok", "iron_book", 5), (11, "tools", "Twin Ferzudok", "iron_book", 60)]
    assert run(spark, mentions, items) == {1: 11, 2: 10}
    assert run(spark, mentions[:1], items) == {}

    def softmax(edges):
        total = edges.groupBy("m").agg(F.sum("w").alias("t"))
        return edges.join(total, "m").select("m", "e", (F.col("w") / (1 + F.col("rest") + F.col("t"))).alias("p"))

    monkeypatch.setattr(entities, "belief_propagation", softmax)
    assert run(spark, mentions, items) == {2: 10}


def test_frequent_words_make_no_block_alone(spark, monkeypatch):
    """Blocks of frequent words are split by a second word or the page, and lose no match that these can tell."""
    monkeypatch.setattr(entities, "BLOCK", 3)
    mentions = [(1, "tools", "Kestupan Drill", "iron_book", 10), (2, "tools", "Nordhall Kestupn Drill", "salt_codex", None), (3, "tools", "Drill", "iron_book", 10), (4, "tools", "Lone", "iron_book", 4)]
    items = [*ITEMS, *((100 + i, "tools", f"Nordhall Drill {w} Kestupan", "iron_book", 200 + 3 * i) for i, w in enumerate(["Alpha", "Berta", "Caesar", "Dora"])), (200, "tools", "Lone", "iron_book", None)]
    assert run(spark, mentions, items) == {1: 1, 2: 5, 3: 1, 4: 200}


def test_marginals_with_small_odds_and_alone(spark):
    edges = spark.createDataFrame([(1, 1, 2.0, 0.5), (1, 2, 1.0, 0.5)], "m bigint, e bigint, w double, rest double")
    assert {r["e"]: r["p"] for r in belief_propagation(edges).collect()} == {1: pytest.approx(2 / 4.5), 2: pytest.approx(1 / 4.5)}


def test_unsettled_messages_are_reported(spark):
    edges = spark.createDataFrame([(1, 1, 9.0), (1, 2, 5.0), (2, 1, 7.0), (2, 2, 8.0)], "m bigint, e bigint, w double")
    with pytest.warns(UserWarning, match="still change"):
        belief_propagation(edges, 0.0, rounds=1).collect()


def test_candidates_are_all_pairs_of_such_odds(spark, monkeypatch):
    """Against the scores of all pairs: no pair is lost, though each word is frequent, is short, stands on far or null pages, or only its likeness is shared."""
    monkeypatch.setattr(entities, "BLOCK", 1)
    rng = random.Random(11)
    vocabulary = ["kestupan", "kestupn", "ksetupam", "drill", "drills", "drll", "nordhall", "nordh.", "nao", "vex", "molvarik", "molvraik", "bo", "x" * 30, "x" * 14 + "y" + "x" * 16, "sak."]
    names = [rng.sample(vocabulary, rng.choice([1, 1, 2, 2, 3, 4])) for _ in range(260)]
    made = [(i, rng.choice(["tools", "armor"]), rng.choice(["a", "b", None]), rng.choice([None, 3.0, 5.0, 6.0, 90.0]), w, rng.choice(["", "", "ii"])) for i, w in enumerate(names)]
    kind = "id bigint, category string, book string, page double, words array<string>, designation string"
    want = {}
    for m, mc, mb, mp, mw, md in made[:130]:
        for e, ec, eb, ep, ew, ed in made[130:]:
            if (mc, md) == (ec, ed) and mb in (None, eb):
                apart = None if mp is None or ep is None else abs(mp - ep)
                odds = log_odds(mw, ew, None if mb is None or eb is None else True, apart)
                if odds > -3:
                    want[m, e] = pytest.approx(math.exp(min(odds, 12)))
    got = candidate_odds(spark.createDataFrame(made[:130], kind), spark.createDataFrame(made[130:], kind)).collect()
    assert len(got) == len(want) > 200 and {(x["m"], x["e"]): x["w"] for x in got} == want


def test_a_frequent_word_alone_finds_its_record(spark):
    """The record has a rare word too, which the mention leaves out; 250 others have the frequent one, or a short one, elsewhere."""
    items = [(1, "tools", "Kestupan Drill", "iron_book", 10), (2, "tools", "Nao Molvarik", "salt_codex", 10)]
    items += [(100 + i, "tools", f"Nao Drill {'abcdefghijklmnopqrstuvwxyz'[i % 26] * 5} {'abcdefghijklmnopqrstuvwxyz'[i // 26] * 6}", "iron_book", 100 + i) for i in range(250)]
    assert run(spark, [(1, "tools", "Drill", "iron_book", 10), (2, "tools", "Nao", "salt_codex", None)], items) == {1: 1, 2: 2}


def test_alike_words_share_a_key():
    words = ["cat", "cats", "cates", "nordhall", "nordh.", "nordhlal", "nrdhal", "nordhalls", "abcde" * 5, "abcde" * 4 + "abdce", "abcde" * 5 + "ss", "abcde" * 7, "abcde" * 6 + "aybcdez"]
    pairs = [(a, b) for a in words for b in words if word_likeness(a, b) > 0]
    assert len(pairs) > 25 and all(likeness_keys(a, True) & likeness_keys(b.rstrip("."), False) for a, b in pairs)


def test_a_word_that_all_share_makes_no_pairs_of_its_own(spark):
    """Near pages and the one word in common leave odds of e^-3 at most, so these are no pairs; one unlike word on either side is, on near pages of the same book, whichever word it is."""
    kind = "id bigint, category string, book string, page double, words array<string>, designation string"
    other = "abcdefghij"
    mentions = [(i, "tools", "a" if i % 2 else None, 10.0 + i % 3, ["zzz" + c * 5, "qqq" + c * 6, "drill"], "") for i, c in enumerate(other)]
    entities = [(100 + i, "tools", "a", 10.0 + i % 2, ["vvv" + c * 5, "www" + c * 6, "drill"], "") for i, c in enumerate(other)]
    near = [(50, "tools", "a", 5.0, ["kestupan", "molvarik", "drill"], ""), (51, "tools", None, 5.0, ["kestupan", "molvarik", "drill"], ""), (52, "tools", "a", 6.0, ["vvvaaaaa", "kestupan", "drill"], "")]
    known = [(150, "tools", "a", 7.0, ["kestupan", "ferzudok", "drill"], ""), (151, "tools", "a", 3.0, ["ruvlimpo", "molvarik", "drill"], ""), (152, "tools", "b", 5.0, ["kestupan", "ferzudok", "drill"], ""), (153, "tools", "a", 8.0, ["kestupan", "molvarik", "x"], "")]
    m, e = spark.createDataFrame(mentions + near, kind), spark.createDataFrame(entities + known, kind)
    assert candidate_pairs(m, e).count() <= 12  # of 182
    assert {(x["m"], x["e"]) for x in candidate_odds(m, e).collect()} == {(50, 150), (50, 151), (52, 150)}
