import random
import re

import numpy as np

from tessera.llm import leaks as leaks_module
from tessera.llm.leaks import leaks, shared_runs, window_sketches

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, run=12):
    def grams(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}

    g = {i: grams(t) for i, t in items}
    return sorted({(d, i) for d, t in docs if (x := grams(t)) for i in g if x & g[i]})


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc bigint, text string, hash int")
    i = spark.createDataFrame([(i, t, "a") for i, t in items], "item bigint, text string, around string")
    return sorted((r["doc"], r["item"]) for r in leaks(d, "doc", "text", i, "item", "text").collect())


def test_matches_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(8, 60))) for i in range(30)]
    docs = []
    for d in range(200):
        source = rng.choice(items)[1].split()
        n = rng.choice([10, 11, 12, 13, 20])
        at = rng.randint(0, max(0, len(source) - n))
        part = source[at : at + n]
        if rng.random() < 0.3:
            part = [w.upper() + "," for w in part]
        docs.append((d, f"{text(rng.randint(0, 40))}. {' '.join(part)}\n{text(rng.randint(0, 40))}"))
    got = found(spark, docs, items)
    assert got == brute(docs, items) and len(got) > 50


def test_edges(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    repeated = "so " * 40
    docs = [(1, item), (2, item[:-7]), (3, None), (4, ""), (5, " \n"), (6, "x " * 9000 + item + " y" * 9000), (7, repeated), (1, item)]
    items = [(1, item), (2, item + " extra"), (3, None), (4, ""), (5, repeated), (6, "short")]
    assert found(spark, docs, items) == brute(docs, items) == [(1, 1), (1, 2), (6, 1), (6, 2), (7, 5)]
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_whole_runs_and_containment(spark):
    item = [f"w{i}" for i in range(60)]
    part = " ".join(item[5:45])
    docs = [(1, f"a b {part} c d " + " ".join(item[30:50])), (2, " ".join(item[:11])), (3, "z " * 3000 + part + " z" * 3000)]
    d = spark.createDataFrame([(i, t) for i, t in docs], "doc bigint, text string")
    i = spark.createDataFrame([(9, " ".join(item))], "item bigint, text string")
    rows = shared_runs(d, "doc", "text", i, "item", "text").collect()
    assert sorted((r["doc"], r["doc_word"], r["item_word"], r["run_words"]) for r in rows) == [(1, 2, 5, 40), (1, 44, 30, 20), (3, 3000, 5, 40)]
    got = {r["doc"]: (r["run_words"], r["shared_shingles"]) for r in leaks(d, "doc", "text", i, "item", "text").collect()}
    assert got == {1: (40, 41), 3: (40, 36)}  # shingles at 5-40 and 30-45


def test_boilerplate_is_split(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    monkeypatch.setattr("tessera.llm.leaks.SALTS", 4)
    docs = [(i, f"x{i} {item} y{i}") for i in range(3000)] + [(5000, "nothing of it")]
    assert found(spark, docs, [(1, item), (2, item + " more")]) == [(i, k) for i in range(3000) for k in (1, 2)]


def test_every_window_has_its_minhash():
    rng = random.Random(4)
    words = np.array([f"w{rng.randint(0, 9)}" for _ in range(300)], dtype=object)
    text = np.repeat([0, 1, 2], [100, 11, 189])
    places = set(window_sketches(words, text)[0].tolist())
    for start in range(300 - 11):
        if text[start] == text[start + 11]:
            assert any(p in places for p in range(start, start + 8))
    assert all(text[p] == text[p + 4] for p in places) and not any(100 <= p < 111 for p in places)


def test_minhash_decides(spark, monkeypatch):
    """Shingles at fixed places instead of the MinHash of every window miss runs that begin elsewhere."""
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(30))) for i in range(20)]
    docs = [(d, " ".join(["x"] * (d % 9) + items[d % 20][1].split()[d % 7 : d % 7 + 14] + ["y"])) for d in range(100)]
    assert found(spark, docs, items) == brute(docs, items) and len(brute(docs, items)) == 100
    sketches = leaks_module.window_sketches

    def at_fixed_places(words, text):
        places, hashes = sketches(words, text)
        kept = places % 8 == 0
        return places[kept], hashes[kept]

    monkeypatch.setattr(leaks_module, "window_sketches", at_fixed_places)
    assert len(found(spark, docs, items)) < 80
