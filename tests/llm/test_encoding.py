import random
import time

from tessera.llm import encoding
from tessera.llm.encoding import maximal_segments, restore_encoding

NAMES = ["Fjällhöhle", "Señora Cruz", "Über Grund", "NÃO Sistemas", "Ångström & Co", "O’Brien Lamp", "Vael–Torsk", "Plain Lantern", "Iron Door"]
SCHEMA = "dataset string, id bigint, text string, key string, restored int"


def garble(text, written, read):
    return text.encode(written).decode(read)


def corpus():
    rng = random.Random(7)
    return [f"{rng.choice(NAMES)} {rng.choice(['Mk 2', 'II', 'X4', 'Plus', ''])}".strip() for _ in range(3000)]


def run(spark, texts):
    df = spark.createDataFrame([("a", i, t, "k", 0) for i, t in enumerate(texts)], SCHEMA)
    return {r["key"]: (r["restored"], r["restorable"]) for r in restore_encoding(df, "dataset", "id", "text").collect()}


def test_restores_what_was_misread(spark):
    bad = {
        garble("Fjällhöhle II", "utf-8", "cp1252"): "Fjällhöhle II",
        garble("Señora Cruz", "utf-8", "cp437"): "Señora Cruz",
        garble("O’Brien Lamp X4", "utf-8", "mac_roman"): "O’Brien Lamp X4",
        garble("Vael–Torsk", "cp1252", "cp437"): "Vael–Torsk",
        garble("Über Grund", "utf-8", "cp1251"): "Über Grund",
        garble(garble("Fjällhöhle", "utf-8", "cp1252"), "utf-8", "cp1252"): "Fjällhöhle",
    }
    texts = corpus()
    got = run(spark, texts + list(bad))
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(bad.values(), len(texts)))
    assert all(ok for _, ok in got.values())


def test_lost_bytes_nulls_and_empties(spark):
    texts = corpus() + ["Fj�llhöhle", None, "", "   ", "plain"]
    got = run(spark, texts)
    assert got == {3000: ("Fj�llhöhle", False)}


def test_very_long_text_and_empty_table(spark):
    long = "Iron Door " * 5000 + garble("Fjällhöhle", "utf-8", "cp1252")
    assert run(spark, corpus() + [long])[3000] == ("Iron Door " * 5000 + "Fjällhöhle", True)
    assert run(spark, []) == {}


def test_segments_are_those_of_brute_force():
    def brute(scores):
        if not any(s > 0 for s in scores):
            return []
        best = max(((sum(scores[i:j]), -(j - i), -i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
        _, i, j = best
        return brute(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(scores[j:])]

    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randint(0, 12))]
        assert maximal_segments(scores) == brute(scores)


def test_segments_decide(spark, monkeypatch):
    """A right text whose pairs are frequent is left alone though an inverse mapping scores better; without segments it would be changed."""
    rng = random.Random(1)
    odd = "S" + garble("é", "utf-8", "cp1252")
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    texts = [f"{rng.choice([odd, 'Sé Grand', 'Café', 'Thé'])} {word()} {word()}" for _ in range(3000)]
    assert run(spark, [*texts, "Café Lamp".encode().decode("cp1252")]) == {3000: ("Café Lamp", True)}
    monkeypatch.setattr(encoding, "maximal_segments", lambda scores: [(0, len(scores))])
    assert run(spark, texts)[next(i for i, t in enumerate(texts) if odd in t)][0].startswith("Sé ")


def test_segments_take_linear_time():
    def seconds(n):
        rng = random.Random(5)
        scores = [rng.choice([-1.0, 0.9]) for _ in range(n)]
        began = time.perf_counter()
        maximal_segments(scores)
        maximal_segments([-1.0, 0.5] * (n // 2))
        return time.perf_counter() - began

    seconds(20_000)
    assert seconds(1_000_000) < 150 * max(0.004, seconds(20_000))


def test_no_accent_standing_alone_is_restored(spark):
    """A misread letter of a scan is no wrong encoding: its only inverse mappings give accents without letters. A text garbled twice, whose first round does, is restored."""
    twice = garble(garble("Øresta", "utf-8", "cp1252"), "utf-8", "cp1252")
    rng = random.Random(2)
    texts = [f"{rng.choice(['Øresta', 'Merfuwen', 'Merzosk', 'Fjällhöhle'])} {rng.choice(['Torch', 'Mk 3', 'Lamp'])}" for _ in range(2000)]
    got = run(spark, [*texts, *[twice] * 3, "M€rfuwen", "M€rzosk Mk 3"])
    assert got == {2000 + i: ("Øresta", True) for i in range(3)}
