import random

import numpy as np

from tessera.llm import spam
from tessera.llm.spam import spam_pages

NOUNS = "lamp door engine harbor session player bridge clinic market rotor".split()


def sentences(rng, n):
    return " ".join(f"The {rng.choice(NOUNS)} and its {rng.choice(NOUNS)} carries a {rng.choice(NOUNS)} under the {rng.choice(NOUNS)}." for _ in range(n))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, lang, 1.0, "p") for i, (t, lang) in enumerate(rows)], "id bigint, text string, lang string, distance double, prose string")
    return sorted(r["key"] for r in spam_pages(df, "id", "text", "lang").collect())


def test_spam_and_what_only_looks_like_it(spark):
    rng = random.Random(1)
    normal = [(sentences(rng, rng.randint(3, 30)), rng.choice(["en", None, "de"])) for _ in range(400)]
    french = [(" ".join(f"La {rng.choice(NOUNS)} répare une {rng.choice(NOUNS)} avant chaque {rng.choice(NOUNS)}." for _ in range(rng.randint(3, 20))), "fr") for _ in range(60)]
    near = [
        (sentences(rng, 12) + "\nLinks:\n" + "\n".join(f"notes: https://a{i}.example/x/{i}" for i in range(4)), "en"),
        ("Lamp X4\nAvail: 3\nBody: 5\nSpeed: 7\n\n" + sentences(rng, 5), "en"),
        (" ".join(f"The lamp sells a door, and no other lamp opens the {rng.choice(NOUNS)}." for _ in range(20)), "en"),
        ("Title Only Here", "en"), (None, "en"), ("", None), ("  \n", "en"), ("12 34", None),
    ]
    spam = [
        (" ".join(rng.choice(["cheap", "buy", "sale"]) + " lamp" for _ in range(80)), "en"),
        ("\n".join(f"https://s{i}.example/lamp/{i}" for i in range(60)), None),
        (" ".join(f"#{rng.choice(NOUNS)}{rng.choice(['sale', 'buy', ''])}" for _ in range(60)), "fr"),
        ("\n".join(f'<a href="http://x{i}.test/{i}">best {rng.choice(NOUNS)}</a>' for i in range(50)), "en"),
        ("\n".join(f"Brand {rng.choice(NOUNS)} {i}00¥ sale SKU {i}" for i in range(40)), "en"),
        ("Sale lamp! Buy door lamp? " * 2000, "en"), (sentences(rng, 1) + "\n" + "lamp | best lamp | " * 60, "en"),
    ]
    rows = normal + french + near + spam
    first = len(rows) - len(spam)
    assert run(spark, rows) == list(range(first, len(rows)))


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == []


def test_scatter_decides(spark, monkeypatch):
    """Without the estimated scatter (one wide one instead), or with the spam direction reversed, nothing is found."""
    rng = random.Random(2)
    rows = [(sentences(rng, rng.randint(3, 30)), "en") for _ in range(200)] + [("cheap lamp best door buy rotor " * 20, "en")]
    assert run(spark, rows) == [200]
    fitted = spam.robust_models
    monkeypatch.setattr(spam, "robust_models", lambda f: {c: (m, s * 0 + np.diag([1.0, 1.0, 1.0, 1.0])) for c, (m, s) in fitted(f).items()})
    assert run(spark, rows) == []
    monkeypatch.setattr(spam, "robust_models", fitted)
    towards = spam.spam_directions
    monkeypatch.setattr(spam, "spam_directions", lambda f, m: {c: -u for c, u in towards(f, m).items()})
    assert run(spark, rows) == []


def test_contamination_moves_no_estimate(spark):
    rng = random.Random(5)
    features = lambda n, at, sd: [("en", *(rng.gauss(a, s) for a, s in zip(at, sd))) for _ in range(n)]
    good = features(3000, (3, -0.4, -2.6, 0.8), (0.2, 0.15, 0.25, 0.04))
    bad = features(300, (-3, -4, -1, 0.6), (0.5, 0.5, 0.3, 0.1))
    schema = "language string, prose double, function double, repetition double, entropy double"
    centre, scatter = spam.robust_models(spark.createDataFrame(good + bad, schema))["en"]
    assert np.allclose(centre, (3, -0.4, -2.6, 0.8), atol=0.03)
    assert np.allclose(np.sqrt(np.diag(scatter)), (0.2, 0.15, 0.25, 0.04), rtol=0.1)


def test_language_beyond_the_lists(spark):
    rng = random.Random(3)
    normal = [(" ".join(f"El {rng.choice(NOUNS)} que tiene una {rng.choice(NOUNS)} pasa por la {rng.choice(NOUNS)}." for _ in range(rng.randint(3, 25))), "es") for _ in range(100)]
    keywords = [(" ".join(f"{rng.choice(NOUNS)} barato {rng.choice(NOUNS)}" for _ in range(40)), "es") for _ in range(3)]
    english = [(sentences(rng, rng.randint(3, 30)), "en") for _ in range(200)]
    assert run(spark, normal + keywords + english) == [100, 101, 102]
