import random

from tessera.llm import scans
from tessera.llm.scans import repair_scans

WORDS = "garage turret lantern courier engine harbor mechanic delivery session clinic every under quietly carries".split()
SCHEMA = "id bigint, name string, description string, field string, traces string, key string"


def clean(rng, sentences=4):
    return " ".join("The " + " ".join(rng.choice(WORDS) for _ in range(9)) + "." for _ in range(sentences))


def wrap(text, width=40):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def run(spark, rows):
    df = spark.createDataFrame([(i, n, d, "f", "t", "k") for i, (n, d) in enumerate(rows)], SCHEMA)
    return {(r["key"], r["field"]): (r["traces"], r["text"]) for r in repair_scans(df, "id", {"name": "name", "description": "description"}).collect()}


def test_traces_are_found_and_repaired(spark):
    rng = random.Random(5)
    base = [(f"Lamp {i}", clean(rng)) for i in range(400)]
    lists = [("Lamp", "Each set holds:\n- two lanterns\n- four engines"), ("Lamp", clean(rng) + "\n\n" + clean(rng)), ("Lamp X4", clean(rng) + " A double-walled long-range lantern.")]
    text = clean(rng)
    lines = wrap(text)
    header = "\n".join([*lines[:2], "STREET GEAR | TOOLS", *lines[2:]])
    page = "\n".join([*lines, "- 117 -"])
    at = text.index("lantern") + 3 if "lantern" in text else text.index("garage") + 3
    hyphen = text[:at] + "-\n" + text[at:]
    wrong = text.replace("garage", "garoge").replace("engine", "eng!ne").replace("courier", "coiirier")
    cases = [("Lamp", header), ("Lamp", page), ("Lamp", hyphen), ("Lamp", wrong), ("Big Lan-\ntern", None), ("BOOK TITLE\nBig Lantern", None), ("Big Lantern\n42", None), ("Big L@ntern", None)]
    got = run(spark, base + lists + cases)
    n = len(base) + len(lists)
    assert {k: v[0] for k, v in got.items()} == {
        (n, "description"): ["header"], (n + 1, "description"): ["page number"], (n + 2, "description"): ["hyphen"], (n + 3, "description"): ["character"],
        (n + 4, "name"): ["hyphen"], (n + 5, "name"): ["header"], (n + 6, "name"): ["page number"], (n + 7, "name"): ["character"],
    }
    assert all(got[n + i, "description"][1] == text for i in range(4))
    assert got[n + 4, "name"][1] == got[n + 5, "name"][1] == got[n + 6, "name"][1] == "Big Lantern"


def test_lines_set_off_by_blank_lines_are_labelled(spark):
    rng = random.Random(7)
    first, second = clean(rng), clean(rng)
    one, two = "\n".join(wrap(first)), "\n".join(wrap(second))
    base = [(f"Lamp {i}", clean(rng)) for i in range(400)] + [("Lamp", f"{one}\n\n{two}")]
    got = run(spark, [*base, ("Lamp", f"{one}\n\n- 128 -\n\n{two}"), ("Lamp", f"{one}\n \nSTREET GEAR | TOOLS\n\n{two}")])
    whole = f"{first}\n\n{second}"
    assert got == {(401, "description"): (["page number"], whole), (402, "description"): (["header"], whole)}


def test_nothing_to_find(spark):
    assert run(spark, [(None, None), ("", ""), (" ", "\n \n"), ("R-7", "ok")]) == {}
    assert run(spark, []) == {}


def test_very_long_text_is_read_whole(spark):
    rng = random.Random(1)
    text = clean(rng, 4000)
    got = run(spark, [("a", text), ("b", "\n".join([*wrap(text), "- 9 -"]))])
    assert got == {(1, "description"): (["page number"], text)}


def test_names_and_long_words_are_repaired(spark):
    """'rn' for 'm' in a name, words of any length and with any number of misread symbols."""
    rng = random.Random(3)
    long = "unterwassernavigationsbeleuchtungseinrichtungen"
    base = [(f"Summer Lamp {i % 7}", clean(rng) + f" The {long} carries billiolli.") for i in range(400)]
    cases = [
        ("Surnmer Lamp", None), ("5ummer Lamp", None), ("SummerLamp", None),
        ("Lamp", f"The {long.replace('e', 'c', 1)} carries it."), ("Lamp", "The b1|!!o|1i carries it."), ("Lamp", f"The {long.replace('u', 'ii', 1)} carries."),
    ]
    got = run(spark, base + cases)
    assert got == {
        (400, "name"): (["character"], "Summer Lamp"), (401, "name"): (["character"], "Summer Lamp"), (403, "description"): (["character"], f"The {long} carries it."),
        (404, "description"): (["character"], "The billiolli carries it."), (405, "description"): (["character"], f"The {long} carries."),
    }


def test_own_answers_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    known = [(f"Big Lantern {i}", clean(rng) + " A long-range double-walled lantern.") for i in range(60)]
    text = clean(rng)
    cases = [
        ("Big Lan-\ntern", text.replace("garage", "garoge", 1).replace("e", "€", 1)), ("Big Lantem", "A long-\nrange lan-\ntern of dou-\nble-\nwalled t0rrets"), ("Big Lantern", "\n".join([*wrap(text), "12"])),
        ("Big Lantern", "\n".join(wrap(text.replace(" ", "- ", 0).replace("lantern", "lan-\ntern")))), (None, None),
    ]
    want = run(spark, known + cases)
    monkeypatch.setattr(scans, "MOST", 0)
    assert run(spark, known + cases) == want
    assert "long-range lantern" in want[61, "description"][1]


def test_confusions():
    assert scans.confusions_between("lantem", "lantern") == 1 and scans.confusions_between("l@nt€m", "lantern") == 3 and scans.confusions_between("lantern", "lantern") == 0
    assert scans.confusions_between("garoge", "garage") == 1 and scans.confusions_between("goroge", "garage") is None and scans.confusions_between("lamp", "lamb") is None


def test_the_line_model_decides(spark, monkeypatch):
    """With every line labelled body, headers and page numbers stay in the text."""
    rng = random.Random(7)
    lines = wrap(clean(rng))
    rows = [(f"Lamp {i}", clean(rng)) for i in range(200)] + [("Lamp", "\n".join([*lines[:2], "STREET GEAR | TOOLS", *lines[2:], "117"]))]
    assert run(spark, rows)[200, "description"][0] == ["header", "page number"]
    monkeypatch.setattr(scans, "viterbi", lambda model, features: [scans.BODY] * len(features))
    assert run(spark, rows) == {}
