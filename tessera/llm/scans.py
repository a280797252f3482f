"""Noise in text from scanned pages (problem 4).

Lines are labelled body, header or break (page number) by a hidden Markov model over layout features: shape, words, end,
case, marks and place in a sentence, taken as independent given the label. Start values are fixed; one step of
expectation maximisation over all texts with line breaks fits the model to the corpus. The labels are decoded by
Viterbi, headers and page numbers are taken out, and body lines are joined into paragraphs; a hyphen at a line's end is
dropped unless the corpus knows the hyphenated compound and not the joined word. Words are compared with the
corpus vocabulary: a word is misread if undoing known confusions gives a word at least ``RATIO`` times as frequent. Names are compared with the
words of names and descriptions, descriptions with those of descriptions.

The vocabulary and the expected counts are gathered over all rows in one pass (locally per task, then added up). Words that confusions can turn into each other
share a key (``confusion_key``), so misread words meet what they may mean in a join over the distinct words of the corpus, with no bound on
length, variants or frequency. The answers (misread words and known compounds) are broadcast if they are at most ``MOST``; if they are more, each
text gets the answers to its own questions by joins. The result is the same.

Defined results
- Null, empty and blank texts have no trace. Lines are split at LF, CR LF and CR; blank lines and list items end a paragraph.
- Very long texts are read whole, in time linear in their length. Rows with the same key are reported once per field.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import stored

MOST = 200_000
RATIO = 10
LINES = 40
LEAST_COUNT = 5

#: What a scanner makes of letters, misread text to the letters meant.
CONFUSIONS = {
    "0": ["o"], "1": ["l", "i"], "|": ["l", "i"], "!": ["i", "l"], "5": ["s"], "6": ["b"], "9": ["g"], "€": ["e"], "8": ["b"], "2": ["z"], "@": ["a"],
    "c": ["e"], "o": ["a"], "f": ["t"], "b": ["h"], "ii": ["u"], "cl": ["d"], "rn": ["m"], "m": ["rn"], "n": ["ri"], "vv": ["w"], "h": ["li"], "d": ["cl"],
}
SYMBOLS = "01256789!|€@"
#: Other confusions that a word may have beside misread symbols, and without any.
LETTERS, LETTERS_ALONE = 2, 1

LINE_END = re.compile(r"\r\n|\r|\n")
BLANK_LINES = re.compile(r"\n[^\S\n]*\n\s*")
TOKEN = re.compile(r"[^\s.,;:?\"()\[\]<>«»“”…/]+")
AROUND = "-'’•!*"
PAGE = re.compile(r"\W*(?:p(?:age|g)?\.?\s*)?\d{1,4}\W*", re.I)
MARKS = re.compile(r"\||//|<<|>>|::|^\d+\s|\s\d+$|\s[-–—]\s")
ITEM = re.compile(r"\s*(?:[-•*·–—]|\d{1,2}[.)])\s+\S")
HYPHENS = "-‐\xad"
LETTER = re.compile(r"[^\W\d_]")
INITIAL = re.compile(r"(?:^|\s)\S*?([^\W\d_])")
HYPHEN_END = re.compile(r"[-‐­]\s*$")
HYPHEN = re.compile(r"([^\W_]+(?:['’-][^\W_]+)*)[-‐­]\s*$")
WORD_START = re.compile(r"\s*([^\W\d_][^\W_]*)")
#: In a name, a digit or symbol amid letters; designations such as X4 or R-7 have at most one letter before it.
NAME_SYMBOL = re.compile(
    rf"[A-Za-z][{SYMBOLS}][a-z]|(?<![^\W_])[{SYMBOLS}](?!(?:st|nd|rd|th)\b)[a-z]{{2,}}|[A-Za-z][a-z]{{2,}}[{SYMBOLS.replace('!', '')}](?![^\W_])"
)

BODY, HEADER, BREAK = range(3)
FEATURES = ("page", "words", "end", "case", "marks", "place")
SIZES = (2, 4, 3, 4, 2, 4)
#: Start values: share of each feature value among body lines, headers and page numbers; case differs for names.
START = {
    "page": ([0.998, 0.002], [0.98, 0.02], [0.01, 0.99]),
    "words": ([0.01, 0.09, 0.3, 0.6], [0.01, 0.44, 0.5, 0.05], [0.45, 0.53, 0.01, 0.01]),
    "end": ([0.7, 0.2, 0.1], [0.97, 0.02, 0.01], [0.8, 0.1, 0.1]),
    "case": ([0.93, 0.04, 0.02, 0.01], [0.04, 0.06, 0.45, 0.45], [0.9, 0.08, 0.01, 0.01]),
    "marks": ([0.97, 0.03], [0.5, 0.5], [0.7, 0.3]),
    "place": ([0.45, 0.15, 0.35, 0.05], [0.15, 0.25, 0.25, 0.35], [0.15, 0.25, 0.25, 0.35]),
}
NAME_CASE = ([0.05, 0.55, 0.395, 0.005], [0.02, 0.02, 0.06, 0.9], [0.9, 0.08, 0.01, 0.01])
FIRST = [0.8, 0.1, 0.1]
NEXT = [[0.9, 0.05, 0.05], [0.88, 0.02, 0.1], [0.88, 0.1, 0.02]]


def line_features(lines: list[str]) -> list[tuple[int, ...]]:
    """The feature values of each line that is not blank."""
    out = []
    texts = [line.strip() for line in lines]
    for i, text in enumerate(texts):
        initials = INITIAL.findall(text)  # of the words with a letter
        page = int(PAGE.fullmatch(text) is not None)
        count = 0 if not initials else 1 if len(initials) < 3 else 2 if len(initials) < 6 else 3
        end = 2 if text[-1:] in HYPHENS and HYPHEN.search(text) else 1 if text[-1:] in ".!?:;," else 0
        if text.isupper() and len(LETTER.findall(text)) > 2:
            case = 3
        elif len(initials) > 1 and all(map(str.isupper, initials)):
            case = 2
        else:
            case = 1 if initials and initials[0].isupper() else 0
        marks = int(MARKS.search(text) is not None and not ITEM.match(lines[i]))
        before = texts[i - 1] if i else ""
        after = texts[i + 1] if i + 1 < len(texts) else ""
        cut_before = bool(before) and before[-1] not in ".!?:" and not page
        starts_low = bool(initials) and text[:1].islower()
        resumes = bool(after) and after[:1].islower()
        place = 3 if cut_before and resumes and not starts_low else 2 if starts_low else 1 if not before or not after else 0
        out.append((page, count, end, case, marks, place))
    return out


def start_model(name: bool) -> dict:
    emissions = [[list(START[f][s]) for f in FEATURES] for s in range(3)]
    if name:
        for s in range(3):
            emissions[s][3] = list(NAME_CASE[s])
    return {"first": list(FIRST), "next": [list(r) for r in NEXT], "emit": emissions}


def posteriors(model: dict, features: list[tuple[int, ...]]) -> tuple[list[list[float]], list[list[list[float]]]]:
    """Forward-backward: label shares of each line and of each pair of neighbours."""
    known = model.setdefault("shares", {})
    for x in features:
        if x not in known:
            known[x] = [math.prod(model["emit"][s][f][v] for f, v in enumerate(x)) for s in range(3)]
    emit = [known[x] for x in features]
    step = model["next"]
    ahead = []
    for i, e in enumerate(emit):
        row = [e[s] * (model["first"][s] if not i else sum(ahead[-1][r] * step[r][s] for r in range(3))) for s in range(3)]
        total = sum(row) or 1.0
        ahead.append([x / total for x in row])
    back = [1.0, 1.0, 1.0]
    single, pairs = [None] * len(emit), []
    for i in range(len(emit) - 1, -1, -1):
        row = [a * b for a, b in zip(ahead[i], back)]
        total = sum(row) or 1.0
        single[i] = [x / total for x in row]
        if i:
            pair = [[ahead[i - 1][r] * step[r][s] * emit[i][s] * back[s] for s in range(3)] for r in range(3)]
            total = sum(map(sum, pair)) or 1.0
            pairs.append([[x / total for x in r] for r in pair])
            back = [sum(step[r][s] * emit[i][s] * back[s] for s in range(3)) for r in range(3)]
            top = max(back) or 1.0
            back = [x / top for x in back]
    return single, pairs


def fitted(model: dict, counts: dict[str, float], weight: float = 0.02) -> dict:
    """The start model moved to the expected counts, held by fifty lines and that share of all lines of its own."""
    weight = 50.0 + weight * sum(n for k, n in counts.items() if k.startswith("emit:") and k.split(":")[2] == "0")

    def shares(own: list[float], key: str) -> list[float]:
        raw = [weight * p + counts.get(f"{key}:{i}", 0.0) for i, p in enumerate(own)]
        return [x / sum(raw) for x in raw]

    return {
        "first": shares(model["first"], "first"),
        "next": [shares(r, f"next:{s}") for s, r in enumerate(model["next"])],
        "emit": [[shares(own, f"emit:{s}:{f}") for f, own in enumerate(model["emit"][s])] for s in range(3)],
    }


def viterbi(model: dict, features: list[tuple[int, ...]]) -> list[int]:
    if not features:
        return []
    log = model.setdefault("steps", [[math.log(x) for x in r] for r in model["next"]])
    known = model.setdefault("logs", {})  # there are few kinds of lines
    best, paths = None, []
    for x in features:
        e = known.get(x)
        if e is None:
            e = known[x] = [sum(math.log(model["emit"][s][f][v]) for f, v in enumerate(x)) for s in range(3)]
        if best is None:
            best = [math.log(model["first"][s]) + e[s] for s in range(3)]
        else:
            came = [max(range(3), key=lambda r: best[r] + log[r][s]) for s in range(3)]
            best = [best[came[s]] + log[came[s]][s] + e[s] for s in range(3)]
            paths.append(came)
    labels = [max(range(3), key=lambda s: best[s])]
    for came in reversed(paths):
        labels.append(came[labels[-1]])
    return labels[::-1]


def tokens(text: str) -> set[str]:
    """The distinct words in lower case."""
    return {t.strip(AROUND) for t in set(TOKEN.findall(text.lower()))} - {""}


def confusion_key(word: Column) -> Column:
    """The same text for all words that ``CONFUSIONS`` can turn into each other, however many of them."""
    out = F.translate(word, "0@o1|!l59€c2f", "aaaiiiisgeezt")
    for letters, spelled in (("[68bhu]", "ii"), ("d", "ei"), ("m", "rri"), ("n", "ri"), ("w", "vv")):
        out = F.regexp_replace(out, letters, spelled)
    return out


def confusions_between(bad: str, good: str) -> int | None:
    """How many confusions, at least, make ``bad`` of ``good``; None if it takes more letters than allowed, or can't be."""
    best: list[dict[tuple[int, int], int]] = [{} for _ in range(len(bad) + 1)]  # (place in good, letters) to symbols
    best[0][0, 0] = 0
    for i, ch in enumerate(bad):
        for (j, letters), symbols in best[i].items():
            steps = [(i + 1, j + 1, letters, symbols)] if good[j : j + 1] == ch else []
            for piece, meanings in CONFUSIONS.items():
                if bad.startswith(piece, i):
                    symbol = piece in SYMBOLS
                    steps += [(i + len(piece), j + len(m), letters + (not symbol), symbols + symbol) for m in meanings if good.startswith(m, j)]
            for i2, j2, n, k in steps:
                if n <= LETTERS and best[i2].get((j2, n), k + 1) > k:
                    best[i2][j2, n] = k
    ends = [n + k for (j, n), k in best[len(bad)].items() if j == len(good) and n <= (LETTERS if k else LETTERS_ALONE)]
    return min(ends, default=None)


def misread_words(words: DataFrame) -> DataFrame:
    """``word, meant`` of the misread ones among the distinct words (word, n) of a corpus."""
    keyed = words.filter((F.length("word") > 2) & F.col("word").rlike(r"\p{L}")).withColumn("k", confusion_key(F.col("word")))
    meant = keyed.filter(F.col("n") >= LEAST_COUNT).select(F.col("k").alias("gk"), F.col("word").alias("meant"), F.col("n").alias("frequency"))
    pairs = keyed.join(meant, F.col("k") == F.col("gk")).filter((F.col("frequency") >= RATIO * F.col("n")) & (F.col("word") != F.col("meant"))).select("word", "meant", "frequency")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = [confusions_between(b, g) for b, g in zip(batch["word"], batch["meant"])]
            yield batch.assign(steps=pd.Series(steps, index=batch.index, dtype="float64")).dropna(subset=["steps"]).astype({"steps": int})

    known = pairs.mapInPandas(check, "word string, meant string, frequency double, steps int")
    best = F.max(F.struct((-F.col("steps")).alias("s"), F.col("frequency"), F.col("meant"))).alias("best")
    return known.groupBy("word").agg(best).select("word", F.col("best.meant").alias("meant"))


def answers(counts: DataFrame) -> DataFrame:
    """``about, q, a``: what is known of the corpus: 'description' or 'name', a misread word, and the word meant; '-' and a compound that keeps its hyphen."""
    in_texts = counts.filter("kind = 'word'").select(F.col("item").alias("word"), "n")
    in_names = counts.filter("kind = 'name word'").select(F.col("item").alias("word"), "n")
    both = in_texts.unionByName(in_names).groupBy("word").agg(F.sum("n").alias("n"))
    own = misread_words(both).join(in_names.select("word"), "word", "left_semi")
    compounds = in_texts.filter((F.col("n") >= LEAST_COUNT) & F.col("word").contains("-"))
    parts = compounds.select("word", F.regexp_extract("word", r"([^-]+)-([^-]+)$", 1).alias("left"), F.regexp_extract("word", r"([^-]+)-([^-]+)$", 2).alias("right"))
    kept = parts.withColumn("joined", F.concat("left", "right")).join(in_texts.select(F.col("word").alias("joined")), "joined", "left_anti")
    return (
        misread_words(in_texts).select(F.lit("description").alias("about"), F.col("word").alias("q"), F.col("meant").alias("a"))
        .unionByName(own.select(F.lit("name").alias("about"), F.col("word").alias("q"), F.col("meant").alias("a")))
        .unionByName(kept.select(F.lit("-").alias("about"), F.col("word").alias("q"), F.lit("").alias("a")))
    )


class Repairer:
    """Finds and repairs the traces of a scan with fitted line models and what is known of the corpus."""

    def __init__(self, models: dict[str, dict]) -> None:
        self.models = models

    def labelled(self, text: str, field: str) -> list[list[tuple[str, int]]]:
        """Blocks between blank lines of (line, label); the lines are labelled as one sequence."""
        blocks = [[x for x in block.split("\n") if x.strip()] for block in BLANK_LINES.split(LINE_END.sub("\n", text))]
        lines = [x for block in blocks for x in block]
        labels = iter(viterbi(self.models[field], line_features(lines)) if len(lines) > 1 else [BODY] * len(lines))
        return [[(x, label) for x, label in zip(block, islice(labels, len(block)))] for block in blocks]

    @staticmethod
    def paragraphs(blocks: list[list[tuple[str, int]]], joint: Callable[[str, str], str]) -> str:
        """The body lines as running text; ``joint``: what stands between a line that ends with a hyphen, without it, and the next one."""
        out: list[str] = []
        for block in blocks:
            parts: list[str] = []
            last = ""
            for line in (x for x, label in block if label == BODY):
                if not parts or ITEM.match(line):
                    if parts:
                        out.append("".join(parts))
                    parts = [line.rstrip()]
                else:
                    head, tail = HYPHEN.search(last), WORD_START.match(line)
                    if head and tail:
                        parts[-1] = HYPHEN_END.sub("", parts[-1])
                        parts += [joint(head.group(1).lower(), tail.group(1).lower()), line.strip()]
                    else:
                        parts += ["" if last.endswith(("-", "/")) else " ", line.strip()]
                last = line.rstrip()
            if parts:
                out.append("".join(parts))
        return "\n".join(out) if len(out) < 2 else "\n".join(p if ITEM.match(p) else ("\n" if i else "") + p for i, p in enumerate(out))

    def questions(self, text: str, field: str, known: Mapping[tuple[str, str], str] | None) -> set[tuple[str, str]]:
        """What the repair looks up: compounds first; with what is ``known`` of them, words."""
        asked: set[tuple[str, str]] = set()

        def joint(left: str, right: str) -> str:
            asked.add(("-", f"{left}-{right}"))
            return "-" if ("-", f"{left}-{right}") in (known or {}) else ""

        out = self.paragraphs(self.labelled(text, field), joint)
        return asked if known is None else {(field, w) for w in tokens(out)}

    def repair(self, text: str, field: str, known: Mapping[tuple[str, str], str]) -> tuple[set[str], str]:
        """The kinds of traces found, and the text without them."""
        traces: set[str] = set()
        blocks = self.labelled(text, field) if "\n" in text or "\r" in text else [[(text, BODY)]]
        labels = {label for block in blocks for _, label in block}
        if HEADER in labels:
            traces.add("header")
        if BREAK in labels:
            traces.add("page number")

        def joint(left: str, right: str) -> str:
            if ("-", f"{left}-{right}") in known:
                return "-"
            traces.add("hyphen")
            return ""

        out = self.paragraphs(blocks, joint)
        if field == "name" and NAME_SYMBOL.search(out):
            traces.add("character")
        wrong = {w: m for w in tokens(out) if (m := known.get((field, w))) is not None}
        if wrong:
            traces.add("character")

            def mend(m: re.Match) -> str:
                word = m.group()
                bare = word.strip(AROUND) if word.lower() not in wrong else word
                fixed = wrong.get(bare.lower())
                if fixed is None:
                    return word
                capital = next((c.isupper() for c in bare if c.isalpha()), False) if field == "description" else bare[:1].isupper() or not bare[:1].isalpha()
                at = word.find(bare)
                return word[:at] + (fixed.capitalize() if capital else fixed) + word[at + len(bare) :]

            out = TOKEN.sub(mend, out)
        return traces, out


def corpus_counts(df: DataFrame) -> DataFrame:
    """``kind, item, n``: words of descriptions and of names, and expected counts of both line models, over all rows of (field, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {f: start_model(f == "name") for f in ("name", "description")}
        words = (Counter(), Counter())
        expected: dict[str, Counter] = {f: Counter() for f in models}

        def rows() -> pd.DataFrame:
            out = [(kind, t, float(n)) for kind, c in zip(("word", "name word"), words) for w, n in c.items() if (t := w.strip(AROUND))] + [(f, k, n) for f, c in expected.items() for k, n in c.items()]
            return pd.DataFrame(out, columns=["kind", "item", "n"])

        for batch in batches:
            for field, text in zip(batch["field"], batch["text"]):
                words[field == "name"].update(TOKEN.findall(text.lower()))
                if "\n" in text or "\r" in text:
                    features = line_features([x for x in LINE_END.split(text) if x.strip()])
                    c = expected[field]
                    # No text counts for more than LINES lines, so that a few long ones can't turn the model.
                    share = min(1.0, LINES / max(1, len(features)))
                    single, pairs = posteriors(models[field], features)
                    for s in range(3):
                        if single:
                            c[f"first:{s}"] += share * single[0][s]
                        for x, p in zip(features, single):
                            for f, v in enumerate(x):
                                c[f"emit:{s}:{f}:{v}"] += share * p[s]
                        for p in pairs:
                            for t in range(3):
                                c[f"next:{s}:{t}"] += share * p[s][t]
            if sum(map(len, words)) > 500_000:
                yield rows()
                words[0].clear()
                words[1].clear()
                expected = {f: Counter() for f in models}
        yield rows()

    return df.mapInPandas(count, "kind string, item string, n double").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def repair_scans(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """``key, field, traces, text``: every field that carries traces of a scan, their kinds, and the repaired text.

    ``fields``: 'name' and 'description' to the columns that hold them.
    """
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in fields.items()))
    texts = df.select(F.col(key).alias("key"), F.explode(entries).alias("e")).select("key", "e.*").filter(F.trim("text") != "")
    counts = stored(corpus_counts(texts.select("field", "text")))
    expected: dict[str, dict[str, float]] = {f: {} for f in fields}
    for r in counts.filter(F.col("kind").isin(*fields)).collect():  # some seventy numbers for each field
        expected[r["kind"]][r["item"]] = r["n"]
    models = {f: fitted(start_model(f == "name"), e) for f, e in expected.items()}
    known = stored(answers(counts))
    sent = known.limit(MOST + 1).collect()
    if len(sent) <= MOST:
        everywhere = df.sparkSession.sparkContext.broadcast({(r["about"], r["q"]): r["a"] for r in sent})
        rows = texts.withColumn("known", F.lit(None).cast(ANSWERS))
    else:
        everywhere = None
        rows = with_own_answers(texts, models, known)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(models)
        for batch in batches:
            out = []
            for k, f, t, own in zip(batch["key"], batch["field"], batch["text"], batch["known"]):
                traces, text = repairer.repair(t, f, everywhere.value if everywhere else own_answers(own))
                if traces:
                    out.append((k, f, sorted(traces), text))
            yield pd.DataFrame(out, columns=["key", "field", "traces", "text"])

    return rows.select("key", "field", "text", "known").mapInPandas(run, f"key {kind}, field string, traces array<string>, text string").dropDuplicates(["key", "field"])


ANSWERS = "array<struct<about:string,q:string,a:string>>"


def own_answers(rows) -> dict[tuple[str, str], str]:
    return {} if rows is None else {(r["about"], r["q"]): r["a"] for r in rows}


def with_own_answers(texts: DataFrame, models: dict[str, dict], known: DataFrame) -> DataFrame:
    """``texts`` with ``known``: the answers (q, a) to the questions of each text, first on compounds, then on words."""
    rows = stored(texts.withColumn("__u", F.monotonically_increasing_id()).withColumn("known", F.lit(None).cast(ANSWERS)))
    for compounds in (True, False):

        def ask(batches: Iterator[pd.DataFrame], compounds: bool = compounds) -> Iterator[pd.DataFrame]:
            repairer = Repairer(models)
            for batch in batches:
                asked = [(u, *q) for u, f, t, own in zip(batch["__u"], batch["field"], batch["text"], batch["known"]) for q in repairer.questions(t, f, None if compounds else own_answers(own))]
                yield pd.DataFrame(asked, columns=["__u", "about", "q"])

        asked = rows.select("__u", "field", "text", "known").mapInPandas(ask, "__u bigint, about string, q string")
        got = asked.join(known, ["about", "q"]).groupBy("__u").agg(F.collect_set(F.struct("about", "q", "a")).alias("__got"))
        none = F.expr(f"cast(array() as {ANSWERS})")
        joined = rows.join(got, "__u", "left").withColumn("known", F.concat(F.coalesce("known", none), F.coalesce("__got", none)))
        rows = stored(joined.drop("__got"))
    return rows.drop("__u")
