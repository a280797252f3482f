"""Matching entities across sources without keys (problem 7).

Mentions (corrections) and records (items) are parsed into words and a designation (II, Mk 2, X4, ...). Candidate pairs share
the category, the designation and the book where the mention names a known one, and their log-odds, from the words, book and page, are above ``LEAST``. All of them are
found, however many records have a word: blocks are of words and pages that such odds need (see ``candidate_pairs``), not bounded in size. Loopy belief
propagation then exchanges messages between mentions and records through joins until the marginals settle:
a mention's factor allows at most one record; a record's factor weighs every further mention by ``SHARE``, since several
corrections may speak of one item (0 would be a hard one-to-one factor). Marginal probabilities are reported. Mentions whose records nobody
else speaks of need no messages. A pair of lesser odds is no candidate and counts nowhere.

Copies are collapsed first: records equal in category, book, words, designation and page are one entity (its smallest row key
stands for it), mentions likewise, so hot groups of copies neither multiply pairs nor messages. Hot mentions get their result by
``lookup_with_heavy``.

Defined results
- A mention without a name or category, or whose best marginal is under ``ACCEPT``, has no match; ties share the probability and
  so have none, unless another mention claims all but one of the tied records. Unequal designations never match. A mention delivered several times is reported once.
- A null page or book says nothing; a book that the registry does not know says nothing either.
- Words of very long names are all used. Empty tables give no rows. If messages have not settled after ``ROUNDS`` rounds, a warning says by how much.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut, lookup_with_heavy, stored

SHARE = 0.5
ACCEPT = 0.5
ROUNDS = 200
#: Messages are damped from this round on, in case they swing.
DAMPED = 10
TOLERANCE = 1e-3
#: Log-odds of a candidate are above this.
LEAST = -3.0
#: Known words of more letters are compared by their parts.
LONG = 24
#: Bounds nothing any more, as blocks are of any size.
BLOCK = 200
#: Most words that are broadcast; more are joined.
MOST = 200_000
#: Pages so far apart still speak for each other.
PAGES = 2

#: Words of designations, and remarks that are no part of a name.
DESIGNATIONS = frozenset({"se", "lx", "plus", "compact"})
NUMBERED = frozenset({"mk", "gen", "no"})
REMARK = re.compile(r"\((?:errata|variant|p\.? ?\d+|reprint|see [^)]*|\d+(?:st|nd|rd|th) printing)\)|\[[^\]]*\]|[*®™†]", re.I)
UNMARKED = str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "’": "'", "_": " "})
CAMEL = re.compile(r"(?<=[a-z0-9.)])(?=[A-Z(])|(?<=[A-Za-z])(?=\()|(?<=[A-Z]{2})(?=[A-Z][a-z])")
NUMBER_WORD = re.compile(r"\b(mk|gen|no)\.?[\s-]*(?=\d)", re.I)
NAME_TOKEN = re.compile(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?\.?")
ROMAN = re.compile(r"[ivx]+")
MODEL = re.compile(r"[a-z]?\d+")


def unmarked(text: str) -> str:
    """Without accents and the like."""
    if text.isascii():
        return text.replace("_", " ")
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(UNMARKED)) if not unicodedata.combining(c))


def parse_name(name: str) -> tuple[list[str], str]:
    """Words in lower case (an abbreviated one ends with a dot) and the designation, its parts sorted."""
    if "\n" in name or "\r" in name:
        lines = [x.strip() for x in re.split(r"[\r\n]+", name) if x.strip()]
        kept = [x for x in lines if any(c.islower() for c in x)] or lines
        name = re.sub(r"[-‐­] ", "", " ".join(kept))
    text = CAMEL.sub(" ", REMARK.sub(" ", unmarked(name)))
    text = NUMBER_WORD.sub(r" \1 ", text)
    if "," in text:
        head, tail = text.split(",", 1)
        text = f"{tail} {head}"
    words, parts = [], []
    tokens = [t.lower() for t in NAME_TOKEN.findall(text)]
    i = 0
    while i < len(tokens):
        bare = tokens[i].rstrip(".")
        after = tokens[i + 1].rstrip(".") if i + 1 < len(tokens) else ""
        if (bare in NUMBERED or bare == "r") and after.isdigit():
            parts.append(bare + after)
            i += 2
            continue
        if ROMAN.fullmatch(bare) or MODEL.fullmatch(bare) or bare in DESIGNATIONS:
            parts.append(bare)
        else:
            words.append(tokens[i])
        i += 1
    return words, " ".join(sorted(parts))


def book_variants(slug: str, title: str | None) -> dict[str, int]:
    """Ways to write a book, normalised, to their rank: 0 for its own names, 1 for short forms."""

    def plain(s: str) -> str:
        return re.sub(r"[^a-z0-9]+", "", unmarked(s).lower())

    out = {}
    for name in filter(None, (slug, title)):
        out |= {plain(name): 0, plain(name) + "v2": 0, plain(name) + "2ndprinting": 0}
        words = re.findall(r"[A-Za-z]+", unmarked(name))
        if len(words) > 1:
            out.setdefault(plain(words[0][0] + "".join(w[:2] for w in words[1:])), 1)
        whole, last = plain(name), len(plain(words[-1])) if words else 0
        for cut_off in range(1, last):
            out.setdefault(whole[: len(whole) - cut_off], 1)
    return out


def edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance with transpositions, ``most`` + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def word_likeness(said: str, known: str) -> float:
    bare = said.rstrip(".")
    known = known.rstrip(".")
    if bare == known:
        return 1.0
    if bare in (known + "s", known + "es") or known in (bare + "s", bare + "es"):
        return 0.95
    if said.endswith(".") and len(bare) > 1 and known.startswith(bare):
        return 0.9
    if min(len(bare), len(known)) > 3 and abs(len(bare) - len(known)) <= 2 and len(set(bare) ^ set(known)) <= 4:  # two edits change four letters at most
        d = edits(bare, known)
        if d == 1 or d == 2 and min(len(bare), len(known)) > 5:
            return 0.85 if d == 1 else 0.7
        if edits(bare, known + "s", 1) == 1:
            return 0.8
    return 0.0


def log_odds(said: list[str], known: list[str], same_book: bool | None, pages_apart: int | None, like: Callable[[str, str], float] = word_likeness) -> float:
    """Evidence that a mention speaks of a record of the same category and designation; ``like`` is ``word_likeness``, or it with a cache."""
    out = 2.0 + (0.0 if same_book is None else 4.0 if same_book else -8.0)
    out += 0.0 if pages_apart is None else 4.0 if pages_apart <= 2 else -7.0
    if said == known:
        return out + 1.0
    best, back = [], [0.0] * len(known)
    for w in said:
        likes = [like(w, k) for k in known]
        best.append(max(likes, default=0.0))
        back = list(map(max, back, likes))
    extra, missing = best.count(0.0), back.count(0.0)
    if extra and missing:
        out -= 8.0
    out -= 3.0 * extra + 1.2 * missing
    out -= sum({0.9: 0.2, 0.85: 0.7, 0.8: 1.0, 0.7: 2.0}.get(x, 0.0) for x in best)
    return out if len(back) > missing else out - 12.0


def parsed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``id, category, book, page, words, designation``; ``columns`` names where id, category, name, book and page are."""
    kind = df.select(columns["id"]).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = {n: parse_name(n) for n in batch["name"].unique()}
            got = [names[n] for n in batch["name"]]
            yield batch.drop(columns="name").assign(words=[w for w, _ in got], designation=[d for _, d in got])

    rows = df.select(*(F.col(columns[c]).alias(c) for c in ("id", "category", "name", "book", "page"))).withColumn("page", F.col("page").cast("double"))
    rows = rows.filter("name is not null and category is not null")
    return rows.mapInPandas(run, f"id {kind}, category string, book string, page double, words array<string>, designation string")


def _without_letters(word: str, most: int) -> set[str]:
    """The word and what is left of it without up to ``most`` letters."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _pieces(length: int) -> list[tuple[int, int]]:
    """Five parts of a word: two edits, a transposition of letters in two parts included, leave one as it is."""
    ends = [length * i // 5 for i in range(6)]
    return list(zip(ends, ends[1:]))


def likeness_keys(word: str, said: bool) -> set[str]:
    """Keys of which a said and a known word share one, whenever ``word_likeness`` is above 0 (and sometimes else)."""
    bare = word.rstrip(".")
    out = {bare, bare + "s", bare + "es"}
    if not said:
        out.add(bare[:2] + ".")
    elif word.endswith(".") and len(bare) > 1:
        out.add(bare[:2] + ".")
    if len(bare) > 3 and len(bare) <= (LONG + 2 if said else LONG):
        out |= _without_letters(bare, 1 if len(bare) <= 5 else 2)
        out |= set() if said else _without_letters(bare + "s", 1)
    if len(bare) > LONG - 2 and said:
        for n in range(max(LONG + 1, len(bare) - 2), len(bare) + 3):
            out |= {f"{n} {i} {bare[x + d : y + d]}" for i, (x, y) in enumerate(_pieces(n)) for d in range(-2, 3) if x + d >= 0}
    elif len(bare) > LONG:
        out |= {f"{len(bare)} {i} {bare[x:y]}" for i, (x, y) in enumerate(_pieces(len(bare)))}
    return out


def alike_words(said: DataFrame, known: DataFrame) -> DataFrame:
    """``said, known``: the distinct words (column ``word``) of either side whose likeness is above 0."""

    def keyed(of_said: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(w, k) for w in batch["word"] for k in likeness_keys(w, of_said)]
                yield pd.DataFrame(rows, columns=["w", "k"])

        return run

    def like(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[word_likeness(s, k) > 0 for s, k in zip(batch["said"], batch["known"])]]

    a = said.select("word").distinct().mapInPandas(keyed(True), "w string, k string").select(F.col("w").alias("said"), F.xxhash64("k").alias("k"))
    b = known.select("word").distinct().mapInPandas(keyed(False), "w string, k string").select(F.col("w").alias("known"), F.xxhash64("k").alias("k"))
    return stored(a.join(b, "k").select("said", "known").distinct().mapInPandas(like, "said string, known string"))


def resolve_books(mentions: DataFrame, books: DataFrame, slug: str, title: str) -> DataFrame:
    """``mentions`` with ``book`` replaced by the slug it stands for, null if it stands for none or several."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(v, s, r) for s, t in zip(batch["slug"], batch["title"]) for v, r in book_variants(s, t).items()]
            yield pd.DataFrame(rows, columns=["variant", "slug", "rank"])

    variants = books.select(F.col(slug).alias("slug"), F.col(title).alias("title")).filter("slug is not null").mapInPandas(run, "variant string, slug string, rank int")
    best = variants.groupBy("variant").agg(F.min("rank").alias("best"))
    known = variants.join(best, "variant").filter("rank = best").groupBy("variant").agg(F.min("slug").alias("slug"), F.count_distinct("slug").alias("n")).filter("n = 1").drop("n")
    plain = F.regexp_replace(F.translate(F.lower("book"), "àáâãäåçèéêëìíîïñòóôõöøùúûüý", "aaaaaaceeeeiiiinoooooouuuuy"), "[^a-z0-9]+", "")
    return mentions.withColumn("__v", plain).join(known, F.col("__v") == F.col("variant"), "left").withColumn("book", F.col("slug")).drop("__v", "variant", "slug")


def _sent(df: DataFrame) -> DataFrame:
    """Written, and broadcast if it is of at most ``MOST`` rows."""
    found = stored(df)
    return F.broadcast(found) if found.count() <= MOST else found


def _rarest(words: DataFrame, reach: DataFrame, most: int) -> DataFrame:
    """Of each name the ``most`` words that reach the fewest names of the other side: ``id, category, designation, book, page, words``, an array of (n, word) in this order, n 0 for a word that reaches none."""
    pairs = F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))
    return words.join(reach, "word", "left").groupBy("id", "category", "designation", "book", "page").agg(F.slice(F.array_sort(pairs), 1, most).alias("words"))


def block_keys(rows: DataFrame, blocks: list[tuple[str, Column, Column]]) -> DataFrame:
    """``id, key, at`` (a hash of the book) of rows (id, category, designation, book, word), once for each of ``blocks`` (kind, place, part), none where place or part is null."""
    keys = [F.when(place.isNotNull() & part.isNotNull(), F.xxhash64("category", "designation", place, F.lit(kind), "word", part)) for kind, place, part in blocks]
    return rows.select("id", F.when(F.col("book").isNotNull(), F.xxhash64("book")).alias("at"), F.explode(F.array(*keys)).alias("key")).filter("key is not null")


def candidate_pairs(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``m, e``: pairs of mention and entity classes among which all are whose ``log_odds`` are above -3.

    That can be in these ways only, and each has its blocks, of whatever size:

    - Every word of the mention is like one of the record: blocks of the mention's rarest word, as it must be among the record's.
    - Every word of the record is like one of the mention: blocks of the record's rarest word.
    - One word of either side is like none of the other. That costs 12.2 together, and 13 is all that a pair gains, by the same book and near pages (9 by either alone; a second
      such word costs 1.2 more at least): blocks of the mention's two rarest words, as one of them is like one of the record's, on near pages.

    Without a book, pages that are far apart leave odds under e^-3, so those mentions meet records on near pages and without a page.
    """
    place = ["id", "category", "designation", "book", "page"]
    said = stored(mentions.select(*place, F.explode(F.array_distinct("words")).alias("word")))
    known = stored(entities.select(*place, F.explode(F.array_distinct(F.transform("words", lambda w: F.rtrim(w, F.lit("."))))).alias("word")))
    alike = alike_words(said, known)
    of_said, of_known = said.groupBy("word").agg(F.count(F.lit(1)).alias("n")), known.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    m_reach = _sent(alike.join(of_known.withColumnRenamed("word", "known"), "known").groupBy(F.col("said").alias("word")).agg(F.sum("n").alias("n")))
    e_reach = _sent(alike.join(of_said.withColumnRenamed("word", "said"), "said").groupBy(F.col("known").alias("word")).agg(F.sum("n").alias("n")))
    likes = _sent(alike)

    def meant(words: DataFrame) -> DataFrame:
        return words.join(likes, words["word"] == likes["said"]).drop("word", "said").withColumnRenamed("known", "word")

    # blocks of pages are so long that pages near to one are in two of them at most
    long, page, book, everywhere, none, pageless = 3 * PAGES, F.col("page"), F.col("book"), F.lit("*"), F.lit(""), F.lit("-")
    low, high = (F.floor((page + d) / long).cast("string") for d in (-PAGES, PAGES))
    near = [low, F.when(low != high, high)]
    on_page = F.coalesce(F.floor(page / long).cast("string"), pageless)
    bookless = F.when(book.isNull() & page.isNotNull(), everywhere)
    loose = not mentions.filter("book is null and page is null").isEmpty()

    def m_places(kind: str) -> list[tuple[str, Column, Column]]:
        return [(kind, F.coalesce(book, F.when(page.isNull(), everywhere)), none), *((kind, bookless, p) for p in (*near, pageless))]

    def e_places(kind: str) -> list[tuple[str, Column, Column]]:
        return [(kind, book, none), (kind, everywhere, on_page), *([(kind, everywhere, none)] if loose else [])]

    of_m = _rarest(said, m_reach, 2).withColumn("two", F.size("words") > 1).select(*place, "two", F.posexplode("words").alias("nth", "b"))
    of_m = meant(of_m.filter("b.n > 0 and (nth = 0 or book is not null and page is not null)").select(*place, "two", "nth", "b.word"))
    first, both = F.col("nth") == 0, F.when(F.col("two") & book.isNotNull(), everywhere)
    m_keys = block_keys(of_m, [*((k, F.when(first, where), part) for k, where, part in m_places("mention")), *(("mention", both, p) for p in near)])
    m_keys = m_keys.unionByName(block_keys(meant(said), m_places("record")))
    of_e = _rarest(known, e_reach, 1).select(*place, F.col("words")[0].alias("b")).filter("b.n > 0").select(*place, "b.word")
    e_keys = block_keys(known.join(e_reach.select("word"), "word", "left_semi"), e_places("mention"))
    e_keys = e_keys.unionByName(block_keys(of_e, e_places("record")))
    m_keys, e_keys = m_keys.select(F.col("id").alias("m"), "key", F.col("at").alias("mb")), e_keys.select(F.col("id").alias("e"), "key", F.col("at").alias("eb"))
    return m_keys.join(e_keys, "key").filter("mb is null or mb = eb").select("m", "e").distinct()


def candidate_odds(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``m, e, w, rest``: the odds of each candidate pair of mention and entity classes; ``rest`` is 0."""
    m = mentions.select(F.col("id").alias("m"), F.col("words").alias("mw"), F.col("book").alias("mb"), F.col("page").alias("mp"), F.col("designation").alias("md"), F.col("category").alias("mc"))
    e = entities.select(F.col("id").alias("e"), F.col("words").alias("ew"), F.col("book").alias("eb"), F.col("page").alias("ep"), F.col("designation").alias("ed"), F.col("category").alias("ec"))
    rows = candidate_pairs(mentions, entities).join(m, "m").join(e, "e").filter("md = ed and mc = ec and (mb is null or mb = eb)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        like = lru_cache(maxsize=1 << 16)(word_likeness)
        for b in batches:
            odds = []
            for mw, ew, mb, eb, mp, ep in zip(b["mw"], b["ew"], b["mb"], b["eb"], b["mp"], b["ep"]):
                same = None if mb is None or eb is None else mb == eb
                apart = None if mp != mp or ep != ep or mp is None or ep is None else abs(mp - ep)
                odds.append(log_odds(list(mw), list(ew), same, apart, like))
            yield pd.DataFrame({"m": b["m"], "e": b["e"], "o": odds})

    kinds = (mentions.schema["id"].dataType.simpleString(), entities.schema["id"].dataType.simpleString())
    scored = rows.select("m", "e", "mw", "ew", "mb", "eb", "mp", "ep").mapInPandas(run, f"m {kinds[0]}, e {kinds[1]}, o double")
    return stored(scored.filter(F.col("o") > LEAST).select("m", "e", F.exp(F.least(F.col("o"), F.lit(12.0))).alias("w"))).withColumn("rest", F.lit(0.0))


def belief_propagation(edges: DataFrame, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """``m, e, p``: marginal probabilities of the edges (m, e, w: odds; rest: the mention's other odds, 0 if absent), by messages exchanged until they settle."""
    edges = edges if "rest" in edges.columns else edges.withColumn("rest", F.lit(0.0))
    shared = edges.join(edges.groupBy("e").agg(F.count(F.lit(1)).alias("claims")), "e")
    of_m = shared.groupBy("m").agg(F.max("claims").alias("most"), F.sum("w").alias("sum_m"))
    known = stored(shared.join(of_m, "m").select("m", "e", "w", "rest", "most", "sum_m"))
    alone = known.filter("most = 1").select("m", "e", (F.col("w") / (1 + F.col("rest") + F.col("sum_m"))).alias("p"))
    state = cut(known.filter("most > 1").select("m", "e", "w", "rest", F.lit(1.0).alias("from_e"), F.lit(0.0).alias("p")))
    soft = max(share, 1e-9)
    change = 0.0
    for n in range(rounds):
        into_m = state.groupBy("m").agg(F.sum(F.col("w") * F.col("from_e")).alias("sum_m"))
        half = state.join(into_m, "m").withColumn("from_m", 1 / (1 + F.col("rest") + F.greatest(F.lit(0.0), F.col("sum_m") - F.col("w") * F.col("from_e"))))
        active = F.log1p(F.lit(soft) * F.col("w") * F.col("from_m"))
        into_e = half.groupBy("e").agg(F.sum(active).alias("sum_e"))
        others = F.exp(F.least(F.lit(300.0), F.greatest(F.lit(0.0), F.col("sum_e") - active)))
        heard = others / (1 + (others - 1) / soft)
        full = half.join(into_e, "e").withColumn("next_e", heard if n < DAMPED else (heard + F.col("from_e")) / 2)
        belief = F.col("w") * F.col("next_e") * F.col("from_m")
        following = cut(full.select("m", "e", "w", "rest", F.col("next_e").alias("from_e"), (belief / (1 + belief)).alias("p"), F.abs(belief / (1 + belief) - F.col("p")).alias("change")))
        state = following.drop("change")
        change = following.agg(F.max("change")).first()[0] or 0.0
        if change < TOLERANCE:
            break
    else:
        warnings.warn(f"marginals still change by {change:.3g} after {rounds} rounds", stacklevel=2)
    return alone.unionByName(state.select("m", "e", "p"))


def match_entities(mentions: DataFrame, mention_columns: dict[str, str], records: DataFrame, record_columns: dict[str, str], books: DataFrame, slug: str, title: str) -> DataFrame:
    """``mention, record, confidence``: at most one record for each mention.

    The column mappings name where ``id``, ``category``, ``name``, ``book`` and ``page`` are found.
    """
    said = resolve_books(parsed(mentions, mention_columns), books, slug, title)
    said = stored(said)
    shape = ["category", "book", "words", "designation", "page"]
    entities = parsed(records, record_columns).groupBy(*shape).agg(F.min("id").alias("id"))
    entities = stored(entities)
    classes = said.groupBy(*shape).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes)
    marginals = belief_propagation(candidate_odds(classes, entities))
    best = marginals.groupBy("m").agg(F.max(F.struct("p", (-F.col("e")).alias("minus_e"))).alias("b")).filter(F.col("b.p") >= ACCEPT)
    result = best.select("m", (-F.col("b.minus_e")).alias("record"), F.col("b.p").alias("confidence"))
    shown = classes.join(result, classes["id"] == result["m"]).select(F.xxhash64(*shape).alias("shape"), *shape, "n", "record", "confidence")
    rows = said.select(F.xxhash64(*shape).alias("shape"), F.col("id").alias("mention"))
    found = lookup_with_heavy(rows, shown.select("shape", "n", "record", "confidence"), ["shape"], ["record", "confidence"], "n", said.count(), F.xxhash64("mention"))
    return found.groupBy("mention").agg(F.max(F.struct("confidence", "record")).alias("b")).select("mention", "b.record", "b.confidence")
