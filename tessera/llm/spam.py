"""Keyword-stuffed and link-list pages (problem 10).

Four features describe a document, each on a scale on which ordinary texts are about normal: the share of text amid function words
(density of prose) and the share of function words, both as log-odds with links and markup counting as text without any, the logarithm of
the share that its three most frequent other words have (repetition), and the words' entropy. Per language a robust centre and scatter are
estimated over all documents: medians, median deviations and decile ranges first, then ``STEPS`` reweighting steps that take mean and covariance of
the documents within ``REJECT``, all as aggregates. The spam direction of a language is the mean direction, in the units of that scatter, of its far
outliers on the side ``SPAM`` points to. A document is reported if its robust Mahalanobis distance is beyond ``CUTOFF`` and so is the part of
it that lies in the spam direction.

Nothing but ``RESOLUTION`` bounds an estimate from below: what shares over about 500 words can tell apart. Languages with few documents
borrow from all: the pooled scatter within languages counts as ``BORROWED`` documents of each.

Languages beyond ``LANGUAGES`` get their function words from the corpus: words that at least ``COMMON`` of the documents stated to be in that language hold
(so at most the mean number of different words in a document, divided by ``COMMON``), if it has ``LEAST_DOCUMENTS``.

Defined results
- Null, empty and blank texts are never reported, nor rows with a null key, nor texts of fewer than ``LEAST_WORDS`` words and links together, as titles.
- The language is that with most function words in the text; without any it is the stated one if its function words are known, else the first
  of ``LANGUAGES``. A text in a language that no document states and no list covers looks like a list of keywords.
- Texts are read whole, in slices of bounded size; rows repeated with the same key are reported once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

#: Common function words. Words shared by two lists, and those of offers ('in' stock, 'pas' cher), are left out.
LANGUAGES = {
    "en": """the a an and or but if of to is are was were be been it its this that these those there with without for from by as at on into
        over under when while until unless since because although though so than then not no nor every each all any some most many few
        several up he she they we you his her their our your who which what where how can could will would should may might must has have
        had do does did""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber wenn von zu zum zur ist sind war waren sein mit ohne für aus bei
        auf nach vor während trotz über unter bis weil obwohl dass nicht kein keine jede jeder jedes alle viele einige er sie es wir ihr
        sein seine welche wer wo wie kann wird werden hat haben""",
    "fr": """le la les un une de du des et ou mais si à au aux est sont était être avec sans pour par sur sous dans dès après avant pendant jusqu
        parce que qui quoi où comme ne plus chaque tout tous toute toutes plusieurs quelques il elle ils elles nous vous son sa ses leur
        leurs ce cette ces peut sera ont""",
}
LINK = re.compile(r"<[^<>]*>|https?://[^\s)>\]]+|www\.[^\s)>\]]+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|info|example|test|invalid)\b[^\s)>\]]*", re.I)
#: No link without one of these.
LINK_SIGN = re.compile(r"<|https?://|www\.|\.(?:com|org|net|info|example|test|invalid)\b", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
REACH = 6
LEAST_WORDS = 8
SLICE = 4_000_000
COMMON = 0.25
LEAST_DOCUMENTS = 20

FEATURES = ("prose", "function", "repetition", "entropy")
#: Signs: which way a feature of spam deviates; entropy may deviate either way.
SPAM = np.array([-1.0, -1.0, 1.0, 0.0])
RESOLUTION = np.array([0.12, 0.08, 0.12, 0.02])
REJECT = 10.0
FAR = 10.0
CUTOFF = 14.5
BORROWED = 50
STEPS = 2


def _text_words(text: str) -> tuple[list[str], float, int]:
    """(words in lower case, share of the characters outside links and markup, number of links)."""
    links, own = 0, 1.0
    if LINK_SIGN.search(text):
        rest, links = LINK.subn(" ", text)
        if links:
            own = len("".join(rest.split())) / max(1, len("".join(text.split())))
            text = rest
    return WORD.findall(text.lower()), own, links


def slice_features(texts: list[str], stated: list[str | None], lists: dict[str, frozenset[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the texts long enough to tell, their languages, their features), all texts at once."""
    parsed = [_text_words(t) for t in texts]
    kept = np.array([i for i, (w, _, k) in enumerate(parsed) if len(w) + k >= LEAST_WORDS], int)
    codes = list(lists)
    if not len(kept):
        return kept, np.array([], object), np.zeros((0, len(FEATURES)))
    parsed = [parsed[i] for i in kept]
    size = np.array([len(w) for w, _, _ in parsed])
    own = np.array([o for _, o, _ in parsed])
    d, total = len(parsed), int(size.sum())
    doc = np.repeat(np.arange(d), size)
    ends = np.cumsum(size)
    starts = ends - size
    word, distinct = pd.factorize(np.array([w for ws, _, _ in parsed for w in ws], dtype=object))
    known = np.array([[w in lists[c] for w in distinct] for c in codes], bool).reshape(len(codes), len(distinct))
    hits = np.stack([np.bincount(doc, weights=known[c][word], minlength=d) for c in range(len(codes))]) if total else np.zeros((len(codes), d))
    said = np.array([[stated[i] == c for i in kept] for c in codes], float)
    language = (hits + 0.5 * said).argmax(axis=0)  # ties go to the stated language
    flags = known[language[doc], word]
    before = np.concatenate([[0], np.cumsum(flags)])
    at = np.arange(total)
    near = before[np.minimum(ends[doc], at + REACH + 1)] - before[np.maximum(starts[doc], at - REACH)]
    n = np.maximum(1, size)
    prose = own * np.bincount(doc, weights=near >= np.minimum(2, size[doc]), minlength=d) / n
    function = own * np.bincount(doc, weights=flags, minlength=d) / n
    pair, count = np.unique(doc * max(1, len(distinct)) + word, return_counts=True)
    owner, kind = pair // max(1, len(distinct)), pair % max(1, len(distinct))
    share = count / n[owner]
    entropy = np.bincount(owner, weights=-share * np.log2(share), minlength=d)
    entropy = np.minimum(1.0, np.where(size > 1, entropy / np.log2(np.maximum(2, size)), 1.0))
    other = np.flatnonzero(~known[language[owner], kind])
    order = other[np.lexsort((-count[other], owner[other]))]
    first = np.searchsorted(owner[order], owner[order])
    top = order[np.arange(len(order)) - first < 3]
    repetition = np.where(size > 20, np.bincount(owner[top], weights=count[top], minlength=d) / n, 0.0)
    features = np.stack([np.log((prose + 0.05) / (1.05 - prose)), np.log((function + 0.01) / (1.01 - function)), np.log(repetition + 0.02), entropy], axis=1)
    return kept, np.array(codes, object)[language], features


def function_words(df: DataFrame, text: str, lang: str) -> dict[str, frozenset[str]]:
    """The fixed lists, and the words common in the documents of every other stated language; over all of its documents."""
    rows = df.select(F.col(lang).alias("language"), F.lower(text).alias("text")).filter(F.col("language").isNotNull() & ~F.col("language").isin(*LANGUAGES) & (F.trim("text") != ""))
    held = rows.select("language", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}+(?:['’]\p{L}+)*)"), F.lit(1)))).alias("word"))
    sizes = rows.groupBy("language").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= LEAST_DOCUMENTS)
    common = held.groupBy("language", "word").agg(F.count(F.lit(1)).alias("n")).join(sizes, "language").filter(F.col("n") >= COMMON * F.col("documents"))
    lists = {code: set(words.split()) for code, words in LANGUAGES.items()}
    for r in common.select("language", "word").collect():
        lists.setdefault(r["language"], set()).add(r["word"])
    return {code: frozenset(words) for code, words in lists.items()}


def document_features(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, language`` and the features of every document that is long enough."""
    kind = df.schema[key].dataType.simpleString()
    lists = function_words(df, text, lang)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = (batch["text"].str.len().cumsum() // SLICE).to_numpy()
            for p in np.unique(part):
                rows = batch[part == p]
                kept, language, features = slice_features(rows["text"].tolist(), rows["stated"].tolist(), lists)
                out = pd.DataFrame(features, columns=list(FEATURES))
                out.insert(0, "language", language)
                out.insert(0, "key", rows["key"].to_numpy()[kept] if len(kept) else [])
                yield out

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("stated")).filter(F.trim("text") != "")
    return rows.filter("key is not null").mapInPandas(run, f"key {kind}, language string, " + ", ".join(f"{f} double" for f in FEATURES))


def _per_language(values: dict, column) -> Column:
    out = F.lit(None).cast("double")
    for code, value in values.items():
        out = F.when(F.col("language") == code, column(value)).otherwise(out)
    return out


def _whitened(models: dict[str, tuple[np.ndarray, np.ndarray]]) -> list:
    """The deviation from the language's centre in the units of its scatter, one column a dimension."""
    out = []
    for k in range(len(FEATURES)):
        def column(model, k=k):
            centre, scatter = model
            row = np.linalg.cholesky(np.linalg.inv(scatter)).T[k]
            return sum((F.lit(float(row[i])) * (F.col(f) - F.lit(float(centre[i]))) for i, f in enumerate(FEATURES)), F.lit(0.0))

        out.append(_per_language(models, column))
    return out


def _square(columns: list):
    return sum((c * c for c in columns[1:]), columns[0] * columns[0])


def robust_models(features: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and scatter of each language; only aggregates of a few numbers per language reach the driver."""
    p = len(FEATURES)
    quantiles = features.groupBy("language").agg(*(F.percentile_approx(f, [0.1, 0.5, 0.9], 10000).alias(f) for f in FEATURES)).collect()
    medians = {r["language"]: np.array([r[f][1] for f in FEATURES]) for r in quantiles}
    deciles = {r["language"]: np.array([(r[f][2] - r[f][0]) / 2.5631 for f in FEATURES]) for r in quantiles}
    away = [F.abs(F.col(f) - _per_language({c: m[i] for c, m in medians.items()}, lambda v: F.lit(float(v)))).alias(f) for i, f in enumerate(FEATURES)]
    deviations = features.select("language", *away).groupBy("language").agg(*(F.percentile_approx(f, 0.5, 10000).alias(f) for f in FEATURES)).collect()
    least = np.diag(RESOLUTION**2)
    models = {}
    for r in deviations:
        c = r["language"]
        models[c] = (medians[c], np.diag(np.maximum.reduce([deciles[c], 1.4826 * np.array([r[f] for f in FEATURES]), RESOLUTION]) ** 2))
    for _ in range(STEPS):
        inside = features.filter(_square(_whitened(models)) <= REJECT**2)
        sums = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
        sums += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
        rows = inside.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
        own = {r["language"]: (r["n"], np.array([r[f"m{i}"] for i in range(p)]), np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])) for r in rows}
        total = sum(n for n, _, _ in own.values())
        pooled = sum(n * cov for n, _, cov in own.values()) / max(1, total) if own else least
        for c, (n, mean, cov) in own.items():
            cov = (n * cov + BORROWED * pooled) / (n + BORROWED)
            # Directions that the corpus leaves nearly empty are as wide as the resolution.
            scale = np.sqrt(np.maximum(np.diag(cov), RESOLUTION**2))
            correlation = cov / np.outer(scale, scale)
            np.fill_diagonal(correlation, 1.0)
            models[c] = (mean, (0.95 * correlation + 0.05 * np.eye(p)) * np.outer(scale, scale))
    return models


def spam_directions(features: DataFrame, models: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """The unit vector, in the units of the scatter, in which the far outliers of each language on the spam side lie."""
    z = [F.col(f"z{k}") for k in range(len(FEATURES))]
    side = _per_language(models, lambda m: sum((F.lit(float(s / np.sqrt(m[1][i, i]))) * (F.col(FEATURES[i]) - F.lit(float(m[0][i]))) for i, s in enumerate(SPAM) if s), F.lit(0.0)))
    far = features.select("language", side.alias("side"), *(w.alias(f"z{k}") for k, w in enumerate(_whitened(models)))).withColumn("d", F.sqrt(_square(z)))
    means = far.filter((F.col("d") > FAR) & (F.col("side") > 0)).groupBy("language").agg(*(F.avg(c / F.col("d")).alias(f"u{k}") for k, c in enumerate(z))).collect()
    out = {}
    for r in means:
        u = np.array([r[f"u{k}"] for k in range(len(FEATURES))])
        out[r["language"]] = u / max(1e-12, float(np.linalg.norm(u)))
    return out


def spam_pages(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, language, distance, towards``: documents that are outliers in the direction of spam; ``towards``: the part of the distance in it."""
    features = cut(document_features(df, key, text, lang))
    models = robust_models(features)
    directions = spam_directions(features, models)
    z = _whitened(models)
    towards = _per_language(directions, lambda u: sum((F.lit(float(x)) * z[k] for k, x in enumerate(u)), F.lit(0.0)))
    scored = features.select("key", "language", F.sqrt(_square(z)).alias("distance"), towards.alias("towards"))
    return scored.filter((F.col("distance") > CUTOFF) & (F.col("towards") > CUTOFF)).dropDuplicates(["key"])
