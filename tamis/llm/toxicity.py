"""Toxicity by a classifier chain: linear models in a fixed order of categories, each of which sees, beside the words,
the probabilities of the categories before it. The probabilities that a later model is trained on are out of fold.

Labels say only whether a text is toxic. The categories before that are kinds of toxic texts, learnt from the labelled rows
in whatever language they are: the words that speak for the label fall into groups that go together in the same texts, and
a toxic text is of the kinds that it has words of. No word is fixed beforehand.

Features and kinds are learnt from labels, so a fold has its own: what a later model is trained on comes from models that
have seen nothing of the rows they answer for, neither in their weights nor in the choice of features and kinds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import labelled_sample, stable
from .linear import Rows, fit_logistic, sigmoid

#: Labelled rows of each class that the chain is fitted on (in expectation), words and beginnings of words it looks at
#: (those that tell the classes apart best).
TRAIN_PER_CLASS = 4000
FEATURES = 1200
#: A feature must be in so many distinct labelled texts, and be so many standard errors from chance.
LEAST_TEXTS, LEAST_Z = 4, 3.5
PREFIX = 5
FOLDS = 5
THRESHOLD = 0.5
#: Kinds of toxic texts that are learnt, in order of the number of their texts; the label itself is the last category.
KINDS = 3
CATEGORIES = (*(f"kind_{i + 1}" for i in range(KINDS)), "toxic")

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    """The words of the whole text in lower case; marked by ^, their first PREFIX characters; with one more ^ each, those
    that two and that three different words begin with."""
    words = set(_WORD.findall((text or "").lower()))
    starts = Counter(w[:PREFIX] for w in words)
    return words.union(("^" + s for s in starts), ("^^" + s for s, n in starts.items() if n > 1), ("^^^" + s for s, n in starts.items() if n > 2))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(words_of(t)) for t in texts])


@dataclass
class Chain:
    """`weights` of each category in order: of the features, then of the logits of the categories before it, then a bias."""

    categories: tuple[str, ...]
    places: dict[str, int]
    weights: list[np.ndarray]

    @classmethod
    def fit(cls, categories: tuple[str, ...], features: list[str], found: list[list[int]], y: np.ndarray, fold: np.ndarray, weight: np.ndarray, within: dict[int, tuple[set[int], np.ndarray]] | None = None, every: set[int] | None = None) -> Chain:
        """`found` has the places of each row's features, `y` a column of 0 and 1 for each category, `fold` the part that
        a row is left out with. `within` has for each fold the places of the features, and the columns for all rows, as
        learnt without its rows; by default they are the same for all. `every` has the places of the features of the chain
        itself, by default all."""
        earlier, weights, n = np.zeros((len(found), 0)), [], len(features)
        whole = [[p for p in row if p in every] for row in found] if every is not None else found
        folds = np.unique(fold).tolist()
        known = {f: ([[p for p in row if p in within[f][0]] for row in found], within[f][1]) if within else (found, y) for f in folds}
        for k in range(len(categories)):
            out_of_fold = np.zeros(len(found))
            for f in folds:
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(inside):
                    own, target = known[f]
                    w = fit_logistic(Rows(earlier[inside], [own[i] for i in inside], n), target[inside, k], weight[inside])
                    out_of_fold[outside] = Rows(earlier[outside], [own[i] for i in outside], n).dot(w)
            weights.append(fit_logistic(Rows(earlier, whole, n), y[:, k], weight))
            earlier = np.concatenate((earlier, _damped(out_of_fold)[:, None]), axis=1)
        return cls(categories, {f: i for i, f in enumerate(features)}, weights)

    def predict(self, found: Iterable[int]) -> list[float]:
        """The probability of each category for a text that has these features."""
        found, earlier, out = list(found), [], []
        n = len(self.places)
        for w in self.weights:
            score = w[-1] + w[found].sum() + sum(a * b for a, b in zip(w[n:-1], earlier, strict=True))
            earlier.append(float(_damped(score)))
            out.append(float(sigmoid(score)))
        return out

    def find(self, text: str | None) -> list[int]:
        return [self.places[w] for w in words_of(text) if w in self.places]


def _damped(score):
    """Earlier categories speak by a bounded logit."""
    return np.clip(score, -6, 6) / 6


def kinds_of(found: list[list[int]], toxic: np.ndarray, speaks: np.ndarray, kinds: int = KINDS, like: list[set[int]] | None = None) -> tuple[np.ndarray, list[set[int]]]:
    """For each row 1 or 0 for each kind, and the features of each kind. The features marked by `speaks` are grouped by the
    toxic rows that they are in: spherical k-means, begun with the most frequent feature and then those least like the
    ones before. Kinds stand by the number of their rows, or in the order of those of `like` that they share most with."""
    rows = np.flatnonzero(toxic)
    table = np.zeros((len(rows), len(speaks)), np.float32)
    for i, r in enumerate(rows):
        table[i, found[r]] = 1
    chosen = np.flatnonzero(speaks & (table.sum(axis=0) > 0))
    out = np.zeros((len(found), kinds))
    if not len(chosen):
        return out, [set() for _ in range(kinds)]
    unit = table[:, chosen].T / np.linalg.norm(table[:, chosen], axis=0)[:, None]
    centres = [unit[int(np.argmax(table[:, chosen].sum(axis=0)))]]
    while len(centres) < min(kinds, len(chosen)):
        centres.append(unit[int(np.argmin((unit @ np.stack(centres).T).max(axis=1)))])
    centres = np.stack(centres)
    for _ in range(20):
        group = np.argmax(unit @ centres.T, axis=1)
        sums = np.stack([unit[group == k].sum(axis=0) if (group == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    has = np.stack([(table[:, chosen[group == k]] > 0).any(axis=1) for k in range(len(centres))], axis=1)
    order = np.argsort(-has.sum(axis=0), kind="stable").tolist()
    groups = [set(chosen[group == k].tolist()) for k in range(len(centres))]
    places = list(range(len(order)))
    if like:
        free, places = list(range(kinds)), []
        for k in order:
            best = max(free, key=lambda j: (len(groups[k] & like[j]), -j))
            free.remove(best)
            places.append(best)
    out[rows[:, None], np.array(places)[None, :]] = has[:, order]
    words: list[set[int]] = [set() for _ in range(kinds)]
    for k, place in zip(order, places, strict=True):
        words[place] = groups[k]
    return out, words


def fit_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_PER_CLASS) -> Chain | None:
    """A chain fitted on a sample of labelled rows, drawn by a hash of the id at rates that come from all labels.

    Of equal texts one counts. Null labels, ids and texts are passed over; without labels of both classes there is none.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    sample = F.broadcast(labelled_sample(known, "y", per_class, "id"))  # about 2 * per_class pairs of numbers
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(sample, "id").select("text", "y").groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("y").alias("toxic"))
    rows = stable(rows.select("h", "toxic", _words_udf("text").alias("words")))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    # for all rows (-1) and without each fold: which features tell the classes apart, and to which side they lean
    fold = F.pmod("h", F.lit(FOLDS)).cast("int")
    by_fold = rows.groupBy(fold.alias("fold"), "toxic").agg(F.count("*").alias("n")).collect()
    sizes = {f: [sum(r["n"] for r in by_fold if r["toxic"] == k and r["fold"] != f) for k in (0, 1)] for f in range(-1, FOLDS)}
    each = [F.sum(F.when(F.col("fold") != f, F.col("toxic") if k else 1 - F.col("toxic")).otherwise(0)).alias(f"n{k}_{f + 1}") for f in range(-1, FOLDS) for k in (0, 1)]
    counted = rows.select("toxic", fold.alias("fold"), F.explode("words").alias("word")).groupBy("word").agg(*each)
    counted = stable(counted.where(F.col("n0_0") + F.col("n1_0") >= LEAST_TEXTS))  # a feature in fewer texts is in fewer without a fold, too
    strong = []
    for f, (clean, bad) in sizes.items():
        a, b = F.col(f"n1_{f + 1}"), F.col(f"n0_{f + 1}")
        odds = lambda hits, total: F.log((hits + 0.5) / (F.lit(total + 0.5) - hits))
        z = (odds(a, bad) - odds(b, clean)) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))  # log odds in standard errors
        strength = F.abs("z")
        rows_of_fold = counted.select("word", z.alias("z"), (a + b).alias("texts"), F.lit(f).alias("fold")).where((F.col("texts") >= LEAST_TEXTS) & (strength >= LEAST_Z))
        strong.append(rows_of_fold.orderBy(F.desc(strength), "word").limit(FEATURES))
    leans: dict[int, dict[str, bool]] = {f: {} for f in sizes}
    for r in reduce(DataFrame.unionByName, strong).collect():  # FEATURES for each fold at most
        leans[r["fold"]][r["word"]] = r["z"] > 0
    if not leans[-1]:
        return None
    features = sorted(set().union(*leans.values()))
    places = F.array_sort(F.array_intersect("words", F.from_json(F.lit(_json(features)), "array<string>")))
    got = rows.select("h", "toxic", places.alias("words")).toArrow().to_pylist()
    got.sort(key=lambda r: r["h"])
    at = {f: i for i, f in enumerate(features)}
    found = [[at[w] for w in r["words"]] for r in got]
    toxic, folds = np.array([r["toxic"] for r in got], np.float64), np.array([r["h"] % FOLDS for r in got])
    speaks = {f: np.array([x[w] if (w in x and not w.startswith("^")) else False for w in features]) for f, x in leans.items()}
    kinds, words = kinds_of(found, toxic, speaks[-1])
    y = np.concatenate((kinds, toxic[:, None]), axis=1)
    within = {}
    for f in np.unique(folds).tolist():
        own, _ = kinds_of(found, toxic * (folds != f), speaks[f], like=words)
        within[f] = {at[w] for w in leans[f]}, np.concatenate((own, toxic[:, None]), axis=1)
    share = np.array([totals[0] / n[0], totals[1] / n[1]])  # as many as there are, though the classes were drawn alike
    weight = share[y[:, -1].astype(int)]
    every = {at[w] for w in leans[-1]}
    return Chain.fit(CATEGORIES, features, found, y, folds, weight, within, every)


def _json(values: list[str]) -> str:
    import json

    return json.dumps(values)


def category_probabilities(text: Column, chain: Chain | None, df: DataFrame) -> Column:
    """A struct with the probability of each of CATEGORIES; all 0 for a null or empty text, or without a chain."""
    held = df.sparkSession.sparkContext.broadcast(chain)  # FEATURES words and a few vectors of numbers for them

    def predict(texts: pd.Series) -> pd.DataFrame:
        model, none = held.value, [0.0] * len(CATEGORIES)
        return pd.DataFrame([model.predict(model.find(t)) if model is not None and t else none for t in texts], columns=list(CATEGORIES))

    return F.pandas_udf(predict, T.StructType([T.StructField(c, T.DoubleType()) for c in CATEGORIES]))(text)


def toxicity(df: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of `df`: doc_id, is_toxic and p_<category> of each category, from the whole text alone.

    Repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """
    asked = df.select(F.col(id_col).alias("doc_id"), category_probabilities(F.col(text_col).cast("string"), chain, df).alias("p"))
    return asked.select("doc_id", (F.col("p.toxic") >= threshold).alias("is_toxic"), *[F.col(f"p.{c}").alias(f"p_{c}") for c in CATEGORIES])
