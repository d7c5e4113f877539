"""Which of many literals a text contains, from one pass over it.

The literals are compiled to an automaton, once in each Python worker, that follows all of them at the same time; the time
is that of the text and of what it finds, however many literals there are.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=64)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, word in enumerate(words):
        out.add_word(word, i)
    out.make_automaton()
    return out


def contained(text: str, words: tuple[str, ...]) -> list[int]:
    """The numbers of the words that `text` contains, ascending; overlapping ones are all found."""
    return sorted({i for _, i in automaton(words).iter(text)}) if words else []


def _bytes_before(text: str) -> np.ndarray:
    """For each place of a text, and its end, how many bytes of UTF-8 stand before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))))


def placed(text: str, words: tuple[str, ...]) -> list[tuple[int, int, int]]:
    """(number, start, end) of every occurrence of the words, overlapping ones too, in bytes."""
    hits = [(i, end + 1 - len(words[i]), end + 1) for end, i in automaton(words).iter(text)] if words else []
    if hits and not text.isascii():
        at = _bytes_before(text)
        hits = [(i, int(at[a]), int(at[b])) for i, a, b in hits]
    return hits


def literal_places(text: Column, words: Iterable[str]) -> Column:
    """An array of (word, start, end) of every occurrence of each of `words`, none of them empty, in bytes."""
    words = tuple(dict.fromkeys(words))
    if "" in words:
        raise ValueError("the empty word is everywhere")

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else placed(t, words) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<struct<word:int,start:bigint,end:bigint>>")(text)


def literals_in(text: Column, words: Iterable[str]) -> Column:
    """An array of those of `words` that `text` contains as they are written, in their order; null for a null text. Repeated
    words count once, and the empty one is in every text."""
    words = tuple(dict.fromkeys(words))
    solid = tuple(w for w in words if w)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else contained(t, solid) for t in texts], dtype=object)

    at = F.pandas_udf(run, T.ArrayType(T.IntegerType()))(text)
    names = F.array(*map(F.lit, solid)).cast("array<string>")
    found = F.transform(at, lambda i: F.get(names, i))
    return found if len(solid) == len(words) else F.when(text.isNotNull(), F.concat(F.array(F.lit("")), found))
