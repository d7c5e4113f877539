"""Token counts by a tokenizer compiled to finite-state transducers.

Two machines run one after the other. The lexer is a deterministic automaton of five states over classes of characters;
its transitions say where a piece starts. A run of text is cut into chunks of equal length, every chunk is read from all
states at once, which gives its state map, and the maps are composed by a parallel prefix scan; then the state before
each chunk is known. The second machine reads the bytes of a piece. Its transitions carry the tokens that they add to
(or take from) the count of the prefix read so far; they are made on first use, and states that no continuation can tell
apart are one: a state holds the longest end of the prefix that a token may begin with, and for each place in it the last
token of the piece's encoding up to there. That last token is the only one whose pair with the token before it is left
as it is by the merges, which is what makes the encoding of every prefix known step by step.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a chunk, characters of a run, pieces whose counts are kept, and states after which the machine is made anew.
CHUNK = 64
RUN_CHARS = 1 << 20
PIECES_KEPT = 300_000
STATES_KEPT = 150_000

#: Fixed values that the lexer is compiled for: what splits a text, and white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# classes of characters: white space, letter, digit, other, an apostrophe with which 1 or 2 letters make a piece
_WHITE, _LETTER, _DIGIT, _OTHER, _SHORT, _LONG = range(6)
# states: no piece is open, in a run of letters, in a run of others, 1 or 2 more characters belong to the piece
_NONE, _IN_LETTERS, _IN_OTHERS, _ONE_MORE, _TWO_MORE = range(5)
_NEXT = np.array(
    [
        [_NONE, _IN_LETTERS, _NONE, _IN_OTHERS, _ONE_MORE, _TWO_MORE],
        [_NONE, _IN_LETTERS, _NONE, _IN_OTHERS, _ONE_MORE, _TWO_MORE],
        [_NONE, _IN_LETTERS, _NONE, _IN_OTHERS, _IN_OTHERS, _IN_OTHERS],
        [_NONE] * 6,
        [_ONE_MORE] * 6,
    ],
    np.int8,
)
_STARTS = np.array(
    [
        [0, 1, 1, 1, 1, 1],
        [0, 0, 1, 1, 1, 1],
        [0, 1, 1, 0, 0, 0],
        [0] * 6,
        [0] * 6,
    ],
    bool,
)
_STATES = len(_NEXT)


def _classes() -> np.ndarray:
    """The class of every code point, by the Unicode version of the library's patterns: Python's own knows other letters."""
    from tokenizers import Regex, pre_tokenizers

    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    every = "".join(map(chr, points.tolist()))
    out = np.full(0x110000, _OTHER, np.int8)
    for pattern, kind in ((r"[\p{L}]+", _LETTER), (r"[\p{N}]+", _DIGIT)):
        inside = np.ones(len(points), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(every):
            inside[a:b] = False
        out[points[inside]] = kind
    out[[ord(c) for c in WHITE]] = _WHITE
    return out


def _later() -> np.ndarray:
    """Code points that Python's Unicode does not know; the library's may give them a lower case, an order or a composition."""
    return np.array([unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)])


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def lex(points: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a text."""
    kinds = classes[points]
    n = len(kinds)
    # a class may depend on the next two characters: a transducer with that much lookahead
    after = np.concatenate((points[1:], [0, 0, 0])).astype(np.uint32)
    first, second = after[:n], after[1 : n + 1]
    quote = points == ord("'")
    kinds = np.where(quote & np.isin(first, [ord(c) for c in "stmd"]), _SHORT, kinds)
    pair = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    kinds = np.where(quote & pair, _LONG, kinds).astype(np.int8)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, _WHITE, np.int8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    # the state map of each chunk
    maps = np.broadcast_to(np.arange(_STATES, dtype=np.int8), (rows, _STATES)).copy()
    for column in grid:
        maps = _NEXT[maps, column[:, None]]
    # composed from the first chunk up to each: an inclusive scan in log steps
    step = 1
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
        step *= 2
    state = np.concatenate(([_NONE], maps[:-1, _NONE])) if rows else np.zeros(0, np.int8)
    opens = np.zeros((CHUNK, rows), bool)
    for i, column in enumerate(grid):
        opens[i] = _STARTS[state, column]
        state = _NEXT[state, column]
    starts = np.flatnonzero(opens.T.ravel()[:n])
    stops = np.flatnonzero((opens.T.ravel()[:n]) | (kinds == _WHITE))
    ends = np.concatenate((stops, [n]))[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    return starts, ends


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself if it is printable, else the next free
    one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


@dataclass(frozen=True)
class WordTokenizer:
    """The text of a tokenizer file: byte-level BPE whose last symbol of a piece has a suffix."""

    source: str
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def from_file(cls, path: str) -> WordTokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(f.read()).checked()

    def checked(self) -> WordTokenizer:
        """ValueError for a file that says something else than what these machines are compiled for."""
        x = json.loads(self.source)
        parts = [p["type"] for p in x["normalizer"]["normalizers"]]
        split = x["pre_tokenizer"]["pretokenizers"]
        if parts != ["NFC", "Replace", "Lowercase"] or split[0]["pattern"] != {"Regex": SPLIT} or [p["type"] for p in split] != ["Split", "ByteLevel"]:
            raise ValueError("another normalizer or pattern than this lexer's")
        if x["model"]["type"] != "BPE" or not x["model"]["end_of_word_suffix"] or x["model"]["byte_fallback"] or x["model"]["ignore_merges"]:
            raise ValueError("not a byte-level BPE with a suffix for the end of a word")
        return self


class PieceMachine:
    """The transducer of pieces: transitions by (state, character), made on first use."""

    def __init__(self, vocabulary: set[str], merges: list[tuple[str, str]], suffix: str):
        self.suffix, self.rank = suffix, {pair: i for i, pair in enumerate(merges)}
        whole = {t for t in vocabulary if self._merged(self._symbols(t)) == [t]}  # others never come out of the merges
        self.inner = {t for t in whole if not t.endswith(suffix)}
        self.last = {t[: -len(suffix)]: t for t in whole if t.endswith(suffix)}
        self.begins = {t[:i] for t in {*self.inner, *self.last} for i in range(1, len(t))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers = {("", (None,), (0,)): 0}
        self.states = [("", (None,), (0,))]
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: list[dict[str, int]] = [{}]

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _merged(self, symbols: list[str]) -> list[str]:
        """By the merges: again and again the leftmost pair of least rank."""
        rank = self.rank
        while len(symbols) > 1:
            r, i = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if r == 1 << 30:
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def _stands(self, before: str | None, token: str) -> bool:
        """Whether the merges leave this pair of tokens as it is."""
        if before is None:
            return True
        key = (before, token)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._merged(self._symbols(before) + self._symbols(token)) == [before, token]
        return known

    def _take(self, state: int, letter: str, tokens) -> tuple[str, int]:
        """The last token after one more character, and what it adds to the count."""
        tail, lasts, counts = self.states[state]
        tail += letter
        for i in range(len(tail)):
            token = tokens(tail[i:])
            if token is not None and self._stands(lasts[i], token):
                return token, counts[i] + 1
        raise ValueError(f"no token ends with {letter!r}")

    def _step(self, state: int, letter: str) -> tuple[int, int]:
        tail, lasts, counts = self.states[state]
        token, adds = self._take(state, letter, lambda t: t if t in self.inner else None)
        tail += letter
        cut = next(i for i in range(len(tail) + 1) if i == len(tail) or tail[i:] in self.begins)
        key = (tail[cut:], (*lasts, token)[cut:], tuple(c - adds for c in (*counts, adds)[cut:]))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.ends.append({})
        self.steps[state][letter] = found = self.numbers[key], adds
        return found

    def count(self, letters: str) -> int:
        """Tokens of a piece, given as the letters of its bytes."""
        if len(self.states) > STATES_KEPT:
            self._reset()
        state = total = 0
        steps = self.steps
        for letter in letters[:-1]:
            state, adds = steps[state].get(letter) or self._step(state, letter)
            total += adds
        letter = letters[-1]
        adds = self.ends[state].get(letter)
        if adds is None:
            adds = self.ends[state][letter] = self._take(state, letter, self.last.get)[1]
        return total + adds


class _Counts(dict):
    """Tokens of each piece; a new piece goes through the machine."""

    def __init__(self, machine: PieceMachine):
        self.machine, self.letters = machine, _byte_letters()

    def __missing__(self, piece: str) -> int:
        letters = "".join(map(self.letters.__getitem__, piece.encode("utf-8", "replace")))
        self[piece] = n = self.machine.count(letters)
        return n


class TokenCounter:
    """Both machines, compiled; of one Python worker."""

    def __init__(self, tokenizer: WordTokenizer):
        x = json.loads(tokenizer.source)
        special = sorted((t["content"] for t in x["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in x["model"]["merges"]]
        self.machine = PieceMachine(set(x["model"]["vocab"]) - set(special), merges, x["model"]["end_of_word_suffix"])
        self.classes, self.later, self.pieces = _classes(), _later(), _Counts(self.machine)

    def _normal(self, text: str) -> tuple[int, str]:
        """Special strings, each a token, and what is left: composed, in lower case letter by letter."""
        n = 0
        if self.special is not None and "<" in text:
            text, n = self.special.subn(" ", text)
        if not text.isascii():
            if self.later[_code_points(text)].any():
                from tokenizers import normalizers

                return n, normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return n, text.lower()

    def counts(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        run, held = [], 0
        for text in texts:
            run.append(self._normal(text or ""))
            held += len(run[-1][1])
            if held >= RUN_CHARS:
                out += self._counted(run)
                run, held = [], 0
        return out + self._counted(run)

    def _counted(self, run: list[tuple[int, str]]) -> list[int]:
        if not run:
            return []
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        text = "\n".join(t for _, t in run)
        starts, ends = lex(_code_points(text), self.classes)
        pieces = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        sums = np.concatenate(([0], np.cumsum(np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces)))))
        edges = np.concatenate(([0], np.cumsum([len(t) + 1 for _, t in run])))
        at = sums[np.searchsorted(starts, edges)]
        return (np.diff(at) + np.array([n for n, _ in run])).tolist()


_COUNTERS: dict[str, TokenCounter] = {}


def _counter(held: Broadcast) -> TokenCounter:
    """Compiled once for each Python worker; a worker keeps the last one only."""
    tokenizer = held.value
    if tokenizer.key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[tokenizer.key] = TokenCounter(tokenizer)
    return _COUNTERS[tokenizer.key]


def n_tokens(text: Column, tokenizer: WordTokenizer, df: DataFrame) -> Column:
    """Tokens of each whole text, without begin or end; a special string inside a text is one token; 0 for null."""
    held = df.sparkSession.sparkContext.broadcast(tokenizer)  # the vocabulary file

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(_counter(held).counts(list(texts)), dtype="int64")

    return F.pandas_udf(count, T.LongType())(text)


def token_counts(df: DataFrame, tokenizer: WordTokenizer, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, n_bytes, n_tokens and over_limit. A null text counts as empty; repeated rows
    stay; other columns are ignored; an empty table gives an empty result."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = df.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), n_tokens(text, tokenizer, df).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
