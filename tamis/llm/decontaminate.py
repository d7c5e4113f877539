"""Benchmark passages in documents, up to a budget of edits: exact pieces find them, bit-parallel distances verify them.

An item of m characters is cut into m // PIECE pieces; its budget is one edit less (about 8 % of a long item), so some
piece of every occurrence is untouched. All pieces are looked for at once. A hit is verified from the piece up: the pieces
are halved again and again, and of an occurrence within budget some untouched piece has, in every part of p pieces that
holds it on the way, at most p - 1 edits. A part that has more ends the way up, so a chance hit costs a comparison of a few
pieces. An item of one piece has no edits to spend and must stand between word boundaries.
"""

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that a piece has at least.
PIECE = 12
#: An item of fewer characters (normalised) is not looked for; by default every item with a text is.
LEAST_ITEM = 1
#: Characters of items in one automaton; larger benchmarks are searched block by block.
BLOCK_CHARS = 8 << 20

Item = tuple[int, str]
_LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def normalised(text: str | None) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join((text or "").lower().split())


def pieces_of(m: int) -> int:
    """How many pieces an item of `m` characters has; the budget is one less."""
    return max(1, m // PIECE)


def least_distance(pattern: str, masks: dict[str, int], text: str, start: int, stop: int) -> tuple[int, int]:
    """The least edit distance between `pattern` and a part of text[start:stop], and where the first such part ends.

    Myers' bit vectors: one big integer holds the column's differences, whatever the pattern's length.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, max(start, 0)
    for i in range(max(start, 0), min(stop, len(text))):
        equal = masks.get(text[i], 0)
        across = (((equal & up) + up) ^ up) | equal
        rise, fall = down | (full & ~(across | up)), up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best, end = score, i + 1
        level = equal | down
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(level | rise)), rise & level
    return best, end


class PieceIndex:
    """The pieces of a block of items, with the parts that verify a hit."""

    def __init__(self, items: list[Item], least: int = LEAST_ITEM):
        import ahocorasick

        self.items = [(i, text) for i, t in items if len(text := normalised(t)) >= max(1, least)]
        self.parts: dict[tuple[int, int, int], tuple[str, dict[str, int], int]] = {}
        self.alike: dict[str, int] = {}
        self.ways: dict[tuple[int, int], list[tuple[int, int]]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            count = pieces_of(len(text))
            for leaf in range(count):
                places.setdefault(text[self.edge(n, leaf) : self.edge(n, leaf + 1)], []).append((n, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def edge(self, n: int, leaf: int) -> int:
        text = self.items[n][1]
        return leaf * len(text) // pieces_of(len(text))

    def parents(self, count: int, leaf: int) -> list[tuple[int, int]]:
        """The parts that hold a piece when `count` pieces are halved again and again, the smallest first."""
        key = (count, leaf)
        if key not in self.ways:
            low, high, way = 0, count, []
            while high - low > 1:
                way.append((low, high))
                middle = (low + high) // 2
                low, high = (low, middle) if leaf < middle else (middle, high)
            self.ways[key] = way[::-1]
        return self.ways[key]

    def part(self, n: int, low: int, high: int) -> tuple[str, dict[str, int], int]:
        """The text of some pieces, its bit masks, and a number that parts of the same text share."""
        key = (n, low, high)
        if key not in self.parts:
            pattern, masks = self.items[n][1][self.edge(n, low) : self.edge(n, high)], {}
            for i, c in enumerate(pattern):
                masks[c] = masks.get(c, 0) | 1 << i
            self.parts[key] = pattern, masks, self.alike.setdefault(pattern, len(self.alike))
        return self.parts[key]

    def leaks(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, least distance, where the first best match ends) of each item within its budget."""
        found: dict[int, tuple[int, int]] = {}
        if not self.items:
            return []
        seen = set()
        known: dict[tuple[int, int, int], tuple[int, int]] = {}  # many items may share a part: it is verified once a place
        for end, (size, where) in self.automaton.iter(text):
            for n, leaf in where:
                # where the item would start if nothing before the piece were edited
                start = end + 1 - size - self.edge(n, leaf)
                if (n, start) in seen:
                    continue
                count, best = pieces_of(len(self.items[n][1])), (0, end + 1)
                if count == 1 and not _apart(text, start, end + 1):
                    continue
                for low, high in self.parents(count, leaf):
                    pattern, masks, number = self.part(n, low, high)
                    at, room = start + self.edge(n, low), high - low - 1
                    if (best := known.get((number, at, room))) is None:
                        best = known[number, at, room] = least_distance(pattern, masks, text, at - room, at + len(pattern) + room)
                    if best[0] > room:
                        break
                else:
                    seen.add((n, start))
                    item = self.items[n][0]
                    found[item] = min(found.get(item, best), best)
        return sorted((i, d, e) for i, (d, e) in found.items())


def _apart(text: str, start: int, stop: int) -> bool:
    """Whether text[start:stop] neither begins nor ends inside a word."""
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not inside(start) and not inside(stop)


_BUILT: dict[str, PieceIndex] = {}


def _index(key: str, items: Broadcast, least: int) -> PieceIndex:
    """Built once for each Python worker, for every block of a search; those of the search before go."""
    search, _ = key.split("/")
    if key not in _BUILT:
        for old in [k for k in _BUILT if k.split("/")[0] != search]:
            del _BUILT[old]
        _BUILT[key] = PieceIndex(items.value, least)
    return _BUILT[key]


def _blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    block, chars = [], 0
    for item, text in benchmark.toLocalIterator(prefetchPartitions=True):
        block.append((item, text))
        chars += len(text or "")
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block or not chars:
        yield block


def _searcher(held: Broadcast, key: str, least: int):
    def search(texts: pd.Series) -> pd.Series:
        index = _index(key, held, least)
        return pd.Series([index.leaks(normalised(t)) for t in texts])

    return F.pandas_udf(search, _LEAKS)


def leaks_column(text: Column, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST_ITEM) -> Column:
    """An array of (item_id, distance, end) for the items of `benchmark` that `text` holds within their budget.

    `end` counts characters of the normalised text. Items without text match nothing, nor does a null or empty text;
    items without an id, and those of fewer than `least` characters, take no part. A document that quotes half of an item
    does not hold it. An item that is found in several places counts where its distance is least. An item under 2 * PIECE characters has no edits to spend. Of repeated items the
    least distance counts. The items are broadcast in blocks of BLOCK_CHARS characters.
    """
    items = benchmark.select(F.col(item_col).cast("bigint"), F.col(item_text_col).cast("string")).where(f"{item_col} is not null")
    context, key = benchmark.sparkSession.sparkContext, uuid.uuid4().hex
    columns = []
    for i, block in enumerate(_blocks(items)):
        columns.append(_searcher(context.broadcast(block), f"{key}/{i}", least)(text))
    if len(columns) == 1:
        return columns[0]
    # an item that is repeated in several blocks counts once, with its least distance
    best = lambda found, x: F.concat(F.filter(found, lambda y: y["item_id"] != x["item_id"]), F.array(F.array_min(F.concat(F.filter(found, lambda y: y["item_id"] == x["item_id"]), F.array(x)))))
    return F.aggregate(F.concat(*columns), F.array().cast(_LEAKS), best)


def benchmark_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, distance, end.

    Texts are whole; case and white space do not count. Clean documents have no row; repeated documents have their rows
    each. Empty tables give an empty result; other columns of both tables are ignored.
    """
    found = df.select(F.col(id_col).alias("doc_id"), F.explode(leaks_column(F.col(text_col).cast("string"), benchmark)).alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.distance", "leak.end")


def without_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `df` whose text holds no item."""
    return df.where(F.size(leaks_column(F.col(text_col).cast("string"), benchmark)) == 0)
