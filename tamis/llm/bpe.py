"""Byte-level BPE: encoding by recursive queries over token-position rows, decoding by ordered aggregation.

In every task an in-process DuckDB holds the table of merges. The distinct words of a batch become rows (word, position,
token), one for each byte. Each row knows the token after its own; one turn of the recursion joins these pairs
with the merges and contracts each word's leftmost pair of least rank, until no pair is left. Words seen before are
looked up, and so are words that are one token.

The rows of that recursion grow with the square of a word's bytes, so words are first cut where no token can reach
across (two bytes that stand side by side in no token), and what is still longer than PIECE bytes is read in overlapping
windows of that size. Two neighbouring windows are joined at a place where both begin the same token: that token stands
behind its left neighbour in one valid encoding and before its right one in the other, and a sequence of tokens is the
encoding of its bytes if each two neighbours are the encoding of theirs. Where windows do not agree (long periodic runs),
the piece goes through a recursion that is keyed by word and position, which keeps the present state only and contracts
all of a word's pairs of least rank in one turn.
"""

from __future__ import annotations

import base64
import itertools
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of a piece, and from one window of a longer one to the next.
PIECE, STRIDE = 128, 64
#: Of one query: words, the sum of the squares of their bytes (its rows are half of that at most), and bytes if keyed.
WORDS_AT_ONCE = 20_000
SQUARES_AT_ONCE = 6_000_000
KEYED_BYTES = 1 << 16
#: Words kept for later batches, and bytes of text (or four for a token) taken at once.
WORDS_KEPT = 250_000
BYTES_AT_ONCE = 1 << 20

_MERGE = """
    WITH RECURSIVE work(word, pos, token, after, turn) AS (
        SELECT word, pos, token, lead(token) OVER (PARTITION BY word ORDER BY pos), 0 FROM bytes_of_words
        UNION ALL
        (
            WITH best AS (
                SELECT word, min({'rank': merged, 'pos': pos}) AS pair
                FROM work JOIN merges ON token::BIGINT << 32 | after = both_tokens GROUP BY word
            ),
            contracted AS (
                SELECT word, pair.pos AS spot, pair.rank AS rank, after AS beyond
                FROM best JOIN work USING (word) WHERE pos = pair.pos + 1
            )
            SELECT word,
                   CASE WHEN pos > spot THEN pos - 1 ELSE pos END,
                   CASE WHEN pos = spot THEN rank ELSE token END,
                   CASE WHEN pos = spot THEN beyond WHEN pos = spot - 1 THEN rank ELSE after END,
                   turn + 1
            FROM work JOIN contracted USING (word) WHERE pos <> spot + 1
        )
    )
    SELECT word, token
    FROM work JOIN (SELECT word, max(turn) AS turn FROM work GROUP BY word) USING (word, turn)
    ORDER BY word, pos
"""
_MERGE_KEYED = """
    WITH RECURSIVE work(word, pos, token, next, rank) USING KEY (word, pos) AS (
        SELECT word, pos, token, pos + 1, merged
        FROM (SELECT *, lead(token) OVER (PARTITION BY word ORDER BY pos) AS after FROM bytes_of_words)
        LEFT JOIN merges ON token::BIGINT << 32 | after = both_tokens
        UNION
        (
            WITH best AS (
                SELECT word, min(rank) AS rank FROM recurring.work GROUP BY word HAVING min(rank) IS NOT NULL
            ),
            pairs AS (
                SELECT word, pos, next, rank, CASE WHEN pos = lag(next) OVER (PARTITION BY word ORDER BY pos) THEN NULL ELSE pos END AS opens
                FROM recurring.work JOIN best USING (word, rank)
            ),
            runs AS (
                SELECT *, max(opens) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM pairs
            ),
            placed AS (
                SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS place FROM runs
            ),
            chosen AS (
                SELECT p.word, p.pos, p.rank AS token, p.next AS gone, w.next AS beyond
                FROM placed p JOIN recurring.work w ON w.word = p.word AND w.pos = p.next WHERE place % 2 = 1
            ),
            touched AS (
                SELECT c.word, c.pos, c.token, c.beyond AS next, coalesce(d.token, w.token) AS after
                FROM chosen c LEFT JOIN recurring.work w ON w.word = c.word AND w.pos = c.beyond
                LEFT JOIN chosen d ON d.word = c.word AND d.pos = c.beyond
                UNION ALL
                SELECT w.word, w.pos, w.token, w.next, c.token
                FROM recurring.work w JOIN chosen c ON w.word = c.word AND w.next = c.pos
                WHERE NOT EXISTS (SELECT 1 FROM chosen g WHERE g.word = w.word AND g.gone = w.pos)
            )
            SELECT word, pos, token, next, merged FROM touched LEFT JOIN merges ON token::BIGINT << 32 | after = both_tokens
            UNION ALL
            SELECT word, gone, -1, NULL, NULL FROM chosen
        )
    )
    SELECT word, token FROM work WHERE token >= 0 ORDER BY word, pos
"""
_DECODE = """
    SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes, count(*) AS known
    FROM ids JOIN vocabulary USING (token) GROUP BY doc
"""


@dataclass(frozen=True)
class BytePairs:
    """Ranks as the lines of a rank file (base64 of a token, then its rank) and the pattern that splits texts."""

    ranks: bytes
    pattern: str
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)


class _Known(dict):
    """Words by number; a new one gets the next number and waits in `fresh` to be learnt."""

    fresh: list[str]

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Engine:
    """Of one Python worker: the merges in DuckDB, and what words have been encoded to."""

    def __init__(self, pairs: BytePairs):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, pairs.ranks.splitlines())}
        self.split = regex.compile(pairs.pattern)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.length = np.zeros(max(self.ranks.values(), default=0) + 1, np.int64)
        self.inside = np.zeros((256, 256), bool)  # two bytes that stand side by side in some token
        for t, r in self.ranks.items():
            self.length[r] = len(t)
            if len(t) > 1:
                flat = np.frombuffer(t, np.uint8)
                self.inside[flat[:-1], flat[1:]] = True
        splits = ((t[:i], t[i:], r) for t, r in self.ranks.items() for i in range(1, len(t)))
        merges = [(self.ranks[a], self.ranks[b], r) for a, b, r in splits if a in self.ranks and b in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        merges = np.array(merges, np.int64).reshape(-1, 3)
        self._load("merges", {"both_tokens": merges[:, 0] << 32 | merges[:, 1], "merged": merges[:, 2].astype(np.int32)})
        self._load("vocabulary", {"token": pa.array(self.ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks])})
        self._number([])
        self.ids, self.sizes, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _number(self, words: Iterable[str]) -> None:
        self.known = _Known(zip(words, itertools.count()))
        self.known.fresh = []

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        """Of the words known, keep those met more than once since they were learnt or kept."""
        kept = self.uses > 1
        if kept.sum() > WORDS_KEPT // 2:
            kept[:] = False
        self.ids = self.ids[np.repeat(kept, self.sizes)]
        self.sizes, self.uses = self.sizes[kept], np.zeros(kept.sum(), np.int64)
        self._number(itertools.compress(self.known, kept.tolist()))

    def _learn(self, words: list[str]) -> None:
        """Encode words that have just got the next numbers."""
        raw = [w.encode("utf-8", "replace") for w in words]
        whole = np.array([self.ranks.get(b, -1) for b in raw])
        rest = np.flatnonzero(whole < 0)
        piece_word, pieces = self._cut([raw[i] for i in rest])
        sizes, ids = self._encoded(pieces)
        word = np.concatenate((np.flatnonzero(whole >= 0), np.repeat(rest[piece_word], sizes)))
        token = np.concatenate((whole[whole >= 0], ids))
        order = np.argsort(word, kind="stable")
        self.sizes = np.concatenate((self.sizes, np.bincount(word, minlength=len(words))))
        self.ids = np.concatenate((self.ids, token[order].astype(np.int32)))
        self.uses = np.concatenate((self.uses, np.zeros(len(words), np.int64)))

    def _cut(self, raw: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Pieces that no token reaches across the ends of, and the number of the word that each belongs to."""
        joined = b"".join(raw)
        flat, ends = np.frombuffer(joined, np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64)
        apart = np.flatnonzero(~self.inside[flat[:-1], flat[1:]]) + 1 if len(flat) else ends[:0]
        edges = np.unique(np.concatenate(([0], ends, apart)))
        bounds = edges.tolist()
        return np.searchsorted(ends, edges[:-1], "right"), [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each piece has, and all their ids."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        if not (lengths > PIECE).any():
            return self._batched(pieces, _MERGE)
        counts = np.where(lengths > PIECE, -(-np.maximum(lengths - PIECE, 0) // STRIDE) + 1, 1)
        owner = np.repeat(np.arange(len(pieces)), counts)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
        sizes, ids = self._batched([pieces[o][s : s + PIECE] for o, s in zip(owner.tolist(), start.tolist(), strict=True)], _MERGE)
        window = np.repeat(np.arange(len(owner)), sizes)
        ends = np.cumsum(self.length[ids])
        before = np.concatenate(([0], ends))[np.cumsum(sizes) - sizes]
        at = start[window] + ends - self.length[ids] - before[window]  # where in its piece a token begins
        # a window is left, and the next one entered, at the first place where both begin the same token
        order = np.lexsort((window, ids, at, owner[window]))
        a, b = order[:-1], order[1:]
        same = (window[b] == window[a] + 1) & (owner[window[a]] == owner[window[b]]) & (at[a] == at[b]) & (ids[a] == ids[b]) & (at[b] > start[window[a]])
        far = np.iinfo(np.int64).max
        leave = np.full(len(owner), far)
        np.minimum.at(leave, window[a[same]], at[a[same]])
        inner = np.concatenate((owner[1:] == owner[:-1], [False]))  # windows that another one follows
        odd = np.unique(owner[inner & (leave == far)])
        enter = np.where(np.concatenate(([False], inner[:-1])), np.concatenate(([0], leave[:-1])), 0)
        leave[~inner] = far
        keep = (at >= enter[window]) & (at < leave[window]) & ~np.isin(owner[window], odd)
        piece, ids = owner[window[keep]], ids[keep]
        for i in odd.tolist():
            more = self._in_turn(pieces[i])
            piece, ids = np.concatenate((piece, np.full(len(more), i))), np.concatenate((ids, more))
        order = np.argsort(piece, kind="stable")
        return np.bincount(piece, minlength=len(pieces)), ids[order]

    def _in_turn(self, piece: bytes) -> np.ndarray:
        """By the keyed recursion; a piece of more than KEYED_BYTES part by part, each from where a token of the one before
        begins, and joined to it if it begins with that token."""
        done, at = np.zeros(0, np.int64), 0
        _, now = self._batched([piece[:KEYED_BYTES]], _MERGE_KEYED)
        while at + KEYED_BYTES < len(piece):
            begins = at + np.cumsum(self.length[now]) - self.length[now]
            i = int(np.searchsorted(begins, at + KEYED_BYTES - KEYED_BYTES // 8))
            while i > 0:
                _, then = self._batched([piece[begins[i] : begins[i] + KEYED_BYTES]], _MERGE_KEYED)
                if then[0] == now[i]:
                    break
                i -= 1
            else:
                raise ValueError("the ranks are not those of a byte-level BPE")
            done, at, now = np.concatenate((done, now[:i])), int(begins[i]), then
        return np.concatenate((done, now))

    def _batched(self, pieces: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """The recursion over pieces, in batches of bounded size."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        sizes, ids, start = np.zeros(len(pieces), np.int64), [np.zeros(0, np.int64)], 0
        squares = np.cumsum(lengths**2)
        while start < len(pieces):
            room = (squares[start - 1] if start else 0) + SQUARES_AT_ONCE
            stop = min(max(start + 1, int(np.searchsorted(squares, room, "right"))), start + WORDS_AT_ONCE)
            flat, n = np.frombuffer(b"".join(pieces[start:stop]), np.uint8), lengths[start:stop]
            word = np.repeat(np.arange(start, stop, dtype=np.int32), n)
            pos = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            self.db.register("bytes_of_words", pa.table({"word": word, "pos": pos, "token": self.byte[flat]}))
            done = self.db.sql(query).to_arrow_table()
            self.db.unregister("bytes_of_words")
            sizes += np.bincount(done["word"].to_numpy(), minlength=len(pieces))
            ids.append(done["token"].to_numpy().astype(np.int64))
            start = stop
        return sizes, np.concatenate(ids)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of texts: how many tokens each has, and all their ids."""
        edges = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
        start = 0
        while start < len(column):
            stop = max(start + 1, int(np.searchsorted(edges, edges[start] + BYTES_AT_ONCE, "right")) - 1)
            words = [self.split.findall(t or "") for t in column.slice(start, stop - start).to_pylist()]
            if len(self.known) > WORDS_KEPT:
                self._forget()
            at = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(words)), np.int64)
            for i in range(0, len(self.known.fresh), WORDS_AT_ONCE):
                self._learn(self.known.fresh[i : i + WORDS_AT_ONCE])
            self.known.fresh.clear()
            self.uses += np.bincount(at, minlength=len(self.uses))
            sizes, ends = self.sizes[at], np.cumsum(self.sizes)
            token_edges = np.concatenate(([0], np.cumsum(sizes)))
            ids = self.ids[np.repeat(ends[at] - sizes - token_edges[:-1], sizes) + np.arange(token_edges[-1])]
            word_edges = np.concatenate(([0], np.cumsum([len(ws) for ws in words])))
            yield np.diff(token_edges[word_edges]), ids
            start = stop

    def decode(self, column: pa.Array) -> pa.Array:
        """The bytes of each array of ids: its tokens in their order. Null for a null array or one with an unknown id."""
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
        out: list[bytes | None] = [b"" if v else None for v in column.is_valid().to_pylist()]
        token = column.flatten()
        start, edges = 0, np.concatenate(([0], np.cumsum(sizes)))
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(edges, edges[start] + BYTES_AT_ONCE // 4, "right")) - 1)
            n = edges[stop] - edges[start]
            doc = np.repeat(np.arange(start, stop, dtype=np.int32), sizes[start:stop])
            self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(n, dtype=np.int32), "token": token.slice(edges[start], n)}))
            done = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("ids")
            for d, b, known in zip(done["doc"].to_pylist(), done["bytes"].to_pylist(), done["known"].to_pylist(), strict=True):
                out[d] = b if known == sizes[d] else None
            for d in set(range(start, stop)) - set(done["doc"].to_pylist()):
                out[d] = None if sizes[d] else out[d]
            start = stop
        return pa.array(out, pa.binary())


_ENGINES: dict[str, Engine] = {}


def _engine(held: Broadcast) -> Engine:
    """Made once for each Python worker; a worker keeps the last one only."""
    pairs = held.value
    if pairs.key not in _ENGINES:
        _ENGINES.clear()
        _ENGINES[pairs.key] = Engine(pairs)
    return _ENGINES[pairs.key]


def _with(batch: pa.RecordBatch, name: str, column: pa.Array, drop: tuple[str, ...]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != name and n not in drop]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)) for n in kept] + [column], kept + [name])


def _schema(df: DataFrame, name: str, kind: T.DataType, drop: tuple[str, ...]) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name and f.name not in drop] + [T.StructField(name, kind)])


def encoded(df: DataFrame, pairs: BytePairs, text_col: str = "text", out: str = "ids", drop: tuple[str, ...] = (), again: str | None = None) -> DataFrame:
    """`df` with the ids of its whole texts, without special tokens, as an array of int in column `out`.

    A null or empty text has no ids. Every row stays, repeated ones too; a column named `out` is replaced, those in
    `drop` go, all others pass unread. With `again`, the ids are decoded in the same pass, into that column.
    """
    held = df.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, engine = 0, _engine(held)
            for sizes, ids in engine.encode(batch.column(batch.schema.names.index(text_col))):
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                part = _with(batch.slice(at, len(sizes)), out, column, drop)
                yield _with(part, again, engine.decode(column), ()) if again else part
                at += len(sizes)

    schema = _schema(df, out, T.ArrayType(T.IntegerType()), drop)
    if again:
        schema = T.StructType([f for f in schema.fields if f.name != again] + [T.StructField(again, T.BinaryType())])
    return df.mapInArrow(run, schema)


def decoded(df: DataFrame, pairs: BytePairs, ids_col: str = "ids", out: str = "bytes", drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the bytes that its arrays of ids stand for, in column `out`; null for null arrays and unknown ids."""
    held = df.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with(batch, out, _engine(held).decode(batch.column(batch.schema.names.index(ids_col))), drop)

    return df.mapInArrow(run, _schema(df, out, T.BinaryType(), drop))
