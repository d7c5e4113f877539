"""Document quality by co-training: a classifier of the text's content and one of the page's metadata start from the same
labelled rows and, over rounds, hand each other the unlabelled rows that they are surest of. Then both are calibrated on
labelled rows kept apart, and the calibrated views are combined into one score."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import labelled_sample, stable
from .linear import fit_logistic, scores, sigmoid

#: Labelled rows of each class that the views are fitted on (in expectation).
TRAIN_PER_CLASS = 3000
#: Rounds, the unlabelled texts that a view hands over in each for each class, and how sure it must be of them.
ROUNDS = 4
HANDED_OVER = 200
SURE = 0.9
#: One labelled row in so many is kept for calibration; rows scoring less than THRESHOLD are not kept.
CALIBRATION = 4
THRESHOLD = 0.35
#: Hashed features of text and metadata.
SHAPES, TEXT_WIDTH, META_WIDTH = 24, 1024, 256
BYTES_AT_ONCE = 1 << 20

_TOKEN = re.compile(r"\S+")
_CLASSES = (r"[A-ZÀ-ÖØ-Þ]", r"[0-9]", r"\|", r"[#$%&*@^~]", r"[.!?]", r"[,;:]", r"[<>{}\[\]\\/=_+]", r"\s", r"\n", r"[^\x00-\x7f]", r"!")
_COUNTERS = [re.compile(c) for c in _CLASSES]


def shape(text: str) -> np.ndarray:
    """Ratios that tell prose from lists, shouting, symbols and repetition, over the whole text."""
    n = max(1, len(text))
    words = _TOKEN.findall(text)
    m = max(1, len(words))
    out = np.zeros(SHAPES, np.float32)
    out[: len(_COUNTERS)] = [min(1.0, 6 * len(c.findall(text)) / n) for c in _COUNTERS]
    same = sum(map(str.__eq__, words, words[1:]))
    bare = sum(map(str.isalpha, words))
    out[11:20] = [
        same / m,
        len(set(words)) / m,
        len(set(words)) / math.sqrt(m) / 20,
        bare / m,
        min(1.0, sum(map(len, words)) / m / 20),
        math.log1p(n) / 15,
        math.log1p(m) / 15,
        min(1.0, max(map(len, words), default=0) / 100),
        sum(map(str.isupper, words)) / m,
    ]
    lines = text.split("\n")
    out[20:23] = [min(1.0, n / len(lines) / 1000), len(set(lines)) / len(lines), float(not words)]
    return out


def text_features(text: str | None) -> np.ndarray:
    """Shape, and hashed counts of two bytes in a row, damped by a root and of length 1."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(TEXT_WIDTH)
    for i in range(0, len(raw), BYTES_AT_ONCE):
        part = raw[i : i + BYTES_AT_ONCE + 1].astype(np.uint32)
        gram = (part[:-1] * 257 + part[1:]) * np.uint32(2_654_435_761) >> np.uint32(22)
        counts += np.bincount(gram.astype(np.int64), minlength=TEXT_WIDTH)
    counts = np.sqrt(counts)
    return np.concatenate((shape(text), counts / max(np.linalg.norm(counts), 1e-12))).astype(np.float32)


def metadata_features(meta: list[str]) -> np.ndarray:
    """One place for each value of a column, by a hash of "column=value"."""
    import zlib

    out = np.zeros(META_WIDTH, np.float32)
    out[[zlib.crc32(v.encode("utf-8", "replace")) % META_WIDTH for v in meta]] = 1
    return out


def metadata(df: DataFrame, columns: tuple[str, ...], length_col: str | None) -> Column:
    """An array of "column=value", the length as its order of magnitude; an absent column says nothing."""
    given = [c for c in columns if c in df.columns]
    values = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in given]
    if length_col in df.columns:
        values.append(F.concat(F.lit("length="), F.coalesce(F.floor(F.log2(F.greatest(F.col(length_col).cast("double"), F.lit(0.0)) + 1) * 2).cast("string"), F.lit(""))))
    return F.array(*values).cast("array<string>")


#: From both views and the marks of the texts that each has got: (view, label, marks, features of both views), once for each view and label.
Surest = Callable[[list[np.ndarray], list[set[int]]], list[tuple[int, int, list[int], list[np.ndarray]]]]


@dataclass
class QualityModel:
    """Two views with their calibrations (slope, bias), and how the calibrated views combine."""

    views: list[np.ndarray]
    calibrations: list[np.ndarray]
    combination: np.ndarray
    given: list[int]

    @classmethod
    def fit(cls, xs: list[np.ndarray], y: np.ndarray, apart: np.ndarray, surest: Surest, weight: np.ndarray) -> QualityModel:
        """`xs` holds the features of both views; rows marked `apart` only calibrate. `surest` finds, for both views, the
        unlabelled texts that they are surest of and that the other has not got."""
        train = ~apart
        add_x: list[list[np.ndarray]] = [[], []]
        add_y: list[list[np.ndarray]] = [[], []]
        taken: list[set[int]] = [set(), set()]
        views: list[np.ndarray] = []
        given = [0, 0]
        for turn in range(ROUNDS + 1):
            views = []
            for v in (0, 1):
                x = np.concatenate([xs[v][train], *add_x[v]])
                target = np.concatenate([y[train], *add_y[v]])
                w = np.concatenate([weight[train], np.full(len(target) - train.sum(), 0.5 * weight[train].mean())])
                views.append(fit_logistic(x, target, w))
            if turn == ROUNDS:
                break
            for v, label, marks, found in surest(views, taken):
                other = 1 - v
                add_x[other].append(found[other])
                add_y[other].append(np.full(len(marks), float(label)))
                taken[other].update(marks)
                given[other] += len(marks)
        held = apart if apart.any() and len(np.unique(y[apart])) == 2 else np.ones(len(y), bool)
        calibrations, logits = [], []
        for v in (0, 1):
            s = scores(xs[v][held], views[v])[:, None]
            calibrations.append(fit_logistic(s, y[held], weight[held], ridge=1e-4))
            logits.append(scores(s, calibrations[v]))
        combination = fit_logistic(np.clip(np.stack(logits, axis=1), -8, 8), y[held], weight[held], ridge=1e-4)
        return cls(views, calibrations, combination, given)

    def score(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The combined score and both calibrated views."""
        logits = [scores(scores(xs[v], self.views[v])[:, None], self.calibrations[v]) for v in (0, 1)]
        together = scores(np.clip(np.stack(logits, axis=1), -8, 8), self.combination)
        return sigmoid(together), sigmoid(logits[0]), sigmoid(logits[1])


_META_COLUMNS = ("source", "lang")


def _extracted(rows: DataFrame) -> pa.Table:
    """Of a bounded sample (h, text, meta, y): the features of both views, as bytes."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = [text_features(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            b = [metadata_features(m).astype(np.int8).tobytes() for m in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.binary()), pa.array(b, pa.binary()), batch.column(3)], ["h", "a", "b", "y"])

    return rows.mapInArrow(extract, "h bigint, a binary, b binary, y int").toArrow().sort_by("h")


def _views(got: pa.Table) -> list[np.ndarray]:
    a = np.frombuffer(b"".join(got["a"].to_pylist()), np.float16).reshape(-1, SHAPES + TEXT_WIDTH).astype(np.float32)
    b = np.frombuffer(b"".join(got["b"].to_pylist()), np.int8).reshape(-1, META_WIDTH).astype(np.float32)
    return [a, b]


def _pool(rows: DataFrame) -> DataFrame:
    """Features of all rows, kept for the rounds: id, mark of the text (h), those of the text (a), metadata. They stay where
    they are made: neither texts nor features are shuffled."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, metas, marks = (batch.column(i) for i in range(4))
            a = [text_features(t).astype(np.float16).tobytes() for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, marks, pa.array(a, pa.binary()), metas], ["id", "h", "a", "meta"])

    kinds = T.StructType([rows.schema["id"], T.StructField("h", T.LongType()), T.StructField("a", T.BinaryType()), T.StructField("meta", T.ArrayType(T.StringType()))])
    return stable(rows.select("id", "text", "meta", "h").mapInArrow(extract, kinds))


def _surest(pool: DataFrame, known: DataFrame) -> Surest:
    """Over all rows of `pool` whose id is not in `known`. In a round every row that a view is sure of becomes a narrow row;
    those with a label go, equal texts become one, and the groups (the first metadata column) get equal parts of what is
    handed over. Only what is handed over is looked up again for its features."""
    group = F.coalesce(F.get("meta", F.lit(0)), F.lit(""))
    groups = pool.agg(F.approx_count_distinct(group, 0.01)).first()[0]
    most = max(1, -(-HANDED_OVER // max(1, groups)))
    kinds = T.StructType([pool.schema["id"], *(T.StructField(n, k) for n, k in (("v", T.IntegerType()), ("y", T.IntegerType()), ("h", T.LongType()), ("sure", T.DoubleType()), ("meta", T.ArrayType(T.StringType()))))])

    def surest(views: list[np.ndarray], taken: list[set[int]]) -> list[tuple[int, int, list[int], list[np.ndarray]]]:
        held = pool.sparkSession.sparkContext.broadcast((views, [np.fromiter(sorted(t), np.int64, len(t)) for t in taken]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            views, taken = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                marks, metas = batch.column(1).to_numpy(), batch.column(3).to_pylist()
                xs = [np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float16).reshape(len(marks), -1).astype(np.float32), np.stack([metadata_features(m) for m in metas])]
                for v in (0, 1):
                    p = sigmoid(scores(xs[v], views[v]))
                    sure = np.maximum(p, 1 - p)
                    at = pa.array(np.flatnonzero((sure >= SURE) & ~np.isin(marks, taken[1 - v])))
                    label = pa.array((p >= 0.5).astype(np.int32)).take(at)
                    view = pa.array(np.full(len(at), v, np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), view, label, batch.column(1).take(at), pa.array(sure.astype(np.float64)).take(at), batch.column(3).take(at)], ["id", "v", "y", "h", "sure", "meta"])

        found = pool.mapInArrow(search, kinds).join(known.select("id").distinct(), "id", "left_anti")
        once = found.groupBy("v", "y", "h").agg(F.min(F.struct((-F.col("sure")).alias("less"), "meta")).alias("best")).select("v", "y", "h", "best.less", "best.meta")
        ranked = Window.partitionBy("v", "y", group).orderBy("less", "h")
        firsts = stable(once.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= most))
        # the groups' firsts come before their seconds, so many groups do not make more rows
        pairs, out = [(v, y) for v in (0, 1) for y in (1, 0)], []
        parts = [firsts.where((F.col("v") == v) & (F.col("y") == y)).orderBy("n", "less", "h").limit(HANDED_OVER) for v, y in pairs]
        chosen: dict[tuple[int, int], dict[int, list[str]]] = {}
        for (v, y), part in zip(pairs, parts, strict=True):
            already = chosen.get((v, 1), {}) if y == 0 else {}
            chosen[v, y] = {r["h"]: r["meta"] for r in part.collect() if r["h"] not in already}
        marks = sorted({h for rows in chosen.values() for h in rows})
        texts = pool.where(F.col("h").isin(marks)).groupBy("h").agg(F.min("a").alias("a")).collect() if marks else []
        texts = {r["h"]: np.frombuffer(bytes(r["a"]), np.float16).astype(np.float32) for r in texts}
        for (v, y), rows in chosen.items():
            if rows:
                hs = sorted(rows)
                out.append((v, y, hs, [np.stack([texts[h] for h in hs]), np.stack([metadata_features(rows[h]) for h in hs])]))
        return out

    return surest


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = _META_COLUMNS, length_col: str = "n_chars") -> QualityModel | None:
    """Fitted on labelled rows, drawn by a hash of the id at rates from all rows, and on all unlabelled rows: in each round
    both views score every one of them.

    Of equal texts one counts. Null labels and ids are passed over; without labels of both classes there is no model.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), metadata(df, meta_cols, length_col).alias("meta"), F.xxhash64(text).alias("h")).where("id is not null")
    sample = F.broadcast(labelled_sample(known, "y", TRAIN_PER_CLASS, "id"))  # about 2 * TRAIN_PER_CLASS pairs of numbers
    drawn = rows.join(sample, "id").groupBy("h").agg(F.min("text").alias("text"), F.min("meta").alias("meta"), F.min("y").alias("y"))
    got = _extracted(drawn)
    y = np.array(got["y"].to_pylist(), np.float64)
    if len(np.unique(y)) < 2:
        return None
    pool = _pool(rows)
    share = np.array([totals[k] / max(1, (y == k).sum()) for k in (0, 1)])  # as many as there are, though drawn alike
    apart = np.array(got["h"].to_pylist()) % CALIBRATION == 0
    return QualityModel.fit(_views(got), y, apart, _surest(pool, known), share[y.astype(int)])


def quality(df: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = _META_COLUMNS, length_col: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of `df`: doc_id, quality (0 to 1), content_score, metadata_score and keep.

    Texts are whole; a null text counts as empty and a null or absent metadata column as a value of its own. Without a
    model every row scores 0.5 and is kept. Repeated rows stay; other columns are ignored.
    """
    held = df.sparkSession.sparkContext.broadcast(model)  # a few vectors of numbers

    def predict(texts: pd.Series, metas: pd.Series) -> pd.DataFrame:
        out = np.full((3, len(texts)), 0.5)
        if held.value is not None and len(texts):
            for i in range(0, len(texts), 512):
                part = slice(i, i + 512)
                xs = [np.stack([text_features(t) for t in texts[part]]), np.stack([metadata_features(list(m)) for m in metas[part]])]
                out[:, part] = held.value.score(xs)
        return pd.DataFrame({"q": out[0], "c": out[1], "m": out[2]})

    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in "qcm"])
    asked = df.select(F.col(id_col).alias("doc_id"), F.pandas_udf(predict, kind)(F.col(text_col).cast("string"), metadata(df, meta_cols, length_col)).alias("s"))
    return asked.select("doc_id", F.col("s.q").alias("quality"), F.col("s.c").alias("content_score"), F.col("s.m").alias("metadata_score"), (F.col("s.q") >= threshold).alias("keep"))
