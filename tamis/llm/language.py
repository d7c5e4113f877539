"""Language identification in two levels: the family first, then the languages within it, by linear support vector
machines over the text's byte n-grams. One machine for each family against the rest, one for each pair of languages of a
family."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import stable, uniform
from .linear import fit_svm, scores, sigmoid

#: Rows that the machines are fitted on at most (in expectation), spread evenly over the languages.
TRAIN_ROWS = 4000
#: Hashed features, and bytes of text taken at once.
WIDTH = 4096
BYTES_AT_ONCE = 1 << 20
UNDETERMINED = "und"
#: How steeply a margin turns into a probability.
STEEPNESS = 3.0
#: Familiarity: folds of the labelled rows, a floor under the shares of grams, bytes below which a text tells little, the
#: share of the labelled rows that the limit must let pass, the room above that, and the least limit, in bits a gram.
FOLDS = 4
FLOOR = 0.01
FEW_BYTES = 50
LET_PASS, ROOM, LEAST_LIMIT = 0.999, 1.25, 1.0
#: The shares of a text's grams are whole numbers that sum to about WHOLE, so their sums are the same in any order, and fit
#: a long for 2^33 rows. Costs are counted in whole parts of a bit, so there are so many different ones at most at any size.
WHOLE = 1 << 30
PARTS_OF_A_BIT = 1 << 12
#: Sums of shares that a task holds at most before it hands them on, of 32 KB each.
SUMS_HELD = 1024
#: Families by ISO 639-1 code, after common linguistic classification; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "malayo-polynesian": "id jv ms su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def features(text: str) -> np.ndarray:
    """Of the whole text in lower case: hashed counts of 1 to 3 bytes in a row, damped by a root, of length 1."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(WIDTH)
    for i in range(0, len(raw), BYTES_AT_ONCE):
        part = raw[i : i + BYTES_AT_ONCE + 2].astype(np.uint32)
        here = min(BYTES_AT_ONCE, len(raw) - i)
        counts[:256] += np.bincount(part[:here], minlength=256)
        for gram in (part[:-1] * 257 + part[1:], part[:-2] * 65_599 + part[1:-1] * 257 + part[2:]):
            counts += np.bincount((gram[:here] * np.uint32(2_654_435_761) >> np.uint32(20)).astype(np.int64), minlength=WIDTH)
    counts = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-12)).astype(np.float32)


@dataclass
class LanguageModel:
    langs: list[str]
    families: list[str]
    by_family: dict[str, np.ndarray]
    by_pair: dict[tuple[str, str], np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> LanguageModel:
        known, langs = sorted(set(langs)), np.array(langs, dtype=object)
        families = sorted({family_of(lang) for lang in known})
        kin = np.array([family_of(lang) for lang in langs], dtype=object)
        by_family = {f: fit_svm(x, np.where(kin == f, 1.0, -1.0)) for f in families} if len(families) > 1 else {}
        by_pair = {}
        for a, b in combinations(known, 2):
            if family_of(a) == family_of(b):
                rows = (langs == a) | (langs == b)
                by_pair[a, b] = fit_svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0))
        return cls(known, families, by_family, by_pair)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language, and the product of the chances of its family and of it within the family."""
        sure = 1.0
        family = self.families[0]
        if self.by_family:
            chance = sigmoid(STEEPNESS * np.array([scores(x, self.by_family[f]) for f in self.families]))
            best = int(np.argmax(chance))
            family, sure = self.families[best], float(chance[best] / chance.sum())
        langs = [lang for lang in self.langs if family_of(lang) == family]
        if len(langs) == 1:
            return langs[0], sure
        won = dict.fromkeys(langs, 0.0)
        for (a, b), w in self.by_pair.items():
            if a in won:
                p = float(sigmoid(STEEPNESS * scores(x, w)))
                won[a] += p
                won[b] += 1 - p
        best = max(langs, key=won.__getitem__)
        return best, sure * won[best] / (len(langs) - 1)


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: the CRC-32 of the id in decimal leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _labelled(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, text and lang of the rows that are not held out and have a text and a language."""
    rows = df.where(~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))


def fit_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Fitted on a sample, drawn by a hash of the id, of the rows that are not held out and have a text and a language.

    The counts behind the sampling rates cover all such rows. None if there are no such rows.
    """
    rows = _labelled(df, id_col, text_col, lang_col)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == F.lit(lang), F.lit(train_rows / len(counts) / n)).otherwise(rate)
    sample = rows.where(uniform("id", seed=3) < rate)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["id", "x", "lang"])

    got = sample.mapInArrow(extract, T.StructType([sample.schema["id"], T.StructField("x", T.BinaryType()), T.StructField("lang", T.StringType())])).toArrow()
    rows = sorted(zip(got["lang"].to_pylist(), got["x"].to_pylist(), strict=True))
    if not rows:
        return None
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    return LanguageModel.fit(x, [r[0] for r in rows])


def prose_features(text: str) -> np.ndarray:
    """Features of the words alone, those without digits if there are any, and last the root of their bytes, by 100."""
    import regex

    words = regex.findall(r"(?<![\p{L}\p{M}\p{N}_])[\p{L}\p{M}]+(?![\p{L}\p{M}\p{N}_])", text) or regex.findall(r"[\p{L}\p{M}]+", text)
    prose = " ".join(words)
    return np.append(features(prose), np.float32(len(prose.encode("utf-8", "replace")) ** 0.5 / 100))


@dataclass
class Familiarity:
    """How many bits a gram of a text's words costs under the shares of grams of one language, against what texts of that
    language cost that were not learnt from. Only the language itself counts, so it does not matter how many there are."""

    bits: dict[str, np.ndarray]
    usual: dict[str, float]
    limit: float

    @staticmethod
    def bits_of(sums: np.ndarray) -> np.ndarray:
        """Bits of each gram, from sums of shares."""
        return -np.log2((1 - FLOOR) * sums / max(sums.sum(), 1e-12) + FLOOR / len(sums))

    @staticmethod
    def slack(root: float) -> float:
        """Short texts stray further, as the root of their length."""
        return 1 + FEW_BYTES**0.5 / (100 * root)

    def strangeness(self, x: np.ndarray, lang: str) -> float:
        """Above 1 for what lies beyond the limit of `lang`."""
        if x[-1] <= 0:
            return 0.0
        return float((x[:-1].astype(np.float64) ** 2 @ self.bits[lang] - self.usual[lang]) / self.slack(x[-1]) / self.limit)


def _fold(x: np.ndarray) -> int:
    """Texts with the same words are in one fold."""
    return zlib.crc32(x.tobytes()) % FOLDS


def _sums(rows: DataFrame) -> dict[str, np.ndarray]:
    """For each language, fold and gram: the sum of the gram's shares over all of `rows`. A few KB for each language."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def taken() -> pa.RecordBatch:
            keys, sums = list(held), pa.array(list(held.values()), pa.list_(pa.int64()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), sums], ["lang", "fold", "sums"])

        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = prose_features(text)
                key = lang, _fold(x)
                if key not in held and len(held) == SUMS_HELD:
                    yield taken()
                held.setdefault(key, np.zeros(WIDTH, np.int64))
                held[key] += np.rint(x[:-1].astype(np.float64) ** 2 * WHOLE).astype(np.int64)
        if held:
            yield taken()

    of_tasks = rows.select("text", "lang").mapInArrow(add, "lang string, fold int, sums array<bigint>")
    of_grams = of_tasks.select("lang", "fold", F.posexplode("sums").alias("gram", "share")).groupBy("lang", "fold", "gram").agg(F.sum("share").alias("share"))
    out: dict[str, np.ndarray] = {}
    for (lang, fold), sums in of_grams.toArrow().to_pandas().groupby(["lang", "fold"]):
        out.setdefault(lang, np.zeros((FOLDS, WIDTH), np.int64))[fold, sums["gram"]] = sums["share"]
    return out


def _costs(rows: DataFrame, bits: dict[str, np.ndarray]) -> DataFrame:
    """lang, cost and slack of each of `rows` with words, under the bits of its language and fold."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # FOLDS vectors of WIDTH numbers for each language

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = prose_features(text)
                if x[-1] > 0:
                    cost = float(x[:-1].astype(np.float64) ** 2 @ shared.value[lang][_fold(x)])
                    out.append((lang, math.floor(cost * PARTS_OF_A_BIT), float(Familiarity.slack(x[-1]))))
            langs, costs, slack = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(costs, pa.int64()), pa.array(slack, pa.float64())], ["lang", "cost", "slack"])

    return rows.select("text", "lang").mapInArrow(measure, "lang string, cost bigint, slack double")


def _quantile(rows: DataFrame, share: float, *by: str) -> DataFrame:
    """Of each group, the least `cost` that `share` of its rows do not exceed. Costs are counted first, so a window has as
    many rows as there are different costs."""
    counts = rows.groupBy(*by, "cost").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*(by or (F.lit(1),)))
    reached = counts.select(*by, "cost", F.sum("n").over(group.orderBy("cost")).alias("at"), F.sum("n").over(group).alias("all"))
    return reached.where(F.col("at") >= share * F.col("all")).groupBy(*by).agg(F.min("cost").alias("cost"))


def fit_familiarity(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Familiarity | None:
    """Fitted on all rows that are not held out and have a text and a language. None if there are no such rows.

    One pass sums the shares of grams by language and fold; another takes what each row costs under its language's other
    folds (under its own, if there are no others). What is usual is the median of a language's costs, and the limit comes
    from a quantile of all out-of-fold costs; both are of counts of all rows, in parts of a bit.
    """
    rows = _labelled(df, id_col, text_col, lang_col)
    sums = _sums(rows)
    if not sums:
        return None
    bits = {lang: Familiarity.bits_of(s.sum(axis=0)) for lang, s in sums.items()}
    apart = [lang for lang, s in sums.items() if s.any(axis=1).sum() > 1]
    judged = bits | {lang: [Familiarity.bits_of(sums[lang].sum(axis=0) - s) for s in sums[lang]] for lang in apart}
    costs = stable(_costs(rows, {lang: np.broadcast_to(b, (FOLDS, WIDTH)) for lang, b in judged.items()}))  # a few bytes a row
    usual = {r["lang"]: r["cost"] / PARTS_OF_A_BIT for r in _quantile(costs, 0.5, "lang").collect()}
    strayed = F.floor((F.col("cost") - PARTS_OF_A_BIT * F.col("usual")) / F.col("slack"))
    known = rows.sparkSession.createDataFrame([(lang, usual[lang]) for lang in apart], "lang string, usual double")
    (limit,) = [r["cost"] for r in _quantile(costs.join(F.broadcast(known), "lang").select(strayed.alias("cost")), LET_PASS).collect()] or [None]
    return Familiarity(bits, dict.fromkeys(bits, 0.0) | usual, math.inf if limit is None else max(LEAST_LIMIT, ROOM * limit / PARTS_OF_A_BIT))


def strangeness(text: Column, lang: Column, familiar: Familiarity | None, df: DataFrame) -> Column:
    """How far a text is from those of `lang`, a language that was learnt; above 1 for what is not taken for it. Null without either."""
    held = df.sparkSession.sparkContext.broadcast(familiar)  # one vector of WIDTH numbers for each language

    def measure(texts: pd.Series, langs: pd.Series) -> pd.Series:
        known = held.value.bits if held.value else {}
        return pd.Series([held.value.strangeness(prose_features(t), g) if t is not None and g in known else None for t, g in zip(texts, langs, strict=True)], dtype="float64")

    return F.pandas_udf(measure, T.DoubleType())(text, lang)


_ANSWER = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predicted_language(text: Column, model: LanguageModel | None, df: DataFrame) -> Column:
    """A struct of lang_pred and score. `und` with score 0 for a text that is null or has no letter, or without model."""
    held = df.sparkSession.sparkContext.broadcast(model)  # a few vectors of WIDTH numbers

    def answer(text: str | None, letter) -> tuple[str, float]:
        if held.value is None or text is None or not letter(text):
            return UNDETERMINED, 0.0
        return held.value.predict(features(text))

    def predict(texts: pd.Series) -> pd.DataFrame:
        import regex

        letter = regex.compile(r"\p{L}").search
        return pd.DataFrame([answer(t, letter) for t in texts], columns=["lang_pred", "score"])

    return F.pandas_udf(predict, _ANSWER)(text)


_JUDGED = T.StructType([*_ANSWER.fields, T.StructField("strangeness", T.DoubleType())])


def judged_language(text: Column, model: LanguageModel | None, familiar: Familiarity | None, df: DataFrame) -> Column:
    """A struct of lang_pred, score and strangeness, as `predicted_language` and `strangeness` give them, in one pass."""
    held = df.sparkSession.sparkContext.broadcast((model, familiar))  # a few vectors of WIDTH numbers

    def judge(texts: pd.Series) -> pd.DataFrame:
        import regex

        letter, (model, familiar) = regex.compile(r"\p{L}").search, held.value
        out = []
        for t in texts:
            lang, score = model.predict(features(t)) if model is not None and t is not None and letter(t) else (UNDETERMINED, 0.0)
            known = familiar is not None and lang in familiar.bits
            out.append((lang, score, familiar.strangeness(prose_features(t), lang) if known else None))
        return pd.DataFrame(out, columns=_JUDGED.names).astype({"strangeness": "float64"})

    return F.pandas_udf(judge, _JUDGED)(text)


def identified(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, held_out, lang_pred, score. Only the whole text decides. A null id is not
    held out; repeated rows stay; other columns are ignored; an empty table gives an empty result."""
    asked = df.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predicted_language(F.col(text_col).cast("string"), model, df).alias("answer"))
    return asked.select("doc_id", "held_out", "answer.lang_pred", "answer.score")
