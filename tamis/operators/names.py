"""Names of persons: runs of capitalised words, scored by how many of them are listed as names, a title, a keyword.

A token is a letter and what follows of letters, apostrophes and hyphens. A run is a maximal sequence of capitalised
tokens with nothing but spaces and tabs between them. A title before the run, or as its first token, counts; in the
latter case it is not part of the name. Of what is left the first few tokens are the span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import Confidence, Detector
from . import lexicons
from .lexicons import listed_of
from .once import once
from .places import near, near_in

_TOKEN = r"\p{L}[\p{L}'-]*+"
_CAPITAL = r"\p{Lu}[\p{L}'-]*+"
#: From the start of a text on, every item is what is no letter and then a run with the token before it, or some tokens
#: that no run follows; so a match begins at a token and never inside one.
_ITEM = rf"[^\p{{L}}]*+(?:(?:(?!\p{{Lu}}){_TOKEN}[ \t]++)?+{_CAPITAL}(?:[ \t]++{_CAPITAL})*+|(?:(?!\p{{Lu}}){_TOKEN}(?![ \t]++\p{{Lu}})[^\p{{L}}]*+){{1,40}}+)"
_PARTS = rf"\A[^\p{{L}}]*+(?:((?!\p{{Lu}}){_TOKEN})[ \t]++)?+({_CAPITAL}(?:[ \t]++{_CAPITAL})*+)\z"
_GAP = r"[ \t]+"
#: Items of a text that are placed at a time.
CHUNK_ITEMS = 32


def span_confidence(score: Column) -> Column:
    return F.least(score * 8 + 40, F.lit(95)).cast("bigint")


def capitalised(text: Column) -> Column:
    """The capitalised tokens of a text in lower case, each once: those that may be evidence."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_CAPITAL), F.lit(0)), F.lower))


def _is_listed(d: Detector, listed: Column | None):
    """Whether a token is evidence: by the list itself, or by the array of the text's listed tokens."""
    words = list(d.dictionary.evidence) if listed is None else []
    return lambda t: F.lower(t).isin(words) if listed is None else F.array_contains(listed, F.lower(t))


def _placed_runs(text: Column) -> Column:
    """The items of a text that end with a run: an array of end (byte) and item. Items are placed within chunks and chunks
    among each other, as adding to one array costs the square of its length."""
    no_runs = F.array().cast("array<struct<end:int,item:string>>")

    def one(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.octet_length(x)
        own = F.array(F.struct(end.alias("end"), x.alias("item")))
        return F.struct(end.alias("at"), F.when(x.rlike(r"\p{Lu}[\p{L}'-]*+\z"), F.concat(acc["runs"], own)).otherwise(acc["runs"]).alias("runs"))

    def chunks(items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(CHUNK_ITEMS))
        return F.transform(starts, lambda i: F.aggregate(F.slice(items, i, F.lit(CHUNK_ITEMS)), F.struct(F.lit(0).alias("at"), no_runs.alias("runs")), one))

    def joined(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(parts, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
        return F.flatten(F.zip_with(parts, starts, lambda x, at: F.transform(x["runs"], lambda r: F.struct((r["end"] + at).alias("end"), r["item"].alias("item")))))

    given = F.transform(F.array(F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0))), chunks)
    return F.element_at(F.transform(given, joined), 1)


def _found_spans(d: Detector, text: Column) -> Column:
    """The spans of a text, with evidence or not: an array of kept (the tokens), titled and at (byte)."""
    titles = sorted(d.dictionary.titles)

    def cut(x: Column) -> Column:
        return F.struct(F.regexp_extract(x["item"], _PARTS, 2).alias("run"), F.regexp_extract(x["item"], _PARTS, 1).alias("before"), x["end"].alias("end"))

    def split(x: Column) -> Column:
        return F.struct(x["run"].alias("run"), x["before"].alias("before"), F.split(x["run"], _GAP).alias("tokens"), (x["end"] - F.octet_length(x["run"])).alias("at"))

    def span(x: Column) -> Column:
        own = F.lower(x["tokens"][0]).isin(titles)
        kept = F.slice(x["tokens"], F.when(own, 2).otherwise(1), F.lit(d.dictionary.max_span_tokens))
        first = F.octet_length(x["run"]) - F.octet_length(F.regexp_replace(x["run"], r"^[^ \t]+[ \t]+", ""))
        at = x["at"] + F.when(own, first).otherwise(0)
        return F.struct(kept.alias("kept"), (own | F.lower(x["before"]).isin(titles)).alias("titled"), at.alias("at"))

    cuts = F.filter(F.transform(_placed_runs(text), cut), lambda x: x["run"] != "")
    return F.filter(F.transform(F.transform(cuts, split), span), lambda x: F.size(x["kept"]) > 0)


def _score(d: Detector, evidence: Column, titled: Column, close: Column) -> Column:
    words = d.dictionary
    score = evidence * words.name_hit + F.when(evidence >= 2, words.adjacency).otherwise(0) + F.when(titled, words.title).otherwise(0)
    return (score + F.when(close, words.keyword).otherwise(0)).cast("bigint")


def _keywords(d: Detector) -> Column:
    return F.array(*[F.lit(k.lower()) for k in d.keywords]).cast("array<string>")


def row_spans(d: Detector, c: Confidence, text: Column, lower: Column, listed: Column | None = None) -> Column:
    """The spans of a text, fired or not, within the row: an array of start (byte), span, evidence, titled, near_keyword and
    score, null for a text that cannot have one that fires. `listed`: those of `capitalised` that are evidence, for lists
    that are not in the plan."""
    is_listed = _is_listed(d, listed)

    def weighed(x: Column) -> Column:
        return F.struct(x["kept"].alias("kept"), x["titled"].alias("titled"), x["at"].alias("at"), F.size(F.filter(x["kept"], is_listed)).alias("evidence"))

    def scored(x: Column) -> Column:
        close = near(lower, x["at"], _keywords(d), c.keyword_window) if d.keywords else F.lit(False)
        score = _score(d, x["evidence"], x["titled"], close)
        return F.struct(x["at"].cast("bigint").alias("start"), F.array_join(x["kept"], " ").alias("span"), x["evidence"].cast("bigint").alias("evidence"), x["titled"].alias("titled"), close.alias("near_keyword"), score.alias("score"))

    spans = F.filter(F.transform(_found_spans(d, text), weighed), lambda x: (x["evidence"] > 0) | x["titled"])
    return F.transform(spans, scored)


def name_finding(d: Detector, c: Confidence, text: Column, lower: Column, listed: Column | None = None) -> Column:
    """The finding of a name detector, within the row: no shuffle, and fit for streams."""
    words = d.dictionary
    fired = F.filter(row_spans(d, c, text, lower, listed), lambda x: x["score"] >= words.fire)
    summed = F.transform(F.array(fired), lambda s: F.when(F.size(s) > 0, F.struct(
        F.size(s).cast("bigint").alias("raw_count"), F.size(s).cast("bigint").alias("validated_count"), F.lit(False).alias("keyword_found"),
        span_confidence(F.array_max(F.transform(s, lambda x: x["score"]))).alias("confidence"), F.lit(True).alias("fired"), F.slice(F.transform(s, lambda x: x["span"]), 1, 3).alias("samples"),
    )))
    some = F.size(listed) > 0 if listed is not None else F.exists(F.regexp_extract_all(text, F.lit(_CAPITAL), F.lit(0)), _is_listed(d, None))
    needs_evidence = words.title + words.keyword < words.fire
    return F.when(some if needs_evidence else text.rlike(r"\p{Lu}"), F.element_at(summed, 1))


def name_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each token: doc_id, row, ord (from 0), token, gap (what follows it), start (byte), capital, and the
    columns in `carry`. `row` tells rows of the same id apart."""
    text = F.col(text_col).cast("string")
    pattern = F.lit(rf"({_TOKEN})([^\p{{L}}]*)")
    lead = F.octet_length(F.regexp_extract(text, r"\A[^\p{L}]*", 0))
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("token"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("gap"))
    texts = df.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), lead.alias("lead"), pairs.alias("pairs"), *carry)
    rows = texts.select("doc_id", "row", "lead", *carry, F.posexplode("pairs").alias("ord", "pair"))
    size = F.octet_length("pair.token") + F.octet_length("pair.gap")
    before = Window.partitionBy("row").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("lead") + F.coalesce(F.sum(size).over(before), F.lit(0))
    return rows.select("doc_id", "row", F.col("ord").cast("bigint").alias("ord"), "pair.token", "pair.gap", start.alias("start"), F.col("pair.token").rlike(r"\A\p{Lu}").alias("capital"), *carry)


def name_runs(tokens: DataFrame) -> DataFrame:
    """The capitalised tokens of `tokens`, with the run they belong to, their place in it, and the token before them if
    only spaces and tabs lie between."""
    order = Window.partitionBy("row").orderBy("ord")
    close = F.lag("gap").over(order).rlike(r"\A[ \t]*\z")
    marked = tokens.withColumns({"before": F.when(close, F.lag("token").over(order)), "joined": F.coalesce(close & F.lag("capital").over(order), F.lit(False))}).where("capital")
    runs = marked.withColumn("run", F.sum((~F.col("joined")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("place", F.row_number().over(Window.partitionBy("row", "run").orderBy("ord")))


def spans_by_table(rows: DataFrame, d: Detector, c: Confidence, evidence: DataFrame) -> DataFrame:
    """The spans of `rows` (doc_id, _text) by a table (word) of evidence: doc_id, start, span, evidence, titled, near_keyword,
    score.

    Spans are found and placed within the row. Their tokens alone, never a text, are joined with the table; those that it
    has, and those of titled spans, meet again by what the span is. Spans that are alike in all columns have equal tokens,
    so their number is that of the tokens over that of the places in the span.
    """
    held = {"_spans": _found_spans(d, F.col("_text"))}
    close = F.lit(False)
    if d.keywords:
        any_keyword = F.exists(_keywords(d), lambda k: F.contains(F.lower("_text"), k))
        held["_bytes"] = F.when(any_keyword, F.encode(F.lower("_text"), "UTF-8"))
        close = F.when(F.col("_bytes").isNull(), False).otherwise(near_in(F.col("_bytes"), F.col("_s.at"), _keywords(d), c.keyword_window))
    found = once(rows, held).select("doc_id", *[k for k in held if k != "_spans"], F.explode("_spans").alias("_s"))
    span = ["doc_id", F.col("_s.at").cast("bigint").alias("start"), F.array_join("_s.kept", " ").alias("span"), "_s.titled", close.alias("near_keyword")]
    tokens = found.select(*span, F.posexplode(F.transform("_s.kept", F.lower)).alias("place", "word"))
    # By word alone, evidence would stay where its counts are, and Spark splits frequent words only of sides dealt for a join.
    part = F.hash("word").alias("part")
    listed = evidence.select("word").distinct().select("word", part, F.lit(1).alias("listed"))
    met = tokens.select("*", part).join(listed, ["word", "part"], "left").where(F.col("titled") | F.col("listed").isNotNull())
    same = met.groupBy("doc_id", "start", "span", "titled", "near_keyword").agg(F.count("*").alias("n"), F.count("listed").alias("listed"), F.size(F.collect_set("place")).alias("places"))
    copies = F.expr("n div places")
    each = same.select("*", F.expr("listed div (n div places)").alias("evidence"), F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return each.select("doc_id", "start", "span", "evidence", "titled", "near_keyword", _score(d, F.col("evidence"), F.col("titled"), F.col("near_keyword")).alias("score"))


def name_spans(df: DataFrame, d: Detector, c: Confidence, id_col: str = "doc_id", text_col: str = "text", evidence: DataFrame | None = None) -> DataFrame:
    """One row for each span, fired or not: doc_id, start, span, evidence, titled, near_keyword, score, confidence, fired.

    A map over rows: the tokens of a run are never rows of their own, and nothing is shuffled. With `evidence`, a table
    (word) in the place of the detector's lists, the tokens of spans are joined with it.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    if evidence is not None:
        rows = spans_by_table(rows, d, c, evidence)
    else:
        listed = None
        if len(d.dictionary.evidence) > lexicons.LITERAL_WORDS:
            rows, listed = once(rows, {"_listed": listed_of(capitalised(F.col("_text")), d.dictionary.evidence)}), F.col("_listed")
        rows = rows.select("doc_id", F.explode(row_spans(d, c, F.col("_text"), F.lower("_text"), listed)).alias("s")).select("doc_id", "s.*")
    return rows.select("*", span_confidence(F.col("score")).alias("confidence"), (F.col("score") >= d.dictionary.fire).alias("fired"))
