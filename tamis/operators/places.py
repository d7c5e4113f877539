"""Where matches are, in bytes, and what stands near them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Set around what a search finds. It is no character; where a text has it, `readable` puts U+FFFD, of as many bytes.
MARK = "\ufffe"
#: A text with more stretches than this is searched whole: placing them costs the square of their number.
MOST_STRETCHES = 2048


def readable(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "\ufffd")).otherwise(text)


def _marked(text: Column, java: str) -> Column:
    """What stands before the first match, the first match, what stands behind it, the second match, and so on."""
    return F.split(F.regexp_replace(text, java, f"{MARK}$0{MARK}"), MARK, -1)


def found(text: Column, java: str, limit: int | None) -> Column:
    """The first `limit` matches (None: all), leftmost and not overlapping, as (start, value), from a single search. The text
    is `readable`."""
    parts = _marked(text, java)
    placed = F.aggregate(
        parts if limit is None else F.slice(parts, 1, 2 * limit),
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<start:int,value:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.octet_length(x)).alias("at"),
            (~acc["hit"]).alias("hit"),
            F.when(acc["hit"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), x.alias("value"))))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return placed["out"]


def _starts(parts: Column) -> Column:
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.octet_length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )["out"]


def near_digits(text: Column, context: int) -> Column:
    """The parts of a text with a digit within `context` characters, as (at, part): where a part starts in bytes. A match
    that has a digit and fewer than `context` characters is found in them, and so is the character before and behind it;
    no match lies in two parts, as more than twice the context is left out between them at least."""
    gap = f"(?<![^0-9])[^0-9]{{{2 * context + 1},}}+"  # tried where such a run begins, so each character is read once
    parts = _marked(text, gap)
    def part(x: Column) -> Column:
        before, behind = F.right(x["before"], F.lit(context)), F.left(x["behind"], F.lit(context))
        return F.struct((x["start"] - F.octet_length(before)).alias("at"), F.concat(before, x["own"], behind).alias("part"))

    def stretches(given: Column) -> Column:
        p, s = given["parts"], given["starts"]
        at = lambda i: F.coalesce(F.get(p, i), F.lit(""))
        each = F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(2)), lambda i: F.struct(at(i - 1).alias("before"), F.get(p, i).alias("own"), at(i + 1).alias("behind"), F.get(s, i).alias("start")))
        return F.transform(F.filter(each, lambda x: x["own"] != ""), part)

    whole = F.array(F.struct(F.lit(0).alias("at"), text.alias("part")))
    few = F.transform(F.array(parts), lambda p: F.when(F.size(p) <= 2 * MOST_STRETCHES, p))
    given = F.transform(few, lambda p: F.when(p.isNotNull(), F.struct(p.alias("parts"), _starts(p).alias("starts"))))
    return F.element_at(F.transform(given, lambda g: F.when(g.isNull(), whole).otherwise(stretches(g))), 1)


def near_in(data: Column, start: Column, keywords: Column, window: int) -> Column:
    """Whether one of `keywords`, an array in lower case, lies whole within `window` bytes of `start`, in the bytes of a
    lower-case text."""
    low = F.greatest(start - window, F.lit(0))
    part = F.substring(data, low + 1, start + window - low)
    return F.exists(keywords, lambda k: F.contains(part, F.encode(k, "UTF-8")))


def near(lower: Column, start: Column, keywords: Column, window: int) -> Column:
    """The same, of the lower-case text itself."""
    return near_in(F.encode(lower, "UTF-8"), start, keywords, window)
