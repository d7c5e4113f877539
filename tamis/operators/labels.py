"""Sensitivity labels: in texts by distinctive strings, in documents by their metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import RuleSet

LABEL = "struct<marker_id:string,label:string,source:string,property:string>"
XMP_LIMIT = 1 << 20


def body_labels(text: Column, rules: RuleSet) -> Column:
    """An array of the distinctive strings that the text contains, as they are written, each once."""
    pairs = list(dict.fromkeys((m.id, s) for m in rules.markers for s in m.distinctive))
    each = [F.when(F.contains(text, F.lit(s)), F.struct(F.lit(i).alias("marker_id"), F.lit(s).alias("label"), F.lit("body").alias("source"), F.lit("").alias("property"))).cast(LABEL) for i, s in pairs]
    return F.array_compact(F.array(*each)) if each else F.array().cast(f"array<{LABEL}>")


def normalised(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def xmp_packet(content: Column) -> Column:
    """The metadata packet of a PDF as text: from its opening to its closing processing instruction, or the element
    itself; without an end, XMP_LIMIT bytes of it. Null without an opening."""
    raw = F.decode(content, "ISO-8859-1")  # a character for each byte
    start = F.coalesce(F.nullif(F.instr(raw, F.lit("<?xpacket begin")), F.lit(0)), F.nullif(F.instr(raw, F.lit("<x:xmpmeta")), F.lit(0)))
    rest = F.substr(raw, start)
    closing = F.instr(rest, F.lit("<?xpacket end"))
    behind = F.instr(F.substr(rest, F.greatest(closing, F.lit(1))), F.lit(">"))
    element = F.instr(rest, F.lit("</x:xmpmeta>"))
    size = F.when((closing > 0) & (behind > 0), closing + behind - 1).when(element > 0, element + 11).otherwise(XMP_LIMIT)
    return F.decode(F.encode(F.substr(rest, F.lit(1), size), "ISO-8859-1"), "UTF-8")


def xmp_labels(packet: Column, rules: RuleSet) -> Column:
    """Labels of a packet: properties by letters and digits alone, strings in any case."""
    norm, lower, each = normalised(packet), F.lower(packet), []
    for m in rules.markers:
        for p in dict.fromkeys(m.metadata_properties):
            key = "".join(c for c in p.lower() if c.isascii() and c.isalnum())
            each.append(F.when(F.contains(norm, F.lit(key)), F.struct(F.lit(m.id).alias("marker_id"), F.lit(p).alias("label"), F.lit("metadata").alias("source"), F.lit(p).alias("property"))).cast(LABEL))
        for s in dict.fromkeys(m.strings):
            each.append(F.when(F.contains(lower, F.lit(s.lower())), F.struct(F.lit(m.id).alias("marker_id"), F.lit(s).alias("label"), F.lit("metadata").alias("source"), F.lit("").alias("property"))).cast(LABEL))
    return F.array_compact(F.array(*each)) if each else F.array().cast(f"array<{LABEL}>")
