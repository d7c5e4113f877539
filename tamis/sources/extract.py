"""Texts and metadata labels of files: plain text, Office documents, PDFs."""

from __future__ import annotations

import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.labels import LABEL, xmp_labels, xmp_packet
from ..operators.once import once
from ..plans.rules import RuleSet
from .formats import DOCX, ENCRYPTED, OFFICE, PDF, PLAINTEXT, PPTX, UNSUPPORTED, XLSX, file_type
from .pdf import pdf_text

#: Set between the two ends of a long text; it holds no keyword, digit or capital.
GAP = "\n\n[... the middle of this text was not looked at ...]\n\n"
PART_BYTES, METADATA_BYTES, PDF_BYTES = 5 << 20, 1 << 20, 32 << 20
#: What a damaged archive or part raises.
BROKEN = (zipfile.BadZipFile, OSError, zlib.error, NotImplementedError, RuntimeError, EOFError, ValueError, IndexError, struct.error)
#: Bytes of a part that are inflated at a time.
READ_BYTES = 1 << 16
# Fixed names of the parts that hold text; a star stands for any ending.
PARTS = {
    DOCX: ("word/document.xml", "word/header*", "word/footer*", "docProps/core.xml", "docProps/custom.xml"),
    XLSX: ("xl/sharedStrings.xml", "docProps/core.xml", "docProps/custom.xml"),
    PPTX: ("ppt/slides/slide*", "docProps/core.xml", "docProps/custom.xml"),
}
METADATA_PARTS = ("docProps/custom.xml", "docProps/core.xml")


@dataclass(frozen=True)
class ExtractOptions:
    """Bytes: of text that are kept, above which a file is looked at in part, and of each end that is then seen."""

    max_bytes: int = 5 << 20
    max_file_bytes: int = 16 << 20
    window: int = 64 << 10
    strict: bool = False


def strip_markup(xml: Column) -> Column:
    """Tags become a space, then the five entities are decoded, each once."""
    text = F.regexp_replace(F.regexp_replace(xml, "<[^<>]*", " "), ">", "")
    return decode_entities(text)


def decode_entities(text: Column) -> Column:
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return text


def head_tail(content: Column, options: ExtractOptions) -> Column:
    """The content, or its two ends around GAP if it is larger than the gate."""
    ends = F.concat(F.substring(content, 1, options.window), F.lit(GAP.encode()), F.substring(content, -options.window, options.window))
    return F.when(F.octet_length(content) > options.max_file_bytes, ends).otherwise(content)


def _wanted(name: str, parts: tuple[str, ...]) -> bool:
    return any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in parts)


def _micros(began: int) -> int:
    return (time.perf_counter_ns() - began) // 1000


def read_parts(content: bytes, kind: str, most: int = PART_BYTES) -> Iterator[tuple[str, str, bool]]:
    """The parts of an Office document with text, by name: name, what stands in the first `most` bytes, and whether that is
    not all. A part that can't be read to its end is given as far as it can, and counts as cut."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in sorted(n for n in archive.namelist() if _wanted(n, PARTS[kind])):
            pieces, left, cut = [], most + 1, False
            try:
                with archive.open(name) as f:
                    while left and (piece := f.read(min(left, READ_BYTES))):
                        pieces.append(piece)
                        left -= len(piece)
            except BROKEN:
                cut = True
            whole = b"".join(pieces)
            yield name, whole[:most].decode("utf-8", "replace"), cut or len(whole) > most


class OfficeParts:
    """The table function office_parts(content, file_type): ord, part, xml, cut of each part with text."""

    def eval(self, content: bytes, kind: str):
        if content is not None and kind in OFFICE:
            try:
                for i, (name, xml, cut) in enumerate(read_parts(bytes(content), kind)):
                    yield i, name, xml, cut
            except BROKEN:
                return


def office_parts(spark: SparkSession, name: str = "office_parts") -> None:
    """Register the table function, for lateral joins in SQL: one row for each part, parts of several files never together
    in one value."""
    spark.udtf.register(name, F.udtf(OfficeParts, returnType="ord int, part string, xml string, cut boolean"))


_PARTS_READ = T.StructType([T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("cut", T.BooleanType()), T.StructField("micros", T.LongType())])


@F.pandas_udf(_PARTS_READ)
def _office_parts(contents: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    def one(c, k):
        began = time.perf_counter_ns()
        try:
            read = list(read_parts(bytes(c), k)) if c is not None else []
        except BROKEN:
            return [], True, _micros(began)
        return [xml for _, xml, _ in read], any(cut for _, _, cut in read), _micros(began)

    return pd.DataFrame([one(c, k) for c, k in zip(contents, kinds, strict=True)], columns=["parts", "cut", "micros"])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("cut", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("micros", T.LongType())]))
def _pdf_text(contents: pd.Series) -> pd.DataFrame:
    def one(c):
        began = time.perf_counter_ns()
        try:
            return (*pdf_text(bytes(c), PDF_BYTES), None, _micros(began)) if c is not None else (None, False, None, 0)
        except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, zlib.error) as e:  # a bad file must not end the job
            return None, False, f"pdf: {e}", _micros(began)

    return pd.DataFrame([one(c) for c in contents], columns=["text", "cut", "error", "micros"])


def office_labels(content: bytes, markers: list[tuple[str, tuple[str, ...], tuple[str, ...]]]) -> list[tuple[str, str, str, str]]:
    """(marker, label, "metadata", property) of the property parts: a property by a part of its name, a value by a string
    in any case. Start and end of an element both forget the property."""
    found: dict[tuple[str, str, str], tuple] = {}
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except BROKEN:
        return []
    for name in (n for n in archive.namelist() if n in METADATA_PARTS):
        prop, chars = "", []

        def flush():
            value = "".join(chars).strip()
            chars.clear()
            for marker, strings, _ in markers:
                for s in strings:
                    if value and s.lower() in value.lower():
                        found.setdefault((marker, prop, value), (marker, value, "metadata", prop))

        def start(_, attributes):
            nonlocal prop
            flush()
            prop = next((v for k, v in attributes.items() if k.rpartition(":")[2] == "name"), "")
            for marker, _, properties in markers:
                for p in properties:
                    if prop and p in prop:
                        found.setdefault((marker, p, prop), (marker, prop, "metadata", p))

        def end(_):
            nonlocal prop
            flush()
            prop = ""

        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars.append
        try:
            with archive.open(name) as f:
                parser.Parse(f.read(METADATA_BYTES), True)
        except (expat.ExpatError, *BROKEN):
            continue
    return list(found.values())


def _office_label_udf(rules: RuleSet):
    markers = [(m.id, m.strings, m.metadata_properties) for m in rules.markers]
    kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("marker_id", "label", "source", "property")]))

    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([office_labels(bytes(c), markers) if c is not None else [] for c in contents])

    return F.pandas_udf(run, kind)


def extracted(df: DataFrame, rules: RuleSet, options: ExtractOptions | None = None, content_col: str = "content") -> DataFrame:
    """`df` with file_type, text, partial, truncated, error, source_labels and micros (what reading an Office file or a PDF
    took) in place of the content.

    A file that can't be read has a null text and an error, and so has a null content; no file ends the job.
    """
    o = options or ExtractOptions()
    content = F.coalesce(F.col(content_col), F.lit(b""))
    df = once(df, {"file_type": file_type(content, o.strict)})
    kind = F.col("file_type")
    office, pdf = kind.isin(*OFFICE), kind == PDF
    df = once(df, {"_parts": _office_parts(F.when(office, content), kind), "_pdf": _pdf_text(F.when(pdf, content)), "_office": _office_label_udf(rules)(F.when(office, content))})
    stripped = F.array_join(F.transform("_parts.parts", lambda x: F.concat(strip_markup(x), F.lit("\n"))), "")
    found = F.encode(F.when(office, stripped).when(pdf, F.col("_pdf.text")), "UTF-8")
    df = once(df, {"_raw": F.when(kind == PLAINTEXT, content).otherwise(found)})
    cut = F.when(office, F.col("_parts.cut")).when(pdf, F.col("_pdf.cut"))
    partial = F.coalesce(F.octet_length("_raw") > o.max_file_bytes, F.lit(False)) | F.coalesce(cut, F.lit(False))
    df = once(df, {"_gated": head_tail(F.col("_raw"), o)})
    gated = F.col("_gated")
    truncated = F.coalesce(F.octet_length(gated) > o.max_bytes, F.lit(False))
    text = F.make_valid_utf8(F.substring(gated, 1, o.max_bytes).cast("string"))
    error = F.when(F.col(content_col).isNull(), "cannot be read").when(kind == UNSUPPORTED, "unsupported format").when(kind == ENCRYPTED, "encrypted or legacy document").when(pdf, F.col("_pdf.error"))
    labels = F.when(office, F.col("_office").cast(f"array<{LABEL}>")).when(pdf, xmp_labels(F.coalesce(xmp_packet(content), F.lit("")), rules))
    df = once(df, {"text": text, "partial": partial, "truncated": truncated, "error": error, "source_labels": F.coalesce(labels, F.array().cast(f"array<{LABEL}>")), "micros": F.coalesce(F.col("_parts.micros"), F.lit(0)) + F.coalesce(F.col("_pdf.micros"), F.lit(0))})
    return df.drop("_parts", "_pdf", "_office", "_raw", "_gated", content_col)
