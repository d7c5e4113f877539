"""What a file is, by its first bytes and, for archives, its entries."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAINTEXT, DOCX, XLSX, PPTX, PDF, ENCRYPTED, UNSUPPORTED = "plaintext", "docx", "xlsx", "pptx", "pdf", "encrypted", "unsupported"
OFFICE = (DOCX, XLSX, PPTX)
SAMPLE_BYTES = 8192

_ZIP, _OLE, _PDF = b"PK\x03\x04", b"\xd0\xcf\x11\xe0", b"%PDF"


def office_type(content: bytes) -> str:
    """Of an archive: which kind of Office document its entries make it."""
    try:
        names = zipfile.ZipFile(io.BytesIO(content)).namelist()
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, IndexError, struct.error):
        return UNSUPPORTED
    if "word/document.xml" in names:
        return DOCX
    if any(n.startswith("xl/") for n in names):
        return XLSX
    return PPTX if any(n.startswith("ppt/slides/") for n in names) else UNSUPPORTED


@F.pandas_udf(T.StringType())
def _office_type(contents: pd.Series) -> pd.Series:
    return pd.Series([office_type(bytes(c)) if c is not None else None for c in contents], dtype=object)


def is_textual(content: Column, strict: bool = False) -> Column:
    """No NUL and valid UTF-8 in the first SAMPLE_BYTES; unless `strict`, a character cut by the sample's end is fine."""
    sample = F.substring(content, 1, SAMPLE_BYTES)
    valid = F.is_valid_utf8(sample.cast("string"))
    if not strict:
        for cut in (1, 2, 3):
            shorter = F.substring(content, 1, SAMPLE_BYTES - cut)
            valid = valid | ((F.octet_length(content) > SAMPLE_BYTES) & F.is_valid_utf8(shorter.cast("string")))
    return ~F.contains(sample, F.lit(b"\x00")) & valid


def magic(content: Column, strict: bool = False) -> Column:
    """The type by its first bytes alone; archives are "zip"."""
    starts = lambda head: F.startswith(content, F.lit(head))
    return F.when(starts(_PDF), PDF).when(starts(_OLE), ENCRYPTED).when(starts(_ZIP), "zip").when(is_textual(content, strict), PLAINTEXT).otherwise(UNSUPPORTED)


def file_type(content: Column, strict: bool = False) -> Column:
    """The type of a file. Only archives are opened."""
    kind = magic(content, strict)
    return F.when(kind == "zip", _office_type(F.when(kind == "zip", content))).otherwise(kind)
