"""File names for collected documents."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import parse_qs, unquote, urlparse

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that hold a name, suffixes that a name loses, its greatest length, and the kinds that are collected.
PARAMETERS, SUFFIXES, LENGTH = ("file", "filename", "name"), ("doc", "docx", "pdf", "ppt", "pptx", "rtf", "xls", "xlsx"), 48
KINDS = ("doc", "pdf", "ppt", "rtf", "xls")


def stem_of(url: str, kind: str) -> str:
    """ASCII letters, digits, dots, hyphens and underscores of the name in an address; the kind if nothing is left."""
    try:
        parts = urlparse(url)
    except ValueError:
        return kind
    asked = parse_qs(parts.query)
    raw = next((asked[p][0] for p in PARAMETERS if asked.get(p)), parts.path.rpartition("/")[2])
    plain = unicodedata.normalize("NFKD", unquote(raw)).encode("ascii", "ignore").decode()
    plain = re.sub(rf"(?i)\.({'|'.join(SUFFIXES)})$", "", plain)
    return re.sub(r"[^A-Za-z0-9._-]+", "-", plain).strip("-")[:LENGTH] or kind


@F.pandas_udf(StringType())
def safe_stem(url: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if u is None or k is None else stem_of(u, k) for u, k in zip(url, kind, strict=True)], dtype=object)
