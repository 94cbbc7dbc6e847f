"""Predicates that tell legacy text from Unicode text and one legacy encoding from the other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphloom.functions import codecs

# Letters that no legacy text has; font prefixes and their encodings; limits.
UNICODE_ONLY = "ăâđêôơưĂÂĐÊÔƠƯẠ-ỹ"
FONTS = {".vn": "tcvn3", "vni": "vni", "vps": "vps", "abc": "tcvn3"}
FEW_LEGACY, FEW_HIGH, VNI_SHARE = 20, 50, 0.35


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def text_is_legacy(text: Column) -> Column:
    """True, false, or null if the text has too little to tell."""
    legacy, unicode = codecs.high_count(text), _count(text, UNICODE_ONLY)
    return F.when((unicode == 0) & (legacy < FEW_LEGACY), F.lit(None).cast("boolean")).otherwise(legacy > unicode)


def legacy_dominates(text: Column) -> Column:
    return codecs.high_count(text) > _count(F.lower(text), codecs.ACCENTED + "đ")


def text_family(text: Column) -> Column:
    """vni, tcvn3, or null: VNI's high characters follow the vowels that they mark."""
    high = codecs.high_count(text)
    after = F.regexp_count(text, F.lit(f"(?<=[aeiouyAEIOUY])[{codecs.HIGH}]"))
    return F.when(high < FEW_HIGH, F.lit(None).cast("string")).when(after / high > VNI_SHARE, "vni").otherwise("tcvn3")


def classify(fonts: Column, text: Column, is_doc: Column) -> Column:
    """The encoding by the chain of gates: fonts, legacy test (of .doc only), dominance, shape, fewer unmapped characters. Without text, the alphabetically first encoding of the fonts."""
    table = codecs._mapped(FONTS)
    known = F.exists(fonts, lambda f: F.try_element_at(table, F.lower(F.substring(f, 1, 3))).isNotNull())
    family = text_family(text)
    t, v = F.size(codecs.unmapped(codecs.tcvn3_decode(text))), F.size(codecs.unmapped(codecs.vni_decode(text)))
    first = F.array_min(F.filter(F.transform(fonts, lambda f: F.try_element_at(table, F.lower(F.substring(f, 1, 3)))), lambda x: x.isNotNull()))
    open_ = known & text.isNotNull() & (~is_doc | F.coalesce(text_is_legacy(text), F.lit(False))) & legacy_dominates(text) & family.isNotNull()
    return F.when(known & text.isNull(), first).when(open_, F.when(t < v, "tcvn3").when(v < t, "vni").otherwise(family))


def scan_kind(chars_per_page: Column, image_share: Column, pages: Column) -> Column:
    """scan, digital, mixed or unreadable by text and images of a document's first twelve pages."""
    return F.when(F.coalesce(pages, F.lit(0)) == 0, "unreadable").when((chars_per_page < 40) & (image_share >= 0.6), "scan").when((chars_per_page >= 40) & (image_share < 0.6), "digital").otherwise("mixed")
