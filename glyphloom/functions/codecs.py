"""Decoders and an encoder for two pre-Unicode encodings of Vietnamese, as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphloom.functions.text import nfc

# The TCVN3 encoding, character by character.
TCVN3 = {
    "¡": "Ă", "¢": "Â", "£": "Ê", "¤": "Ô", "¥": "Ơ", "¦": "Ư", "§": "Đ", "¨": "ă", "©": "â", "ª": "ê", "«": "ô", "¬": "ơ", "\xad": "ư", "®": "đ",
    "µ": "à", "¸": "á", "¶": "ả", "·": "ã", "¹": "ạ", "»": "ằ", "¾": "ắ", "¼": "ẳ", "½": "ẵ", "Æ": "ặ", "Ç": "ầ", "Ê": "ấ", "È": "ẩ", "É": "ẫ", "Ë": "ậ",
    "Ì": "è", "Ð": "é", "Î": "ẻ", "Ï": "ẽ", "Ñ": "ẹ", "Ò": "ề", "Õ": "ế", "Ó": "ể", "Ô": "ễ", "Ö": "ệ", "×": "ì", "Ý": "í", "Ø": "ỉ", "Ü": "ĩ", "Þ": "ị",
    "ß": "ò", "ã": "ó", "á": "ỏ", "â": "õ", "ä": "ọ", "å": "ồ", "è": "ố", "æ": "ổ", "ç": "ỗ", "é": "ộ", "ê": "ờ", "í": "ớ", "ë": "ở", "ì": "ỡ", "î": "ợ",
    "ï": "ù", "ó": "ú", "ñ": "ủ", "ò": "ũ", "ô": "ụ", "õ": "ừ", "ø": "ứ", "ö": "ử", "÷": "ữ", "ù": "ự", "ú": "ỳ", "ý": "ý", "û": "ỷ", "ü": "ỹ", "þ": "ỵ",
}
# Characters that a PDF's text layer has in place of TCVN3's.
PDF = {"−": "\xad", "∙": "\xb7"}
# The VNI encoding: modifiers in lower case with the marks that they add, letters that take modifiers, letters that don't.
ACUTE, GRAVE, HOOK, TILDE, DOT, CIRCUMFLEX, BREVE = "́", "̀", "̉", "̃", "̣", "̂", "̆"
VNI_MARKS = {
    "ù": ACUTE, "ø": GRAVE, "û": HOOK, "õ": TILDE, "ï": DOT, "â": CIRCUMFLEX, "ê": BREVE, "á": CIRCUMFLEX + ACUTE, "à": CIRCUMFLEX + GRAVE,
    "å": CIRCUMFLEX + HOOK, "ã": CIRCUMFLEX + TILDE, "ä": CIRCUMFLEX + DOT, "é": BREVE + ACUTE, "è": BREVE + GRAVE, "ë": BREVE + DOT, "ü": BREVE + TILDE,
}
VNI_LETTERS = {**{c: c for c in "aeiouy"}, "ô": "ơ", "ö": "ư"}
VNI_ALONE = {"ñ": "đ", "ò": "ị", "æ": "ỉ", "ó": "ĩ"}
# Vietnamese letters of Latin-1; Vietnamese letters with a diacritic in lower case.
LATIN1_VN = "ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝàáâãèéêìíòóôõùúý"
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
HIGH = "\xa1-\xff"
# Characters of HIGH that no Vietnamese text has.
FOREIGN = "".join(c for c in map(chr, range(0xA1, 0x100)) if c not in LATIN1_VN)


def both_cases(table: dict[str, str]) -> dict[str, str]:
    return {**table, **{k.upper(): v.upper() for k, v in table.items()}}


def vni_tables() -> tuple[dict[str, str], dict[str, str]]:
    """What decodes (pairs and single letters), and what letters are encoded as: the same made backwards.

    Decoding takes any mix of cases; encoding gives a letter's mark the letter's case. Letters that stand alone come first.
    """
    marks = {**VNI_MARKS, **{k.upper(): v for k, v in VNI_MARKS.items()}}
    letters, alone = both_cases(VNI_LETTERS), both_cases(VNI_ALONE)
    decode, encode = {}, {v: k for k, v in alone.items()}
    for c, letter in letters.items():
        for m, mark in marks.items():
            whole = unicodedata.normalize("NFC", letter + mark)
            if len(whole) > 1 or letter in "ơưƠƯ" and mark[0] in (CIRCUMFLEX, BREVE):
                continue
            decode[c + m] = whole
            if c.isupper() == m.isupper():
                encode.setdefault(whole, c + m)
    decode |= alone | {c: x for c, x in letters.items() if c != x}
    for c, x in letters.items():
        if c != x:
            encode.setdefault(x, c)
    return decode, encode


VNI_DECODE, VNI_ENCODE = vni_tables()


def _pair_pattern() -> str:
    """Pairs before single characters: per letter the modifiers that it takes."""
    by: dict[str, str] = {}
    for k in VNI_DECODE:
        if len(k) == 2:
            by[k[0]] = by.get(k[0], "") + k[1]
    return "(?s)" + "|".join(f"{c}[{m}]" for c, m in by.items()) + "|."


VNI_PATTERN = _pair_pattern()


def _mapped(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def tcvn3_mapped(text: Column) -> Column:
    table = {**TCVN3, **{k: TCVN3[v] for k, v in PDF.items()}}
    return F.translate(text, "".join(table), "".join(table.values()))


def upper_runs(text: Column) -> Column:
    """Lines with three or more ASCII letters, all of them capitals, wholly in capitals: the encoding has no accented ones."""
    shout = lambda x: ~x.rlike("[a-z]") & (F.length(F.regexp_replace(x, "[^A-Za-z]+", "")) >= 3)
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(shout(x), F.upper(x)).otherwise(x)), "\n")


def tcvn3_decode(text: Column) -> Column:
    """Not idempotent: apply it only to text that is in the encoding."""
    return upper_runs(tcvn3_mapped(text))


def tcvn3_convert(text: Column) -> Column:
    """tcvn3_decode, composed: whole texts only, as composing leaves the JVM."""
    return nfc(tcvn3_decode(text))


def vni_convert(text: Column) -> Column:
    """vni_decode, composed."""
    return nfc(vni_decode(text))


# Runs of ASCII but for a last letter that a modifier may follow, pairs, and single characters: the same parts as VNI_PATTERN gives, with ASCII in one.
_VNI_PARTS = "(?s)[\\x00-\\x7f]+(?![^\\x00-\\x7f])|" + VNI_PATTERN.removeprefix("(?s)")
# What pairs decode to, a row of letters for each modifier, and single characters.
_FIRSTS, _SECONDS = ("".join(dict.fromkeys(k[n] for k in VNI_DECODE if len(k) == 2)) for n in (0, 1))
_PAIRS = [VNI_DECODE.get(c + m) for m in _SECONDS for c in _FIRSTS]
_SINGLE = {k: v for k, v in VNI_DECODE.items() if len(k) == 1}
# What letters encode to: a base, and a mark for those that have one, which come first.
_ENCODED = dict(sorted(VNI_ENCODE.items(), key=lambda kv: -len(kv[1])))


def _beyond_ascii(part: Column) -> Column:
    return F.octet_length(part) > F.length(part)


def vni_decode(text: Column) -> Column:
    pairs = F.array(*map(F.lit, _PAIRS))

    def one(x: Column) -> Column:
        at = (F.instr(F.lit(_SECONDS), F.substring(x, 2, 1)) - 1) * len(_FIRSTS) + F.instr(F.lit(_FIRSTS), F.substring(x, 1, 1))
        return F.when(F.length(x) == 2, F.element_at(pairs, at)).otherwise(F.translate(x, "".join(_SINGLE), "".join(_SINGLE.values())))

    # ASCII runs of any length, and a pair has two characters of which one at least is beyond ASCII.
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_VNI_PARTS), F.lit(0)), lambda x: F.when(_beyond_ascii(x), one(x)).otherwise(x)), "")


def vni_encode(text: Column) -> Column:
    letters, bases, marks = "".join(_ENCODED), "".join(v[0] for v in _ENCODED.values()), "".join(v[1:] for v in _ENCODED.values())
    known = lambda x: F.instr(F.lit(letters), x) > 0
    one = lambda x: F.when(known(x), F.concat(F.translate(x, letters, bases), F.translate(x, letters, marks))).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)[\x00-\x7f]+|."), F.lit(0)), lambda x: F.when(_beyond_ascii(x), one(x)).otherwise(x)), "")


def vni_encodable(text: Column) -> Column:
    """Whether every letter beyond ASCII has a verified form."""
    return ~F.translate(F.regexp_replace(text, r"[\x00-\x7f]+", ""), "".join(VNI_ENCODE), "").rlike(r"\p{L}")


def residue(decoded: Column) -> Column:
    """Characters of the upper half of Latin-1 that no Vietnamese text has."""
    return F.length(F.regexp_replace(decoded, f"[^{FOREIGN}]+", ""))


def unmapped(decoded: Column) -> Column:
    """The distinct characters that residue() counts."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(decoded, f"[^{FOREIGN}]+", ""), ""), lambda x: x != ""))


def misread(decoded: Column) -> Column:
    """How badly a decoded line reads: residue counts three times, impossible vowel pairs once."""
    return residue(decoded) * 3 + F.regexp_count(decoded, F.lit(f"[aeiouyAEIOUY][{ACCENTED}]"))


def high_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{HIGH}]+", ""))
