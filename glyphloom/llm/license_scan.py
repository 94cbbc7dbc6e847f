"""License scans by ordered signature rules.

Each rule is a regular expression over the lower-cased text with a label, a
priority and keywords, one of which every match contains. An Aho-Corasick
automaton over the keywords says which rules a text needs at all. Overlapping
detections are resolved by interval containment: a detection that lies inside
one of higher priority, or inside a longer one of equal priority, is suppressed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from glyphloom.llm.common import by_text, table

# Phrases of the base and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Label, the keyword that a match must hold, names as patterns, identifiers as patterns, addresses as patterns.
_ = r"[\s,_-]+"
FAMILIES = (
    ("gpl-3.0", "general public", [r"gnu general public licen[sc]e,? (?:version|v\.?) ?3"], [r"gpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"], [r"gnu\.org/licenses/gpl-3\.0"]),
    ("gpl-2.0", "general public", [r"gnu general public licen[sc]e,? (?:version|v\.?) ?2"], [r"gpl-?v?2(?:\.0)?(?:-only|-or-later|\+)?"], [r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"]),
    ("gpl", "general public", [r"gnu general public licen[sc]e", r"gnu gpl"], [r"gpl"], [r"gnu\.org/licenses/gpl"]),
    ("lgpl-3.0", "lesser", [r"lesser general public licen[sc]e,? (?:version|v\.?) ?3"], [r"lgpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"], [r"gnu\.org/licenses/lgpl-3\.0"]),
    ("lgpl-2.1", "lesser", [r"lesser general public licen[sc]e,? (?:version|v\.?) ?2\.1"], [r"lgpl-?v?2\.1(?:-only|-or-later|\+)?"], [r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"]),
    ("lgpl", "general public", [r"gnu (?:lesser|library) general public licen[sc]e", r"gnu lgpl"], [r"lgpl"], [r"gnu\.org/licenses/lgpl"]),
    ("agpl-3.0", "affero", [r"gnu affero general public licen[sc]e", r"affero gpl"], [r"agpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"], [r"gnu\.org/licenses/agpl"]),
    ("gfdl", "free documentation", [r"gnu free documentation licen[sc]e"], [r"gfdl(?:-1\.[123])?"], [r"gnu\.org/licenses/fdl"]),
    ("apache-2.0", "apache", [r"apache licen[sc]e,? (?:version|v\.?) ?2(?:\.0)?", r"apache software licen[sc]e,? (?:version|v\.?) ?2(?:\.0)?"], [r"apache-2(?:\.0)?", r"asl ?2\.0"], [r"apache\.org/licenses/license-2\.0"]),
    ("apache-1.1", "apache", [r"apache (?:software )?licen[sc]e,? (?:version|v\.?) ?1\.1"], [r"apache-1\.1"], [r"apache\.org/licenses/license-1\.1"]),
    ("apache", "apache", [r"apache licen[sc]e", r"apache software licen[sc]e"], [r"apache"], [r"apache\.org/licenses"]),
    ("mit", "mit", [r"\bmit licen[sc]e", r"the mit/x11 licen[sc]e", r"\bexpat licen[sc]e"], [r"mit"], [r"opensource\.org/licen[sc]es?/mit"]),
    ("mit-0", "mit", [r"mit no attribution"], [r"mit-0"], [r"opensource\.org/licen[sc]es?/mit-0"]),
    ("bsd-4-clause", "bsd", [r"4-clause bsd licen[sc]e", r"original bsd licen[sc]e"], [r"bsd-4-clause"], [r"directory\.fsf\.org/wiki/license:bsd-4-clause"]),
    ("bsd-3-clause", "bsd", [r"(?:3|three)-clause bsd licen[sc]e", r"(?:new|revised|modified) bsd licen[sc]e"], [r"bsd-3-clause(?:-clear)?"], [r"opensource\.org/licen[sc]es?/bsd-3-clause"]),
    ("bsd-2-clause", "bsd", [r"(?:2|two)-clause bsd licen[sc]e", r"(?:simplified|freebsd) bsd licen[sc]e"], [r"bsd-2-clause(?:-patent)?"], [r"opensource\.org/licen[sc]es?/bsd-2-clause"]),
    ("bsd", "bsd", [r"\bbsd licen[sc]e", r"berkeley software distribution"], [r"bsd"], [r"opensource\.org/licen[sc]es?/bsd"]),
    ("0bsd", "bsd", [r"zero-clause bsd", r"bsd zero clause"], [r"0bsd"], [r"opensource\.org/licen[sc]es?/0bsd"]),
    ("isc", "isc", [r"\bisc licen[sc]e", r"internet systems consortium licen[sc]e"], [r"isc"], [r"opensource\.org/licen[sc]es?/isc"]),
    ("mpl-2.0", "mozilla", [r"mozilla public licen[sc]e,? (?:version|v\.?) ?2(?:\.0)?"], [r"mpl-?2(?:\.0)?"], [r"mozilla\.org/(?:en-us/)?mpl/2\.0"]),
    ("mpl-1.1", "mozilla", [r"mozilla public licen[sc]e,? (?:version|v\.?) ?1\.1"], [r"mpl-?1\.1"], [r"mozilla\.org/(?:en-us/)?mpl/1\.1"]),
    ("mpl", "mozilla", [r"mozilla public licen[sc]e"], [r"mpl"], [r"mozilla\.org/(?:en-us/)?mpl"]),
    ("epl-2.0", "eclipse", [r"eclipse public licen[sc]e,? (?:-|version|v\.?) ?(?:v )?2(?:\.0)?"], [r"epl-?2(?:\.0)?"], [r"eclipse\.org/legal/epl-2\.0"]),
    ("epl-1.0", "eclipse", [r"eclipse public licen[sc]e"], [r"epl-?1(?:\.0)?"], [r"eclipse\.org/legal/epl-v10"]),
    ("edl-1.0", "eclipse", [r"eclipse distribution licen[sc]e"], [r"edl-?1(?:\.0)?"], [r"eclipse\.org/org/documents/edl"]),
    ("cddl-1.0", "common development", [r"common development and distribution licen[sc]e"], [r"cddl(?:-1\.[01])?"], [r"opensource\.org/licen[sc]es?/cddl"]),
    ("cpl-1.0", "common public", [r"common public licen[sc]e"], [r"cpl-1\.0"], [r"opensource\.org/licen[sc]es?/cpl"]),
    ("eupl-1.2", "european union", [r"european union public licen[sc]e"], [r"eupl(?:-1\.[12])?"], [r"joinup\.ec\.europa\.eu/[a-z/]*eupl"]),
    ("artistic-2.0", "artistic", [r"artistic licen[sc]e,? (?:version|v\.?)? ?2(?:\.0)?"], [r"artistic-2\.0"], [r"opensource\.org/licen[sc]es?/artistic-2"]),
    ("artistic", "artistic", [r"artistic licen[sc]e"], [r"artistic(?:-1\.0)?(?:-perl)?"], [r"opensource\.org/licen[sc]es?/artistic"]),
    ("zlib", "zlib", [r"\bzlib licen[sc]e", r"zlib/libpng licen[sc]e"], [r"zlib"], [r"opensource\.org/licen[sc]es?/zlib"]),
    ("libpng", "libpng", [r"\blibpng licen[sc]e"], [r"libpng(?:-2\.0)?"], [r"libpng\.org/pub/png/src/libpng-license"]),
    ("boost", "boost", [r"boost software licen[sc]e"], [r"bsl-1\.0"], [r"boost\.org/license_1_0"]),
    ("unlicense", "unlicense", [r"\bthe unlicense"], [r"unlicense"], [r"unlicense\.org"]),
    ("wtfpl", "want to public", [r"do what the f\S+ you want to public licen[sc]e"], [r"wtfpl"], [r"wtfpl\.net"]),
    ("psf-2.0", "python software", [r"python software foundation licen[sc]e"], [r"psf-2\.0", r"python-2\.0"], [r"docs\.python\.org/\S*license"]),
    ("php-3.01", "php", [r"\bphp licen[sc]e"], [r"php-3\.0[01]?"], [r"php\.net/license"]),
    ("ruby", "ruby", [r"\bruby licen[sc]e"], [r"ruby"], [r"ruby-lang\.org/\S*license"]),
    ("openssl", "openssl", [r"\bopenssl licen[sc]e"], [r"openssl"], [r"openssl\.org/source/license"]),
    ("ofl-1.1", "open font", [r"sil open font licen[sc]e", r"open font licen[sc]e"], [r"ofl-1\.[01]"], [r"scripts\.sil\.org/ofl"]),
    ("ms-pl", "microsoft", [r"microsoft public licen[sc]e"], [r"ms-pl"], [r"opensource\.org/licen[sc]es?/ms-pl"]),
    ("ms-rl", "microsoft", [r"microsoft reciprocal licen[sc]e"], [r"ms-rl"], [r"opensource\.org/licen[sc]es?/ms-rl"]),
    ("cc0", "cc0", [r"\bcc0 1\.0", r"creative commons (?:zero|cc0)"], [r"cc0-1\.0", r"cc0"], [r"creativecommons\.org/publicdomain/zero"]),
    ("cc-by-nc-nd", "cc by", [rf"\bcc{_}by{_}nc{_}nd"], [r"cc-by-nc-nd(?:-[1234]\.0)?"], [r"creativecommons\.org/licenses/by-nc-nd"]),
    ("cc-by-nc-sa", "cc by", [rf"\bcc{_}by{_}nc{_}sa", r"attribution-noncommercial-sharealike"], [r"cc-by-nc-sa(?:-[1234]\.0)?"], [r"creativecommons\.org/licenses/by-nc-sa"]),
    ("cc-by-nc", "cc by", [rf"\bcc{_}by{_}nc", r"attribution-noncommercial"], [r"cc-by-nc(?:-[1234]\.0)?"], [r"creativecommons\.org/licenses/by-nc/"]),
    ("cc-by-nd", "cc by", [rf"\bcc{_}by{_}nd", r"attribution-noderivs"], [r"cc-by-nd(?:-[1234]\.0)?"], [r"creativecommons\.org/licenses/by-nd"]),
    ("cc-by-sa", "cc by", [rf"\bcc{_}by{_}sa", r"attribution-sharealike"], [r"cc-by-sa(?:-[1234]\.0)?"], [r"creativecommons\.org/licenses/by-sa"]),
    ("cc-by", "cc by", [rf"\bcc{_}by\b", r"creative commons attribution"], [r"cc-by(?:-[1234]\.0)?"], [r"creativecommons\.org/licenses/by/"]),
    ("odbl", "open database", [r"open database licen[sc]e"], [r"odbl-1\.0"], [r"opendatacommons\.org/licenses/odbl"]),
    ("odc-by", "open data commons", [r"open data commons attribution"], [r"odc-by-1\.0"], [r"opendatacommons\.org/licenses/by"]),
    ("public-domain", "public domain", [r"(?:released|dedicated|placed) (?:in|in)?to the public domain"], [r"publicdomain"], [r"creativecommons\.org/publicdomain/mark"]),
    ("proprietary", "rights reserved", [r"all rights reserved"], [r"licenseref-proprietary"], [r"\bunlicensed\b"]),
    ("busl-1.1", "business source", [r"business source licen[sc]e"], [r"busl-1\.1"], [r"mariadb\.com/bsl"]),
    ("sspl-1.0", "server side", [r"server side public licen[sc]e"], [r"sspl-1\.0"], [r"mongodb\.com/licensing/server-side"]),
    ("elastic-2.0", "elastic", [r"elastic licen[sc]e"], [r"elastic-2\.0"], [r"elastic\.co/licensing/elastic-license"]),
    ("ncsa", "ncsa", [r"illinois/ncsa open source licen[sc]e"], [r"ncsa"], [r"opensource\.org/licen[sc]es?/ncsa"]),
    ("afl-3.0", "academic free", [r"academic free licen[sc]e"], [r"afl-[123]\.[012]"], [r"opensource\.org/licen[sc]es?/afl"]),
    ("osl-3.0", "open software", [r"open software licen[sc]e"], [r"osl-[123]\.0"], [r"opensource\.org/licen[sc]es?/osl"]),
    ("postgresql", "postgresql", [r"\bpostgresql licen[sc]e"], [r"postgresql"], [r"postgresql\.org/about/licence"]),
)

#: Keywords of the names that can match without their family's one: every match holds one of them.
_CC = tuple("cc" + c for c in " \t\n\r\f\v,_-")
OWN_KEYS = {
    "gnu gpl": ("gnu gpl",), "gnu lgpl": ("gnu lgpl",), r"\bexpat licen[sc]e": ("expat licen",), "berkeley software distribution": ("berkeley",),
    "internet systems consortium licen[sc]e": ("internet systems",), "creative commons (?:zero|cc0)": ("creative commons",), "creative commons attribution": ("creative commons",),
    **{n: _CC if n.startswith(r"\bcc") else ("attribution-",) for label, _, names, _, _ in FAMILIES if label.startswith("cc-by") for n in names if not n.startswith("creative")},
}


def rules() -> list[tuple[int, tuple[str, ...], str, str, float]]:
    """(priority, keywords, pattern, label, weight) in order: addresses and tags first, then grants, names and titles."""
    out = []
    for label, key, names, ids, urls in FAMILIES:
        out += [(4, (u.split(r"\.")[0].split("(")[0].removeprefix(r"\b").removesuffix(r"\b"),), u, label, 0.9) for u in urls]
        out += [(4, ("spdx",), rf"spdx-license-identifier:\s*\(?(?:[\w.+-]+\s+(?:or|and|with)\s+)*{i}(?![\w.+-])", label, 0.95) for i in ids]
        out += [(3, OWN_KEYS.get(n, (key,)), rf"(?:licen[sc]ed|released|distributed|available|published|redistribute\S*|provided)\s+(?:\S+\s+){{0,5}}?(?:under|by|with)\s+(?:the\s+(?:terms\s+of\s+the\s+)?|an?\s+)?(?:{n})", label, 0.85) for n in names]
        out += [(3, ("licen",), rf"\blicen[sc]e\s*[:=]\s*[\"']?{i}(?![\w.+-])", label, 0.8) for i in ids]
        out += [(2, OWN_KEYS.get(n, (key,)), n, label, 0.6) for n in names]
    # A rule with a longer label of the same family tells more (gpl-3.0 before gpl).
    return sorted(out, key=lambda r: (-r[0], -len(r[3]), r[3], r[2]))


RULES = rules()
#: Byte by byte: A-Z to lower case, what is no word character to a space; bytes of other letters stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}


def scanner():
    """A function from a text to (n_words, n_base, first_word, last_word, base_labels, labels, score, detections)."""
    import ahocorasick

    gate = ahocorasick.Automaton()
    by_key: dict[str, list[int]] = {}
    for i, r in enumerate(RULES):
        for key in r[1]:
            by_key.setdefault(key, []).append(i)
    for key, places in by_key.items():
        gate.add_word(key, places)
    gate.make_automaton()
    compiled: dict[int, re.Pattern] = {}

    def one(text: str) -> tuple:
        words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
        flat = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in PHRASES:
            at = flat.find(want := f" {phrase} ".encode())
            while at >= 0:
                places.append(flat.count(b" ", 0, at + 1) - 1)
                base.add(label)
                at = flat.find(want, at + 1)
        low, found = text.translate(_LOWER), []
        need = sorted({i for _, of in gate.iter(low) for i in of})
        for i in need:
            pattern = compiled.get(i) or compiled.setdefault(i, re.compile(RULES[i][2], re.ASCII))
            found += [(m.start(), m.end(), i) for m in pattern.finditer(low)]
        survive, around = [], []  # around: survivors that reach beyond the present start
        for s, e, i in sorted(found, key=lambda x: (x[0], -x[1], x[2])):  # what contains comes before what it contains
            around = [x for x in around if x[1] > s]
            if not any(x[1] >= e and (RULES[x[2]][0], x[1] - x[0]) >= (RULES[i][0], e - s) for x in around):
                around.append((s, e, i))
                survive.append(i)
        open_ = 0.5 ** len(places)
        for i in survive:
            open_ *= 1 - RULES[i][4]
        labels = base | {RULES[i][3] for i in survive}
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - open_, len(survive)

    return one


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of docs. Null text counts as empty: no words, no labels, score 0. Rows that repeat are rows of the result; an empty table gives an empty one.

    Of detections that begin and end alike, the one of higher priority stands; of equal priority, the first in order.

    score: 1 minus the product of what the detections and base places leave open.
    """
    made: list = []

    def one(text: str) -> tuple:
        if not made:
            made.append(scanner())
        return made[0](text)

    return by_text(docs, one, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its licenses; null text counts as empty."""
    return scan(table(spark, sf_dir, "documents"))
