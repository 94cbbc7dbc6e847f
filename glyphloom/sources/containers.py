"""Text and font names of legacy binary documents: .doc, .ppt and .xls (OLE2), .rtf, .pdf.

The bytes go to Python in Arrow batches; each file is read on its own, so the pass is narrow. A file that can't be read
has null text and no fonts. PDF text needs the pdfplumber package; without it, the text of a PDF is null.
"""

from __future__ import annotations

import io
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Kinds and suffixes; font names; Word's control characters and what stands for them; line breaks of slides.
KINDS = {"doc": ".doc", "xls": ".xls", "ppt": ".ppt", "rtf": ".rtf", "pdf": ".pdf"}
STREAM_FONTS = r"\.Vn[A-Za-z]+|VNI-[A-Za-z]+|VPS[A-Za-z]+|ABC[A-Za-z]*"
BYTE_FONTS = STREAM_FONTS + r"|VNS[A-Za-z0-9]+"
WORD_CONTROLS = {"\r": "\n", "\x07": "\n", "\x0b": "\n", "\x0c": "\n", "\x13": "", "\x14": "", "\x15": "", "\x01": "", "\x02": "", "\x08": "", "\x1e": "-", "\xa0": " "}
SLIDE_BREAKS = {"\r": "\n", "\x0b": "\n"}
# Record types of presentations and spreadsheets.
USER_EDIT, PERSIST, TEXT_BYTES, TEXT_CHARS = 0x0FF5, 0x1772, 0x0FA8, 0x0FA0
SHEET, SST, CONTINUE, LABEL_SST, LABEL, NUMBER, RK, MULTI_RK, FORMULA, STRING, BOOLEAN = 0x85, 0xFC, 0x3C, 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205
# RTF control words that stand for a character, and destinations without text.
RTF_CHARS = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "|", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "~": "\xa0", "_": "-"}
RTF_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "headerl", "headerr", "headerf", "footer", "footerl", "footerr", "footerf", "footnote", "listtable", "listoverridetable", "revtbl", "rsidtbl", "generator", "themedata", "datastore", "fldinst", "xmlnstbl", "latentstyles"}
END = 0xFFFFFFFA  # sector numbers from here on end a chain


class Ole2:
    """The named streams of an OLE2 compound file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
            raise ValueError("not an OLE2 file")
        self.data = data
        big, small = struct.unpack_from("<HH", data, 30)
        directory, _, self.cutoff, mini_fat, _, more, _ = struct.unpack_from("<7I", data, 48)
        self.sector, self.mini_sector = 1 << big, 1 << small
        lists = [x for x in struct.unpack_from("<109I", data, 76) if x < END]
        seen: set[int] = set()
        while more < END and more not in seen:  # the list of FAT sectors goes on in a chain of its own
            seen.add(more)
            *part, more = self._numbers(more)
            lists += [x for x in part if x < END]
        self.fat = [x for s in lists for x in self._numbers(s)]
        self.mini_fat = self._unpacked(self._chain(mini_fat))
        self.entries: dict[str, tuple[int, int]] = {}
        self.mini = b""
        raw = self._chain(directory)
        for at in range(0, len(raw) - 127, 128):
            length, kind = struct.unpack_from("<HB", raw, at + 64)
            start, size = struct.unpack_from("<II", raw, at + 116)
            if kind == 5:
                self.mini = self._chain(start)[:size]
            elif kind == 2:
                self.entries.setdefault(raw[at : at + max(length - 2, 0)].decode("utf-16-le", "replace"), (start, size))

    def _at(self, n: int) -> bytes:
        return self.data[(n + 1) * self.sector : (n + 2) * self.sector]

    @staticmethod
    def _unpacked(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _numbers(self, n: int) -> list[int]:
        return self._unpacked(self._at(n))

    @staticmethod
    def _follow(start: int, table: list[int]):
        seen: set[int] = set()
        while start < len(table) and start not in seen:
            seen.add(start)
            yield start
            start = table[start]

    def _chain(self, start: int) -> bytes:
        return b"".join(self._at(n) for n in self._follow(start, self.fat))

    def read(self, name: str) -> bytes:
        """The stream's bytes; none if there is no such stream."""
        if name not in self.entries:
            return b""
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        w = self.mini_sector
        return b"".join(self.mini[n * w : (n + 1) * w] for n in self._follow(start, self.mini_fat))[:size]


def word_text(data: bytes) -> str:
    """The main stream's pieces in order: eight-bit ones are Windows-1252, others UTF-16."""
    ole = Ole2(data)
    main = ole.read("WordDocument")
    (flags,) = struct.unpack_from("<H", main, 10)
    start, size = struct.unpack_from("<II", main, 418)
    clx = ole.read("1Table" if flags & 0x200 else "0Table")[start : start + size]
    at = 0
    while clx[at] == 1:  # property blocks come before the piece table
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if clx[at] != 2:
        raise ValueError("no piece table")
    (size,) = struct.unpack_from("<I", clx, at + 1)
    table = clx[at + 5 : at + 5 + size]
    n = (size - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", table)
    out = []
    for i in range(n):
        (where,) = struct.unpack_from("<I", table, 4 * (n + 1) + 8 * i + 2)
        chars = ends[i + 1] - ends[i]
        if where & 0x40000000:
            where = (where & 0x3FFFFFFF) // 2
            out.append(main[where : where + chars].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * chars].decode("utf-16-le", "replace"))
    return "".join(out).translate(str.maketrans(WORD_CONTROLS))


def _atoms(data: bytes, at: int, end: int):
    """(type, body) of each atom in data[at:end]; containers are entered, by a stack as they may nest deeply."""
    stack = [(at, end)]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            head, kind, size = struct.unpack_from("<HHI", data, at)
            at += 8
            if size > end - at:
                break
            if head & 15 == 15:
                stack.append((at + size, end))
                end = at + size
            else:
                yield kind, data[at : at + size]
                at += size


def slides_text(data: bytes) -> str:
    """Text of the revision saved last. Older revisions stay in the stream, so without a chain of edits there is no text."""
    ole = Ole2(data)
    body, user = ole.read("PowerPoint Document"), ole.read("Current User")
    if len(user) < 20:
        return ""
    (edit,) = struct.unpack_from("<I", user, 16)
    places: dict[int, int] = {}
    document, seen = None, set()
    while edit and edit not in seen and edit + 36 <= len(body) and struct.unpack_from("<H", body, edit + 2)[0] == USER_EDIT:
        seen.add(edit)
        before, directory, own = struct.unpack_from("<III", body, edit + 16)
        document = own if document is None else document
        older: dict[int, int] = {}
        if directory + 8 <= len(body) and struct.unpack_from("<H", body, directory + 2)[0] == PERSIST:
            numbers = Ole2._unpacked(body[directory + 8 : directory + 8 + struct.unpack_from("<I", body, directory + 4)[0]])
            i = 0
            while i < len(numbers):
                first, many = numbers[i] & 0xFFFFF, numbers[i] >> 20
                older |= {first + k: x for k, x in enumerate(numbers[i + 1 : i + 1 + many])}
                i += 1 + many
        places = older | places  # newer edits win
        edit = before
    start = places.get(document)
    if start is None or start + 8 > len(body):
        return ""
    end = min(start + 8 + struct.unpack_from("<I", body, start + 4)[0], len(body))
    code = {TEXT_BYTES: "latin-1", TEXT_CHARS: "utf-16-le"}
    found = [raw.decode(code[kind], "replace") for kind, raw in _atoms(body, start + 8, end) if kind in code]
    return "\n".join(found).translate(str.maketrans(SLIDE_BREAKS))


def cell_text(value: object) -> str:
    """A cell as a reader sees it: whole numbers without a point, others to ten digits, texts with single spaces."""
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else format(value, ".10g")
    return " ".join(str(value).split())


def _rk(n: int) -> float:
    value = float((n - (1 << 32) if n >> 31 else n) >> 2) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & 0xFFFFFFFC) << 32))[0]
    return value / 100 if n & 1 else value


class _Strings:
    """Reads strings from a record that goes on in others; a string's characters may change width where it goes on."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.i, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.parts[self.i]):
                self.i, self.at = self.i + 1, 0
            got = self.parts[self.i][self.at : self.at + n - len(out)]
            out, self.at = out + got, self.at + len(got)
        return out

    def string(self) -> str:
        chars, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while chars:
            if self.at >= len(self.parts[self.i]):
                self.i, self.at = self.i + 1, 1
                wide = self.parts[self.i][0] & 1
            here = min(chars, (len(self.parts[self.i]) - self.at) // (2 if wide else 1))
            if not here:
                raise ValueError("broken string")
            out.append(self.take(here * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace"))
            chars -= here
        self.take(4 * runs + extra)
        return "".join(out)


def _xl_string(raw: bytes) -> str:
    return _Strings([raw]).string() if raw else ""


def sheets_text(data: bytes) -> str:
    """The rows of all sheets, cells joined by tabs (BIFF8)."""
    book = (ole := Ole2(data)).read("Workbook")
    if not book:
        raise ValueError("no BIFF8 workbook" if "Book" in ole.entries else "no workbook")

    def records(at: int):
        while at + 4 <= len(book):
            kind, size = struct.unpack_from("<HH", book, at)
            yield kind, book[at + 4 : at + 4 + size]
            at += 4 + size

    starts, parts, last = [], [], 0
    for kind, raw in records(0):
        if kind == SHEET and raw[5] == 0:
            starts.append(struct.unpack_from("<I", raw)[0])
        if kind == SST:
            parts = [raw]
        elif kind == CONTINUE and last == SST:
            parts.append(raw)
        last = last if kind == CONTINUE else kind
        if kind == 0x0A:  # end of the part that describes the book
            break
    strings: list[str] = []
    if parts:
        (n,) = struct.unpack_from("<I", parts[0], 4)
        source = _Strings([parts[0][8:], *parts[1:]])
        strings = [source.string() for _ in range(n)]
    lines = []
    for start in starts:
        cells: dict[tuple[int, int], object] = {}
        depth, waiting = 0, None
        for kind, raw in records(start):
            depth += (kind == 0x809) - (kind == 0x0A)
            if kind == 0x0A and depth == 0:
                break
            if depth > 1:  # a chart within the sheet
                continue
            if kind == STRING and waiting:
                cells[waiting], waiting = _xl_string(raw), None
            if kind not in (LABEL_SST, LABEL, NUMBER, RK, MULTI_RK, FORMULA, BOOLEAN):
                continue
            row, col = at = struct.unpack_from("<HH", raw)
            if kind == LABEL_SST:
                cells[at] = strings[struct.unpack_from("<I", raw, 6)[0]]
            elif kind == LABEL:
                cells[at] = _xl_string(raw[6:])
            elif kind == NUMBER:
                (cells[at],) = struct.unpack_from("<d", raw, 6)
            elif kind == RK:
                cells[at] = _rk(struct.unpack_from("<I", raw, 6)[0])
            elif kind == MULTI_RK:
                cells |= {(row, col + k): _rk(struct.unpack_from("<I", raw, 6 + 6 * k)[0]) for k in range((len(raw) - 6) // 6)}
            elif kind == BOOLEAN:
                cells[at] = raw[6]
            elif raw[12:14] == b"\xff\xff":  # a formula whose value is no number
                cells[at] = raw[8] if raw[6] in (1, 2) else ""
                waiting = at if raw[6] == 0 else None
            else:
                (cells[at],) = struct.unpack_from("<d", raw, 6)
        height, width = (1 + max((k[i] for k in cells), default=-1) for i in (0, 1))
        lines += ["\t".join(cell_text(cells.get((r, c), "")) for c in range(width)) for r in range(height)]
    return "\n".join(lines)


_RTF = re.compile(r"\\u(-?\d+) ?|\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z\r\n])|([{}])|[\r\n]+|([^\\{}\r\n]+)|\\[\r\n]?")


def rtf_text(data: bytes) -> str:
    """The text of an RTF file; eight-bit characters are Windows-1252, or Latin-1 where that has none."""
    out: list[str] = []
    stack, silent, width, skip = [], False, 1, 0
    for m in _RTF.finditer(data.decode("latin-1")):
        code, word, number, byte, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append((silent, width))
            skip = 0
        elif brace:
            silent, width = stack.pop() if stack else (False, 1)
            skip = 0
        elif sign == "*" or word in RTF_SILENT:
            silent = True
        elif word == "uc":
            width = int(number or 1)
        elif word == "bin" or silent:
            continue
        elif code:
            out.append(chr(int(code) % 65536))
            skip = width
        elif skip and (byte or sign or word in RTF_CHARS):
            skip -= 1
        elif byte:
            raw = bytes.fromhex(byte)
            out.append(raw.decode("cp1252") if raw not in (b"\x81", b"\x8d", b"\x8f", b"\x90", b"\x9d") else raw.decode("latin-1"))
        elif word or sign:
            out.append(RTF_CHARS.get(word or sign, sign if sign in ("\\", "{", "}") else ""))
        elif plain:
            out.append(plain[skip:])
            skip = max(0, skip - len(plain))
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def pdf_text(data: bytes) -> str:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return "\n".join(page.extract_text() or "" for page in pdf.pages)


READERS = {"doc": word_text, "ppt": slides_text, "xls": sheets_text, "rtf": rtf_text, "pdf": pdf_text}


def text_of(data: bytes | None, kind: str | None) -> str | None:
    try:
        return READERS[kind](data)
    except Exception:  # whatever is wrong with a file from the web, it has no text
        return None


def fonts_of(data: bytes | None, kind: str | None) -> list[str]:
    if data is None:
        return []
    if kind not in ("doc", "xls", "ppt"):
        return sorted(set(re.findall(BYTE_FONTS, data.decode("latin-1"))))
    try:
        ole = Ole2(data)
        raw = [ole.read(n) for n in ole.entries]
    except Exception:
        return []
    return sorted({x for r in raw for code in ("utf-16-le", "latin-1") for x in re.findall(STREAM_FONTS, r.decode(code, "ignore"))})


@F.pandas_udf(StringType())
def container_text(content: pd.Series, kind: pd.Series) -> pd.Series:
    """The text of each file by its kind (a key of KINDS); null for what can't be read."""
    return pd.Series([text_of(c, k) for c, k in zip(content, kind, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def declared_fonts(content: pd.Series, kind: pd.Series) -> pd.Series:
    """Distinct names of legacy fonts that each file declares, sorted."""
    return pd.Series([fonts_of(c, k) for c, k in zip(content, kind, strict=True)], dtype=object)


def kind_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
