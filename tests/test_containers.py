"""Readers of binary documents, on files that the tests make."""

import struct

from glyphloom.sources import containers as C

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


def ole2(streams: dict[str, bytes]) -> bytes:
    """A compound file: streams under 4,096 bytes lie in the mini stream."""
    sectors, fat = [], []

    def put(raw: bytes) -> int:
        start, n = len(sectors), max(1, -(-len(raw) // 512))
        sectors.extend(raw[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(n))
        fat.extend([*range(start + 1, start + n), END])
        return start

    mini, mini_fat, entries = b"", [], []
    for name, raw in streams.items():
        if len(raw) < 4096:
            start, n = len(mini) // 64, max(1, -(-len(raw) // 64))
            mini += raw.ljust(n * 64, b"\0")
            mini_fat += [*range(start + 1, start + n), END]
        else:
            start = put(raw)
        entries.append((name, 2, start, len(raw)))
    entries.insert(0, ("Root Entry", 5, put(mini), len(mini)))
    raw = b"".join((n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(n) + 2, kind)).ljust(116, b"\0") + struct.pack("<III", start, size, 0) for n, kind, start, size in entries)
    directory = put(raw)
    minis = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat) + b"\xff" * (-4 * len(mini_fat) % 512))
    own = len(sectors)
    fat.append(0xFFFFFFFD)
    assert len(fat) <= 128
    sectors.append(struct.pack("<128I", *fat, *[FREE] * (128 - len(fat))))
    head = bytes.fromhex("d0cf11e0a1b11ae1").ljust(24, b"\0") + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6)
    head = head.ljust(44, b"\0") + struct.pack("<8I", 1, directory, 0, 4096, minis, 1, END, 0) + struct.pack("<109I", own, *[FREE] * 108)
    return head + b"".join(sectors)


def record(kind: int, body: bytes, head: int = 0) -> bytes:
    return struct.pack("<HHI", head, kind, len(body)) + body


def test_word_pieces():
    first, second = "Bé Tµi\r\x13x".encode("cp1252"), "Hà Nội\x07".encode("utf-16-le")
    main = bytearray(6000)
    struct.pack_into("<H", main, 10, 0x200)
    main[1000 : 1000 + len(first)], main[5000 : 5000 + len(second)] = first, second
    pieces = struct.pack("<3I", 0, len(first), len(first) + 7) + struct.pack("<HIH", 0, 2000 | 0x40000000, 0) + struct.pack("<HIH", 0, 5000, 0)
    clx = b"\x01\x02\x00ab\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 418, 3, len(clx))
    made = ole2({"WordDocument": bytes(main), "1Table": b"xyz" + clx + ".VnTime".encode("utf-16-le") + b"VNI-Times"})
    assert C.text_of(made, "doc") == "Bé Tµi\nxHà Nội\n"
    assert C.fonts_of(made, "doc") == ["VNI-Times"]  # the other name stands at an odd place


def test_slides_of_last_revision():
    old = record(1000, record(C.TEXT_BYTES, b"old"), 15)
    new = record(1000, record(1008, record(C.TEXT_BYTES, b"B\xb5\rx"), 15) + record(C.TEXT_CHARS, "Nội".encode("utf-16-le")), 15)
    body = b"\0" * 8 + old
    edit = lambda before, directory: record(C.USER_EDIT, struct.pack("<7I", 0, 0, before, directory, 1, 0, 0))
    place, first = len(body), 0
    body += record(C.PERSIST, struct.pack("<II", 1 | 1 << 20, 8))
    first = len(body)
    body += edit(0, place)
    at = len(body)
    body += new
    place = len(body)
    body += record(C.PERSIST, struct.pack("<II", 1 | 1 << 20, at))
    last = len(body)
    body += edit(first, place)
    user = record(0x0FF6, struct.pack("<III", 20, 0, last))
    assert C.text_of(ole2({"PowerPoint Document": body, "Current User": user}), "ppt") == "Bµ\nx\nNội"
    assert C.text_of(ole2({"PowerPoint Document": body}), "ppt") == ""


def test_sheets():
    rec = lambda kind, body=b"": struct.pack("<HH", kind, len(body)) + body
    wide = "Hà  Nội".encode("utf-16-le")
    sst = rec(C.SST, struct.pack("<II", 2, 2) + struct.pack("<HB", 3, 0) + b"B\xb5 " + struct.pack("<HB", 7, 1) + wide[:4]) + rec(C.CONTINUE, b"\x01" + wide[4:])
    sheet = rec(0x809, b"\0" * 16) + rec(C.LABEL_SST, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(C.NUMBER, struct.pack("<HHHd", 0, 2, 0, 33.74668725180189)) + rec(C.LABEL_SST, struct.pack("<HHHI", 1, 1, 0, 1))
    sheet += rec(C.MULTI_RK, struct.pack("<HHHIHIH", 2, 0, 0, 5 << 2 | 2, 0, 1234 << 2 | 3, 1)) + rec(0x0A)
    head = lambda at: rec(0x809, b"\0" * 16) + rec(C.SHEET, struct.pack("<IBB", at, 0, 0) + b"\x01\0S") + sst + rec(0x0A)
    assert C.text_of(ole2({"Workbook": head(len(head(0))) + sheet}), "xls") == "Bµ\t\t33.74668725\n\tHà Nội\t\n5\t12.34\t"
    assert [C.cell_text(x) for x in (5.0, 0.1 + 0.2, -3.0, " a  b ", 1e20)] == ["5", "0.3", "-3", "a b", "100000000000000000000"]


def test_rtf():
    raw = rb"{\rtf1\ansi{\fonttbl{\f0 .VnTime;}{\f1 VNSabc1;}}{\*\generator x;}B\'b5 \{x\}\par\u7897 ?a\uc0\u273 b\tab c\line}"
    assert C.text_of(raw, "rtf") == "Bµ {x}\nộ" + "ađb\tc\n"
    assert C.fonts_of(raw, "rtf") == [".VnTime", "VNSabc1"]


def test_columns(spark):
    rows = [(1, b"{\\rtf1 a}", "a/x.RTF"), (2, b"nonsense", "b.doc"), (3, None, "c.xls"), (4, b"", "d"), (5, b"{\\rtf1 \\'", "e.rtf")]
    df = spark.createDataFrame(rows, "n int, content binary, path string").withColumn("kind", C.kind_of("path"))
    got = df.select("n", C.container_text("content", "kind").alias("t"), C.declared_fonts("content", "kind").alias("f")).orderBy("n").collect()
    assert [r.t for r in got][:4] == ["a", None, None, None] and all(r.f == [] for r in got)
