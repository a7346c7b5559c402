"""Small artifact files made here, byte by byte: for the readers' tests and for the queries that compare what they read."""

from __future__ import annotations

import datetime as dt
import struct

from .shellitems import _LINK

#: The time in all samples, and the same in 100 ns since 1601.
D = dt.datetime(2024, 1, 1)
FT = (1_704_067_200_000_000 + 11_644_473_600_000_000) * 10


class Log:
    """Writes event-log chunks: one template with substitutions, one record per event."""

    def __init__(self):
        self.chunk = bytearray(512)
        self.template = None
        self.names = {}

    def name(self, text):
        """Reference to a name; the name itself stands right behind its first reference."""
        if text in self.names:
            return struct.pack("<I", self.names[text])
        at = self.base + len(self.body) + 4
        self.names[text] = at
        return struct.pack("<I", at) + struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def add(self, token):
        self.body += token

    def open(self, text, attributes=()):
        self.add(bytes([0x41 if attributes else 1]) + struct.pack("<HI", 0xFFFF, 0))
        self.add(self.name(text))
        if attributes:
            self.add(struct.pack("<I", 0))
        for i, (key, value) in enumerate(attributes):
            self.add(bytes([0x46 if i + 1 < len(attributes) else 6]))
            self.add(self.name(key))
            self.add(value)
        self.add(b"\x02")

    def text(self, value):
        return b"\x05\x01" + struct.pack("<H", len(value)) + value.encode("utf-16-le")

    def sub(self, index, kind, optional=False):
        return bytes([0x0E if optional else 0x0D]) + struct.pack("<HB", index, kind)

    def event(self, number, values):
        """values: (type, bytes) in order of the template's substitutions."""
        at = len(self.chunk)
        self.body, self.base = bytearray(b"\x0f\x01\x01\0"), at + 24
        self.add(b"\x0c\x01" + struct.pack("<I", 7))
        if self.template is None:
            self.template = self.base + len(self.body) + 4
            self.add(struct.pack("<I", self.template))
            head = len(self.body)
            self.add(struct.pack("<I", 0) + bytes(16) + struct.pack("<I", 0))
            start = len(self.body)
            self.add(b"\x0f\x01\x01\0")
            self.open("Event", [("xmlns", self.text("http://events"))])
            self.open("System")
            self.open("Provider", [("Name", self.sub(0, 1))])
            self.add(b"\x04")
            self.open("EventID")
            self.add(self.sub(1, 6) + b"\x04")
            self.open("TimeCreated", [("SystemTime", self.sub(2, 17))])
            self.add(b"\x04")
            self.open("EventRecordID")
            self.add(self.sub(3, 10) + b"\x04")
            self.open("Channel")
            self.add(self.sub(4, 1) + b"\x04")
            self.open("Computer")
            self.add(self.text("PC") + self.sub(5, 1) + b"\x04")
            self.open("Security", [("UserID", self.sub(6, 19, True))])
            self.add(b"\x04\x04")
            self.open("EventData")
            for i, key in enumerate(("TargetUserName", "IpAddress", "LogonType")):
                self.open("Data", [("Name", self.text(key))])
                self.add(self.sub(7 + i, values[7 + i][0], True) + b"\x04")
            self.add(b"\x04\x04\0")
            struct.pack_into("<I", self.body, head + 20, len(self.body) - start)
        else:
            self.add(struct.pack("<I", self.template))
        self.add(struct.pack("<I", len(values)) + b"".join(struct.pack("<HBB", len(v), k, 0) for k, v in values) + b"".join(v for _, v in values) + b"\0")
        size = 24 + len(self.body) + 4
        self.chunk += struct.pack("<4sIQq", b"**\0\0", size, number, FT) + self.body + struct.pack("<I", size)

    def done(self):
        struct.pack_into("<8s", self.chunk, 0, b"ElfChnk\0")
        struct.pack_into("<I", self.chunk, 48, len(self.chunk))
        return bytes(self.chunk).ljust(65536, b"\0")


def w(text):
    return 1, text.encode("utf-16-le")


SID = bytes([1, 2, 0, 0, 0, 0, 0, 5]) + struct.pack("<II", 21, 500)


def logon(log, number, event, user, channel="Security"):
    log.event(number, [w("Provider-A"), (6, struct.pack("<H", event)), (17, struct.pack("<q", FT + 10_000_000 * number)), (10, struct.pack("<Q", number)), w(channel), w("-7"), (19, SID) if number % 2 else (0, b""), w(user), w("203.0.113.9"), (8, struct.pack("<I", 3))])


def evtx(per_chunk):
    out = b"ElfFile\0".ljust(4096, b"\0")
    number = 0
    for events in per_chunk:
        log = Log()
        for event, user in events:
            number += 1
            logon(log, number, event, user)
        out += log.done()
    return out


def huffman_all_literals(data):
    """An Xpress Huffman stream of literals with a flat code of eight bits."""
    out = bytearray()
    for at in range(0, len(data), 65536):
        block = data[at : at + 65536]
        out += bytes([0x88] * 128) + bytes(128)  # 256 literals of eight bits, no matches
        bits = "".join(f"{b:08b}" for b in block)
        bits += "0" * (-len(bits) % 16) + "0" * 32
        out += b"".join(struct.pack("<H", int(bits[i : i + 16], 2)) for i in range(0, len(bits), 16))
        break
    return bytes(out)


def prefetch_file():
    body = bytearray(304)
    struct.pack_into("<I4s", body, 0, 30, b"SCCA")
    body[16 : 16 + 16] = "CALC.EXE".encode("utf-16-le")
    struct.pack_into("<8q", body, 128, FT, *[0] * 7)
    struct.pack_into("<I", body, 208, 4)
    refs = "\\VOLUME{1}\\WINDOWS\\CALC.EXE\0".encode("utf-16-le")
    struct.pack_into("<II", body, 100, 304, len(refs))
    return bytes(body) + refs


def hive(keys):
    """A hive of keys {path: {value: bytes}}, values binary."""
    cells = bytearray(b"hbin" + b"\0" * 28)

    def put(body):
        body += b"\0" * (-(len(body) + 4) % 8)
        at = len(cells)
        cells.extend(struct.pack("<i", -(len(body) + 4)) + body)
        return at

    tree = {}
    for path in keys:
        here = tree
        for part in path.split("\\"):
            here = here.setdefault(part, {})

    def node(name, path, children, flags=0x20):
        subs = [node(n, f"{path}\\{n}" if path else n, c) for n, c in children.items()]
        values = []
        for n, raw in keys.get(path, {}).items():
            values.append(put(b"vk" + struct.pack("<HIIIHH", len(n), len(raw), put(raw), 3, 1, 0) + n.encode()))
        lst = put(b"lf" + struct.pack("<H", len(subs)) + b"".join(struct.pack("<I4s", s, b"") for s in subs)) if subs else 0xFFFFFFFF
        vals = put(struct.pack(f"<{len(values)}I", *values)) if values else 0xFFFFFFFF
        head = b"nk" + struct.pack("<Hq", flags, FT + 10_000_000 * path.count("\\")) + struct.pack("<II", 0, 0) + struct.pack("<III", len(subs), 0, lst) + struct.pack("<I", 0xFFFFFFFF) + struct.pack("<II", len(values), vals)
        return put(head.ljust(72, b"\0") + struct.pack("<HH", len(name), 0) + name.encode())

    root = node("ROOT", "", tree, 0x2C)
    return b"regf".ljust(36, b"\0") + struct.pack("<I", root).ljust(4096 - 36, b"\0") + bytes(cells)


def u(text):
    return text.encode("utf-16-le")


def cache_10(entries):
    out = struct.pack("<I", 52).ljust(52, b"\0")
    for path, ft in entries:
        rest = struct.pack("<H", len(u(path))) + u(path) + struct.pack("<qI", ft, 0)
        out += b"10ts" + struct.pack("<II", 0, len(rest)) + rest
    return out


def cache_8(entries):
    out = struct.pack("<I", 128).ljust(128, b"\0")
    for path, ft in entries:
        rest = struct.pack("<H", len(u(path))) + u(path) + struct.pack("<H", 4) + b"pk\0\0" + struct.pack("<IIqI", 2, 0, ft, 0)
        out += b"10ts" + struct.pack("<II", 0, len(rest)) + rest
    return out


def cache_8_short(entries):
    return struct.pack("<II", 0x80, 0) + b"".join(b"10ts" + struct.pack("<Iq", 10 + len(u(p)), ft) + struct.pack("<H", len(u(p))) + u(p) for p, ft in entries)


def cache_7(entries):
    head = struct.pack("<II", 0xBADC0FEE, len(entries)).ljust(128, b"\0")
    texts, rows = b"", b""
    for path, ft in entries:
        rows += struct.pack("<HHIQqIIQQ", len(u(path)), len(u(path)) + 2, 0, 128 + 48 * len(entries) + len(texts), ft, 0, 0, 0, 0)
        texts += u(path)
    return head + rows + texts


def folder_item(short, long):
    ext = struct.pack("<HH", 46 + len(u(long)) + 4, 9) + b"\x04\0\xef\xbe" + bytes(46 - 8) + u(long) + b"\0\0\0\0"
    return b"\0\0" + bytes([0x31, 0]) + bytes(10) + short.encode() + b"\0" + b"\0" * (len(short) % 2 == 0) + ext


def compound(parts):
    """A compound file of small and large streams in storages one deep: {path: bytes}."""
    names = ["Root Entry"]
    folders = sorted({p.split("/")[0] for p in parts if "/" in p})
    names += folders + list(parts)
    sectors, fat = [], []

    def chain(raw):
        begin = len(sectors)
        n = max(1, -(-len(raw) // 512))
        for i in range(n):
            sectors.append(raw[512 * i : 512 * i + 512].ljust(512, b"\0"))
            fat.append(begin + i + 1 if i + 1 < n else 0xFFFFFFFE)
        return begin

    mini, mini_fat, places = b"", [], {}
    for p, raw in parts.items():
        if len(raw) >= 4096:
            places[p] = chain(raw)
        else:
            places[p] = len(mini) // 64
            n = max(1, -(-len(raw) // 64))
            mini_fat += [places[p] + i + 1 if i + 1 < n else 0xFFFFFFFE for i in range(n)]
            mini += raw.ljust(64 * n, b"\0")
    at_mini = chain(mini) if mini else 0xFFFFFFFE
    at_mini_fat = chain(struct.pack(f"<{len(mini_fat)}I", *mini_fat)) if mini_fat else 0xFFFFFFFE

    def entry(name, kind, right, child, begin, size):
        text = name.encode("utf-16-le") + b"\0\0"
        return text.ljust(64, b"\0") + struct.pack("<HBBIII", len(text), kind, 1, 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<IQ", begin, size)

    index = {n: i for i, n in enumerate(names)}

    def siblings(group):
        return {n: index[group[i + 1]] if i + 1 < len(group) else 0xFFFFFFFF for i, n in enumerate(group)}

    top = folders + [p for p in parts if "/" not in p]
    right = siblings(top)
    for f in folders:
        right |= siblings([p for p in parts if p.startswith(f + "/")])
    raw = entry("Root Entry", 5, 0xFFFFFFFF, index[top[0]], at_mini, len(mini))
    for f in folders:
        raw += entry(f, 1, right[f], index[next(p for p in parts if p.startswith(f + "/"))], 0, 0)
    for p, body in parts.items():
        raw += entry(p.split("/")[-1], 2, right[p], 0xFFFFFFFF, places[p], len(body))
    at_dir = chain(raw)
    at_fat = len(sectors)
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    assert len(table) == 512
    sectors.append(table)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", 1, at_dir, 0, 4096, at_mini_fat, 1 if mini_fat else 0, 0xFFFFFFFE, 0) + struct.pack("<I", at_fat)
    return head.ljust(512, b"\xff") + b"".join(sectors)


def link(target):
    info = struct.pack("<7I", 0, 28, 1, 28, 45, 0, 0)
    body = info + struct.pack("<IIII", 17, 3, 0x1234, 16) + b"\0" + target.encode() + b"\0" + b"\0"
    body = struct.pack("<I", len(body)) + body[4:24] + struct.pack("<I", len(body) - 1) + body[28:]
    return _LINK + struct.pack("<II", 2, 0) + struct.pack("<qqq", FT, FT, FT) + bytes(24) + body + bytes(4)


KINDS = {"bit": 1, "u8": 2, "i16": 3, "i32": 4, "f64": 8, "text": 10, "blob": 11, "ltext": 12, "i64": 15, "guid": 16}
PACK = {"u8": "<B", "i16": "<h", "i32": "<i", "f64": "<d", "i64": "<q"}


def record(columns, row):
    """Fixed columns (ids below 128), variable ones (below 256) and tagged ones of a row."""
    fixed = [(i, k, n) for i, k, n in columns if i < 128]
    head, nulls = b"", 0
    for i, k, n in fixed:
        size = {"bit": 1, "u8": 1, "i16": 2, "i32": 4, "f64": 8, "i64": 8, "guid": 16}[k]
        v = row.get(n)
        nulls |= (v is None) << i - 1
        head += bytes(size) if v is None else v if k == "guid" else struct.pack(PACK[k], v)
    last = max((i for i, *_ in fixed), default=0)
    head += nulls.to_bytes((last + 7) // 8, "little")
    variable = [(i, row.get(n)) for i, k, n in columns if 128 <= i < 256]
    ends, body = b"", b""
    for _, v in variable:
        body += v or b""
        ends += struct.pack("<H", len(body) | (0x8000 if v is None else 0))
    tags = [(i, row[n]) for i, k, n in columns if i >= 256 and row.get(n) is not None]
    table, data = b"", b""
    for i, v in tags:
        mark, raw = (0x4000, bytes([v[0]]) + v[1]) if isinstance(v, tuple) else (0, v)
        table += struct.pack("<HH", i, 4 * len(tags) + len(data) | mark)
        data += raw
    return struct.pack("<BBH", last, 127 + len(variable), 4 + len(head)) + head + ends + body + table + data


def page(entries, flags, size=8192):
    """A page of (key, data) entries; the first tag is the page's own."""
    body, tags = b"", [(0, 0)]
    for key, raw in entries:
        tags.append((2 + len(key) + len(raw), len(body)))
        body += struct.pack("<H", len(key)) + key + raw
    out = bytearray(size)
    struct.pack_into("<HI", out, 34, len(tags), flags)
    out[40 : 40 + len(body)] = body
    for i, (n, off) in enumerate(tags):
        struct.pack_into("<HH", out, size - 4 * (i + 1), n, off)
    return bytes(out)


def database(tables):
    """A database of tables {name: (columns, rows, long values)}; the first table's rows lie on two pages."""
    catalog_columns = [(1, "i32", "a"), (2, "i16", "b"), (3, "i32", "c"), (4, "i32", "d"), (5, "i32", "e"), (6, "i32", "f"), (7, "i32", "g"), (128, "text", "name")]
    pages, entries = {}, []
    number = 5

    def listed(owner, kind, ident, what, page_or_locale, name):
        entries.append((struct.pack(">I", len(entries)), record(catalog_columns, {"a": owner, "b": kind, "c": ident, "d": what, "e": 0, "f": 0, "g": page_or_locale, "name": name.encode()})))

    for t, (name, (columns, rows, longs)) in enumerate(tables.items()):
        raw = [(struct.pack(">I", i), record(columns, r)) for i, r in enumerate(rows)]
        listed(t + 2, 1, t + 2, number, 0, name)
        if t == 0 and len(raw) > 1:
            pages[number] = page([(b"a", struct.pack("<I", number + 1)), (b"b", struct.pack("<I", number + 2))], 1 | 4)
            pages[number + 1], pages[number + 2] = page(raw[:1], 2), page(raw[1:], 2)
            number += 3
        else:
            pages[number] = page(raw, 1 | 2)
            number += 1
        for i, k, n in columns:
            listed(t + 2, 2, i, KINDS[k], 1200 if k in ("text", "ltext") else 0, n)
        if longs:
            listed(t + 2, 4, 9, number, 0, "LV")
            parts = [(struct.pack(">I", k), struct.pack("<II", 1, len(v))) for k, v in longs.items()] + [(struct.pack(">II", k, at), v[at : at + 4000]) for k, v in longs.items() for at in range(0, len(v), 4000)]
            pages[number] = page(parts, 1 | 2)
            number += 1
    pages[4] = page(entries, 1 | 2)
    head = bytearray(8192)
    struct.pack_into("<II", head, 4, 0x89ABCDEF, 0x620)
    struct.pack_into("<II", head, 232, 17, 8192)
    return bytes(head) * 2 + b"".join(pages.get(i, bytes(8192)) for i in range(1, number))


DAYS = (D - dt.datetime(1899, 12, 30)).days + 0.25


def srudb():
    usage = [(1, "i32", "AutoIncId"), (2, "f64", "TimeStamp"), (3, "i32", "AppId"), (4, "i32", "UserId"), (5, "i64", "InterfaceLuid"), (6, "i32", "L2ProfileId"), (7, "i64", "BytesSent"), (8, "i64", "BytesRecvd")]
    program = [*usage[:4], (5, "i64", "ForegroundCycleTime"), (6, "i64", "BackgroundCycleTime"), (7, "i32", "ForegroundContextSwitches"), (8, "i32", "BackgroundContextSwitches"), (9, "i64", "ForegroundBytesRead"), (10, "i64", "ForegroundBytesWritten")]
    return database({
        "{973F5D5C-1D90-4944-BE8E-24B94231A174}": (usage, [{"AutoIncId": 1, "TimeStamp": DAYS, "AppId": 1, "UserId": 2, "InterfaceLuid": 77, "BytesSent": 1 << 40, "BytesRecvd": 5}, {"AutoIncId": 2, "TimeStamp": DAYS, "AppId": 3, "UserId": 9, "BytesSent": 1, "BytesRecvd": 2}], {}),
        "{D10CA2FE-6FCF-4F6D-848E-B2E99266FA89}": (program, [{"AutoIncId": 1, "TimeStamp": DAYS, "AppId": 1, "UserId": 2, "ForegroundCycleTime": 9, "BackgroundCycleTime": 8, "ForegroundContextSwitches": 7, "BackgroundContextSwitches": 6, "ForegroundBytesRead": 5, "ForegroundBytesWritten": 4}], {}),
        "SruDbIdMapTable": ([(1, "u8", "IdType"), (2, "i32", "IdIndex"), (256, "blob", "IdBlob")], [{"IdType": 0, "IdIndex": 1, "IdBlob": u("\\Device\\app.exe\0")}, {"IdType": 3, "IdIndex": 2, "IdBlob": SID}, {"IdType": 1, "IdIndex": 3, "IdBlob": (4, struct.pack("<I", 6))}], {6: u("svc" * 1000)}),
    })


def counted(text):
    return struct.pack("<I", len(text) + 1) + u(text) + b"\0\0"


def file_entry(number, name, parent, flags=1, base=0, size=None, streams=(), short=None):
    """A file record of 1,024 bytes with update marks; short: a second name of eight letters."""

    def attribute(kind, body, label=""):
        text = u(label)
        head = struct.pack("<IIBBHHHIHH", kind, 0, 0, len(label), 24, 0, 0, len(body), 24 + len(text), 0)
        raw = head + text + body
        raw += b"\0" * (-len(raw) % 8)
        return raw[:4] + struct.pack("<I", len(raw)) + raw[8:]

    def named(text, space):
        return attribute(0x30, struct.pack("<Q", parent | 1 << 48) + bytes(56) + bytes([len(text), space]) + u(text))

    body = attribute(0x10, struct.pack("<4q", FT, FT, FT, FT) + bytes(16)) if not base else b""
    if short:
        body += named(short, 2)
    if name:
        body += named(name, 1)
    if size is not None:
        body += attribute(0x80, b"x" * size)
    for s in streams:
        body += attribute(0x80, b"y", s)
    rec = bytearray((struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 48, 3, 0, 1, 1, 56, flags, 0, 1024, base, 0, 0, number) + bytes(8) + body + b"\xff\xff\xff\xff").ljust(1024, b"\0"))
    struct.pack_into("<HHH", rec, 48, 7, *struct.unpack_from("<H", rec, 510), *struct.unpack_from("<H", rec, 1022))
    struct.pack_into("<H", rec, 510, 7)
    struct.pack_into("<H", rec, 1022, 7)
    return bytes(rec)


def file_table():
    """A small table: folders nested, a deleted file, streams, an extended record, a missing parent, a circle, damaged records."""
    rows = {0: ("$MFT", 5), 5: (".", 5), 6: ("Users", 5), 7: ("ann", 6), 8: ("Downloads", 7), 9: ("setup program.exe", 8), 10: ("lost.txt", 99), 11: ("a", 12), 12: ("b", 11), 13: (None, 0), 14: ("deleted.txt", 8)}
    out = []
    for n in range(20):
        if n == 9:
            out.append(file_entry(n, *rows[n], size=11, streams=("Zone.Identifier",), short="SETUPP~1"))
        elif n == 13:
            out.append(file_entry(n, None, 0))
        elif n == 14:
            out.append(file_entry(n, *rows[n], flags=0, size=3))
        elif n == 15:
            out.append(file_entry(n, "long name.bin", 8, base=13, size=40, streams=("extra",)))
        elif n in rows:
            out.append(file_entry(n, *rows[n], flags=3 if n in (5, 6, 7, 8, 11, 12) else 1))
        else:
            out.append(b"BAAD".ljust(1024, b"\0") if n % 2 else bytes(1024))
    return b"".join(out)
