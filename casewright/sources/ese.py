"""Extensible storage engine databases: pages, catalog and records; resource usage (SRUM), transfers (BITS) and directory accounts (NTDS) from them.

Pages of a table's tree are found through its catalog entry and read depth
first. Records bring fixed columns, variable ones and tagged ones; long values
live in a tree of their own.
"""

from __future__ import annotations

import datetime as dt
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from .binary import from_filetime
from .eventlog import sid_text

# Sizes of column types that are fixed, and how their numbers are read.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 4, 7: 8, 8: 8, 14: 4, 15: 8, 16: 16, 17: 2}
_READ = {1: "<?", 2: "<B", 3: "<h", 4: "<i", 5: "<q", 6: "<f", 7: "<d", 8: "<q", 14: "<I", 15: "<q", 17: "<H"}


@dataclass
class Column:
    ident: int
    name: str
    kind: int
    size: int
    codepage: int


@dataclass
class Table:
    name: str
    root: int
    columns: list[Column] = field(default_factory=list)
    long_root: int = 0


_CATALOG = Table("MSysObjects", 4, [Column(i, n, k, _SIZES[k], 0) for i, n, k in ((1, "ObjidTable", 4), (2, "Type", 3), (3, "Id", 4), (4, "ColtypOrPgnoFDP", 4), (5, "SpaceUsage", 4), (6, "Flags", 4), (7, "PagesOrLocale", 4))] + [Column(128, "Name", 10, 0, 1252)])


def lz77(data: bytes, size: int) -> bytes:
    """Plain Xpress: 32 flags, then literals and matches."""
    out = bytearray()
    at = half = 0
    flags = left = 0
    while len(out) < size and at < len(data):
        if not left:
            flags, left = struct.unpack_from("<I", data, at)[0], 32
            at += 4
            continue
        left -= 1
        if not flags >> left & 1:
            out.append(data[at])
            at += 1
            continue
        pair = struct.unpack_from("<H", data, at)[0]
        at += 2
        length, back = pair & 7, (pair >> 3) + 1
        if length == 7:
            if half:
                length, half = data[half] >> 4, 0
            else:
                length, half = data[at] & 15, at
                at += 1
            if length == 15:
                length = data[at]
                at += 1
                if length == 255:
                    length = struct.unpack_from("<H", data, at)[0]
                    at += 2
                    if length == 0:
                        length = struct.unpack_from("<I", data, at)[0]
                        at += 4
                    length -= 15 + 7
                length += 15
            length += 7
        for _ in range(length + 3):
            out.append(out[-back])
    return bytes(out[:size])


def unpacked(raw: bytes) -> bytes:
    """A compressed column value: seven bits a character, or plain Xpress."""
    how = raw[0] >> 3
    if how in (1, 2):
        bits = int.from_bytes(raw[1:], "little")
        n = ((len(raw) - 2) * 8 + (raw[0] & 7) + 1) // 7
        text = bytes(bits >> 7 * i & 127 for i in range(n))
        return text if how == 1 else text.decode("latin-1").encode("utf-16-le")
    if how == 3:
        return lz77(raw[3:], struct.unpack_from("<H", raw, 1)[0])
    raise ValueError(f"compression {how}")


class Database:
    """Tables of a database file by name; rows are read as they are asked for."""

    def __init__(self, data: bytes):
        if len(data) < 668 or data[4:8] != b"\xef\xcd\xab\x89":
            raise ValueError("no storage engine database")
        self.data = data
        self.page_size = struct.unpack_from("<I", data, 236)[0]
        self.large = self.page_size >= 16384 and struct.unpack_from("<I", data, 232)[0] >= 17
        self.tables: dict[str, Table] = {}
        by_id: dict[int, Table] = {}
        for row in self.rows(_CATALOG):
            kind, owner = row.get("Type"), row.get("ObjidTable")
            if kind == 1:
                by_id[owner] = self.tables[row["Name"]] = Table(row["Name"], row["ColtypOrPgnoFDP"])
            elif kind == 2 and owner in by_id:
                by_id[owner].columns.append(Column(row["Id"], row["Name"], row["ColtypOrPgnoFDP"], row["SpaceUsage"] or 0, row["PagesOrLocale"] or 0))
            elif kind == 4 and owner in by_id:
                by_id[owner].long_root = row["ColtypOrPgnoFDP"]
        for t in self.tables.values():
            t.columns.sort(key=lambda c: c.ident)

    def entries(self, root: int) -> Iterator[tuple[bytes, bytes]]:
        """(key, data) of every leaf entry of a tree."""
        todo, seen = [root], set()
        while todo:
            number = todo.pop()
            if number in seen or number <= 0:
                continue
            seen.add(number)
            page = self.data[(number + 1) * self.page_size : (number + 2) * self.page_size]
            if len(page) < self.page_size:
                continue
            n_tags = struct.unpack_from("<H", page, 34)[0]
            flags = struct.unpack_from("<I", page, 36)[0]
            head = 80 if self.large else 40
            shared, children = b"", []
            for i in range(n_tags):
                size, off = struct.unpack_from("<HH", page, self.page_size - 4 * (i + 1))
                if self.large:
                    size, off = size & 0x7FFF, off & 0x7FFF
                    mark = struct.unpack_from("<H", page, head + off)[0] >> 13 if size >= 2 else 0
                else:
                    mark, size, off = off >> 13, size & 0x1FFF, off & 0x1FFF
                raw = page[head + off : head + off + size]
                if i == 0:
                    shared = raw if not flags & 1 else b""
                    continue
                if mark & 2 or len(raw) < 2:
                    continue
                at, prefix = 0, b""
                if mark & 4:
                    prefix = shared[: struct.unpack_from("<H", raw)[0] & 0x1FFF]
                    at = 2
                n = struct.unpack_from("<H", raw, at)[0] & 0x1FFF
                key, body = prefix + raw[at + 2 : at + 2 + n], raw[at + 2 + n :]
                if flags & 2:
                    yield key, body
                elif len(body) >= 4:
                    children.append(struct.unpack_from("<I", body)[0])
            todo += reversed(children)

    def rows(self, table: Table) -> Iterator[dict]:
        """Rows as names and values; null columns are left out."""
        if table.long_root:
            parts: dict[int, list[tuple[int, bytes]]] = {}
            for key, body in self.entries(table.long_root):
                if len(key) >= 8:
                    parts.setdefault(int.from_bytes(key[:4], "big"), []).append((int.from_bytes(key[4:8], "big"), body))
            longs = {k: b"".join(b for _, b in sorted(v)) for k, v in parts.items()}
        else:
            longs = {}
        fixed = [c for c in table.columns if c.ident < 128]
        variable = [c for c in table.columns if 128 <= c.ident < 256]
        tagged = {c.ident: c for c in table.columns if c.ident >= 256}
        for _, raw in self.entries(table.root):
            if len(raw) < 4:
                continue
            last_fixed, last_variable, place = struct.unpack_from("<BBH", raw)
            out: dict = {}
            nulls = raw[place - (last_fixed + 7) // 8 : place]
            at = 4
            for i, c in enumerate(fixed):
                size = _SIZES.get(c.kind, c.size)
                if c.ident <= last_fixed:
                    bit = c.ident - 1
                    if not (bit // 8 < len(nulls) and nulls[bit // 8] >> bit % 8 & 1):
                        out[c.name] = self.value(c, raw[at : at + size])
                at += size
            n = max(0, last_variable - 127)
            ends = struct.unpack_from(f"<{n}H", raw, place)
            start, begin = 0, place + 2 * n
            for c in variable:
                if c.ident - 128 >= n:
                    break
                start = next((ends[j] & 0x7FFF for j in range(c.ident - 129, -1, -1)), 0)
                end = ends[c.ident - 128]
                if not end & 0x8000:
                    out[c.name] = self.value(c, raw[begin + start : begin + end])
            rest = raw[begin + (ends[-1] & 0x7FFF if n else 0) :]
            if len(rest) >= 4:
                mask = 0x7FFF if self.large else 0x3FFF
                count = (struct.unpack_from("<H", rest, 2)[0] & mask) // 4
                marks = [struct.unpack_from("<HH", rest, 4 * i) for i in range(count) if 4 * i + 4 <= len(rest)]
                for i, (ident, off) in enumerate(marks):
                    body = rest[off & mask : marks[i + 1][1] & mask if i + 1 < len(marks) else len(rest)]
                    c = tagged.get(ident)
                    if c is None or not body:
                        continue
                    how = 0
                    if self.large or off & 0x4000:
                        how, body = body[0], body[1:]
                    if how & 4:
                        body = longs.get(int.from_bytes(body[:4], "little"), longs.get(int.from_bytes(body[:4], "big"), b""))
                    elif how & 8:  # several values: the first counts
                        first = struct.unpack_from("<H", body)[0] & 0x7FFF
                        more = struct.unpack_from("<H", body, 2)[0] & 0x7FFF if first > 2 else len(body)
                        body = body[first:more]
                    if how & 2 and body:
                        body = unpacked(body)
                    out[c.name] = self.value(c, body)
            yield out

    def value(self, c: Column, raw: bytes):
        if c.kind in _READ:
            return struct.unpack_from(_READ[c.kind], raw)[0] if len(raw) >= _SIZES[c.kind] else None
        if c.kind == 16:
            return str(uuid.UUID(bytes_le=raw[:16]))
        if c.kind in (10, 12):
            return raw.decode("utf-16-le" if c.codepage == 1200 else "cp1252", "replace").rstrip("\0")
        return raw

    def table(self, *names: str) -> Table | None:
        """The first table of one of the names, in any case."""
        low = {n.lower(): t for n, t in self.tables.items()}
        return next((low[n.lower()] for n in names if n.lower() in low), None)


def _days(v) -> dt.datetime | None:
    """Days since 1899-12-30 as a double, or the same bits read as an integer."""
    if v is None:
        return None
    days = struct.unpack("<d", struct.pack("<q", v))[0] if isinstance(v, int) else v
    return dt.datetime(1899, 12, 30) + dt.timedelta(milliseconds=round(days * 86_400_000)) if 1 < days < 300_000 else None


# ---- resource usage

# Tables of network and of program usage.
NETWORK, PROGRAMS = "{973F5D5C-1D90-4944-BE8E-24B94231A174}", "{D10CA2FE-6FCF-4F6D-848E-B2E99266FA89}"


def _names(db: Database) -> dict[int, str]:
    """Programs and accounts by their number: texts, or SIDs where the type says so."""
    ids = db.table("SruDbIdMapTable")
    out = {}
    for r in db.rows(ids) if ids else ():
        blob = r.get("IdBlob") or b""
        if blob and r.get("IdIndex") is not None:
            out[r["IdIndex"]] = sid_text(blob) if r.get("IdType") == 3 and len(blob) >= 8 else blob.decode("utf-16-le", "replace").rstrip("\0")
    return out


def _usage(data: bytes, table: str, columns: dict[str, str]) -> Iterator[dict]:
    db = Database(data)
    wanted, names = db.table(table), _names(db)
    for r in db.rows(wanted) if wanted else ():
        app, user = r.get("AppId"), r.get("UserId")
        yield {"timestamp": _days(r.get("TimeStamp")), "app_id": app, "user_id": user, "app_name": names.get(app), "user_name": names.get(user), **{n: r.get(c) for n, c in columns.items()}}


def srum_network(data: bytes, path: str) -> Iterator[dict]:
    """srum_network_usage: bytes by program, account and interface."""
    return _usage(data, NETWORK, {"bytes_sent": "BytesSent", "bytes_recvd": "BytesRecvd", "iface_luid": "InterfaceLuid", "l2_profile_id": "L2ProfileId"})


def srum_programs(data: bytes, path: str) -> Iterator[dict]:
    """srum_app_usage: cycles, switches and bytes by program and account."""
    return _usage(data, PROGRAMS, {"fg_cycles": "ForegroundCycleTime", "bg_cycles": "BackgroundCycleTime", "fg_context_switches": "ForegroundContextSwitches", "bg_context_switches": "BackgroundContextSwitches", "fg_bytes_read": "ForegroundBytesRead", "fg_bytes_written": "ForegroundBytesWritten"})


# ---- background transfers

# States of a transfer job.
STATES = ("Queued", "Connecting", "Transferring", "Suspended", "Error", "TransientError", "Transferred", "Acknowledged", "Cancelled")


def _texts(raw: bytes, at: int, count: int) -> tuple[list[str], int]:
    """So many texts, each after its number of characters."""
    out = []
    for _ in range(count):
        n = struct.unpack_from("<I", raw, at)[0]
        if at + 4 + 2 * n > len(raw):
            raise ValueError("text beyond the end")
        out.append(raw[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace").rstrip("\0"))
        at += 4 + 2 * n
    return out, at


def _jobs(db: Database) -> Iterator[tuple[str, bytes, dict]]:
    jobs = db.table("Jobs", "BITS_JOB", "BITSJob", "Job")
    for r in db.rows(jobs) if jobs else ():
        raw = r.get("Blob") or b""
        ident = str(r.get("Id") or "")
        row: dict = {"job_guid": ident}
        try:
            row["job_type"], row["priority"], state = struct.unpack_from("<iii", raw, 16)
            row["state"] = state
            row["state_name"] = STATES[state] if 0 <= state < len(STATES) else f"State({state})"
            (row["job_name"], _, _, _, row["owner"]), at = _texts(raw, 48, 5)
        except (struct.error, ValueError):
            yield ident, raw, row
            continue
        times = [t for p in range(at, min(len(raw) - 7, at + 4096)) if (t := from_filetime(struct.unpack_from("<q", raw, p)[0])) and 2000 <= t.year < 2100]
        for name, t in zip(("created_at", "modified_at", "completed_at"), times):
            row[name] = t
        yield ident, raw, row


def bits_jobs(data: bytes, path: str) -> Iterator[dict]:
    """bits_jobs: every job of a transfer queue."""
    for _, _, row in _jobs(Database(data)):
        yield row


def bits_files(data: bytes, path: str) -> Iterator[dict]:
    """bits_files: every file of the queue with the job that names it, and how much of it has come."""
    db = Database(data)
    jobs = [(ident, raw) for ident, raw, _ in _jobs(db)]
    files = db.table("Files", "BITS_FILE", "BITSFile", "File")
    for r in db.rows(files) if files else ():
        raw, ident = r.get("Blob") or b"", str(r.get("Id") or "")
        own = uuid.UUID(ident).bytes_le if ident else b"\xff" * 16
        row: dict = {"file_guid": ident, "job_guid": next((j for j, blob in jobs if own in blob), None)}
        try:
            (row["local_path"], row["remote_url"], _), at = _texts(raw, 0, 3)
            got, total = struct.unpack_from("<QQ", raw, at)
            row["bytes_xferred"], row["bytes_total"] = (None if x == (1 << 64) - 1 else x for x in (got, total))
        except (struct.error, ValueError):
            pass
        total, got = row.get("bytes_total"), row.get("bytes_xferred")
        row["pct_complete"] = got * 100.0 / total if total and got is not None else 0.0
        yield row


# ---- directory accounts


def ntds_accounts(data: bytes, path: str) -> Iterator[dict]:
    """ntds_accounts: accounts of a directory, of equal names the first."""
    db = Database(data)
    table = db.table("datatable")
    seen: set[str] = set()
    for r in db.rows(table) if table else ():
        name = r.get("ATTm590045")
        if not name or name.lower() in seen:
            continue
        seen.add(name.lower())
        sid = r.get("ATTr589970") or b""
        flags = r.get("ATTj589832") or 0
        yield {
            "sam_account_name": name, "display_name": r.get("ATTm131085"), "description": r.get("ATTm13"), "object_sid": sid_text(sid[:-4] + sid[:-5:-1]) if len(sid) >= 12 else None, "last_logon": from_filetime(r.get("ATTq589876") or 0), "pwd_last_set": from_filetime(r.get("ATTq589920") or 0), "bad_pwd_count": r.get("ATTj589836"), "account_flags": flags,
            "is_disabled": bool(flags & 0x2), "is_deleted": bool(r.get("ATTi131120")), "pwd_never_expires": bool(flags & 0x10000), "no_pwd_required": bool(flags & 0x20),
        }
