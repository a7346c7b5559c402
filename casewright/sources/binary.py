"""Readers of binary artifacts: one Python decoder per format, run over files in Arrow batches.

A decoder takes the bytes and the path of a file and yields rows. What is wrong
inside a file ends that file's rows and nothing else; ``source_files`` tells
which files failed and why. A file is decoded in one task: these formats can't
be split, and their sizes are those of single artifacts.
"""

from __future__ import annotations

import codecs
import datetime as dt
import hashlib
import sqlite3
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import TABLES
from .packed import unmam

EPOCH = dt.datetime(1970, 1, 1)


def from_filetime(v: int) -> dt.datetime | None:
    """100 ns since 1601; null for 0, the time before 1970 and far futures."""
    us = v // 10 - 11_644_473_600_000_000
    return EPOCH + dt.timedelta(microseconds=us) if 0 < us < 4_102_444_800_000_000 * 2 else None


def utf16(raw: bytes) -> str:
    return raw.decode("utf-16-le", "replace").split("\0", 1)[0]


# ---- NTFS

# Reasons of change journal records.
USN_REASONS = {
    0x1: "DATA_OVERWRITE", 0x2: "DATA_EXTEND", 0x4: "DATA_TRUNCATION", 0x10: "NAMED_DATA_OVERWRITE", 0x20: "NAMED_DATA_EXTEND", 0x40: "NAMED_DATA_TRUNCATION", 0x100: "FILE_CREATE", 0x200: "FILE_DELETE", 0x400: "EA_CHANGE", 0x800: "SECURITY_CHANGE", 0x1000: "RENAME_OLD_NAME", 0x2000: "RENAME_NEW_NAME", 0x4000: "INDEXABLE_CHANGE", 0x8000: "BASIC_INFO_CHANGE", 0x10000: "HARD_LINK_CHANGE", 0x20000: "COMPRESSION_CHANGE", 0x40000: "ENCRYPTION_CHANGE", 0x80000: "OBJECT_ID_CHANGE", 0x100000: "REPARSE_POINT_CHANGE", 0x200000: "STREAM_CHANGE", 0x80000000: "CLOSE",
}


def usnjrnl(data: bytes, path: str) -> Iterator[dict]:
    """Version 2 records; zeroed stretches and damaged records are skipped in steps of eight bytes."""
    at, end = 0, len(data)
    while at + 60 <= end:
        size, major, _ = struct.unpack_from("<IHH", data, at)
        if not (60 <= size <= 0x1000 and major == 2 and size % 8 == 0 and at + size <= end):
            if data[at : at + 4096] == b"\0" * 4096:
                at += 4096
            else:
                at += 8
            continue
        usn, ft, reason, source, _, attrs, nlen, noff = struct.unpack_from("<qqIIIIHH", data, at + 24)
        name = data[at + noff : at + noff + nlen].decode("utf-16-le", "replace")
        yield {"usn": usn, "path": name, "reason": "|".join(n for b, n in USN_REASONS.items() if reason & b), "timestamp": from_filetime(ft), "file_attributes": attrs & 0x7FFFFFFF, "source_info": str(source)}
        at += size


def file_record(raw: bytes, number: int | None = None) -> dict | None:
    """One record of a file table: its number, the record it extends (0: none), name, parent, times, size and streams; None for what is no record.

    number: its place in the table, where that is known; newer tables write it
    into the record too.
    """
    rec, size = bytearray(raw), len(raw)
    if rec[:4] != b"FILE" or size < 48:
        return None
    fix, count = struct.unpack_from("<HH", rec, 4)
    for i in range(1, count):
        if i * 512 <= size and fix + 2 * i + 2 <= size:
            rec[i * 512 - 2 : i * 512] = rec[fix + 2 * i : fix + 2 * i + 2]
    first, flags = struct.unpack_from("<HH", rec, 20)
    base = struct.unpack_from("<Q", rec, 32)[0] & 0xFFFFFFFFFFFF
    own = struct.unpack_from("<I", rec, 44)[0] if number is None else number
    at, name, parent, space, times, length, streams = first, None, None, 9, None, None, []
    while at + 16 <= size:
        kind, alen = struct.unpack_from("<II", rec, at)
        if kind == 0xFFFFFFFF or alen < 16 or at + alen > size:
            break
        resident, nlen, noff = rec[at + 8] == 0, rec[at + 9], struct.unpack_from("<H", rec, at + 10)[0]
        if resident:
            clen, coff = struct.unpack_from("<IH", rec, at + 16)
            body = bytes(rec[at + coff : at + coff + clen])
        if kind == 0x10 and resident and len(body) >= 32:
            times = struct.unpack_from("<4q", body)
        elif kind == 0x30 and resident and len(body) >= 66:
            ns = body[65]
            if name is None or (space == 2 and ns != 2):
                name, space = body[66 : 66 + 2 * body[64]].decode("utf-16-le", "replace"), ns
                parent = struct.unpack_from("<Q", body)[0] & 0xFFFFFFFFFFFF
        elif kind == 0x80 and (resident or struct.unpack_from("<q", rec, at + 16)[0] == 0):  # later parts of a split stream say no size
            n_bytes = clen if resident else struct.unpack_from("<q", rec, at + 48)[0]
            if nlen:
                streams.append(bytes(rec[at + noff : at + noff + 2 * nlen]).decode("utf-16-le", "replace"))
            else:
                length = n_bytes
        at += alen
    c, m, x, a = (from_filetime(t) for t in times) if times else (None,) * 4
    return {"inode": own, "base": base, "name": name, "short": space == 2, "parent": parent, "size": length, "created": c, "modified": m, "mft_modified": x, "accessed": a, "flags": flags, "streams": streams}


def mft(data: bytes, path: str) -> Iterator[dict]:
    """File records of a master file table read as a whole, with paths from their parents; records that extend another add to it. Larger tables: ``filetable.file_table``."""
    recs: dict[int, dict] = {}
    more: list[dict] = []
    for n in range(len(data) // 1024):
        r = file_record(data[n * 1024 : (n + 1) * 1024], n)
        if r is None:
            continue
        if r["base"]:
            more.append(r)
        else:
            recs[n] = r
    for r in more:
        own = recs.get(r["base"])
        if own is not None:
            if r["name"] is not None and (own["name"] is None or own["short"] and not r["short"]):
                own |= {k: r[k] for k in ("name", "short", "parent")}
            own["size"] = r["size"] if own["size"] is None else own["size"]
            own["streams"] = own["streams"] + r["streams"]
    named = {n: r for n, r in recs.items() if r["name"] is not None}

    def full(n: int) -> str:
        parts, seen = [], set()
        while n in named and n != 5 and n not in seen:
            seen.add(n)
            parts.append(named[n]["name"])
            n = named[n]["parent"]
        return "/".join(reversed(parts))

    for n, r in named.items():
        yield {**r, "path": full(n), "is_dir": bool(r["flags"] & 2), "is_deleted": not r["flags"] & 1, "ads_name": ",".join(sorted(r["streams"])) or None}


# ---- Windows shell and loader


def recycle_bin(data: bytes, path: str) -> Iterator[dict]:
    version, size, ft = struct.unpack_from("<qqq", data)
    raw = data[28:] if version == 2 else data[24 : 24 + 520]
    base = path.replace("\\", "/").rsplit("/", 1)[-1]
    sid = next((p for p in path.replace("\\", "/").split("/") if p.upper().startswith("S-1-")), None)
    yield {"original_path": utf16(raw), "deleted_at": from_filetime(ft), "size": size, "sid": sid, "i_file": base, "r_file": "$R" + base[2:]}


def prefetch(data: bytes, path: str) -> Iterator[dict]:
    """Traces of versions 17 to 31, compressed or not."""
    data = unmam(data)
    version, magic = struct.unpack_from("<I4s", data)
    if magic != b"SCCA":
        raise ValueError("no prefetch file")
    name = utf16(data[16:76])
    strings, slen = struct.unpack_from("<II", data, 100)
    vols, nvol = struct.unpack_from("<II", data, 108)
    if version == 17:
        times, runs = struct.unpack_from("<q", data, 120), struct.unpack_from("<I", data, 144)[0]
    elif version == 23:
        times, runs = struct.unpack_from("<q", data, 128), struct.unpack_from("<I", data, 152)[0]
    else:
        times, runs = struct.unpack_from("<8q", data, 128), struct.unpack_from("<I", data, 208)[0] or struct.unpack_from("<I", data, 200)[0]
    refs = [s for s in data[strings : strings + slen].decode("utf-16-le", "replace").split("\0") if s]
    volumes = []
    for i in range(nvol):
        off, n = struct.unpack_from("<II", data, vols + i * (40 if version == 17 else 104 if version < 30 else 96))
        volumes.append(data[vols + off : vols + off + 2 * n].decode("utf-16-le", "replace"))
    whole = next((r for r in refs if r.upper().endswith("\\" + name.upper())), None)
    yield {"filename": name, "path": whole, "run_count": runs, "last_run": max((t for t in map(from_filetime, times) if t), default=None), "first_seen": None, "volume_paths": "\n".join(volumes), "sha256": hashlib.sha256(data).hexdigest(), "file_refs": "\n".join(refs)}


def lnk(data: bytes, path: str) -> Iterator[dict]:
    """Shell links: target, times, volume, arguments, machine."""
    if data[:4] != b"L\0\0\0":
        raise ValueError("no shell link")
    flags, _, c, a, m = struct.unpack_from("<IIqqq", data, 20)
    at, target, serial, label = 76, None, None, None
    if flags & 1:
        at += 2 + struct.unpack_from("<H", data, at)[0]
    if flags & 2:
        n, head, lf, vol, base, _, suffix = struct.unpack_from("<7I", data, at)
        z = lambda off: data[at + off : data.index(b"\0", at + off)].decode("cp1252", "replace")
        if lf & 1:
            serial = f"{struct.unpack_from('<I', data, at + vol + 8)[0]:08X}"
            label = z(vol + struct.unpack_from("<I", data, at + vol + 12)[0]) or None
            target = z(base) + z(suffix)
        at += n
    texts = {}
    for bit, key in ((4, "name"), (8, "relative"), (16, "dir"), (32, "args"), (64, "icon")):
        if flags & bit:
            n = struct.unpack_from("<H", data, at)[0]
            wide = flags & 0x80
            raw = data[at + 2 : at + 2 + n * (2 if wide else 1)]
            texts[key] = raw.decode("utf-16-le" if wide else "cp1252", "replace")
            at += 2 + len(raw)
    machine = None
    while at + 8 <= len(data):
        n, sig = struct.unpack_from("<II", data, at)
        if n < 8:
            break
        if sig == 0xA0000003:
            machine = data[at + 16 : at + 32].split(b"\0")[0].decode("ascii", "replace")
        at += n
    yield {"path": path, "target_path": target or texts.get("relative"), "created": from_filetime(c), "modified": from_filetime(m), "accessed": from_filetime(a), "machine_id": machine, "drive_serial": serial, "volume_label": label, "args": texts.get("args") or None, "working_dir": texts.get("dir") or None}


# ---- registry


def hive_values(data: bytes, path: str) -> Iterator[dict]:
    """Every value of a registry hive as registry_raw: key path, name, type, data, last write of the key."""
    if data[:4] != b"regf":
        raise ValueError("no registry hive")
    base = 4096
    root = struct.unpack_from("<I", data, 36)[0]
    kinds = {0: "REG_NONE", 1: "REG_SZ", 2: "REG_EXPAND_SZ", 3: "REG_BINARY", 4: "REG_DWORD", 7: "REG_MULTI_SZ", 11: "REG_QWORD"}

    def cell(off: int) -> bytes:
        at = base + off
        n = abs(struct.unpack_from("<i", data, at)[0])
        return data[at + 4 : at + n]

    def content(n: int, off: int, raw: bytes) -> bytes:
        if n & 0x80000000:
            return raw[: n & 0x7FFFFFFF]
        body = cell(off)
        if body[:2] == b"db" and n > 16344:
            count, lst = struct.unpack_from("<HI", body, 2)
            refs = struct.unpack_from(f"<{count}I", cell(lst))
            body = b"".join(cell(r)[:16344] for r in refs)
        return body[:n]

    def shown(kind: int, raw: bytes) -> str:
        if kind in (1, 2):
            return utf16(raw)
        if kind == 7:
            return "\n".join(x for x in raw.decode("utf-16-le", "replace").split("\0") if x)
        if kind == 4 and len(raw) >= 4:
            return str(struct.unpack("<I", raw[:4])[0])
        if kind == 11 and len(raw) >= 8:
            return str(struct.unpack("<Q", raw[:8])[0])
        return raw.hex()

    def children(off: int) -> Iterator[int]:
        body = cell(off)
        sig, n = body[:2], struct.unpack_from("<H", body, 2)[0]
        if sig in (b"lf", b"lh"):
            yield from (struct.unpack_from("<I", body, 4 + 8 * i)[0] for i in range(n))
        elif sig == b"li":
            yield from struct.unpack_from(f"<{n}I", body, 4)
        elif sig == b"ri":
            for i in range(n):
                yield from children(struct.unpack_from("<I", body, 4 + 4 * i)[0])

    name = path.replace("\\", "/").rsplit("/", 1)[-1].upper()
    todo, seen = [(root, "")], set()
    while todo:
        off, key = todo.pop()
        if off in seen or off == 0xFFFFFFFF:
            continue
        seen.add(off)
        nk = cell(off)
        if nk[:2] != b"nk":
            continue
        flags, ft = struct.unpack_from("<Hq", nk, 2)
        n_sub, _, subs = struct.unpack_from("<III", nk, 20)
        n_val, vals = struct.unpack_from("<II", nk, 36)
        n_name = struct.unpack_from("<H", nk, 72)[0]
        raw = nk[76 : 76 + n_name]
        own = raw.decode("cp1252" if flags & 0x20 else "utf-16-le", "replace")
        here = (f"{key}\\{own}" if key else own) if off != root else ""
        if n_val and vals != 0xFFFFFFFF:
            for v in struct.unpack_from(f"<{n_val}I", cell(vals)):
                vk = cell(v)
                if vk[:2] != b"vk":
                    continue
                n, dlen = struct.unpack_from("<HI", vk, 2)
                doff, kind, vflags = struct.unpack_from("<IIH", vk, 8)
                vname = vk[20 : 20 + n].decode("cp1252" if vflags & 1 else "utf-16-le", "replace")
                yield {"hive": name, "key_path": here, "value_name": vname, "value_type": kinds.get(kind, str(kind)), "value_data": shown(kind, content(dlen, doff, vk[8:12])), "modified": from_filetime(ft)}
        if n_sub and subs != 0xFFFFFFFF:
            todo += [(c, here) for c in children(subs)]


# ---- Linux, browsers, mail


def wtmp(data: bytes, path: str) -> Iterator[dict]:
    """Records of login files in order: kind, user, terminal, host, time."""
    for i in range(len(data) // 384):
        rec = data[i * 384 : (i + 1) * 384]
        kind, pid = struct.unpack_from("<hxxi", rec)
        text = lambda a, n: rec[a : a + n].split(b"\0")[0].decode("utf-8", "replace")  # noqa: E731,B023
        sec, usec = struct.unpack_from("<ii", rec, 340)
        yield {"source": path, "pos": i, "kind": kind, "pid": pid, "terminal": text(8, 32), "user": text(44, 32), "src_ip": text(76, 256), "at": EPOCH + dt.timedelta(seconds=sec, microseconds=usec)}


def browser(data: bytes, path: str) -> Iterator[dict]:
    """Visits of Chromium and Firefox databases."""
    low = path.replace("\\", "/").lower()
    name = next((n for k, n in (("edge", "Edge"), ("brave", "Brave"), ("opera", "Opera"), ("firefox", "Firefox"), ("chrome", "Chrome")) if k in low), "Chrome")
    profile = path.replace("\\", "/").rsplit("/", 2)[-2] if "/" in path.replace("\\", "/") else ""
    con = sqlite3.connect(":memory:")
    try:
        # a database in write-ahead mode is read as it was last written back
        con.deserialize(data[:18] + b"\x01\x01" + data[20:] if data[18:20] == b"\x02\x02" else data)
        if low.endswith("places.sqlite"):
            rows = con.execute("SELECT p.url, p.title, v.visit_date, p.visit_count FROM moz_historyvisits v JOIN moz_places p ON p.id = v.place_id")
            shift = 0
        else:
            rows = con.execute("SELECT u.url, u.title, v.visit_time, u.visit_count FROM visits v JOIN urls u ON u.id = v.url")
            shift = 11_644_473_600_000_000
        for url, title, at, n in rows:
            us = (at or 0) - shift
            yield {"browser": name, "url": url, "title": title, "visit_time": EPOCH + dt.timedelta(microseconds=us) if us > 0 else None, "visit_count": n, "profile": profile}
    finally:
        con.close()


def _mail(raw: bytes, path: str) -> dict:
    import email
    from email import policy
    from email.utils import getaddresses, parseaddr, parsedate_to_datetime

    m = email.message_from_bytes(raw, policy=policy.default)

    def head(name: str) -> str | None:
        try:
            return str(m[name]) if m[name] is not None else None
        except Exception:
            return None

    def when(name: str) -> dt.datetime | None:
        try:
            t = parsedate_to_datetime(head(name))
            return t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t
        except Exception:
            return None

    text, html, files = [], [], 0
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment" or part.get_filename():
            files += 1
        elif part.get_content_type() in ("text/plain", "text/html"):
            try:
                body = part.get_content()
            except Exception:
                body = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
            (text if part.get_content_type() == "text/plain" else html).append(body)
    name, addr = parseaddr(head("From") or "")
    many = lambda h: ", ".join(a for _, a in getaddresses([head(h) or ""]) if a) or None
    ident = int.from_bytes(hashlib.sha256(raw).digest()[:8], "big") >> 1
    return {"id": ident, "source_file": path, "folder": path.replace("\\", "/").rsplit("/", 2)[-2] if path.count("/") > 1 else "", "message_id": (head("Message-ID") or "").strip("<> ") or None, "from_addr": addr or None, "from_name": name or None, "to_addrs": many("To"), "cc_addrs": many("Cc"), "bcc_addrs": many("Bcc"), "subject": head("Subject"), "sent_at": when("Date"), "received_at": None, "body_text": "\n".join(text) or None, "body_html": "\n".join(html) or None, "has_attachments": files > 0, "x_mailer": head("X-Mailer"), "x_originating_ip": (head("X-Originating-IP") or "").strip("[] ") or None, "reply_to": head("Reply-To"), "in_reply_to": (head("In-Reply-To") or "").strip("<> ") or None, "headers_raw": raw.split(b"\r\n\r\n", 1)[0].split(b"\n\n", 1)[0].decode("utf-8", "replace")}


def eml(data: bytes, path: str) -> Iterator[dict]:
    yield _mail(data, path)


def mbox(data: bytes, path: str) -> Iterator[dict]:
    """Mails parted by 'From ' lines; quoted ones lose their mark."""
    import re

    for raw in re.split(rb"(?m)^From [^\n]*\n", data)[1:]:
        yield _mail(re.sub(rb"(?m)^>(>*From )", rb"\1", raw), path)


WTMP_DDL = "source string, pos int, kind int, pid int, terminal string, user string, src_ip string, at timestamp"
DECODERS: dict[str, tuple[Callable[[bytes, str], Iterator[dict]], str]] = {
    "usnjrnl": (usnjrnl, TABLES["usnjrnl"]), "mft": (mft, TABLES["mft"]), "recycle_bin": (recycle_bin, TABLES["recycle_bin"]), "prefetch": (prefetch, TABLES["prefetch"]), "lnk": (lnk, TABLES["lnk_files"]),
    "hive": (hive_values, TABLES["registry_raw"]), "amcache": (hive_values, TABLES["registry_raw"]), "wtmp": (wtmp, WTMP_DDL), "browser": (browser, TABLES["browser_history"]), "eml": (eml, TABLES["emails"]), "mbox": (mbox, TABLES["emails"]),
}


def _later() -> dict[str, tuple[Callable[[bytes, str], Iterator[dict]], str]]:
    """Decoders of the modules that build on this one."""
    from . import ese as E
    from . import shellitems as S

    return {"srum_network": (E.srum_network, TABLES["srum_network_usage"]), "srum_programs": (E.srum_programs, TABLES["srum_app_usage"]), "bits_jobs": (E.bits_jobs, TABLES["bits_jobs"]), "bits_files": (E.bits_files, TABLES["bits_files"]), "ntds": (E.ntds_accounts, TABLES["ntds_accounts"]), "shimcache": (S.shimcache, TABLES["shimcache"]), "shellbags": (S.shellbags, TABLES["shellbags"]), "jumplists": (S.jumplists, TABLES["jumplists"]), "msg": (S.msg, TABLES["emails"])}


def decoders() -> dict[str, tuple[Callable[[bytes, str], Iterator[dict]], str]]:
    """Every reader of whole files by name: function and columns."""
    return {**DECODERS, **_later()}


def decode(files: DataFrame, reader: str, keep_going: bool = True) -> DataFrame:
    """Rows of all files that ask for a reader (frame of ``router.files``, or any with path and content).

    keep_going: a damaged file gives the rows before the damage; else it fails.
    """
    fn, ddl = decoders()[reader]
    names = [c.split(" ")[0] for c in ddl.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows: list[tuple] = []
                try:
                    for r in fn(bytes(content), path):
                        rows.append(tuple(r.get(n) for n in names))
                        if len(rows) >= 20_000:  # pieces of a large file, not a limit
                            yield _frame(rows, names, ddl)
                            rows = []
                except Exception:
                    if not keep_going:
                        raise
                if rows:
                    yield _frame(rows, names, ddl)

    wanted = files.filter(F.array_contains("readers", reader)) if "readers" in files.columns else files
    return wanted.select("path", "content").mapInPandas(work, ", ".join(f"`{c.split(' ')[0]}` {c.split(' ')[1]}" for c in ddl.split(", ")))


def _frame(rows: list[tuple], names: list[str], ddl: str) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=names)
    for c in ddl.split(", "):
        n, kind = c.split(" ")
        if kind in ("int", "bigint"):
            df[n] = df[n].astype("Int64")
        elif kind == "timestamp":
            df[n] = pd.to_datetime(df[n], errors="coerce")
        elif kind == "boolean":
            df[n] = df[n].astype("boolean")
    return df


def source_files(files: DataFrame) -> DataFrame:
    """path, type, sha256, size, error of every file with a decoder: error is null where all of it could be read."""

    known = decoders()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content, size, asked in zip(b["path"], b["content"], b["length"], b["readers"]):
                for reader in asked:
                    error = None
                    if reader in known:
                        try:
                            for _ in known[reader][0](bytes(content), path):
                                pass
                        except Exception as e:
                            error = f"{type(e).__name__}: {e}"
                    out.append((path, reader, hashlib.sha256(bytes(content)).hexdigest(), size, error))
            yield pd.DataFrame(out, columns=["path", "type", "sha256", "size", "error"])

    return files.select("path", "content", "length", "readers").mapInPandas(work, "path string, type string, sha256 string, size bigint, error string")


def linux_sessions(records: DataFrame) -> DataFrame:
    """linux_sessions of login records: a login and the next logout of its terminal; open ones have no logout.

    A login on a terminal that is still taken ends the one before without a
    logout. Reboots are sessions of user 'SYSTEM' without logout.
    """
    order = W.partitionBy("source", "terminal").orderBy("at", "pos")
    seq = records.filter(F.col("kind").isin(7, 8)).withColumn("_k", F.lead("kind").over(order)).withColumn("_t", F.lead("at").over(order))
    logins = seq.filter("kind = 7").select("user", "terminal", F.col("at").alias("login_time"), F.when(F.col("_k") == 8, F.col("_t")).alias("logout_time"), "src_ip", "source")
    boots = records.filter("kind = 2").select(F.lit("SYSTEM").alias("user"), "terminal", F.col("at").alias("login_time"), F.lit(None).cast("timestamp").alias("logout_time"), "src_ip", "source")
    return logins.unionByName(boots)


# ---- tables folded from registry values


def rot13(c: F.Column) -> F.Column:
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return F.translate(c, plain, codecs.encode(plain, "rot13"))


def run_keys(raw: DataFrame) -> DataFrame:
    """persistence: values of Run and RunOnce keys."""
    return raw.filter(F.lower("key_path").rlike(r"currentversion\\run(?:once)?$")).select(F.lit("run_key").alias("type"), F.col("value_name").alias("name"), F.col("value_data").alias("command"), F.lit(None).cast("string").alias("path"), "key_path", F.lit(True).alias("enabled"), F.lit(None).cast("string").alias("sid"), "modified")


def services(raw: DataFrame) -> DataFrame:
    """services of the control sets: one row per service, its values folded."""
    own = raw.withColumn("name", F.regexp_extract("key_path", r"(?i)ControlSet\d{3}\\Services\\([^\\]+)$", 1)).filter("name <> ''")
    pick = lambda v: F.max(F.when(F.col("value_name") == v, F.col("value_data")))
    start = {"0": "Boot", "1": "System", "2": "Auto", "3": "Manual", "4": "Disabled"}
    agg = own.groupBy("name").agg(pick("DisplayName").alias("display_name"), pick("Start").alias("_s"), pick("ImagePath").alias("binary_path"), pick("ObjectName").alias("object_name"), F.max("modified").alias("modified"))
    named = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])[F.col("_s")]
    return agg.select("name", "display_name", F.coalesce(named, F.col("_s")).alias("start_type"), "binary_path", "object_name", "modified")


def user_assist(raw: DataFrame) -> DataFrame:
    """userassist: names by ROT13, counts and times from the little-endian data."""
    v = raw.filter(F.lower("key_path").rlike(r"userassist\\\{[^}]*\}\\count$") & (F.length("value_data") >= 136))

    def le(at: int, n: int) -> F.Column:
        return F.conv(F.concat(*[F.substring("value_data", 1 + 2 * (at + i), 2) for i in range(n - 1, -1, -1)]), 16, 10).try_cast("bigint")

    from ..functions.text import filetime

    return v.select(rot13(F.col("value_name")).alias("path"), le(4, 4).cast("int").alias("run_count"), filetime(le(60, 8)).alias("last_run"), le(8, 4).cast("int").alias("focus_count"), le(12, 4).cast("int").alias("focus_duration"))


def bam(raw: DataFrame) -> DataFrame:
    """bam_dam: last runs by account."""
    from ..functions.text import filetime

    v = raw.withColumn("sid", F.regexp_extract("key_path", r"(?i)Services\\(?:bam|dam)\\.*\\(S-1-[\d-]+)$", 1)).filter("sid <> '' AND value_type = 'REG_BINARY' AND length(value_data) >= 16")
    ft = F.conv(F.concat(*[F.substring("value_data", 1 + 2 * i, 2) for i in range(7, -1, -1)]), 16, 10).try_cast("bigint")
    return v.select(F.col("value_name").alias("path"), filetime(ft).alias("last_run"), "sid", F.when(F.lower("key_path").contains("\\bam\\"), "bam").otherwise("dam").alias("source"))
