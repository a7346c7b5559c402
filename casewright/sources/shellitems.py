"""Windows shell artifacts: application compatibility cache, shell bags, jump lists, Outlook messages; compound files under them."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

from .binary import from_filetime, hive_values, lnk, utf16
from .router import user_in

# ---- application compatibility cache


def _cache_records(blob: bytes) -> Iterator[tuple[str, object]]:
    """(path, last modified) of each record of an AppCompatCache value, newest first as stored."""
    mark = struct.unpack_from("<I", blob)[0]
    if mark in (0xBADC0FFE, 0xBADC0FEE):  # a table with texts behind it; 64 bit records have padding before the place of the text
        count = struct.unpack_from("<I", blob, 4)[0]
        head, narrow, wide = (8, 24, 32) if mark == 0xBADC0FFE else (128, 32, 48)
        padded = bool(count) and struct.unpack_from("<I", blob, head + 4)[0] == 0
        for i in range(count):
            if padded:
                n, _, _, place, ft = struct.unpack_from("<HHIQq", blob, head + wide * i)
            else:
                n, _, place, ft = struct.unpack_from("<HHIq", blob, head + narrow * i)
            yield blob[place : place + n].decode("utf-16-le", "replace"), from_filetime(ft)
        return
    if mark == 0xDEADBEEF:  # a table of 528 byte records with the place of their text
        count = struct.unpack_from("<I", blob, 4)[0]
        for i in range(count):
            at = 16 + 528 * i
            if at + 16 > len(blob):
                return
            n, _, place, ft = struct.unpack_from("<HHIq", blob, at)
            raw = blob[place : place + n] if 0 < place and place + n <= len(blob) else blob[at + 10 : at + 10 + n]
            yield raw.decode("utf-16-le", "replace"), from_filetime(ft)
        return
    at = mark if blob[mark : mark + 4] in (b"10ts", b"00ts") else blob.find(b"10ts")  # the first number is the head's size
    while 0 <= at and at + 12 <= len(blob) and blob[at : at + 4] in (b"10ts", b"00ts"):
        # after the tag: a checksum and the size of the rest; older builds have the size right away
        size = struct.unpack_from("<I", blob, at + 8)[0]
        n = struct.unpack_from("<H", blob, at + 12)[0] if at + 14 <= len(blob) else 0
        if 0 < size <= len(blob) - at - 12 and n <= size - 2 and (at + 12 + size == len(blob) or blob[at + 12 + size : at + 12 + size + 4] in (b"10ts", b"00ts", b"\0\0\0\0", b"")):
            rest = blob[at + 14 + n : at + 12 + size]
            # Windows 8 keeps packages and flags before the time, Windows 10 the time right after the path
            ft = 0
            if len(rest) >= 8:
                skip = 0
                if mark == 0x80 and len(rest) >= 2:
                    skip = 2 + struct.unpack_from("<H", rest)[0] + 8
                ft = struct.unpack_from("<q", rest, skip)[0] if len(rest) >= skip + 8 else 0
            yield blob[at + 14 : at + 14 + n].decode("utf-16-le", "replace"), from_filetime(ft)
            at += 12 + size
            continue
        size = struct.unpack_from("<I", blob, at + 4)[0]
        if size < 10 or at + 8 + size > len(blob):
            return
        ft, n = struct.unpack_from("<qH", blob, at + 8)
        yield blob[at + 18 : at + 18 + n].decode("utf-16-le", "replace"), from_filetime(ft)
        at += 8 + size


def shimcache(data: bytes, path: str) -> Iterator[dict]:
    """shimcache of a SYSTEM hive: every control set's cache in its order; executed isn't told by newer systems and stays null."""
    seen: set[str] = set()
    for v in hive_values(data, path):
        if v["value_name"].lower() == "appcompatcache" and v["value_type"] == "REG_BINARY" and v["value_data"] not in seen:
            seen.add(v["value_data"])  # control sets are often copies of one another
            for i, (name, at) in enumerate(_cache_records(bytes.fromhex(v["value_data"]))):
                yield {"path": name, "last_modified": at, "executed": None, "order_idx": i}


# ---- shell items and bags

# Well-known folders of virtual items.
FOLDERS = {
    "20d04fe0-3aea-1069-a2d8-08002b30309d": "My Computer", "208d2c60-3aea-1069-a2d7-08002b30309d": "My Network Places", "645ff040-5081-101b-9f08-00aa002f954e": "Recycle Bin", "21ec2020-3aea-1069-a2dd-08002b30309d": "Control Panel", "450d8fba-ad25-11d0-98a8-0800361b1103": "My Documents", "59031a47-3f72-44a7-89c5-5595fe6b30ee": "Users", "031e4825-7b94-4dc3-b131-e946b44c8dd5": "Libraries", "f02c1a0d-be21-4350-88b0-7367fc96ef3c": "Network", "679f85cb-0220-4080-b29b-5540cc05aab6": "Quick access",
}


def _long_name(item: bytes) -> str:
    """The long name in an item's extension block, '' without one."""
    at = item.find(b"\x04\x00\xef\xbe")
    if at < 4:
        return ""
    version = struct.unpack_from("<H", item, at - 2)[0]
    # size, version, mark, two times (4 each) and a place (2) come first; later versions add a file reference and more
    skip = {3: 20, 7: 38, 8: 42, 9: 46}.get(version, 20 if version < 7 else 46)
    return utf16(item[at - 4 + skip :]) if at - 4 + skip < len(item) else ""


def item_name(item: bytes) -> tuple[str, str]:
    """(name, kind) of a shell item: virtual, drive, folder, file, network or unknown."""
    if len(item) < 4:
        return "", "unknown"
    kind = item[2]
    if kind == 0x1F:
        g = item[4:20]
        ident = f"{g[3::-1].hex()}-{g[5:3:-1].hex()}-{g[7:5:-1].hex()}-{g[8:10].hex()}-{g[10:].hex()}" if len(g) == 16 else ""
        return FOLDERS.get(ident, "{" + ident + "}"), "virtual"
    if kind & 0x70 == 0x20:
        return item[3:].split(b"\0")[0].decode("cp1252", "replace"), "drive"
    if kind & 0x70 == 0x30 or kind == 0xB1:
        wide = kind & 4
        short = utf16(item[14:]) if wide else item[14:].split(b"\0")[0].decode("cp1252", "replace")
        return _long_name(item) or short, "folder" if kind & 1 else "file"
    if kind & 0x70 == 0x40:
        return item[5:].split(b"\0")[0].decode("cp1252", "replace"), "network"
    return _long_name(item), "unknown"


def shellbags(data: bytes, path: str) -> Iterator[dict]:
    """shellbags of a user's hive: folders looked at, with their whole path; the time is the folder's own key's, else that of the key that lists it."""
    items: dict[tuple[str, str], tuple[str, str]] = {}
    written: dict[str, object] = {}
    roots = ""
    for v in hive_values(data, path):
        if (m := re.search(r"(?i)\\bagmru(?=\\|$)", "\\" + v["key_path"])) is None:
            continue
        key = ("\\" + v["key_path"])[m.end() :].lstrip("\\")
        written[key] = v["modified"]
        roots = path
        if v["value_name"].isdigit() and v["value_type"] == "REG_BINARY":
            items[key, v["value_name"]] = item_name(bytes.fromhex(v["value_data"]))
    user = user_in(path)
    source = "UsrClass" if "usrclass" in roots.lower() else "NTUSER"
    for (key, number), (name, kind) in items.items():
        if not name:
            continue
        steps = key.split("\\") if key else []
        above = [items.get(("\\".join(steps[:i]), s), ("?", ""))[0] for i, s in enumerate(steps)]
        whole = ""
        for part in [*above, name]:
            whole = part if not whole or part.startswith("\\\\") else whole + ("" if whole.endswith("\\") else "\\") + part
        own = f"{key}\\{number}" if key else number
        yield {"path": whole, "last_modified": written.get(own) or written.get(key), "user": user, "source": source, "item_type": kind}


# ---- compound files


def streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by their path from the root (storages parted by slashes)."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("no compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    size, mini = 1 << shift, 1 << mini_shift
    n_fat, first_dir, _, cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<I I I I I I I I", data, 44)
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    table = list(struct.unpack_from("<109I", data, 76))
    at, seen = first_difat, set()
    while at < 0xFFFFFFFA and at not in seen:
        seen.add(at)
        more = struct.unpack(f"<{size // 4}I", sector(at))
        table += more[:-1]
        at = more[-1]
    fat: list[int] = []
    for n in table:
        if n < 0xFFFFFFFA and len(raw := sector(n)) == size:
            fat += struct.unpack(f"<{size // 4}I", raw)

    def chain(n: int) -> bytes:
        out, done = [], set()
        while n < len(fat) and n not in done:
            done.add(n)
            out.append(sector(n))
            n = fat[n]
        return b"".join(out)

    raw_dir = chain(first_dir)
    entries = []
    for i in range(0, len(raw_dir) - 127, 128):
        n = struct.unpack_from("<H", raw_dir, i + 64)[0]
        left, right, child = struct.unpack_from("<III", raw_dir, i + 68)
        begin, length = struct.unpack_from("<IQ", raw_dir, i + 116)
        entries.append((raw_dir[i : i + max(0, n - 2)].decode("utf-16-le", "replace"), raw_dir[i + 66], left, right, child, begin, length & 0xFFFFFFFF if shift == 9 else length))
    small = chain(entries[0][5]) if entries else b""
    raw_mini = chain(first_mini) if n_mini else b""
    mini_fat = struct.unpack(f"<{len(raw_mini) // 4}I", raw_mini) if raw_mini else ()

    def body(begin: int, length: int) -> bytes:
        if length >= cutoff:
            return chain(begin)[:length]
        out, n, done = [], begin, set()
        while n < len(mini_fat) and n not in done:
            done.add(n)
            out.append(small[n * mini : (n + 1) * mini])
            n = mini_fat[n]
        return b"".join(out)[:length]

    out: dict[str, bytes] = {}
    todo, done = [(entries[0][4], "")] if entries else [], set()
    while todo:
        n, prefix = todo.pop()
        if n >= len(entries) or n in done:
            continue
        done.add(n)
        name, kind, left, right, child, begin, length = entries[n]
        todo += [(left, prefix), (right, prefix)]
        if kind == 2:
            out[prefix + name] = body(begin, length)
        elif kind == 1:
            todo.append((child, f"{prefix}{name}/"))
    return out


# ---- jump lists

# Programs by the number of their jump list.
APPLICATIONS = {
    "1b4dd67f29cb1962": "Explorer", "5da8f9b674986c19": "Microsoft Office Word", "b8ab874f5e7b8f2e": "Microsoft Office Excel", "b08f8b06c67b42bf": "Microsoft Office PowerPoint", "ae12ea2a5be2a2d7": "Notepad", "9b9cdc69c1c24e2b": "Command Prompt", "b7cdf4c72bf6a75f": "Windows PowerShell", "7e4dca80246863e3": "Outlook", "3c9a590b03f18f14": "Internet Explorer", "9d61274eebee32ba": "Mozilla Firefox",
    "9a16f9f5e3aceb60": "Google Chrome", "7c5a40ef0a24a5c1": "Adobe Acrobat Reader", "f01b4d95cf55d32a": "Task Manager", "d65231b0d2a4c5b8": "Regedit", "50e70be46609e0b3": "Paint", "c7efcf1c2f5e3ef3": "WinRAR", "1c6b3b67889524de": "7-Zip", "4fce25e2da3e9869": "PuTTY", "9b2dde1a2aa84a19": "FileZilla", "6e4c2c8a26d98e40": "Total Commander",
}

_LINK = struct.pack("<I", 76) + bytes.fromhex("0114020000000000c000000000000046")


def _dest_list(raw: bytes) -> Iterator[dict]:
    """Entries of a DestList stream: number, path, last use, count, pinned."""
    version, count = struct.unpack_from("<II", raw)
    at = 32
    for _ in range(count):
        if at + 114 > len(raw):
            return
        number = struct.unpack_from("<I", raw, at + 88)[0]
        used, pin = struct.unpack_from("<qi", raw, at + 100)
        if version == 1:
            times, chars, text, tail = struct.unpack_from("<f", raw, at + 96)[0], struct.unpack_from("<H", raw, at + 112)[0], at + 114, 0
        else:
            times, chars, text, tail = struct.unpack_from("<I", raw, at + 116)[0], struct.unpack_from("<H", raw, at + 128)[0], at + 130, 4
        yield {"entry_id": f"{number:x}", "target_path": raw[text : text + 2 * chars].decode("utf-16-le", "replace"), "accessed": from_filetime(used), "access_count": int(times), "pin_status": "pinned" if pin >= 0 else ""}
        at = text + 2 * chars + tail


def jumplists(data: bytes, path: str) -> Iterator[dict]:
    """Jump lists of both kinds: files a program opened, with the times of their links; entries without a path are left out."""
    base = re.split(r"[/\\]", path)[-1].lower()
    app = base.split(".")[0]
    fixed = {"app_id": app, "app_name": APPLICATIONS.get(app, "")}
    if base.endswith(".automaticdestinations-ms"):
        parts = streams(data)
        links = {}
        for name, raw in parts.items():
            if raw[:20] == _LINK:
                try:
                    links[name.lower()] = next(lnk(raw, path))
                except (struct.error, ValueError, IndexError):
                    continue
        listed = {e["entry_id"]: e for e in _dest_list(parts["DestList"])} if len(parts.get("DestList", b"")) >= 32 else {}
        for number in sorted(listed.keys() | links.keys()):
            e, link = listed.get(number, {}), links.get(number, {})
            target = e.get("target_path") or link.get("target_path")
            if target:
                yield {**fixed, "entry_type": "automatic", "target_path": target, "created": link.get("created"), "modified": link.get("modified"), "accessed": e.get("accessed") or link.get("accessed"), "access_count": e.get("access_count", 0), "pin_status": e.get("pin_status", ""), "entry_id": number}
        return
    places = [m.start() for m in re.finditer(re.escape(_LINK), data)]
    for i, (a, z) in enumerate(zip(places, [*places[1:], len(data)])):
        try:
            link = next(lnk(data[a:z], path))
        except (struct.error, ValueError, IndexError):
            continue
        if link["target_path"]:
            yield {**fixed, "entry_type": "custom", "target_path": link["target_path"], "created": link["created"], "modified": link["modified"], "accessed": link["accessed"], "access_count": 0, "pin_status": "", "entry_id": f"entry_{i}"}


# ---- Outlook messages


def msg(data: bytes, path: str) -> Iterator[dict]:
    """One mail of a saved Outlook message: properties of the message itself, recipients by their kind."""
    parts = streams(data)

    def text(prefix: str, tag: str) -> str | None:
        if (raw := parts.get(f"{prefix}__substg1.0_{tag}001F")) is not None:
            return raw.decode("utf-16-le", "replace").rstrip("\0") or None
        if (raw := parts.get(f"{prefix}__substg1.0_{tag}001E")) is not None:
            return raw.decode("cp1252", "replace").rstrip("\0") or None
        return None

    def times(wanted: int):
        raw = parts.get("__properties_version1.0", b"")
        for at in range(32, len(raw) - 15, 16):
            if struct.unpack_from("<I", raw, at)[0] == wanted << 16 | 0x40:
                return from_filetime(struct.unpack_from("<q", raw, at + 8)[0])
        return None

    to: dict[int, list[str]] = {1: [], 2: [], 3: []}
    for prefix in sorted({n.split("/")[0] + "/" for n in parts if n.startswith("__recip_version1.0_")}):
        raw = parts.get(prefix + "__properties_version1.0", b"")
        kind = next((struct.unpack_from("<I", raw, at + 8)[0] for at in range(8, len(raw) - 15, 16) if struct.unpack_from("<I", raw, at)[0] == 0x0C150003), 1)
        if who := text(prefix, "39FE") or text(prefix, "3003"):
            to.setdefault(kind, []).append(who)
    headers = text("", "007D")
    head = lambda name: (m.group(1).strip() if headers and (m := re.search(rf"(?im)^{name}:\s*(.+)$", headers)) else None)
    html = parts.get("__substg1.0_10130102")
    yield {
        "id": int.from_bytes(hashlib.sha256(data).digest()[:8], "big") >> 1, "source_file": path, "folder": re.split(r"[/\\]", path)[-2] if len(re.split(r"[/\\]", path)) > 1 else "", "message_id": (text("", "1035") or "").strip("<> ") or None, "from_addr": text("", "5D01") or text("", "0C1F"), "from_name": text("", "0C1A"), "to_addrs": ", ".join(to[1]) or text("", "0E04"), "cc_addrs": ", ".join(to[2]) or None, "bcc_addrs": ", ".join(to[3]) or None,
        "subject": text("", "0037"), "sent_at": times(0x0039), "received_at": times(0x0E06), "body_text": text("", "1000"), "body_html": html.decode("utf-8", "replace") if html else text("", "1013"), "has_attachments": any(n.startswith("__attach_version1.0_") for n in parts), "x_mailer": head("X-Mailer"), "x_originating_ip": (head("X-Originating-IP") or "").strip("[] ") or None, "reply_to": head("Reply-To"), "in_reply_to": (text("", "1042") or "").strip("<> ") or None, "headers_raw": headers,
    }
