"""Windows event logs (.evtx): records of binary XML to evtx_events.

A log is a row of chunks of 64 KiB that hold their own strings and templates,
so a file is cut into chunks on the JVM and the chunks are spread over all
cores; only the decoding of a chunk's binary XML is Python, in Arrow batches.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary import _frame, from_filetime
from .router import channel_of

HEADER, CHUNK = 4096, 65536
EVENT = "event_id int, channel string, timestamp timestamp, computer string, user_sid string, provider string, message string, xml_raw string, record_id bigint"


@dataclass
class Element:
    """An element of a record: attributes in order, children are texts, values to be filled in (ints) or elements."""

    name: str
    attributes: list[tuple[str, list]] = field(default_factory=list)
    children: list = field(default_factory=list)


def sid_text(raw: bytes) -> str:
    """S-1-... of a binary security identifier."""
    parts = struct.unpack_from(f"<{raw[1]}I", raw, 8)
    return "-".join(["S", str(raw[0]), str(int.from_bytes(raw[2:8], "big")), *map(str, parts)])


_NUMBERS = {3: "b", 4: "B", 5: "h", 6: "H", 7: "i", 8: "I", 9: "q", 10: "Q", 11: "f", 12: "d"}


class Chunk:
    """Decoder of one chunk; names and templates are found by their place in it."""

    def __init__(self, data: bytes):
        self.data = data
        self.names: dict[int, tuple[str, int]] = {}
        self.templates: dict[int, list] = {}

    def name(self, at: int) -> tuple[str, int]:
        """(name, size of its record) at a place of the chunk."""
        if at not in self.names:
            n = struct.unpack_from("<H", self.data, at + 6)[0]
            self.names[at] = self.data[at + 8 : at + 8 + 2 * n].decode("utf-16-le", "replace"), 10 + 2 * n
        return self.names[at]

    def _named(self, at: int) -> tuple[str, int]:
        """Name referred to at ``at`` and the place after the reference (and the name, where it stands right there)."""
        where = struct.unpack_from("<I", self.data, at)[0]
        text, size = self.name(where)
        return text, at + 4 + (size if where == at + 4 else 0)

    def value(self, kind: int, raw: bytes):
        """A typed value as text, or as elements for binary XML."""
        if kind & 0x80:
            return self._array(kind & 0x7F, raw)
        if kind == 0 or not raw and kind not in (1, 2):
            return ""
        if kind == 1:
            return raw.decode("utf-16-le", "replace").rstrip("\0")
        if kind == 2:
            return raw.decode("cp1252", "replace").rstrip("\0")
        if kind in _NUMBERS:
            return str(struct.unpack_from("<" + _NUMBERS[kind], raw)[0])
        if kind == 13:
            return "true" if any(raw[:4]) else "false"
        if kind == 14:
            return raw.hex().upper()
        if kind == 15:
            return "{" + str(uuid.UUID(bytes_le=raw[:16])).upper() + "}"
        if kind == 16:
            return f"0x{int.from_bytes(raw, 'little'):x}"
        if kind == 17:
            t = from_filetime(struct.unpack_from("<q", raw)[0])
            return t.isoformat(sep=" ") if t else ""
        if kind == 18:
            y, mo, _, d, h, mi, s, ms = struct.unpack_from("<8H", raw)
            return f"{y:04}-{mo:02}-{d:02} {h:02}:{mi:02}:{s:02}.{ms:03}"
        if kind == 19:
            return sid_text(raw)
        if kind in (20, 21):
            return f"0x{int.from_bytes(raw[: 4 if kind == 20 else 8], 'little'):x}"
        return raw.hex().upper()

    def _array(self, kind: int, raw: bytes) -> str:
        if kind in (1, 2):
            text = raw.decode("utf-16-le" if kind == 1 else "cp1252", "replace")
            return ", ".join(x for x in text.split("\0") if x)
        width = {3: 1, 4: 1, 5: 2, 6: 2, 7: 4, 8: 4, 9: 8, 10: 8, 11: 4, 12: 8, 13: 4, 15: 16, 17: 8, 18: 16, 20: 4, 21: 8}.get(kind)
        return raw.hex().upper() if not width else ", ".join(self.value(kind, raw[i : i + width]) for i in range(0, len(raw) - width + 1, width))

    def nodes(self, at: int, end: int) -> tuple[list, int]:
        """Nodes from ``at`` up to the end of the fragment or element; values to be filled in stand as (index, optional)."""
        data, out = self.data, []
        open_elements: list[Element] = []
        attribute: list | None = None

        def put(x) -> None:
            if attribute is not None:
                attribute.append(x)
            else:
                (open_elements[-1].children if open_elements else out).append(x)

        while at < end:
            token = data[at] & 0x0F
            if token == 0:
                return out, at + 1
            if token == 1:
                name, after = self._named(at + 7)
                if data[at] & 0x40:
                    after += 4
                e = Element(name)
                attribute = None
                put(e)
                open_elements.append(e)
                at = after
            elif token == 2:
                attribute = None
                at += 1
            elif token in (3, 4):
                attribute = None
                open_elements.pop()
                at += 1
                if not open_elements and token == 4 and at >= end:
                    return out, at
            elif token == 5:
                kind = data[at + 1]
                if kind != 1:
                    raise ValueError("value of an unknown type in the text")
                n = struct.unpack_from("<H", data, at + 2)[0]
                put(data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"))
                at += 4 + 2 * n
            elif token == 6:
                name, at = self._named(at + 1)
                attribute = []
                open_elements[-1].attributes.append((name, attribute))
            elif token == 7 or token == 11:
                n = struct.unpack_from("<H", data, at + 1)[0]
                put(data[at + 3 : at + 3 + 2 * n].decode("utf-16-le", "replace"))
                at += 3 + 2 * n
            elif token == 8:
                put(chr(struct.unpack_from("<H", data, at + 1)[0]))
                at += 3
            elif token == 9:
                name, at = self._named(at + 1)
                put({"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.get(name, f"&{name};"))
            elif token == 10:
                _, at = self._named(at + 1)
            elif token == 12:
                made, at = self.instance(at)
                for x in made:
                    put(x)
            elif token in (13, 14):
                put((struct.unpack_from("<H", data, at + 1)[0], token == 14))
                at += 4
            elif token == 15:
                at += 4
            else:
                raise ValueError(f"unknown token {data[at]:#x}")
        return out, at

    def instance(self, at: int) -> tuple[list, int]:
        """A template with its values filled in."""
        data = self.data
        where = struct.unpack_from("<I", data, at + 6)[0]
        after = at + 10
        if where not in self.templates:
            size = struct.unpack_from("<I", data, where + 20)[0]
            self.templates[where] = self.nodes(where + 24, where + 24 + size)[0]
        if where == after:
            after += 24 + struct.unpack_from("<I", data, where + 20)[0]
        count = struct.unpack_from("<I", data, after)[0]
        kinds = [struct.unpack_from("<HB", data, after + 4 + 4 * i) for i in range(count)]
        pos = after + 4 + 4 * count
        values = []
        for size, kind in kinds:
            values.append(self.nodes(pos, pos + size)[0] if kind == 0x21 else self.value(kind, data[pos : pos + size]) if kind else None)
            pos += size
        return self._filled(self.templates[where], values), pos

    def _filled(self, nodes: list, values: list) -> list:
        out = []
        for n in nodes:
            if isinstance(n, tuple):
                v = values[n[0]] if n[0] < len(values) else None
                if isinstance(v, list):
                    out += v
                elif v is not None:
                    out.append(v)
            elif isinstance(n, Element):
                attributes = [(k, self._filled(v, values)) for k, v in n.attributes]
                out.append(Element(n.name, [(k, v) for k, v in attributes if v], self._filled(n.children, values)))
            else:
                out.append(n)
        return out

    def records(self) -> Iterator[tuple[int, int, Element]]:
        """(number, time of writing, event) of each record; what can't be read ends at the next record."""
        data = self.data
        end = min(len(data), struct.unpack_from("<I", data, 48)[0]) if data[:8] == b"ElfChnk\0" else 0
        at = 512
        while at + 28 <= end and data[at : at + 4] == b"**\0\0":
            size, number, written = struct.unpack_from("<IQq", data, at + 4)
            if size < 28 or at + size > len(data):
                return
            try:
                nodes, _ = self.nodes(at + 24, at + size - 4)
                event = next((n for n in nodes if isinstance(n, Element)), None)
            except (struct.error, IndexError, ValueError):
                event = None
            if event is not None:
                yield number, written, event
            at += size


def _text(e: Element | None) -> str:
    return "" if e is None else "".join(x if isinstance(x, str) else _text(x) for x in e.children)


def _child(e: Element | None, name: str) -> Element | None:
    return None if e is None else next((x for x in e.children if isinstance(x, Element) and x.name == name), None)


def _attribute(e: Element | None, name: str) -> str | None:
    return None if e is None else next(("".join(x for x in v if isinstance(x, str)) for k, v in e.attributes if k == name), None)


def xml(e: Element) -> str:
    """The event as XML text."""
    attributes = "".join(f" {k}={quoteattr(''.join(x for x in v if isinstance(x, str)))}" for k, v in e.attributes)
    inside = "".join(escape(x) if isinstance(x, str) else xml(x) for x in e.children)
    return f"<{e.name}{attributes}>{inside}</{e.name}>" if inside else f"<{e.name}{attributes}/>"


def _data(e: Element) -> dict:
    """Event data by name: named Data elements by their name, others by their element's name; what repeats becomes a list."""
    out: dict = {}
    for x in e.children:
        if isinstance(x, Element):
            key = _attribute(x, "Name") or x.name
            value = _data(x) if any(isinstance(y, Element) for y in x.children) else _text(x)
            out[key] = value if key not in out else [*(out[key] if isinstance(out[key], list) else [out[key]]), value]
    return out


def event_row(number: int, written: int, event: Element) -> dict:
    """A record's row of evtx_events (channel as the record names it)."""
    system = _child(event, "System")
    ident = _text(_child(system, "EventID")).strip()
    stamp = _attribute(_child(system, "TimeCreated"), "SystemTime")
    at = pd.to_datetime(stamp, errors="coerce") if stamp else None
    data = _child(event, "EventData")
    own = _data(data) if data is not None else None
    if own is None and (user := _child(event, "UserData")) is not None:
        own = _data(user)
    return {
        "event_id": int(ident) if ident.isdigit() else None,
        "channel": _text(_child(system, "Channel")) or None,
        "timestamp": from_filetime(written) if at is None or pd.isna(at) else at.tz_localize(None) if at.tzinfo is None else at.tz_convert("UTC").tz_localize(None),
        "computer": _text(_child(system, "Computer")) or None,
        "user_sid": _attribute(_child(system, "Security"), "UserID") or None,
        "provider": _attribute(_child(system, "Provider"), "Name"),
        "message": None if own is None else json.dumps(own, ensure_ascii=False),
        "xml_raw": xml(event),
        "record_id": int(n) if (n := _text(_child(system, "EventRecordID"))).isdigit() else number,
    }


def chunk_rows(data: bytes) -> Iterator[dict]:
    """Rows of one chunk; b'' and damaged chunks give none."""
    if len(data) >= 512:
        for record in Chunk(data).records():
            yield event_row(*record)


def evtx_events(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """evtx_events of event-log files (``router.files``, or any frame of path and content).

    channel is the record's own, or taken from the file's name where it has
    none. Damaged chunks and records are left out, the others stay; files that
    are no event logs give no rows. A file's chunks are decoded independently.
    """
    names = [c.split(" ")[0] for c in EVENT.split(", ")]
    logs = files.filter(F.array_contains("readers", "evtx")) if "readers" in files.columns else files
    starts = F.sequence(F.lit(HEADER), F.length("content") - 1, F.lit(CHUNK))
    cut = logs.filter((F.length("content") > HEADER) & (F.substring("content", 1, 7) == F.lit(b"ElfFile"))).select(channel_of(F.col("path")).alias("_channel"), F.explode(starts).alias("_at"), "content")
    chunks = cut.select("_channel", F.expr(f"substring(content, _at + 1, {CHUNK})").alias("_chunk"))
    from ..common import worker_partitions

    spread = chunks.repartition(partitions or worker_partitions(files.sparkSession))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for channel, data in zip(b["_channel"], b["_chunk"]):
                rows = [{**r, "channel": r["channel"] or channel} for r in chunk_rows(bytes(data))]
                if rows:
                    yield _frame([tuple(r[n] for n in names) for r in rows], names, EVENT)

    return spread.mapInPandas(work, EVENT)
