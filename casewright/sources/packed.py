"""Compressed containers: Xpress Huffman streams (compressed prefetch files), LZNT1, and ZIP archives of collected files."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .router import readers


def _decoding_table(lengths: list[int]) -> tuple[list[int], list[int]]:
    """Symbol and code length for each of the 32,768 next 15 bits, codes in canonical order."""
    symbols, sizes = [0] * 32768, [0] * 32768
    at = 0
    for size in range(1, 16):
        for symbol, n in enumerate(lengths):
            if n == size:
                span = 1 << (15 - size)
                if at + span > 32768:
                    raise ValueError("oversubscribed code")
                symbols[at : at + span] = [symbol] * span
                sizes[at : at + span] = [size] * span
                at += span
    if at != 32768:
        raise ValueError("incomplete code")
    return symbols, sizes


def xpress_huffman(data: bytes, size: int) -> bytes:
    """The plain text of an LZ77 stream with Huffman codes, ``size`` bytes long, in blocks of 64 KiB that each bring their own code."""
    out = bytearray()
    at = 0
    while len(out) < size:
        if at + 260 > len(data):
            raise ValueError("stream ends early")
        symbols, sizes = _decoding_table([n for b in data[at : at + 256] for n in (b & 15, b >> 4)])
        at += 256
        bits = struct.unpack_from("<H", data, at)[0] << 16 | struct.unpack_from("<H", data, at + 2)[0]
        at += 4
        left = 16  # bits at hand beyond the upper sixteen
        block_end = min(size, len(out) + 65536)
        while len(out) < block_end:
            top = bits >> 17 & 0x7FFF
            symbol, n = symbols[top], sizes[top]
            bits = bits << n & 0xFFFFFFFF
            left -= n
            if left < 0:
                bits |= int.from_bytes(data[at : at + 2], "little") << -left
                at += 2
                left += 16
            if symbol < 256:
                out.append(symbol)
                continue
            length, width = symbol & 15, symbol - 256 >> 4
            if length == 15:
                length = data[at]
                at += 1
                if length == 255:
                    length = struct.unpack_from("<H", data, at)[0]
                    at += 2
                    if length == 0:
                        length = struct.unpack_from("<I", data, at)[0]
                        at += 4
                    length -= 15
                length += 15
            length += 3
            back = (bits >> (32 - width) if width else 0) | 1 << width
            bits = bits << width & 0xFFFFFFFF
            left -= width
            if left < 0:
                bits |= int.from_bytes(data[at : at + 2], "little") << -left
                at += 2
                left += 16
            if back > len(out):
                raise ValueError("match before the beginning")
            for _ in range(length):
                out.append(out[-back])
    return bytes(out[:size])


def unmam(data: bytes) -> bytes:
    """A prefetch file without its compression; others as they are."""
    if data[:3] != b"MAM":
        return data
    # the fourth byte's high bit tells of a checksum after the size
    size = struct.unpack_from("<I", data, 4)[0]
    return xpress_huffman(data[12 if data[3] & 0x80 else 8 :], size)


def lznt1(data: bytes) -> bytes:
    """The plain text of chunks of 4 KiB of tagged literals and matches."""
    out = bytearray()
    at = 0
    while at + 2 <= len(data):
        head = struct.unpack_from("<H", data, at)[0]
        if head == 0:
            break
        at += 2
        end = at + (head & 0xFFF) + 1
        if not head & 0x8000:
            out += data[at:end]
            at = end
            continue
        begin = len(out)
        while at < min(end, len(data)):
            tags = data[at]
            at += 1
            for bit in range(8):
                if at >= min(end, len(data)):
                    break
                if not tags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                pair = struct.unpack_from("<H", data, at)[0]
                at += 2
                width = max(4, (len(out) - begin - 1).bit_length())
                length, back = (pair & (1 << 16 - width) - 1) + 3, (pair >> 16 - width) + 1
                if back > len(out):
                    raise ValueError("match before the beginning")
                for _ in range(length):
                    out.append(out[-back])
        at = end
    return bytes(out)


def with_archives(files: DataFrame) -> DataFrame:
    """``router.files`` with the members of ZIP archives besides: path archive!/member, and their readers.

    Members are put out one by one; archives inside archives are opened too.
    Damaged archives and encrypted members are left out. The archives themselves stay.
    """

    def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError):
            return
        for info in archive.infolist():
            if info.is_dir() or info.flag_bits & 1:
                continue
            try:
                body = archive.read(info)
            except Exception:  # a damaged member
                continue
            path = f"{name}!/{info.filename}"
            yield path, body
            if info.filename.lower().endswith(".zip"):
                yield from members(path, body)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content, when in zip(b["path"], b["content"], b["modificationTime"]):
                for name, body in members(path, bytes(content)):
                    yield pd.DataFrame({"path": [name], "length": [len(body)], "modificationTime": [when], "content": [body]})

    archives = files.filter(F.lower("path").endswith(".zip")).select("path", "content", "modificationTime")
    inside = archives.mapInPandas(work, "path string, length bigint, modificationTime timestamp, content binary")
    return files.unionByName(inside.withColumn("readers", readers(F.col("path"))).select(files.columns))
