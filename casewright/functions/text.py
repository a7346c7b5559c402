"""Column expressions the detectors, searches and scanners share (all JVM-side)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of severities.
SEVERITY_RANK = {"HIGH": 3, "MED": 2, "MEDIUM": 2, "LOW": 1}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def low(c: str | Column) -> Column:
    return F.lower(col(c))


def has(c: str | Column, *pieces: str) -> Column:
    """Any of the pieces lies in the lower-cased text (literally: no LIKE wildcards)."""
    return any_of([low(c).contains(p) for p in pieces])


def ends(c: str | Column, *pieces: str) -> Column:
    return any_of([low(c).endswith(p) for p in pieces])


def starts(c: str | Column, *pieces: str) -> Column:
    return any_of([low(c).startswith(p) for p in pieces])


def ordered(c: str | Column, *patterns: str) -> Column:
    """Any pattern, whose pieces (parted by …) follow each other in the lower-cased text."""
    return any_of([low(c).rlike("(?s)" + ".*".join(re.escape(x) for x in p.split("…"))) for p in patterns])


def slashed(c: str | Column) -> Column:
    """Lower-cased path with forward slashes, so that one spelling of a folder fits both."""
    return F.translate(low(c), "\\", "/")


def within(c: str | Column, *folders: str) -> Column:
    """The path holds one of the folders (given with forward slashes); paths without root count from the root."""
    return any_of([F.concat(F.lit("/"), slashed(c)).contains(f) for f in folders])


def basename(c: str | Column) -> Column:
    """Last component of a path of either kind, lower-cased."""
    return F.regexp_extract(low(c), r"[^/\\]*$", 0)


def is_base(c: str | Column, *names: str) -> Column:
    return basename(c).isin([n if "." in n else n + ".exe" for n in names])


def recent(c: str | Column) -> Column:
    """Not before 2000: collectors write year 1 for no time."""
    return col(c) >= F.lit("2000-01-01 00:00:00").cast("timestamp")


def is_private_ip(c: str | Column) -> Column:
    """Loopback, link-local, unspecified and RFC 1918 addresses as text."""
    return col(c).rlike(r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|::1$|fe80:|f[cd][0-9a-fA-F]{2}:)")


def severity_rank(c: str | Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(col(c) == name, rank).otherwise(out)
    return out


def joined(c: str | Column, sep: str = ",") -> Column:
    """Aggregate: distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(col(c))), sep)


def filetime(c: str | Column) -> Column:
    """100 ns since 1601 to timestamp; null for 0 and before the epoch."""
    v = col(c).try_cast("bigint")
    return F.when(v >= 116_444_736_000_000_000, F.timestamp_micros(F.floor((v.cast("decimal(20,0)") - 116_444_736_000_000_000) / 10).cast("bigint")))


def hex_to_int(c: str | Column) -> Column:
    """'0x1f' or '1f' to bigint; plain decimals stay."""
    s = F.trim(col(c))
    digits = F.regexp_extract(s, r"^0[xX]([0-9a-fA-F]{1,15})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).try_cast("bigint")).otherwise(s.try_cast("bigint"))


def bit_names(c: str | Column, names: dict[int, str], sep: str = "|") -> Column:
    """Names of the set bits, joined in order of the bits."""
    v = col(c).cast("bigint")
    return F.concat_ws(sep, *[F.when(v.bitwiseAND(F.lit(bit).cast("bigint")) != 0, F.lit(name)) for bit, name in sorted(names.items())])
