"""Text stamps of mixed layout, precision and zone to one UTC instant.

An ordered cascade of anchored patterns picks the first layout that fits a
stamp and rewrites it to one canonical field string (year|month|day|hour|...);
the fields are then checked strictly, once, for all layouts. Zones come from
the stamp, or from the source's lookup row (zone and order of numeric dates).
Everything is a JVM column expression in one pass over the rows; the only joins
are with the lookup and with a list of zone abbreviations as long as the time
zone database.

Policy for local times: one that occurs twice means the earlier instant, one
that is skipped is read with the offset in force before the change.
"""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import FIRST_REAL_US, micros

# English month names as stamps abbreviate them.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
_HALF = r"(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?: ?(Z|[A-Z]{2,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?))?"
_MON = r"([A-Za-z]{3})[a-z]*\.?"
_DAYNAME = r"(?:[A-Za-z]{2,9}\.?,? +)?"

#: (layout, anchored pattern, its groups as year|month|day|hour|minute|second|fraction|zone|half|order).
#: order: '' for a settled date, 's' for a slashed one whose order the source decides, 'y' for one without year.
LAYOUTS = (
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]|, ?| +){_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8||"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,12}))?(Z|[+-]\d{2}:?\d{2})$", "$1|$2|$3|$4|$5|$6|$7|$8||"),
    ("compact_local", r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,12}))?$", "$1|$2|$3|$4|$5|$6|$7|||"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? +{_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8||"),
    ("day_month_name", rf"^{_DAYNAME}(\d{{1,2}})[- /]{_MON}[- /](\d{{4}})(?:[ :]|, ?){_TIME}{_HALF}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$9|$8|"),
    ("year_first_slashed", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}),? +{_TIME}{_HALF}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$9|$8|"),
    ("slashed", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),? +{_TIME}{_HALF}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$9|$8|s"),
    ("date_command", rf"^[A-Za-z]{{3}} {_MON} +(\d{{1,2}}) {_TIME}{_HALF}{_ZONE} (\d{{4}})$", "$9|$1|$2|$3|$4|$5|$6|$8|$7|"),
    ("month_name_first", rf"^{_MON} +(\d{{1,2}}),? (\d{{4}}),? +{_TIME}{_HALF}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$9|$8|"),
    ("no_year", rf"^{_MON} +(\d{{1,2}}) {_TIME}$", "|$1|$2|$3|$4|$5|$6|||y"),
)

#: Names of the columns in between: a table's own columns of these names are set aside.
_OWN = frozenset("_s _f _z _host _zone _order _own _y _m _mon _d _clock _oh _om _off _limit _us n f".split())

_NUMBER = r"^(?:[^0-9A-Za-z+-]*)(\d{9,19})(?:[.,](\d{1,12}))?(?::\d+)?(?:[^0-9A-Za-z]*)$"
_HEX = r"^[^0-9A-Za-z]*0[xX]([0-9A-Fa-f]{15,16})[^0-9A-Za-z]*$"

#: Plain numbers: the least and the first too large value of each unit (years 2000 to 2100; the ranges are disjoint), SQL for microseconds since 1970.
UNITS = (
    (946_684_800, 4_102_444_800, "n * 1000000 + f"),
    (946_684_800_000, 4_102_444_800_000, "n * 1000 + f div 1000"),
    (946_684_800_000_000, 4_102_444_800_000_000, "n"),
    (946_684_800_000_000_000, 4_102_444_800_000_000_000, "n div 1000"),
    (12_591_158_400_000_000, 15_746_918_400_000_000, "n - 11644473600000000"),  # microseconds since 1601
    (125_911_584_000_000_000, 157_469_184_000_000_000, "n div 10 - 11644473600000000"),  # 100 ns since 1601
    (630_822_816_000_000_000, 662_380_416_000_000_000, "n div 10 - 62135596800000000"),  # 100 ns since year 1
)


@lru_cache(maxsize=1)
def _abbreviations() -> tuple[tuple[str, str, int], ...]:
    rows = set()
    for name in sorted(available_timezones()):
        z = ZoneInfo(name)
        for year in (2001, 2008, 2015, 2020, 2025):
            for month in (1, 4, 7, 10):
                at = datetime(year, month, 15, 12, tzinfo=z)
                rows.add((name, at.tzname(), int(at.utcoffset().total_seconds()) * 1_000_000))
    # A name that meant several offsets there: the latest entry of the sorted list wins, so that a stamp has one meaning.
    lean = {(n, a): o for n, a, o in sorted(rows)}
    return tuple((n, a, o) for (n, a), o in lean.items())


def zone_abbreviations(spark: SparkSession) -> DataFrame:
    """(zone_name, abbreviation, offset_us) of every zone's standard and summer time, from the time zone database."""
    return spark.createDataFrame(_abbreviations(), "zone_name string, abbreviation string, offset_us bigint")


def _int(c: Column) -> Column:
    return F.when(c != "", c).otherwise(None).try_cast("int")


def normalize_stamps(
    df: DataFrame,
    stamp: str,
    source: str,
    lookup: DataFrame,
    not_after: str | None = None,
    result: str = "utc_us",
) -> DataFrame:
    """``df`` with the bigint column ``result``: microseconds since 1970 UTC, null where the stamp means no instant.

    stamp: text; source: the column that ``lookup`` knows as ``host``;
    lookup: host, zone_name, date_order ('dmy', 'mdy', 'ymd'); not_after: a
    time, by which a stamp without year gets the latest year that does not put
    it later (without that column such stamps mean nothing).

    No instant: null, empty, zero, impossible and pre-2000 stamps, local stamps
    of an unknown or null source, zone names that are not the source's own.
    Digits beyond microseconds are cut off. All rows and columns of ``df`` are
    kept, in any number and of any name; an existing column ``result`` is refused. A source
    listed more than once in the lookup has the row of its least zone_name.
    """
    if result in df.columns:
        raise ValueError(f"column {result} exists")
    if clash := {c: f"_kept{i}_{c}" for i, c in enumerate(df.columns) if c in _OWN}:
        names = [clash.get(c, c) if c else c for c in (stamp, source, not_after)]
        out = normalize_stamps(df.withColumnsRenamed(clash), names[0], names[1], lookup, names[2], result)
        return out.withColumnsRenamed({v: k for k, v in clash.items()})
    spark = df.sparkSession
    zones = zone_abbreviations(spark).groupBy("zone_name").agg(F.map_from_entries(F.collect_list(F.struct("abbreviation", "offset_us"))).alias("_own"))
    listed = lookup.filter(F.col("host").isNotNull()).groupBy("host").agg(F.min_by("date_order", "zone_name").alias("_order"), F.min("zone_name").alias("zone_name"))
    hosts = listed.join(zones, "zone_name").select(F.col("host").alias("_host"), F.col("zone_name").alias("_zone"), "_order", "_own")

    x = df.withColumn("_s", F.regexp_replace(F.trim(df[stamp]), r"^[\s\[(\"'<]+|[\s\])\"'>]+$", ""))
    s = F.col("_s")
    fields = F.lit(None).cast("string")
    for _, pattern, canon in reversed(LAYOUTS):
        fields = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, canon)).otherwise(fields)
    x = x.withColumn("_f", F.split(fields, r"\|"))
    part = [F.col("_f")[i] for i in range(10)]
    x = x.withColumn("_z", F.upper(part[7]))
    x = x.withColumn("_z", F.when(F.col("_z").isin("Z", "UTC", "GMT", "UT"), F.lit("+0000")).otherwise(F.regexp_replace("_z", "^(?:UTC|GMT)(?=[+-])|:", "")))
    x = x.join(hosts, F.col(source) == F.col("_host"), "left")

    # the date's parts in their order
    slashed = part[9] == "s"
    a, c = part[0], part[2]
    x = x.withColumn("_order", F.when(~(slashed & (F.length(c) == 4) & (F.col("_order") == "ymd")), F.col("_order")))
    order = F.col("_order")
    year = F.when(slashed, F.when(order == "ymd", a).when(order.isNotNull(), c)).otherwise(part[0])
    month = F.when(slashed & (order == "mdy"), a).otherwise(part[1])
    day = F.when(slashed, F.when(order == "dmy", a).when(order == "mdy", part[1]).when(order == "ymd", c)).otherwise(part[2])
    name_number = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS) for v in (m, i + 1)])
    x = x.withColumn("_y", _int(year)).withColumn("_mon", month).withColumn("_d", _int(day))
    x = x.withColumn("_y", F.when(F.length(year) == 2, F.col("_y") + 2000).otherwise(F.col("_y")))
    x = x.withColumn("_m", F.coalesce(_int(F.when(F.col("_mon").rlike("^[0-9]+$"), F.col("_mon"))), name_number[F.lower("_mon")]))
    h, half = _int(part[3]), F.lower(part[8])
    hour = F.when(half == "", F.when(h <= 23, h)).when((h >= 1) & (h <= 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    minute, second = _int(part[4]), F.coalesce(_int(part[5]), F.lit(0))
    fraction = F.rpad(F.substring(F.coalesce(part[6], F.lit("")), 1, 6), 6, "0").try_cast("bigint")
    clock = F.when((minute <= 59) & (second <= 59), ((hour * 60 + minute) * 60 + second).cast("bigint") * 1_000_000 + fraction)
    x = x.withColumn("_clock", clock)
    digits = F.regexp_extract("_z", r"^[+-](\d{2})(\d{2})?$", 1), F.regexp_extract("_z", r"^[+-](\d{2})(\d{2})?$", 2)
    x = x.withColumn("_oh", _int(digits[0])).withColumn("_om", F.coalesce(_int(digits[1]), F.lit(0)))
    east = F.col("_oh") * 60 + F.col("_om")
    offset = F.when((east <= 18 * 60) & (F.col("_om") < 60), east.cast("bigint") * 60_000_000 * F.when(F.col("_z").startswith("-"), -1).otherwise(1))
    x = x.withColumn("_off", F.coalesce(offset, F.col("_own")[F.col("_z")]))

    def instant(y: Column) -> Column:
        first = F.make_date(F.greatest(F.lit(1), F.least(F.lit(9999), y)), F.greatest(F.lit(1), F.least(F.lit(12), F.col("_m"))), F.lit(1))
        fits = (y >= 1) & (y <= 9999) & F.col("_m").between(1, 12) & (F.col("_d") >= 1) & (F.col("_d") <= F.day(F.last_day(first)))
        local = F.when(fits, (F.unix_date(first) + F.col("_d") - 1).cast("bigint") * 86_400_000_000 + F.col("_clock"))
        by_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.col("_zone")))
        return F.when(F.col("_z") == "", by_zone).otherwise(local - F.col("_off"))

    dated = instant(F.col("_y"))
    if not_after is not None:
        limit = micros(df, not_after)
        x = x.withColumn("_limit", limit)
        last = F.year(F.timestamp_micros(F.col("_limit") + 86_400_000_000))
        tried = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda back: instant(last - back))
        undated = F.array_max(F.filter(tried, lambda u: u <= F.col("_limit")))
        dated = F.when(part[9] == "y", F.when(F.col("_limit").isNotNull(), undated)).otherwise(dated)
    n = F.regexp_extract("_s", _NUMBER, 1).try_cast("bigint")
    f = F.rpad(F.substring(F.regexp_extract("_s", _NUMBER, 2), 1, 6), 6, "0").try_cast("bigint")
    x = x.withColumn("n", F.coalesce(F.when(F.col("_s").rlike(_HEX), F.conv(F.regexp_extract("_s", _HEX, 1), 16, 10).try_cast("bigint")), n)).withColumn("f", f)
    number = F.lit(None).cast("bigint")
    for least, beyond, sql in reversed(UNITS):
        number = F.when((F.col("n") >= least) & (F.col("n") < beyond), F.expr(sql)).otherwise(number)
    us = F.when(F.col("_f").isNotNull(), dated).otherwise(number)
    x = x.withColumn("_us", us)
    # Through a generator of one row: a filter on the result is then not copied, with all it is made of, below the steps above.
    return x.select(*[df[c] for c in df.columns], F.explode(F.array(F.when(F.col("_us") >= FIRST_REAL_US, F.col("_us")))).alias(result))
