"""The findings contract: what every detector, rule and scan returns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined, low, recent, severity_rank
from ..schema import Case

FINDING = "type string, value string, source string, confidence string, related_campaign string, first_seen timestamp, notes string"
COLUMNS = [c.split(" ")[0] for c in FINDING.split(", ")]


@dataclass(frozen=True)
class Detector:
    """build gives value and first_seen, and may give confidence, type and what the note is made of; requires: tables that must have rows.

    note: the evidence, a text or a column over the rows built from; of counted
    groups a column of their size and two lists of distinct values.
    """

    ident: str
    severity: str
    kind: str
    technique: str | None
    build: Callable[[Case], DataFrame]
    requires: tuple[str, ...] = ()
    note: str | Callable[..., Column] = ""

    def parts(self) -> tuple:
        """What can share a scan with other detectors: one or more declarations over single tables."""
        return (self.build,) if isinstance(self.build, (Rows, Counted)) else self.build if isinstance(self.build, tuple) else ()

    def noted(self, *parts: Column, note: str | Callable[..., Column] | None = None) -> Column:
        """The note as a column."""
        note = self.note if note is None else note
        return F.lit(note).cast("string") if isinstance(note, str) else note(*parts).cast("string")

    def run(self, case: Case) -> DataFrame:
        if parts := self.parts():
            return union(case, [fused(case, part.table, [(self, part)]) for part in parts])
        df = self.build(case)
        given = set(df.columns)
        pick = {
            "type": F.col("type") if "type" in given else F.lit(self.kind),
            "value": F.col("value").cast("string"),
            "source": F.lit(f"detect:{self.ident}"),
            "confidence": F.col("confidence") if "confidence" in given else F.lit(self.severity),
            "related_campaign": F.col("related_campaign") if "related_campaign" in given else F.lit(self.technique).cast("string"),
            "first_seen": F.col("first_seen").cast("timestamp"),
            "notes": F.col("notes") if "notes" in given else self.noted(),
        }
        return df.select(*[c.alias(n) for n, c in pick.items()])


@dataclass(frozen=True)
class Rows:
    """Filter and project one table; many of them over a table are run in one scan (``fused``). kind, technique and note stand for the detector's own where given."""

    table: str
    where: Callable[[], Column] | None
    value: Callable[[], Column]
    seen: str | None = None
    distinct: bool = True
    kind: str | None = None
    technique: str | None = None
    note: str | Callable[..., Column] | None = None

    def first_seen(self) -> Column:
        return (F.col(self.seen) if self.seen else F.lit(None)).cast("timestamp")

    def test(self) -> Column:
        return self.where() if self.where is not None else F.lit(True)


@dataclass(frozen=True)
class Counted:
    """Filter, group, keep groups of at least so many rows; the value is made of what the keys are made of. Many over a table share scan and shuffle (``fused``)."""

    table: str
    where: Callable[[], Column]
    keys: tuple
    value: Callable[[], Column]
    at_least: int
    seen: str | None = "timestamp"
    lists: tuple[Callable[[], Column], ...] = ()  # up to two columns whose distinct values the note names

    def key_columns(self) -> list[Column]:
        return [F.col(k) if isinstance(k, str) else k() for k in self.keys]


def rows(table: str, where: Callable[[], Column] | None, value: Callable[[], Column], seen: str | None = None, distinct: bool = True, **own) -> Rows:
    return Rows(table, where, value, seen, distinct, **own)


def counted(table: str, where: Callable[[], Column], keys: Sequence[str | Callable[[], Column]], value: Callable[[], Column], at_least: int, seen: str | None = "timestamp", lists: Sequence[Callable[[], Column]] = ()) -> Counted:
    return Counted(table, where, tuple(keys), value, at_least, seen, tuple(lists))


def fused(case: Case, table: str, items: Sequence[tuple[Detector, Rows | Counted]]) -> DataFrame:
    """All detectors that filter and project, or count, rows of one table: one scan, one aggregation.

    A row that passes several tests gives a hit for each. Hits are grouped by
    all they show (rows that are reported each by itself also by a number of
    their own), or by the keys that are counted.
    """
    null = F.lit(None).cast("string")
    parts, labels, least, notes = [], [], [], []
    for i, (d, part) in enumerate(items):
        if isinstance(part, Rows):
            test, keys, lists = part.test(), F.array().cast("array<string>"), []
            seen, shown = part.first_seen(), part.first_seen()
            note, number = d.noted(note=part.note), F.lit(None).cast("bigint") if part.distinct else F.col("_number")
            notes.append(F.col("_note"))
            least.append(1)
        else:
            test, keys, lists = part.where(), F.array(*[k.cast("string") for k in part.key_columns()]), [make().cast("string") for make in part.lists]
            seen, shown = (F.col(part.seen) if part.seen else F.lit(None)).cast("timestamp"), F.lit(None).cast("timestamp")
            note, number = null, F.lit(None).cast("bigint")
            notes.append(d.noted(F.col("_n").cast("string"), F.col("_a"), F.col("_b")))
            least.append(part.at_least)
        both = [(lists[j] if j < len(lists) else null).alias(n) for j, n in enumerate("ab")]
        hit = F.struct(F.lit(i).alias("_i"), keys.alias("_k"), part.value().cast("string").alias("value"), seen.alias("seen"), shown.alias("shown"), note.alias("_note"), number.alias("_own"), *both)
        parts.append(F.when(F.coalesce(test, F.lit(False)), hit))
        kind, technique = getattr(part, "kind", None) or d.kind, getattr(part, "technique", None) or d.technique
        labels += [F.lit(i), F.struct(F.lit(kind).alias("type"), F.lit(f"detect:{d.ident}").alias("source"), F.lit(d.severity).alias("confidence"), F.lit(technique).cast("string").alias("related_campaign"), F.lit(least[-1]).alias("least"))]
    source = case[table]
    if any(isinstance(p, Rows) and not p.distinct for _, p in items):
        source = source.withColumn("_number", F.monotonically_increasing_id())
    hits = source.select(F.explode(F.filter(F.array(*parts), lambda h: h.isNotNull())).alias("_h")).select("_h.*")
    agg = hits.groupBy("_i", "_k", "value", "shown", "_note", "_own").agg(F.count(F.lit(1)).alias("_n"), F.min("seen").alias("first_seen"), F.array_sort(F.collect_set("a")).alias("_a"), F.array_sort(F.collect_set("b")).alias("_b"))
    named = agg.withColumn("_l", F.create_map(*labels)[F.col("_i")]).filter(F.col("_n") >= F.col("_l.least"))
    return named.select("_l.type", "value", "_l.source", "_l.confidence", "_l.related_campaign", "first_seen", F.element_at(F.array(*notes), F.col("_i") + 1).alias("notes"))


def empty(case: Case) -> DataFrame:
    return case.spark.createDataFrame([], FINDING)


def union(case: Case, frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else empty(case)


def replace_family(known: DataFrame, family: str, found: DataFrame) -> DataFrame:
    """Findings with the family's old rows (source prefix) replaced by new ones."""
    return known.filter(~F.coalesce(F.col("source").startswith(f"{family}:"), F.lit(False))).select(*COLUMNS).unionByName(found.select(*COLUMNS))


def multi_source(findings: DataFrame) -> DataFrame:
    """Values that more than one source reports: value, n_sources, sources, worst."""
    once = findings.filter("value IS NOT NULL").select(low("value").alias("value"), "source", "confidence").distinct()
    agg = once.groupBy("value").agg(F.countDistinct("source").alias("n_sources"), joined("source", " + ").alias("sources"), F.max_by("confidence", severity_rank("confidence")).alias("worst"))
    return agg.filter("n_sources > 1")


__all__ = ["COLUMNS", "FINDING", "Counted", "Detector", "Rows", "counted", "empty", "fused", "multi_source", "recent", "replace_family", "rows", "union"]
