"""String patterns searched in several tables at once.

A rule has literal strings (or /regular expressions/) and asks for any or all of
them. Literals are compared as they are: % and _ have no meaning.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_of, any_of
from ..schema import Case
from .findings import union


@dataclass(frozen=True)
class Target:
    table: str
    text: str
    value: Callable[[], Column]
    seen: str | None


TARGETS = {
    "cmdline": Target("mem_cmdline", "cmdline", lambda: F.concat_ws(" ", "name", "cmdline"), None),
    "scriptblock": Target("ps_scriptblock", "script_text", lambda: F.left(F.col("script_text"), F.lit(300)), "timestamp"),
    "events": Target("evtx_events", "message", lambda: F.concat(F.col("event_id").cast("string"), F.lit(": "), F.left(F.col("message"), F.lit(300))), "timestamp"),
    "paths": Target("mft", "path", lambda: F.col("path"), "modified"),
    "amcache_paths": Target("amcache", "path", lambda: F.col("path"), "first_seen"),
    "browser": Target("browser_history", "url", lambda: F.col("url"), "visit_time"),
    "defender": Target("defender_events", "threat_name", lambda: F.concat_ws(" | ", "threat_name", "path"), "timestamp"),
}


@dataclass(frozen=True)
class PatternRule:
    name: str
    strings: tuple[str, ...]
    condition: str = "any"
    targets: tuple[str, ...] = ()
    severity: str = "MED"
    technique: str | None = None
    ident: str = ""
    description: str = ""


def parse_pattern(d: dict) -> PatternRule:
    """A rule from its document; ValueError says what is missing."""
    if not isinstance(d, dict) or not d.get("name") or not d.get("strings"):
        raise ValueError("a pattern rule needs a name and strings")
    grade = {"critical": "HIGH", "high": "HIGH", "medium": "MED"}.get(str(d.get("severity", "medium")).lower(), "LOW")
    return PatternRule(d["name"], tuple(d["strings"]), d.get("condition") or "any", tuple(d.get("targets") or ()), grade, d.get("technique"), str(d.get("id") or ""), d.get("description") or "")


def load_patterns(folder: str) -> tuple[list[PatternRule], dict[str, str]]:
    """Rules of a folder's JSON files (a rule or a list of them each), and what could not be loaded and why."""
    rules, errors = [], {}
    for name in sorted(os.listdir(folder)):
        if not name.endswith(".json"):
            continue
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                doc = json.load(f)
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {e}"
            continue
        for i, d in enumerate(doc if isinstance(doc, list) else [doc]):
            try:
                rules.append(parse_pattern(d))
            except Exception as e:
                errors[f"{name}#{i}" if isinstance(doc, list) else name] = f"{type(e).__name__}: {e}"
    return rules, errors


def bundled_patterns() -> list[PatternRule]:
    """The pattern rules that come with the library."""
    with open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "rules", "patterns.json"), encoding="utf-8") as f:
        return [parse_pattern(d) for d in json.load(f)]


def matches(text: Column, strings: Sequence[str], condition: str = "any", regex: bool = True) -> Column:
    """Whether the text holds any or all of the strings."""
    tests = [text.rlike(s[1:-1]) if regex and len(s) > 2 and s[0] == s[-1] == "/" else text.contains(s) for s in strings]
    return all_of(tests) if condition == "all" else any_of(tests)


def scan(case: Case, rules: Sequence[PatternRule], regex: bool = True) -> DataFrame:
    """Findings of all rules over their targets: each target is read once for all rules that want it."""
    frames = []
    for ident, target in TARGETS.items():
        mine = [r for r in rules if not [t for t in r.targets if t in TARGETS] or ident in r.targets]
        if not mine:
            continue
        text = F.col(target.text)
        info = F.array(*[F.when(matches(text, r.strings, r.condition, regex), F.struct(F.lit(f"yaralite:{r.ident or r.name}").alias("s"), F.lit(r.severity).alias("c"), F.lit(r.technique).cast("string").alias("t"), F.lit(r.name).alias("n"))) for r in mine])
        hit = case[target.table].filter(text.isNotNull()).select(target.value().alias("value"), (F.col(target.seen) if target.seen else F.lit(None)).cast("timestamp").alias("first_seen"), F.explode(F.filter(info, lambda x: x.isNotNull())).alias("r"))
        frames.append(hit.select(F.lit("string").alias("type"), "value", F.col("r.s").alias("source"), F.col("r.c").alias("confidence"), F.col("r.t").alias("related_campaign"), "first_seen", F.col("r.n").alias("notes")).distinct())
    return union(case, frames)
