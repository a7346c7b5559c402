"""Log lines of differing layouts to entries with stamp, level, component and message.

Each line is parsed by a weighted grammar (``functions.earley``): rules
describe entry heads, their fields, and the lines that continue an entry; the
highest-scoring parse decides. Lines meet in order of their number inside
blocks of a file; the last head before a block is carried in from one row per
block, so a file of any length is never sorted as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import cut_lineage, worker_partitions
from ..functions.earley import Grammar

BLOCK_LINES = 4096

# Level names and letters as programs write them.
LEVELS = {
    "debug": ("debug", "dbg", "dbug", "trace", "trc", "verbose", "fine", "d", "t", "v"),
    "info": ("info", "inf", "information", "informational", "notice", "note", "i", "n"),
    "warn": ("warn", "warning", "wrn", "w"),
    "error": ("error", "err", "eror", "severe", "critical", "crit", "fatal", "alert", "emerg", "emergency", "panic", "e", "f", "c"),
}
LEVEL_KEYS = {name: key for key, names in LEVELS.items() for name in names}

_WORDS = "|".join(sorted((n for names in LEVELS.values() for n in names if len(n) > 1), key=len, reverse=True))
_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_CLOCK = r"\d{2}:\d{2}:\d{2}"
# Every line is parsed with a closing NUL, so that a rest of line is never empty and needs no second rule.
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})"

TERMINALS = {
    "SP": r"[ \t]+",
    "DASH": r" +- +",
    "NIL": r"-",
    "LBR": r"\[",
    "RBR": r"\]",
    "LT": r"<",
    "GT": r">",
    "SLASH": r"/",
    "BAR": r"[ \t]*\|[ \t]*",
    "COLON": r":(?=[ \0])",
    "INT": r"\d+",
    # stamps
    "ISO": rf"\d{{4}}[-/]\d{{2}}[-/]\d{{2}}[T ]{_CLOCK}(?:[.,]\d+)?{_OFFSET}?",
    "ISO_Z": rf"\d{{4}}-\d{{2}}-\d{{2}}[T ]{_CLOCK}(?:[.,]\d+)? (?:[+-]\d{{2}}:?\d{{2}}|[A-Z]{{3,5}})(?=[ \]\0])",
    "DOTTED": rf"\d{{2}}\.\d{{2}}\.\d{{4}} {_CLOCK}(?:[.,]\d+)?{_OFFSET}?",
    "DOTTED_Z": rf"\d{{2}}\.\d{{2}}\.\d{{4}} {_CLOCK}(?:[.,]\d+)? (?:[+-]\d{{2}}:?\d{{2}}|[A-Z]{{3,5}})(?=[ \]\0])",
    "CLASSIC": rf"{_MON} [ \d]\d {_CLOCK}(?:\.\d+)?",
    "DATE_CMD": rf"[A-Z][a-z]{{2}} {_MON} [ \d]\d {_CLOCK}(?: [A-Z]{{2,5}}| [+-]\d{{4}})? \d{{4}}",
    "EPOCH": r"\d{10}(?:\.\d+)?(?![\d.])|\d{13}(?!\d)|\d{16}(?!\d)",
    "GLOG_STAMP": rf"\d{{4}} {_CLOCK}\.\d+",
    "GLOG_LEVEL": r"[DIWEFTV](?=\d{4} )",
    # fields
    "LEVEL": rf"(?i:{_WORDS})(?![\w.-])",
    "PRI": r"\d{1,3}",
    "VERSION": r"\d(?= )",
    "HOST": r"[A-Za-z0-9][\w.-]*(?![\w.:\[/-])",
    "COMP": r"[A-Za-z_][\w.+-]*(?:/[A-Za-z_][\w.+-]*)*",
    "COMP_PLAIN": r"[A-Za-z_][\w.+-]*",
    "COMP_IN_BRACKETS": r"[A-Za-z_][\w.+/-]*(?=\])",
    "THREAD": r"[\w.#-]+",
    "TEXT": r".+",
    # name=value lines
    "K_STAMP": r"(?:ts|time|timestamp|t|date|datetime|when)=",
    "K_LEVEL": r"(?:level|lvl|severity|sev|loglevel|priority)=",
    "K_COMP": r"(?:component|prog|program|mod|module|unit|logger|comp|app|service|subsystem|facility|tag)=",
    "K_OTHER": r"(?!(?:ts|time|timestamp|t|date|datetime|when|level|lvl|severity|sev|loglevel|priority|component|prog|program|mod|module|unit|logger|comp|app|service|subsystem|facility|tag|msg|message|text)=)[A-Za-z_][\w.-]*=",
    "K_MSG": r"(?:msg|message|text)=",
    "QUOTED": r'"(?:[^"\\]|\\.)*"',
    "BARE": r'[^\s"=\0]+(?=[\s\0])',
    "END": r"\s*\0",
    "Q": r'"',
    # JSON lines
    "JOPEN": r"\{\s*",
    "JCLOSE": r"\s*\}\s*\0",
    "JCOMMA": r"\s*,\s*",
    "J_STAMP": r'"(?:ts|time|timestamp|t|@timestamp|date|datetime|when)"\s*:\s*',
    "J_LEVEL": r'"(?:level|lvl|severity|sev|loglevel|priority)"\s*:\s*',
    "J_COMP": r'"(?:component|prog|program|mod|module|unit|logger|comp|app|service|subsystem|facility|tag)"\s*:\s*',
    "J_OTHER": r'"(?!(?:ts|time|timestamp|t|@timestamp|date|datetime|when|level|lvl|severity|sev|loglevel|priority|component|prog|program|mod|module|unit|logger|comp|app|service|subsystem|facility|tag|msg|message|text)")(?:[^"\\]|\\.)*"\s*:\s*',
    "J_MSG": r'"(?:msg|message|text)"\s*:\s*',
    "JSTAMP_TEXT": r'[^"\\]+(?=")',
    "JNUMBER": r"-?\d+(?:\.\d+)?",
    "JWORD": r"null|true|false",
    "JNEST": r"[\[{].*?[\]}](?=\s*[,}])",
    # continuations
    "BLANK": r"\s+\0",
    "FRAME": r"\s+(?:at|in|from) .+",
    "CAUSE": r"(?:Caused by|Traceback|During handling|Suppressed|\.\.\. \d+ more).*",
    "HEXDUMP": r"[0-9A-Fa-f]{4,16}:?(?: +[0-9A-Fa-f]{2})+.*",
    "MARKED": r"\s*[|>*#].*",
    "INDENTED": r"[ \t]+\S.*",
    "BRACE": r"[{}\[\]()],?\s*\0",
}

RULES = {
    "LINE": [(1.0, "ENTRY"), (0.001, "CONTINUED")],
    "STAMP": [(1.0, "stamp:ISO"), (0.5, "stamp:ISO_Z"), (1.0, "stamp:DOTTED"), (0.5, "stamp:DOTTED_Z"), (1.0, "stamp:CLASSIC"), (1.0, "stamp:DATE_CMD"), (0.9, "stamp:EPOCH")],
    "PID": [(1.0, "LBR INT RBR")],
    # what follows a head without a level field: the level may stand before the text
    "TAGGED": [(1.0, "text:TEXT"), (1.2, "SP level:LEVEL COLON text:TEXT"), (1.2, "SP LT level:LEVEL GT text:TEXT")],
    "ENTRY": [
        (1.0, "SP? level:LEVEL SP STAMP SP INT SP INT SP comp:COMP DASH text:TEXT"),
        (0.4, "SP? STAMP SP INT SP INT SP comp:COMP DASH text:TEXT"),
        (1.0, "LBR STAMP RBR SP LBR level:LEVEL SP? RBR SP LBR comp:COMP_IN_BRACKETS RBR text:TEXT"),
        (0.5, "LBR STAMP RBR SP LBR comp:COMP_IN_BRACKETS RBR TAGGED"),
        (1.0, "STAMP SP level:LEVEL SP comp:COMP PID? COLON text:TEXT"),
        (0.5, "STAMP SP comp:COMP PID? COLON TAGGED"),
        (1.0, "STAMP SP level:LEVEL SP LBR THREAD RBR SP comp:COMP DASH text:TEXT"),
        (0.5, "STAMP SP LBR THREAD RBR SP comp:COMP DASH text:TEXT"),
        (1.0, "STAMP BAR comp:COMP BAR level:LEVEL BAR text:TEXT"),
        (1.0, "STAMP BAR level:LEVEL BAR comp:COMP BAR text:TEXT"),
        (0.3, "STAMP BAR comp:COMP BAR text:TEXT"),
        (1.0, "level:GLOG_LEVEL stamp:GLOG_STAMP SP INT SP comp:COMP RBR text:TEXT"),
        (0.7, "STAMP SP HOST SP comp:COMP PID? COLON TAGGED"),
        (1.0, "STAMP SP HOST SP comp:COMP_PLAIN SLASH level:LEVEL COLON text:TEXT"),
        (1.0, "LBR STAMP RBR SP HOST SP comp:COMP_PLAIN PID? SLASH level:LEVEL COLON text:TEXT"),
        (0.5, "LBR STAMP RBR SP HOST SP comp:COMP PID? COLON TAGGED"),
        (1.0, "LT pri:PRI GT VERSION SP STAMP SP HOST SP comp:COMP SP PROCID SP NILFIELD SP NILFIELD text:TEXT"),
        (0.9, "LT pri:PRI GT STAMP SP HOST SP comp:COMP PID? COLON text:TEXT"),
        (1.0, "LOGFMT END"),
        (1.0, "JOPEN JBODY JCLOSE"),
    ],
    "PROCID": [(1.0, "INT"), (1.0, "NIL")],
    "NILFIELD": [(1.0, "NIL"), (0.5, "THREAD")],
    "LOGFMT": [(1.0, "OTHER_PAIR SP LOGFMT"), (1.0, "STAMP_PAIR SP PAIRS")],
    "PAIRS": [(1.0, "PAIR"), (1.0, "PAIR SP PAIRS")],
    "PAIR": [(1.0, "OTHER_PAIR"), (1.0, "STAMP_PAIR")],
    "STAMP_PAIR": [(1.0, "K_STAMP stampq:QUOTED"), (0.9, "K_STAMP STAMP")],
    "OTHER_PAIR": [(1.0, "K_LEVEL levelq:VALUE"), (1.0, "K_COMP compq:VALUE"), (1.0, "K_MSG msgq:VALUE?"), (1.0, "K_OTHER VALUE?")],
    "VALUE": [(1.0, "QUOTED"), (1.0, "BARE")],
    "JBODY": [(1.0, "JOTHER JCOMMA JBODY"), (1.0, "JSTAMP"), (1.0, "JSTAMP JCOMMA JREST")],
    "JREST": [(1.0, "JANY"), (1.0, "JANY JCOMMA JREST")],
    "JANY": [(1.0, "JOTHER"), (1.0, "JSTAMP")],
    "JSTAMP": [(1.0, "J_STAMP Q stamp:JSTAMP_TEXT Q"), (1.0, "J_STAMP stamp:JNUMBER")],
    "JOTHER": [(1.0, "J_LEVEL levelq:JVALUE"), (1.0, "J_COMP compq:JVALUE"), (1.0, "J_MSG msgq:JVALUE"), (1.0, "J_OTHER JVALUE")],
    "JVALUE": [(1.0, "QUOTED"), (1.0, "JNUMBER"), (1.0, "JWORD"), (0.5, "JNEST")],
    "CONTINUED": [
        (1.0, "BLANK"), (1.0, "FRAME"), (1.0, "CAUSE"), (1.0, "HEXDUMP"), (1.0, "MARKED"), (0.8, "INDENTED"), (1.0, "BRACE"), (0.01, "unparsed:TEXT"),
    ],
}

_GRAMMAR: Grammar | None = None


def grammar() -> Grammar:
    """The line grammar, built once per Python worker."""
    global _GRAMMAR
    if _GRAMMAR is None:
        _GRAMMAR = Grammar("LINE", RULES, TERMINALS)
    return _GRAMMAR


def _syslog_level(priority: int) -> str:
    severity = priority % 8
    return "error" if severity <= 3 else "warn" if severity == 4 else "debug" if severity == 7 else "info"


# Terminals never tell one digit from another, so lines that differ in digits only have the same spans.
_DIGITS = {ord(d): "0" for d in "123456789"}


def _spans(text: str, known: dict[str, list | None]) -> list[tuple[str, int, int]] | None:
    """Named spans of the best parse of a line; ``known`` holds those of lines that differ in digits only."""
    shape = text.replace("\0", " ").translate(_DIGITS) + "\0"
    if shape not in known:
        found = grammar().parse(shape)
        known[shape] = None if found is None else found[1]
    return known[shape]


def _unescaped(value: str) -> str:
    """The text of a field's value, quoted as in JSON or by backslashes, or bare."""
    if not value.startswith('"'):
        return value
    try:
        return json.loads(value, strict=False)
    except ValueError:
        return re.sub(r"\\(.)", r"\1", value[1:-1])


def parse_line(line: str | None, known: dict[str, list | None] | None = None) -> tuple[bool, str, str, str, str, bool]:
    """(is head, stamp, level key, component, its part of the message, has no known form) of one line.

    A head's part is what follows the head, or its message field without quotes
    and escapes, or the whole line if it has fields but none for the message. A
    continuing line's part is the line. A level before the text is read as the
    head's where the head states none.
    """
    text = (line or "").rstrip("\r\n")
    spans = _spans(text, {} if known is None else known) if text else None
    if spans is None:
        return False, "", "", "", text, False
    stamp, level, comp, message, unparsed, head = "", "", "", None, False, False
    for name, a, z in spans:
        piece = text[a:z]
        if name in ("stamp", "stampq"):
            stamp, head = stamp or piece.strip('"'), True
        elif name in ("level", "levelq"):
            level = LEVEL_KEYS.get(piece.strip('"').strip().lower(), "")
        elif name == "pri":
            level = _syslog_level(int(piece))
        elif name in ("comp", "compq"):
            comp = piece.strip('"').strip()
        elif name == "text":
            message = piece.removeprefix(" ")
        elif name == "msgq" and message is None:
            message = _unescaped(piece)
        elif name == "unparsed":
            unparsed = True
    if not head:
        return False, "", "", "", text, unparsed
    return True, stamp, level, comp, text if message is None else message, unparsed


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        known: dict[str, list | None] = {}
        rows = [parse_line(m, known) for m in b["_text"]]
        out = b[["_file", "_line", "_rec"]].copy()
        for i, name in enumerate(("_head", "_stamp", "_level", "_comp", "_piece", "_unparsed")):
            out[name] = pd.Series([r[i] for r in rows], index=b.index, dtype=bool if i in (0, 5) else object)
        yield out


def parsed_lines(df: DataFrame, text: str, file: str, line: str, rec: str) -> DataFrame:
    """Each distinct line once: _file, _line, _rec, _head, _stamp, _level, _comp, _piece, _unparsed.

    A line found twice (same file and number) is one line, known by its lowest
    ``rec``, with the text of that row. Lines of a null file or number are
    dropped: they cannot be placed.
    """
    placed = df.select(df[file].alias("_file"), df[line].cast("bigint").alias("_line"), df[rec].cast("bigint").alias("_rec"), df[text].alias("_text")).filter("_file IS NOT NULL AND _line IS NOT NULL AND _rec IS NOT NULL")
    # An explicit number: parsing costs far more than the lines' bytes, by which partitions would be merged.
    spaced = placed.repartition(worker_partitions(df.sparkSession), "_file", "_line")
    once = spaced.groupBy("_file", "_line").agg(F.min_by("_text", "_rec").alias("_text"), F.min("_rec").alias("_rec")).select("_file", "_line", "_rec", "_text")
    return once.mapInPandas(_parse_batches, "_file string, _line bigint, _rec bigint, _head boolean, _stamp string, _level string, _comp string, _piece string, _unparsed boolean")


def log_entries(df: DataFrame, text: str = "message", file: str = "source_file", line: str = "line_no", rec: str = "rec_id", block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per entry: source_file, first_line, first_rec_id, n_lines, stamp_text, level_key, component_key, message, n_unparsed.

    message is the head's text and the continuing lines, joined by line feeds;
    n_unparsed counts continuing lines of no known form. Lines before a file's
    first head belong to no entry. Null and empty lines continue an entry. An
    empty table gives no rows; a file without heads gives none.
    """
    # Parsed once and written: three branches read the lines, and each would parse them again.
    lines = cut_lineage(parsed_lines(df, text, file, line, rec)).withColumn("_block", F.expr(f"_line div {block_lines}"))
    head_line = F.when(F.col("_head"), F.col("_line"))
    here = W.partitionBy("_file", "_block").orderBy("_line").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = lines.withColumn("_own", F.max(head_line).over(here))
    # One row per block, from the last line's running head: no second pass over the texts.
    ends = lines.groupBy("_file", "_block").agg(F.max(head_line).alias("_last"))
    carried = ends.withColumn("_carry", F.max("_last").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))).select("_file", "_block", "_carry")
    settled = marked.filter("_own IS NOT NULL")
    before = marked.filter("_own IS NULL").join(carried, ["_file", "_block"]).withColumn("_own", F.col("_carry")).filter("_own IS NOT NULL").select(settled.columns)
    own = F.col("_head")
    message = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", F.col("_piece").alias("p")))), lambda x: x["p"]), "\n")
    entries = (
        settled.unionByName(before)
        .groupBy("_file", "_own")
        .agg(
            F.max(F.when(own, F.col("_rec"))).alias("first_rec_id"),
            F.count(F.lit(1)).cast("int").alias("n_lines"),
            F.max(F.when(own, F.col("_stamp"))).alias("stamp_text"),
            F.max(F.when(own, F.col("_level"))).alias("level_key"),
            F.max(F.when(own, F.col("_comp"))).alias("component_key"),
            message.alias("message"),
            F.count_if("_unparsed").alias("n_unparsed"),
        )
    )
    return entries.select(F.col("_file").alias("source_file"), F.col("_own").alias("first_line"), "first_rec_id", "n_lines", "stamp_text", "level_key", "component_key", "message", "n_unparsed")
