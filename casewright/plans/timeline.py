"""Timelines: many tables in one shape, with budgets, filters, context and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import any_of, low, within
from ..schema import Case


@dataclass(frozen=True)
class Branch:
    """One table's part of a timeline; category, detail and extra are SQL expressions."""

    table: str
    label: str
    seen: str
    category: str
    detail: str
    extra: str
    where: str = "true"
    budget: int = 500


# The tables of the timeline and what each shows.
BRANCHES = (
    Branch("evtx_events", "evtx", "timestamp", "cast(event_id AS string)", "coalesce(channel, '')", "computer", budget=2000),
    Branch("auth_events", "auth", "timestamp", "cast(event_id AS string)", "coalesce(user, '')", "coalesce(src_ip, '')", budget=1000),
    Branch("defender_events", "defender", "timestamp", "severity", "coalesce(threat_name, '')", "coalesce(path, '')"),
    Branch("ioc_indicators", "detect", "first_seen", "confidence", "concat(source, chr(1), coalesce(notes, ''))", "value"),
    Branch("prefetch", "prefetch", "last_run", "filename", "concat(run_count, ' runs')", "path"),
    Branch("amcache", "amcache", "first_seen", "'exec'", "path", "coalesce(sha256, '')"),
    Branch("mft", "mft", "modified", "'file'", "path", "cast(coalesce(size, 0) AS string)", "NOT is_dir AND translate(lower(path), chr(92), '/') RLIKE '/(temp|appdata|downloads)/.*[.](exe|dll|ps1|bat|vbs)$'"),
    Branch("proc_creation", "proc_4688", "timestamp", "coalesce(image, '')", "coalesce(cmdline, '')", "coalesce(user_name, '')"),
    Branch("sysmon_process", "sysmon", "timestamp", "coalesce(image, '')", "coalesce(cmdline, '')", "coalesce(user_name, '')"),
    Branch("sysmon_network", "sysmon_net", "timestamp", "coalesce(image, '')", "concat(coalesce(dst_ip, ''), ':', coalesce(dst_port, 0))", "coalesce(dst_host, '')"),
    Branch("sysmon_imageload", "dll_load", "timestamp", "coalesce(image, '')", "coalesce(image_loaded, '')", "coalesce(signature, '')"),
    Branch("browser_history", "browser", "visit_time", "browser", "url", "coalesce(title, '')"),
    Branch("lateral_movement", "lateral", "timestamp", "coalesce(type, '')", "coalesce(user, '')", "concat(coalesce(src_host, ''), ' → ', coalesce(dst_host, ''))"),
    Branch("ps_scriptblock", "powershell", "timestamp", "'script'", "substring(coalesce(script_text, ''), 1, 120)", "''"),
    Branch("rdp_events", "rdp", "timestamp", "'rdp'", "coalesce(user, '')", "coalesce(src_ip, '')"),
    Branch("smb_events", "smb", "timestamp", "coalesce(operation, '')", "coalesce(user, '')", "concat(coalesce(src_ip, ''), ':', coalesce(share, ''))"),
    Branch("persistence", "persistence", "modified", "coalesce(type, '')", "coalesce(name, '')", "coalesce(command, '')"),
    Branch("lnk_files", "lnk", "modified", "'lnk'", "coalesce(target_path, '')", "path"),
    Branch("userassist", "userassist", "last_run", "'exec'", "path", "concat(coalesce(run_count, 0), ' runs')"),
    Branch("bam_dam", "bam_dam", "last_run", "source", "path", "sid"),
    Branch("usnjrnl", "usnjrnl", "timestamp", "reason", "path", "''", "reason RLIKE 'FILE_CREATE|FILE_DELETE|RENAME'"),
    Branch("linux_auth", "linux_auth", "timestamp", "event_type", "coalesce(user, '')", "coalesce(src_ip, '')"),
    Branch("shell_history", "shell", "timestamp", "shell", "command", "coalesce(user, '')"),
    Branch("anydesk_events", "anydesk", "timestamp", "level", "message", "component"),
    Branch("wer_crashes", "wer", "crash_time", "coalesce(exception_code, '')", "app_name", "app_path"),
    Branch("srum_network_usage", "srum", "timestamp", "app_name", "concat(bytes_sent, '/', bytes_recvd)", "user_name"),
    Branch("rdp_client_history", "rdp_client", "modified", "'rdp_client'", "server", "username"),
    Branch("run_mru", "run_mru", "modified", "'run'", "command", "user"),
)

FIELDS = ("ts", "source", "category", "detail", "extra")


def branch_rows(case: Case, b: Branch) -> DataFrame:
    """One table in the timeline's shape; rows without a real time are left out."""
    sane = F.col(b.seen).cast("timestamp")
    df = case[b.table].filter(sane.isNotNull() & (sane >= F.lit("2000-01-01").cast("timestamp")) & F.expr(b.where))
    exprs = [sane.alias("ts"), F.lit(b.label).alias("source"), *[F.expr(e).cast("string").alias(n) for n, e in (("category", b.category), ("detail", b.detail), ("extra", b.extra))]]
    return df.select(*exprs)


def collected(case: Case) -> list[str]:
    """Labels of the timeline's tables that were collected."""
    return [b.label for b in BRANCHES if case.has(b.table)]


def timeline(
    case: Case,
    sources: Sequence[str] | None = None,
    begin: str | None = None,
    end: str | None = None,
    text: str | None = None,
    budgets: bool = False,
    total: int | None = None,
    newest_first: bool = True,
    per_group: int | None = None,
) -> DataFrame:
    """Rows of all collected tables as ts, source, category, detail, extra.

    sources: labels; begin and end: bounds, included; text: contained in
    detail, category or extra in any case; budgets: newest rows of each table
    only, before the union (a top-k per branch); per_group: newest rows of each
    (source, category); total: newest (or oldest) rows overall, ordered. Without
    total the rows are not ordered.
    """
    chosen = [b for b in BRANCHES if case.has(b.table) and (not sources or b.label in sources)]
    frames = []
    for b in chosen:
        df = branch_rows(case, b)
        if begin:
            df = df.filter(F.col("ts") >= F.lit(begin).cast("timestamp"))
        if end:
            df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
        if text:
            df = df.filter(any_of([low(x).contains(text.lower()) for x in ("category", "detail", "extra")]))
        if budgets:
            df = df.orderBy(F.col("ts").desc_nulls_last(), "category", "detail", "extra").limit(b.budget)
        frames.append(df)
    if not frames:
        return case.spark.createDataFrame([], "ts timestamp, source string, category string, detail string, extra string")
    out = reduce(DataFrame.unionByName, frames)
    if per_group:
        order = W.partitionBy("source", "category").orderBy(F.col("ts").desc_nulls_last(), "detail", "extra")
        out = out.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_group).drop("_r")
    if total:
        when = F.col("ts").desc_nulls_last() if newest_first else F.col("ts").asc_nulls_last()
        out = out.orderBy(when, "source", "category", "detail", "extra").limit(total)
    return out


def event_context(case: Case, at: str, seconds: int = 300, total: int = 300) -> DataFrame:
    """Rows at most so many seconds (1 to 3600) around a time, oldest first."""
    seconds = max(1, min(3600, seconds))
    mid = F.lit(at).cast("timestamp")
    span = F.expr(f"INTERVAL {seconds} SECONDS")
    near = timeline(case).filter(F.col("ts").between(mid - span, mid + span))
    return near.orderBy("ts", "source", "category", "detail", "extra").limit(total)


def histogram(case: Case, sources: Sequence[str] = ("evtx", "auth", "proc_4688", "sysmon", "browser"), unit: str = "hour") -> DataFrame:
    """Rows per unit of time and source, one column per source, and their sum."""
    rows = timeline(case, sources).groupBy(F.date_trunc(unit, "ts").alias("bucket")).pivot("source", list(sources)).count()
    counts = [F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("bigint") for s in sources]
    return rows.select("bucket", *[c.alias(s) for c, s in zip(counts, sources)], reduce(lambda a, b: a + b, counts).alias("total"))


def first_last(case: Case) -> DataFrame:
    """Range of times of each source."""
    return timeline(case).groupBy("source").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_rows"))


# ---- search and pivot

# Columns a term is looked up in, with the time shown.
PIVOTS = {
    "prefetch": ("last_run", ("filename", "path")), "amcache": ("first_seen", ("path",)), "shimcache": ("last_modified", ("path",)), "bam_dam": ("last_run", ("path",)), "mft": ("modified", ("path",)), "usnjrnl": ("timestamp", ("path",)), "lnk_files": ("modified", ("target_path", "path")),
    "proc_creation": ("timestamp", ("image", "cmdline", "parent_image")), "sysmon_process": ("timestamp", ("image", "cmdline")), "sysmon_imageload": ("timestamp", ("image", "image_loaded")), "sysmon_network": ("timestamp", ("image", "dst_ip", "dst_host")), "sysmon_dns": ("timestamp", ("image", "query_name")), "auth_events": ("timestamp", ("user", "src_ip", "workstation")), "browser_history": ("visit_time", ("url", "title")), "defender_events": ("timestamp", ("threat_name", "path")), "ps_scriptblock": ("timestamp", ("script_text",)),
    "ioc_indicators": ("first_seen", ("value", "notes")), "registry_raw": ("modified", ("key_path", "value_data")), "persistence": ("modified", ("name", "command")), "services": ("modified", ("name", "binary_path")), "mem_cmdline": (None, ("name", "cmdline")), "mem_netscan": ("created", ("name", "remote_addr", "local_addr")), "mem_pslist": ("create_time", ("name",)), "linux_auth": ("timestamp", ("user", "src_ip", "message")), "shell_history": ("timestamp", ("command", "user")), "userassist": ("last_run", ("path",)), "emails": ("sent_at", ("subject", "from_addr", "to_addrs", "body_text")), "anydesk_sessions": ("timestamp", ("client_alias", "anydesk_id")), "evtx_events": ("timestamp", ("message", "computer")),
}


def pivot(case: Case, term: str, tables: Sequence[str] | None = None, per_table: int | None = None) -> DataFrame:
    """Rows that hold a term (in any case): ts, source, field, detail; of each table the newest ``per_table`` where given."""
    if len(term) < 2:
        raise ValueError("a term has at least two characters")
    frames = []
    for table, (seen, cols) in PIVOTS.items():
        if not case.has(table) or tables and table not in tables:
            continue
        hit = F.coalesce(*[F.when(low(x).contains(term.lower()), F.struct(F.lit(x).alias("f"), F.left(F.col(x).cast("string"), F.lit(300)).alias("d"))) for x in cols])
        ts = (F.col(seen) if seen else F.lit(None)).cast("timestamp").alias("ts")
        df = case[table].select(ts, hit.alias("_h")).filter("_h IS NOT NULL").select("ts", F.lit(table).alias("source"), F.col("_h.f").alias("field"), F.col("_h.d").alias("detail"))
        if per_table:
            df = df.orderBy(F.col("ts").desc_nulls_last(), "field", "detail").limit(per_table)
        frames.append(df)
    return reduce(DataFrame.unionByName, frames) if frames else case.spark.createDataFrame([], "ts timestamp, source string, field string, detail string")


def correlate(case: Case, term: str) -> DataFrame:
    """How many rows of each table hold a term, and when first and last."""
    return pivot(case, term).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


__all__ = ["BRANCHES", "PIVOTS", "branch_rows", "collected", "correlate", "event_context", "first_last", "histogram", "pivot", "timeline", "within"]
