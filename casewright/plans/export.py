"""Export of tables and timelines, and the report's sections."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..detect.findings import multi_source
from ..functions.text import basename, has, is_private_ip, joined, severity_rank, within
from ..schema import TABLES, Case
from . import library as L
from .timeline import BRANCHES, timeline
from .views import scripts, transfers, usage_top

#: The column a table's time bounds apply to.
TIME_COLUMNS = {b.table: b.seen for b in BRANCHES}


def bounded(case: Case, table: str, begin: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """A table between two times (included), where it has a time; all of it else."""
    df, seen = case[table], TIME_COLUMNS.get(table)
    if seen and begin:
        df = df.filter(F.col(seen) >= F.lit(begin).cast("timestamp"))
    if seen and end:
        df = df.filter(F.col(seen) <= F.lit(end).cast("timestamp"))
    return df.limit(limit) if limit else df


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text: times as YYYY-MM-DD HH:MM:SS, null as empty."""
    out = []
    for n, k in df.dtypes:
        c = F.col(f"`{n}`")
        t = F.date_format(c, "yyyy-MM-dd HH:mm:ss") if k.startswith("timestamp") else F.to_json(c) if k.startswith(("array", "struct", "map")) else c.cast("string")
        out.append(F.coalesce(t, F.lit("")).alias(n))
    return df.select(*out)


def write(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A folder of csv, tsv (both with header), jsonl (keys sorted, nulls kept) or parquet parts."""
    if fmt in ("csv", "tsv"):
        as_text(df).write.mode("overwrite").option("header", True).option("sep", "," if fmt == "csv" else "\t").option("emptyValue", "").csv(path)
    elif fmt == "jsonl":
        times = [F.date_format(F.col(f"`{n}`"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(n) if k.startswith("timestamp") else F.col(f"`{n}`") for n, k in sorted(df.dtypes)]
        df.select(*times).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def export_all(case: Case, folder: str, fmt: str = "csv", begin: str | None = None, end: str | None = None) -> list[str]:
    """Every collected table that has rows, and the timeline; the names written."""
    done = []
    for t in TABLES:
        if case.has(t) and not (df := bounded(case, t, begin, end)).isEmpty():
            write(df, f"{folder}/{t}", fmt)
            done.append(t)
    rows = timeline(case, begin=begin, end=end)
    if not rows.isEmpty():
        write(rows.orderBy(F.col("ts").desc_nulls_last(), "source"), f"{folder}/timeline", fmt)
        done.append("timeline")
    return done


# ---- report

# Events a report lists.
KEY_EVENTS = (1102, 4624, 4625, 4648, 4672, 4688, 4698, 4720, 4732, 7045)


# Events of the Unix logon log a report lists.
UNIX_EVENTS = ("ssh_login_success", "ssh_login_failed", "ssh_invalid_user", "sudo", "useradd", "su_success")


def process_traces(case: Case) -> DataFrame:
    """Processes in memory with command line, prefetch, and what the compatibility and inventory caches know of a program of that name (equality of the last part of the path)."""
    lines = case["mem_cmdline"].groupBy("pid").agg(F.min("cmdline").alias("cmdline"))
    runs = case["prefetch"].groupBy(F.lower("filename").alias("_k")).agg(F.max("run_count").alias("run_count"), F.max("last_run").alias("last_run"))
    cached = case["shimcache"].groupBy(basename("path").alias("_k")).agg(F.min("path").alias("cached_path"))
    known = case["amcache"].groupBy(basename("path").alias("_k")).agg(F.min("sha256").alias("sha256"))
    own = case["mem_pslist"].withColumn("_k", F.lower("name")).join(lines, "pid", "left")
    return own.join(runs, "_k", "left").join(cached, "_k", "left").join(known, "_k", "left").select("pid", "ppid", "name", "create_time", "cmdline", "run_count", "last_run", "cached_path", "sha256")


def script_evidence(case: Case, findings: DataFrame) -> DataFrame:
    """Scripts that hide what they do with what else speaks of them, newest first: findings of their text, of a process that ran them by name, of prefetch traces."""
    hiding = scripts(case, hiding=True, limit=None)
    by_text = findings.filter("value IS NOT NULL").groupBy(F.left("value", F.lit(200)).alias("_v")).agg(joined("source", ", ").alias("reported_by"))
    base = hiding.withColumn("_v", F.left("preview", F.lit(200))).join(by_text, "_v", "left").withColumn("_k", basename("path"))
    ran = case["mem_cmdline"].select(F.explode(F.array_distinct(F.transform(F.split(F.translate("cmdline", "\"'", "  "), r"\s+"), lambda x: F.regexp_extract(F.lower(x), r"[^/\\]+$", 0)))).alias("_k")).filter("_k <> ''").groupBy("_k").agg(F.count(F.lit(1)).alias("n_processes"))
    return base.join(ran, "_k", "left").select("timestamp", "computer", "path", F.left("preview", F.lit(300)).alias("script"), "reported_by", F.coalesce("n_processes", F.lit(0)).alias("n_processes")).orderBy(F.col("timestamp").desc_nulls_last(), "script")


def triaged(case: Case, findings: DataFrame) -> DataFrame:
    """Findings of detectors, rules and patterns with what the analyst noted on their source."""
    notes = case["case_notes"].filter("ref_type = 'triage'").groupBy(F.col("ref_id").alias("source")).agg(joined("note", "; ").alias("triage"))
    automatic = findings.filter(F.col("source").rlike("^(?:detect|sigma|yaralite):"))
    return automatic.join(notes, "source", "left").withColumn("triage", F.coalesce("triage", F.lit("")))


def sections(case: Case, findings: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """The report's tables by title, each ordered and at most as long as a page bears."""

    def newest(table: str, seen: str, n: int, *cols: str):
        return lambda: case[table].select(*cols).orderBy(F.col(seen).desc_nulls_last(), *[c for c in cols if c != seen]).limit(n)

    return {
        "Verdict": lambda: L.verdict(findings),
        "Threat findings": lambda: triaged(case, findings).orderBy(severity_rank("confidence").desc(), "source", "value").select("confidence", "source", "type", "value", "first_seen", "notes", "triage").limit(500),
        "Techniques": lambda: L.tactics(findings).orderBy(F.col("hits").desc(), "technique"),
        "Reported by several sources": lambda: multi_source(findings).orderBy(F.col("n_sources").desc(), "value").limit(200),
        "Collected tables": lambda: L.counts(case).orderBy("table_name"),
        "Accounts": lambda: L.user_activity(case, findings).orderBy(F.col("n_failed").desc(), "account").limit(100),
        "Suspicious logons": lambda: L.auth_stats(case).filter("n_failed > 0 OR n_explicit > 0").orderBy(F.col("n_failed").desc(), "account").limit(100),
        "Key events": lambda: case["evtx_events"].filter(F.col("event_id").isin(*KEY_EVENTS)).groupBy("event_id", "channel").agg(F.count(F.lit(1)).alias("n_rows"), F.max("timestamp").alias("last_ts")).orderBy(F.col("n_rows").desc(), "event_id").limit(200),
        "Processes in memory": lambda: L.process_tree(case).orderBy("pid").limit(300),
        "Process traces": lambda: process_traces(case).orderBy("pid").limit(300),
        "Injected memory": newest("mem_malfind", "pid", 200, "pid", "name", "address", "reason"),
        "Network": lambda: L.network_correlation(case, findings).orderBy(F.col("n_findings").desc(), F.col("n_conns").desc(), "remote_addr").limit(200),
        "Execution": newest("prefetch", "last_run", 300, "filename", "run_count", "last_run", "path"),
        "Cached programs": newest("shimcache", "last_modified", 300, "last_modified", "path", "order_idx"),
        "Inventoried programs": newest("amcache", "first_seen", 300, "first_seen", "path", "sha256", "publisher"),
        "Watched processes": lambda: case["sysmon_process"].filter(has("cmdline", "-enc", "frombase64", "downloadstring", "bypass") | within("image", "/temp/", "/downloads/", "/appdata/", "/public/", "/programdata/")).select("timestamp", "image", "cmdline", "parent_image", "user_name").orderBy(F.col("timestamp").desc_nulls_last(), "image").limit(100),
        "Watched connections": lambda: case["sysmon_network"].filter(F.col("initiated") & ~is_private_ip("dst_ip")).select("timestamp", "image", "dst_ip", "dst_port", "dst_host").orderBy(F.col("timestamp").desc_nulls_last(), "dst_ip").limit(100),
        "Watched names": newest("sysmon_dns", "timestamp", 50, "timestamp", "image", "query_name", "query_results"),
        "Threats found": lambda: case["defender_events"].filter("threat_name <> '' OR path <> ''").select("timestamp", "threat_name", "severity", "path", "action").orderBy(F.col("timestamp").desc_nulls_last(), "path").limit(300),
        "Scripts with evidence": lambda: script_evidence(case, findings).limit(60),
        "Started programs": lambda: L.process_stats(case).orderBy(F.col("n_starts").desc(), "program").limit(100),
        "Suspicious files": lambda: case["mft"].filter(~F.col("is_dir") & within("path", "/temp/", "/downloads/", "/appdata/", "/public/")).groupBy("path").agg(F.max("modified").alias("modified"), F.max("size").alias("size")).orderBy(F.col("modified").desc_nulls_last(), "path").limit(200),
        "Scripts": newest("ps_scriptblock", "timestamp", 50, "timestamp", "path", "script_text"),
        "Shell history": newest("shell_history", "timestamp", 200, "timestamp", "user", "command"),
        "Persistence": lambda: case["persistence"].select("type", "name", "command", "modified").orderBy("type", "name").limit(300),
        "Services": lambda: case["services"].filter(F.lower("start_type").isin("auto", "boot", "system") | ~within("binary_path", "/system32/")).select("name", "display_name", "start_type", "binary_path").orderBy("name").limit(300),
        "Scheduled tasks": lambda: case["scheduled_tasks"].select("name", "command", "args", "author", "last_run").orderBy("name").limit(300),
        "Unix logons": lambda: case["linux_auth"].filter(F.col("event_type").isin(*UNIX_EVENTS)).select("timestamp", "event_type", "user", "src_ip", "message").orderBy(F.col("timestamp").desc_nulls_last(), "message").limit(200),
        "Unix persistence": lambda: case["linux_persistence"].select("type", "user", "path", "command", "details").orderBy("type", "path", "command").limit(200),
        "Journal": lambda: case["usnjrnl"].filter(F.col("reason").rlike("FILE_CREATE|FILE_DELETE|RENAME")).select("timestamp", "path", "reason").orderBy(F.col("timestamp").desc_nulls_last(), "path").limit(300),
        "Jump lists": newest("jumplists", "accessed", 200, "accessed", "app_name", "target_path", "access_count"),
        "Links": newest("lnk_files", "modified", 200, "modified", "path", "target_path", "args"),
        "Recycle bin": newest("recycle_bin", "deleted_at", 300, "deleted_at", "original_path", "size", "sid"),
        "Folders looked at": newest("shellbags", "last_modified", 300, "last_modified", "user", "path", "item_type"),
        "Started from the desktop": newest("userassist", "last_run", 200, "last_run", "path", "run_count"),
        "Background activity": newest("bam_dam", "last_run", 200, "last_run", "path", "sid"),
        "Crashes": newest("wer_crashes", "crash_time", 300, "crash_time", "app_name", "fault_module", "exception_code"),
        "Network use": lambda: usage_top(case),
        "Transfers": lambda: transfers(case).limit(300),
        "Files not read": lambda: case["source_files"].filter("error IS NOT NULL").select("path", "type", "error").orderBy("path", "type").limit(500),
        "Browser": newest("browser_history", "visit_time", 200, "visit_time", "browser", "url", "title"),
        "Remote access": newest("anydesk_sessions", "timestamp", 300, "timestamp", "direction", "client_alias", "anydesk_id"),
        "Mails": lambda: L.mail_stats(case).orderBy("folder"),
        "Timeline": lambda: timeline(case, budgets=True, per_group=10, total=500),
        "Indicators": lambda: findings.filter(~F.col("source").rlike("^(?:detect|sigma|yaralite):")).orderBy("source", "value").limit(500),
    }


def html_report(case: Case, findings: DataFrame, title: str = "Case report") -> str:
    """One page with all sections that have rows (each is bounded, and brought to the driver)."""
    parts = []
    for name, build in sections(case, findings).items():
        df = as_text(build())
        rows = df.collect()
        if rows:
            head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
            body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v)[:400])}</td>" for v in r) + "</tr>" for r in rows)
            parts.append(f"<h2>{html.escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font-family:sans-serif}}table{{border-collapse:collapse}}td,th{{border:1px solid #bbb;padding:2px 6px;text-align:left}}</style><h1>{html.escape(title)}</h1>" + "".join(parts)


def context_text(case: Case, findings: DataFrame) -> str:
    """A short plain text of the case for a language model: counts, verdict and the first rows of the main sections."""
    out = []
    for name in ("Verdict", "Collected tables", "Threat findings", "Key events", "Started programs", "Accounts"):
        rows = as_text(sections(case, findings)[name]().limit(30)).collect()
        if rows:
            out.append(f"## {name}\n" + "\n".join(" | ".join(str(v)[:120] for v in r) for r in rows))
    return "\n\n".join(out)
