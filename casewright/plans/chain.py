"""What happened around a program, file, account or address: sixteen sources in one order of time."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, basename
from ..schema import Case

c = F.col
EVENT = "ts timestamp, source string, severity string, action string, detail string, extra string, related string, user string"
# Folders after which a file's name begins in a path that lost its separators.
FOLDERS = ("Downloads", "Desktop", "Documents", "AppData", "Temp", "System32", "SysWOW64", "Users", "Roaming", "Local")


def asked(term: str) -> tuple[str, str, int | None]:
    """(name, its last part in small letters, process number or None) of a term; findings' values name a process as 'x.exe (PID 7) ...'."""
    term = term.strip()
    m = re.match(r"(.+?) \(PID (\d+)[) ]", term)
    name, pid = (m.group(1), int(m.group(2))) if m else (term, None)
    last = re.split(r"[\\/]", name)[-1].lower()
    if ":" in name and "\\" not in name and "/" not in name:
        for folder in FOLDERS:
            if (at := name.rfind(folder)) >= 0:
                rest = name[at + len(folder) :].strip().lower()
                if rest and len(rest) < len(last):
                    last = rest
                break
    return name, last, pid


def _text(*parts: str | Column) -> Column:
    """Texts and columns in one, null as nothing."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in parts])


def chain(case: Case, term: str, total: int | None = 1500, per_source: int | None = None) -> DataFrame:
    """ts, source, severity, action, detail, extra, related, user of what names the term, in order of time; injected code, which has no time, last.

    Other rows without a time are left out, and times before 1995 or after 2099
    where collectors write such for none. Limits (None: none) keep the earliest.
    """
    name, last, pid = asked(term)
    if not name:
        return case.spark.createDataFrame([], EVENT)

    def like(*columns: str) -> Column:
        return any_of([F.coalesce(F.lower(n).contains(name.lower()), F.lit(False)) for n in columns])

    def like_last(*columns: str) -> Column:
        return any_of([F.coalesce(F.lower(n).contains(last), F.lit(False)) for n in columns])

    def by_pid(test: Column) -> Column:
        return test if pid is None else test | F.coalesce(c("pid") == pid, F.lit(False))

    def sane(column: str) -> Column:
        return c(column).between(F.lit("1995-01-01").cast("timestamp"), F.lit("2099-12-31").cast("timestamp"))

    def made(table: str, where: Column, seen: str | None, source: str, action: Column, detail: Column, extra: Column | str = "", related: Column | str = "", user: Column | str = "", severity: str = "", frame: DataFrame | None = None) -> DataFrame | None:
        if not case.has(table):
            return None
        df = (case[table] if frame is None else frame).filter(where)
        if seen:
            df = df.filter(c(seen).isNotNull())
        shown = {"severity": F.lit(severity), "action": action, "detail": detail, "extra": extra, "related": related, "user": user}
        out = df.select((c(seen) if seen else F.lit(None)).cast("timestamp").alias("ts"), F.lit(source).alias("source"), *[_text(v).alias(n) for n, v in shown.items()])
        return out.orderBy("ts", "action", "detail", "extra").limit(per_source) if per_source else out

    image, parent = basename("image"), basename("parent_image")
    shown_image, shown_parent = F.regexp_extract("image", r"[^/\\]*$", 0), F.regexp_extract("parent_image", r"[^/\\]*$", 0)
    spawn = F.when(image == last, _text("Created (spawned by ", shown_parent, ")")).when(parent == last, _text("Spawned ", shown_image)).otherwise("Process spawn")
    logon = F.when(c("event_id") == 4624, "Logon success").when(c("event_id") == 4625, "Logon failure").when(c("event_id") == 4648, "Explicit creds logon").otherwise(_text("Authentication ", c("event_id")))
    from_ip = F.when(~F.coalesce("src_ip", F.lit("")).isin("", "-"), _text(" · IP: ", c("src_ip"))).otherwise("")
    in_memory = case["mem_pslist"].join(case["mem_cmdline"].select("pid", "cmdline"), "pid", "left")
    exactly = (F.lower("user") == term.strip().lower()) | (c("src_ip") == term.strip())
    parts = [
        made("proc_creation", sane("timestamp") & (like_last("image", "parent_image") | like("cmdline")), "timestamp", "proc_creation", spawn, c("image"), c("cmdline"), shown_parent, c("user_name")),
        made("defender_events", like("path", "threat_name", "process_name", "sha256"), "timestamp", "defender", _text("Defender detection: ", c("threat_name")), c("path"), _text("Action: ", c("action"), " · ", c("severity")), c("process_name"), c("detection_user"), "high"),
        made("auth_events", F.coalesce(exactly, F.lit(False)) | like("process_name"), "timestamp", "auth", logon, _text("User: ", c("user"), from_ip), _text("Type ", c("logon_type"), " · ", c("process_name")), "", c("user")),
        made("prefetch", sane("last_run") & (like_last("filename") | like("path")), "last_run", "prefetch", F.lit("Executed (prefetch)"), c("filename"), _text("Runs: ", c("run_count"), " · ", c("path"))),
        made("amcache", like("path"), "first_seen", "amcache", F.lit("First seen on system"), c("path"), _text(c("publisher"), " · ", c("version"), " · ", c("sha256"))),
        made("persistence", like("command", "key_path") | like_last("name"), "modified", "persistence", _text("Persistence: ", c("type"), " · ", c("name")), c("command"), _text("Key: ", c("key_path")), severity="med"),
        made("bam_dam", like("path"), "last_run", "bam_dam", F.lit("BAM/DAM execution record"), c("path"), _text(c("source"), " · SID: ", c("sid"))),
        made("userassist", like("path"), "last_run", "userassist", F.lit("User-launched (UserAssist)"), c("path"), _text("Runs: ", c("run_count"), " · Focus: ", c("focus_count"))),
        made("sysmon_process", like_last("image", "parent_image") | like("cmdline"), "timestamp", "sysmon", F.lit("Sysmon process"), c("image"), c("cmdline"), "", c("user_name")),
        made("sysmon_network", like_last("image") | like("dst_host") | F.coalesce(c("dst_ip") == term.strip(), F.lit(False)), "timestamp", "sysmon_net", F.lit("Network connection"), _text(c("image"), " → ", c("dst_ip"), ":", c("dst_port")), c("dst_host"), "", c("user_name")),
        made("evtx_events", sane("timestamp") & like("message"), "timestamp", "evtx", _text("Event ", c("event_id"), " · ", c("channel")), c("message")),
        made("mem_pslist", by_pid(like_last("name") | like("cmdline")), "create_time", "mem_pslist", F.lit("Process in RAM snapshot"), _text(c("name"), " (PID ", c("pid"), ")"), _text("Threads:", c("threads"), " Handles:", c("handles")), "", c("cmdline"), frame=in_memory),
        made("mem_netscan", by_pid(like_last("name") | like("remote_addr", "local_addr")), "created", "mem_netscan", _text("RAM: Network (", c("state"), ")"), _text(c("name"), " → ", c("remote_addr"), ":", c("remote_port")), _text(c("proto"), " · PID ", c("pid"))),
        made("mem_malfind", by_pid(like_last("name")), None, "mem_malfind", F.lit("RAM: Injected code region"), _text(c("name"), " (PID ", c("pid"), ") @ ", c("address")), _text("Size: ", c("size"), " · ", c("reason")), "", F.left("disasm", F.lit(200)), "high"),
        made("browser_downloads", like("local_path", "url") | like_last("local_path"), "start_time", "browser_dl", F.lit("Browser download"), c("local_path"), _text(c("browser"), " · ", c("url"))),
        made("browser_history", like("url", "title"), "visit_time", "browser", F.lit("Browser visit"), c("url"), _text(c("title"), " · ", c("browser"))),
    ]
    found = [p for p in parts if p is not None]
    if not found:
        return case.spark.createDataFrame([], EVENT)
    out = reduce(DataFrame.unionByName, found).orderBy(c("ts").asc_nulls_last(), "source", "action", "detail", "extra")
    return out.limit(total) if total else out


def chain_sources(events: DataFrame) -> DataFrame:
    """How many rows of a chain each source gave."""
    return events.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
