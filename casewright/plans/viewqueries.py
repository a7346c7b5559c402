"""Queries of the viewer's statistics and lists over the collected tables or small literal ones, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Case
from . import chain as Ch
from . import views as V
from .artifactcases import literal_sql
from .detectorcases import OLD, T, U, case_of

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def over_data(name: str, sql: str):
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Case(spark, sf_dir))
        ORACLE[name] = sql
        return fn

    return keep


_USER = "\"user\" <> '' AND \"user\" NOT LIKE 'S-1-%'"
_IP = "src_ip NOT IN ('', '-')"


@over_data("logon_totals", f"SELECT count(*) AS total, count(*) FILTER (event_id = 4625) AS failed, count(DISTINCT CASE WHEN {_USER} THEN \"user\" END) AS unique_users, count(DISTINCT CASE WHEN {_IP} THEN src_ip END) AS unique_ips FROM auth_events")
def _(case: Case) -> DataFrame:
    return V.logon_totals(case)


for _of, _where in (("user", _USER), ("src_ip", _IP)):
    for _failed, _n in ((False, 15), (True, 10)):
        _more = " AND event_id = 4625" if _failed else ""
        QUERIES[f"logon_top_{_of}{'_failed' if _failed else ''}"] = lambda spark, sf_dir, of=_of, failed=_failed, n=_n: V.logon_top(Case(spark, sf_dir), of, failed, n)
        ORACLE[f"logon_top_{_of}{'_failed' if _failed else ''}"] = f"SELECT \"{_of}\", count(*) AS n_rows FROM auth_events WHERE {_where}{_more} GROUP BY 1 ORDER BY n_rows DESC, 1 LIMIT {_n}"


@over_data("logon_event_counts", "SELECT event_id, count(*) AS n_rows FROM auth_events GROUP BY 1")
def _(case: Case) -> DataFrame:
    return V.logon_event_counts(case)


@over_data("logon_type_breakdown", "SELECT CAST(logon_type AS VARCHAR) AS logon_type, count(*) AS total, count(*) FILTER (event_id = 4624) AS successes, count(*) FILTER (event_id = 4625) AS failures, count(DISTINCT \"user\") AS unique_users FROM auth_events WHERE logon_type <> 0 GROUP BY 1")
def _(case: Case) -> DataFrame:
    return V.logon_type_breakdown(case)


@over_data("new_credential_logons", f"SELECT \"user\", src_ip, count(*) AS n_rows, epoch_us(max(\"timestamp\")) AS last_us FROM auth_events WHERE logon_type = 9 AND {_USER} GROUP BY 1, 2")
def _(case: Case) -> DataFrame:
    return V.new_credential_logons(case).select("user", "src_ip", "n_rows", F.unix_micros("last_seen").alias("last_us"))


_S = "contains(lower(coalesce({}, '')), 'sql')"


@over_data(
    "search_all_kinds",
    f"""SELECT 'network' AS kind, remote_addr || ':' || CAST(remote_port AS VARCHAR) AS title, name AS detail, proto AS ref FROM mem_netscan WHERE {_S.format('remote_addr')} OR {_S.format('name')}
UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), message, channel FROM evtx_events WHERE {_S.format('message')} OR {_S.format('user_sid')}
UNION ALL SELECT 'proc_creation', image, coalesce(cmdline, ''), coalesce(user_name, '') FROM proc_creation WHERE {_S.format('image')} OR {_S.format('cmdline')} OR {_S.format('parent_image')} OR {_S.format('user_name')}
UNION ALL SELECT 'browser', url, coalesce(title, ''), browser FROM browser_history WHERE {_S.format('url')} OR {_S.format('title')}
UNION ALL SELECT 'process', 'sqlservr.exe', 'x', '7'""",
)
def _(case: Case) -> DataFrame:
    more = case.with_tables(mem_pslist=case.spark.createDataFrame([(7, "sqlservr.exe"), (8, "calc.exe")], "pid int, name string"), mem_cmdline=case.spark.createDataFrame([(7, "x"), (8, "y")], "pid int, cmdline string"))
    return V.search(more, "SQL", None).filter("kind <> 'auth'")


_HIDING = "frombase64|encodedcommand|invoke-expression|-enc |\\[char\\]|downloadstring|new-object.*webclient|iex|bypass|shellcode|reflection\\.assembly|marshal|-w hidden|lsass"


@over_data("scripts_that_hide", f"SELECT epoch_us(\"timestamp\") AS at_us, script_id, path, level, computer, left(script_text, 3000) AS preview, CAST(length(script_text) AS INTEGER) AS total_len FROM ps_scriptblock WHERE regexp_matches(lower(script_text), '(?s){_HIDING}')")
def _(case: Case) -> DataFrame:
    return V.scripts(case, hiding=True, limit=None).select(F.unix_micros("timestamp").alias("at_us"), "script_id", "path", "level", "computer", "preview", "total_len")


@over_data("remote_access_stats", "SELECT count(*) AS total_sessions, count(*) FILTER (direction = 'Incoming') AS incoming, count(*) FILTER (direction = 'Outgoing') AS outgoing, count(DISTINCT anydesk_id) AS unique_ids FROM anydesk_sessions")
def _(case: Case) -> DataFrame:
    return V.remote_access_stats(case).drop("first_seen", "last_seen")


@over_data("mail_top_senders", "SELECT lower(from_addr) AS sender, count(*) AS n_rows FROM emails WHERE from_addr <> '' GROUP BY 1 ORDER BY n_rows DESC, 1 LIMIT 15")
def _(case: Case) -> DataFrame:
    return V.top_senders(case)


@over_data("program_started", "SELECT epoch_us(\"timestamp\") AS at_us, pid, image, cmdline FROM proc_creation WHERE contains(lower(coalesce(image, '')), 'certutil.exe')")
def _(case: Case) -> DataFrame:
    return V.program(case, "CertUtil.exe")["started"].select(F.unix_micros("timestamp").alias("at_us"), "pid", "image", "cmdline")


# ---- over literals


def over_rows(name: str, tables: dict, build, columns: str, kinds: str, rows: list[tuple]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(case_of(spark, tables)).select(*columns.split())
    ORACLE[name] = literal_sql(columns, dict(zip(columns.split(), kinds.split())), rows)


_MFT = {"mft": ("path size modified created is_dir is_deleted", [("Users/a/Temp/x/y.exe", 1, T, OLD, False, False), ("Windows/Fonts/f.EXE", 2, U, U, False, True), ("Windows/x.exe", 3, T, U, False, False), ("Users/a/Downloads/d.txt", 4, T, T, False, True), ("Users/a/Temp", 0, T, U, True, True), ("$Recycle.Bin/S-1/r.exe", 5, None, None, False, False), ("RECYCLER/r.exe", 6, T, T, False, False)])}
for _mode, _paths in (("suspicious", ("Windows/Fonts/f.EXE", "RECYCLER/r.exe", "Users/a/Temp/x/y.exe")), ("deleted", ("Windows/Fonts/f.EXE", "Users/a/Downloads/d.txt")), ("exec", ("Windows/Fonts/f.EXE", "RECYCLER/r.exe", "Users/a/Temp/x/y.exe", "Windows/x.exe", "$Recycle.Bin/S-1/r.exe")), ("timestomped", ("Windows/x.exe",))):
    over_rows(f"files_{_mode}", _MFT, lambda case, mode=_mode: V.files(case, mode), "path", "string", [(p,) for p in _paths])
over_rows("files_with_term", _MFT, lambda case: V.files(case, term="DOWNLOADS"), "path size", "string bigint", [("Users/a/Downloads/d.txt", 4)])
over_rows("files_recycle", {"recycle_bin": ("original_path deleted_at size sid", [("C:\\a", T, 1, "S"), ("C:\\b", U, 2, "S")])}, lambda case: V.files(case, "recycle", limit=1), "path modified size sid", "string timestamp bigint string", [("C:\\b", U, 2, "S")])
over_rows("files_links", {"lnk_files": ("path target_path modified args", [("a.lnk", "C:\\a", T, "-x")])}, lambda case: V.files(case, "lnk"), "path target_path modified args", "string string timestamp string", [("a.lnk", "C:\\a", T, "-x")])
over_rows("files_shellbags", {"shellbags": ("path last_modified user source", [("C:\\a", T, "ann", "NTUSER")])}, lambda case: V.files(case, "shellbags"), "path last_modified user source", "string timestamp string string", [("C:\\a", T, "ann", "NTUSER")])
over_rows("files_jumplists", {"jumplists": ("target_path app_name modified", [("C:\\a", "Word", T)])}, lambda case: V.files(case, "jumplists"), "path app_name modified", "string string timestamp", [("C:\\a", "Word", T)])
over_rows("files_journal", {"usnjrnl": ("path reason timestamp", [("a", "CLOSE", T), ("b", None, T)])}, lambda case: V.files(case, "usnjrnl"), "path reason modified", "string string timestamp", [("a", "CLOSE", T)])
over_rows("sysmon_process_stats", {"sysmon_process": ("image sha256 integrity_level", [("C:\\W\\CertUtil.exe", "aa", "High"), ("C:\\Temp\\a.exe", "", "Medium"), ("C:\\Temp\\a.exe", None, "System"), (None, None, None)])}, V.sysmon_process_stats, "total with_sha256 lolbins susp_path high_integrity unique_images", "bigint bigint bigint bigint bigint bigint", [(4, 1, 1, 2, 2, 2)])
over_rows("sysmon_network_stats", {"sysmon_network": ("dst_ip initiated", [("203.0.113.1", True), ("10.0.0.1", True), ("203.0.113.1", False), ("", True), (None, True)])}, V.sysmon_network_stats, "total outbound external unique_dst", "bigint bigint bigint bigint", [(5, 4, 1, 2)])
over_rows("sysmon_dns_stats", {"sysmon_dns": ("query_name query_status", [("a", "0"), ("a", "9003"), ("b", ""), ("c", None)])}, V.sysmon_dns_stats, "total unique_names failed", "bigint bigint bigint", [(4, 3, 1)])
over_rows("sysmon_imageload_stats", {"sysmon_imageload": ("image_loaded signed", [("C:\\Temp\\a.dll", True), ("C:\\b.dll", False), ("C:\\b.dll", None)])}, V.sysmon_imageload_stats, "total unsigned susp_path unique_dlls", "bigint bigint bigint bigint", [(3, 2, 1, 2)])
over_rows("kerberos_totals", {"kerberos_events": ("user encryption_type", [("a", "0x17"), ("a", "23"), ("b", "RC4-HMAC"), ("c", "0x12"), ("d", None)])}, V.kerberos_totals, "total rc4", "bigint bigint", [(5, 3)])
over_rows("kerberos_top", {"kerberos_events": ("user service_name encryption_type src_ip", [("a", "s", "0x12", "i"), ("a", "s", "0x12", "i"), ("b", "s", "0x12", "i")])}, lambda case: V.kerberos_top(case, 1), "user service_name n_rows", "string string bigint", [("a", "s", 2)])
over_rows("memory_summary", {"mem_pslist": ("pid name", [(10, "a.exe")]), "mem_psscan": ("pid name", [(10, "a.exe"), (11, "b.exe"), (12, "x"), (3, "low")]), "mem_cmdline": ("pid name", [(10, "a")])}, V.memory_summary, "name n_rows", "string bigint", [("pslist", 1), ("netscan", 0), ("malfind", 0), ("modules", 0), ("cmdline", 1), ("psscan", 4), ("driverscan", 0), ("hidden", 1)])
over_rows("usage_top_network", {"srum_network_usage": ("app_name bytes_sent bytes_recvd", [("a", 5, 5), ("a", 1, 0), ("b", 100, 1), ("", 999, 9), (None, 999, 9)])}, V.usage_top, "app_name total_bytes_sent total_bytes_recvd records", "string bigint bigint bigint", [("b", 100, 1, 1), ("a", 6, 5, 2)])
over_rows("usage_top_programs", {"srum_app_usage": ("app_name fg_cycles bg_cycles", [("a", 5, 5), ("b", 1, 1)])}, lambda case: V.usage_top(case, "srum_app_usage", 1), "app_name total_fg_cycles total_bg_cycles records", "string bigint bigint bigint", [("a", 5, 5, 1)])
over_rows("device_stats", {"usb_history": ("serial_number first_install last_arrival", [("s1", T, U), ("s1", OLD, None), ("s2", None, None)])}, V.device_stats, "total unique_devices first_seen last_seen", "bigint bigint timestamp timestamp", [(3, 2, OLD, U)])
over_rows("crash_stats", {"wer_crashes": ("app_name crash_time", [("a", T), ("a", U), ("b", None)])}, V.crash_stats, "total unique_apps first_crash last_crash", "bigint bigint timestamp timestamp", [(3, 2, T, U)])
over_rows("background_stats", {"bam_dam": ("path sid last_run", [("p", "S1", T), ("q", "S2", U)])}, V.background_stats, "total unique_sids first_run last_run", "bigint bigint timestamp timestamp", [(2, 2, T, U)])
over_rows("software_stats", {"installed_software": ("display_name publisher", [("a", "x"), ("b", "x"), ("c", None)])}, V.software_stats, "total unique_publishers", "bigint bigint", [(3, 1)])
over_rows("transfers_with_jobs", {"bits_jobs": ("job_guid job_name owner state_name created_at", [("j", "n", "o", "Queued", T)]), "bits_files": ("job_guid remote_url local_path", [("j", "http://x", "C:\\x"), ("z", "http://y", "C:\\y")])}, V.transfers, "job_name remote_url created_at", "string string timestamp", [("n", "http://x", T), (None, "http://y", None)])
over_rows("directory_stats", {"ntds_accounts": ("sam_account_name is_disabled is_deleted pwd_never_expires no_pwd_required bad_pwd_count", [("a", True, False, True, False, 2), ("b", False, False, False, True, 0), ("c", None, None, None, None, None)])}, V.directory_stats, "total disabled deleted never_expires no_password with_failures", "bigint bigint bigint bigint bigint bigint", [(3, 1, 0, 1, 1, 1)])
over_rows("event_at_time", {"evtx_events": ("event_id record_id timestamp", [(1, 5, T), (2, 4, T), (1, 3, U)])}, lambda case: V.event_at(case, T, 1), "event_id record_id", "int bigint", [(1, 5)])
over_rows("program_modules", {"sysmon_imageload": ("image image_loaded signed signature sha256 timestamp", [("C:\\A.exe", "x.dll", True, None, "h", U), ("C:\\a.exe", "x.dll", True, None, "h", T), ("C:\\b.exe", "x.dll", True, None, "h", T)])}, lambda case: V.program(case, "a.exe")["modules"], "image_loaded signature first_seen load_count", "string string timestamp bigint", [("x.dll", "", T, 2)])
over_rows("mail_with_parts", {"emails": ("id subject", [(1, "a"), (2, "b")]), "email_attachments": ("email_id filename", [(1, "f"), (2, "g")]), "email_urls": ("email_id url", [(1, "u")])}, lambda case: V.mail(case, 1)["attachments"], "email_id filename", "bigint string", [(1, "f")])

_CHAIN = {
    "proc_creation": ("timestamp image parent_image cmdline user_name", [(T, "C:\\x\\Evil.exe", "C:\\W\\cmd.exe", "evil -a", "ann"), (U, "C:\\W\\cmd.exe", "C:\\x\\evil.exe", "cmd", "ann"), (U, "C:\\W\\a.exe", "b.exe", "a --run evil.exe", None), ("1990-01-01 00:00:00", "evil.exe", "p", "c", "u"), (T, "C:\\other.exe", "p", "c", "u")]),
    "auth_events": ("timestamp event_id user src_ip logon_type process_name", [(T, 4624, "bob", "10.0.0.1", 3, "C:\\x\\evil.exe"), (T, 4624, "evil.exe", "-", 3, None), (T, 4624, "bob", "10.0.0.2", 3, "a.exe")]),
    "prefetch": ("last_run filename run_count path", [(U, "EVIL.EXE", 3, "\\x")]), "mem_pslist": ("pid name create_time threads handles", [(7, "evil.exe", T, 2, 3), (8, "ghost.exe", U, 1, 1), (9, "none.exe", T, 1, 1)]), "mem_cmdline": ("pid cmdline", [(7, "evil -a")]),
    "mem_malfind": ("pid name address size reason disasm", [(8, "ghost.exe", "0x1", 4096, "rwx", "nop"), (9, "none.exe", "0x2", 1, "x", "y")]), "browser_history": ("visit_time browser url title", [(T, "chrome", "http://x/evil.exe", "t"), (None, "chrome", "http://y/evil.exe", "t")]),
}
over_rows("chain_of_a_process", _CHAIN, lambda case: Ch.chain(case, "evil.exe (PID 8) @ 0x1"), "ts source severity action detail extra related user", "timestamp string string string string string string string", [
    (T, "auth", "", "Logon success", "User: bob · IP: 10.0.0.1", "Type 3 · C:\\x\\evil.exe", "", "bob"), (T, "browser", "", "Browser visit", "http://x/evil.exe", "t · chrome", "", ""), (T, "mem_pslist", "", "Process in RAM snapshot", "evil.exe (PID 7)", "Threads:2 Handles:3", "", "evil -a"),
    (T, "proc_creation", "", "Created (spawned by cmd.exe)", "C:\\x\\Evil.exe", "evil -a", "cmd.exe", "ann"), (U, "mem_pslist", "", "Process in RAM snapshot", "ghost.exe (PID 8)", "Threads:1 Handles:1", "", ""), (U, "prefetch", "", "Executed (prefetch)", "EVIL.EXE", "Runs: 3 · \\x", "", ""), (U, "proc_creation", "", "Process spawn", "C:\\W\\a.exe", "a --run evil.exe", "b.exe", ""), (U, "proc_creation", "", "Spawned cmd.exe", "C:\\W\\cmd.exe", "cmd", "evil.exe", "ann"), (None, "mem_malfind", "high", "RAM: Injected code region", "ghost.exe (PID 8) @ 0x1", "Size: 4096 · rwx", "", "nop"),
])


@over_data("chain_sources_of_a_tool", "SELECT 'proc_creation' AS source, count(*) AS n_rows FROM proc_creation WHERE \"timestamp\" BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2099-12-31' AND (contains(lower(coalesce(image, '')), 'certutil.exe') OR contains(lower(coalesce(parent_image, '')), 'certutil.exe') OR contains(lower(coalesce(cmdline, '')), 'certutil.exe')) HAVING count(*) > 0 UNION ALL SELECT 'mem_netscan', count(*) FROM mem_netscan WHERE created IS NOT NULL AND contains(lower(coalesce(name, '')), 'certutil.exe') HAVING count(*) > 0 UNION ALL SELECT 'browser', count(*) FROM browser_history WHERE visit_time IS NOT NULL AND (contains(lower(coalesce(url, '')), 'certutil.exe') OR contains(lower(coalesce(title, '')), 'certutil.exe')) HAVING count(*) > 0 UNION ALL SELECT 'auth', count(*) FROM auth_events WHERE \"timestamp\" IS NOT NULL AND (lower(coalesce(\"user\", '')) = 'certutil.exe' OR contains(lower(coalesce(process_name, '')), 'certutil.exe')) HAVING count(*) > 0")
def _(case: Case) -> DataFrame:
    return Ch.chain_sources(Ch.chain(case, "certutil.exe", None)).filter("source IN ('proc_creation', 'mem_netscan', 'browser', 'auth')")
