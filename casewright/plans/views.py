"""What a case viewer asks for: search, file lists, statistics of logons, watched processes, memory, devices and usage, and all there is about one program or account.

Lists are as long as a page bears (their limit is a parameter, ties ordered);
statistics are one pass over a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, ends, has, ordered, severity_rank, within
from ..schema import Case
from .library import listed, top

c = F.col

# Where a search looks: kind, table, columns searched, and what a hit shows (title, detail, ref) as SQL.
SEARCHED = (
    ("prefetch", "prefetch", ("filename", "path"), "filename", "path", "CAST(run_count AS string)"),
    ("event", "evtx_events", ("message", "user_sid"), "CAST(event_id AS string)", "message", "channel"),
    ("ioc", "ioc_indicators", ("value", "notes", "source"), "value", "notes", "source"),
    ("file", "mft", ("path",), "path", "''", "CAST(size AS string)"),
    ("persistence", "persistence", ("name", "command", "key_path"), "name", "command", "type"),
    ("network", "mem_netscan", ("remote_addr", "name"), "concat(remote_addr, ':', CAST(remote_port AS string))", "name", "proto"),
    ("auth", "auth_events", ("user", "src_ip", "workstation"), "coalesce(user, '?')", "concat(CAST(event_id AS string), coalesce(concat(' · ', src_ip), ''))", "CAST(timestamp AS string)"),
    ("defender", "defender_events", ("threat_name", "path", "sha256"), "coalesce(threat_name, 'Unknown')", "coalesce(path, '')", "CAST(timestamp AS string)"),
    ("proc_creation", "proc_creation", ("image", "cmdline", "parent_image", "user_name"), "image", "coalesce(cmdline, '')", "coalesce(user_name, '')"),
    ("sysmon", "sysmon_process", ("image", "cmdline", "parent_image", "sha256"), "coalesce(image, '')", "coalesce(cmdline, '')", "coalesce(user_name, '')"),
    ("browser", "browser_history", ("url", "title"), "url", "coalesce(title, '')", "browser"),
    ("registry", "registry_raw", ("key_path", "value_data", "value_name"), "key_path", "coalesce(value_data, '')", "value_name"),
)


def _holds(term: str, *columns: str) -> Column:
    """Any of the columns holds the term, whatever its case; null columns don't."""
    return any_of([F.coalesce(has(n, term.lower()), F.lit(False)) for n in columns])


def search(case: Case, term: str, per_kind: int | None = 50) -> DataFrame:
    """kind, title, detail, ref of what holds the term, at most so many of each kind (None: all). Terms of less than two letters are refused."""
    if len(term) < 2:
        raise ValueError("search for at least two letters")
    lines = case["mem_cmdline"].select("pid", "cmdline")
    ps = case["mem_pslist"].join(lines, "pid", "left").filter(_holds(term, "name", "cmdline")).selectExpr("'process' AS kind", "name AS title", "coalesce(cmdline, '') AS detail", "CAST(pid AS string) AS ref")
    parts = [ps]
    for kind, table, columns, title, detail, ref in SEARCHED:
        parts.append(case[table].filter(_holds(term, *columns)).selectExpr(f"'{kind}' AS kind", f"{title} AS title", f"{detail} AS detail", f"{ref} AS ref"))
    if per_kind is not None:
        parts = [p.orderBy("title", "detail", "ref").limit(per_kind) for p in parts]
    return reduce(DataFrame.unionByName, parts)


# Endings of programs, and (folder, endings) of files that are suspicious there.
PROGRAM_ENDINGS = (".exe", ".dll", ".bat", ".ps1", ".vbs", ".scr", ".com", ".pif")
SUSPICIOUS_FILES = (("/temp/", (".exe", ".dll", ".bat", ".ps1", ".vbs", ".hta")), ("/appdata/roaming/", (".exe",)), ("/downloads/", (".exe", ".dll")), ("/public/", (".exe",)), ("/windows/tasks/", (".exe", ".ps1")), ("/programdata/", (".exe",)), ("/perflogs/", (".exe",)), ("/windows/fonts/", (".exe",)), ("/windows/help/", (".exe",)), ("/recycle…/", (".exe",)))


def files(case: Case, mode: str = "suspicious", term: str | None = None, limit: int | None = 500) -> DataFrame:
    """Files by one of nine modes, newest first: suspicious, deleted, exec, timestomped, lnk, recycle, shellbags, jumplists, usnjrnl. A term searches all files instead."""
    shown = {"lnk": ("lnk_files", "modified", ["path", "target_path", "created", "modified", "args", "machine_id"]), "recycle": ("recycle_bin", "modified", ["original_path AS path", "deleted_at AS modified", "size", "sid"]), "shellbags": ("shellbags", "last_modified", ["path", "last_modified", "user", "source"]), "jumplists": ("jumplists", "modified", ["target_path AS path", "app_name", "created", "modified", "accessed"]), "usnjrnl": ("usnjrnl", "modified", ["path", "reason", "timestamp AS modified"])}
    if term is None and mode in shown:
        table, seen, columns = shown[mode]
        df = case[table].filter("reason IS NOT NULL") if mode == "usnjrnl" else case[table]
        out = df.selectExpr(*columns)
    else:
        seen = "modified"
        own = case["mft"].filter(~c("is_dir"))
        tests = {
            "deleted": lambda: c("is_deleted"),
            "exec": lambda: ends("path", *PROGRAM_ENDINGS),
            "timestomped": lambda: c("created") > c("modified"),
            "suspicious": lambda: any_of([ordered(F.concat(F.lit("/"), c("path")), *[f"{folder}…{e}" for e in endings]) & ends("path", *endings) for folder, endings in SUSPICIOUS_FILES]),
        }
        if term is None and mode not in tests:
            raise ValueError(f"unknown mode {mode}")
        out = own.filter(has("path", term.lower()) if term is not None else tests[mode]()).select("path", "size", "modified", "created", "is_deleted")
    ranked = out.orderBy(c(seen).desc_nulls_last(), "path")
    return ranked.limit(limit) if limit else ranked


# ---- statistics


def _named(df: DataFrame, **counts: Column) -> DataFrame:
    """One row of counts in one pass."""
    return df.agg(*[x.cast("bigint").alias(n) for n, x in counts.items()])


def _account() -> Column:
    return (c("user") != "") & ~c("user").startswith("S-1-")


def _address() -> Column:
    return ~c("src_ip").isin("", "-")


def logon_totals(case: Case) -> DataFrame:
    """total, failed, unique_users, unique_ips of logon events, in one pass."""
    return _named(case["auth_events"], total=F.count(F.lit(1)), failed=F.count_if(c("event_id") == 4625), unique_users=F.countDistinct(F.when(_account(), c("user"))), unique_ips=F.countDistinct(F.when(_address(), c("src_ip"))))


def logon_top(case: Case, of: str, failed: bool = False, n: int = 15) -> DataFrame:
    """The most frequent users or addresses (of = 'user' or 'src_ip') of all or failed logon events."""
    rows = case["auth_events"].filter(_account() if of == "user" else _address())
    return top(rows.filter("event_id = 4625") if failed else rows, c(of), n, of)


def logon_event_counts(case: Case) -> DataFrame:
    return case["auth_events"].groupBy("event_id").agg(F.count(F.lit(1)).alias("n_rows"))


def logon_type_breakdown(case: Case) -> DataFrame:
    """Events, successes, failures and users of each logon type."""
    typed = case["auth_events"].filter(c("logon_type") != 0)
    return typed.groupBy(c("logon_type").cast("string").alias("logon_type")).agg(F.count(F.lit(1)).alias("total"), F.count_if(c("event_id") == 4624).alias("successes"), F.count_if(c("event_id") == 4625).alias("failures"), F.countDistinct("user").alias("unique_users"))


def new_credential_logons(case: Case) -> DataFrame:
    """Users and addresses of logons with new credentials (type 9)."""
    return case["auth_events"].filter((c("logon_type") == 9) & _account()).groupBy("user", "src_ip").agg(F.count(F.lit(1)).alias("n_rows"), F.max("timestamp").alias("last_seen"))


def kerberos_totals(case: Case) -> DataFrame:
    """All tickets and those of the weak cipher."""
    weak = has("encryption_type", "rc4", "0x17") | (c("encryption_type") == "23")
    return _named(case["kerberos_events"], total=F.count(F.lit(1)), rc4=F.count_if(weak))


def kerberos_top(case: Case, n: int = 10) -> DataFrame:
    keys = ["user", "service_name", "encryption_type", "src_ip"]
    return case["kerberos_events"].groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(c("n_rows").desc(), *keys).limit(n)


# Programs and folders the watched processes are counted by.
_LOLBINS = tuple(f"{n}.exe" for n in ("certutil", "mshta", "regsvr32", "wscript", "cscript", "rundll32", "msiexec", "bitsadmin", "wmic", "msbuild", "cmstp"))
_FOLDERS = ("/temp/", "/downloads/", "/appdata/", "/programdata/", "/public/")


def _external() -> Column:
    private = any_of([c("dst_ip").startswith(x) for x in ("10.", "192.168.", "172.1", "172.2", "172.3")]) | (c("dst_ip") == "127.0.0.1")
    return c("initiated") & ~c("dst_ip").isin("0.0.0.0", "-", "") & ~private


def sysmon_process_stats(case: Case) -> DataFrame:
    return _named(case["sysmon_process"], total=F.count(F.lit(1)), with_sha256=F.count_if(c("sha256") != ""), lolbins=F.count_if(ends("image", *_LOLBINS)), susp_path=F.count_if(within("image", *_FOLDERS)), high_integrity=F.count_if(c("integrity_level").isin("High", "System")), unique_images=F.countDistinct("image"))


def sysmon_network_stats(case: Case) -> DataFrame:
    return _named(case["sysmon_network"], total=F.count(F.lit(1)), outbound=F.count_if(c("initiated")), external=F.count_if(_external()), unique_dst=F.countDistinct(F.when(c("dst_ip") != "", c("dst_ip"))))


def sysmon_dns_stats(case: Case) -> DataFrame:
    return _named(case["sysmon_dns"], total=F.count(F.lit(1)), unique_names=F.countDistinct("query_name"), failed=F.count_if(~c("query_status").isin("0", "")))


def sysmon_imageload_stats(case: Case) -> DataFrame:
    """Modules without a word on their signature count as unsigned."""
    return _named(case["sysmon_imageload"], total=F.count(F.lit(1)), unsigned=F.count_if(~F.coalesce("signed", F.lit(False))), susp_path=F.count_if(within("image_loaded", "/temp/", "/appdata/", "/programdata/")), unique_dlls=F.countDistinct("image_loaded"))


def memory_summary(case: Case) -> DataFrame:
    """Rows of each memory table, and processes only the pool scan knows."""
    tables = ("pslist", "netscan", "malfind", "modules", "cmdline", "psscan", "driverscan")
    counts = [case[f"mem_{t}"].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("name"), "n_rows") for t in tables]
    hidden = case["mem_psscan"].filter(c("pid").between(4, 131072) & (F.length("name") >= 3)).join(case["mem_pslist"].select("pid"), "pid", "left_anti").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("hidden").alias("name"), "n_rows")
    return reduce(DataFrame.unionByName, [*counts, hidden])


def remote_access_stats(case: Case) -> DataFrame:
    """Sessions of the remote-access tool by direction, partners, first and last."""
    return case["anydesk_sessions"].agg(F.count(F.lit(1)).alias("total_sessions"), F.count_if(c("direction") == "Incoming").alias("incoming"), F.count_if(c("direction") == "Outgoing").alias("outgoing"), F.countDistinct("anydesk_id").alias("unique_ids"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def usage_top(case: Case, table: str = "srum_network_usage", n: int = 20) -> DataFrame:
    """Programs by bytes (srum_network_usage) or processor cycles (srum_app_usage)."""
    a, b = ("bytes_sent", "bytes_recvd") if table == "srum_network_usage" else ("fg_cycles", "bg_cycles")
    agg = case[table].filter(c("app_name") != "").groupBy("app_name").agg(F.sum(a).alias(f"total_{a}"), F.sum(b).alias(f"total_{b}"), F.count(F.lit(1)).alias("records"))
    return agg.orderBy((c(f"total_{a}") + c(f"total_{b}")).desc_nulls_last(), "app_name").limit(n)


def _spans(case: Case, table: str, key: str, name: str, first: str, last: str, named: tuple[str, str]) -> DataFrame:
    return case[table].agg(F.count(F.lit(1)).alias("total"), F.countDistinct(key).alias(name), F.min(first).alias(named[0]), F.max(last).alias(named[1]))


def device_stats(case: Case) -> DataFrame:
    return _spans(case, "usb_history", "serial_number", "unique_devices", "first_install", "last_arrival", ("first_seen", "last_seen"))


def crash_stats(case: Case) -> DataFrame:
    return _spans(case, "wer_crashes", "app_name", "unique_apps", "crash_time", "crash_time", ("first_crash", "last_crash"))


def background_stats(case: Case) -> DataFrame:
    return _spans(case, "bam_dam", "sid", "unique_sids", "last_run", "last_run", ("first_run", "last_run"))


def software_stats(case: Case) -> DataFrame:
    return _named(case["installed_software"], total=F.count(F.lit(1)), unique_publishers=F.countDistinct("publisher"))


def transfers(case: Case) -> DataFrame:
    """Transferred files with their job, newest job first."""
    jobs = case["bits_jobs"].select("job_guid", "job_name", "owner", "state_name", "created_at")
    return case["bits_files"].join(jobs, "job_guid", "left").select("created_at", "job_name", "owner", "state_name", "remote_url", "local_path", "bytes_total", "bytes_xferred", "pct_complete").orderBy(c("created_at").desc_nulls_last(), "remote_url")


def directory_stats(case: Case) -> DataFrame:
    """Accounts of the directory, and how many are disabled, deleted, without expiry of or need for a password, or have failed."""
    return _named(case["ntds_accounts"], total=F.count(F.lit(1)), disabled=F.count_if(c("is_disabled")), deleted=F.count_if(c("is_deleted")), never_expires=F.count_if(c("pwd_never_expires")), no_password=F.count_if(c("no_pwd_required")), with_failures=F.count_if(c("bad_pwd_count") > 0))


# ---- one program, account, event, mail

# Pieces (parted by …) of scripts that hide what they do.
OBFUSCATION = ("frombase64", "encodedcommand", "invoke-expression", "-enc ", "[char]", "downloadstring", "new-object…webclient", "iex", "bypass", "shellcode", "reflection.assembly", "marshal", "-w hidden", "lsass")


def scripts(case: Case, term: str | None = None, hiding: bool = False, limit: int | None = 300) -> DataFrame:
    """Script blocks, newest first, with their first 3,000 letters and whole length."""
    df = case["ps_scriptblock"]
    if term:
        df = df.filter(_holds(term, "script_text", "path"))
    if hiding:
        df = df.filter(ordered("script_text", *OBFUSCATION))
    out = df.select("timestamp", "script_id", "path", "level", "computer", F.left("script_text", F.lit(3000)).alias("preview"), F.length("script_text").alias("total_len"))
    ranked = out.orderBy(c("timestamp").desc_nulls_last(), "script_id", "preview")
    return ranked.limit(limit) if limit else ranked


def program(case: Case, image: str, findings: DataFrame | None = None) -> dict[str, DataFrame]:
    """All there is about a program, by section: its starts, children, connections, modules, files, names asked for, traces, findings."""
    base = image.replace("/", "\\").rsplit("\\", 1)[-1]
    own = lambda t: case[t].filter(_holds(image, "image")).orderBy("timestamp")
    found = findings if findings is not None else case["ioc_indicators"]
    return {
        "self": own("sysmon_process").select("timestamp", "pid", "ppid", "image", "cmdline", "parent_image", "user_name", "integrity_level", "sha256"),
        "children": case["sysmon_process"].filter(_holds(image, "parent_image")).orderBy("timestamp").select("timestamp", "pid", "image", "cmdline", "user_name", "integrity_level"),
        "network": own("sysmon_network").select("timestamp", "dst_ip", "dst_port", F.coalesce("dst_host", F.lit("")).alias("dst_host"), "proto", "initiated"),
        "modules": case["sysmon_imageload"].filter(_holds(image, "image")).groupBy("image_loaded", "signed", F.coalesce("signature", F.lit("")).alias("signature"), "sha256").agg(F.min("timestamp").alias("first_seen"), F.count(F.lit(1)).alias("load_count")).orderBy("signed", "image_loaded"),
        "files": own("sysmon_file").select("timestamp", "target_filename"),
        "names": own("sysmon_dns").select("timestamp", "query_name", F.coalesce("query_results", F.lit("")).alias("query_results")),
        "prefetch": case["prefetch"].filter(_holds(base, "filename")).select("filename", "run_count", "last_run", "path"),
        "amcache": case["amcache"].filter(_holds(image, "path")).select("path", "sha256", "first_seen", F.coalesce("publisher", F.lit("")).alias("publisher")),
        "findings": found.filter(_holds(base, "value") | _holds(image, "notes")).orderBy(severity_rank("confidence").desc(), "source", "value").select("type", "value", "source", "confidence", F.coalesce("notes", F.lit("")).alias("notes"), "first_seen"),
        "started": own("proc_creation").select("timestamp", "pid", "ppid", "image", "cmdline", "parent_image", "user_name", "integrity_level"),
    }


def account(case: Case, user: str, findings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Processes, logons and findings of an account."""
    found = findings if findings is not None else case["ioc_indicators"]
    return {"processes": listed(case, "proc_creation", user, ("user_name",), "timestamp", 500), "logons": listed(case, "auth_events", user, ("user",), "timestamp", 500), "findings": found.filter(_holds(user, "value", "notes")).limit(100)}


def event_at(case: Case, at: str, event_id: int | None = None) -> DataFrame:
    """The event of an exact time (and number); nothing for a text that is no time."""
    df = case["evtx_events"].filter(c("timestamp") == F.lit(at).try_cast("timestamp"))
    return (df.filter(c("event_id") == event_id) if event_id is not None else df).orderBy("record_id").limit(1)


def mail(case: Case, ident: int) -> dict[str, DataFrame]:
    """A mail with its attachments and addresses."""
    return {"mail": case["emails"].filter(c("id") == ident), "attachments": case["email_attachments"].filter(c("email_id") == ident), "urls": case["email_urls"].filter(c("email_id") == ident)}


def top_senders(case: Case, n: int = 15) -> DataFrame:
    return top(case["emails"].filter("from_addr <> ''"), F.lower("from_addr"), n, "sender")


__all__ = [n for n in dir() if not n.startswith("_")]
