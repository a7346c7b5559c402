"""The built-in detectors, by kind of artifact.

Each is a declaration over one or more tables of a case; Catalyst plans all of
them as one union. Paths are compared in one spelling (lower case, forward
slashes), names by their last component, and text literally.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import all_of, any_of, basename, ends, has, is_base, joined, low, ordered, recent, slashed, starts, within
from ..schema import Case
from .findings import Counted, Detector, Rows, counted, fused, rows, union

c = F.col

# Program groups the detectors name.
SHELLS = ("cmd", "powershell", "pwsh", "wscript", "cscript", "mshta")
OFFICE = ("winword", "excel", "powerpnt", "outlook", "msaccess")
BROWSERS = ("chrome", "firefox", "msedge", "iexplore", "opera")
SYSTEM = ("svchost", "lsass", "csrss", "smss", "winlogon", "services", "spoolsv", "wininit", "lsm", "taskhost", "taskhostw", "dllhost", "conhost", "explorer")
SYSTEM_FOLDERS = ("/system32/", "/syswow64/", "/winsxs/", "/windows/explorer")
LOLBINS = ("certutil", "mshta", "regsvr32", "wscript", "cscript", "msiexec", "installutil", "regasm", "regsvcs", "odbcconf")
TEMPS = ("/temp/", "/tmp/", "/downloads/", "/desktop/", "/appdata/local/temp/")
VIRTUAL_ACCOUNTS = ("local service", "network service", "anonymous logon")


def _text(*parts: str | Column) -> Column:
    """Texts and columns in one; null where a column is."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _or(name: str, other: str = "?") -> Column:
    return F.coalesce(c(name).cast("string"), F.lit(other))


def _cut(name: str, size: int) -> Column:
    return F.left(c(name), F.lit(size))


def _command() -> Column:
    """The command line, or the image where there is none."""
    return F.coalesce(F.nullif(c("cmdline"), F.lit("")), c("image"))


def _last(name: str) -> Column:
    return F.substring_index(name, "\\", -1)


def _app() -> Column:
    return F.coalesce(F.nullif(c("app_name"), F.lit("")), c("app_id"))


# The evidence each finding is reported with.
NOTES: dict = {
    "defender_detection": lambda: _text(c("threat_name"), " [", c("severity"), "] action=", c("action")),
    "pif_scr_user": "PIF/SCR in user dir — classic dropper extension",
    "hta_script_user": "Scripting engine file in user dir",
    "exe_user_docs": "Executable in user data directory",
    "log_cleared": lambda: _text("Log cleared on ", c("computer"), " channel=", c("channel")),
    "defender_tamper": lambda: _cut("message", 200),
    "new_service": lambda: _cut("message", 200),
    "scheduled_task": lambda: _cut("message", 200),
    "user_created": lambda: _cut("message", 200),
    "privilege_group": lambda: _cut("message", 200),
    "explicit_credentials": lambda n, a, b: _text("Explicit creds ×", n, " from ", F.array_join(a, ","), " workstation=", F.array_join(b, ",")),
    "brute_force": lambda n, a, b: _text("Brute force: ", n, " failed logons"),
    "encoded_powershell": lambda: _text("Encoded PS from PID ", c("pid"), " parent=", c("ppid")),
    "temp_execution": lambda: _text("Cmdline: ", _cut("cmdline", 200)),
    "ram_tools": "Memory/credential tool present on disk",
    "sticky_keys": "Accessibility binary modified — possible backdoor replacement",
    "malfind_injection": lambda: _text("Malfind: ", c("reason")),
    "network_injection": lambda: _text("Injected process with network connections — C2 indicator: exec+write VAD @ ", c("address")),
    "hidden_process": "DKOM: process in pool scan but not in ActiveProcessLinks — possible rootkit",
    "suspicious_ppid": lambda: _text("Unexpected parent-child: ", c("name"), " spawned by ", c("p_name")),
    "masquerade_path": "System process not in expected path — possible masquerade/hollowing",
    "cmdline_obfuscation": "Obfuscated or LOLBin command line detected",
    "amcache_ghost": "Executed file no longer on disk (amcache without MFT entry)",
    "wmi_subscription": lambda: _text("WMI subscription: ", c("consumer_type"), " query=", _cut("filter_query", 100)),
    "certutil_download": "certutil used to download files — common malware dropper technique",
    "mshta_http": "mshta loading remote script — common phishing/execution technique",
    "regsvr32_scrobj": "regsvr32 loading scrobj.dll or remote COM script (Squiblydoo)",
    "shadow_copy_deletion": "Volume shadow copy deletion — ransomware precursor or anti-forensics",
    "bits_job_download": "BITS job used to transfer files — can be abused for persistence and C2",
    "run_key_persistence": "Registry Run key modified — common persistence mechanism",
    "lolbin_wscript": "wscript/cscript executing scripts from user-writable location",
    "defender_tamper_ps": "Defender real-time protection disabled via PowerShell",
    "ssh_bruteforce": lambda n, a, b: _text("SSH brute force: ", n, " failed attempts"),
    "new_authorized_key": lambda: _text("SSH authorized_key entry: ", c("details")),
    "root_crontab": lambda: _text("root crontab: ", c("details"), " @ ", c("path")),
    "usnjrnl_mass_delete": lambda: _text(c("n"), " FILE_DELETE events in $UsnJrnl"),
    "usnjrnl_ransomware_ext": lambda n, a, b: _text("Suspicious extension created: ", c("value")),
    "new_interactive_user": lambda: c("details"),
    "shell_download_exec": "download+execute in shell history",
    "shell_reverse_shell": "reverse shell in shell history",
    "amcache_suspicious_path": "Executed from suspicious path (amcache)",
    "shimcache_suspicious_path": "Shimcache entry from suspicious path",
    "wmi_persistence": lambda: _text("WMI subscription: ", c("consumer_type"), " filter=", c("filter_name")),
    "ps_scriptblock_download_cradle": "PS download cradle or obfuscation detected",
    "shell_antiforensics": "anti-forensics in shell history",
    "recycle_bin_exe": lambda: _text("Executable/script deleted via Recycle Bin (", c("i_file"), ")"),
    "userassist_suspicious_path": lambda: _text("UserAssist execution from suspicious path, runs=", c("run_count")),
    "bam_suspicious_path": "BAM/DAM execution from suspicious path",
    "jumplists_suspicious_target": lambda: _text("JumpList entry from suspicious path (app=", _app(), ")"),
    "jumplists_high_access": lambda: _text("Frequently opened via JumpList: ", c("access_count"), " times (app=", _app(), ")"),
    "shellbags_network_share": lambda: _text("User browsed network location (shellbags): user=", _or("user", "-")),
    "shellbags_suspicious_path": lambda: _text("Shellbag entry from suspicious path — folder may have been deleted: user=", _or("user", "-")),
    "pass_the_hash": lambda n, a, b: _text("Pass-the-Hash: ", n, " explicit credential events, src=", F.array_join(a, ", ")),
    "hollow_process": "Process in memory has no prefetch and no amcache match — possible process hollowing",
    "kerberoasting": "Kerberos 4769 with RC4 (etype 0x17) — possible Kerberoasting",
    "dcsync_attack": "DCSync: event 4662 with DS-Replication-Get-Changes — may indicate credential dump",
    "ntds_exfil": "NTDS.dit extraction — domain credential dump technique",
    "uac_bypass_registry": "UAC bypass: HKCU registry shell command hijack for auto-elevated binary",
    "lsass_targeted_access": "Cmdline targeting lsass.exe — credential dumping indicator",
    "rdp_brute_force": lambda n, a, b: _text("RDP brute force: ", n, " failures (logon_type=10)"),
    "suspicious_parent_child": lambda: _text("Suspicious parent→child: ", c("p_name"), " spawned ", c("name"), " — phishing indicator"),
    "process_masquerade": "System process name outside System32/SysWOW64 — possible masquerade/LOLBin abuse",
    "discovery_recon": "Post-exploitation recon command in live process cmdline",
    "asrep_roasting": lambda n, a, b: _text("AS-REP Roasting: event 4768 with no Kerberos pre-authentication required — ", n, " events"),
    "sysmon_office_spawn": lambda: _text("Sysmon1: shell spawned by ", _last("parent_image"), " parent_cmd=", F.left(_or("parent_cmdline", ""), F.lit(150))),
    "sysmon_encoded_ps": lambda: _text("Sysmon1: encoded PS sha256=", _or("sha256", "")),
    "sysmon_lolbin": lambda: _text("Sysmon1: LOLBin sha256=", _or("sha256", ""), " user=", _or("user_name", "")),
    "sysmon_susp_path": lambda: _text("Sysmon1: exec from writable path sha256=", _or("sha256", "")),
    "sysmon_network_external": lambda: _text("Sysmon3: outbound by ", _last("image"), ":", c("dst_port"), " user=", _or("user_name", "")),
    "sysmon_dns_suspicious": lambda: _text("Sysmon22: DNS by ", _last("image"), " results=", F.left(_or("query_results", ""), F.lit(80))),
    "sysmon_unsigned_dll": lambda: _text("Sysmon7: unsigned DLL in ", _last("image"), " sha256=", _or("sha256", "")),
    "sysmon_masquerade_sysname": lambda: _text("Sysmon1: system name outside System32 sha256=", _or("sha256", "")),
    "proc_create_lolbin": lambda: _text("LOLBin via event 4688: ", _command()),
    "proc_create_susp_parent": lambda: _text("Shell spawned by Office/browser via 4688 — parent=", _or("parent_image"), " cmd=", _command()),
    "proc_create_susp_path": lambda: _text("Executable from suspicious write location: ", _command()),
    "wannacry_file_indicators": "Known WannaCry file or encrypted output on disk",
    "ransomware_ext_usnjrnl": "WannaCry encrypted file extension detected in $UsnJrnl",
    "anomalous_routing_svc": "",
    "mssql_attack_surface": "",
    "service_binary_wannacry_ts": "Service binary matches known WannaCry filenames (mssecsvc/tasksche)",
    "anon_smb_cluster": lambda n, a, b: _text("Anonymous SMB logon cluster: ", n, " events (logon_type=3, null session)"),
    "event_log_gap": lambda: _text("Log gap of ", c("gap"), " days in channel=", c("channel"), " (last event before gap: ", c("before"), ")"),
    "anydesk_incoming_session": lambda: _text("AnyDesk remote session: auth=", _or("auth_method"), " alias=", _or("client_alias"), " id=", _or("anydesk_id"), " file=", _or("source_file")),
    "anydesk_unattended_config": lambda: _text("AnyDesk unattended access config: ", c("key"), "=", c("value"), " [", c("source_file"), "]"),
    "wer_crash_suspicious_app": lambda: _text("Process crash: ", _or("app_name"), " fault_module=", _or("fault_module"), " exception=", _or("exception_code"), " at offset=", _or("exception_offset")),
    "dhcp_network_config": lambda: _text("DHCP/network event ", c("event_id"), ": ", _cut("message", 300)),
    "bits_suspicious_download": lambda: _text("BITS job: ", _or("job_name"), " | owner=", _or("owner"), " | state=", _or("state_name")),
    "ad_accounts_with_old_logon": lambda: _text("AD account | disabled=", c("is_disabled"), " | bad_pwd=", _or("bad_pwd_count", "0"), " | flags=", _or("account_flags", "0")),
}

DETECTORS: list[Detector] = []


def add(ident: str, severity: str, kind: str, technique: str | None, build, requires: tuple[str, ...] = ()) -> None:
    DETECTORS.append(Detector(ident, severity, kind, technique, build, requires, NOTES[ident]))


def exe(*names: str) -> list[str]:
    return [f"{n}.exe" for n in names]


def pid_name(prefix: str = "") -> Column:
    return F.concat(c(prefix + "name"), F.lit(" (PID "), c(prefix + "pid").cast("string"), F.lit(")"))


def event(ident: str, severity: str, technique: str, *ids: int) -> None:
    add(ident, severity, "event", technique, rows("evtx_events", lambda: c("event_id").isin(*ids) & recent("timestamp"), lambda: c("event_id").cast("string"), "timestamp", distinct=False))


def file(ident: str, severity: str, technique: str | None, where, table: str = "mft", path: str = "path", seen: str | None = "modified", distinct: bool = False, requires: tuple[str, ...] = ()) -> None:
    test = (lambda: ~c("is_dir") & where() & recent("modified")) if table == "mft" else where
    add(ident, severity, "file", technique, rows(table, test, lambda: c(path), seen, distinct), requires)


def command(ident: str, severity: str, label: str, where) -> None:
    """Command lines in memory, each once."""
    add(ident, severity, "process", None, rows("mem_cmdline", where, lambda: F.concat(F.lit(label + ": "), c("cmdline"))))


def shell(ident: str, where) -> None:
    add(ident, "HIGH", "process", None, rows("shell_history", where, lambda: F.left(c("command"), F.lit(200)), "timestamp"))


# ---- files on disk

add("defender_detection", "HIGH", "file", "T1059", rows("defender_events", lambda: (c("threat_name") != "") & recent("timestamp"), lambda: c("path"), "timestamp", distinct=False))
file("pif_scr_user", "HIGH", "T1204.002", lambda: ends("path", ".pif", ".scr") & within("path", "/users/"))
file("hta_script_user", "HIGH", "T1059.005", lambda: ends("path", ".hta", ".vbs", ".vbe", ".jse", ".wsh", ".wsf") & within("path", "/users/"))
file("exe_user_docs", "HIGH", "T1204.002", lambda: ends("path", ".exe", ".dll", ".com") & within("path", "/users/") & within("path", "/documents/", "/downloads/", "/desktop/"))
file("ram_tools", "HIGH", "T1003", lambda: has("path", "winpmem", "dumpit", "rammap", "ftkimager", "procdump", "lsass.dmp", "mimikatz", "wce.exe", "pwdump", "gsecdump"))
file("sticky_keys", "HIGH", "T1546.008", lambda: within("path", "/sethc.", "/utilman.", "/osk.", "/magnify.", "/narrator.", "/displayswitch.", "/atbroker.") & ends("path", ".bak", ".old", ".backup", ".exe"))
file("wannacry_file_indicators", "HIGH", "WannaCry/T1486", lambda: has("path", "mssecsvc.exe", "tasksche.exe", "wannacry", "wncry", "@please_read_me@", "@wannadecryptor@", "00000000.eky", "00000000.res", "00000000.pky"), distinct=True)
file("amcache_suspicious_path", "HIGH", None, lambda: within("path", *TEMPS, "/appdata/roaming/") & ends("path", ".exe"), "amcache", seen="first_seen", distinct=True)
file("shimcache_suspicious_path", "HIGH", None, lambda: within("path", *TEMPS) & ends("path", ".exe"), "shimcache", seen="last_modified", distinct=True)
file("recycle_bin_exe", "MED", None, lambda: ends("original_path", ".exe", ".dll", ".bat", ".ps1", ".vbs", ".hta", ".js"), "recycle_bin", "original_path", "deleted_at", True)
file("jumplists_suspicious_target", "HIGH", None, lambda: within("target_path", "/temp/", "/appdata/local/temp/", "/downloads/", "/public/", "/recycle"), "jumplists", "target_path", "accessed", True)
file("jumplists_high_access", "MED", None, lambda: (c("access_count") > 20) & (c("target_path") != ""), "jumplists", "target_path", "accessed", True)
file("shellbags_suspicious_path", "HIGH", None, lambda: within("path", "/temp/", "/tmp/", "/appdata/local/temp", "/downloads/", "/recycle", "/public/"), "shellbags", seen="last_modified", distinct=True)
add("shellbags_network_share", "HIGH", "network", None, rows("shellbags", lambda: (slashed("path").startswith("//") | has("path", "network", "\\\\server")) & (c("item_type") == "network"), lambda: c("path"), "last_modified"))
file("process_masquerade", "HIGH", "T1036.005", lambda: any_of([slashed("path").endswith(f"/{n}.exe") for n in SYSTEM]) & ~within("path", *SYSTEM_FOLDERS), "amcache", seen="first_seen", distinct=True)
add("usnjrnl_ransomware_ext", "HIGH", "file", None, counted("usnjrnl", lambda: c("reason").contains("FILE_CREATE") & ends("path", ".locked", ".encrypted", ".enc", ".crypt", ".crypted", ".ransom", ".pays", ".wncry", ".wcry", ".zepto", ".locky", ".cerber"), ["path"], lambda: c("path"), 1))
add("ransomware_ext_usnjrnl", "HIGH", "file", "WannaCry/T1486", counted("usnjrnl", lambda: ends("path", ".wncry", ".wcry"), ["path"], lambda: c("path"), 1))


def mass_delete(case: Case) -> DataFrame:
    total = case["usnjrnl"].filter(c("reason").contains("FILE_DELETE")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"))
    return total.filter("n >= 100").select(F.lit("mass_file_deletion").alias("value"), "first_seen", "n")


add("usnjrnl_mass_delete", "HIGH", "host", None, mass_delete)


def amcache_ghost(case: Case) -> DataFrame:
    """Programs the application cache knows and the file table doesn't."""
    there = case["mft"].select(slashed("path").alias("_k")).distinct()
    gone = case["amcache"].filter(recent("first_seen")).withColumn("_k", slashed("path")).join(there, "_k", "left_anti")
    return gone.select(c("path").alias("value"), "first_seen")


add("amcache_ghost", "MED", "file", "T1070.004", amcache_ghost, ("amcache", "mft"))

# ---- event logs

event("log_cleared", "HIGH", "T1070.001", 1102, 1100)
event("defender_tamper", "HIGH", "T1562.001", 5001, 5004, 5007, 5010, 5012, 3002)
event("new_service", "HIGH", "T1543.003", 7045)
event("scheduled_task", "MED", "T1053.005", 4698, 4702)
event("user_created", "HIGH", "T1136.001", 4720)
event("privilege_group", "HIGH", "T1098", 4732, 4756)
add("run_key_persistence", "HIGH", "registry", None, counted("evtx_events", lambda: (c("event_id") == 13) & within("message", "/currentversion/run"), [lambda: F.left(c("message"), F.lit(200)).alias("message")], lambda: F.concat(F.lit("run key: "), F.left(c("message"), F.lit(200))), 1))
add("kerberoasting", "HIGH", "auth", "T1558.003", counted("evtx_events", lambda: (c("event_id") == 4769) & (c("message").contains("0x17") | c("message").contains("23")) & recent("timestamp"), ["event_id"], lambda: c("event_id").cast("string"), 1))
add("dcsync_attack", "HIGH", "auth", "T1003.006", counted("evtx_events", lambda: (c("event_id") == 4662) & (c("message").contains("Replication-Get-Changes") | c("message").contains("1131f6a")) & recent("timestamp"), ["event_id"], lambda: c("event_id").cast("string"), 1))
add("asrep_roasting", "HIGH", "auth", "T1558.004", counted("evtx_events", lambda: (c("event_id") == 4768) & c("message").contains("0x0") & recent("timestamp"), ["event_id"], lambda: c("event_id").cast("string"), 1))


def log_gap(case: Case) -> DataFrame:
    """Channels silent for more than seven calendar days."""
    order = W.partitionBy("channel").orderBy("timestamp")
    # one row per channel and day: what is ordered per channel is bounded by days, not by events
    days = case["evtx_events"].filter(recent("timestamp")).groupBy("channel", F.to_date("timestamp").alias("day")).agg(F.min("timestamp").alias("timestamp"), F.max("timestamp").alias("last"))
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(order))).withColumn("before", F.lag("last").over(order)).filter("gap > 7")
    return gaps.select(F.concat(F.lit("log_gap:"), c("channel")).alias("value"), c("timestamp").alias("first_seen"), "gap", "channel", "before")


add("event_log_gap", "HIGH", "event", "T1070.001", log_gap)
add("dhcp_network_config", "LOW", "network", None, rows("evtx_events", lambda: c("event_id").between(4198, 4205) & recent("timestamp"), lambda: F.concat(F.lit("dhcp_event_"), c("event_id").cast("string")), "timestamp"))


add("anomalous_routing_svc", "HIGH", "service", "T1599/T1021", (
    rows("services", lambda: low("name").isin("iprip", "remoteaccess", "rrasman", "router", "iphlpsvc_routing"), lambda: F.concat(c("name"), F.lit(" ["), F.coalesce("display_name", F.lit("")), F.lit("]")), "modified", note=lambda: _text("Routing or pivot service present on workstation — binary: ", _or("binary_path"))),
    rows("evtx_events", lambda: c("event_id").isin(29031, 20189, 20190) & recent("timestamp"), lambda: F.concat(F.lit("routing_svc_event_"), c("event_id").cast("string")), "timestamp", kind="event", technique="T1599", note=lambda: _text("Routing service start/stop event: ", _cut("message", 200))),
))
add("mssql_attack_surface", "HIGH", "service", "T1190", (
    rows("services", lambda: (has("name", "mssql") | F.coalesce(has("display_name", "sql server"), F.lit(False))) & low("start_type").isin("auto", "automatic", "2", "autostart"), lambda: c("name"), "modified", note="SQL Server auto-started with mixed auth — sa account may be accessible via SMB named pipe"),
    rows("evtx_events", lambda: (c("event_id") == 15268) & recent("timestamp"), lambda: c("event_id").cast("string"), "timestamp", kind="event", note=lambda: _text("SQL Server mixed-auth mode enabled (EID 15268): ", _cut("message", 200))),
))
add("service_binary_wannacry_ts", "HIGH", "service", "WannaCry/T1543.003", rows("services", lambda: has("binary_path", "mssecsvc", "tasksche", "wannacry"), lambda: F.concat(c("name"), F.lit(": "), F.coalesce("binary_path", F.lit("?"))), "modified"))

# ---- logons


def account() -> Column:
    return F.concat(c("user"), F.lit("@"), F.coalesce("domain", F.lit("")))


def human(*more: str) -> Column:
    """Not a virtual account; a missing domain is an empty one."""
    return ~starts("user", "umfd-", "dwm-") & ~low("user").isin(*VIRTUAL_ACCOUNTS, *more) & ~low(F.coalesce("domain", F.lit(""))).isin("font driver host", "window manager")


add("explicit_credentials", "MED", "auth", "T1550.002", counted("auth_events", lambda: (c("event_id") == 4648) & recent("timestamp") & human(), ["user", "domain"], account, 2, lists=[lambda: F.coalesce("src_ip", F.lit("-")), lambda: F.coalesce("workstation", F.lit("-"))]))
add("pass_the_hash", "HIGH", "auth", "T1550.002", counted("auth_events", lambda: (c("event_id") == 4648) & (c("user") != "") & ~c("user").endswith("$") & human("window manager") & recent("timestamp"), ["user", "domain"], account, 10, lists=[lambda: F.coalesce("src_ip", F.lit("-"))]))
add("brute_force", "HIGH", "ip", "T1110.001", counted("auth_events", lambda: (c("event_id") == 4625) & ~c("src_ip").isin("", "-", "127.0.0.1") & recent("timestamp"), ["src_ip"], lambda: c("src_ip"), 5))
add("rdp_brute_force", "HIGH", "ip", "T1110.001", counted("auth_events", lambda: (c("event_id") == 4625) & (c("logon_type") == 10) & ~c("src_ip").isin("", "-", "127.0.0.1", "::1") & recent("timestamp"), ["src_ip"], lambda: c("src_ip"), 5))
add("anon_smb_cluster", "HIGH", "ip", "T1021.002/EternalBlue", counted("auth_events", lambda: (low("user").isin("anonymous logon", "anonymous", "") | c("user").isNull()) & (c("logon_type") == 3) & recent("timestamp"), [lambda: F.coalesce(F.nullif(c("src_ip"), F.lit("")), F.coalesce("workstation", F.lit("unknown")))], lambda: F.coalesce(F.nullif(c("src_ip"), F.lit("")), F.coalesce("workstation", F.lit("unknown"))), 3))
add("ssh_bruteforce", "HIGH", "ip", None, counted("linux_auth", lambda: c("event_type").isin("ssh_login_failed", "ssh_invalid_user") & (c("src_ip") != ""), ["src_ip"], lambda: c("src_ip"), 20))
add("ad_accounts_with_old_logon", "MED", "user", "T1078", rows("ntds_accounts", lambda: c("sam_account_name").isNotNull() & ~c("sam_account_name").endswith("$") & ~F.coalesce("is_disabled", F.lit(False)) & (c("last_logon").isNull() | (c("last_logon") < F.current_timestamp() - F.expr("INTERVAL 180 DAYS"))), lambda: c("sam_account_name"), "last_logon", distinct=False))

# ---- memory


def with_start(where, value, *kept: str):
    """Command lines with their process's start; kept: what the note needs beside them."""

    def build(case: Case) -> DataFrame:
        start = case["mem_pslist"].select("pid", "ppid", "create_time", c("name").alias("p_name"))
        return case["mem_cmdline"].join(start, "pid").filter(where()).select(value().alias("value"), c("create_time").alias("first_seen"), *kept).distinct()

    return build


add("encoded_powershell", "HIGH", "command", "T1027.010", with_start(lambda: has("cmdline", "-encodedcommand", "-enc ", "-e ") & has("name", "powershell"), lambda: F.left(c("cmdline"), F.lit(300)), "pid", "ppid"))
add("temp_execution", "MED", "process", "T1036.005", with_start(lambda: within("cmdline", "/temp/", "/appdata/local/temp/", "/appdata/roaming/") & c("create_time").isNotNull(), lambda: F.concat(c("p_name"), F.lit(" (PID "), c("pid").cast("string"), F.lit(")")), "cmdline"))
add("ntds_exfil", "HIGH", "process", "T1003.003", with_start(lambda: (has("cmdline", "ntdsutil") & has("cmdline", "ifm", "ntds")) | has("cmdline", "ntds.dit") | (ordered("cmdline", "vssadmin…create shadow") & has("cmdline", "c:")), lambda: F.left(c("cmdline"), F.lit(300))))
add("lsass_targeted_access", "HIGH", "process", "T1003.001", with_start(lambda: has("cmdline", "lsass") & (has("cmdline", "procdump", "tasklist", "processhacker", "-ma ", "sqldumper") | ordered("cmdline", "rundll32…comsvcs")), lambda: F.left(c("cmdline"), F.lit(300))))
add("discovery_recon", "MED", "process", "T1082", with_start(lambda: ordered("cmdline", "whoami…/all", "whoami…/priv", "net user…/domain", "nltest…/domain_trusts", "nltest…/dclist", "ipconfig…/all", "arp…-a") | has("cmdline", "net localgroup"), lambda: F.left(c("cmdline"), F.lit(200))))


def malfind(case: Case) -> DataFrame:
    grade = F.when(low("name").isin(*exe("svchost", "lsass", "services", "csrss", "winlogon", "smss", "wininit", "taskhost", "taskhostw", "spoolsv")), "HIGH").when(low("name").isin(*exe(*BROWSERS, "brave", "node")), "LOW").otherwise("MEDIUM")
    return case["mem_malfind"].select(F.concat(pid_name(), F.lit(" @ "), c("address")).alias("value"), F.lit(None).cast("timestamp").alias("first_seen"), grade.alias("confidence"), "reason")


add("malfind_injection", "HIGH", "process", "T1055", malfind)
add("network_injection", "HIGH", "process", "T1055", lambda case: case["mem_malfind"].filter((c("pid") > 0) & ~low("name").isin(*exe("opera", "chrome", "msedge", "firefox", "brave", "node", "iexplore", "dllhost"))).join(case["mem_netscan"].filter("pid > 0").select("pid"), "pid", "left_semi").select(pid_name().alias("value"), F.lit(None).cast("timestamp").alias("first_seen"), "address").distinct(), ("mem_malfind", "mem_netscan"))
add("hidden_process", "HIGH", "process", "T1055.012", lambda case: case["mem_psscan"].filter(c("pid").between(4, 131072) & (F.length("name") >= 3) & c("exit_time").isNull() & ~F.coalesce("stale_pool", F.lit(False))).join(case["mem_pslist"].select("pid"), "pid", "left_anti").select(pid_name().alias("value"), F.lit(None).cast("timestamp").alias("first_seen")), ("mem_psscan", "mem_pslist"))


def family(case: Case) -> DataFrame:
    """Processes with their parents."""
    ps = case["mem_pslist"]
    child = ps.select(c("pid"), c("ppid"), c("name"), c("create_time"))
    return child.join(ps.select(c("pid").alias("ppid"), c("name").alias("p_name")), "ppid")


def odd_parents(case: Case) -> DataFrame:
    n, p = low("name"), low("p_name")
    odd = any_of(
        [
            n.isin(*exe("cmd", "powershell", "pwsh", "wscript", "cscript", "mshta", "bitsadmin")) & (p == "svchost.exe"),
            n.isin(*exe(*SHELLS, "rundll32", "regsvr32")) & p.isin(*exe("winword", "excel", "powerpnt", "outlook", "onenote", "msaccess", "mspub")),
            (n == "svchost.exe") & ~p.isin(*exe("services", "svchost", "msiexec", "wermgr", "tiworker", "trustedinstaller")),
            n.isin(*exe(*SHELLS)) & p.isin(*exe("vmtoolsd", "vmwaretray", "vmwareuser")),
            n.isin(*exe("cmd", "powershell", "pwsh", "wscript", "cscript")) & p.isin(*exe(*BROWSERS, "brave")),
        ]
    )
    return family(case).filter(odd).select(F.concat(pid_name(), F.lit(" parent="), c("p_name")).alias("value"), c("create_time").alias("first_seen"), "name", "p_name")


add("suspicious_ppid", "HIGH", "process", "T1036.005", odd_parents, ("mem_pslist",))
add("suspicious_parent_child", "HIGH", "process", "T1566.001", lambda case: family(case).filter(low("p_name").isin(*exe("winword", "excel", "powerpnt", "outlook", "msaccess", "chrome", "firefox", "msedge", "iexplore", "acrord32")) & low("name").isin(*exe(*SHELLS, "rundll32", "regsvr32"))).join(case["mem_cmdline"].select("pid", "cmdline"), "pid").select(F.left(c("cmdline"), F.lit(300)).alias("value"), c("create_time").alias("first_seen"), "name", "p_name").distinct())
add("masquerade_path", "HIGH", "process", "T1036.005", rows("mem_cmdline", lambda: (c("cmdline") != "") & c("cmdline").contains("\\") & ~(c("cmdline").contains("SystemRoot") | c("cmdline").contains("windir")) & any_of([(low("name") == f"{n}.exe") & ~within("cmdline", f"/windows/system32/{n}.exe") for n in ("svchost", "lsass", "csrss", "services", "winlogon", "smss", "wininit")]), lambda: F.concat(pid_name(), F.lit(" path="), c("cmdline")), distinct=False), ("mem_cmdline",))
add("cmdline_obfuscation", "HIGH", "process", "T1027", rows("mem_cmdline", lambda: (c("cmdline") != "") & any_of([has("cmdline", " -enc ", " -e ", " -encodedcommand ", " -ec ", " -w hidden", " -windowstyle hidden", "-executionpolicy bypass", "-ep bypass"), (low("name") == "certutil.exe") & has("cmdline", "-urlcache", "-decode"), (low("name") == "wmic.exe") & has("cmdline", "process call create"), (low("name") == "mshta.exe") & has("cmdline", "http", "vbscript", "javascript"), (low("name") == "bitsadmin.exe") & has("cmdline", "/transfer")]), lambda: F.concat(pid_name(), F.lit(": "), F.left(c("cmdline"), F.lit(200)))), ("mem_cmdline",))
command("certutil_download", "HIGH", "certutil download", lambda: has("cmdline", "certutil") & has("cmdline", "-urlcache", "-decode", "http"))
command("mshta_http", "HIGH", "mshta remote", lambda: has("cmdline", "mshta") & has("cmdline", "http", "\\\\"))
command("regsvr32_scrobj", "HIGH", "regsvr32 scrobj", lambda: has("cmdline", "regsvr32") & has("cmdline", "scrobj", "http", "/s /u /i"))
command("shadow_copy_deletion", "HIGH", "shadow delete", lambda: ordered("cmdline", "vssadmin…delete shadows", "wmic…shadowcopy…delete", "wbadmin…delete…catalog", "bcdedit…recoveryenabled…no"))
command("bits_job_download", "MED", "bitsadmin", lambda: has("cmdline", "bitsadmin") & has("cmdline", "/transfer", "/create", "http"))
command("lolbin_wscript", "MED", "wscript", lambda: has("cmdline", "wscript", "cscript") & within("cmdline", "/temp/", "/appdata/", "/downloads/", "/desktop/"))
command("defender_tamper_ps", "HIGH", "defender tamper", lambda: has("cmdline", "set-mppreference") & (ordered("cmdline", "disablerealtimemonitoring…$true") | has("cmdline", "-disablerealtimemonitoring 1")))


def hollow(case: Case) -> DataFrame:
    """Running processes that neither prefetch nor the application cache has seen."""
    ps = case["mem_pslist"].filter(~c("name").startswith("System") & (c("name") != "Idle") & (c("pid") > 4) & c("create_time").isNotNull()).withColumn("_k", low("name"))
    started = case["prefetch"].select(low("filename").alias("_k"))
    cached = case["amcache"].select(basename("path").alias("_k"))
    return ps.join(started, "_k", "left_anti").join(cached, "_k", "left_anti").select(pid_name().alias("value"), c("create_time").alias("first_seen"))


add("hollow_process", "HIGH", "process", "T1055.012", hollow, ("mem_pslist", "prefetch"))

# ---- registry and persistence

add("userassist_suspicious_path", "HIGH", "process", None, rows("userassist", lambda: within("path", "/temp/", "/tmp/", "/appdata/local/temp/", "/downloads/", "/public/", "/recycle"), lambda: c("path"), "last_run"))
add("bam_suspicious_path", "HIGH", "process", None, rows("bam_dam", lambda: within("path", "/temp/", "/tmp/", "/appdata/local/temp/", "/downloads/", "/public/"), lambda: c("path"), "last_run"))
add("uac_bypass_registry", "HIGH", "registry", "T1548.002", rows("registry_raw", lambda: (c("value_data") != "") & c("value_name").isin("", "(Default)") & (any_of([slashed("key_path").rlike(p) for p in ("ms-settings.*shell.*open.*command", "mscfile.*shell.*open.*command", "software/classes/exefile.*shell.*open.*command")]) | within("key_path", "software/classes/ms-settings")), lambda: F.concat(c("key_path"), F.lit(" = "), F.left(c("value_data"), F.lit(200))), "modified"))
add("wmi_subscription", "HIGH", "wmi", "T1546.003", rows("wmi_subs", None, lambda: F.concat(c("consumer_name"), F.lit(" → "), c("filter_name")), "created", distinct=False))
add("wmi_persistence", "HIGH", "process", None, rows("wmi_subs", None, lambda: c("consumer_name"), "created"))
add("new_authorized_key", "MED", "file", None, rows("linux_persistence", lambda: c("type") == "authorized_key", lambda: F.concat(c("path"), F.lit(" ["), c("user"), F.lit("]"))))
add("root_crontab", "HIGH", "process", None, rows("linux_persistence", lambda: (c("type") == "crontab") & c("user").isin("root", ""), lambda: c("command")))
add("new_interactive_user", "MED", "account", None, rows("linux_persistence", lambda: (c("type") == "passwd_entry") & c("enabled") & ~c("command").isin("/bin/false", "/usr/sbin/nologin", "/sbin/nologin"), lambda: c("user")))

# ---- scripts and shells

shell("shell_download_exec", lambda: has("command", "wget", "curl") & (ordered("command", "|…bash", "|…sh", "chmod…x") | has("command", "./")))
shell("shell_reverse_shell", lambda: ordered("command", "nc …-e", "ncat …-e", "bash -i >…/dev/tcp/", "python…pty…spawn", "socat…exec"))
shell("shell_antiforensics", lambda: has("command", "history -c", "shred ", "wipe ", "unset histfile", "export histsize=0") | (has("command", "rm ") & has("command", ".bash_history")))
add("ps_scriptblock_download_cradle", "HIGH", "process", None, rows("ps_scriptblock", lambda: has("script_text", "downloadstring", "invoke-expression", "iex(", "frombase64string", "-enc ", "-encodedcommand") & ~has("script_text", "chocolatey", "copyright", "microsoft.com", "#requires"), lambda: F.left(c("script_text"), F.lit(200)), "timestamp"))

# ---- process creation and sysmon

add("sysmon_office_spawn", "HIGH", "process", "T1566.001", rows("sysmon_process", lambda: is_base("image", *SHELLS, "rundll32") & is_base("parent_image", *OFFICE, *BROWSERS, "acrord32") & recent("timestamp"), lambda: F.left(c("image"), F.lit(300)), "timestamp"), ("sysmon_process",))
add("sysmon_encoded_ps", "HIGH", "process", "T1027.010", rows("sysmon_process", lambda: is_base("image", "powershell", "pwsh") & has("cmdline", "-encodedcommand", "-enc ", "frombase64string", "-e ") & recent("timestamp"), lambda: F.left(c("cmdline"), F.lit(300)), "timestamp"), ("sysmon_process",))
add("sysmon_lolbin", "HIGH", "process", "T1218", rows("sysmon_process", lambda: is_base("image", *LOLBINS, "msbuild", "cmstp", "forfiles", "bitsadmin") & recent("timestamp"), lambda: F.left(c("cmdline"), F.lit(300)), "timestamp"), ("sysmon_process",))
add("sysmon_susp_path", "MED", "process", "T1036", rows("sysmon_process", lambda: within("image", "/temp/", "/appdata/local/temp/", "/appdata/roaming/", "/downloads/", "/public/", "/programdata/") & ends("image", ".exe") & recent("timestamp"), lambda: F.left(c("image"), F.lit(300)), "timestamp"), ("sysmon_process",))
add("sysmon_masquerade_sysname", "HIGH", "process", "T1036.005", rows("sysmon_process", lambda: is_base("image", *SYSTEM) & ~within("image", *SYSTEM_FOLDERS) & recent("timestamp"), lambda: F.left(c("image"), F.lit(300)), "timestamp"), ("sysmon_process",))
add("sysmon_network_external", "HIGH", "ip", "T1071", rows("sysmon_network", lambda: c("initiated") & ~c("dst_ip").isin("0.0.0.0", "-", "") & ~(any_of([c("dst_ip").startswith(x) for x in ("10.", "192.168.", "172.1", "172.2", "172.3")]) | c("dst_ip").isin("127.0.0.1", "::1")) & is_base("image", *SHELLS, "regsvr32", "rundll32", "certutil", "msiexec", "wmic", "bitsadmin", "curl", "wget", "explorer") & recent("timestamp"), lambda: c("dst_ip"), "timestamp"), ("sysmon_network",))
add("sysmon_dns_suspicious", "MED", "domain", "T1071.004", rows("sysmon_dns", lambda: ~c("query_name").isin("", "-") & (is_base("image", *SHELLS, "regsvr32", "rundll32", "certutil") | ends("query_name", ".tk", ".top", ".pw", ".click", ".gq", ".ml") | (F.length(F.substring_index("query_name", ".", 1)) >= 20)) & recent("timestamp"), lambda: c("query_name"), "timestamp"), ("sysmon_dns",))
add("sysmon_unsigned_dll", "HIGH", "file", "T1574.002", rows("sysmon_imageload", lambda: ~c("signed") & ends("image_loaded", ".dll") & within("image_loaded", "/temp/", "/appdata/", "/downloads/", "/public/", "/programdata/") & recent("timestamp"), lambda: c("image_loaded"), "timestamp"), ("sysmon_imageload",))
add("proc_create_lolbin", "HIGH", "process", "T1218", rows("proc_creation", lambda: is_base("image", *LOLBINS, "ieexec", "xwizard", "expand", "extrac32", "pcwrun", "appsyncpublishingserver") & recent("timestamp"), lambda: c("image"), "timestamp"), ("proc_creation",))
add("proc_create_susp_parent", "HIGH", "process", "T1566.001", rows("proc_creation", lambda: is_base("image", *SHELLS) & is_base("parent_image", *OFFICE, *BROWSERS, "acrord32") & recent("timestamp"), lambda: c("image"), "timestamp"), ("proc_creation",))
add("proc_create_susp_path", "MED", "process", "T1036", rows("proc_creation", lambda: within("image", "/temp/", "/appdata/local/temp/", "/appdata/roaming/", "/downloads/", "/public/") & ends("image", ".exe") & recent("timestamp"), lambda: c("image"), "timestamp"), ("proc_creation",))

# ---- remote access, crashes, transfers

add("anydesk_incoming_session", "HIGH", "network", "T1219", rows("anydesk_sessions", lambda: c("direction") == "Incoming", lambda: F.concat(F.coalesce(F.nullif(c("anydesk_id"), F.lit("")), F.coalesce("client_alias", F.lit("unknown"))), F.lit(" ["), c("direction"), F.lit("]")), "timestamp"), ("anydesk_sessions",))
add("anydesk_unattended_config", "MED", "config", "T1219", rows("anydesk_config", lambda: has("key", "unattended", "permission") | (c("key") == "ad.anynet.fpr"), lambda: F.concat(c("key"), F.lit("="), c("value"))), ("anydesk_config",))
add("wer_crash_suspicious_app", "MED", "process", "T1203", rows("wer_crashes", lambda: recent("crash_time") & (low("app_name").isin(*exe("taskhost", "lsass", "svchost", "services", "spoolsv", "winlogon", "csrss", "wininit")) | c("exception_code").isin("c0000005", "c0000374", "80000003", "c0000409")), lambda: F.concat(c("app_name"), F.lit(" [exc="), F.coalesce("exception_code", F.lit("?")), F.lit("]")), "crash_time"), ("wer_crashes",))
add("bits_suspicious_download", "HIGH", "url", "T1197", lambda case: case["bits_files"].filter(c("remote_url").isNotNull() & ~c("remote_url").rlike(r"^https://.*\.(?:microsoft|windowsupdate|windows)\.com/") & ~c("remote_url").startswith("https://ctldl.windowsupdate.com/")).join(case["bits_jobs"].select("job_guid", "created_at", "job_name", "owner", "state_name"), "job_guid").select(c("remote_url").alias("value"), c("created_at").alias("first_seen"), "job_name", "owner", "state_name"))

BY_ID = {d.ident: d for d in DETECTORS}


def run_detectors(case: Case, only: list[str] | None = None, errors: dict[str, str] | None = None) -> DataFrame:
    """Findings of all detectors (or those named) whose required tables hold rows.

    A detector whose tables are missing or empty gives no rows. Detectors that
    filter or count rows of a table share one scan and one aggregation of it. One
    that can't be planned on this case (a column of another type, say) is left
    out and recorded in ``errors``, the others run; without ``errors`` it is raised.
    """
    chosen = [BY_ID[i] for i in only] if only else DETECTORS
    ready = [d for d in chosen if all(case.has_rows(t) for t in d.requires)]
    frames: list[DataFrame] = []
    shared: dict[str, list[tuple[Detector, Rows | Counted]]] = {}

    def planned(ds: list[tuple[Detector, Rows | Counted | None]], table: str | None) -> None:
        try:
            frames.append(fused(case, table, ds) if table else ds[0][0].run(case))
        except AnalysisException as e:
            if errors is None:
                raise
            if len(ds) == 1:
                errors[ds[0][0].ident] = str(e).splitlines()[0]
            else:  # find out which of them it is
                for item in ds:
                    planned([item], table)

    for d in ready:
        parts = d.parts()
        if not parts:
            planned([(d, None)], None)
        for part in parts:
            shared.setdefault(part.table, []).append((d, part))
    for table, items in shared.items():
        if case.has(table):
            planned(items, table)
    return union(case, frames)


__all__ = ["BY_ID", "DETECTORS", "all_of", "joined", "run_detectors"]
